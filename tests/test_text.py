import json

import pytest
from pyspark.sql import functions as F

from kgweave.operators import chat, mentions
from kgweave.functions import sizing
from kgweave.plans import prompts, summaries

ANN = """Node: Ann (Type: Person)

Outgoing Relationships:
  → Bob (Person) via 'knows'
  → Acme (Company) via 'founded'
  → Acme (Company) via 'works_at'

Incoming Relationships:
  ← Bob (Person) via 'knows'
  ← Acme (Company) via 'employs'
  ← Nil () via 'sees'

Node Properties: {"age":"30"}"""
CY = """Node: Cy (Type: Person)

Outgoing Relationships:
  → Java (Language) via 'uses'

Incoming Relationships:"""


@pytest.mark.parametrize("small", [True, False, None])
def test_node_summary(nodes, edges, small):
    texts = summaries.node_summary(nodes, edges, nodes, small=small)
    text = {r["node_id"]: r["summary"] for r in texts.collect()}
    assert len(text) == 12
    assert text[1] == ANN
    # Only a dangling edge comes in: the header stands alone.
    assert text[3] == CY
    assert text[8] == "Node: Dot (Type: Person)"


def test_node_summary_compact(nodes, edges):
    row = summaries.node_summary(nodes, edges, [1], 1, "compact").first()
    assert row["summary"] == (
        "Node: Ann (Type: Person)\n\nOutgoing:\n  → Bob (Person) via 'knows'"
        "\n\nIncoming:\n  ← Bob (Person) via 'knows'"
    )


def test_node_summary_by_name(spark, nodes, edges):
    names = spark.createDataFrame([("Ann",), ("Zoe",)], "name string")
    for small in (True, False, None):
        texts = summaries.node_summary_by_name(nodes, edges, names, small=small)
        text = {r["name"]: r["summary"] for r in texts.collect()}
        assert text["Ann"] == ANN
        assert text["Zoe"] == "Node 'Zoe' not found in the knowledge graph."


def test_category_summary(nodes, edges):
    texts = summaries.category_summary(nodes, edges, ["Company", "Zip", "All"])
    text = {r["label"]: r["summary"] for r in texts.collect()}
    assert text["Company"].startswith("Nodes in 'Company' category:\n\nNode: Acme")
    assert text["Company"].count("-" * 40) == 3
    assert text["Company"].endswith("→ Java (Language) via 'uses'\n" + "-" * 40)
    assert text["Zip"] == "Nodes in 'Zip' category:\n"
    assert text["All"].startswith("Sample nodes from entire graph:\n\nNode: Ann")
    assert text["All"].count("-" * 40) == 5


def test_category_summary_by_name_repeats_the_first_node(nodes, edges):
    texts = summaries.category_summary(nodes, edges, ["Company"], by="name")
    # The company Ann is looked up by name and yields the person Ann.
    assert "Node: Ann (Type: Person)" in texts.first()["summary"]


def test_every_category(nodes, edges):
    labels = [r["label"] for r in summaries.category_summary(nodes, edges).collect()]
    assert sorted(labels) == [" ", "Company", "Language", "Person", "nan"]


def test_graph_summary(nodes, edges):
    text = summaries.graph_summary_text(nodes, edges).first()["summary"]
    assert text.splitlines() == [
        "COMPLETE KNOWLEDGE GRAPH:",
        "-  : 1 nodes",
        "- Company: 3 nodes",
        "- Language: 2 nodes",
        "- Person: 4 nodes",
        "- nan: 1 nodes",
        "",
        "KEY RELATIONSHIPS:",
        "  Acme (Company) → Ann (Person) via 'employs'",
        "  Acme (Company) →  (Language) via 'uses'",
        "  Beta (Company) → Acme (Company) via 'owns'",
        "  Ann (Company) → Java (Language) via 'uses'",
        "  Ann (Person) → Bob (Person) via 'knows'",
        "  Ann (Person) → Acme (Company) via 'founded'",
        "  Bob (Person) → Ann (Person) via 'knows'",
        "  Bob (Person) → Bob (Person) via 'likes'",
        "  Cy (Person) → Java (Language) via 'uses'",
    ]


def test_sample_context(nodes, edges):
    first = summaries.sample_context(nodes, edges, n=2).first()["context"]
    assert first.split("\n\nNode: ")[1].startswith("Bob")
    top = summaries.sample_context(nodes, edges, "most_connected", 3).first()["context"]
    assert [line for line in top.splitlines() if line.startswith("Node:")] == [
        "Node: Ann (Type: Person)",
        "Node: Bob (Type: Person)",
        "Node: Acme (Type: Company)",
    ]


@pytest.fixture(scope="module")
def conv(spark):
    long = [(1, t, "user" if t % 2 == 0 else "ai", f"m{t}") for t in range(9)]
    return spark.createDataFrame(
        long + [(2, 0, "user", "only")], "conv_id bigint, turn bigint, role string, text string"
    )


def test_history(conv):
    history = {r[0]: r[1] for r in chat.format_history(conv).collect()}
    assert history[1] == "Ai: m3\nUser: m4\nAi: m5\nUser: m6\nAi: m7"
    assert history[2] == "No previous conversation."
    whole = {r[0]: r[1] for r in chat.format_history(conv, 2, False).collect()}
    assert whole == {1: "Ai: m7\nUser: m8", 2: "User: only"}


def test_turns(spark, conv, rows):
    last = chat.last_turns(conv, 3).filter("conv_id = 1")
    assert [r["turn"] for r in last.collect()] == [6, 7, 8]
    whole = chat.last_turns(conv, None)
    assert [r["turn"] for r in whole.collect()] == [*range(9), 0]
    assert chat.last_turns(conv, None).count() == 10
    assert chat.previous_turns(conv).count() == 8
    cleared = spark.createDataFrame([(1,)], "conv_id bigint")
    assert rows(chat.clear_history(conv, cleared), "conv_id") == [(2,)]
    new = spark.createDataFrame(
        [(1, 2, "ai", "b"), (1, 1, "user", "a"), (7, 1, "user", "c")],
        "conv_id bigint, step int, role string, text string",
    )
    added = chat.append_turns(conv, new)
    assert rows(added.filter("text IN ('a', 'b', 'c')"), "conv_id", "turn", "text") == [
        (1, 10, "b"),
        (1, 9, "a"),
        (7, 0, "c"),
    ]


def test_stats_context(nodes, edges, rows):
    facts = prompts.stats_context(nodes, edges, [1, 2], "Both")
    assert rows(facts) == [(1, "Ann", 6, "Both", 12, 14), (2, "Bob", 4, "Both", 12, 14)]
    facts = prompts.category_stats_context(nodes, edges, ["Person"])
    assert rows(facts) == [("Person", 4, 11, "Category Overview", 12, 14)]


def test_context_for(spark, nodes, edges):
    questions = spark.createDataFrame(
        [
            (1, "node", "Ann"),
            (2, "node", "Zoe"),
            (3, "category", "Zip"),
            (4, None, None),
            (5, "node", None),
            (6, "category", "Company"),
        ],
        "question_id int, view string, selected string",
    )
    text = dict(
        (r[0], r[1]) for r in prompts.context_for(questions, nodes, edges).collect()
    )
    assert text[1] == ANN
    assert text[2].endswith("not found in the knowledge graph.")
    assert text[3] == "Nodes in 'Zip' category:\n"
    assert text[4] == text[5] == "No specific node data available."
    assert text[6].count("Node: ") == 3


@pytest.mark.parametrize("template", prompts.TEMPLATES)
def test_prompts_fill_every_slot(spark, template):
    slots = prompts.slots(prompts.TEMPLATES[template])
    row = spark.range(1).select(
        F.col("id").alias("question_id"), *(F.lit(f"<{s}>").alias(s) for s in slots)
    )
    prompt = prompts.build_prompt(row, template).first()["prompt"]
    assert all(f"<{slot}>" in prompt for slot in slots) and "{" not in prompt
    with pytest.raises(ValueError, match="needs columns"):
        prompts.build_prompt(row.drop(slots[0]), template)


SAMPLED = {"max_new_tokens": 500, "temperature": 0.7, "do_sample": True, "return_full_text": False}
PAYLOADS = {
    "sampled": SAMPLED,
    "factual": SAMPLED | {"temperature": 0.3},
    "short": {"max_new_tokens": 500, "temperature": 0.3},
    "long": {"max_new_tokens": 1000, "temperature": 0.3},
}


@pytest.mark.parametrize("preset", PAYLOADS)
def test_payload(spark, preset):
    asked = spark.createDataFrame([(1, 'say "hi"\n→')], "question_id int, prompt string")
    payload = json.loads(prompts.request_payload(asked, preset).first()["payload"])
    assert payload == {"inputs": 'say "hi"\n→', "parameters": PAYLOADS[preset]}


def test_stats_for_every_question(spark, nodes, edges):
    asked = spark.createDataFrame([(1, 1), (2, 77), (3, None), (4, 9)], "question_id int, seed_id bigint")
    facts = prompts.stats_for(asked, nodes, edges)
    got = sorted((r.question_id, r.selected_node, r.connected_count, r.total_nodes, r.total_edges) for r in facts.collect())
    assert got == [(1, "Ann", 6, 12, 14), (2, "no selection", 0, 12, 14), (3, "no selection", 0, 12, 14), (4, None, 1, 12, 14)]


def test_many_selections_give_the_same_texts(spark, nodes, edges, monkeypatch):
    rows = [(1, "node", "Ann"), (2, "category", "Company"), (3, "node", "Zoe"), (4, None, "x"), (5, "node", "Ann")]
    questions = spark.createDataFrame(rows, "question_id int, view string, selected string")
    few = sorted(map(tuple, prompts.context_for(questions, nodes, edges).collect()))
    monkeypatch.setattr(prompts, "PUSHED_IDS", 1)
    monkeypatch.setattr(sizing, "PUSHED_IDS", 1)
    assert sorted(map(tuple, prompts.context_for(questions, nodes, edges).collect())) == few


def test_a_body_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, 200, "{}")], "request_id int, status int, body string")
    for mode in ("early", "strict", "compact"):
        plan = prompts.parse_response(rows, mode)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") + plan.count("parseJson") <= 1 and "get_json_object" not in plan


RESPONSES = [
    (200, '[{"generated_text":"a"}]', "a", "a", "a"),
    (200, '{"generated_text":"b"}', "b", "b", "b"),
    (
        200,
        '{"choices":[{"message":{"content":"c"}}]}',
        "c",
        "Response received but couldn't extract text. Keys found: ['choices']",
        "Unexpected format: ['choices']",
    ),
    (
        200,
        '{"z":1}',
        '{"z":1}',
        "Response received but couldn't extract text. Keys found: ['z']",
        "Unexpected format: ['z']",
    ),
    (
        200,
        "[]",
        "[]",
        "Response received but couldn't extract text. Keys found: Not a dict",
        "Unexpected format: not an object",
    ),
    (
        200,
        '[{"generated_text":""}]',
        "",
        "Response received but couldn't extract text. Keys found: Not a dict",
        "",
    ),
    (200, '[{"x":1}]', "No response received", None, ""),
    (503, "busy", *["Llama API Error: 503 - busy"] * 2, "LLM Error 503: busy"),
    (201, '{"generated_text":"d"}', *['Llama API Error: 201 - {"generated_text":"d"}'] * 2, "d"),
]


def test_parse_response(spark):
    table = spark.createDataFrame(
        [(i, r[0], r[1]) for i, r in enumerate(RESPONSES)],
        "request_id int, status int, body string",
    )
    for column, mode in enumerate(("early", "strict", "compact"), 2):
        answers = prompts.parse_response(table, mode).orderBy("request_id").collect()
        for answer, response in zip(answers, RESPONSES):
            if response[column] is not None:
                assert answer["answer"] == response[column], (mode, response)


def test_body_that_is_not_json(spark):
    table = spark.createDataFrame([(1, 200, "oops {")], "request_id int, status int, body string")
    for mode in ("early", "strict"):
        assert "failed" in prompts.parse_response(table, mode).first()["answer"]


def brute_force(texts, names):
    return sorted(
        {(i, n) for i, text in texts for n in names if n.strip() and n.strip().lower() in text.lower()}
    )


def test_mentions_match_brute_force(spark):
    """Short, long, nested, repeated and blank names; texts across cut sizes."""
    long_name = "x" * 70 + "yz"
    names = ["a", "ab", "abc", "Abcd", "abcde", " ab ", "", "  ", "é", "ÉÀ→", long_name]
    names += ["x" * 64, "bcda" * 20, "Same Start 1", "Same Start 12", "zz top"]
    texts = [
        "",
        "a",
        "xxABCDExx",
        "no such thing",
        "é éà→ same start 123",
        "b" * 63 + "Zz Top" + "b" * 200,
        "q" * 2045 + "same start 1" + "q" * 3000 + long_name + "!",
        "q" * 32766 + "zZ tOP",
        "bcda" * 19,
        "bcda" * 21,
        "y" * 64 + "x" * 64,
    ]
    nodes = spark.createDataFrame(
        [(i, "L", n) for i, n in enumerate(names)] + [(99, None, None)],
        "node_id bigint, label string, name string",
    )
    table = spark.createDataFrame(
        list(enumerate(texts)) + [(99, None)], "text_id int, text string"
    )
    found = mentions.mention_table(table, nodes)
    assert sorted(
        {(r["text_id"], r["name"]) for r in found.collect()}
    ) == sorted({(i, n.strip()) for i, n in brute_force(enumerate(texts), names)})


def test_names_after_pairs_of_surrogates(spark):
    nodes = spark.createDataFrame([(1, "L", "b😀c"), (2, "L", "cd"), (3, "L", "😀😀")], "node_id bigint, label string, name string")
    table = spark.createDataFrame([(1, "a😀b😀😀b😀cd"), (2, "😀" * 700 + "cd")], "text_id int, text string")
    found = mentions.mention_table(table, nodes)
    assert sorted((r["text_id"], r["first_id"]) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)]


def test_few_beginnings_are_spelled_out(spark, monkeypatch):
    """Only starts of names become rows; the other way to find them gives the same."""
    names = ["en", "e", "web", "doc1", "doc12", "[a]", "a.b", "b😀c", "\\", "z" * 70, "İx"]
    texts = ["the en DOC123 a.b axb [A] web\\", "😀b😀c" * 400, "q" * 508 + "doc12" + "y" * 600 + "z" * 71, "i̇x", ""]
    nodes = spark.createDataFrame([(i, "L", n) for i, n in enumerate(names)], "node_id bigint, label string, name string")
    table = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    spelled = mentions.mention_table(table, nodes)
    assert "posexplode" not in spelled._jdf.queryExecution().optimizedPlan().toString()
    found = sorted((r["text_id"], r["name"]) for r in spelled.collect())
    assert found == sorted(brute_force(enumerate(texts), names))
    monkeypatch.setattr(mentions, "SPELLED", 0)
    assert sorted((r["text_id"], r["name"]) for r in mentions.mention_table(table, nodes).collect()) == found


def test_names_mode_keeps_spaces_and_blanks(spark):
    nodes = spark.createDataFrame(
        [(1, "L", " ab"), (2, "L", "")], "node_id bigint, label string, name string"
    )
    table = spark.createDataFrame([(1, "ab"), (2, "x AB"), (3, "")], "text_id int, text string")
    found = mentions.mention_table(table, nodes, "names")
    assert sorted((r["text_id"], r["name"]) for r in found.collect()) == [
        (1, ""),
        (2, ""),
        (2, " ab"),
        (3, ""),
    ]


def test_enrich_answers(spark, nodes):
    answers = spark.createDataFrame(
        [(1, "ANN and acme"), (2, "nothing"), (3, None)], "answer_id int, answer string"
    )
    terms = {r[0]: r[1] for r in prompts.enrich_answers(answers, nodes).collect()}
    assert terms == {
        1: "ANN and acme\n\n**Related Concepts from the Graph:**\n"
        "• **Ann** is a **Person** related to the knowledge graph.\n"
        "• **Acme** is a **Company** related to the knowledge graph.\n"
        "• **Ann** is a **Company** related to the knowledge graph.",
        2: "nothing",
        3: None,
    }
    names = {r[0]: r[1] for r in prompts.enrich_answers(answers, nodes, "names").collect()}
    assert names[1] == (
        "ANN and acme\n\n**More context:**\n• Ann is a key element in this graph.\n"
        "• Acme is a key element in this graph."
    )
