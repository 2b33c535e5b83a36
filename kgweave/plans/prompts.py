"""From questions to requests, and from responses to answers.

The model call itself is an external service; these are the batch steps on
both sides of it, over whole tables of questions and responses.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.columns import ordered_lines, shown
from kgweave.functions.sizing import PUSHED_IDS, as_seeds, one_row, pinned
from kgweave.model import BOTH
from kgweave.operators.mentions import mention_table
from kgweave.operators.stats import (
    category_metrics,
    count_edges,
    count_nodes,
    edge_count,
)
from kgweave.plans.summaries import category_summary, node_summary_by_name

# Texts that stand in for an answer or a context.
NO_CONTEXT = "No specific node data available."
CATEGORY_VIEW = "Category Overview"
NO_SELECTION = "no selection"
NO_TEXT = "No response received"
NOT_JSON = "Llama query failed: the body is not JSON"
REFUSED = "Llama API Error: "
REFUSED_COMPACT = "LLM Error "
NO_TEXT_KEYS = "Response received but couldn't extract text. Keys found: "
NO_TEXT_KEYS_COMPACT = "Unexpected format: "

# Prompt texts by what they offer the model; the slots name columns.
TEMPLATES = {
    "stats": (
        "Facts about the current selection\n"
        "node: {selected_node}\n"
        "connections: {connected_count}\n"
        "direction: {direction}\n"
        "nodes in graph: {total_nodes}\n"
        "edges in graph: {total_edges}\n\n"
        "Conversation so far\n{history}\n\n"
        "Question: {question}\n"
    ),
    "grounded": (
        "Use nothing but these graph facts.\n{context}\n\n"
        "nodes in graph: {total_nodes}\n"
        "edges in graph: {total_edges}\n"
        "view: {direction}\n\n"
        "Conversation so far\n{history}\n\n"
        "Question: {question}\n"
    ),
    "hybrid": (
        "Start from these graph facts, then add what is commonly known.\n"
        "{context}\n\n"
        "Say which part comes from the graph and which does not.\n\n"
        "Question: {question}\n"
    ),
    "overview": (
        "{summary}\n\nView: {focus}\n\n"
        "Look the answer up in the summary; keep general remarks short.\n\n"
        "Question: {question}\n"
    ),
    "plain": (
        "Graph facts\n{context}\n\nConversation so far\n{history}\n\n"
        "Question: {question}\n"
    ),
    "examples": (
        "Answer from the graph facts only; say so when they do not hold the "
        "answer.\n\n"
        "Sample question: Which parts does the supplier deliver?\n"
        "Sample answer: According to the graph, bolts and rings.\n"
        "Sample question: How old is the supplier?\n"
        "Sample answer: The graph does not say.\n\n"
        "Graph facts\n{context}\n\nConversation so far\n{history}\n\n"
        "Question: {question}\n"
    ),
    "strict": (
        "Answer from the graph facts only. If they do not hold the answer, "
        "reply: The graph does not say.\n"
        "Graph facts\n{context}\nConversation so far\n{history}\n"
        "Question: {question}\n"
    ),
}

# Generation parameters of the request presets.
PRESETS = {
    "sampled": {
        "max_new_tokens": 500,
        "temperature": 0.7,
        "do_sample": True,
        "return_full_text": False,
    },
    "factual": {
        "max_new_tokens": 500,
        "temperature": 0.3,
        "do_sample": True,
        "return_full_text": False,
    },
    "short": {"max_new_tokens": 500, "temperature": 0.3},
    "long": {"max_new_tokens": 1000, "temperature": 0.3},
}


def stats_context(
    nodes: DataFrame,
    edges: DataFrame,
    seeds,
    direction: str | None = BOTH,
    small: bool | None = None,
) -> DataFrame:
    """Per seed: its name, its edge count in the direction, graph totals."""
    seeds = as_seeds(nodes.sparkSession, seeds, small)
    counts = edge_count(edges, seeds, direction)
    named = seeds.keep(nodes.select("node_id", "name"), "node_id")
    return _with_totals(
        counts.join(named, F.col("seed_id") == F.col("node_id")).select(
            "seed_id",
            F.col("name").alias("selected_node"),
            F.col("edge_count").alias("connected_count"),
            F.lit(direction).cast("string").alias("direction"),
        ),
        nodes,
        edges,
    )


def stats_for(
    questions: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    direction: str | None = BOTH,
    small: bool | None = None,
) -> DataFrame:
    """Every question with the facts of its ``seed_id``; one whose seed is no
    node, or null, stands without selection and connections."""
    seeds = questions.select(F.col("seed_id").alias("node_id"))
    facts = stats_context(nodes, edges, seeds, direction, small)
    met = questions.join(
        facts.select("seed_id", "selected_node", "connected_count", F.lit(True).alias("_met")),
        "seed_id",
        "left",
    )
    name = F.when(F.col("_met").isNull(), NO_SELECTION).otherwise(F.col("selected_node"))
    filled_in = {
        "selected_node": name,
        "connected_count": F.coalesce("connected_count", F.lit(0)),
        "direction": F.lit(direction).cast("string"),
    }
    return _with_totals(met.withColumns(filled_in).drop("_met"), nodes, edges)


def category_stats_context(
    nodes: DataFrame, edges: DataFrame, labels: list[str] | None = None
) -> DataFrame:
    """The same for category views: size, touching edges, graph totals."""
    return _with_totals(
        category_metrics(nodes, edges, labels).select(
            "label",
            F.col("node_count").alias("category_count"),
            F.col("connections").alias("connected_count"),
            F.lit(CATEGORY_VIEW).alias("direction"),
        ),
        nodes,
        edges,
    )


def _with_totals(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        one_row(count_nodes(nodes)).alias("total_nodes"),
        one_row(count_edges(edges)).alias("total_edges"),
    )


def context_for(
    questions: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10
) -> DataFrame:
    """``(question_id, context)`` by the question's view.

    ``view`` is ``node`` (``selected`` is a name), ``category`` (``selected``
    is a label) or anything else for no selection.  Texts are built once per
    distinct selection and joined to the questions.
    """
    selected = F.col("selected").isNotNull()
    on_node = questions.filter((F.col("view") == "node") & selected)
    on_category = questions.filter((F.col("view") == "category") & selected)
    neither = questions.filter(
        ~F.coalesce(F.col("view").isin("node", "category"), F.lit(False)) | ~selected
    )
    # All selections are looked at once; if few, names and labels go on as lists.
    chosen = questions.filter(F.col("view").isin("node", "category") & selected)
    held = pinned(chosen.select("view", "selected"), PUSHED_IDS + 1).rows
    if held.num_rows <= PUSHED_IDS:
        pairs = dict.fromkeys(zip(*(c.to_pylist() for c in held.columns)))
        names = [value for view, value in pairs if view == "node"]
        labels = [value for view, value in pairs if view == "category"]
    else:
        names = on_node.select(F.col("selected").alias("name")).distinct()
        labels = on_category.select(F.col("selected").alias("label")).distinct()
    node_texts = node_summary_by_name(nodes, edges, names, k)
    category_texts = category_summary(nodes, edges, labels)
    return (
        on_node.join(node_texts, F.col("selected") == F.col("name"))
        .select("question_id", F.col("summary").alias("context"))
        .unionByName(
            on_category.join(
                category_texts, F.col("selected") == F.col("label")
            ).select("question_id", F.col("summary").alias("context"))
        )
        .unionByName(neither.select("question_id", F.lit(NO_CONTEXT).alias("context")))
    )


def fill(template: str, columns: dict[str, Column] | None = None) -> Column:
    """A template as a column; slots are columns of the same name by default."""
    columns = columns or {}
    parts = []
    for text, slot, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if slot:
            parts.append(shown(columns.get(slot, F.col(slot))))
    return F.concat(*parts)


def slots(template: str) -> list[str]:
    return [slot for _, slot, _, _ in Formatter().parse(template) if slot]


def build_prompt(questions: DataFrame, template: str) -> DataFrame:
    """``(question_id, prompt)`` from a table that holds the template's slots."""
    text = TEMPLATES[template]
    missing = [slot for slot in slots(text) if slot not in questions.columns]
    if missing:
        raise ValueError(f"template {template!r} needs columns {missing}")
    return questions.select("question_id", fill(text).alias("prompt"))


def focus_line(view: Column, selected: Column) -> Column:
    """What the asker is looking at, for the ``overview`` template."""
    return (
        F.when(selected.isNull(), F.lit("whole graph"))
        .when(view == "category", F.concat(F.lit("category "), selected))
        .otherwise(F.concat(F.lit("node "), selected))
    )


def request_payload(prompts: DataFrame, preset: str = "factual") -> DataFrame:
    """``(question_id, payload)``: the JSON body of each request."""
    parameters = F.struct(*(F.lit(v).alias(k) for k, v in PRESETS[preset].items()))
    body = F.struct(F.col("prompt").alias("inputs"), parameters.alias("parameters"))
    return prompts.select("question_id", F.to_json(body).alias("payload"))


def parse_response(responses: DataFrame, mode: str = "strict") -> DataFrame:
    """``(request_id, answer)`` from raw responses ``(request_id, status, body)``.

    ``early`` accepts list, object and chat-style bodies and falls back to the
    raw body; ``strict`` reports the keys of a body without text; ``compact``
    takes every status below 400.
    """
    if mode not in ("early", "strict", "compact"):
        raise ValueError(f"unknown mode {mode!r}")
    body, status = F.col("body"), F.col("status")
    answers = {"early": _early, "strict": _strict, "compact": _compact}
    # Bound once, so that the body is parsed once whatever is asked of it.
    parsed = F.array(F.expr("try_parse_json(body)"))
    text = F.transform(parsed, lambda value: answers[mode](value, body))[0]
    code = status.cast("string")
    if mode == "compact":
        refused = F.concat(F.lit(REFUSED_COMPACT), code, F.lit(": "), shown(body))
        answer = F.when(status < 400, text).otherwise(refused)
    else:
        refused = F.concat(F.lit(REFUSED), code, F.lit(" - "), shown(body))
        answer = F.when(status == 200, text).otherwise(refused)
    return responses.select("request_id", answer.alias("answer"))


def _at(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _length(value: Column) -> Column:
    """Elements of a body that is a list; null for any other."""
    return F.size(_at(value, "$", "array<variant>"))


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _key_list(body: Column) -> Column:
    """Keys in the order of the text, which a parsed body does not keep."""
    keys = F.json_object_keys(body)
    listed = F.concat(F.lit("['"), F.array_join(keys, "', '"), F.lit("']"))
    return F.when(F.size(keys) == 0, "[]").otherwise(listed)


IN_LIST, IN_OBJECT = "$[0].generated_text", "$.generated_text"
IN_CHOICES = "$.choices[0].message.content"


def _early(value: Column, body: Column) -> Column:
    return (
        F.when(value.isNull(), NOT_JSON)
        .when(_length(value) > 0, F.coalesce(_at(value, IN_LIST), F.lit(NO_TEXT)))
        .when(_at(value, IN_OBJECT).isNotNull(), _at(value, IN_OBJECT))
        .when(
            _at(value, "$.choices", "variant").isNotNull(),
            F.coalesce(_at(value, IN_CHOICES), F.lit(NO_TEXT)),
        )
        .otherwise(body)
    )


def _strict(value: Column, body: Column) -> Column:
    report = F.when(_is_object(value), _key_list(body)).otherwise("Not a dict")
    return (
        F.when(value.isNull(), NOT_JSON)
        .when((_length(value) > 0) & (_at(value, IN_LIST) != ""), _at(value, IN_LIST))
        .when(_is_object(value) & _at(value, IN_OBJECT).isNotNull(), _at(value, IN_OBJECT))
        .otherwise(F.concat(F.lit(NO_TEXT_KEYS), report))
    )


def _compact(value: Column, body: Column) -> Column:
    report = F.when(_is_object(value), _key_list(body)).otherwise("not an object")
    return (
        F.when(_length(value) > 0, F.coalesce(_at(value, IN_LIST), F.lit("")))
        .when(_at(value, IN_OBJECT).isNotNull(), _at(value, IN_OBJECT))
        .otherwise(F.concat(F.lit(NO_TEXT_KEYS_COMPACT), report))
    )


# The heading and the bullet of each enrichment mode.
HEADINGS = {
    "names": "\n\n**More context:**\n",
    "terms": "\n\n**Related Concepts from the Graph:**\n",
}


def _bullet(mode: str) -> Column:
    name = F.col("name")
    if mode == "names":
        return F.concat(F.lit("• "), name, F.lit(" is a key element in this graph."))
    return F.concat(
        F.lit("• **"),
        name,
        F.lit("** is a **"),
        shown(F.col("label")),
        F.lit("** related to the knowledge graph."),
    )


def enrich_answers(
    answers: DataFrame, nodes: DataFrame, mode: str = "terms"
) -> DataFrame:
    """``(answer_id, answer)`` with the graph's names in it as bullet lines.

    Bullets follow the order in which the nodes hold the names.  An answer
    that mentions nothing is unchanged.  The bullets of an answer are bounded
    by the names its own text contains.
    """
    found = mention_table(answers, nodes, mode, "answer_id", "answer")
    bullets = found.groupBy("answer_id").agg(
        ordered_lines(
            [F.col("first_id"), F.col("name"), F.col("label")], _bullet(mode)
        ).alias("bullets")
    )
    enriched = F.when(
        F.col("bullets").isNotNull(),
        F.concat("answer", F.lit(HEADINGS[mode]), "bullets"),
    ).otherwise(F.col("answer"))
    return answers.join(bullets, "answer_id", "left").select(
        "answer_id", enriched.alias("answer")
    )
