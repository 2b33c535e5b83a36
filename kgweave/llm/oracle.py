"""DuckDB SQL of the queries that SQL can say."""


def _raking(rounds: int = 12) -> str:
    """Rounds of raking over source, lang and topic, each margin a window sum."""
    powers = {"source": 0.7, "lang": 0.7, "topic": 0.9}
    goals = ", ".join(
        f"(sum(tokens) OVER (PARTITION BY {d})) AS margin_{d}" for d in powers
    )
    weights = ", ".join(
        f"power(margin_{d}, {p}) / (SELECT sum(power(t, {p})) FROM (SELECT sum(tokens) AS t FROM cells GROUP BY {d})) "
        f"* 0.7 * (SELECT sum(tokens) FROM cells) AS goal_{d}"
        for d, p in powers.items()
    )
    steps, last = [], "start"
    for i in range(rounds):
        for d in powers:
            name = f"r{i}_{d}"
            ratio = f"CASE WHEN sum(tokens * least(factor, 1.0)) OVER (PARTITION BY {d}) > 0 THEN goal_{d} / sum(tokens * least(factor, 1.0)) OVER (PARTITION BY {d}) ELSE 1.0 END"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (least(factor * {ratio}, 1e6) AS factor) FROM {last})")
            last = name
    return f"""
WITH docs AS MATERIALIZED (
  SELECT *, coalesce(source, '') AS s, coalesce(lang, '') AS l,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
described AS MATERIALIZED (
  SELECT *, CASE WHEN text IS NULL THEN 'none'
    WHEN 8 * length(regexp_replace(text, '[^|]', '', 'g')) >= n_tokens THEN CASE WHEN length(text) > 0 THEN 'list' ELSE 'none' END
    WHEN upper(text) = text THEN 'caps' ELSE 'prose' END AS topic FROM docs),
cells AS MATERIALIZED (
  SELECT s AS source, l AS lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM described GROUP BY ALL),
margins AS (SELECT *, {goals} FROM cells),
start AS MATERIALIZED (SELECT *, {weights}, 0.7::DOUBLE AS factor FROM margins),
{", ".join(steps)}
SELECT doc_id, d.lang, d.source, d.topic, n_tokens, round(least(factor, 1.0), 6) AS probability,
  ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < least(factor, 1.0) AS kept
FROM described d JOIN {last} c ON d.s = c.source AND d.l = c.lang AND d.topic = c.topic
"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    start = "[4294967295::UBIGINT]"
    letters = f"list_transform(string_split({text}, ''), lambda z: ord(z)::UBIGINT)"
    bits = "lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT))"
    return f"xor(list_reduce(list_concat({start}, {letters}), lambda p, q: list_reduce([xor(p, q), 0, 0, 0, 0, 0, 0, 0, 0], {bits})), 4294967295::UBIGINT)"


def _repair_step() -> str:
    """One row x taken by the audits p of the four states: least of all edits, as cost in six digits and letters."""
    add = lambda state, cost, letters: f"(lpad((left({state}, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({state}, 7) || '{letters}')"
    stays = "x.f NOT IN ('b', 'd')"
    cut = "(CASE WHEN x.f = 't' THEN 1 ELSE 0 END)"
    drop = lambda s: add(f"p.s{s}", 3, "D")
    keep = lambda s, i: f"CASE WHEN {stays} AND x.i = '{i}' THEN {add(f'p.s{s}', cut, 'K')} END"
    rerole = lambda s, i: f"CASE WHEN {stays} THEN {add(f'p.s{s}', f'(2 + {cut})', 'R' + i)} END"
    to_u = ", ".join([drop(2), *(f(s, "u") for s in (0, 1, 3) for f in (keep, rerole))])
    row = (
        f"{{'s0': {drop(0)}, 's1': least({drop(1)}, {keep(0, 's')}), 's2': least({to_u}), "
        f"'s3': least({drop(3)}, {keep(2, 'a')}, {rerole(2, 'a')})}}"
    )
    user = f"{{'s0': y.s0, 's1': y.s1, 's2': least(y.s2, {', '.join(add(f'y.s{s}', 2, 'Iu') for s in (0, 1, 3))}), 's3': y.s3}}"
    both = f"{{'i': '', 'f': '', 's0': z.s0, 's1': z.s1, 's2': z.s2, 's3': least(z.s3, {add('z.s2', 2, 'Ia')})}}"
    return f"list_transform(list_transform([{row}], lambda y: {user}), lambda z: {both})[1]"


ORACLE = {
    "op12_structure_repair": rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fate FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE fate <> 0),
placed_rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM placed_rows),
f AS MATERIALIZED (
  SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN again THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE 'f' END AS f,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier FROM r),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
    count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'i': i, 'f': f, 's0': NULL::VARCHAR, 's1': NULL::VARCHAR, 's2': NULL::VARCHAR, 's3': NULL::VARCHAR}} ORDER BY pos) AS rows
  FROM f GROUP BY conv_id),
states AS (
  SELECT * EXCLUDE (rows), list_reduce(list_concat([{{'i': '', 'f': '', 's0': '000000', 's1': NULL, 's2': '000002Iu', 's3': '000004IuIa'}}], rows),
    lambda p, x: {_repair_step()}) AS s FROM told),
plans AS MATERIALIZED (SELECT * EXCLUDE (s), left(least(s.s0, s.s3), 6)::BIGINT AS cost, substr(least(s.s0, s.s3), 7) AS plan FROM states),
tokens AS (SELECT conv_id, unnest(regexp_extract_all(plan, 'D|K|[IR][ua]')) AS token, generate_subscripts(regexp_extract_all(plan, 'D|K|[IR][ua]'), 1) AS nth FROM plans),
placed AS (SELECT *, sum(CASE WHEN token[1] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY nth) AS pos FROM tokens),
lines AS (
  SELECT placed.conv_id, nth, CASE token WHEN 'Iu' THEN 'user:' WHEN 'Ia' THEN 'assistant:' WHEN 'K' THEN role || ':' || text
    WHEN 'Ru' THEN 'user:' || text WHEN 'Ra' THEN 'assistant:' || text END AS line
  FROM placed LEFT JOIN f ON placed.conv_id IS NOT DISTINCT FROM f.conv_id AND placed.pos = f.pos AND token[1] <> 'I'),
hashed AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth), '')) AS repaired_sha256 FROM lines GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  replace(replace(coalesce(plan, ''), 'u', ''), 'a', '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM every LEFT JOIN plans ON every.conv_id IS NOT DISTINCT FROM plans.conv_id
  LEFT JOIN hashed ON every.conv_id IS NOT DISTINCT FROM hashed.conv_id
""",
    "op11_prefix_trie": rf"""
WITH turns AS (
  SELECT conv_id::BIGINT AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
t AS MATERIALIZED (
  SELECT c, pos, dense_rank() OVER (ORDER BY role, text) AS id, len(regexp_extract_all(text, '[^ 	-
]+')) AS w FROM turns),
convs AS (SELECT c, c - c % 20 AS base, ({_crc32("c::VARCHAR")} % 4)::BIGINT AS h, count(*) AS n FROM t GROUP BY c),
heads AS MATERIALIZED (
  SELECT a.c, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS k FROM convs a LEFT JOIN convs b ON a.base = b.c),
rebuilt AS (
  SELECT heads.c, t.pos AS d, id, w FROM heads JOIN t ON t.c = base AND t.pos <= k
  UNION ALL SELECT heads.c, k + t.pos - h, id, w FROM heads JOIN t ON t.c = heads.c AND t.pos > h),
paths AS (
  SELECT heads.c, list(id ORDER BY d) FILTER (id IS NOT NULL) AS ids, list(w ORDER BY d) FILTER (id IS NOT NULL) AS ws
  FROM heads LEFT JOIN rebuilt USING (c) GROUP BY heads.c),
members AS MATERIALIZED (
  SELECT c, d, array_to_string(ids[1:d], ',') AS node, array_to_string(ids[1:d - 1], ',') AS parent, ws[d] AS w, d = len(coalesce(ids, [])) AS ends
  FROM (SELECT *, unnest(range(0, len(coalesce(ids, [])) + 1)) AS d FROM paths)),
nodes AS MATERIALIZED (
  SELECT d, coalesce(node, '') AS node, any_value(CASE WHEN d > 0 THEN parent END) AS parent, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(any_value(w), 0) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY d, coalesce(node, '')),
grown AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
trie AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN grown ON nodes.node = grown.parent AND nodes.d = grown.d),
below AS (
  SELECT a AS d, array_to_string(string_split(node, ',')[1:a], ',') AS node, sum((n_convs - 1) * w) AS saved, count(*) FILTER (n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM trie) GROUP BY ALL)
SELECT trie.conv_id, trie.d AS depth, up.conv_id AS parent_conv_id, trie.n_convs, trie.n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, trie.ends_sha256
FROM trie JOIN below ON trie.d = below.d AND trie.node = coalesce(below.node, '')
  LEFT JOIN trie up ON trie.parent = up.node AND trie.d = up.d + 1
""",
    "op10_raking": _raking(),
    "op3_decontaminate": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s + 1:s + 10], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, l, s, array_to_string(w[s + 1:s + l], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM wins) WHERE len(w) >= l)),
hits AS (SELECT doc_id, item_id, s, l FROM places JOIN wins USING (l, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_preference_chat": r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'unknown'), coalesce(text, '')) AS pos,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
told AS (SELECT conv_id, max(pos) AS n, coalesce(max(CASE WHEN role = 'assistant' THEN pos END), 0) AS last FROM t GROUP BY conv_id),
reply AS (SELECT t.conv_id - 1 AS conv_id, role, text FROM t JOIN told ON t.conv_id = told.conv_id AND pos = last),
sides AS (
  SELECT conv_id, 'chosen' AS side, pos, role, text FROM t
  UNION ALL SELECT t.conv_id, 'rejected', pos, role, text FROM t JOIN told USING (conv_id) WHERE last = 0 OR pos < last
  UNION ALL SELECT reply.conv_id, 'rejected', last, role, text FROM reply JOIN told USING (conv_id) WHERE last > 0),
differ AS (
  SELECT conv_id, min(pos) AS first FROM (
    SELECT conv_id, pos FROM sides GROUP BY conv_id, pos
    HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)) GROUP BY conv_id),
cut AS (
  SELECT conv_id, coalesce(first - 1, n) AS n_prompt FROM told LEFT JOIN differ USING (conv_id)),
rendered AS (
  SELECT s.*, n_prompt, '<|' || replace(role, '<|', '< |') || '|>' || chr(10) AS head,
    replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body FROM sides s JOIN cut USING (conv_id)),
prompts AS (
  SELECT conv_id, string_agg(head || body, '' ORDER BY pos) AS prompt FROM rendered WHERE side = 'chosen' AND pos <= n_prompt GROUP BY conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side ORDER BY pos) - length(body) AS start
  FROM rendered WHERE pos > n_prompt),
done AS (
  SELECT conv_id, side, string_agg(head || body, '' ORDER BY pos) AS completion,
    string_agg(start::BIGINT::VARCHAR || ':' || (start + length(body))::BIGINT::VARCHAR, ',' ORDER BY pos) FILTER (role = 'assistant') AS spans
  FROM placed GROUP BY conv_id, side)
SELECT conv_id, n_prompt::BIGINT AS n_prompt_turns, coalesce(prompt, '') AS prompt,
  coalesce(c.completion, '') AS chosen, coalesce(c.spans, '') AS chosen_spans,
  coalesce(r.completion, '') AS rejected, coalesce(r.spans, '') AS rejected_spans,
  c.completion IS NULL AND r.completion IS NULL AS identical
FROM cut LEFT JOIN prompts USING (conv_id)
  LEFT JOIN (SELECT * FROM done WHERE side = 'chosen') c USING (conv_id)
  LEFT JOIN (SELECT * FROM done WHERE side = 'rejected') r USING (conv_id)
""",
}
