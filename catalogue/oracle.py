"""The queries of ``catalogue.queries`` as SQL over the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Each graph is a pair of common table expressions named n and e.
SUPPLY = """
n AS (
  SELECT r_regionkey::BIGINT * 8 AS node_id, 'Region' AS label, r_name AS name, NULL::VARCHAR AS properties FROM region
  UNION ALL SELECT n_nationkey::BIGINT * 8 + 1, 'Nation', n_name, NULL FROM nation
  UNION ALL SELECT c_custkey * 8 + 2, 'Customer', c_name, '{"segment":"' || c_mktsegment || '"}' FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, 'Supplier', s_name, NULL FROM supplier
  UNION ALL SELECT p_partkey * 8 + 4, 'Part', p_name, '{"brand":"' || p_brand || '","type":"' || p_type || '"}' FROM part
  UNION ALL SELECT o_orderkey * 8 + 5, 'Order', 'Order#' || o_orderkey, '{"status":"' || o_orderstatus || '"}' FROM orders
),
e AS (
  SELECT n_nationkey::BIGINT * 8 + 1 AS u, n_regionkey::BIGINT * 8 AS v, 'in_region' AS r FROM nation
  UNION ALL SELECT c_custkey * 8 + 2, c_nationkey::BIGINT * 8 + 1, 'lives_in' FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, s_nationkey::BIGINT * 8 + 1, 'based_in' FROM supplier
  UNION ALL SELECT o_orderkey * 8 + 5, o_custkey * 8 + 2, 'placed_by' FROM orders
  UNION ALL SELECT l_suppkey * 8 + 3, l_partkey * 8 + 4, 'supplies_' || lower(l_returnflag) FROM lineitem
)"""

ACTIVITY = """
n AS (
  SELECT c_custkey AS node_id, c_mktsegment AS label, c_name AS name, NULL::VARCHAR AS properties FROM customer
),
e AS (
  SELECT user_id AS u, json_extract_string(props, '$.k')::BIGINT AS v, event_type AS r FROM events
)"""

REVIEW = """
n AS (
  SELECT 'doc' || doc_id AS node_id,
         CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'Good' ELSE ' ' END AS label,
         'doc' || doc_id AS name FROM labels
  UNION ALL SELECT DISTINCT source, 'nan', source FROM documents
  UNION ALL SELECT DISTINCT lang, 'Language', lang FROM documents
),
e AS (
  SELECT source AS u, 'doc' || doc_id AS v, 'lists' AS r FROM documents
  UNION ALL SELECT 'doc' || doc_id, lang, 'written_in' FROM documents
)"""

EDGE = "u AS source_node_id, v AS target_node_id, r AS relation_type"
NODE = "node_id, label, name, properties"


def sql(name: str, graph: str | None, body: str, *ctes: str) -> None:
    parts = [p for p in (graph, *ctes) if p]
    ORACLE[name] = (f"WITH {', '.join(parts)} " if parts else "") + body


# --- tables and types -------------------------------------------------------

sql("kg_nodes", SUPPLY, f"SELECT {NODE} FROM n")
sql("kg_edges", SUPPLY, f"SELECT {EDGE} FROM e")
sql(
    "narrow_types_lineitem",
    None,
    """SELECT * REPLACE (l_orderkey::INTEGER AS l_orderkey, l_partkey::INTEGER AS l_partkey,
    l_suppkey::INTEGER AS l_suppkey, l_quantity::FLOAT AS l_quantity,
    l_extendedprice::FLOAT AS l_extendedprice, l_discount::FLOAT AS l_discount,
    l_tax::FLOAT AS l_tax) FROM lineitem""",
)
sql(
    "to_native_review",
    REVIEW,
    "SELECT node_id, coalesce(label, '') AS label, coalesce(name, '') AS name FROM n",
)
sql(
    "to_native_customer",
    None,
    """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey,
    c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer""",
)
sql(
    "dedupe_nodes",
    None,
    """SELECT l_suppkey * 8 + 3 AS node_id, 'Supplier' AS label,
    min(l_linestatus || '/' || l_partkey) AS name FROM lineitem GROUP BY 1""",
)

BOTH_TABLES = f"""SELECT {EDGE}, NULL AS node_id, NULL AS label, NULL AS name, NULL AS properties FROM e
    UNION ALL SELECT NULL, NULL, NULL, {NODE} FROM n"""
sql("snapshot", ACTIVITY, BOTH_TABLES)
sql("read_tables", SUPPLY, BOTH_TABLES)

# --- selection --------------------------------------------------------------

sql("labels_raw", REVIEW, "SELECT DISTINCT label FROM n")
sql("labels_non_null", REVIEW, "SELECT DISTINCT label FROM n WHERE label IS NOT NULL")
sql(
    "labels_clean",
    REVIEW,
    "SELECT DISTINCT label FROM n WHERE trim(label) <> '' AND label <> 'nan'",
)
sql("filter_label", SUPPLY, f"SELECT {NODE} FROM n WHERE label = 'Customer'")
sql("filter_label_all", REVIEW, "SELECT node_id, label, name FROM n")
sql("names_in_label", SUPPLY, "SELECT DISTINCT name FROM n WHERE label = 'Part'")
sql(
    "names_by_label",
    SUPPLY,
    """SELECT DISTINCT label, node_count, name FROM
    (SELECT *, count(*) OVER (PARTITION BY label) AS node_count FROM n)""",
)
sql(
    "names_by_label_unnamed",
    REVIEW,
    """SELECT DISTINCT label, node_count, CASE WHEN name LIKE 'doc%' THEN NULL ELSE name END AS name FROM
    (SELECT *, count(*) OVER (PARTITION BY label) AS node_count FROM n) WHERE label IS NOT NULL""",
)
FIRST_OF = """SELECT {cols} FROM (SELECT *, row_number() OVER
    (PARTITION BY {keys} ORDER BY node_id) AS rn FROM n) WHERE rn = 1"""
sql(
    "find_node",
    SUPPLY,
    FIRST_OF.format(cols=NODE, keys="label, name") + " AND label IN ('Part', 'Supplier')",
)
WANTED = """w AS (SELECT p_name AS name FROM part UNION SELECT p_brand FROM part),
f AS (""" + FIRST_OF.format(cols=NODE, keys="name") + ")"
sql(
    "find_by_name",
    SUPPLY,
    """SELECT w.name, node_id, label, properties, node_id IS NOT NULL AS found
    FROM w LEFT JOIN f ON w.name = f.name""",
    WANTED,
)
sql(
    "find_by_id",
    SUPPLY,
    f"SELECT {NODE} FROM n WHERE node_id IN (SELECT l_partkey * 8 + 4 FROM lineitem)",
)
sql(
    "properties_of_label",
    SUPPLY,
    """SELECT node_id, coalesce(properties, '{}') AS properties FROM n
    WHERE label IN ('Part', 'Supplier')""",
)
IDS = "(SELECT node_id FROM n WHERE label = '{}')"
sql("incident_edges_out", SUPPLY, f"SELECT {EDGE} FROM e WHERE u IN " + IDS.format("Supplier"))
sql("incident_edges_in", SUPPLY, f"SELECT {EDGE} FROM e WHERE v IN " + IDS.format("Nation"))
BUILDING = IDS.format("BUILDING")
sql(
    "incident_edges_both",
    ACTIVITY,
    f"SELECT {EDGE} FROM e WHERE u IN {BUILDING} OR v IN {BUILDING}",
)
sql(
    "nonblank",
    REVIEW,
    "SELECT node_id, label AS question FROM n WHERE trim(label) <> ''",
)
sql(
    "vertex_columns",
    REVIEW,
    """SELECT node_id AS id, coalesce(label, '') AS label,
    coalesce(label, '') AS "group", coalesce(name, '') AS title FROM n""",
)
sql(
    "vertex_columns_category",
    REVIEW,
    """SELECT node_id AS id, coalesce(label, '') AS label, coalesce(label, '') AS "group",
    coalesce(name, '') || ' (' || coalesce(label, '') || ')' AS title FROM n""",
)

# --- joins ------------------------------------------------------------------

sql(
    "join_target",
    REVIEW,
    f"""SELECT {EDGE}, label AS target_label, name AS target_name
    FROM e JOIN n ON v = node_id""",
)
sql(
    "join_source",
    SUPPLY,
    f"""SELECT {EDGE}, label AS source_label, name AS source_name
    FROM e JOIN n ON u = node_id""",
)
sql(
    "dangling_edges",
    REVIEW,
    f"""SELECT {EDGE}, 'source' AS missing_side FROM e
    WHERE NOT EXISTS (SELECT 1 FROM n WHERE node_id = u)
    UNION ALL SELECT {EDGE}, 'target' FROM e
    WHERE NOT EXISTS (SELECT 1 FROM n WHERE node_id = v)""",
)
NATION = IDS.format("Nation")
sql("touching", SUPPLY, f"SELECT {EDGE} FROM e WHERE u IN {NATION} OR v IN {NATION}")
sql("snapshot_lookup", SUPPLY, f"SELECT {EDGE} FROM e WHERE u IN {NATION} OR v IN {NATION}")
sql("semi_ids", ACTIVITY, f"SELECT {NODE} FROM n WHERE node_id IN (SELECT u FROM e)")
sql(
    "seed_names",
    ACTIVITY,
    f"SELECT {EDGE}, name AS seed_name FROM e JOIN n ON u = node_id",
)

# --- counts -----------------------------------------------------------------

HISTOGRAM = """SELECT label, count(*) AS node_count FROM n
    WHERE label IS NOT NULL GROUP BY label"""
sql("count_nodes", SUPPLY, "SELECT count(*) AS total_nodes FROM n")
sql("count_edges", SUPPLY, "SELECT count(*) AS total_edges FROM e")
sql("label_histogram", REVIEW, HISTOGRAM)
sql("category_size", SUPPLY, HISTOGRAM)
COUNTS = """(SELECT count(*) FROM e WHERE u = node_id) AS outgoing,
    (SELECT count(*) FROM e WHERE v = node_id) AS incoming,
    (SELECT count(*) FROM e WHERE u = node_id OR v = node_id) AS both_sides"""
SEED_COUNTS = """c AS (
  SELECT node_id, count(*) FILTER (WHERE side = 0) AS outgoing,
         count(*) FILTER (WHERE side = 1) AS incoming,
         count(DISTINCT edge_no) AS both_sides
  FROM (SELECT u AS node_id, 0 AS side, edge_no FROM m
        UNION ALL SELECT v, 1, edge_no FROM m)
  GROUP BY node_id)"""
NUMBERED = "m AS (SELECT *, row_number() OVER () AS edge_no FROM e)"
sql(
    "edge_count_by_direction",
    ACTIVITY,
    """SELECT n.node_id AS seed_id, coalesce(outgoing, 0) AS outgoing,
    coalesce(incoming, 0) AS incoming, coalesce(both_sides, 0) AS "both"
    FROM n LEFT JOIN c ON n.node_id = c.node_id""",
    NUMBERED,
    SEED_COUNTS,
)
sql(
    "edge_count_both",
    ACTIVITY,
    """SELECT n.node_id AS seed_id, coalesce(both_sides, 0) AS edge_count
    FROM n LEFT JOIN c ON n.node_id = c.node_id""",
    NUMBERED,
    SEED_COUNTS,
)
sql(
    "edge_count_no_direction",
    ACTIVITY,
    "SELECT node_id AS seed_id, 0::BIGINT AS edge_count FROM n",
)
METRICS = """lab AS (SELECT label, count(*) AS node_count FROM n WHERE label IS NOT NULL GROUP BY label),
ee AS (SELECT u, v, a.node_id AS su, b.node_id AS sv, a.label AS lu, b.label AS lv
       FROM e LEFT JOIN n a ON u = a.node_id LEFT JOIN n b ON v = b.node_id),
con AS (SELECT label, count(*) AS connections FROM (
          SELECT lu AS label FROM ee UNION ALL
          SELECT lv FROM ee WHERE lv IS DISTINCT FROM lu) GROUP BY label),
sub AS (SELECT label, count(DISTINCT id) AS subgraph_size FROM (
          SELECT label, node_id AS id FROM n UNION ALL
          SELECT lu, sv FROM ee WHERE sv IS NOT NULL UNION ALL
          SELECT lv, su FROM ee WHERE su IS NOT NULL) GROUP BY label)"""
METRIC_ROWS = """SELECT lab.label, node_count, coalesce(connections, 0) AS connections,
    subgraph_size FROM lab LEFT JOIN con ON lab.label = con.label
    JOIN sub ON lab.label = sub.label"""
sql(
    "category_connections",
    SUPPLY,
    f"SELECT label, connections FROM ({METRIC_ROWS})",
    METRICS,
)
sql(
    "category_connections_one",
    ACTIVITY,
    f"""SELECT 'BUILDING' AS label, count(*) AS connections FROM e
    WHERE u IN {BUILDING} OR v IN {BUILDING}""",
)
sql("category_metrics", SUPPLY, METRIC_ROWS, METRICS)
sql("category_metrics_dangling", REVIEW, METRIC_ROWS, METRICS)
sql(
    "category_metrics_one",
    ACTIVITY,
    f"SELECT * FROM ({METRIC_ROWS}) WHERE label = 'BUILDING'",
    METRICS,
)
sql(
    "category_metrics_absent",
    SUPPLY,
    f"""SELECT label, coalesce(node_count, 0) AS node_count, coalesce(connections, 0) AS connections,
    coalesce(subgraph_size, 0) AS subgraph_size
    FROM (VALUES ('Nation'), ('Planet'), ('Region')) w(label) LEFT JOIN ({METRIC_ROWS}) USING (label)""",
    METRICS,
)
sql(
    "subgraph_size",
    SUPPLY,
    f"SELECT subgraph_size FROM ({METRIC_ROWS}) WHERE label = 'Nation'",
    METRICS,
)
DEGREES = """d AS (
  SELECT coalesce(o.id, i.id) AS node_id, out_degree, in_degree
  FROM (SELECT u AS id, count(*) AS out_degree FROM e WHERE u IS NOT NULL GROUP BY u) o
  FULL JOIN (SELECT v AS id, count(*) AS in_degree FROM e WHERE v IS NOT NULL GROUP BY v) i
  ON o.id = i.id)"""
sql("degrees", ACTIVITY, "SELECT node_id, out_degree, in_degree FROM d", DEGREES)
sql(
    "two_sided_degree",
    SUPPLY,
    "SELECT node_id, out_degree + in_degree AS degree FROM d",
    DEGREES,
)
sql(
    "total_degree",
    SUPPLY,
    """SELECT node_id, coalesce(out_degree, 0) + coalesce(in_degree, 0) AS degree
    FROM d""",
    DEGREES,
)
sql("distinct_names", SUPPLY, "SELECT DISTINCT name FROM n")
sql("distinct_terms", SUPPLY, "SELECT DISTINCT name, label FROM n")

# --- extraction -------------------------------------------------------------

sql(
    "simple_digraph",
    SUPPLY,
    """SELECT u AS source_node_id, v AS target_node_id, max(r) AS relation_type
    FROM e GROUP BY u, v""",
)
# Touches of the seeds: phase 0 leaves the seed a, phase 1 enters it.
TOUCHES = """t AS (
  SELECT u AS a, v AS b, 0 AS phase, u, v, r FROM e UNION ALL
  SELECT v, u, 1, u, v, r FROM e),
x AS (
  SELECT t.*, s.label AS a_label, s.name AS a_name, f.label AS b_label, f.name AS b_name
  FROM t JOIN n s ON a = s.node_id JOIN n f ON b = f.node_id)"""
sql(
    "both_directions",
    ACTIVITY,
    "SELECT a, b, phase, u AS source, v AS target, r AS relation FROM t",
    TOUCHES,
)
sql(
    "merge_vertices",
    ACTIVITY,
    """SELECT b AS id, arg_max(r, (a, phase, r)) AS relation, arg_max(phase, (a, phase, r))::INTEGER AS side,
    max(u) AS source FROM t GROUP BY b""",
    TOUCHES,
)
EGO = """SELECT a AS seed_id, u AS source, v AS target, max(r) AS label,
    any_value(b_name) AS title FROM x WHERE {} GROUP BY a, u, v"""
sql("ego_out", ACTIVITY, EGO.format("a_label = 'BUILDING' AND phase = 0"), TOUCHES)
sql("ego_in", ACTIVITY, EGO.format("a_label = 'BUILDING' AND phase = 1"), TOUCHES)
sql("ego_both", ACTIVITY, EGO.format("a_label = 'BUILDING'"), TOUCHES)
sql("ego_repeated_ids", ACTIVITY, EGO.format("a_label = 'BUILDING'"), TOUCHES)
sql("ego_every_node", ACTIVITY, EGO.format("true"), TOUCHES)
sql(
    "ego_both_vertices",
    ACTIVITY,
    """SELECT seed_id, id, n.label, n.label AS "group", n.name AS title FROM (
    SELECT a AS seed_id, b AS id FROM x WHERE a_label = 'BUILDING'
    UNION SELECT node_id, node_id FROM n WHERE label = 'BUILDING') JOIN n ON id = n.node_id""",
    TOUCHES,
)
sql(
    "ego_both_reversed",
    ACTIVITY,
    """SELECT a AS seed_id, a AS source, b AS target, r AS label, b_name AS title FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY phase DESC, u DESC, v DESC, r DESC) AS rn
    FROM x WHERE a_label = 'BUILDING') WHERE rn = 1""",
    TOUCHES,
)
sql(
    "ego_multi_edges",
    ACTIVITY,
    """SELECT u AS source, v AS target, max(r) AS label FROM x
    WHERE a_label = 'BUILDING' GROUP BY u, v""",
    TOUCHES,
)
sql(
    "ego_multi_vertices",
    ACTIVITY,
    """SELECT node_id AS id, label, name AS title FROM n WHERE label = 'BUILDING'
    OR node_id IN (SELECT b FROM x WHERE a_label = 'BUILDING')""",
    TOUCHES,
)


def category_vertices(where: str) -> str:
    return f"""SELECT node_id AS id, label, label AS "group",
    name || ' (' || label || ')' AS title FROM n WHERE {where.format("label")}
    OR node_id IN (SELECT b FROM x WHERE {where.format("a_label")})"""


def category_edges(where: str, title: str) -> str:
    return f"""SELECT u AS source, v AS target, r AS label, {title} AS title FROM (
    SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY a DESC, phase DESC, r DESC) AS rn
    FROM x WHERE {where}) WHERE rn = 1"""


def category_colors(where: str, selected: str) -> str:
    return f"""SELECT n.node_id AS id, n.label, n.label AS "group",
    n.name || ' (' || n.label || ')' AS title,
    CASE WHEN phase IS NULL THEN '#FF6B6B' WHEN n.label = '{selected}' THEN '#FFB6C1'
         WHEN phase = 0 THEN '#ADD8E6' ELSE '#90EE90' END AS color,
    CASE WHEN {where.format("n.label")} THEN 40 END AS size
    FROM n LEFT JOIN (SELECT * FROM (SELECT b, phase, row_number() OVER
      (PARTITION BY b ORDER BY a DESC, phase DESC) AS rn
      FROM x WHERE {where.format("a_label")}) WHERE rn = 1) l ON n.node_id = b
    WHERE phase IS NOT NULL OR {where.format("n.label")}"""


STYLED = "r || ': ' || CASE WHEN phase = 0 THEN a_name || ' → ' || b_name ELSE b_name || ' → ' || a_name END"
sql("category_graph_nodes", SUPPLY, category_vertices("{} = 'Supplier'"), TOUCHES)
sql("category_graph_edges", SUPPLY, category_edges("a_label = 'Supplier'", "b_name"), TOUCHES)
sql("category_graph_inside", ACTIVITY, category_edges("a_label = 'BUILDING'", "b_name"), TOUCHES)
sql("category_graph_all", ACTIVITY, category_edges("true", "b_name"), TOUCHES)
sql("category_graph_styled", ACTIVITY, category_edges("a_label = 'BUILDING'", STYLED), TOUCHES)
sql("category_styles", ACTIVITY, category_colors("{} = 'BUILDING'", "BUILDING"), TOUCHES)
sql("category_styles_all", ACTIVITY, category_colors("{} IS NOT NULL", "All"), TOUCHES)
sql(
    "vis_vertices",
    SUPPLY,
    f"""SELECT id::VARCHAR AS id, label, "group", title, color, size
    FROM ({category_colors("{} = 'Nation'", "Nation")})""",
    TOUCHES,
)
sql(
    "export_vis",
    SUPPLY,
    f"""SELECT source::VARCHAR AS "from", target::VARCHAR AS "to", label, title,
    NULL AS id, NULL AS "group", NULL AS color, NULL AS size
    FROM ({category_edges("a_label = 'Nation'", STYLED)})
    UNION ALL SELECT NULL, NULL, label, title, id::VARCHAR, "group", color, size
    FROM ({category_colors("{} = 'Nation'", "Nation")})""",
    TOUCHES,
)

# --- first k ----------------------------------------------------------------

sql("first_nodes", SUPPLY, f"SELECT {NODE} FROM n ORDER BY node_id LIMIT 15")
RANKED = """k AS (
  SELECT *, row_number() OVER (PARTITION BY a, phase ORDER BY u, v, r)::INTEGER AS rk
  FROM (SELECT u AS a, v AS b, 0 AS phase, u, v, r FROM e UNION ALL
        SELECT v, u, 1, u, v, r FROM e))"""
sql(
    "first_edges_per_node",
    SUPPLY,
    """SELECT a, b, phase, u AS source, v AS target, r AS relation, rk AS rank
    FROM k WHERE rk <= 5""",
    RANKED,
)
sql(
    "text_lines",
    SUPPLY,
    """SELECT a, string_agg(r, ', ' ORDER BY rk) AS relations FROM k
    WHERE phase = 0 AND rk <= 5 GROUP BY a""",
    RANKED,
)
TOP15 = """top AS (SELECT node_id FROM d
  ORDER BY out_degree + in_degree DESC NULLS LAST, node_id LIMIT 15)"""
sql(
    "most_connected",
    SUPPLY,
    f"SELECT {NODE} FROM n WHERE node_id IN (SELECT node_id FROM top)",
    DEGREES,
    TOP15,
)
EXAMPLES = """(SELECT *, row_number() OVER (PARTITION BY label ORDER BY node_id)::INTEGER AS rank
    FROM n WHERE label IS NOT NULL)"""
sql("examples_per_label", SUPPLY, f"SELECT {NODE}, rank FROM {EXAMPLES} WHERE rank <= 3")
sql(
    "category_sample",
    SUPPLY,
    f"SELECT {NODE} FROM n WHERE label = 'Part' ORDER BY node_id LIMIT 5",
)
sql("category_sample_all", SUPPLY, f"SELECT {NODE} FROM n ORDER BY node_id LIMIT 5")

# --- summaries --------------------------------------------------------------


def texts(name: str, k: int, compact: bool = False, properties: bool = True) -> str:
    """CTEs ending in ``name(node_id, summary)`` for every node."""
    out, into = ("Outgoing:", "Incoming:") if compact else (
        "Outgoing Relationships:",
        "Incoming Relationships:",
    )

    def section(phase: int, header: str, arrow: str) -> str:
        return f"""{name}_{phase} AS (
  SELECT a, chr(10) || '{header}' || coalesce(chr(10) || string_agg(
    CASE WHEN f.node_id IS NOT NULL THEN '  {arrow} ' || coalesce(f.name, '') || ' ('
      || coalesce(f.label, '') || ') via ''' || r || '''' END, chr(10) ORDER BY rk), '') AS body
  FROM k LEFT JOIN n f ON b = f.node_id WHERE phase = {phase} AND rk <= {k} GROUP BY a)"""

    props = "NULL"
    if properties and not compact:
        props = """CASE WHEN coalesce(properties, '{}') NOT IN ('', '{}')
      THEN chr(10) || 'Node Properties: ' || properties END"""
    return f"""{section(0, out, "→")},
{section(1, into, "←")},
{name} AS (
  SELECT n.node_id, concat_ws(chr(10), 'Node: ' || coalesce(n.name, '') || ' (Type: '
    || coalesce(n.label, '') || ')', o.body, i.body, {props}) AS summary
  FROM n LEFT JOIN {name}_0 o ON n.node_id = o.a LEFT JOIN {name}_1 i ON n.node_id = i.a)"""


BY_NAME = """byname AS (SELECT name, min(node_id) AS first_id FROM n GROUP BY name)"""
sql(
    "node_summary",
    SUPPLY,
    "SELECT node_id, summary FROM t10",
    RANKED,
    texts("t10", 10),
)
sql(
    "node_summary_compact",
    SUPPLY,
    f"SELECT node_id, summary FROM t5 WHERE node_id IN {IDS.format('Supplier')}",
    RANKED,
    texts("t5", 5, compact=True),
)
sql(
    "node_summary_dangling",
    REVIEW,
    "SELECT node_id, summary FROM t10",
    RANKED,
    texts("t10", 10, properties=False),
)
sql(
    "node_summary_by_name",
    SUPPLY,
    """SELECT w.name, coalesce(summary,
      'Node ''' || w.name || ''' not found in the knowledge graph.') AS summary
    FROM w LEFT JOIN byname ON w.name = byname.name LEFT JOIN t10 ON first_id = node_id""",
    "w AS (SELECT p_name AS name FROM part UNION SELECT p_brand FROM part)",
    RANKED,
    texts("t10", 10),
    BY_NAME,
)
RULED = "summary || chr(10) || repeat('-', 40)"
sql(
    "category_summary",
    SUPPLY,
    f"""SELECT s.label, 'Nodes in ''' || s.label || ''' category:' || chr(10) || chr(10)
    || string_agg({RULED}, chr(10) ORDER BY s.node_id) AS summary
    FROM {EXAMPLES} s JOIN t3 ON s.node_id = t3.node_id WHERE s.rank <= 5 GROUP BY s.label""",
    RANKED,
    texts("t3", 3),
)
sql(
    "category_summary_by_name",
    SUPPLY,
    f"""SELECT 'Part' AS label, 'Nodes in ''Part'' category:' || chr(10) || chr(10)
    || string_agg({RULED}, chr(10) ORDER BY s.node_id) AS summary
    FROM (SELECT * FROM n WHERE label = 'Part' ORDER BY node_id LIMIT 5) s
    JOIN byname ON s.name = byname.name JOIN t3 ON first_id = t3.node_id
    UNION ALL SELECT 'All', 'Sample nodes from entire graph:' || chr(10) || chr(10)
    || string_agg({RULED}, chr(10) ORDER BY s.node_id)
    FROM (SELECT * FROM n ORDER BY node_id LIMIT 5) s
    JOIN byname ON s.name = byname.name JOIN t3 ON first_id = t3.node_id
    UNION ALL SELECT 'Planet', 'Nodes in ''Planet'' category:' || chr(10)""",
    RANKED,
    texts("t3", 3),
    BY_NAME,
)
GRAPH_LINES = f"""h AS (SELECT label, '- ' || label || ': ' || count(*) || ' nodes' AS line
  FROM n WHERE label IS NOT NULL GROUP BY label),
g AS (SELECT s.label, s.rank AS pos, k.rk AS rank, '  ' || s.name || ' (' || s.label || ') → '
      || f.name || ' (' || f.label || ') via ''' || r || '''' AS line
  FROM {EXAMPLES} s JOIN k ON s.node_id = a AND phase = 0 AND rk <= 2
  JOIN n f ON b = f.node_id WHERE s.rank <= 3),
full_text AS (SELECT 'COMPLETE KNOWLEDGE GRAPH:' || chr(10)
  || (SELECT string_agg(line, chr(10) ORDER BY label) FROM h) || chr(10) || chr(10)
  || 'KEY RELATIONSHIPS:' || chr(10)
  || (SELECT string_agg(line, chr(10) ORDER BY label, pos, rank) FROM g) AS summary)"""
sql(
    "graph_summary_lines",
    SUPPLY,
    """SELECT 0 AS section, label, 0 AS pos, 0 AS rank, line FROM h
    UNION ALL SELECT 1, label, pos, rank, line FROM g""",
    RANKED,
    GRAPH_LINES,
)
sql("graph_summary_text", SUPPLY, "SELECT summary FROM full_text", RANKED, GRAPH_LINES)
FIRST_CONTEXT = """sc AS (SELECT string_agg(summary, chr(10) || chr(10) ORDER BY s.node_id) AS context
  FROM (SELECT * FROM n ORDER BY node_id LIMIT 15) s JOIN t5 ON s.node_id = t5.node_id)"""
sql(
    "sample_context_first",
    SUPPLY,
    "SELECT context FROM sc",
    RANKED,
    texts("t5", 5, compact=True),
    FIRST_CONTEXT,
)
sql(
    "sample_context_connected",
    SUPPLY,
    """SELECT string_agg(summary, chr(10) || chr(10) ORDER BY s.node_id) AS context
    FROM n s JOIN top ON s.node_id = top.node_id
    JOIN byname ON s.name = byname.name JOIN t5 ON first_id = t5.node_id""",
    DEGREES,
    TOP15,
    RANKED,
    texts("t5", 5, compact=True),
    BY_NAME,
)

# --- conversations ----------------------------------------------------------

HISTORY = """hist AS (
  SELECT conv_id, coalesce(string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text,
    chr(10) ORDER BY turn) FILTER (WHERE back BETWEEN 2 AND 6), 'No previous conversation.') AS history
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
        FROM conversations) GROUP BY conv_id)"""
sql("history_last5", None, "SELECT conv_id, history FROM hist", HISTORY)
LAST = """SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER
    (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= {}"""
sql("last_turns_8", None, LAST.format(8))
sql("last_turns_5", None, LAST.format(5))
sql("last_turns_all", None, "SELECT conv_id, turn, role, text FROM conversations")
sql(
    "append_turns",
    None,
    """SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT item_id, coalesce(last, -1) + 1, 'user', text
    FROM benchmark LEFT JOIN l ON item_id = l.conv_id
    UNION ALL SELECT item_id, coalesce(last, -1) + 2, 'ai', 'ok'
    FROM benchmark LEFT JOIN l ON item_id = l.conv_id""",
    "l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)",
)
sql(
    "clear_history",
    None,
    """SELECT conv_id, turn, role, text FROM conversations WHERE conv_id NOT IN
    (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
sql(
    "previous_turns",
    None,
    """SELECT conv_id, turn, role, text FROM conversations c WHERE turn <
    (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id)""",
)

# --- prompts, requests, responses -------------------------------------------

QUESTIONS = """q0 AS (SELECT conv_id, max_by(text, turn) AS question, max(turn) AS last,
    bool_or(role = 'system') AS sys FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id AS question_id, conv_id * 8 + 2 AS seed_id, question,
    CASE WHEN sys THEN NULL WHEN last > 4 THEN 'category' ELSE 'node' END AS view,
    CASE WHEN sys THEN NULL WHEN last > 5 THEN 'Supplier' WHEN last > 4 THEN 'Nation'
         ELSE c_name END AS selected
  FROM q0 LEFT JOIN customer ON conv_id = c_custkey)"""
CONTEXT = f"""cat AS (SELECT s.label, 'Nodes in ''' || s.label || ''' category:' || chr(10) || chr(10)
    || string_agg({RULED}, chr(10) ORDER BY s.node_id) AS summary
    FROM {EXAMPLES} s JOIN t3 ON s.node_id = t3.node_id WHERE s.rank <= 5 GROUP BY s.label),
ctx AS (SELECT question_id, CASE WHEN view = 'node' AND selected IS NOT NULL THEN t10.summary
    WHEN view = 'category' THEN cat.summary ELSE 'No specific node data available.' END AS context
  FROM q LEFT JOIN t10 ON view = 'node' AND seed_id = t10.node_id
  LEFT JOIN cat ON view = 'category' AND selected = cat.label)"""
CONTEXT_PARTS = (RANKED, texts("t10", 10), texts("t3", 3), QUESTIONS, CONTEXT)
TOTALS = """tot AS (SELECT (SELECT count(*) FROM n) AS total_nodes,
    (SELECT count(*) FROM e) AS total_edges)"""
sql(
    "stats_context",
    ACTIVITY,
    """SELECT n.node_id AS seed_id, name AS selected_node,
    coalesce(both_sides, 0) AS connected_count, 'Both' AS direction, total_nodes, total_edges
    FROM n LEFT JOIN c ON n.node_id = c.node_id CROSS JOIN tot""",
    NUMBERED,
    SEED_COUNTS,
    TOTALS,
)
sql(
    "category_stats_context",
    SUPPLY,
    f"""SELECT label, node_count AS category_count, connections AS connected_count,
    'Category Overview' AS direction, total_nodes, total_edges
    FROM ({METRIC_ROWS}) CROSS JOIN tot""",
    METRICS,
    TOTALS,
)
sql("context_for", SUPPLY, "SELECT question_id, context FROM ctx", *CONTEXT_PARTS)


def filled(template: str, values: dict[str, str]) -> str:
    """A prompt template as SQL; ``values`` maps its slots to expressions."""
    text = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for slot, value in values.items():
        text = text.replace("{" + slot + "}", f"' || {value} || '")
    return text


# The wording of the prompts, a slot in braces where a value goes.
PROMPTS = {
    "stats": """Facts about the current selection
node: {selected_node}
connections: {connected_count}
direction: {direction}
nodes in graph: {total_nodes}
edges in graph: {total_edges}

Conversation so far
{history}

Question: {question}
""",
    "grounded": """Use nothing but these graph facts.
{context}

nodes in graph: {total_nodes}
edges in graph: {total_edges}
view: {direction}

Conversation so far
{history}

Question: {question}
""",
    "hybrid": """Start from these graph facts, then add what is commonly known.
{context}

Say which part comes from the graph and which does not.

Question: {question}
""",
    "overview": """{summary}

View: {focus}

Look the answer up in the summary; keep general remarks short.

Question: {question}
""",
    "plain": """Graph facts
{context}

Conversation so far
{history}

Question: {question}
""",
    "examples": """Answer from the graph facts only; say so when they do not hold the answer.

Sample question: Which parts does the supplier deliver?
Sample answer: According to the graph, bolts and rings.
Sample question: How old is the supplier?
Sample answer: The graph does not say.

Graph facts
{context}

Conversation so far
{history}

Question: {question}
""",
    "strict": """Answer from the graph facts only. If they do not hold the answer, reply: The graph does not say.
Graph facts
{context}
Conversation so far
{history}
Question: {question}
""",
}


def prompt_oracles() -> None:
    base = {"question": "question", "history": "history"}
    hist = "JOIN hist ON question_id = conv_id"
    sql(
        "prompts_stats",
        SUPPLY,
        "SELECT question_id, "
        + filled(
            PROMPTS["stats"],
            base
            | {
                "selected_node": "CASE WHEN s.node_id IS NULL THEN 'no selection' ELSE coalesce(s.name, '') END",
                "connected_count": "coalesce(both_sides, 0)",
                "direction": "'Both'",
                "total_nodes": "total_nodes",
                "total_edges": "total_edges",
            },
        )
        + f""" AS prompt FROM q {hist} LEFT JOIN n s ON seed_id = s.node_id
        LEFT JOIN c ON seed_id = c.node_id CROSS JOIN tot""",
        NUMBERED,
        SEED_COUNTS,
        TOTALS,
        QUESTIONS,
        HISTORY,
    )
    sql(
        "prompts_grounded",
        SUPPLY,
        "SELECT q.question_id, "
        + filled(
            PROMPTS["grounded"],
            base
            | {
                "context": "context",
                "direction": "coalesce(view, 'none')",
                "total_nodes": "total_nodes",
                "total_edges": "total_edges",
            },
        )
        + """ AS prompt FROM q JOIN hist ON q.question_id = conv_id
        JOIN ctx ON q.question_id = ctx.question_id CROSS JOIN tot""",
        *CONTEXT_PARTS,
        TOTALS,
        HISTORY,
    )
    sql(
        "prompts_hybrid",
        SUPPLY,
        "SELECT q.question_id, "
        + filled(PROMPTS["hybrid"], base | {"context": "context"})
        + " AS prompt FROM q JOIN ctx ON q.question_id = ctx.question_id",
        *CONTEXT_PARTS,
    )
    focus = """CASE WHEN selected IS NULL THEN 'whole graph'
      WHEN view = 'category' THEN 'category ' || selected ELSE 'node ' || selected END"""
    sql(
        "prompts_overview",
        SUPPLY,
        "SELECT question_id, "
        + filled(PROMPTS["overview"], base | {"summary": "summary", "focus": focus})
        + " AS prompt FROM q CROSS JOIN full_text",
        RANKED,
        GRAPH_LINES,
        QUESTIONS,
    )
    for template in ("plain", "examples", "strict"):
        sql(
            f"prompts_{template}",
            SUPPLY,
            "SELECT question_id, "
            + filled(PROMPTS[template], base | {"context": "context"})
            + f" AS prompt FROM q {hist} CROSS JOIN sc",
            RANKED,
            texts("t5", 5, compact=True),
            FIRST_CONTEXT,
            QUESTIONS,
            HISTORY,
        )


# The parameters of the four request presets.
for preset, parameters in {
    "sampled": "'max_new_tokens', 500, 'temperature', 0.7, 'do_sample', true, 'return_full_text', false",
    "factual": "'max_new_tokens', 500, 'temperature', 0.3, 'do_sample', true, 'return_full_text', false",
    "short": "'max_new_tokens', 500, 'temperature', 0.3",
    "long": "'max_new_tokens', 1000, 'temperature', 0.3",
}.items():
    sql(
        f"request_payload_{preset}",
        None,
        f"""SELECT conv_id * 8 + turn AS question_id, json_object('inputs', text,
        'parameters', json_object({parameters}))::VARCHAR AS payload
        FROM conversations""",
    )


ANSWERED = "SELECT conv_id * 8 + turn AS request_id, CASE {} ELSE text END AS answer FROM conversations"
REFUSED = "WHEN turn = 6 THEN 'Llama API Error: 503 - ' || text"
KEYS = "Response received but couldn''t extract text. Keys found: "
sql(
    "parse_response_early",
    None,
    ANSWERED.format(
        "WHEN turn = 3 THEN json_object('z', text)::VARCHAR WHEN turn = 4 THEN '[]' "
        "WHEN turn = 5 THEN '' " + REFUSED
    ),
)
sql(
    "parse_response_strict",
    None,
    ANSWERED.format(
        f"WHEN turn = 2 THEN '{KEYS}[''choices'']' WHEN turn = 3 THEN '{KEYS}[''z'']' "
        f"WHEN turn IN (4, 5) THEN '{KEYS}Not a dict' " + REFUSED
    ),
)
sql(
    "parse_response_compact",
    None,
    ANSWERED.format(
        "WHEN turn = 2 THEN 'Unexpected format: [''choices'']' "
        "WHEN turn = 3 THEN 'Unexpected format: [''z'']' "
        "WHEN turn = 4 THEN 'Unexpected format: not an object' WHEN turn = 5 THEN '' "
        "WHEN turn = 6 THEN 'LLM Error 503: ' || text"
    ),
)

# --- mentions and enrichment ------------------------------------------------

ANSWERS = """sold AS (SELECT l_partkey, string_agg(s_name, ', ' ORDER BY s_name) AS names
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey),
ans AS (SELECT p_partkey * 2 AS answer_id, upper(names || ' ship the ' || p_name || '.') AS answer
  FROM part JOIN sold ON p_partkey = l_partkey
  UNION ALL SELECT (conv_id * 8 + turn) * 2 + 1, text FROM conversations),
low AS (SELECT answer_id, lower(answer) AS l FROM ans)"""
TERMS = """tm AS (SELECT trim(name) AS name, label, min(node_id) AS first_id FROM n GROUP BY name, label),
hit AS (SELECT answer_id, name, label, first_id FROM low
  JOIN tm ON tm.name <> '' AND contains(l, lower(tm.name)))"""
NAMES = """tm AS (SELECT name, min(node_id) AS first_id FROM n GROUP BY name),
hit AS (SELECT answer_id, name, first_id FROM low JOIN tm ON contains(l, lower(tm.name)))"""
sql("mention_table", SUPPLY, "SELECT answer_id, name, label, first_id FROM hit", ANSWERS, TERMS)
sql("mention_table_names", SUPPLY, "SELECT answer_id, name, first_id FROM hit", ANSWERS, NAMES)
sql(
    "mention_table_documents",
    REVIEW,
    """SELECT doc_id AS text_id, name, label
    FROM (SELECT doc_id, lower(text) AS l FROM documents)
    JOIN (SELECT DISTINCT name, label FROM n) t ON contains(l, lower(t.name))""",
)
ENRICHED = """SELECT ans.answer_id, answer || coalesce(chr(10) || chr(10) || '{heading}'
    || chr(10) || bullets, '') AS answer
    FROM ans LEFT JOIN (SELECT answer_id, string_agg({bullet}, chr(10)
      ORDER BY {order}) AS bullets FROM hit GROUP BY answer_id) b ON ans.answer_id = b.answer_id"""
sql(
    "enrich_answers",
    SUPPLY,
    ENRICHED.format(
        heading="**Related Concepts from the Graph:**",
        bullet="'• **' || name || '** is a **' || label || '** related to the knowledge graph.'",
        order="first_id, name, label",
    ),
    ANSWERS,
    TERMS,
)
sql(
    "enrich_answers_names",
    SUPPLY,
    ENRICHED.format(
        heading="**More context:**",
        bullet="'• ' || name || ' is a key element in this graph.'",
        order="first_id, name",
    ),
    ANSWERS,
    NAMES,
)

prompt_oracles()
ORACLE["node_summary_repeated_ids"] = ORACLE["node_summary"]
