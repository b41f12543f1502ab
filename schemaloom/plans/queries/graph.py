"""Graph operators on edges between rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import graph as gr
from ...operators.ranges import overlap_pairs
from ..registry import query
from .names import ENTRIES, entries

# Supply edges: part -> supplier, per return flag, and a few edges from a node to itself.
SUPPLY = """SELECT DISTINCT l_returnflag AS project, concat('p', CAST(l_partkey AS VARCHAR(12))) AS from_key,
  CASE WHEN l_partkey % 50 = 0 THEN concat('p', CAST(l_partkey AS VARCHAR(12)))
       ELSE concat('s', CAST(l_suppkey AS VARCHAR(12))) END AS to_key FROM {lineitem}"""
D_DEGREE = f"""SELECT project, node, count(*) AS degree FROM (SELECT project, from_key AS node FROM ({SUPPLY}) WHERE from_key <> to_key
  UNION ALL SELECT project, to_key FROM ({SUPPLY}) WHERE from_key <> to_key) GROUP BY 1, 2"""


@query("degree", D_DEGREE)
def degree(t):
    return gr.degree(t.derive(SUPPLY), ["project"])


@query("hub_weight", f"""SELECT e.project, from_key, to_key, 1 + least(greatest(a.degree, b.degree), 12) AS weight FROM ({SUPPLY}) e
JOIN ({D_DEGREE}) a ON a.project = e.project AND a.node = from_key JOIN ({D_DEGREE}) b ON b.project = e.project AND b.node = to_key
WHERE from_key <> to_key""")
def hub_weight(t):
    return gr.edge_weights(t.derive(SUPPLY), ["project"]).select("project", "from_key", "to_key", "weight")


@query("neighbours", f"""SELECT DISTINCT project, node FROM (SELECT project, unnest(list_value(from_key, to_key)) AS node
FROM ({SUPPLY}) WHERE from_key = 's3' OR to_key = 's3')""")
def neighbours(t):
    return gr.neighbours(t.derive(SUPPLY), "s3", ["project"])


@query("focus_edges", f"SELECT project, from_key, to_key, from_key = 's3' OR to_key = 's3' AS connected FROM ({SUPPLY})")
def focus_edges(t):
    return gr.focus_edges(t.derive(SUPPLY), "s3")


@query("orphans", "SELECT doc_id AS node FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})")
def orphans(t):
    """Documents that no label points at."""
    edges = t.labels.select(F.col("doc_id").alias("from_key"), (-1 - F.col("toxic").cast("bigint")).alias("to_key"))
    return gr.orphans(t.documents.select(F.col("doc_id").alias("node")), edges, [])


@query("cluster_members", "SELECT concat('cluster::', p_type) AS cluster, p_partkey AS member FROM {part} WHERE p_size > 10")
def cluster_members(t):
    tables = t.part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("").alias("group"))
    return gr.cluster_members(tables, [])


# Lineage over the whole schema: region -> nation -> customer -> order, nation -> supplier -> order (by
# its first line), and a ring of suppliers that no level can be given to.
LINEAGE = """
SELECT concat('r', CAST(n_regionkey AS VARCHAR(12))) AS from_key, concat('n', CAST(n_nationkey AS VARCHAR(12))) AS to_key FROM {nation}
UNION ALL SELECT concat('n', CAST(c_nationkey AS VARCHAR(12))), concat('c', CAST(c_custkey AS VARCHAR(12))) FROM {customer}
UNION ALL SELECT concat('c', CAST(o_custkey AS VARCHAR(12))), concat('o', CAST(o_orderkey AS VARCHAR(12))) FROM {orders}
UNION ALL SELECT concat('n', CAST(s_nationkey AS VARCHAR(12))), concat('s', CAST(s_suppkey AS VARCHAR(12))) FROM {supplier}
UNION ALL SELECT concat('s', CAST(l_suppkey AS VARCHAR(12))), concat('o', CAST(l_orderkey AS VARCHAR(12))) FROM {lineitem}
UNION ALL SELECT concat('c', CAST(c_custkey AS VARCHAR(12))), concat('d', CAST(c_custkey AS VARCHAR(12))) FROM {customer}
UNION ALL SELECT concat('d', CAST(c_custkey AS VARCHAR(12))), concat('o', CAST(c_custkey AS VARCHAR(12))) FROM {customer}"""
RING = """
UNION ALL SELECT concat('x', CAST(s_suppkey AS VARCHAR(12))), concat('x', CAST((s_suppkey + 1) % (SELECT count(*) FROM {supplier}) AS VARCHAR(12)))
FROM {supplier}
UNION ALL SELECT concat('x', CAST(s_suppkey AS VARCHAR(12))), concat('below', CAST(s_suppkey AS VARCHAR(12))) FROM {supplier}"""


@query("lineage_levels", f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({LINEAGE})), walk AS (
  SELECT DISTINCT from_key AS node, CAST(0 AS BIGINT) AS level FROM e WHERE from_key NOT IN (SELECT to_key FROM e)
  UNION SELECT e.to_key, walk.level + 1 FROM walk JOIN e ON e.from_key = walk.node)
SELECT node, max(level) AS level, false AS cyclic FROM walk GROUP BY node
UNION ALL SELECT DISTINCT to_key, CAST(NULL AS BIGINT), true FROM (SELECT NULL AS from_key, NULL AS to_key WHERE false {RING})""")
def lineage_levels(t):
    return gr.lineage_levels(t.derive(LINEAGE + RING))


@query("lineage_from_artifacts", f"""SELECT e.project, d.base_name AS from_table, e.base_name AS to_table FROM ({ENTRIES}) e
JOIN ({ENTRIES}) d ON d.ord IN (e.ord - 7, e.ord - 14) WHERE e.kind <> 'source'""")
def lineage_from_artifacts(t):
    rows = entries(t)
    # dependencies of an entry: the two before it in its project, and one that does not exist
    deps = F.array(*[F.col(f"d{i}") for i in (1, 2)], F.lit("model.gone"))
    before = [rows.select((F.col("ord") + 7 * i).alias("ord"), F.col("uid").alias(f"d{i}")) for i in (1, 2)]
    with_deps = rows.join(before[0], "ord", "left").join(before[1], "ord", "left").withColumn(
        "depends_on", F.filter(deps, lambda d: d.isNotNull()))
    return gr.lineage_from_artifacts(with_deps).select("project", "from_table", "to_table")


SCRIPTS = """SELECT e.project, e.base_name AS to_table, o_orderkey AS ord, concat('select * from ', chr(123), chr(123), ' ref(', chr(39),
  d.ref_name, chr(39), ') ', chr(125), chr(125), ' a join source(', chr(34), d.source_name, chr(34), ', ', chr(34), upper(d.ref_name), chr(34),
  ') b -- xref(', chr(39), 'no', chr(39), ')', CASE WHEN o_orderkey % 2 = 0 THEN concat(' union all select 1 from ref(', chr(39), d.package, chr(39), ' , ',
  chr(39), d.ref_name, chr(39), ')') ELSE '' END) AS sql, d.ref_name AS rn, d.source_name AS sn, d.package AS pk
FROM {orders} JOIN (@ENTRIES@) e ON e.ord = o_custkey JOIN (@ENTRIES@) d ON d.ord = e.ord + 7""".replace("@ENTRIES@", ENTRIES)
D_CALLS = f"""SELECT project, to_table, ord, 0 AS pos, 'ref' AS kind, '' AS q, rn AS name FROM ({SCRIPTS})
UNION ALL SELECT project, to_table, ord, 1, 'source', sn, upper(rn) FROM ({SCRIPTS})
UNION ALL SELECT project, to_table, ord, 2, 'ref', pk, rn FROM ({SCRIPTS}) WHERE ord % 2 = 0"""


@query("sql_calls", f"SELECT project, to_table, ord, kind, q AS qualifier, name FROM ({D_CALLS})")
def sql_calls(t):
    calls = gr.sql_calls(t.derive(SCRIPTS).select("project", "to_table", "ord", "sql"))
    return calls.select("project", "to_table", "ord", "call.kind", F.concat("call.source_name", "call.package").alias("qualifier"),
                        "call.name")


@query("lineage_from_sql", f"""
WITH k AS (SELECT project, kind, q, lower(ref_name) AS n, min(base_name) AS hit FROM (
  SELECT project, 'ref' AS kind, unnest(list_value('', lower(package))) AS q, ref_name, base_name FROM ({ENTRIES}) WHERE kind <> 'source'
  UNION ALL SELECT project, 'source', lower(source_name), ref_name, base_name FROM ({ENTRIES}) WHERE kind = 'source')
  GROUP BY ALL HAVING count(*) = 1)
SELECT c.project, c.to_table, c.ord, coalesce(k.hit, CASE WHEN c.kind = 'source' THEN concat(c.q, '.', c.name) ELSE c.name END) AS from_table
FROM ({D_CALLS}) c LEFT JOIN k ON k.project = c.project AND k.kind = c.kind AND k.q = lower(c.q) AND k.n = lower(c.name)""")
def lineage_from_sql(t):
    rows = t.derive(SCRIPTS).select("project", "to_table", "ord", "sql")
    return gr.lineage_from_sql(rows, entries(t)).select(
        "project", "to_table", F.col("ord.script").alias("ord"), "from_table")


# Boxes of events: a minute of the day by a value, per user.
BOXES = """SELECT user_id, event_id, CAST(event_id % 1440 AS DOUBLE) AS x0, CAST(event_id % 1440 + 90 AS DOUBLE) AS x1,
  round(value * 10) AS y0, round(value * 10) + 40 AS y1 FROM {events}"""


@query("overlap_pairs", f"""SELECT a.user_id, a.event_id AS left_key, b.event_id AS right_key FROM ({BOXES}) a JOIN ({BOXES}) b
ON b.user_id = a.user_id AND a.event_id < b.event_id
WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) + 18 > 0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) + 18 > 0""")
def overlap(t):
    return overlap_pairs(t.derive(BOXES), "event_id", [("x0", "x1"), ("y0", "y1")], 18.0, ["user_id"])
