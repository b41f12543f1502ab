"""Name resolution, ordering, grouping, search, schema changes and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.predicates import fuzzy_match
from ...operators import grouping as g
from ...operators import links as ln
from ...operators import ordering as o
from ...operators import resolve as res
from ...operators import schema_change as ch
from ...operators import search
from ...session import cut_lineage
from ..registry import query

# One entry per customer. Names repeat inside a project often enough to collide.
ENTRIES = """SELECT *, CASE WHEN kind = 'source' THEN concat(source_name, '.', ref_name) ELSE ref_name END AS base_name,
  CASE WHEN relation_name = '' THEN '' ELSE lower(concat('rel_', ref_name)) END AS rel_leaf FROM (
SELECT *, concat(kind, '.', package, '.k', CAST(ord AS VARCHAR(12))) AS uid, CASE WHEN ord % 6 = 0 THEN
  concat(chr(34), database, chr(34), '.', chr(34), 'S', schema, chr(34), '.', chr(34), 'Rel_', ref_name, chr(34)) ELSE '' END
  AS relation_name FROM (
SELECT c_custkey AS ord, concat('proj', CAST(c_custkey % 7 AS VARCHAR(12))) AS project,
  CASE WHEN c_custkey % 5 = 0 THEN 'source' ELSE 'model' END AS kind,
  concat(CASE c_custkey % 4 WHEN 0 THEN 'stg_' WHEN 1 THEN 'int_' WHEN 2 THEN 'Fct_' ELSE '' END, c_mktsegment, '_',
    CAST(CAST(floor(c_custkey / 100) AS BIGINT) AS VARCHAR(12))) AS ref_name,
  CASE WHEN c_custkey % 5 = 0 THEN concat('Src', CAST(c_nationkey % 3 AS VARCHAR(12))) ELSE '' END AS source_name,
  concat('pkg', CAST(c_custkey % 3 AS VARCHAR(12))) AS package,
  CASE WHEN c_nationkey % 6 = 0 THEN '' ELSE concat('Sch', CAST(c_nationkey % 4 AS VARCHAR(12))) END AS schema,
  concat('db', CAST(c_nationkey % 2 AS VARCHAR(12))) AS database,
  CASE WHEN c_custkey % 2 = 0 THEN 'models/core' ELSE '' END AS path_qualifier
FROM {customer}) a) b"""


def entries(t):
    return (t.derive(ENTRIES).withColumn("name", F.col("ref_name")).withColumn("display_name", F.col("base_name"))
            .withColumn("resource_type", F.col("kind")))


# Orders refer to the entry of their customer, in upper case, half of them with a package.
REFS = """SELECT o_orderkey AS ref_id, e.project, upper(e.ref_name) AS wanted,
  CASE WHEN o_orderkey % 2 = 0 THEN upper(e.package) ELSE '' END AS wanted_package, lower(e.source_name) AS wanted_source,
  CASE o_orderkey % 5 WHEN 0 THEN e.ref_name WHEN 1 THEN concat(e.schema, '.', e.ref_name)
    WHEN 2 THEN concat(e.database, '.', e.schema, '.', e.ref_name, ';') WHEN 3 THEN concat('other.', e.ref_name, ' x')
    ELSE concat(chr(34), e.database, chr(34), '.s', e.schema, '.rel_', e.ref_name) END AS relation
FROM {orders} JOIN (@ENTRIES@) e ON e.ord = o_custkey""".replace("@ENTRIES@", ENTRIES)


@query("resolve_ref", f"""SELECT ref_id, uid AS target FROM ({REFS}) r LEFT JOIN (
  SELECT project, pkg, rn, min(uid) AS uid FROM (
    SELECT project, lower(ref_name) AS rn, uid, unnest(list_value('', lower(package))) AS pkg
    FROM ({ENTRIES}) WHERE kind <> 'source') GROUP BY ALL HAVING count(*) = 1) d
ON d.project = r.project AND d.rn = lower(wanted) AND d.pkg = lower(wanted_package)""")
def resolve_ref(t):
    return res.resolve_ref(t.derive(REFS), entries(t), "wanted", "wanted_package").select(
        "ref_id", F.col("target.uid").alias("target"))


@query("resolve_source", f"""SELECT ref_id, uid AS target FROM ({REFS}) r LEFT JOIN (
  SELECT project, lower(source_name) AS sn, lower(ref_name) AS rn, min(uid) AS uid FROM ({ENTRIES})
  WHERE kind = 'source' GROUP BY ALL HAVING count(*) = 1) d
ON d.project = r.project AND d.rn = lower(wanted) AND d.sn = wanted_source""")
def resolve_source(t):
    return res.resolve_source(t.derive(REFS), entries(t), "wanted_source", "wanted").select(
        "ref_id", F.col("target.uid").alias("target"))


@query("resolve_leaf", f"""SELECT ref_id, uid AS target FROM ({REFS}) r LEFT JOIN (
  SELECT project, leaf, min(uid) AS uid FROM (SELECT DISTINCT project, uid,
    unnest(list_value(lower(ref_name), rel_leaf)) AS leaf FROM ({ENTRIES})) WHERE leaf <> ''
  GROUP BY ALL HAVING count(*) = 1) d ON d.project = r.project AND d.leaf = lower(wanted)""")
def resolve_leaf(t):
    return res.resolve_leaf(t.derive(REFS), entries(t), "wanted").select("ref_id", F.col("target.uid").alias("target"))


D_REL = "lower(replace(regexp_extract(rtrim(relation, ';'), '^(\\S*)', 1), chr(34), ''))"
D_CANDIDATES = f"""SELECT DISTINCT project, uid, lower(schema) AS s, lower(database) AS d, unnest(list_value(
  lower(ref_name), lower(base_name),
  CASE WHEN schema <> '' THEN lower(concat(schema, '.', ref_name)) END,
  CASE WHEN schema <> '' THEN lower(concat(database, '.', schema, '.', ref_name)) END,
  nullif(rel_leaf, ''), CASE WHEN rel_leaf <> '' THEN concat('s', lower(schema), '.', rel_leaf) END,
  CASE WHEN rel_leaf <> '' THEN concat(database, '.s', lower(schema), '.', rel_leaf) END)) AS needle FROM ({ENTRIES})"""


@query("resolve_relation", f"""
WITH texts AS (SELECT DISTINCT project, list_filter(string_split({D_REL}, '.'), lambda x: x <> '') AS p FROM ({REFS})),
takes AS (SELECT project, p, len(p) AS n, unnest(range(1, len(p) + 1)) AS take FROM texts),
found AS (SELECT t.project, t.p, t.take, min(c.uid) AS uid FROM takes t JOIN ({D_CANDIDATES}) c ON c.project = t.project
    AND c.needle = array_to_string(t.p[t.n - t.take + 1:], '.')
  WHERE (t.take > 1 OR t.n < 2 OR c.s = '' OR c.s = t.p[t.n - 1]) AND (t.take > 2 OR t.n < 3 OR c.d = '' OR c.d = t.p[t.n - 2])
  GROUP BY ALL HAVING count(*) = 1),
best AS (SELECT project, p, max_by(uid, take) AS uid FROM found GROUP BY ALL)
SELECT ref_id, coalesce(b.uid, l.uid) AS target FROM (SELECT *, list_filter(string_split({D_REL}, '.'), lambda x: x <> '') AS p
  FROM ({REFS})) r LEFT JOIN best b ON b.project = r.project AND b.p = r.p
LEFT JOIN (SELECT project, leaf, min(uid) AS uid FROM (SELECT DISTINCT project, uid,
    unnest(list_value(lower(ref_name), rel_leaf)) AS leaf FROM ({ENTRIES})) WHERE leaf <> ''
  GROUP BY ALL HAVING count(*) = 1) l ON l.project = r.project AND len(r.p) = 1 AND l.leaf = r.p[1]""")
def resolve_relation(t):
    return res.resolve_relation(t.derive(REFS), entries(t), "relation").select(
        "ref_id", F.col("target.uid").alias("target"))


def _level_sql() -> str:
    """The levels of qualification, one nested pass each."""
    tail = "CASE WHEN kind = 'source' THEN list_value(source_name, ref_name) ELSE list_value(ref_name) END"
    qualifier = "replace(coalesce(nullif(schema, ''), path_qualifier), '/', '.')"
    prefixes = (f"list_value({qualifier})", f"list_value(package, {qualifier})",
                f"list_value(database, package, {qualifier})", f"list_value(database, package, {qualifier}, package)")
    sql = f"SELECT *, base_name AS dn FROM ({ENTRIES})"
    for prefix in prefixes:
        parts = f"list_filter(list_concat({prefix}, {tail}), lambda x: x <> '')"
        name = (f"array_to_string(list_filter({parts}, lambda x, i: "
                f"list_position(list_transform({parts}, lambda y: lower(y)), lower(x)) = i), '.')")
        sql = (f"SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY project, lower(dn)) > 1 THEN {name} ELSE dn END "
               f"AS dn) FROM ({sql})")
    return (f"SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY project, lower(dn)) > 1 "
            f"THEN concat(dn, '.', replace(uid, '.', '_')) ELSE dn END AS dn) FROM ({sql})")


@query("qualify_names", f"SELECT project, uid, dn AS display_name FROM ({_level_sql()})")
def qualify_names(t):
    return o.qualify_names(entries(t)).select("project", "uid", "display_name")


# Ordering -------------------------------------------------------------------------------------------

ALIASED = """SELECT c_custkey % 4 AS project, c_custkey AS ord, CASE c_custkey % 5 WHEN 0 THEN concat(c_mktsegment, ' table')
  WHEN 1 THEN concat('9', c_mktsegment) WHEN 2 THEN '' ELSE concat('t.', c_mktsegment, '-x') END AS name FROM {customer}"""
D_ALIAS = """CASE WHEN regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') = '' OR regexp_matches(name, '^[0-9]')
  THEN concat('e_', regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g')) ELSE regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') END"""


@query("unique_alias", f"""SELECT project, ord, CASE WHEN k = 1 THEN a ELSE concat(a, '_', k) END AS alias FROM (
  SELECT *, row_number() OVER (PARTITION BY project, a ORDER BY ord) AS k FROM (SELECT *, {D_ALIAS} AS a FROM ({ALIASED})))""")
def unique_alias(t):
    return o.unique_alias(t.derive(ALIASED), ["project"], "ord").select("project", "ord", "alias")


# Names that end in suffixes of other names, so that aliases compete for them.
CLASHING = """SELECT p_size % 10 AS project, p_partkey AS ord, concat(CASE p_partkey % 3 WHEN 0 THEN 'small box' WHEN 1 THEN 'box' ELSE 'box_2' END,
  CASE p_partkey % 7 WHEN 0 THEN '_2' WHEN 1 THEN '_3' WHEN 2 THEN concat('_', CAST(p_partkey % 11 + 2 AS VARCHAR(9))) ELSE '' END) AS name FROM {part}"""


@query("unique_alias_clash", f"""
WITH RECURSIVE n AS (SELECT project, ord, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS base, row_number() OVER (PARTITION BY project ORDER BY ord) AS no
                     FROM ({CLASHING})),
w AS (SELECT project, CAST(0 AS BIGINT) AS no, CAST(NULL AS BIGINT) AS ord, CAST([] AS VARCHAR[]) AS used, '' AS alias FROM n GROUP BY project
  UNION ALL SELECT project, no, ord, list_append(used, alias), alias FROM (
    SELECT n.project, n.no, n.ord, w.used, list_filter(list_transform(range(1, CAST(len(w.used) AS BIGINT) + 2),
        lambda i: CASE WHEN i = 1 THEN n.base ELSE concat(n.base, '_', i) END), lambda x: NOT list_contains(w.used, x))[1] AS alias
    FROM w JOIN n ON n.project = w.project AND n.no = w.no + 1))
SELECT project, ord, alias FROM w WHERE no > 0""")
def unique_alias_clash(t):
    return o.unique_alias(t.derive(CLASHING), ["project"], "ord").select("project", "ord", "alias")


FREE = """SELECT o_custkey AS uid, CASE o_orderkey % 5 WHEN 0 THEN 'new_column' WHEN 1 THEN 'New_Column_2'
  WHEN 2 THEN 'new_column_3' WHEN 3 THEN 'new_column_02' ELSE 'other' END AS name, o_orderkey AS ord,
  'int' AS type FROM {orders}"""
D_FREE = f"""SELECT uid, CASE WHEN NOT bool_or(lower(name) = 'new_column') THEN 'new_column'
  WHEN NOT bool_or(lower(name) = 'new_column_2') THEN 'new_column_2'
  WHEN NOT bool_or(lower(name) = 'new_column_3') THEN 'new_column_3' ELSE 'new_column_4' END AS free_name, max(ord) AS last
FROM ({FREE}) GROUP BY uid"""


@query("next_free_name", f"SELECT uid, free_name FROM ({D_FREE})")
def next_free_name(t):
    rows = t.derive(FREE)
    return o.next_free_name(rows, rows, ["uid"])


@query("add_column", f"""SELECT uid, name, type, ord FROM ({FREE})
UNION ALL SELECT uid, free_name, 'varchar(255)', last + 1 FROM ({D_FREE}) WHERE uid % 2 = 0""")
def add_column(t):
    rows = t.derive(FREE)
    return ch.add_column(rows, rows.where("uid % 2 = 0"), ["uid"], "mysql").select("uid", "name", "type", "ord")


@query("column_head", """SELECT o_custkey AS uid, o_orderkey AS ord, rn, CASE WHEN n > 8 THEN concat('+', n - 8, ' more')
  ELSE '' END AS footer FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)
  AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}) WHERE rn <= 8""")
def column_head(t):
    rows = t.orders.select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("ord"))
    return o.column_head(rows, ["uid"], "ord").withColumn("rn", F.col("rn").cast("bigint"))


@query("dedupe_first", """SELECT user_id, event_type, min(event_id) AS event_id, min_by(value, event_id) AS value
FROM {events} GROUP BY user_id, event_type""")
def dedupe_first(t):
    rows = t.events.select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("at"))
    return o.dedupe_first(rows, ["user_id", "event_type"], "at").drop("at")


@query("batch_strings", """SELECT c_nationkey, CAST(floor((rn - 1) / 5) AS BIGINT) AS batch,
  concat('filename:project.yml ', string_agg(CASE WHEN c_mktsegment = 'BUILDING' THEN 'org:' ELSE 'user:' END || c_name,
  ' ' ORDER BY rn)) AS query FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn
  FROM {customer}) GROUP BY 1, 2""")
def batch_strings(t):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Organization").otherwise("User")
    return o.batch_strings(t.customer, ["c_nationkey"], "c_custkey", o.owner_scope(kind, "c_name"),
                           "filename:project.yml ")


@query("default_first", "SELECT DISTINCT o_orderpriority AS branch, o_custkey AS repo FROM {orders}")
def default_first(t):
    branches = t.orders.select(F.col("o_orderpriority").alias("branch"), F.col("o_custkey").alias("repo")).distinct()
    return o.default_first(branches, F.col("branch") == "3-MEDIUM", "branch")


@query("sorted_names", "SELECT DISTINCT source, lang FROM {documents} WHERE trim(source) <> '' AND trim(lang) <> ''")
def sorted_names(t):
    return o.sorted_names(t.documents, "source", "lang")


@query("fuzzy_rank", """SELECT p_partkey, score FROM (SELECT p_partkey, CAST(CASE WHEN position('ed' IN n) > 0
  THEN 1001 - position('ed' IN n) WHEN p1 > 0 AND p2 > 0 THEN CASE WHEN p2 = 1 THEN 7 ELSE 2 END ELSE -1 END AS BIGINT)
  AS score FROM (SELECT *, position('e' IN n) AS p1, CASE WHEN position('e' IN n) > 0 THEN
  position('d' IN substr(n, position('e' IN n) + 1)) ELSE 0 END AS p2 FROM (
  SELECT p_partkey, lower(p_name || ' ' || p_type) AS n FROM {part}))) WHERE score >= 0
ORDER BY score DESC, p_partkey""")
def fuzzy_rank(t):
    return search.fuzzy_rank(t.part, "ED", "p_name", "p_type", "p_partkey").select("p_partkey", "score")


# Grouping -------------------------------------------------------------------------------------------

# Every part is a table of the project of its brand, with four candidate groups.
GROUPED = """SELECT p_brand AS project, p_partkey AS node, p_type AS domain,
  CASE WHEN p_size < 48 THEN 'bulk' ELSE concat('s', CAST(p_size AS VARCHAR(9))) END AS layer,
  CASE WHEN p_size % 2 = 0 THEN '' ELSE concat(' ', substring(p_name, 1, 3), ' ') END AS folder,
  CASE WHEN p_size % 10 < 7 THEN NULL ELSE p_type END AS schema FROM {part}"""


def _signal_sql(col: str) -> str:
    return f"""SELECT project, '{col}' AS mode, count(*) FILTER (WHERE v <> '') AS groups,
  count(*) FILTER (WHERE v <> '' AND n >= 2) AS multi, coalesce(max(n) FILTER (WHERE v <> ''), 0) AS biggest,
  CAST(coalesce(sum(n) FILTER (WHERE v <> ''), 0) AS BIGINT) AS assigned, CAST(sum(n) AS BIGINT) AS total
FROM (SELECT project, trim(coalesce({col}, '')) AS v, count(*) AS n FROM ({GROUPED}) GROUP BY 1, 2) GROUP BY project"""


D_SIGNAL = "groups >= 2 AND multi >= 2 AND biggest / total <= 0.9 AND assigned >= total * 0.5"


@query("group_signal", f"SELECT * EXCLUDE (mode), {D_SIGNAL} AS signal FROM ({_signal_sql('layer')})")
def group_signal(t):
    return g.group_signal(t.derive(GROUPED), ["project"], "layer")


@query("available_group_modes", "SELECT project, mode, CAST(place AS BIGINT) AS place, groups FROM (" + " UNION ALL ".join(
    f"SELECT *, {i} AS place FROM ({_signal_sql(m)})" for i, m in enumerate(g.GROUP_MODES)) + f") WHERE {D_SIGNAL}")
def available_group_modes(t):
    return g.available_group_modes(t.derive(GROUPED), ["project"])


@query("apply_group", f"""SELECT project, node, CASE WHEN trim(folder) <> '' AND count(*) OVER (PARTITION BY project,
  trim(folder)) >= 2 THEN trim(folder) ELSE '' END AS "group" FROM ({GROUPED})""")
def apply_group(t):
    return g.apply_group(t.derive(GROUPED), ["project"], "folder").select("project", "node", "group")


@query("group_extent", """SELECT p_brand, min(p_size) AS x_min, max(p_size) AS x_max,
  min(p_retailprice) AS y_min, max(p_retailprice + p_size) AS y_max FROM {part} GROUP BY p_brand""")
def group_extent(t):
    rows = t.part.withColumn("top", F.col("p_retailprice") + F.col("p_size"))
    return g.group_extent(rows, ["p_brand"], {"x": ("p_size", "p_size"), "y": ("p_retailprice", "top")})


STATS = """SELECT c_custkey AS project, 'erd' AS mode, CAST(c_nationkey AS BIGINT) AS tables,
  CAST(c_custkey % 3 AS BIGINT) AS relations FROM {customer}
UNION ALL SELECT c_custkey, 'lineage', CAST(c_nationkey AS BIGINT), CAST(c_custkey % 5 AS BIGINT) FROM {customer}"""


@query("mode_choice", f"""WITH s AS (SELECT *, count(*) FILTER (WHERE relations > 0) OVER (PARTITION BY project) AS any_edges FROM ({STATS}))
SELECT project, mode, tables, relations, row_number() OVER (PARTITION BY project ORDER BY relations DESC, mode) - 1 AS rank,
  CASE WHEN relations = 0 THEN 'tables only' WHEN mode = 'lineage' THEN 'ref/source edges' ELSE 'FK relations' END AS label
FROM s WHERE relations > 0 OR (any_edges = 0 AND mode = 'erd')""")
def mode_choice(t):
    return g.mode_choice(t.derive(STATS), ["project"])


@query("visibility_counts", """SELECT p_brand, count(*) FILTER (WHERE lower(p_name) LIKE '%r%n%g%') AS matched, count(*) AS total,
  count(*) FILTER (WHERE p_size % 3 = 0) AS hidden,
  count(*) FILTER (WHERE lower(p_name) LIKE '%r%n%g%' AND p_size % 3 <> 0) AS shown FROM {part} GROUP BY p_brand""")
def visibility_counts(t):
    return g.visibility_counts(t.part, ["p_brand"], fuzzy_match("rng", "p_name"), F.col("p_size") % 3 == 0)


@query("model_stats", """
SELECT c_nationkey AS project, count(*) AS tables, CAST(sum(n) AS BIGINT) AS relations, CAST(sum(m) AS BIGINT) AS columns,
  CAST(sum(y) AS BIGINT) AS columns_typed FROM {customer}
LEFT JOIN (SELECT o_custkey, count(*) AS m, count(*) FILTER (WHERE o_orderstatus = 'F') AS n,
  count(*) FILTER (WHERE o_orderkey % 2 = 0) AS y FROM {orders} GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def model_stats(t):
    nation = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project"))
    rows = t.orders.join(nation, "o_custkey").withColumn("type", F.when(F.col("o_orderkey") % 2 == 0, "int").otherwise(" "))
    return g.model_stats(nation, rows, rows.where("o_orderstatus = 'F'"), ["project"])


@query("typed_columns", f"SELECT uid, count(*) FILTER (WHERE ord % 2 = 0) AS columns_typed FROM ({FREE}) GROUP BY uid")
def typed_columns(t):
    rows = t.derive(FREE).withColumn("type", F.when(F.col("ord") % 2 == 0, "int").when(F.col("ord") % 3 == 0, "  "))
    return g.typed_columns(rows, ["uid"])


# Schema changes -------------------------------------------------------------------------------------

EDGES = """SELECT c_nationkey AS project, o_orderkey AS ord, c_name AS from_table, concat('T', CAST(o_orderkey % 50 AS VARCHAR(9)))
  AS to_table, 'Order_Id' AS col1, o_orderpriority AS col2 FROM {orders} JOIN {customer} ON c_custkey = o_custkey"""
CHANGES = """SELECT c_nationkey AS project, lower(c_name) AS key, concat('Renamed ', c_name) AS new_name FROM {customer}
  WHERE c_acctbal > 5000 UNION ALL SELECT n_nationkey, 't7', 'Seven' FROM {nation}"""


@query("rename_cascade", f"""SELECT e.project, e.ord, coalesce(a.new_name, from_table) AS from_table,
  coalesce(b.new_name, to_table) AS to_table FROM ({EDGES}) e
LEFT JOIN ({CHANGES}) a ON a.project = e.project AND a.key = lower(from_table)
LEFT JOIN ({CHANGES}) b ON b.project = e.project AND b.key = lower(to_table)""")
def rename_cascade(t):
    tables = t.customer.select(F.col("c_nationkey").alias("project"), F.lower("c_name").alias("table_key"),
                               F.col("c_name").alias("name"))
    return ch.rename_cascade(tables, t.derive(EDGES), t.derive(CHANGES))[1].select("project", "ord", "from_table", "to_table")


@query("rename_tables", f"""SELECT c_nationkey AS project, lower(coalesce(new_name, c_name)) AS table_key,
  coalesce(new_name, c_name) AS name FROM {{customer}} LEFT JOIN ({CHANGES}) ON project = c_nationkey AND key = lower(c_name)""")
def rename_tables(t):
    tables = t.customer.select(F.col("c_nationkey").alias("project"), F.lower("c_name").alias("table_key"),
                               F.col("c_name").alias("name"))
    return ch.rename_tables(tables, t.derive(CHANGES)).select("project", "table_key", "name")


COL_CHANGES = """SELECT c_nationkey AS project, lower(c_name) AS table_key, 'Order_Id' AS old_name, 'oid' AS new_name
  FROM {customer} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_nationkey, lower(c_name), '1-URGENT', 'urgent' FROM {customer}
  WHERE c_custkey % 3 = 0"""


@query("rename_column", f"""SELECT project, ord, concat(CASE WHEN k % 2 = 0 THEN 'oid' ELSE col1 END, ',',
  CASE WHEN col2 = '1-URGENT' AND k % 3 = 0 THEN 'urgent' ELSE col2 END) AS from_cols
FROM (SELECT *, CAST(right(from_table, 9) AS BIGINT) AS k FROM ({EDGES}))""")
def rename_column(t):
    rows = t.derive(EDGES).withColumn("from_cols", F.array("col1", "col2"))
    cols = rows.select("project", F.lower("from_table").alias("table_key"), F.col("col1").alias("name")).distinct()
    lists = ch.rename_column(cols, rows, t.derive(COL_CHANGES))[1]
    return lists.select("project", "ord", F.array_join("from_cols", ",").alias("from_cols"))


@query("rename_column_own", f"""SELECT DISTINCT project, lower(from_table) AS table_key,
  CASE WHEN CAST(right(from_table, 9) AS BIGINT) % 2 = 0 THEN 'oid' ELSE col1 END AS name FROM ({EDGES})""")
def rename_column_own(t):
    rows = t.derive(EDGES).withColumn("from_cols", F.array("col1", "col2"))
    cols = rows.select("project", F.lower("from_table").alias("table_key"), F.col("col1").alias("name")).distinct()
    return ch.rename_column(cols, rows, t.derive(COL_CHANGES))[0]


@query("retype_column", """SELECT c_nationkey AS project, c_name AS table_key, c_mktsegment AS name,
  CASE WHEN c_acctbal < 0 THEN 'bigint' ELSE 'int' END AS type FROM {customer}""")
def retype_column(t):
    cols = t.customer.select(F.col("c_nationkey").alias("project"), F.col("c_name").alias("table_key"),
                             F.col("c_mktsegment").alias("name"), F.lit("int").alias("type"), "c_acctbal")
    changes = cols.where("c_acctbal < 0").select("project", "table_key", "name", F.lit("bigint").alias("new_type"))
    return ch.retype_column(cols, changes).select("project", "table_key", "name", "type")


def _versions(t):
    rows = t.customer.select(F.col("c_nationkey").alias("project"), F.col("c_name").alias("table_key"), "c_acctbal")
    return rows.where("c_acctbal < 6000"), rows.where("c_acctbal > 2000")


D_DIFF = """SELECT c_nationkey AS project, c_name AS table_key, CASE WHEN c_acctbal > 2000 AND c_acctbal < 6000 THEN 'kept'
  WHEN c_acctbal > 2000 THEN 'added' ELSE 'dropped' END AS status FROM {customer}"""


@query("schema_diff", D_DIFF)
def schema_diff(t):
    return ch.schema_diff(*_versions(t), ["project"])


@query("new_tables", f"SELECT project, table_key FROM ({D_DIFF}) WHERE status = 'added'")
def new_tables(t):
    return ch.new_tables(ch.schema_diff(*_versions(t), ["project"]))


@query("structure_changed", f"SELECT project, bool_or(status <> 'kept') AS changed FROM ({D_DIFF}) GROUP BY project")
def structure_changed(t):
    return ch.structure_changed(ch.schema_diff(*_versions(t), ["project"]), ["project"])


# Hidden: whoever has an event. Changed: every customer.
def _hidden(t):
    return t.events.select(F.col("user_id").alias("node")), t.customer.select(F.col("c_custkey").alias("node"))


@query("hidden_set_update", "SELECT user_id AS node FROM {events} UNION SELECT c_custkey FROM {customer}")
def hidden_set_update(t):
    return ch.hidden_set_update(*_hidden(t), True)


@query("hidden_set_show", "SELECT c_custkey AS node FROM {customer} EXCEPT SELECT user_id FROM {events}")
def hidden_set_show(t):
    return ch.hidden_set_update(*reversed(_hidden(t)), False)


@query("hidden_set_changes", "SELECT c_custkey AS node FROM {customer} WHERE c_custkey NOT IN (SELECT user_id FROM {events})")
def hidden_set_changes(t):
    return ch.hidden_set_changes(*_hidden(t), True)


@query("restore_attributes", """SELECT c_custkey AS node, CASE WHEN v IS NOT NULL THEN v ELSE c_acctbal END AS x,
  CASE WHEN v IS NOT NULL THEN k ELSE c_nationkey END AS y, v IS NOT NULL AS restored FROM {customer}
LEFT JOIN (SELECT user_id, max(value) AS v, CAST(count(*) AS INTEGER) AS k FROM {events} GROUP BY user_id) ON user_id = c_custkey""")
def restore_attributes(t):
    tables = t.customer.select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").alias("y"))
    saved = t.events.groupBy(F.col("user_id").alias("node")).agg(F.max("value").alias("x"), F.count("*").cast("int").alias("y"))
    return ch.restore_attributes(tables, saved, ["node"], ["x", "y"])


@query("keep_listed", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT user_id FROM {events})")
def keep_listed(t):
    return ch.keep_listed(t.customer.select("c_custkey", "c_name"), t.events.select(F.col("user_id").alias("c_custkey")),
                          "c_custkey")


# Links ----------------------------------------------------------------------------------------------

# Tables are the distinct part names of a brand; some plural. Columns: a key, and references to the
# names of other parts of the brand in several spellings.
LINK_TABLES = """SELECT project, table_key, row_number() OVER (PARTITION BY project ORDER BY table_key) AS ord FROM (
  SELECT DISTINCT p_brand AS project, concat(replace(p_name, ' ', '_'), CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 's' ELSE 'es' END)
  AS table_key FROM {part}) a"""
LINK_COLUMNS = """SELECT project, table_key, name, pk, row_number() OVER (PARTITION BY project ORDER BY table_key, pk DESC, name) AS ord
FROM (SELECT DISTINCT project, table_key, name, pk FROM (
  SELECT project, table_key, CASE WHEN ord % 2 = 0 THEN 'id' ELSE concat(table_key, '_key') END AS name, true AS pk FROM (@TABLES@) x
  UNION ALL SELECT x.project, x.table_key, CASE p_size % 4 WHEN 0 THEN concat(replace(p_name, ' ', '_'), '_id')
    WHEN 1 THEN concat(upper(replace(p_name, ' ', '_')), 'Id') WHEN 2 THEN concat(replace(p_name, ' ', '_'), 's_KEY') ELSE 'note' END,
    false FROM (@TABLES@) x JOIN {part} ON p_brand = x.project AND p_partkey % 5 = x.ord % 5) b) c""".replace("@TABLES@", LINK_TABLES)
D_LINKS = f"""
WITH cols AS ({LINK_COLUMNS}), tabs AS ({LINK_TABLES}),
forms AS (SELECT project, form, max_by(table_key, seen) AS table_key FROM (
    SELECT project, table_key AS form, table_key, ord * 2 AS seen FROM tabs
    UNION ALL SELECT project, regexp_replace(table_key, '(es|s)$', ''), table_key, ord * 2 + 1 FROM tabs) GROUP BY 1, 2),
keys AS (SELECT project, table_key, min_by(name, ord) AS key_col FROM cols WHERE pk GROUP BY 1, 2),
one AS (SELECT c.project, c.table_key, c.name, min(p.table_key) AS to_key FROM cols c JOIN cols p ON p.pk AND p.project = c.project
    AND lower(p.name) = lower(c.name) AND p.table_key <> c.table_key WHERE NOT c.pk GROUP BY 1, 2, 3 HAVING count(*) = 1),
two AS (SELECT c.project, c.table_key, c.name, coalesce(f1.table_key, f2.table_key, f3.table_key) AS to_key
    FROM (SELECT *, regexp_extract(lower(name), '^(.+?)_?id$', 1) AS stem FROM cols WHERE NOT pk) c
    LEFT JOIN forms f1 ON f1.project = c.project AND f1.form = stem LEFT JOIN forms f2 ON f2.project = c.project AND f2.form = stem || 's'
    LEFT JOIN forms f3 ON f3.project = c.project AND f3.form = stem || 'es' WHERE stem <> ''),
alls AS (SELECT c.project, c.table_key AS from_key, c.name AS from_col, c.ord, coalesce(one.to_key, k.table_key) AS to_key,
    CASE WHEN one.to_key IS NOT NULL THEN c.name ELSE k.key_col END AS to_col, CASE WHEN one.to_key IS NOT NULL THEN 1 ELSE 2 END AS rule
    FROM cols c LEFT JOIN one USING (project, table_key, name)
    LEFT JOIN two ON two.project = c.project AND two.table_key = c.table_key AND two.name = c.name AND two.to_key <> c.table_key
    LEFT JOIN keys k ON k.project = c.project AND k.table_key = two.to_key WHERE NOT c.pk)
SELECT * FROM alls WHERE to_key IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY project, from_key, lower(from_col), to_key, lower(to_col) ORDER BY ord) = 1"""


@query("infer_links_by_key", f"SELECT project, from_key, from_col, to_key, to_col FROM ({D_LINKS}) WHERE rule = 1")
def infer_links_by_key(t):
    found = ln.links_by_key_name(cut_lineage(t.derive(LINK_COLUMNS)))
    return ln.add_links(found, None, "ord").drop("ord")


@query("infer_links", f"SELECT project, from_key, from_col, to_key, to_col, CAST(rule AS BIGINT) AS rule FROM ({D_LINKS})")
def infer_links(t):
    # both rules read the columns several times
    return ln.infer_links(cut_lineage(t.derive(LINK_COLUMNS)), t.derive(LINK_TABLES)).drop("ord").withColumn(
        "rule", F.col("rule").cast("bigint"))


NEW_LINKS = """SELECT 'p' AS project, o_orderkey AS ord, concat('T', CAST(o_custkey % 20 AS VARCHAR(9))) AS from_key, o_orderstatus AS from_col,
  concat('T', CAST(o_orderkey % 20 AS VARCHAR(9))) AS to_key, lower(o_orderstatus) AS to_col FROM {orders}"""
D_PAIR = """least(concat(lower(from_key), '.', lower(from_col)), concat(lower(to_key), '.', lower(to_col))) AS a,
  greatest(concat(lower(from_key), '.', lower(from_col)), concat(lower(to_key), '.', lower(to_col))) AS b"""


@query("add_links", f"""SELECT project, ord, from_key, from_col, to_key, to_col FROM (SELECT *, {D_PAIR} FROM ({NEW_LINKS}))
WHERE a <> b AND (a, b) NOT IN (SELECT (a, b) FROM (SELECT {D_PAIR} FROM ({NEW_LINKS}) WHERE ord % 7 = 0))
QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY ord) = 1""")
def add_links(t):
    rows = t.derive(NEW_LINKS)
    return ln.add_links(rows, rows.where("ord % 7 = 0"), "ord").select(*rows.columns)
