"""Sources, constraint folding and edges, on metadata documents made from the given tables.

Documents are templates filled per row: ``~`` stands for a double quote and ``<`` ``>`` for braces,
put right by ``translate``. Every customer (or order) is a small project of its own, so the number of
documents grows with the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import constraints as k
from ...operators import relations as r
from ...operators import resolve as res
from ...operators.ordering import stable_ordinals
from ...sources import artifacts, lines, projects, schema_files, sinks
from ...session import shared_folder
from ..model import export_model, model_from_artifacts
from ..registry import query
from .names import ENTRIES, entries

JSON = "translate(%s, '~<>', concat(chr(34), chr(123), chr(125)))"
KEY = "CAST(c_custkey AS VARCHAR(12))"

# A model, a model that is disabled for every third customer, two tests and a source per project.
MANIFEST_TEXT = JSON % f"""concat('<~nodes~:<~model.p.m~:<~resource_type~:~model~,~name~:~m_', {KEY},
 '~,~alias~:~', c_mktsegment, '~,~schema~:~s', CAST(c_nationkey AS VARCHAR(12)),
 '~,~package_name~:~p~,~config~:<~enabled~:true,~materialized~:~table~>,~columns~:<~id~:<~data_type~:~int~>,~Seg~:<>,~Code~:<~name~:~code~>>,',
 '~depends_on~:<~nodes~:[~source.p.raw.t~]>>,~model.p.n~:<~unique_id~:~model.p.n~,~resource_type~:~seed~,~name~:~n_', {KEY},
 '~,~columns~:<~id~:<>,~m_id~:<>>,~enabled~:', CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END,
 '>,~test.p.u~:<~resource_type~:~test~,~test_metadata~:<~name~:~unique~,~kwargs~:<~column_name~:~id~>>,~attached_node~:~model.p.m~,~depends_on~:<~nodes~:[~model.p.m~]>>,',
 '~test.p.r~:<~resource_type~:~test~,~column_name~:~m_id~,~test_metadata~:<~name~:~x.relationships~,~kwargs~:<~to~:~a~,~arguments~:<~to~:~ref(m)~,~field~:~id~>>>,~depends_on~:<~nodes~:[~model.p.n~,~model.p.m~]>>>,',
 '~sources~:<~source.p.raw.t~:<~name~:~t_', {KEY}, '~,~columns~:<~id~:<>>>>>')"""
MANIFESTS = f"SELECT concat('/fleet/c', {KEY}) AS project_dir, c_custkey, {MANIFEST_TEXT} AS text FROM {{customer}}"
DIR = f"concat('/fleet/c', {KEY})"


@query("read_manifest_nodes", f"""
SELECT {DIR} AS project_dir, 'model.p.m' AS uid, 'model' AS resource_type, c_mktsegment AS name,
  concat('m_', {KEY}) AS ref_name, concat('s', CAST(c_nationkey AS VARCHAR)) AS schema_name, 'p' AS package,
  'source.p.raw.t' AS depends_on, 'm' AS domain FROM {{customer}}
UNION ALL SELECT {DIR}, 'model.p.n', 'seed', concat('n_', {KEY}), concat('n_', {KEY}), '', '', '', 'n'
FROM {{customer}} WHERE c_custkey % 3 <> 0""")
def read_manifest_nodes(t):
    found = artifacts.read_manifest_nodes(artifacts.parse_manifests(t.derive(MANIFESTS)))
    return found.select(
        "project_dir", "uid", "resource_type", "name", "ref_name", F.col("schema").alias("schema_name"), "package",
        F.array_join("depends_on", ",").alias("depends_on"),
        F.col("groups.domain").alias("domain"))


@query("read_manifest_sources", f"""SELECT {DIR} AS project_dir, 'source.p.raw.t' AS uid, 'source' AS kind,
  concat('t_', {KEY}) AS name, 'raw' AS source_name, concat('raw.t_', {KEY}) AS base_name, 'raw' AS domain
FROM {{customer}}""")
def read_manifest_sources(t):
    found = artifacts.read_manifest_sources(artifacts.parse_manifests(t.derive(MANIFESTS)))
    return found.select("project_dir", "uid", "kind", "name", "source_name", "base_name", "groups.domain")


@query("read_manifest_tests", f"""
SELECT {DIR} AS project_dir, 'test.p.u' AS test_id, 'unique' AS test, 'id' AS column, '' AS target, '' AS field,
  'model.p.m' AS attached, 'model.p.m' AS deps FROM {{customer}}
UNION ALL SELECT {DIR}, 'test.p.r', 'relationships', 'm_id', 'ref(m)', 'id', '', 'model.p.n,model.p.m'
FROM {{customer}}""")
def read_manifest_tests(t):
    found = artifacts.read_manifest_tests(artifacts.parse_manifests(t.derive(MANIFESTS)))
    return found.drop("pos").withColumn("deps", F.array_join("deps", ","))


CATALOG_TEXT = JSON % f"""concat('<~nodes~:<~model.p.m~:<~columns~:<~ID~:<~name~:~ID~,~type~:~',
  CASE WHEN c_custkey % 2 = 0 THEN 'bigint' ELSE ' ' END, '~>,~added~:<~type~:~', c_mktsegment, '~>>>>,~sources~:<>>')"""
CATALOGS = f"SELECT {DIR} AS project_dir, {CATALOG_TEXT} AS text FROM {{customer}}"


@query("read_catalog_columns", f"""
SELECT {DIR} AS project_dir, 'model' AS kind, 'model.p.m' AS uid, CAST(0 AS BIGINT) AS pos, 'ID' AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 'bigint' ELSE '' END AS type FROM {{customer}}
UNION ALL SELECT {DIR}, 'model', 'model.p.m', 1, 'added', c_mktsegment FROM {{customer}}""")
def read_catalog_columns(t):
    return artifacts.parse_catalogs(t.derive(CATALOGS))


def _declared(t):
    rows = artifacts.read_manifest_nodes(artifacts.parse_manifests(t.derive(MANIFESTS)))
    from ...functions.arrays import columns_from_map

    return rows.select(F.col("project_dir").alias("project"), "uid", F.explode(columns_from_map("column_map")).alias("c")).select(
        "project", "uid", "c.*")


def _catalog(t):
    return artifacts.parse_catalogs(t.derive(CATALOGS)).select(
        F.col("project_dir").alias("project"), "uid", "name", "type", "pos")


D_M_COLUMNS = f"""
SELECT {DIR} AS project, 'model.p.m' AS uid, 'id' AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 'bigint' ELSE 'int' END AS type, CAST(1 AS BIGINT) AS ord FROM {{customer}}
UNION ALL SELECT {DIR}, 'model.p.m', 'Seg', '', 2 FROM {{customer}}
UNION ALL SELECT {DIR}, 'model.p.m', 'code', '', 3 FROM {{customer}}
UNION ALL SELECT {DIR}, 'model.p.m', 'added', c_mktsegment, 4 FROM {{customer}}
UNION ALL SELECT {DIR}, 'model.p.n', 'id', '', 1 FROM {{customer}} WHERE c_custkey % 3 <> 0
UNION ALL SELECT {DIR}, 'model.p.n', 'm_id', '', 2 FROM {{customer}} WHERE c_custkey % 3 <> 0"""


@query("enrich_from_catalog", f"SELECT project, uid, name, type FROM ({D_M_COLUMNS})")
def enrich_from_catalog(t):
    return k.enrich_from_catalog(_declared(t), _catalog(t)).select("project", "uid", "name", "type")


@query("stable_ordinals", f"SELECT project, uid, name, ord FROM ({D_M_COLUMNS})")
def stable_ordinals_query(t):
    cols = k.enrich_from_catalog(_declared(t), _catalog(t))
    placed = cols.withColumn("phase", F.shiftright("ord", 60)).withColumn(
        "pos", F.col("ord").bitwiseAND(F.lit((1 << 60) - 1)))
    return stable_ordinals(placed, ["project", "uid"]).select("project", "uid", "name", "ord")


def _model(t, lineage=False):
    known = t.customer.select(F.concat(F.lit("/fleet/c"), F.col("c_custkey").cast("string")).alias("project_dir"),
                              F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("project"))
    return model_from_artifacts(artifacts.parse_manifests(t.derive(MANIFESTS)),
                                artifacts.parse_catalogs(t.derive(CATALOGS)), known, lineage)


# A disabled seed leaves the relationships test without its second table: the test falls to the model
# and the text of its target stays as an unknown table.
@query("artifact_model", f"""
SELECT concat('p', {KEY}) AS project, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE concat('n_', {KEY}) END AS from_table,
  'm_id' AS from_cols, CASE WHEN c_custkey % 3 = 0 THEN 'ref(m)' ELSE c_mktsegment END AS to_table, 'id' AS to_cols,
  c_custkey % 3 = 0 AS to_missing FROM {{customer}}""")
def artifact_model_relations(t):
    return _model(t).relations.select(
        "project", "from_table", F.array_join("from_cols", ",").alias("from_cols"), "to_table",
        F.array_join("to_cols", ",").alias("to_cols"), "to_missing")


@query("artifact_lineage", f"""SELECT concat('p', {KEY}) AS project, concat('raw.t_', {KEY}) AS from_table,
  c_mktsegment AS to_table FROM {{customer}}""")
def artifact_lineage(t):
    return _model(t, lineage=True).relations.select("project", "from_table", "to_table")


@query("artifact_model_stats", f"""SELECT concat('p', {KEY}) AS project, 'manifest' AS source, 'erd' AS mode,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END AS BIGINT) AS tables, CAST(1 AS BIGINT) AS relations,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 7 END AS BIGINT) AS columns, CAST(2 AS BIGINT) AS columns_typed FROM {{customer}}""")
def artifact_model_stats(t):
    return _model(t).stats


@query("stored_model_meta", f"""SELECT concat('p', {KEY}) AS project, 'erd' AS mode, concat('p', {KEY}) AS title, 'manifest' AS source,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END AS BIGINT) AS tables, CAST(1 AS BIGINT) AS relations,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 7 END AS BIGINT) AS columns, CAST(2 AS BIGINT) AS columns_typed, 'org/fleet' AS repo,
  'main' AS branch FROM {{customer}}""")
def stored_model_meta(t):
    """Written with its commit and read back."""
    path = f"{shared_folder(t.spark)}/model-{uuid.uuid4().hex}"
    sinks.write_model(_model(t).parts(), path, repo="org/fleet", branch="main")
    return sinks.read_model(t.spark, path)["meta"]


# A model's lines: two or three tables a project, one edge unless its target is missing.
M_LINES = f"""SELECT c_custkey, unnest([['erDiagram'],
  [concat('    ', c_mktsegment, ' {{'), concat('        ', CASE WHEN c_custkey % 2 = 0 THEN 'bigint' ELSE 'int' END, ' id UK'), '        unknown Seg',
   '        unknown code', concat('        ', c_mktsegment, ' added'), '    }}'],
  CASE WHEN c_custkey % 3 <> 0 THEN [concat('    n_', {KEY}, ' {{'), '        unknown id', '        unknown m_id FK', '    }}'] ELSE [] END,
  [concat('    "raw.t_', {KEY}, '" {{'), '        unknown id', '    }}'],
  CASE WHEN c_custkey % 3 <> 0 THEN [concat('    ', c_mktsegment, ' ||--o{{ n_', {KEY}, ' : "m_id"')] ELSE [] END]) AS block FROM {{customer}}"""


@query("model_export_mermaid", f"""SELECT concat('p', {KEY}) AS project, line, count(*) AS times
FROM (SELECT c_custkey, unnest(block) AS line FROM ({M_LINES})) GROUP BY ALL""")
def model_export_mermaid(t):
    return export_model(_model(t), "mermaid").groupBy("project", "line").agg(F.count(F.lit(1)).alias("times"))


# YAML -----------------------------------------------------------------------------------------------

YAML_TEXT = JSON % f"""concat('<models: [<name: ', lower(c_mktsegment), ', columns: [<name: id, data_type: int, tests: [unique, not_null]>, <name: no, tests: [<relationships: <arguments: <to: ref(x), field: id>>>]>]>, <name: off, config: <enabled: ',
  CASE WHEN c_custkey % 2 = 0 THEN 'false' ELSE 'true' END, '>>], sources: [<name: raw, schema: S, tables: [<name: t_', {KEY}, '>]>]>')"""
YAML_FILES = f"SELECT concat({DIR}, '/models/core/schema.yml') AS file, {YAML_TEXT} AS value FROM {{customer}}"
SETTINGS_TEXT = JSON % f"""concat('<name: ', CASE WHEN c_custkey % 4 = 0 THEN '~ ~' ELSE concat('shop_', {KEY}) END,
  CASE c_custkey % 3 WHEN 0 THEN ', model-paths: [src]' WHEN 1 THEN ', model_paths: models' ELSE '' END, '>')"""
SETTINGS_FILES = f"""SELECT concat('/fleet/c', {KEY}, CASE c_custkey % 5 WHEN 0 THEN '/target' WHEN 1 THEN '/node_modules/x'
  ELSE '/a' END, '/dbt_project.yml') AS file, {SETTINGS_TEXT} AS value FROM {{customer}}"""


def _binary(files):
    return files.select("file", F.encode("value", "UTF-8").alias("content"))


def _every_project(t):
    """A project per customer at its folder, default paths."""
    return t.customer.select(
        F.concat(F.lit("/fleet/c"), F.col("c_custkey").cast("string")).alias("project_dir"),
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("project"),
        *[F.array(F.lit(d)).alias(n) for n, d in projects.SETTINGS.items()])


@query("discover_projects", f"""
SELECT concat('/fleet/c', {KEY}, '/a') AS project_dir,
  CASE WHEN c_custkey % 4 = 0 THEN 'a' ELSE concat('shop_', {KEY}) END AS project FROM {{customer}}
WHERE c_custkey % 5 > 1""")
def discover_projects(t):
    docs = projects.yaml_documents(_binary(t.derive(SETTINGS_FILES)))
    return projects.find_projects(docs, "/fleet").select("project_dir", "project")


@query("project_settings", f"""
SELECT concat('/fleet/c', {KEY}, '/a') AS project_dir, CASE WHEN c_custkey % 3 = 0 THEN 'src' ELSE 'models' END
  AS model_paths, 'seeds' AS seed_paths, 'snapshots' AS snapshot_paths FROM {{customer}} WHERE c_custkey % 5 > 1""")
def project_settings(t):
    docs = projects.yaml_documents(_binary(t.derive(SETTINGS_FILES)))
    found = projects.find_projects(docs, "/fleet")
    return found.select("project_dir", *[F.array_join(c, ",").alias(c) for c in projects.SETTINGS])


@query("pick_source", """
SELECT c_custkey AS project, 'manifest' AS source, c_name AS name FROM {customer} WHERE c_acctbal > 5000
UNION ALL SELECT o_custkey, 'yml', o_orderpriority FROM {orders}
WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)""")
def pick_source(t):
    manifest = t.customer.where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("project"), F.lit("manifest").alias("source"), F.col("c_name").alias("name"))
    yml = t.orders.select(F.col("o_custkey").alias("project"), F.lit("yml").alias("source"),
                          F.col("o_orderpriority").alias("name"))
    return projects.pick_source(manifest, yml)


def _objects(t):
    return schema_files.schema_objects(projects.yaml_documents(_binary(t.derive(YAML_FILES))), _every_project(t))


@query("read_schema_yaml", f"""
SELECT concat('p', {KEY}) AS project, 'model' AS kind, lower(c_mktsegment) AS name, '' AS source_name,
  '' AS schema_name, 'models/core' AS path_qualifier, false AS skipped FROM {{customer}}
UNION ALL SELECT concat('p', {KEY}), 'model', 'off', '', '', 'models/core', c_custkey % 2 = 0 FROM {{customer}}
UNION ALL SELECT concat('p', {KEY}), 'source', concat('t_', {KEY}), 'raw', 'S', 'models/core', false FROM {{customer}}""")
def read_schema_yaml(t):
    return _objects(t).select("project", "kind", "name", "source_name", F.col("schema").alias("schema_name"),
                              "path_qualifier", "skipped")


@query("yaml_columns", f"""
SELECT concat('p', {KEY}) AS project, CAST(0 AS BIGINT) AS pos, 'id' AS name, 'int' AS type FROM {{customer}}
UNION ALL SELECT concat('p', {KEY}), 1, 'no', '' FROM {{customer}}""")
def yaml_columns(t):
    return schema_files.yaml_columns(_objects(t)).select("project", "pos", "name", "type")


@query("yaml_tests", f"""
SELECT concat('p', {KEY}) AS project, 'unique' AS test, 'id' AS column, '' AS target, '' AS field FROM {{customer}}
UNION ALL SELECT concat('p', {KEY}), 'not_null', 'id', '', '' FROM {{customer}}
UNION ALL SELECT concat('p', {KEY}), 'relationships', 'no', 'ref(x)', 'id' FROM {{customer}}""")
def yaml_tests(t):
    return schema_files.yaml_tests(_objects(t)).select("project", "test", "column", "target", "field")


SQL_FILES = f"""SELECT concat('/fleet/c', CAST(o_custkey AS VARCHAR(12)), CASE o_orderkey % 4 WHEN 0 THEN '/models/a/'
  WHEN 1 THEN '/models/' WHEN 2 THEN '/snapshots/' ELSE '/analyses/' END, lower(o_orderstatus), '_',
  CAST(o_orderkey AS VARCHAR(12)), '.v1.sql') AS file, concat(CASE WHEN o_orderkey % 8 = 2 THEN
  concat(chr(123), '%- snapshot snap_', o_orderstatus, ' -%', chr(125)) ELSE '' END, ' select 1') AS value,
  o_orderkey, o_custkey, o_orderstatus FROM {{orders}}"""


@query("read_model_sql", f"""SELECT concat('p', CAST(o_custkey AS VARCHAR)) AS project, 'model' AS kind,
  concat(lower(o_orderstatus), '_', CAST(o_orderkey AS VARCHAR), '.v1') AS name,
  replace(file, concat('/fleet/c', CAST(o_custkey AS VARCHAR), '/'), '') AS relative, value AS sql
FROM ({SQL_FILES}) WHERE o_orderkey % 4 < 2""")
def read_model_sql(t):
    found = schema_files.model_scripts(t.derive(SQL_FILES).select("file", "value"), _every_project(t))
    return found.select("project", "kind", "name", "relative", "sql")


@query("read_snapshot_sql", f"""SELECT concat('p', CAST(o_custkey AS VARCHAR)) AS project, 'snapshot' AS kind,
  CASE WHEN o_orderkey % 8 = 2 THEN concat('snap_', o_orderstatus)
       ELSE concat(lower(o_orderstatus), '_', CAST(o_orderkey AS VARCHAR), '.v1') END AS name
FROM ({SQL_FILES}) WHERE o_orderkey % 4 = 2""")
def read_snapshot_sql(t):
    found = schema_files.snapshot_scripts(t.derive(SQL_FILES).select("file", "value"), _every_project(t))
    return found.select("project", "kind", "name")


SEED_LINES = """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '  ' ELSE concat(role, ', ', chr(34), 'Turn',
  CAST(turn AS VARCHAR(9)), chr(34), ',,', CAST(conv_id AS VARCHAR(9))) END AS value FROM {conversations}"""


@query("read_seed_headers", f"""SELECT conv_id, role || ',Turn' || turn || ',' || conv_id AS header FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM {{conversations}} WHERE turn % 3 <> 0)
WHERE rn = 1 UNION ALL SELECT conv_id, '' FROM {{conversations}} GROUP BY conv_id
HAVING count(*) FILTER (WHERE turn % 3 <> 0) = 0""")
def read_seed_headers(t):
    name = F.concat(F.lit("/fleet/seeds/"), F.col("conv_id").cast("string"), F.lit(".csv"))
    rows = t.derive(SEED_LINES).withColumn("file", name)
    one = t.spark.range(1).select(F.lit("/fleet").alias("project_dir"), F.lit("p").alias("project"),
                                  F.array(F.lit("seeds")).alias("seed_paths"))
    found = schema_files.seed_headers(rows.select("file").distinct(), rows.select(
        "file", F.col("turn").alias("at"), "value"), one)
    return found.select(F.col("name").cast("bigint").alias("conv_id"), F.array_join("header", ",").alias("header"))


JSON_LINES = f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '   ' WHEN 1 THEN concat(props, '-oops')
  WHEN 2 THEN {JSON % "'<~other~:1>'"} WHEN 3 THEN {JSON % "'<~name~:'"}
  ELSE concat({JSON % "'<~name~:~'"}, event_type, {JSON % "'~,~k~:'"}, CAST(user_id AS VARCHAR(9)), chr(125)) END AS value
FROM {{events}}"""


@query("read_json_lines", "SELECT event_id, event_type AS name, user_id AS k FROM {events} WHERE event_id % 5 = 4")
def read_json_lines(t):
    return lines.parse_json_lines(t.derive(JSON_LINES), "name string, k bigint", "name")


@query("model_payload", """
SELECT c_nationkey AS project, md5(concat(chr(123), '"title":"', CAST(c_nationkey AS VARCHAR), ' (lineage)","tables":',
  CAST(count(*) AS VARCHAR), ',"top":"', chr(92), 'u003c', max(c_name), '"', chr(125))) AS payload_md5
FROM {customer} GROUP BY c_nationkey""")
def model_payload(t):
    rows = t.customer.groupBy(F.col("c_nationkey").alias("project")).agg(
        F.concat(F.first("c_nationkey").cast("string"), F.lit(" (lineage)")).alias("title"),
        F.count(F.lit(1)).alias("tables"), F.concat(F.lit("<"), F.max("c_name")).alias("top"))
    return sinks.payload(rows, "project").select("project", F.md5("payload").alias("payload_md5"))


# Constraints and flags ------------------------------------------------------------------------------

# One constraint per order on its customer's table; the column follows from the order.
CONSTRAINTS = """SELECT concat('p', CAST(o_custkey % 10 AS VARCHAR(9))) AS project,
  concat('t', CAST(o_custkey AS VARCHAR(9))) AS uid, o_orderkey AS pos,
  CASE o_orderkey % 5 WHEN 0 THEN 'primary_key' WHEN 1 THEN 'not_null' WHEN 2 THEN 'unique' WHEN 3 THEN 'unique'
    ELSE 'check' END AS type,
  CASE WHEN o_orderkey % 5 = 3 THEN array('a', 'B') ELSE array(concat('c_', lower(o_orderstatus))) END AS columns
FROM {orders}"""
D_CONSTRAINTS = CONSTRAINTS.replace("array(", "list_value(")


@query("constraint_flags", f"""SELECT project, uid, lower(name) AS col_key, bool_or(type = 'primary_key') AS pk,
  bool_or(type IN ('primary_key', 'not_null')) AS nn, bool_or(type = 'unique' AND n = 1) AS uniq
FROM (SELECT project, uid, type, len(columns) AS n, unnest(columns) AS name FROM ({D_CONSTRAINTS})) GROUP BY ALL""")
def constraint_flags(t):
    flags = k.constraint_flags(t.derive(CONSTRAINTS))
    return flags.groupBy("project", "uid", F.lower("name").alias("col_key")).agg(
        *[F.bool_or(f).alias(f) for f in k.FLAGS])


D_DECLARED = "SELECT concat('p', CAST(c_custkey % 10 AS VARCHAR(9))) AS project, concat('t', CAST(c_custkey AS VARCHAR(9))) AS uid, c_custkey AS key FROM {customer}"
TEST_ROWS = """SELECT concat('p', CAST(o_custkey % 10 AS VARCHAR(9))) AS project,
  concat('t', CAST(o_custkey AS VARCHAR(9))) AS uid, o_orderkey AS pos,
  CASE o_orderkey % 3 WHEN 0 THEN 'unique' WHEN 1 THEN 'not_null' ELSE 'relationships' END AS test,
  CASE o_orderkey % 4 WHEN 0 THEN 'ID' WHEN 1 THEN 'extra' WHEN 2 THEN '' ELSE 'id' END AS column FROM {orders}"""
D_TEST_COLUMNS = f"""SELECT project, uid, lower(name) AS col_key, bool_or(nn) AS nn, bool_or(uniq) AS uniq FROM (
  SELECT project, uid, 'id' AS name, false AS nn, false AS uniq FROM ({D_DECLARED})
  UNION ALL SELECT project, uid, "column", test = 'not_null', test = 'unique' FROM ({TEST_ROWS.replace('AS column', 'AS "column"')})
  WHERE test <> 'relationships' AND "column" <> '') GROUP BY ALL"""


def _with_tests(t):
    declared = t.derive(D_DECLARED).select("project", "uid", F.lit("id").alias("name"), F.lit("int").alias("type"),
                                           F.lit(0).alias("pos"))
    return k.assemble_columns(declared, tests=k.test_flags(t.derive(TEST_ROWS)))


@query("test_flags", D_TEST_COLUMNS)
def test_flags(t):
    return _with_tests(t).select("project", "uid", "col_key", "nn", "uniq")


@query("infer_pk", f"SELECT project, uid, col_key, nn AND uniq AS pk FROM ({D_TEST_COLUMNS})")
def infer_pk(t):
    return _with_tests(t).select("project", "uid", "col_key", "pk")


# Lines as the columns of their order: place l_linenumber (repeats are told apart by the other keys).
LINE_COLUMNS = """SELECT o_orderkey % 5 AS project, o_custkey AS uid, o_orderkey AS ord,
  concat('c', CAST(o_orderkey AS VARCHAR(9))) AS name, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS pk FROM {orders}"""


@query("default_target_columns", f"""SELECT project, uid,
  coalesce(string_agg(name, ',' ORDER BY ord) FILTER (WHERE pk), min_by(name, ord)) AS cols
FROM ({LINE_COLUMNS}) GROUP BY project, uid""")
def default_target_columns(t):
    return k.default_target_columns(t.derive(LINE_COLUMNS), ["project", "uid"]).select(
        "project", "uid", F.array_join("default_cols", ",").alias("cols"))


# Edges ----------------------------------------------------------------------------------------------

# Tests of orders against the entries made from customers: two dependencies each, some attached.
FK_TESTS = """
SELECT e.project, concat('t', CAST(o_orderkey AS VARCHAR(12))) AS test_id, o_orderkey AS pos, 'relationships' AS test,
  CASE WHEN o_orderkey % 4 = 0 THEN 'seg' ELSE 'id' END AS col,
  CASE o_orderkey % 3 WHEN 0 THEN concat('ref(', chr(39), e.ref_name, chr(39), ')') WHEN 1 THEN 'no_call'
    ELSE concat('source(', chr(39), 'gone', chr(39), ',', chr(39), 'away', chr(39), ')') END AS target,
  CASE WHEN o_orderkey % 2 = 0 THEN 'id' ELSE '' END AS field,
  CASE WHEN o_orderkey % 5 = 0 THEN e.uid ELSE '' END AS attached,
  e.uid AS dep1, f.uid AS dep2
FROM {orders} JOIN (@ENTRIES@) e ON e.ord = o_custkey
LEFT JOIN (@ENTRIES@) f ON f.ord = o_custkey + 7""".replace("@ENTRIES@", ENTRIES)
D_KNOWN = f"SELECT project, uid, base_name FROM ({ENTRIES})"
# Entries whose number is even have the column 'seg'; all have 'id'.
D_OWNERS = f"""
SELECT x.*, CASE WHEN attached <> '' AND attached IS DISTINCT FROM excluded THEN attached
  WHEN dep1 IS DISTINCT FROM excluded AND (col = 'id' OR n1 % 2 = 0) THEN dep1
  WHEN dep2 IS NOT NULL AND dep2 IS DISTINCT FROM excluded AND (col = 'id' OR n2 % 2 = 0) THEN dep2
  WHEN dep1 IS DISTINCT FROM excluded THEN dep1 WHEN dep2 IS NOT NULL AND dep2 IS DISTINCT FROM excluded THEN dep2
  ELSE dep1 END AS owner
FROM (SELECT q.*, a.ord AS n1, b.ord AS n2,
    CASE WHEN o.n = 1 AND q.pos % 3 = 0 THEN o.uid END AS excluded, CASE WHEN q.pos % 3 = 0 AND o.n = 1 THEN o.base_name END AS called
  FROM ({FK_TESTS}) q LEFT JOIN ({ENTRIES}) a ON a.uid = q.dep1 LEFT JOIN ({ENTRIES}) b ON b.uid = q.dep2
  LEFT JOIN (SELECT project, lower(ref_name) AS rn, count(*) AS n, min(uid) AS uid, min(base_name) AS base_name
    FROM ({ENTRIES}) WHERE kind <> 'source' GROUP BY 1, 2) o
  ON o.project = q.project AND q.pos % 3 = 0
     AND o.rn = lower(replace(replace(q.target, concat('ref(', chr(39)), ''), concat(chr(39), ')'), ''))) x"""


def _fk_tests(t):
    return t.derive(FK_TESTS).withColumnRenamed("col", "column").withColumn(
        "deps", F.filter(F.array("dep1", "dep2"), lambda d: d.isNotNull())).drop("dep1", "dep2")


def _seen(t):
    e = entries(t)
    return e.select("project", "uid", F.lit("id").alias("name")).unionByName(
        e.where("ord % 2 = 0").select("project", "uid", F.lit("Seg").alias("name")))


@query("resolve_test_owner", f"SELECT project, test_id, owner FROM ({D_OWNERS})")
def resolve_test_owner(t):
    found = r.resolve_tests(_fk_tests(t), entries(t), _seen(t))
    return found.select("project", "test_id", F.col("owner.uid").alias("owner"))


@query("fk_from_test", f"""
SELECT o.project, k1.base_name AS from_table, o.col AS from_col,
  coalesce(o.called, CASE WHEN o.dep1 <> o.owner THEN k2.base_name ELSE k3.base_name END,
    CASE o.pos % 3 WHEN 0 THEN replace(replace(o.target, concat('ref(', chr(39)), ''), concat(chr(39), ')'), '')
      WHEN 1 THEN 'no_call' ELSE 'gone.away' END) AS to_table, o.field AS to_col
FROM ({D_OWNERS}) o JOIN ({D_KNOWN}) k1 ON k1.uid = o.owner LEFT JOIN ({D_KNOWN}) k2 ON k2.uid = o.dep1
LEFT JOIN ({D_KNOWN}) k3 ON k3.uid = o.dep2""")
def fk_from_test(t):
    edges = r.fk_from_test(r.resolve_tests(_fk_tests(t), entries(t), _seen(t)))
    return edges.select("project", "from_table", F.array_join("from_cols", ",").alias("from_col"), "to_table",
                        F.array_join("to_cols", ",").alias("to_col"))


SPECS = """SELECT e.project, e.base_name AS from_table, o_orderpriority AS col,
  CASE o_orderkey % 3 WHEN 0 THEN concat('ref(', chr(39), e.ref_name, chr(39), ')') WHEN 1 THEN 'plain text'
    ELSE concat('source(', chr(39), 'src', chr(39), ',', chr(39), 'x', chr(39), ')') END AS to_text,
  CASE WHEN o_orderkey % 2 = 0 THEN 'id' ELSE '' END AS field, o_orderkey AS ord, e.ref_name
FROM {orders} JOIN (@ENTRIES@) e ON e.ord = o_custkey""".replace("@ENTRIES@", ENTRIES)
D_REFS = f"""SELECT project, lower(ref_name) AS rn, count(*) AS n, min(uid) AS uid, min(base_name) AS base_name
  FROM ({ENTRIES}) WHERE kind <> 'source' GROUP BY 1, 2"""


@query("fk_from_yaml", f"""SELECT s.project, s.from_table, s.col AS from_col,
  CASE s.ord % 3 WHEN 0 THEN coalesce(d.base_name, s.ref_name) WHEN 1 THEN 'plain text' ELSE 'src.x' END AS to_table,
  s.field AS to_col FROM ({SPECS}) s
LEFT JOIN ({D_REFS}) d ON d.project = s.project AND d.rn = lower(s.ref_name) AND d.n = 1""")
def fk_from_yaml(t):
    edges = r.fk_from_yaml(t.derive(SPECS).withColumnRenamed("col", "column"), entries(t))
    return edges.select("project", "from_table", F.array_join("from_cols", ",").alias("from_col"), "to_table",
                        F.array_join("to_cols", ",").alias("to_col"))


FKS = """SELECT e.project, e.uid, 'foreign_key' AS type, o_orderkey AS pos, o_orderpriority AS col, e.ref_name,
  CASE o_orderkey % 3 WHEN 0 THEN concat('ref(', chr(39), e.ref_name, chr(39), ')')
    WHEN 1 THEN concat('references ', e.ref_name, ' (k1, k2)') ELSE concat('nowhere.', o_orderstatus) END AS target,
  CASE WHEN o_orderkey % 2 = 0 THEN 'id' ELSE '' END AS to_col
FROM {orders} JOIN (@ENTRIES@) e ON e.ord = o_custkey""".replace("@ENTRIES@", ENTRIES)
D_LEAVES = f"""SELECT project, needle, count(*) AS n, min(uid) AS uid, min(base_name) AS base_name FROM (
  SELECT DISTINCT project, uid, base_name, unnest(list_value(lower(ref_name), lower(base_name), rel_leaf)) AS needle
  FROM ({ENTRIES})) GROUP BY project, needle"""


@query("fk_from_constraint", f"""
SELECT f.project, e.base_name AS from_table, f.col AS from_col,
  CASE f.pos % 3 WHEN 0 THEN coalesce(d.base_name, f.ref_name) WHEN 1 THEN coalesce(l.base_name, lower(f.ref_name))
    ELSE lower(f.target) END AS to_table,
  CASE WHEN f.to_col <> '' THEN f.to_col WHEN f.pos % 3 = 1 THEN 'k1,k2'
    WHEN f.pos % 3 = 0 AND d.uid IS NOT NULL THEN 'id' ELSE '' END AS to_cols
FROM ({FKS}) f JOIN ({ENTRIES}) e ON e.uid = f.uid
LEFT JOIN ({D_REFS}) d ON d.project = f.project AND d.rn = lower(f.ref_name) AND d.n = 1 AND f.pos % 3 = 0
LEFT JOIN ({D_LEAVES}) l ON l.project = f.project AND l.needle = lower(f.ref_name) AND l.n = 1 AND f.pos % 3 = 1""")
def fk_from_constraint(t):
    rows = t.derive(FKS).select(
        "project", "uid", "type", "pos", F.array("col").alias("columns"), F.array("target").alias("targets"),
        F.filter(F.array("to_col"), lambda c: c != "").alias("to_columns"))
    cols = _seen(t).select("project", "uid", "name", (F.col("name") != "id").cast("bigint").alias("ord"),
                           F.lit(False).alias("pk"))
    edges = r.fk_from_constraint(rows, entries(t), cols)
    return edges.select("project", "from_table", F.array_join("from_cols", ",").alias("from_col"), "to_table",
                        F.array_join("to_cols", ",").alias("to_cols"))


# Raw edges between names of customers; half of the targets are unknown, and repeats are many.
RAW_EDGES = """SELECT o_custkey % 3 AS project, upper(c_name) AS from_table,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('Customer#00000000', CAST(o_orderkey % 10 AS VARCHAR(9)))
       ELSE concat('Missing_', o_orderstatus) END AS to_table, o_orderpriority AS from_col,
  CASE WHEN o_orderkey % 3 = 0 THEN 'id' ELSE '' END AS to_col, o_orderkey AS ord
FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey"""
NAMES = "SELECT c_custkey % 3 AS project, c_name AS name, c_name AS uid FROM {customer} WHERE c_acctbal > 0"


def _raw(t):
    return t.derive(RAW_EDGES).select("project", "from_table", F.array("from_col").alias("from_cols"), "to_table",
                                      F.filter(F.array("to_col"), lambda c: c != "").alias("to_cols"), "ord")


D_FINAL = f"""SELECT DISTINCT e.project, f.name AS from_table, from_col, coalesce(g.name, to_table) AS to_table, to_col,
  g.name IS NULL AS to_missing FROM ({RAW_EDGES}) e
JOIN ({NAMES}) f ON f.project = e.project AND lower(f.name) = lower(from_table)
LEFT JOIN ({NAMES}) g ON g.project = e.project AND lower(g.name) = lower(to_table)"""


@query("finalize_relations", D_FINAL)
def finalize_relations(t):
    return r.finalize_relations(_raw(t), t.derive(NAMES)).select(
        "project", "from_table", F.array_join("from_cols", ",").alias("from_col"), "to_table",
        F.array_join("to_cols", ",").alias("to_col"), "to_missing")


# Columns named like the priorities (edge columns) and like the status values (plain) of a table's orders.
MARKED = """SELECT DISTINCT c_custkey % 3 AS project, c_name AS uid, lower(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus
  ELSE o_orderpriority END) AS col_key FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE c_acctbal > 0"""


@query("mark_fk_columns", f"""SELECT m.project, m.uid, m.col_key, d.from_col IS NOT NULL AS fk FROM ({MARKED}) m
LEFT JOIN (SELECT DISTINCT project, from_table, lower(from_col) AS from_col FROM ({D_FINAL})) d
ON d.project = m.project AND d.from_table = m.uid AND d.from_col = m.col_key""")
def mark_fk_columns(t):
    tables = t.derive(NAMES)
    return r.mark_fk_columns(t.derive(MARKED), r.finalize_relations(_raw(t), tables), tables)


@query("distinct_edges", f"""SELECT project, lower(from_table) AS from_key, lower(to_table) AS to_key, min(ord) AS ord
FROM ({RAW_EDGES}) GROUP BY 1, 2, 3""")
def distinct_edges(t):
    keyed = t.derive(RAW_EDGES).select("project", F.lower("from_table").alias("from_key"),
                                       F.lower("to_table").alias("to_key"), "ord")
    return r.distinct_edges(keyed, ["project", "from_key", "to_key"], "ord")


@query("visible_edges", f"""SELECT project, from_table, to_table, ord FROM ({RAW_EDGES}) e
WHERE lower(from_table) NOT IN (SELECT lower(c_name) FROM {{customer}} WHERE c_acctbal < 1000)
  AND lower(to_table) NOT IN (SELECT lower(c_name) FROM {{customer}} WHERE c_acctbal < 1000)""")
def visible_edges(t):
    hidden = t.customer.where("c_acctbal < 1000").select(
        F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])).alias("project"), F.col("c_name").alias("name"))
    return r.visible_edges(t.derive(RAW_EDGES), hidden).select("project", "from_table", "to_table", "ord")


@query("export_edges", f"""SELECT project, from_table, to_table, from_col, to_col FROM ({D_FINAL})
WHERE NOT to_missing AND to_col <> ''""")
def export_edges(t):
    final = r.export_edges(r.finalize_relations(_raw(t), t.derive(NAMES)), columns_needed=True)
    return final.select("project", "from_table", "to_table", F.array_join("from_cols", ",").alias("from_col"),
                        F.array_join("to_cols", ",").alias("to_col"))


@query("union_edges", f"""SELECT project, lower(from_table) AS from_key, from_col, lower(to_table) AS to_key, to_col,
  false AS manual FROM ({D_FINAL})
UNION ALL SELECT s_suppkey % 3, lower(s_name), 'id', 'nation', 'key', true FROM {{supplier}}""")
def union_edges(t):
    links = t.supplier.select((F.col("s_suppkey") % 3).alias("project"), F.lower("s_name").alias("from_key"),
                              F.lit("id").alias("from_col"), F.lit("nation").alias("to_key"),
                              F.lit("key").alias("to_col"))
    return r.with_manual_links(r.finalize_relations(_raw(t), t.derive(NAMES)), links)


# Files against entries ------------------------------------------------------------------------------

FILES = """SELECT e.project, CASE WHEN o_orderkey % 4 = 0 THEN 'seed' ELSE 'model' END AS kind,
  concat('f', CAST(o_orderkey AS VARCHAR(12))) AS file,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('new_', o_orderstatus) ELSE upper(e.base_name) END AS name
FROM {orders} JOIN (@ENTRIES@) e ON e.ord = o_custkey""".replace("@ENTRIES@", ENTRIES)


@query("match_file_to_entry", f"""SELECT f.project, f.kind, f.file, f.name, m.uid FROM ({FILES}) f LEFT JOIN (
  SELECT project, kind, lower(base_name) AS nk, min(uid) AS uid FROM ({ENTRIES}) GROUP BY 1, 2, 3 HAVING count(*) = 1) m
ON m.project = f.project AND m.kind = f.kind AND m.nk = lower(f.name)""")
def match_file_to_entry(t):
    named = entries(t).withColumn("name", F.col("base_name"))
    return res.match_file_to_entry(t.derive(FILES), named).select("project", "kind", "file", "name", "uid")


@query("exclude_skipped_files", f"""SELECT f.project, f.kind, f.file, f.name FROM ({FILES}) f WHERE NOT EXISTS (
  SELECT 1 FROM ({ENTRIES}) e WHERE e.ord % 3 = 0 AND e.project = f.project AND e.kind = f.kind
  AND lower(e.base_name) = lower(f.name))""")
def exclude_skipped_files(t):
    skipped = entries(t).where("ord % 3 = 0").select("project", "kind", F.col("base_name").alias("name"))
    return res.exclude_skipped_files(t.derive(FILES), skipped).select("project", "kind", "file", "name")
