"""Column functions on texts made from the given tables.

Inputs are SQL that both engines read the same way: characters a literal would need to escape are
written with chr().
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import arrays, keys, predicates, scores, text, types
from ..registry import query

Q1, Q2, BT, NL = "chr(39)", "chr(34)", "chr(96)", "chr(10)"


def d_clean(x: str) -> str:
    """Oracle SQL: blank for null, spaces and one matched quote pair off."""
    t = f"trim(coalesce({x}, ''))"
    return (f"(CASE WHEN length({t}) >= 2 AND left({t}, 1) IN ({Q1}, {Q2}, {BT}) AND left({t}, 1) = right({t}, 1) "
            f"THEN trim(substr({t}, 2, length({t}) - 2)) ELSE {t} END)")


def d_first(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({d_clean(x)}, '')" for x in xs) + ", '')"


# Texts with spaces, quotes of each kind, blanks and nulls.
RAW = f"""
SELECT p_partkey AS id, CASE p_size % 7
  WHEN 0 THEN concat('  ', p_name, ' ') WHEN 1 THEN concat({Q1}, ' ', p_name, {Q1})
  WHEN 2 THEN concat({Q2}, p_name, {Q2}) WHEN 3 THEN '   ' WHEN 4 THEN NULL
  WHEN 5 THEN concat({Q2}, p_name) ELSE concat({BT}, p_name, ' ', {BT}, ' ') END AS raw,
  p_name AS other, p_size AS size FROM {{part}}"""


@query("clean_scalar", f"SELECT id, {d_clean('raw')} AS cleaned FROM ({RAW})")
def clean_scalar(t):
    return t.derive(RAW).select("id", text.clean_scalar("raw").alias("cleaned"))


@query("first_text", f"SELECT id, {d_first('raw', 'other')} AS value FROM ({RAW})")
def first_text(t):
    return t.derive(RAW).select("id", text.first_text("raw", "other").alias("value"))


# Model-like names from orders: layer prefixes (also doubled), a business word, a number.
NAMED = """
SELECT o_orderkey AS id, concat(
  CASE o_orderkey % 9 WHEN 0 THEN 'stg_' WHEN 1 THEN 'int_' WHEN 2 THEN 'dim_' WHEN 3 THEN 'Raw_stg_'
    WHEN 4 THEN 'final.mart_' WHEN 5 THEN 'fct_' WHEN 6 THEN 'base_' WHEN 7 THEN '_' ELSE '' END,
  CASE o_custkey % 5 WHEN 0 THEN 'orders' WHEN 1 THEN 'Customer_region' WHEN 2 THEN 'stg' WHEN 3 THEN 'billing.line'
    ELSE 'fact_' END,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('_', CAST(o_custkey AS STRING)) END) AS name,
  CASE o_orderkey % 11 WHEN 0 THEN 'source' WHEN 1 THEN 'seed' WHEN 2 THEN 'snapshot' ELSE 'model' END AS kind,
  CASE WHEN o_orderkey % 22 = 0 THEN concat('Erp_', o_orderstatus) ELSE '' END AS source_name,
  CASE o_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'models' WHEN 2 THEN 'models/staging/erp' ELSE 'models//marts' END
    AS path_qualifier,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('models/core/', o_orderpriority, '/m.sql') ELSE 'm.sql' END
    AS file,
  concat(' ', upper(o_orderstatus), '_Schema') AS schema_name
FROM {orders}"""

_PREFIXES = "|".join(keys.LAYER_PREFIXES)
D_TOKEN = "regexp_extract(%s, '^[_.]*([^_.]+)', 1)"
D_DOMAIN = f"""CASE
  WHEN kind = 'source' AND source_name <> '' THEN {D_TOKEN % 'lower(source_name)'}
  WHEN {D_TOKEN % f"regexp_replace(lower(name), '^(({_PREFIXES})[_.])+', '')"} <> ''
  THEN {D_TOKEN % f"regexp_replace(lower(name), '^(({_PREFIXES})[_.])+', '')"}
  ELSE {D_TOKEN % 'lower(name)'} END"""
D_FOLDER_TEXT = """CASE WHEN path_qualifier <> '' THEN path_qualifier
  WHEN file LIKE '%/%' THEN regexp_replace(file, '/[^/]*$', '') ELSE '' END"""
D_SEGMENTS = f"list_filter(string_split({D_FOLDER_TEXT}, '/'), lambda x: x <> '')"
D_LAYER = f"""CASE WHEN kind IN ('source', 'seed', 'snapshot') THEN kind
  WHEN len({D_SEGMENTS}) >= 2 THEN {D_SEGMENTS}[2]
  WHEN regexp_matches(lower(name), '^(stg_|staging[_.])') THEN 'staging'
  WHEN regexp_matches(lower(name), '^(int_|intermediate[_.])') THEN 'intermediate'
  WHEN regexp_matches(lower(name), '^(fct|dim|mart|rpt|agg|fact)_') THEN 'marts' ELSE '' END"""
D_FOLDER = f"array_to_string({D_SEGMENTS}[2:], '/')"
NAMED_ORACLE = NAMED.replace("AS STRING", "AS VARCHAR")


def _segments():
    return keys.path_segments("path_qualifier", "file", F.lit(None).cast("string"))


@query("domain_key", f"SELECT id, {D_DOMAIN} AS domain FROM ({NAMED_ORACLE})")
def domain_key(t):
    return t.derive(NAMED).select(
        "id", keys.domain_key("kind", "kind", "source_name", "name", "name", "name").alias("domain"))


@query("layer_key", f"SELECT id, {D_LAYER} AS layer FROM ({NAMED_ORACLE})")
def layer_key(t):
    return t.derive(NAMED).select("id", keys.layer_key("kind", "kind", _segments(), "name").alias("layer"))


@query("folder_key", f"SELECT id, {D_FOLDER} AS folder FROM ({NAMED_ORACLE})")
def folder_key(t):
    return t.derive(NAMED).select("id", keys.folder_key(_segments()).alias("folder"))


@query("build_group_keys", f"""SELECT id, {D_DOMAIN} AS domain, {D_LAYER} AS layer, {D_FOLDER} AS folder,
  lower(trim(schema_name)) AS schema_key FROM ({NAMED_ORACLE})""")
def build_group_keys(t):
    groups = keys.build_group_keys("kind", "kind", "source_name", "name", "name", "name", "schema_name",
                                   "path_qualifier", "file", F.lit(None).cast("string"))
    return t.derive(NAMED).withColumn("g", groups).select(
        "id", "g.domain", "g.layer", "g.folder", F.col("g.schema").alias("schema_key"))


TESTS = """SELECT event_id AS id, CASE user_id % 4 WHEN 0 THEN concat('pkg.', event_type) WHEN 1 THEN 'a.b.unique'
  WHEN 2 THEN concat(' ', event_type, ' ') ELSE '' END AS name,
  CASE user_id % 4 WHEN 0 THEN 'Primary Key' WHEN 1 THEN 'NOT-NULL' WHEN 2 THEN 'foreign - key' ELSE event_type END
    AS kind FROM {events}"""


@query("test_name", f"SELECT id, regexp_extract({d_first('name')}, '([^.]*)$', 1) AS test FROM ({TESTS})")
def test_name(t):
    return t.derive(TESTS).select("id", text.test_name("name").alias("test"))


@query("constraint_type", f"SELECT id, regexp_replace(lower(kind), '[\\s-]+', '_', 'g') AS type FROM ({TESTS})")
def constraint_type(t):
    return t.derive(TESTS).select("id", text.constraint_type("kind").alias("type"))


# Rendered relation names with quotes, brackets, semicolons and trailing words.
RELATIONS = f"""
SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, CASE l_partkey % 6
  WHEN 0 THEN concat({Q2}, 'Ware', {Q2}, '.', {Q2}, 'S', CAST(l_linenumber AS VARCHAR(9)), {Q2}, '.', {Q2}, 'Line', {Q2})
  WHEN 1 THEN concat('[dbo].[T', CAST(l_suppkey AS VARCHAR(9)), '];;')
  WHEN 2 THEN concat('Analytics.orders_', l_returnflag, ' AS o')
  WHEN 3 THEN concat({BT}, 'p-1.d.t', CAST(l_partkey AS VARCHAR(9)), {BT})
  WHEN 4 THEN '' ELSE concat('..x..', l_linestatus, '.') END AS relation FROM {{lineitem}}"""
D_STRIP = "regexp_replace(regexp_replace(%s, '^[`\"''\\[]+', ''), '[`\"''\\]]+$', '')"
D_HEAD = f"regexp_extract(regexp_replace({d_first('relation')}, ';+$', ''), '^(\\S*)', 1)"
D_PARTS = f"list_filter(string_split({D_HEAD}, '.'), lambda x: x <> '')"


@query("relation_leaf", f"""SELECT k1, k2, k3, k4, coalesce({D_STRIP % f"{D_PARTS}[-1]"}, '') AS leaf
FROM ({RELATIONS})""")
def relation_leaf(t):
    return t.derive(RELATIONS).select("k1", "k2", "k3", "k4", text.relation_leaf("relation").alias("leaf"))


@query("normalize_relation", f"""SELECT k1, k2, k3, k4, lower(array_to_string(list_filter(list_transform(
  string_split({D_HEAD}, '.'), lambda x: {D_STRIP % 'x'}), lambda x: x <> ''), '.')) AS relation_key
FROM ({RELATIONS})""")
def normalize_relation(t):
    return t.derive(RELATIONS).select("k1", "k2", "k3", "k4", text.normalize_relation("relation").alias("relation_key"))


@query("strip_identifier", f"SELECT k1, k2, k3, k4, {D_STRIP % d_first('relation')} AS identifier FROM ({RELATIONS})")
def strip_identifier(t):
    return t.derive(RELATIONS).select("k1", "k2", "k3", "k4", text.strip_identifier("relation").alias("identifier"))


@query("bare_name", f"""SELECT k1, k2, k3, k4, regexp_replace(regexp_replace(
  trim(string_split(relation, '.')[-1]), '^[`"\\[]', ''), '[`"\\]]$', '') AS bare FROM ({RELATIONS})""")
def bare_name(t):
    return t.derive(RELATIONS).select("k1", "k2", "k3", "k4", text.bare_name("relation").alias("bare"))


@query("safe_part", """SELECT page_id, trim(regexp_replace(regexp_replace(url, '[\\\\/]+', '.', 'g'), '^$', ''), '.')
  AS part FROM {pages}""")
def safe_part(t):
    return t.pages.select("page_id", text.safe_part("url").alias("part"))


LISTS = f"""SELECT c_custkey AS id, concat({Q2}, c_name, {Q2}, ' , ', lower(c_mktsegment), ',,[', c_mktsegment, ']')
  AS listed FROM {{customer}}"""


@query("string_list", f"""SELECT id, array_to_string(list_filter(list_transform(string_split(listed, ','),
  lambda x: {D_STRIP % 'trim(x)'}), lambda x: x <> ''), '|') AS items FROM ({LISTS})""")
def string_list(t):
    return t.derive(LISTS).select("id", F.array_join(text.string_list(F.array("listed")), "|").alias("items"))


# One call per order: source and ref forms, packages, both quotes, and texts that are no call.
CALLS = f"""
SELECT o_orderkey AS id, CASE o_orderkey % 6
  WHEN 0 THEN concat('ref(', {Q1}, 'm_', CAST(o_custkey AS VARCHAR(9)), {Q1}, ')')
  WHEN 1 THEN concat({NL}, '  ref( ', {Q2}, 'pkg', {Q2}, ' , ', {Q2}, 'm_', o_orderstatus, {Q2}, ' )  ')
  WHEN 2 THEN concat('source(', {Q1}, ' raw ', {Q1}, ', ', {Q1}, 't', CAST(o_custkey AS VARCHAR(9)), {Q1}, ')')
  WHEN 3 THEN concat('source(', {Q1}, 'only', {Q1}, ') or ref(', {Q1}, 'fall', {Q1}, ')')
  WHEN 4 THEN 'analytics.orders' ELSE 'ref(orders)' END AS call_text FROM {{orders}}"""
D_ARG = "trim(regexp_extract_all(regexp_extract(call_text, '%s\\s*\\(([^)]*)\\)', 1), '[''\"]([^''\"]*)[''\"]', 1)[%d])"
D_S1, D_S2 = D_ARG % ("source", 1), D_ARG % ("source", 2)
D_R1, D_R2 = D_ARG % ("ref", 1), D_ARG % ("ref", 2)
D_CALL = f"""SELECT id, CASE WHEN s2 IS NOT NULL THEN 'source' WHEN r1 IS NOT NULL THEN 'ref' END AS kind,
  CASE WHEN s2 IS NOT NULL THEN s1 WHEN r1 IS NOT NULL THEN '' END AS source_name,
  CASE WHEN s2 IS NOT NULL THEN '' WHEN r2 IS NOT NULL THEN r1 WHEN r1 IS NOT NULL THEN '' END AS package,
  CASE WHEN s2 IS NOT NULL THEN s2 WHEN r2 IS NOT NULL THEN r2 ELSE r1 END AS name
FROM (SELECT id, {D_S1} AS s1, {D_S2} AS s2, {D_R1} AS r1, {D_R2} AS r2 FROM ({CALLS}))"""


@query("parse_call", D_CALL)
def parse_call(t):
    return t.derive(CALLS).select("id", text.parse_call("call_text").alias("c")).select(
        "id", "c.kind", "c.source_name", "c.package", "c.name")


@query("call_label", f"""SELECT id, CASE WHEN kind = 'source' THEN source_name || '.' || name
  ELSE coalesce(name, '') END AS label FROM ({D_CALL})""")
def call_label(t):
    return t.derive(CALLS).select("id", text.call_label(text.parse_call("call_text")).alias("label"))


TARGETS = """
SELECT o_orderkey AS id, concat(
  CASE o_orderkey % 3 WHEN 0 THEN 'REFERENCES ' WHEN 1 THEN 'foreign key references ' ELSE '' END,
  CASE o_custkey % 2 WHEN 0 THEN 'Sales.Orders_' ELSE 'customers_' END, o_orderstatus,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' (id)' ELSE '(a, b )' END,
  CASE o_custkey % 3 WHEN 0 THEN ' ON DELETE cascade' WHEN 1 THEN ' not deferrable' ELSE '' END) AS target
FROM {orders}"""


@query("constraint_target", f"""
SELECT id, string_split(relation, '.')[-1] AS leaf, lower(relation) AS relation_key, replace(cols, ' ', '') AS columns
FROM (SELECT id, regexp_extract(target, '((Sales\\.Orders|customers)_[A-Z])', 1) AS relation,
        regexp_extract(target, '\\(([^)]*)\\)', 1) AS cols FROM ({TARGETS}))""")
def constraint_target(t):
    return t.derive(TARGETS).select("id", text.constraint_target("target").alias("c")).select(
        "id", "c.leaf", F.col("c.relation").alias("relation_key"), F.array_join("c.columns", ",").alias("columns"))


PHYSICAL = f"""
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'source' ELSE 'model' END AS kind,
  CASE WHEN c_custkey % 3 = 0 THEN concat('alias_', c_mktsegment) ELSE ' ' END AS alias,
  CASE WHEN c_custkey % 5 = 0 THEN concat({Q2}, 'ident', {Q2}) END AS identifier,
  CASE WHEN c_nationkey % 2 = 0 THEN concat({Q2}, 'db', {Q2}, '.', {Q2}, 'rel_', c_mktsegment, {Q2}) ELSE '' END
    AS relation_name,
  CASE WHEN c_nationkey % 3 = 0 THEN c_name END AS name, concat('model.p.', c_name) AS unique_id,
  CASE WHEN c_custkey % 8 = 0 THEN 'raw' ELSE '' END AS source_name FROM {{customer}}"""
D_REL_TAIL = "CASE WHEN relation_name = '' THEN '' ELSE replace(string_split(relation_name, '.')[-1], '\"', '') END"


@query("physical_name", f"""SELECT id, CASE WHEN kind = 'source'
  THEN {d_first('identifier', D_REL_TAIL, 'name', "string_split(unique_id, '.')[-1]")}
  ELSE {d_first('alias', 'identifier', D_REL_TAIL, 'name', "string_split(unique_id, '.')[-1]")} END AS physical
FROM ({PHYSICAL})""")
def physical_name(t):
    return t.derive(PHYSICAL).select("id", text.physical_name(
        "kind", "alias", "identifier", "relation_name", "name", "unique_id").alias("physical"))


@query("entry_base_name", f"""SELECT id, CASE WHEN kind = 'source' AND source_name <> ''
  THEN concat(source_name, '.', {d_first('name')}) ELSE {d_first('name')} END AS base_name FROM ({PHYSICAL})""")
def entry_base_name(t):
    return t.derive(PHYSICAL).select("id", text.entry_base_name("kind", "source_name", "name").alias("base_name"))


TYPED = """SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN 'VARCHAR (255)' WHEN 1 THEN 'Numeric(12, 2)'
  WHEN 2 THEN 'TIMESTAMP_NTZ' WHEN 3 THEN '' WHEN 4 THEN '2D Point' WHEN 5 THEN concat('ENUM( a,', p_type, ' )')
  WHEN 6 THEN 'tinyint(1)' ELSE p_type END AS label, concat(p_name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END)
  AS name, p_size AS size FROM {part}"""


@query("pretty_type", f"""SELECT id, CASE WHEN regexp_matches(label, '^[a-zA-Z_]') THEN
  concat(lower(regexp_extract(label, '^([a-zA-Z_]+)', 1)),
         regexp_replace(regexp_replace(label, '^[a-zA-Z_]+', ''), '\\s+', '', 'g')) ELSE lower(label) END AS pretty
FROM ({TYPED})""")
def pretty_type(t):
    return t.derive(TYPED).select("id", text.pretty_type("label").alias("pretty"))


CAMEL = "SELECT p_partkey AS id, concat(p_type, 'OrderItem', p_brand, 'URLPath2Http') AS class_name FROM {part}"


@query("snake_case", f"""SELECT id, lower(regexp_replace(class_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake
FROM ({CAMEL})""")
def snake_case(t):
    return t.derive(CAMEL).select("id", text.snake_case("class_name").alias("snake"))


@query("hash_bucket", """
SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(
  range(1, length(c_name) + 1), lambda i: CAST(ord(substr(c_name, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda h, x: (h * 31 + x) % 4294967296) % 10 AS BIGINT) AS bucket FROM {customer}""")
def hash_bucket(t):
    return t.customer.select("c_custkey", scores.hash_bucket("c_name").alias("bucket"))


EXPORTED = f"""SELECT id, label, CASE WHEN size % 3 = 0 THEN concat('we ', {Q2}, name) WHEN size % 3 = 1
  THEN concat('t_', CAST(size AS VARCHAR(9))) ELSE name END AS name FROM ({TYPED})"""
D_QUOTE = "concat(chr(34), replace(name, chr(34), ''), chr(34))"


@query("export_names", f"""SELECT id,
  CASE WHEN regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_]*$') THEN name ELSE {D_QUOTE} END AS mermaid_name,
  CASE WHEN regexp_replace(regexp_replace(label, '\\s+', '_', 'g'), '[^a-zA-Z0-9_(),]', '', 'g') = '' THEN 'unknown'
    ELSE regexp_replace(regexp_replace(label, '\\s+', '_', 'g'), '[^a-zA-Z0-9_(),]', '', 'g') END AS mermaid_type,
  CASE WHEN label = '' THEN 'unknown' WHEN regexp_matches(label, '^[a-zA-Z0-9_()]+$') THEN label
    ELSE concat(chr(34), label, chr(34)) END AS dbml_type, {D_QUOTE} AS quoted FROM ({EXPORTED})""")
def export_names(t):
    return t.derive(EXPORTED).select(
        "id", text.mermaid_name("name").alias("mermaid_name"), text.mermaid_type("label").alias("mermaid_type"),
        text.dbml_type("label").alias("dbml_type"), text.quote("name").alias("quoted"))


@query("json_script_escape", """SELECT page_id, md5(replace(html, '<', concat(chr(92), 'u003c'))) AS escaped_md5
FROM {pages}""")
def json_script_escape(t):
    return t.pages.select("page_id", F.md5(text.json_script_escape("html")).alias("escaped_md5"))


WORDS = """SELECT o_orderkey AS id, concat(CASE o_orderkey % 4 WHEN 0 THEN 'boxes' WHEN 1 THEN 'orders'
  WHEN 2 THEN 'news_item' ELSE 'address' END, o_orderstatus) AS upper_name, concat(
  CASE o_custkey % 4 WHEN 0 THEN 'Customer_Id' WHEN 1 THEN 'orderid' WHEN 2 THEN 'id' ELSE 'paid' END) AS col_name,
  CASE o_orderkey % 3 WHEN 0 THEN 'boxes' WHEN 1 THEN 'orders' ELSE 'staff' END AS table_key FROM {orders}"""


@query("singular_key", f"""SELECT id, CASE WHEN table_key LIKE '%es' THEN left(table_key, length(table_key) - 2)
  WHEN table_key LIKE '%s' THEN left(table_key, length(table_key) - 1) ELSE table_key END AS singular FROM ({WORDS})""")
def singular_key(t):
    return t.derive(WORDS).select("id", text.singular_key("table_key").alias("singular"))


@query("fk_stem", f"""SELECT id, CASE WHEN length(col_name) > 2 AND lower(right(col_name, 2)) = 'id'
  THEN CASE WHEN length(col_name) > 3 AND substr(col_name, length(col_name) - 2, 1) = '_'
       THEN lower(left(col_name, length(col_name) - 3)) ELSE lower(left(col_name, length(col_name) - 2)) END
  ELSE '' END AS stem FROM ({WORDS})""")
def fk_stem(t):
    return t.derive(WORDS).select("id", text.fk_stem("col_name").alias("stem"))


# Predicates -----------------------------------------------------------------------------------------

NODES = """
SELECT event_id AS id, CASE user_id % 6 WHEN 0 THEN 'model' WHEN 1 THEN 'seed' WHEN 2 THEN 'snapshot'
    WHEN 3 THEN 'test' WHEN 4 THEN 'source' ELSE ' model ' END AS resource_type,
  CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN true END AS enabled,
  CASE event_id % 7 WHEN 0 THEN false WHEN 1 THEN true END AS config_enabled,
  CASE event_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN '' ELSE NULL END AS materialized,
  CASE event_id % 4 WHEN 0 THEN 'Ephemeral' WHEN 1 THEN 'view' ELSE NULL END AS config_materialized
FROM {events}"""
D_OFF = "(coalesce(NOT enabled, false) OR coalesce(NOT config_enabled, false))"
D_EPH = "(coalesce(nullif(materialized, ''), config_materialized, '') = 'Ephemeral')"


@query("is_table_resource", f"""SELECT id, trim(resource_type) IN ('model', 'seed', 'snapshot') AS is_table
FROM ({NODES})""")
def is_table_resource(t):
    return t.derive(NODES).select("id", predicates.is_table_resource("resource_type").alias("is_table"))


@query("is_disabled", f"SELECT id, {D_OFF} AS disabled FROM ({NODES})")
def is_disabled(t):
    return t.derive(NODES).select("id", predicates.is_disabled("enabled", "config_enabled").alias("disabled"))


@query("is_ephemeral", f"SELECT id, {D_EPH} AS ephemeral FROM ({NODES})")
def is_ephemeral(t):
    return t.derive(NODES).select(
        "id", predicates.is_ephemeral("materialized", "config_materialized").alias("ephemeral"))


@query("is_skipped", f"""SELECT id, {D_OFF} OR (resource_type <> 'source' AND {D_EPH}) AS skipped FROM ({NODES})""")
def is_skipped(t):
    return t.derive(NODES).select("id", predicates.is_skipped(
        "resource_type", "enabled", "config_enabled", "materialized", "config_materialized").alias("skipped"))


@query("fuzzy_match", """SELECT p_partkey, lower(p_name) LIKE '%ed%' OR lower(p_name) LIKE '%e%d%' AS matched,
  lower(p_name) LIKE '%r%n%g%' AS in_order FROM {part}""")
def fuzzy_match(t):
    return t.part.select("p_partkey", predicates.fuzzy_match("ED", "p_name").alias("matched"),
                         predicates.fuzzy_match("rng", "p_name").alias("in_order"))


REPOS = """SELECT o_orderkey AS id, concat(CASE o_orderkey % 4 WHEN 0 THEN 'acme' WHEN 1 THEN '-x.y' WHEN 2 THEN 'a b'
  ELSE '' END, CASE o_custkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '//' ELSE '-' END, o_orderpriority) AS repo,
  concat(CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN '/' WHEN 3 THEN ' ' ELSE 'v' END,
  CASE o_custkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'feature/x-1' WHEN 2 THEN 'a b' ELSE 'rel~1' END) AS branch
  FROM {orders}"""


@query("valid_repo_name", f"SELECT id, regexp_full_match(repo, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') AS valid FROM ({REPOS})")
def valid_repo_name(t):
    return t.derive(REPOS).select("id", predicates.valid_repo_name("repo").alias("valid"))


@query("valid_branch", f"""SELECT id, trim(branch) <> '' AND left(trim(branch), 1) NOT IN ('-', '/')
  AND NOT regexp_matches(trim(branch), '[\\s~^:?*\\[\\\\]') AS valid FROM ({REPOS})""")
def valid_branch(t):
    return t.derive(REPOS).select("id", predicates.valid_branch("branch").alias("valid"))


# Scores ---------------------------------------------------------------------------------------------

D_FUZZY = """CASE WHEN position('rng' IN n) > 0 THEN 1001 - position('rng' IN n)
  WHEN p3 > 0 THEN 1 + CASE WHEN p2 = p1 + 1 THEN 6 ELSE 1 END + CASE WHEN p3 = p2 + 1 THEN 6 ELSE 1 END ELSE -1 END"""
# Greedy places of r, n and g in the text n; 0 when there is none.
D_PLACES = """SELECT *, CASE WHEN p2 > 0 AND position('g' IN substr(n, p2 + 1)) > 0
    THEN p2 + position('g' IN substr(n, p2 + 1)) ELSE 0 END AS p3
  FROM (SELECT *, CASE WHEN p1 > 0 AND position('n' IN substr(n, p1 + 1)) > 0
    THEN p1 + position('n' IN substr(n, p1 + 1)) ELSE 0 END AS p2
  FROM (SELECT *, position('r' IN n) AS p1 FROM (%s)))"""


@query("fuzzy_score", f"""SELECT p_partkey, CAST({D_FUZZY} AS BIGINT) AS score
FROM ({D_PLACES % "SELECT p_partkey, lower(p_name) AS n FROM {part}"})""")
def fuzzy_score(t):
    return t.part.select("p_partkey", scores.fuzzy_score("rng", "p_name").alias("score"))


# Arrays, maps and JSON ------------------------------------------------------------------------------

# A literal brace would read as a table mark in the Spark input, so the JSON is put together with chr().
KWARGS = """SELECT event_id AS id, event_type, user_id % 3 AS form, props, CASE user_id % 3
  WHEN 0 THEN concat(chr(123), '"column_name":"a","arguments":', chr(123), '"column_name":"', event_type,
                     '","field":"f"', chr(125), chr(125))
  WHEN 1 THEN concat(chr(123), '"column_name":"', event_type, '"', chr(125)) ELSE props END AS kwargs FROM {events}"""


@query("merge_test_args", f"""SELECT id, CASE WHEN form < 2 THEN event_type END AS column_name,
  CASE WHEN form = 0 THEN 'f' END AS field, CASE WHEN form = 2 THEN regexp_extract(props, '([0-9]+)', 1) END AS k
FROM ({KWARGS})""")
def merge_test_args(t):
    rows = t.derive(KWARGS)
    return rows.select("id", *[arrays.merge_test_args("kwargs", k).alias(k) for k in ("column_name", "field", "k")])


ITEMS = """SELECT event_id AS id, event_type, user_id % 3 AS form, CASE user_id % 3 WHEN 0 THEN event_type
  WHEN 1 THEN concat('pkg.', event_type) ELSE concat(chr(123), '"pkg.', event_type, '":', props, chr(125)) END AS item,
  props FROM {events}"""


@query("parse_yaml_test", f"""SELECT id, event_type AS name,
  CASE WHEN form = 2 THEN replace(props, ' ', '') ELSE concat(chr(123), chr(125)) END AS args FROM ({ITEMS})""")
def parse_yaml_test(t):
    return t.derive(ITEMS).select("id", arrays.parse_yaml_test("item").alias("p")).select(
        "id", "p.name", F.replace("p.args", F.lit(" "), F.lit("")).alias("args"))


@query("as_array", """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE 1 END AS n,
  CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_name END AS first FROM {customer}""")
def as_array(t):
    value = F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name"))
    return t.customer.select("c_custkey", arrays.as_array(value).alias("a")).select(
        "c_custkey", F.size("a").alias("n"), arrays.first_column("a").alias("first"))


COLLISTS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'own' ELSE '' END AS owner,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('["a_', o_orderstatus, '","b"]') END AS columns,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('x,', o_orderstatus) END AS column_names,
  CASE WHEN o_orderkey % 7 = 0 THEN 'single' END AS column_name, o_orderstatus AS col FROM {orders}"""


@query("constraint_columns", f"""SELECT id, CASE WHEN owner <> '' THEN owner
  WHEN columns IS NOT NULL THEN concat('a_', col, ',b') WHEN column_names IS NOT NULL THEN concat('x,', col)
  WHEN column_name IS NOT NULL THEN 'single' ELSE col END AS names FROM ({COLLISTS})""")
def constraint_columns(t):
    return t.derive(COLLISTS).select("id", F.array_join(arrays.constraint_columns(
        "owner", "columns", "column_names", "column_name", "col"), ",").alias("names"))


@query("first_columns", f"""SELECT id, CASE WHEN columns IS NULL THEN '' ELSE concat('a_', col) END AS first
FROM ({COLLISTS})""")
def first_columns(t):
    return t.derive(COLLISTS).select("id", arrays.first_column(
        F.from_json("columns", "array<string>")).alias("first"))


@query("columns_from_map", """
SELECT c_custkey, CAST(0 AS BIGINT) AS pos, lower(c_mktsegment) AS name, 'int' AS type FROM {customer}
UNION ALL SELECT c_custkey, 1, c_name, CASE WHEN c_nationkey % 2 = 0 THEN 'text' ELSE '' END FROM {customer}""")
def columns_from_map(t):
    def column(name, data_type, other):
        return F.struct(name.alias("name"), data_type.alias("data_type"), other.alias("type"),
                        F.lit(None).cast("string").alias("dtype"))

    blank, none = F.lit(" "), F.lit(None).cast("string")
    as_map = F.create_map(
        F.lower("c_mktsegment"), column(none, blank, F.lit("int")),
        F.lit("key"), column(F.col("c_name"), F.when(F.col("c_nationkey") % 2 == 0, "text"), none))
    return t.customer.select("c_custkey", F.explode(arrays.columns_from_map(as_map)).alias("c")).select(
        "c_custkey", "c.pos", "c.name", "c.type")


LABELS = """SELECT p_partkey AS id, CASE p_size % 12 WHEN 0 THEN 'integer' WHEN 1 THEN 'BIGSERIAL' WHEN 2 THEN 'tinyint(1)'
  WHEN 3 THEN 'tinyint' WHEN 4 THEN 'numeric(12,2)' WHEN 5 THEN 'NUMBER' WHEN 6 THEN 'double precision'
  WHEN 7 THEN 'nvarchar(max)' WHEN 8 THEN 'TIMESTAMP_TZ' WHEN 9 THEN 'datetime2' WHEN 10 THEN 'jsonb'
  ELSE p_type END AS label, p_size % 12 AS form FROM {part}"""


@query("map_sql_type", f"""SELECT id, CASE form WHEN 0 THEN 'int' WHEN 1 THEN 'bigint' WHEN 2 THEN 'boolean'
  WHEN 3 THEN 'tinyint' WHEN 4 THEN 'decimal(12,2)' WHEN 5 THEN 'decimal(38,0)' WHEN 6 THEN 'double'
  WHEN 7 THEN 'string' WHEN 8 THEN 'timestamp' WHEN 9 THEN 'timestamp_ntz' WHEN 10 THEN 'variant' END AS spark_type
FROM ({LABELS})""")
def map_sql_type(t):
    return t.derive(LABELS).select("id", types.map_sql_type("label").alias("spark_type"))
