"""Script mining and text exports, on scripts and models written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import export as ex
from ...operators import mining as m
from ..registry import query
from ..scripts import mine_ddl, mine_scripts

# One DDL script per order. Comments, quoted separators, nested types, late keys and an ALTER; every
# seventh script has a table that never closes.
K = "CAST(o_orderkey AS VARCHAR(12))"
DDL = f"""SELECT o_orderkey AS script_id, concat(
 '-- header; not a statement', chr(10), 'CREATE TABLE ', chr(34), 'Cust_', CAST(o_custkey AS VARCHAR(12)), chr(34), ' (', chr(10),
 '  id BIGINT PRIMARY KEY, /* a, b; */ email VARCHAR (255) NOT NULL UNIQUE DEFAULT ', chr(39), 'a;b,(c', chr(39), ',', chr(10),
 '  kind ENUM(', chr(39), 'x,y', chr(39), ', ', chr(39), 'z', chr(39), '), price Numeric(10, 2) CHECK (price > f(g(1), h(2))),', chr(10),
 '  KEY k_email (email)', chr(10), ');', chr(10),
 'create table if not exists shop.ord_', {K}, ' (id int, cust_id bigint NOT NULL REFERENCES Cust_', CAST(o_custkey AS VARCHAR(12)), '(id), code text,',
 ' PRIMARY KEY (id, ', chr(96), 'code', chr(96), '), UNIQUE (cust_id), CONSTRAINT fk FOREIGN KEY (code) REFERENCES ref_', o_orderstatus, ' (c1)) # tail', chr(10), ';',
 'ALTER TABLE ONLY shop.ord_', {K}, ' ADD CONSTRAINT a FOREIGN KEY (id, code) REFERENCES other.Ledger (x, y);',
 CASE WHEN o_orderkey % 7 = 0 THEN 'create temp table broken (a int, b int; select 1' ELSE 'select 1 from t' END) AS text,
 o_custkey, o_orderstatus FROM {{orders}}"""
IDS = ["script_id"]


def _statements(t):
    return m.ddl_statements(t.derive(DDL).select("script_id", "text"), IDS)


def _mined(t):
    return mine_ddl(t.derive(DDL), IDS)


@query("classify_format", """SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'mermaid' WHEN page_id % 8 = 1 THEN 'plantuml' WHEN page_id % 8 = 2 THEN 'dbml'
  WHEN page_id % 8 = 3 THEN 'prisma' WHEN page_id % 8 = 4 THEN 'sequelize' WHEN page_id % 8 = 5 THEN 'sqlalchemy' WHEN page_id % 8 = 6 THEN 'bigquery'
  ELSE 'sql' END AS format FROM {pages}""")
def classify_format(t):
    brace = "chr(123)"
    text = f"""SELECT page_id, concat(CASE page_id % 8 WHEN 0 THEN concat('x', chr(10), '  erDiagram', chr(10)) WHEN 1 THEN 'entity A' WHEN 2 THEN concat('Table t ', {brace})
      WHEN 3 THEN concat('model User ', {brace}) WHEN 4 THEN 'DataTypes.X; a.init (' WHEN 5 THEN 'class A(Base): x = Column (' WHEN 6 THEN
      concat('With a as (select 1 from ', chr(96), 'p.d.t', chr(96), ')') ELSE 'create table x (a int)' END, chr(10), replace(url, '/', ' '),
      CASE WHEN page_id % 8 = 1 THEN ' a ||-- b' ELSE '' END) AS text FROM {{pages}}"""
    return t.derive(text).select("page_id", m.classify_format("text").alias("format"))


@query("ddl_statements", f"SELECT script_id, unnest([0, 1, 2, 3]) AS stmt FROM ({DDL})")
def ddl_statements(t):
    return _statements(t).select("script_id", F.col("stmt").cast("int").alias("stmt"))


@query("ddl_tables", f"""SELECT script_id, concat('cust_', o_custkey) AS table_key, concat('Cust_', o_custkey) AS name FROM ({DDL})
UNION ALL SELECT script_id, concat('ord_', script_id), concat('ord_', script_id) FROM ({DDL})""")
def ddl_tables(t):
    return _mined(t).tables.select("script_id", "table_key", "name")


@query("ddl_errors", f"SELECT script_id, 'broken' AS name, 'unbalanced parentheses' AS error FROM ({DDL}) WHERE script_id % 7 = 0")
def ddl_errors(t):
    return _mined(t).errors.select("script_id", "name", "error")


_COLUMNS = (
    ("cust", 0, "id", "bigint", 1, 0, 0, 0), ("cust", 1, "email", "varchar(255)", 0, 1, 1, 0),
    ("cust", 2, "kind", "enum(''x,y'',''z'')", 0, 0, 0, 0), ("cust", 3, "price", "numeric(10,2)", 0, 0, 0, 0),
    ("ord", 0, "id", "int", 1, 0, 0, 1), ("ord", 1, "cust_id", "bigint", 0, 1, 1, 1), ("ord", 2, "code", "text", 1, 0, 0, 1))
D_COLUMNS = " UNION ALL ".join(
    f"SELECT script_id, concat('{t}_', {'o_custkey' if t == 'cust' else 'script_id'}) AS table_key, {i} AS item_no, '{n}' AS name, '{y}' AS type, "
    f"{bool(p)} AS pk, {bool(nn)} AS nn, {bool(u)} AS uniq, {bool(fk)} AS fk FROM ({DDL})"
    for t, i, n, y, p, nn, u, fk in _COLUMNS)


@query("ddl_columns", f"SELECT script_id, table_key, item_no, name, type, pk, nn, uniq, fk FROM ({D_COLUMNS})")
def ddl_columns(t):
    return _mined(t).columns.withColumn("item_no", (F.col("at") % (1 << 31)).cast("int")).drop("at")


@query("ddl_keys", f"""SELECT script_id, concat('ord_', script_id) AS table_key, unnest(['id', 'code', 'cust_id']) AS name,
  unnest([true, true, false]) AS key_pk, unnest([false, false, true]) AS key_uniq FROM ({DDL})""")
def ddl_keys(t):
    items = _mined(t).items
    names = m.ddl_columns(items, IDS).select("script_id", "table_key", F.col("at").alias("col_at"), "name")
    return m.ddl_keys(items, IDS).join(names, ["script_id", "table_key", "col_at"]).drop("col_at")


@query("ddl_foreign_keys", f"""
SELECT script_id, concat('ord_', script_id) AS from_table, 'cust_id' AS from_cols, concat('Cust_', o_custkey) AS to_table, 'id' AS to_cols, false AS to_missing FROM ({DDL})
UNION ALL SELECT script_id, concat('ord_', script_id), 'code', concat('ref_', o_orderstatus), 'c1', true FROM ({DDL})
UNION ALL SELECT script_id, concat('ord_', script_id), 'id,code', 'Ledger', 'x,y', true FROM ({DDL})""")
def ddl_foreign_keys(t):
    return _mined(t).relations.select("script_id", "from_table", F.array_join("from_cols", ",").alias("from_cols"), "to_table",
                        F.array_join("to_cols", ",").alias("to_cols"), "to_missing")


# One query script per customer: a chain of CTEs over a quoted base table, a plain one and UNNEST.
CTE = """SELECT c_custkey AS script_id, concat('-- with comment', chr(10), 'WITH Base_A AS (SELECT t.id, max(amount) AS ', chr(96), 'Top', chr(96), ', ',
  'count(*) FROM ', chr(96), 'proj.data.', c_mktsegment, chr(96), ' t JOIN unnest(items) WHERE x IN (select 1 from Plain.Orders)), ',
  'second (p, q) as (select *, a.b + c, ', chr(39), 'x, from y', chr(39), ' AS lit, arr[1, 2] from Base_A a join second on true), ',
  'last_', CAST(c_nationkey AS VARCHAR(9)), ' AS (select * from second left join base_a using (id) join ', chr(96), 'proj.data.', c_mktsegment, chr(96), ' using (id))',
  CASE WHEN c_custkey % 3 = 0 THEN ' select 1 from last' ELSE ', open as (select 1 from x' END) AS text, c_mktsegment, c_nationkey FROM {customer}"""


@query("cte_edges", f"""
SELECT script_id, 'Base_A' AS from_table, c_mktsegment AS to_table, true AS to_base FROM ({CTE})
UNION ALL SELECT script_id, 'Base_A', 'orders', true FROM ({CTE})
UNION ALL SELECT script_id, 'second', 'Base_A', false FROM ({CTE})
UNION ALL SELECT script_id, 'second', 'y', true FROM ({CTE})
UNION ALL SELECT script_id, concat('last_', c_nationkey), 'second', false FROM ({CTE})
UNION ALL SELECT script_id, concat('last_', c_nationkey), 'Base_A', false FROM ({CTE})
UNION ALL SELECT script_id, concat('last_', c_nationkey), c_mktsegment, true FROM ({CTE})""")
def cte_edges(t):
    return m.cte_edges(m.cte_bodies(t.derive(CTE).select("script_id", "text"), IDS), IDS)


@query("cte_bodies", f"""SELECT script_id, unnest(['Base_A', 'second', concat('last_', c_nationkey)]) AS name, true AS closed FROM ({CTE})
UNION ALL SELECT script_id, 'open', false FROM ({CTE}) WHERE script_id % 3 <> 0""")
def cte_bodies(t):
    return m.cte_bodies(t.derive(CTE).select("script_id", "text"), IDS).select("script_id", "name", F.coalesce("closed", F.lit(False)).alias("closed"))


@query("cte_columns", f"""SELECT script_id, unnest(['Base_A', 'Base_A', 'Base_A', 'second', 'second']) AS cte, CAST(unnest([1, 2, 3, 1, 2]) AS BIGINT) AS col_no,
  unnest(['id', 'Top', 'col3', 'c', 'col2']) AS name FROM ({CTE})""")
def cte_columns(t):
    return m.cte_columns(m.cte_bodies(t.derive(CTE).select("script_id", "text"), IDS), IDS).select("script_id", "cte", "col_no", "name")


# A mixed corpus: the DDL scripts, the query scripts, and pages as scripts of whatever format they look like.
MIXED = f"""SELECT concat('d', CAST(script_id AS VARCHAR(12))) AS script_id, text FROM ({DDL}) UNION ALL
SELECT concat('c', CAST(script_id AS VARCHAR(12))), substr(text, 17) FROM ({CTE}) UNION ALL
SELECT concat('p', CAST(page_id AS VARCHAR(12))), concat('graph', chr(10), 'erDiagram ', url) FROM {{pages}}""".replace("{{pages}}", "{pages}")


@query("mine_scripts_tables", f"""
SELECT concat('d', script_id) AS script_id, 'sql' AS format, unnest([concat('Cust_', o_custkey), concat('ord_', script_id)]) AS name FROM ({DDL})
UNION ALL SELECT concat('c', script_id), 'bigquery', unnest(['Base_A', 'second', concat('last_', c_nationkey), c_mktsegment, 'orders', 'y']) FROM ({CTE})""")
def mine_scripts_tables(t):
    return mine_scripts(t.derive(MIXED), IDS).tables


@query("mine_scripts_errors", f"""
SELECT concat('d', script_id) AS script_id, 'sql' AS format, 'broken: unbalanced parentheses' AS error FROM ({DDL}) WHERE script_id % 7 = 0
UNION ALL SELECT concat('c', script_id), 'bigquery', 'open: unbalanced parentheses' FROM ({CTE}) WHERE script_id % 3 <> 0
UNION ALL SELECT concat('p', page_id), 'mermaid', 'format is not read' FROM {{pages}}""")
def mine_scripts_errors(t):
    return mine_scripts(t.derive(MIXED), IDS).errors


def _rule_sql(text: str) -> str:
    rules = " ".join("WHEN " + " AND ".join("regexp_matches(%s, '%s')" % (text, p.replace("'", "''")) for p in patterns) + f" THEN '{name}'"
                     for name, patterns in m.FORMAT_RULES)
    return f"CASE {rules} ELSE 'sql' END"


@query("classify_pages", f"SELECT page_id, {_rule_sql('html')} AS format FROM {{pages}}")
def classify_pages(t):
    """The whole page texts by the same rules."""
    return t.pages.select("page_id", m.classify_format(F.coalesce("html", F.lit(""))).alias("format"))


# Exports --------------------------------------------------------------------------------------------

# A model per nation: its customers are tables, their orders the columns, and orders on the customer's
# number point at the next customer of the nation.
X_TABLES = "SELECT c_nationkey AS project, c_custkey AS t_ord, concat(c_mktsegment, ' ', c_name) AS name FROM {customer}"
X_COLUMNS = """SELECT c_nationkey AS project, c_custkey AS t_ord, o_orderkey AS ord, concat('c_', CAST(o_orderkey AS VARCHAR(12))) AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'numeric(10, 2)' WHEN 1 THEN '' ELSE o_orderstatus END AS type, o_orderkey % 4 = 0 AS pk, o_orderkey % 5 = 0 AS fk,
  o_orderkey % 3 = 0 AS uniq, o_orderkey % 2 = 0 AS nn FROM {orders} JOIN {customer} ON c_custkey = o_custkey"""
X_RELATIONS = """SELECT c_nationkey AS project, c_custkey AS ord, concat(c_mktsegment, ' ', c_name) AS from_table, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('k', chr(34)) END AS from_col,
  concat(c_mktsegment, ' ', c_name) AS to_table, CASE WHEN c_custkey % 2 = 0 THEN 'id' ELSE '' END AS to_col, c_custkey % 5 = 0 AS to_missing FROM {customer}"""


def _export(t, fmt):
    def listed(col):
        return F.filter(F.array(col), lambda c: c != "")

    relations = t.derive(X_RELATIONS).withColumn("from_cols", listed("from_col")).withColumn("to_cols", listed("to_col"))
    return ex.export(fmt, t.derive(X_TABLES), t.derive(X_COLUMNS), relations).select("project", "section", "t_ord", "line")


D_PROJECTS = "SELECT DISTINCT c_nationkey AS project FROM {customer}"
D_TYPE = "CASE WHEN type = '' THEN 'unknown' ELSE replace(type, ' ', '_') END"


def _q(x: str) -> str:
    return f"concat(chr(34), replace({x}, chr(34), ''), chr(34))"


@query("export_mermaid", f"""
SELECT project, 0 AS section, CAST(0 AS BIGINT) AS t_ord, 'erDiagram' AS line FROM ({D_PROJECTS})
UNION ALL SELECT project, 1, t_ord, concat('    ', {_q('name')}, ' ', chr(123)) FROM ({X_TABLES})
UNION ALL SELECT project, 1, t_ord, concat('    ', chr(125)) FROM ({X_TABLES})
UNION ALL SELECT project, 1, t_ord, concat('        ', {D_TYPE}, ' ', name, CASE WHEN pk OR fk OR uniq THEN ' ' ELSE '' END,
  concat_ws(',', CASE WHEN pk THEN 'PK' END, CASE WHEN fk THEN 'FK' END, CASE WHEN uniq AND NOT pk THEN 'UK' END)) FROM ({X_COLUMNS})
UNION ALL SELECT project, 2, ord, concat('    ', {_q('to_table')}, ' ||--o', chr(123), ' ', {_q('from_table')}, ' : ',
  CASE WHEN from_col = '' THEN '"fk"' ELSE concat(chr(34), 'k', chr(92), chr(34), chr(34)) END) FROM ({X_RELATIONS}) WHERE NOT to_missing""")
def export_mermaid(t):
    return _export(t, "mermaid")


@query("export_dbml", f"""
SELECT project, 1 AS section, t_ord, concat('Table ', {_q('name')}, ' ', chr(123)) AS line FROM ({X_TABLES})
UNION ALL SELECT project, 1, t_ord, unnest([chr(125), '']) FROM ({X_TABLES})
UNION ALL SELECT project, 1, t_ord, concat('  ', {_q('name')}, ' ', CASE WHEN type = '' THEN 'unknown' WHEN type LIKE '% %' THEN {_q('type')} ELSE type END,
  CASE WHEN pk OR uniq OR nn THEN concat(' [', concat_ws(', ', CASE WHEN pk THEN 'pk' END, CASE WHEN uniq AND NOT pk THEN 'unique' END,
  CASE WHEN nn AND NOT pk THEN 'not null' END), ']') ELSE '' END) FROM ({X_COLUMNS})
UNION ALL SELECT project, 2, ord, concat('Ref: ', {_q('from_table')}, '.', {_q('from_col')}, ' > ', {_q('to_table')}, '.', {_q('to_col')})
FROM ({X_RELATIONS}) WHERE NOT to_missing AND from_col <> '' AND to_col <> ''""")
def export_dbml(t):
    return _export(t, "dbml")


D_X_ALIAS = "replace(replace(%s, ' ', '_'), '#', '_')"


@query("export_plantuml", f"""
SELECT project, 0 AS section, CAST(0 AS BIGINT) AS t_ord, unnest(['@startuml', 'hide circle', 'skinparam linetype ortho', '']) AS line FROM ({D_PROJECTS})
UNION ALL SELECT project, 1, t_ord, concat('entity ', chr(34), name, chr(34), ' as ', {D_X_ALIAS % 'name'}, ' ', chr(123)) FROM ({X_TABLES})
UNION ALL SELECT project, 1, t_ord, unnest([chr(125), '']) FROM ({X_TABLES})
UNION ALL SELECT project, 1, t_ord, '  --' FROM ({X_COLUMNS}) GROUP BY project, t_ord HAVING bool_or(pk) AND bool_or(NOT pk)
UNION ALL SELECT project, 1, t_ord, CASE WHEN pk THEN concat('  * ', name, ' : ', type, ' <<PK>>')
  ELSE concat('  ', name, ' : ', type, CASE WHEN fk THEN ' <<FK>>' ELSE '' END) END FROM ({X_COLUMNS})
UNION ALL SELECT project, 2, ord, concat({D_X_ALIAS % 'to_table'}, ' ||--o', chr(123), ' ', {D_X_ALIAS % 'from_table'}) FROM ({X_RELATIONS}) WHERE NOT to_missing
UNION ALL SELECT project, 3, 0, '@enduml' FROM ({D_PROJECTS})""")
def export_plantuml(t):
    return _export(t, "plantuml")
