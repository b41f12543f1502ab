"""Script mining on hand-written scripts."""

from schemaloom.operators import mining as m
from schemaloom.plans.scripts import mine_ddl, mine_scripts

DEEP = "(" * 30 + "x;y,z" + ")" * 30

SCRIPT = f"""
-- users; the first table
CREATE TABLE users (
  id BIGINT PRIMARY KEY,
  "Mail" VARCHAR(255) NOT NULL UNIQUE DEFAULT 'a;b,(',   # note; here
  score double precision CHECK {DEEP},
  kind ENUM('a,b', 'c''d')
);
/* block ; with
   lines */
CREATE OR REPLACE TEMP TABLE IF NOT EXISTS shop.[orders] (
  id int, user_id bigint references users (id), code numeric (10, 2) not null,
  PRIMARY KEY (id, code), UNIQUE (user_id, code),
  CONSTRAINT u UNIQUE (id), INDEX i (code),
  CONSTRAINT f FOREIGN KEY (code, id) REFERENCES missing(a, `b`)
);
create table Users (extra text, PRIMARY KEY (id));
ALTER TABLE ONLY public.orders ADD CONSTRAINT z FOREIGN KEY (user_id) REFERENCES users;
ALTER TABLE nowhere ADD FOREIGN KEY (a) REFERENCES users (id);
CREATE TABLE broken (a int, b text;
"""


def mined(spark, *scripts):
    return mine_ddl(spark.createDataFrame(list(enumerate(scripts)), "script_id int, text string"), ["script_id"])


def test_ddl_script(spark):
    got = mined(spark, SCRIPT)
    assert {(r["table_key"], r["name"]) for r in got.tables.collect()} == {("users", "users"), ("orders", "orders")}
    cols = {(r["table_key"], r["name"]): (r["type"], r["pk"], r["nn"], r["uniq"], r["fk"]) for r in got.columns.collect()}
    assert cols == {
        ("users", "id"): ("bigint", True, False, False, False),
        ("users", "Mail"): ("varchar(255)", False, True, True, False),
        ("users", "score"): ("double", False, False, False, False),
        ("users", "kind"): ("enum('a,b','c''d')", False, False, False, False),
        ("orders", "id"): ("int", True, False, False, True),
        ("orders", "user_id"): ("bigint", False, False, True, True),
        ("orders", "code"): ("numeric(10,2)", True, True, True, True),
        ("users", "extra"): ("text", False, False, False, False)}
    rels = [(r["from_table"], tuple(r["from_cols"]), r["to_table"], tuple(r["to_cols"]), r["to_missing"])
            for r in got.relations.orderBy("at").collect()]
    assert rels == [("orders", ("user_id",), "users", ("id",), False), ("orders", ("code", "id"), "missing", ("a", "b"), True),
                    ("orders", ("user_id",), "users", (), False)]
    assert {(r["name"], r["error"]) for r in got.errors.collect()} == {("broken", "unbalanced parentheses")}


def test_pattern_and_fold_agree(spark):
    """Text the pattern can follow is split the same way by the fold over its tokens."""
    texts = ["a;b(c;d(e;f));'g;h';i", ";;x", "a(b)c(d;(e));f", "`q;(`;\"z;\"", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("tok", m._tokens(m.F.col("t"), "();"))
    rows = df.select("i", m.F.regexp_extract_all("t", m.F.lit(m._piece(";")), m.F.lit(0)).alias("p"), m._split(m.F.col("tok"), ";").alias("f")).collect()
    for r in rows:
        assert r["p"] == [x for x in r["f"] if x]


def test_unbalanced_scripts_keep_their_rest(spark):
    df = spark.createDataFrame([(0, "select f(1; create table t (a int);"), (1, "x); create table t (a int); y")], "script_id int, text string")
    got = {(r["script_id"], r["sql"].strip()) for r in m.ddl_statements(df, ["script_id"]).collect()}
    # an open bracket swallows what follows; a stray closing one keeps later separators inside
    assert got == {(0, "select f(1; create table t (a int);"), (1, "x); create table t (a int); y")}


def test_many_statements_and_columns(spark):
    script = "".join(f"create table t{i} (" + ", ".join(f"c{j} int" for j in range(40)) + ");\n" for i in range(300))
    got = mined(spark, script)
    assert got.tables.count() == 300 and got.columns.count() == 12000


def test_cte_chain(spark):
    sql = """-- with nothing
    WITH a AS (SELECT id, sum(x) total, t.`Name` FROM `p.d.Orders` t, UNNEST(items) CROSS JOIN unnest(z)),
    b (k) AS (SELECT *, 1 + 2, 'x, from q' AS "Lit" FROM a JOIN raw.Events USING (id)),
    c AS (SELECT [1, 2][0], f(a, b) AS g FROM b JOIN a ON true JOIN c ON true)
    SELECT * FROM c"""
    df = spark.createDataFrame([(0, sql), (1, "select 1 from x"), (2, "with recursive r as (select 1) select 2")], "script_id int, text string")
    bodies = m.cte_bodies(df, ["script_id"])
    assert [r["name"] for r in bodies.orderBy("cte_no").collect()] == ["a", "b", "c"]
    assert {(r["from_table"], r["to_table"], r["to_base"]) for r in m.cte_edges(bodies, ["script_id"]).collect()} == {
        ("a", "Orders", True), ("b", "a", False), ("b", "events", True), ("c", "b", False), ("c", "a", False), ("b", "q", True)}
    # a select list ends at the first FROM, quoted or not
    cols = {}
    for r in m.cte_columns(bodies, ["script_id"]).orderBy("cte_no", "col_no").collect():
        cols.setdefault(r["cte"], []).append(r["name"])
    assert cols == {"a": ["id", "total", "Name"], "b": ["2", "col2"], "c": ["col1", "g"]}


def test_type_arguments_of_any_depth(spark):
    deep = "(" * 40 + "5" + ")" * 40
    got = mined(spark, f"create table t (a numeric{deep} not null, b numeric(((((5))))) , c decimal (10, (2)) unique, d text);")
    assert {r["name"]: (r["type"], r["nn"], r["uniq"]) for r in got.columns.collect()} == {
        "a": (f"numeric{deep}", True, False), "b": ("numeric(((((5)))))", False, False), "c": ("decimal(10,(2))", False, True), "d": ("text", False, False)}
    assert got.errors.isEmpty()


def test_select_lists_by_pattern_and_fold(spark):
    """Lists the pattern can follow are cut the same way by the fold."""
    texts = ["a, f(b, c[1, 2]) as d, [x, (y, z)]", "'q, r', `s, t`, u[(1, 2), 3]", "a", "f((g([1, 2], h(3))), 4), b", "a,, b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("tok", m._tokens(m.F.col("t"), "()[],"))
    for r in df.select(m.F.col("t").rlike(m._ANY_BALANCED).alias("ok"), m.F.regexp_extract_all("t", m.F.lit(m._ANY_PIECE), m.F.lit(0)).alias("p"),
                       m._split(m.F.col("tok"), ",", "()[]").alias("f")).collect():
        assert r["ok"] and r["p"] == [x for x in r["f"] if x]
    deep = "[" * 30 + "1, 2" + "]" * 30
    bodies = m.cte_bodies(spark.createDataFrame([(0, f"with a as (select x, {deep} as y, f(1, 2) from t)")], "script_id int, text string"), ["script_id"])
    assert [r["name"] for r in m.cte_columns(bodies, ["script_id"]).orderBy("col_no").collect()] == ["x", "y", "col3"]


def test_mixed_corpus(spark):
    scripts = spark.createDataFrame([
        (0, "create table a (x int); create table b (y int references a (x));", None), (1, "with q as (select z from `p.d.T`) select 1", None),
        (2, "erDiagram", None), (3, "select 1", None), (4, "", None), (5, None, None), (6, "create table open (a int", None),
        (7, "with q as (select z from T)", "BigQuery "), (8, "create table c (x int)", "dbml")], "k int, body string, kind string")
    got = mine_scripts(scripts, ["k"], "body", "kind")
    assert sorted((r["k"], r["name"]) for r in got.tables.collect()) == [(0, "a"), (0, "b"), (1, "T"), (1, "q"), (7, "q"), (7, "t")]
    assert sorted((r["k"], r["table_name"], r["name"]) for r in got.columns.collect()) == [(0, "a", "x"), (0, "b", "y"), (1, "q", "z"), (7, "q", "z")]
    assert sorted((r["k"], r["from_table"], r["to_table"]) for r in got.relations.collect()) == [(0, "b", "a"), (1, "q", "T"), (7, "q", "t")]
    assert sorted((r["k"], r["error"]) for r in got.errors.collect()) == [
        (2, "format is not read"), (3, "no tables found"), (4, "no tables found"), (5, "no tables found"), (6, "open: unbalanced parentheses"), (8, "format is not read")]


def test_formats(spark):
    samples = {
        "mermaid": "x\n  erDiagram\n", "plantuml": "@startuml", "dbml": "Table users {", "prisma": "model User {",
        "sequelize": "s.define('u', {", "sqlalchemy": "class A(Base):\n  id = Column(Integer)",
        "bigquery": "WITH a AS (select 1 from `p.d.t`)", "sql": "create table t (a int)"}
    df = spark.createDataFrame(list(samples.items()), "want string, text string")
    for r in df.withColumn("got", m.classify_format("text")).collect():
        assert r["got"] == r["want"]


def test_key_lists_with_nested_brackets(spark):
    deep = "(" * 20 + "a" + ")" * 20
    got = mined(spark, "create table k (a text, b int, c int, primary key (lower(trim(coalesce(a))), b));",
                "create table k (a text, b int, c int, unique (f(a, c)));",
                f"create table k (a text, b int, c int, primary key (g{deep}, b));")
    rows = {(r["script_id"], r["name"]): (r["pk"], r["uniq"]) for r in got.columns.collect()}
    assert {k for k, (pk, _) in rows.items() if pk} == {(0, "b"), (2, "b")}
    assert not any(uniq for _, uniq in rows.values())
    assert got.errors.isEmpty()


def test_columns_and_keys_meet_in_one_exchange(spark):
    """Text is searched once where conditions name it again, and tables are dealt out once for columns, keys and edges."""
    items = mined(spark, SCRIPT).items
    for found in (m.ddl_columns(items, ["script_id"]), m.ddl_keys(items, ["script_id"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    bodies = m.ddl_bodies(m.ddl_statements(spark.createDataFrame([(0, SCRIPT)], "script_id int, text string"), ["script_id"]), ["script_id"])
    assert bodies._jdf.queryExecution().optimizedPlan().toString().count("create\\s+") == 1


def test_keys_of_repeated_and_missing_ids(spark):
    """Columns of scripts without id stay without key flags; scripts given twice keep each row."""
    text = "create table t (a int, b int, primary key (a), a int, unique (a, nowhere));"
    scripts = spark.createDataFrame([(None, text), (1, text), (1, text)], "script_id int, text string")
    got = mine_ddl(scripts, ["script_id"])
    rows = sorted((str(r["script_id"]), r["at"] % (1 << 31), r["name"], r["pk"], r["uniq"]) for r in got.columns.collect())
    one = [(0, "a", True, False), (1, "b", False, False), (3, "a", False, True)]
    assert rows == sorted([("1", *r) for r in one] * 2 + [("None", k, n, False, False) for k, n, _, _ in one])


def test_formats_need_their_literals():
    import re

    assert set(m.LITERALS) <= {p for _, patterns in m.FORMAT_RULES for p in patterns}
    samples = ["erDiagram", "@startuml", "entity A", 'class "A', "Table t {", "Ref x:", "model U {", "datasource d {", "generator g {", ".define ( 'x",
               "DataTypes.", "Column (", "mapped_column(", "`a.b`"]
    for pattern, parts in m.LITERALS.items():
        hits = [x for x in samples if re.search(pattern, x)]
        assert hits and all(any(p in x for p in parts) for x in hits)
