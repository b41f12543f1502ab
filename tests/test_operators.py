"""Operators on small inputs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from schemaloom.functions import keys, predicates, scores, text
from schemaloom.operators import checks, export, graph, grouping, links, resolve, search


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(value):
    return F.lit(value)


def groups(spark, path="", name="", file=None, kind="model", source="", schema=""):
    null = F.lit(file).cast("string")
    return one(spark, keys.build_group_keys(lit(kind), lit(kind), lit(source), lit(name), lit(name), lit(name),
                                            lit(schema), lit(path), null, F.lit(None).cast("string")))


def test_group_keys(spark):
    g = groups(spark, "models/staging/stripe", "stg_orders")
    assert (g["domain"], g["layer"], g["folder"]) == ("orders", "staging", "staging/stripe")
    g = groups(spark, name="dim_x", file="models/marts/dim_x.sql")
    assert (g["layer"], g["folder"]) == ("marts", "marts")
    assert groups(spark, name="stg_acmelab_calibration_x")["domain"] == "acmelab"
    g = groups(spark, name="orders", kind="source", source="Stripe", schema="Analytics")
    assert (g["layer"], g["domain"], g["schema"]) == ("source", "stripe", "analytics")


@pytest.mark.parametrize("value", ["abc", "é漢字", "a😀b", ""])
def test_hash_bucket_counts_utf16_units(spark, value):
    units, h = value.encode("utf-16-le"), 0
    for i in range(0, len(units), 2):
        h = (h * 31 + units[i] + 256 * units[i + 1]) % 2**32
    assert one(spark, scores.hash_bucket(lit(value))) == h % 10


@pytest.mark.parametrize(("query", "value", "want"), [
    ("", "x", 0), ("ware", "acme/warehouse", 995), ("zzz", "acme", -1), ("ac", "xaxc", 2), ("abd", "abxd", 8)])
def test_fuzzy_score(spark, query, value, want):
    assert one(spark, scores.fuzzy_score(query, lit(value))) == want
    assert one(spark, predicates.fuzzy_match(query, lit(value))) == (want >= 0)


def test_fuzzy_rank(spark):
    items = spark.createDataFrame([(0, "acme/orders-api", "order service"), (1, "acme/warehouse", "models"),
                                   (2, "acme/marketing-site", None)], "at int, name string, description string")
    assert [r["name"] for r in search.fuzzy_rank(items, "ware", "name", "description", "at").collect()] == ["acme/warehouse"]
    assert search.fuzzy_rank(items, "", "name", "description", "at").count() == 3


@pytest.mark.parametrize(("value", "want"), [
    ("  'x' ", "x"), ('"a', '"a'), ("``", ""), ("'\n y \n'", "y"), (" z﻿", "z"), ("'a\"", "'a\"")])
def test_clean_scalar(spark, value, want):
    assert one(spark, text.clean_scalar(lit(value))) == want


def test_branch_names(spark):
    for value, want in (("feature/x-1", True), ("-rf", False), ("", False), ("a b", False)):
        assert one(spark, predicates.valid_branch(lit(value))) is want


@pytest.mark.parametrize(("values", "want"), [
    (["f", "f", "s", "s"], True), (["c"] * 91 + ["d"] * 2 + [""] * 7, False), (list("abcd"), False),
    (["f", "f", "s", "s"] + [""] * 6, False)])
def test_group_signal(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert grouping.group_signal(df, [], "v").first()["signal"] is want


def test_group_modes_and_groups(spark):
    rows = [("finance", "staging", "marts/core", "public"), ("sales", "marts", "staging/x", "public"),
            ("ops", "source", "source/x", "public")]
    df = spark.createDataFrame([r for r in rows for _ in (0, 1)], "domain string, layer string, folder string, schema string")
    assert [(r["mode"], r["groups"]) for r in grouping.available_group_modes(df, []).collect()] == [
        ("domain", 3), ("layer", 3), ("folder", 3)]
    some = spark.createDataFrame([("f",), ("f",), ("o",), ("",)], "domain string")
    assert sorted(r["group"] for r in grouping.apply_group(some, [], "domain").collect()) == ["", "", "f", "f"]
    assert {r["group"] for r in grouping.apply_group(some, [], "none").collect()} == {""}


@pytest.mark.parametrize(("erd", "lineage", "want"), [
    (0, 12, [("lineage", 0)]), (9, 4, [("erd", 0), ("lineage", 1)]), (0, 0, [("erd", 0)]), (2, 5, [("lineage", 0), ("erd", 1)])])
def test_mode_choice(spark, erd, lineage, want):
    df = spark.createDataFrame([("p", "erd", 3, erd), ("p", "lineage", 3, lineage)], "project string, mode string, tables int, relations int")
    got = grouping.mode_choice(df, ["project"]).orderBy("rank").collect()
    assert [(r["mode"], r["rank"]) for r in got] == want
    if erd == lineage == 0:
        assert got[0]["label"] == "tables only"


def test_levels_report_cycles(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("a", "a")]
    got = {r["node"]: (r["level"], r["cyclic"]) for r in
           graph.lineage_levels(spark.createDataFrame(edges, "from_key string, to_key string")).collect()}
    assert got == {"a": (0, False), "b": (1, False), "c": (2, False), "d": (3, False),
                   "x": (None, True), "y": (None, True), "z": (None, True)}


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_levels_with_shuffled_and_small_frontier(spark, threshold, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    edges = spark.range(1, 200).selectExpr("'p' AS project", "cast(id div 3 AS string) AS from_key", "cast(id AS string) AS to_key")
    got = {int(r["node"]): r["level"] for r in graph.lineage_levels(edges, ["project"]).collect()}
    depth = {0: 0}
    for i in range(1, 200):
        depth[i] = depth[i // 3] + 1
    assert got == depth


def levels_one_by_one(edges):
    """Longest path from the roots; None on and below cycles."""
    nodes, above = {n for e in edges for n in e}, {}
    for a, b in edges:
        if a != b:
            above.setdefault(b, set()).add(a)
    level = {n: 0 for n in nodes if n not in above}
    while True:
        new = {n: 1 + max(level[p] for p in above[n]) for n in nodes if n not in level and above[n] <= level.keys()}
        if not new:
            return {n: level.get(n) for n in nodes}
        level.update(new)


def level_cases():
    rng = random.Random(5)
    yield [(f"n{i}", f"n{i + 1}") for i in range(300)]
    yield [e for i in range(60) for e in ((f"m{i}", f"a{i}"), (f"m{i}", f"b{i}"), (f"a{i}", f"m{i + 1}"), (f"b{i}", f"c{i}"), (f"c{i}", f"m{i + 1}"))]
    yield [("r", f"x{i}") for i in range(50)] + [(f"x{i}", f"x{(i + 1) % 20}") for i in range(20)] + [("x3", "y"), ("y", "z"), ("r", "z"), ("q", "q")]
    for n, more in ((30, 1), (60, 2), (40, 4)):
        acyclic = [(f"k{a}", f"k{b}") for _ in range(n * more) for a, b in [sorted(rng.sample(range(n), 2))]]
        yield acyclic
        yield acyclic + [(f"k{rng.randrange(n)}", f"k{rng.randrange(n)}") for _ in range(2)] + [("k5", "t0"), *((f"t{i}", f"t{i + 1}") for i in range(9))]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_levels_equal_a_plain_pass(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    cases = list(level_cases())
    rows = [(str(p), a, b) for p, edges in enumerate(cases) for a, b in edges]
    found = graph.lineage_levels(spark.createDataFrame(rows, "project string, from_key string, to_key string"), ["project"]).collect()
    for p, edges in enumerate(cases):
        got = {r["node"]: r["level"] for r in found if r["project"] == str(p)}
        assert got == {n: x for n, x in levels_one_by_one([e for e in edges if e[0] != e[1]]).items()}, p
    assert all(r["cyclic"] == (r["level"] is None) for r in found)
    assert graph.lineage_levels(spark.createDataFrame([], "from_key string, to_key string")).count() == 0


def test_levels_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    rounds = []
    edges = spark.range(5000).selectExpr("id AS from_key", "id + 1 AS to_key")
    got = graph.lineage_levels(edges, rounds=rounds)
    assert len(rounds) < 40 and {r["node"]: r["level"] for r in got.collect()} == {i: i for i in range(5001)}


def test_relation_prefers_longest_consistent_suffix(spark):
    cols = ["project", "uid", "ref_name", "name", "schema", "database", "display_name", "relation_name"]
    e = spark.createDataFrame([
        ("p", "1", "orders", "orders", "a", "db", "a.orders", ""), ("p", "2", "orders", "orders", "b", "db", "b.orders", ""),
        ("p", "3", "users", "users_v2", "", "", "users", '"db"."s"."People"')], cols)
    refs = ["a.orders", "B.Orders", "db.a.orders", "other.a.orders", "orders", "c.orders", "x.y.users", "people", "s.people", "zzz"]
    df = spark.createDataFrame([("p", r) for r in refs], ["project", "ref"])
    got = {r["ref"]: r["t"]["uid"] if r["t"] else None for r in
           resolve.resolve_relation(df, e, "ref", into="t").collect()}
    assert got == {"a.orders": "1", "B.Orders": "2", "db.a.orders": "1", "other.a.orders": None, "orders": None,
                   "c.orders": None, "x.y.users": "3", "people": "3", "s.people": "3", "zzz": None}


def test_links_skip_shared_key_names_and_known_pairs(spark):
    cols = spark.createDataFrame([
        ("p", "users", "id", True, 1), ("p", "orders", "id", True, 2), ("p", "orders", "user_id", False, 3),
        ("p", "orders", "sku", False, 4), ("p", "boxes", "sku", True, 5), ("p", "boxes", "orderid", False, 6),
        ("p", "boxes", "note", False, 7)], "project string, table_key string, name string, pk boolean, ord long")
    tabs = spark.createDataFrame([("p", "users", 1), ("p", "orders", 2), ("p", "boxes", 3)], "project string, table_key string, ord long")
    got = {(r["from_key"], r["from_col"], r["to_key"], r["to_col"]) for r in links.infer_links(cols, tabs).collect()}
    assert got == {("orders", "user_id", "users", "id"), ("orders", "sku", "boxes", "sku"), ("boxes", "orderid", "orders", "id")}
    known = spark.createDataFrame([("p", "USERS", "id", "orders", "user_id")], "project string, from_key string, from_col string, to_key string, to_col string")
    assert links.infer_links(cols, tabs, known).count() == 2


def test_contract_runs_on_rows(spark):
    child = spark.createDataFrame([(1, 10), (1, 11), (None, 12), (3, None)], "id int, parent int")
    parent = spark.createDataFrame([(10,), (12,)], "key int")
    got = {(r["check_name"], r["columns"]): (r["violations"], r["failed_rows"]) for r in checks.run_contract(
        checks.Contract("c", ("id",), (("id",),), ("id",), ((("parent",), "p", ("key",)),)), {"c": child, "p": parent}).collect()}
    assert got == {("not_null", "id"): (1, 1), ("unique", "id"): (1, 2), ("primary_key", "id"): (2, 3), ("relationship", "parent"): (1, 1)}


def test_contract_from_model(spark):
    cols = spark.createDataFrame([("p", "Orders", "id", True, True, True, 1), ("p", "Orders", "cust", False, True, False, 2),
                                  ("q", "Orders", "x", True, True, True, 1)],
                                 "project string, table_name string, name string, pk boolean, nn boolean, uniq boolean, ord long")
    rels = spark.createDataFrame([("p", "Orders", ["cust"], "customers", ["id"], False), ("p", "Orders", ["x"], "gone", ["y"], True)],
                                 "project string, from_table string, from_cols array<string>, to_table string, to_cols array<string>, to_missing boolean")
    k = checks.contract_from_model(cols, rels, "p", "orders")
    assert (k.not_null, k.unique, k.primary_key) == (("id", "cust"), (("id",),), ("id",))
    assert k.foreign_keys == ((("cust",), "customers", ("id",)),)


def lines(df):
    return [r["line"] for r in df.orderBy(*export.ORDER).collect()]


def test_exports(spark):
    tabs = spark.createDataFrame([("p", "users", 0), ("p", "order items", 1)], "project string, name string, t_ord long")
    cols = spark.createDataFrame([
        ("p", 0, 0, "id", "int", True, False, True, True), ("p", 0, 1, "mail", "varchar (9)", False, False, True, True),
        ("p", 1, 0, "user id", "", False, True, False, False)],
        "project string, t_ord long, ord long, name string, type string, pk boolean, fk boolean, uniq boolean, nn boolean")
    rels = spark.createDataFrame([("p", 0, "order items", ["user id"], "users", ["id"], False), ("p", 1, "users", ["x"], "gone", ["y"], True),
                                  ("p", 2, "users", [], "users", ["id"], False)],
                                 "project string, ord long, from_table string, from_cols array<string>, to_table string, to_cols array<string>, to_missing boolean")
    assert lines(export.export("mermaid", tabs, cols, rels)) == [
        "erDiagram", "    users {", "        int id PK", "        varchar_(9) mail UK", "    }", '    "order items" {',
        '        unknown "user id" FK', "    }", '    users ||--o{ "order items" : "user id"', '    users ||--o{ users : "fk"']
    assert lines(export.export("dbml", tabs, cols, rels)) == [
        'Table "users" {', '  "id" int [pk]', '  "mail" "varchar (9)" [unique, not null]', "}", "", 'Table "order items" {',
        '  "user id" unknown', "}", "", 'Ref: "order items"."user id" > "users"."id"']
    assert lines(export.export("plantuml", tabs, cols, rels)) == [
        "@startuml", "hide circle", "skinparam linetype ortho", "", 'entity "users" as users {', "  * id : int <<PK>>", "  --",
        "  mail : varchar (9)", "}", "", 'entity "order items" as order_items {', "  user id :  <<FK>>", "}", "",
        "users ||--o{ order_items", "users ||--o{ users", "@enduml"]
    assert lines(export.export("nope", tabs, cols, rels)) == []


def test_hot_key_is_split(spark):
    """Half of the references name one table; the join on that key runs as several tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        names = spark.range(2000).selectExpr(
            "'p' AS project", "cast(id AS string) AS uid", "'model' AS kind", "concat('t', id) AS ref_name", "'' AS source_name",
            "'' AS package", "concat('t', id) AS display_name")
        refs = spark.range(0, 60000, 1, 8).selectExpr("'p' AS project", "id", "if(id % 2 = 0, 't7', concat('t', id % 2000)) AS wanted",
                                                     "repeat(cast(id AS string), 8) AS pad")
        found = resolve.resolve_ref(refs, names, "wanted")
        assert found.where("target.display_name = 't7'").count() == 30030
        found.write.format("noop").mode("overwrite").save()
        joined = found.groupBy("target.uid").agg(F.max("pad"))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_relation_texts_are_worked_out_once(spark):
    """Rows whose text is resolved are written before the texts, the suffixes and the result read them."""
    from pyspark.sql import functions as F

    from schemaloom.operators.resolve import resolve_relation

    fields = "project string, uid string, kind string, ref_name string, name string, display_name string, relation_name string, schema string, database string"
    entries = spark.createDataFrame([("p", "u1", "model", "orders", "orders", "orders", "", "s", "d"), ("p", "u2", "model", "x", "x", "x", "", "", "")], fields)
    rows = spark.createDataFrame([("p", "s.orders"), ("p", "X"), ("p", "s.orders"), ("p", "none"), (None, "x")], "project string, relation string")
    found = resolve_relation(rows.withColumn("mark", F.reverse("relation")), entries, "relation")
    assert "reverse" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((str(r["project"]), r["relation"], r["mark"], r["target"] and r["target"]["uid"]) for r in found.collect())
    assert [(*g[:2], g[3]) for g in got if g[0] == "p"] == [("p", "X", "u2"), ("p", "none", None), ("p", "s.orders", "u1"), ("p", "s.orders", "u1")]
    assert got[0] == ("None", "x", "x", None)
