"""Contracts from one scan per table, links verified from rows, profiles."""

import re

import pytest

from schemaloom.operators import checks
from schemaloom.plans import live

FOLDER = "/root/testdata/sf0.001"


def results(df):
    return {(r["table_name"], r["check_name"], r["columns"]): (r["violations"], r["failed_rows"]) for r in df.collect()}


@pytest.fixture(scope="module")
def data(spark):
    child = spark.createDataFrame([(1, 10, "a", 1.5, None), (1, 11, "b", 0.0, 7), (None, 12, "a", -0.0, 7), (3, None, None, float("nan"), 8),
                                   (4, 10, "a", float("nan"), 9)], "id int, parent int, name string, rate double, `odd name` bigint")
    parent = spark.createDataFrame([(10, "x", "10"), (12, "y", "11"), (None, "x", None)], "key bigint, kind string, text string")
    return {"c": child, "p": parent}


def test_every_kind_of_key(data):
    contract = checks.Contract(
        "c", ("id", "odd name"), (("name",), ("rate",), ("id", "parent"), ("parent", "name", "rate")), ("id", "parent"),
        ((("parent",), "p", ("key",)), (("parent",), "p", ("key",), "kind = 'x'"), (("parent",), "p", ("text",)),
         (("parent", "name"), "p", ("key", "kind"))))
    got = checks.run_contracts([contract, checks.Contract("p", primary_key=("key",), unique=(("kind",),))], data).collect()
    assert sorted((r["check_name"], r["columns"], r["violations"], r["failed_rows"]) for r in got if r["table_name"] == "c") == sorted([
        ("not_null", "id", 1, 1), ("not_null", "odd name", 1, 1), ("unique", "name", 1, 3), ("unique", "rate", 2, 4), ("unique", "id,parent", 0, 0),
        ("unique", "parent,name,rate", 0, 0), ("primary_key", "id,parent", 2, 2), ("relationship", "parent", 1, 1),
        ("relationship", "parent", 2, 2), ("relationship", "parent", 1, 1), ("relationship", "parent,name", 3, 4)])
    assert sorted((r["check_name"], r["violations"], r["failed_rows"]) for r in got if r["table_name"] == "p") == [("primary_key", 1, 1), ("unique", 1, 2)]


def test_key_with_nulls_in_different_places(spark):
    rows = spark.createDataFrame([(None, 1), (1, None), (None, 1), (1, 1), (None, None)], "a int, b int")
    got = results(checks.run_contract(checks.Contract("t", primary_key=("a", "b")), {"t": rows}))
    # three keys hold a null, one of them on two rows
    assert got == {("t", "primary_key", "a,b"): (3, 4)}


def test_empty_tables_and_contracts(spark, data):
    none = {k: v.limit(0) for k, v in data.items()}
    contract = checks.Contract("c", ("id",), (("name",),), ("id",), ((("parent",), "p", ("key",)),))
    assert set(results(checks.run_contract(contract, none)).values()) == {(0, 0)}


def test_one_scan_per_table(spark):
    names = ("lineitem", "orders", "part", "customer")
    tables = {n: spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in names}
    contracts = [
        checks.Contract("lineitem", ("l_orderkey", "l_tax"), (("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey")), ("l_orderkey", "l_linenumber"),
                        ((("l_orderkey",), "orders", ("o_orderkey",)), (("l_partkey",), "part", ("p_partkey",)))),
        checks.Contract("orders", ("o_custkey",), (), ("o_orderkey",), ((("o_custkey",), "customer", ("c_custkey",), "c_acctbal > 0"),)),
        checks.Contract("customer", (), (("c_name",),), ("c_custkey",))]
    plan = checks.run_contracts(contracts, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) == len(names)
    # one shuffle by key, one to fold the checks
    assert plan.count("Aggregate [") == 2


def test_links_verified_from_rows(spark, data):
    links = spark.createDataFrame([("p", "C", "parent", "p", "KEY", 1), ("p", "c", "parent", "p", "text", 2), ("p", "c", "name", "p", "kind", 3),
                                   ("p", "c", "gone", "p", "key", 4), ("p", "c", "name", "nowhere", "key", 5)],
                                  "project string, from_key string, from_col string, to_key string, to_col string, ord int")
    got = {r["ord"]: (r["child_values"], r["found"], r["share"]) for r in checks.verify_links(links, data).collect()}
    assert got == {1: (3, 2, 0.666667), 2: (3, 2, 0.666667), 3: (2, 0, 0.0), 4: (0, 0, None), 5: (2, 0, 0.0)}
    assert checks.verify_links(links.limit(0), data).count() == 0


def test_links_found_in_live_tables(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(1, 1), (2, 9)], "id int, users_id int")
    got = live.found_links({"users": a, "orders": b}, {"users": "id", "orders": "id"}).collect()
    assert [(r["from_key"], r["from_col"], r["to_key"], r["to_col"], r["found"], r["child_values"]) for r in got] == [("orders", "users_id", "users", "id", 1, 2)]


def test_profiles(spark, data):
    exact = {r["column_name"]: (r["filled"], r["nulls"], r["distinct_values"]) for r in checks.column_profile(data["c"]).collect()}
    assert exact == {"id": (4, 1, 3), "parent": (4, 1, 3), "name": (4, 1, 2), "rate": (5, 0, 3), "odd name": (4, 1, 3)}
    rough = {r["column_name"]: (r["filled"], r["nulls"], r["distinct_values"]) for r in checks.column_profile(data["c"], approximate=True).collect()}
    assert rough == exact


def test_profiles_merge(spark):
    whole = spark.range(20_000).selectExpr("id % 7000 AS a", "if(id % 4 = 0, null, cast(id AS string)) AS b", "cast(null AS int) AS c")
    parts = [checks.profile_sketches(whole.where(f"a % 3 = {i}")) for i in range(3)]
    merged = checks.profile_counts(checks.merge_profiles(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    got = {r["column_name"]: r for r in merged.collect()}
    assert {c: (r["filled"], r["nulls"]) for c, r in got.items()} == {"a": (20_000, 0), "b": (15_000, 5_000), "c": (0, 20_000)}
    # three standard errors
    for c, n in (("a", 7000), ("b", 15_000), ("c", 0)):
        assert abs(got[c]["distinct_values"] - n) <= 0.05 * n
    plan = checks.profile_sketches(whole)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # sketches, not values
