"""Numbering, aliases, heads and batches against plain Python."""

import random
import re

import pytest

from schemaloom.operators import ordering as o


def alias_one_by_one(names):
    used, out = set(), []
    for name in names:
        base = re.sub(r"[^A-Za-z0-9_]", "_", name)
        base = "e_" + base if not base or base[0].isdigit() else base
        alias, i = base, 2
        while alias in used:
            alias, i = f"{base}_{i}", i + 1
        used.add(alias)
        out.append(alias)
    return out


def test_number_rows_across_blocks(spark):
    rows = [(g, i * 3 + len(g)) for g in ("a", "hot") for i in range(5 if g == "a" else 60)]
    found = o.number_rows(spark.createDataFrame(rows, "g string, at long"), ["g"], "at", "rn", block=7).collect()
    want = {(g, at): 1 + sum(1 for h, b in rows if h == g and b < at) for g, at in rows}
    assert {(r["g"], r["at"]): r["rn"] for r in found} == want


CASES = [
    ["a", "a", "a_2", "a"],
    ["a_2", "a", "a"],
    ["a", "a_2", "a", "a", "a_3", "a"],
    ["a_2_2", "a_2", "a", "a", "a_2", "a"],
    ["x", "a", "a", "a", "a_2", "a_2", "a_2_2", "1", "e_1", "", "a"],
]


def test_unique_alias_cases(spark):
    rng = random.Random(7)
    cases = CASES + [[rng.choice(["a", "a", "a_2", "a_3", "a_2_2", "b", "a_4"]) for _ in range(14)] for _ in range(12)]
    rows = [(p, i, n) for p, names in enumerate(cases) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "project int, at long, name string")
    found = {(r["project"], r["at"]): r["alias"] for r in o.unique_alias(df, ["project"], "at", block=4).collect()}
    for p, names in enumerate(cases):
        assert [found[p, i] for i in range(len(names))] == alias_one_by_one(names), names


def test_unique_alias_with_very_many_claims(spark):
    """10,000 claimed suffixes of one base, some before and some after the rows that want them."""
    rng = random.Random(11)
    names = ["a"] * 9000 + [f"a_{i}" for i in range(2, 10_002)] + ["a_3_2", "a_7", "a_7_2", "a_7_2_2", "a_9"] * 20
    rng.shuffle(names)
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(names)], "project int, at long, name string")
    found = {r["at"]: r["alias"] for r in o.unique_alias(df, ["project"], "at", block=1000).collect()}
    assert [found[i] for i in range(len(names))] == alias_one_by_one(names)


def test_unique_alias_nested_suffixes(spark):
    chain = ["a"] + ["a" + "_2" * i for i in range(1, 12)]
    cases = [[n for n in chain for _ in (0, 1)], [n for n in reversed(chain) for _ in (0, 1)], ["a", *chain, *chain], ["a_99999999999999999999", "a", "a"]]
    rows = [(p, i, n) for p, names in enumerate(cases) for i, n in enumerate(names)]
    found = {(r["project"], r["at"]): r["alias"] for r in o.unique_alias(
        spark.createDataFrame(rows, "project int, at long, name string"), ["project"], "at", block=3).collect()}
    for p, names in enumerate(cases):
        assert [found[p, i] for i in range(len(names))] == alias_one_by_one(names), names


@pytest.mark.parametrize(("n", "shown", "footer"), [(5, 5, ""), (8, 8, ""), (9, 8, "+1 more"), (12, 8, "+4 more")])
def test_column_head(spark, n, shown, footer):
    rows = o.column_head(spark.range(n).selectExpr("'t' AS t", "id AS ord"), ["t"], "ord").collect()
    assert len(rows) == shown and {r["footer"] for r in rows} == {footer}


def test_batches(spark):
    owners = spark.createDataFrame([(i, "User" if i % 2 else "Organization", f"o{i}") for i in range(12)],
                                   "at long, kind string, login string")
    got = o.batch_strings(owners, [], "at", o.owner_scope("kind", "login"), "filename:x ", block=4).orderBy("batch").collect()
    assert [r["query"].count(":") - 1 for r in got] == [5, 5, 2]
    assert got[0]["query"] == "filename:x org:o0 user:o1 org:o2 user:o3 org:o4"
    assert o.batch_strings(owners.limit(0), [], "at", o.owner_scope("kind", "login")).count() == 0


def test_next_free_name(spark):
    cols = spark.createDataFrame([("a", "new_column"), ("a", "NEW_COLUMN_2"), ("a", "new_column_4"), ("b", "x"),
                                  ("c", "new_column_2"), ("a", "new_column_99999999999999999999")], "t string, name string")
    got = {r["t"]: r["free_name"] for r in o.next_free_name(cols, cols, ["t"]).collect()}
    assert got == {"a": "new_column_3", "b": "new_column", "c": "new_column"}


def test_qualify_names_keeps_what_does_not_collide(spark):
    rows = [("p", f"model.pkg{i}.orders", "model", "orders", "", f"pkg{i}", s, "db", "", "orders")
            for i, s in enumerate(("a", "b", "b"))] + [("p", "model.x.solo", "model", "solo", "", "x", "a", "db", "", "solo")]
    df = spark.createDataFrame(rows, "project string, uid string, kind string, name string, source_name string, "
                                     "package string, schema string, database string, path_qualifier string, base_name string")
    got = {r["uid"]: r["display_name"] for r in o.qualify_names(df).collect()}
    assert got == {"model.pkg0.orders": "a.orders", "model.pkg1.orders": "pkg1.b.orders",
                   "model.pkg2.orders": "pkg2.b.orders", "model.x.solo": "solo"}


def test_default_first_and_sorted_names(spark):
    rows = spark.createDataFrame([(0, "b"), (1, "main"), (2, "a"), (3, " "), (4, "a")], "at int, name string")
    assert [r["name"] for r in o.default_first(rows, rows["name"] == "main", "at").collect()] == ["main", "b", "a", " ", "a"]
    assert [r["name"] for r in o.sorted_names(rows, "name").collect()] == ["a", "b", "main"]
