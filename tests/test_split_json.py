"""Documents taken apart piece by piece against a JSON parser."""

import json
import random

import pytest
from pyspark.sql import functions as F
from projects import write_artifact_project

from schemaloom.sources import artifacts
from schemaloom.sources.split_json import split_members

NASTY = ['plain', 'a } b', '{"x": "}"}', 'quote \\" and \\\\', '\\\\"}{][', 'ünï 😀 }', '', ' "nodes": { ', "line\nbreak } \t"]


def document(seed, members):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(6 if depth < 3 else 3)
        return (rng.choice(NASTY) if kind < 2 else rng.choice([None, True, 1.5, -3]) if kind == 2 else
                [value(depth + 1) for _ in range(rng.randrange(3))] if kind == 3 else {rng.choice(NASTY) + str(i): value(depth + 1) for i in range(rng.randrange(3))})

    def section(n):
        return {f"{rng.choice(NASTY)}{i}": {"name": rng.choice(NASTY), "deep": value(0), "n": i} for i in range(n)}

    return {"version": 3, "tags": ["}", ["x", "{"]], "metadata": {"a": "}", "b": {"c": [{}]}}, "nodes": section(members), "empty": {}, "note": "} {",
            "parent_map": {"a": ["b}", "c"], "d": []}, "sources": section(members // 3), "last": {"x": {"y": 1}}}


def wanted(docs):
    return sorted((name, section, i, key, json.dumps(value, sort_keys=True)) for name, doc in docs.items()
                  for section in ("nodes", "sources") for i, (key, value) in enumerate(doc[section].items()))


@pytest.mark.parametrize(("indent", "ascii_only"), [(None, True), (2, False)])
def test_members_equal_the_parser(spark, tmp_path, indent, ascii_only, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.files.maxPartitionBytes", before))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # many blocks a file, borders anywhere
    docs = {f"d{i}.json": document(i, n) for i, n in enumerate((0, 1, 40, 120))}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_only) + ("\n" if indent else ""), "utf-8")
    (tmp_path / "nothing.json").write_text("")
    rows = split_members(spark, str(tmp_path), "*.json").where("section in ('nodes', 'sources')").collect()
    got = sorted((r["file"].rsplit("/", 1)[-1], r["section"], r["pos"], r["key"], json.dumps(json.loads(r["text"]), sort_keys=True)) for r in rows)
    assert got == wanted(docs)


def test_manifest_read_both_ways(spark, tmp_path):
    write_artifact_project(tmp_path)
    for read in (artifacts.read_manifest, artifacts.read_catalog_columns):
        whole, split = (read(spark, str(tmp_path), split_from=n) for n in (1 << 26, 0))
        assert [f.name for f in whole.schema] == [f.name for f in split.schema]
        # constraints are kept as text, with or without the file's blanks
        texts = [sorted(r[0].replace(" ", "") for r in d.select(F.to_json(F.struct(*d.columns))).collect()) for d in (whole, split)]
        assert texts[0] == texts[1] != []


def test_a_large_manifest_is_several_tasks(spark, tmp_path, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.files.maxPartitionBytes", before))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    (tmp_path / "target").mkdir()
    nodes = {f"model.p.m{i}": {"unique_id": f"model.p.m{i}", "resource_type": "model", "name": f"m{i}", "raw_code": "select {a} " * 300} for i in range(2500)}
    (tmp_path / "target" / "manifest.json").write_text(json.dumps({"nodes": nodes, "sources": {}}))
    rows = artifacts.read_manifest(spark, str(tmp_path), split_from=1 << 20)
    scan = spark.read.option("lineSep", "}").text(str(tmp_path / "target" / "manifest.json"))
    assert scan.rdd.getNumPartitions() >= 8
    assert rows.where("kind = 'model' and key = concat('model.p.m', pos) and node.name = concat('m', pos)").count() == 2500 == rows.count()
