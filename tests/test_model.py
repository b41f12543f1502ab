"""Metadata of two small projects -> model; expected values worked out by hand."""

import pytest
from projects import write_artifact_project, write_schema_file_project

from pyspark.sql import functions as F

from schemaloom.operators.export import ORDER
from schemaloom.operators.graph import neighbours
from schemaloom.plans.model import Model, artifact_model, export_model, fleet_model, schema_file_model, stored_model
from schemaloom.sources.projects import discover_projects
from schemaloom.sources.sinks import read_model, write_model

WIDE_NAMES = [f"c{n}" for n in range(20)]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("projects")
    write_artifact_project(folder)
    write_schema_file_project(folder)
    return str(folder)


@pytest.fixture(scope="module")
def room(spark, root):
    return artifact_model(spark, root)


@pytest.fixture(scope="module")
def yard(spark, root):
    return only_yard(schema_file_model(spark, root))


def only_yard(model):
    return Model(*[part.where("project = 'freight_yard'") for part in model.parts().values()])


def in_order(rows, *columns):
    return [tuple(r[c] for c in columns) for r in rows.orderBy("ord").collect()]


def edges(model):
    return [f"{r['from_table']}({','.join(r['from_cols'])}) -> {r['to_table']}({','.join(r['to_cols'])})"
            for r in model.relations.orderBy("ord").collect()]


def marks(model, table):
    rows = model.columns.where(f"table_name = '{table}'").collect()
    return {r["name"]: "".join(f for f in ("pk", "nn", "uniq", "fk") if r[f]) for r in rows}


def lineage(model):
    return sorted(f"{r['from_table']} -> {r['to_table']}" for r in model.relations.collect())


def test_vendored_projects_are_passed_over(spark, root):
    assert {r["project"] for r in discover_projects(spark, root).collect()} == {"reading_room", "freight_yard"}


def test_compiled_tables_and_edges(room):
    assert {r["name"] for r in room.tables.collect()} == {
        "members", "titles", "copies", "circ.loans", "branch.loans", "fines", "desk.scans"}
    assert edges(room) == [
        "circ.loans(card_no) -> members(card_no)", "fines(loan_ref) -> circ.loans(loan_no)",
        "copies(isbn,edition) -> titles(isbn,edition)", "circ.loans(barcode) -> copies(barcode)"]
    counted = room.stats.first()
    assert (counted["tables"], counted["columns"], counted["relations"]) == (7, 15, 4)


def test_compiled_marks_and_types(room):
    assert marks(room, "members") == {"card_no": "pknnuniq", "full_name": ""}
    assert marks(room, "titles") == {"isbn": "pknn", "edition": "pknn"}
    assert marks(room, "copies") == {"barcode": "pknn", "isbn": "fk", "edition": "fk"}
    assert marks(room, "fines") == {"fine_no": "", "loan_ref": "uniqfk"}
    found = {(r["table_name"], r["name"]): r["type"] for r in room.columns.collect()}
    assert found["members", "card_no"] == "varchar" and found["members", "full_name"] == "text"
    assert found["desk.scans", "scanned_at"] == "timestamp"


def test_compiled_lineage(spark, root):
    assert lineage(artifact_model(spark, root, lineage=True)) == [
        "copies -> circ.loans", "desk.scans -> circ.loans", "members -> circ.loans"]


def test_tables_of_several_files_keep_one_order(yard):
    assert in_order(yard.tables, "ord", "name") == list(enumerate(
        ["carriers", "ports", "yard.gates", "waybills", "legs", "delays", "tariffs", "leg_states"], 1))


def test_edges_have_their_own_places_past_the_sixteenth_column(yard):
    assert edges(yard) == ["yard.gates(port) -> ports(code)", "waybills(c15) -> carriers(code)", "waybills(c17) -> ports(code)",
                           "legs(port) -> ports(code)"]
    assert [r[0] for r in in_order(yard.relations, "ord")] == [1, 2, 3, 4]


def test_single_values_count_as_lists(yard):
    assert marks(yard, "carriers") == {"code": "pknnuniq", "title": ""}
    assert marks(yard, "legs") == {"leg_no": "", "port": "fk"}
    assert [n for (n,) in in_order(yard.columns.where("table_name = 'waybills'"), "name")] == WIDE_NAMES
    assert {n for n, m in marks(yard, "waybills").items() if m} == {"c15", "c17"}
    assert [n for (n,) in in_order(yard.columns.where("table_name = 'tariffs'"), "name")] == ["port", "rate"]


def test_scripts_of_one_name_are_one_table(spark, root):
    assert lineage(only_yard(schema_file_model(spark, root, lineage=True))) == [
        "carriers -> legs", "legs -> delays", "legs -> leg_states", "ports -> delays", "yard.gates -> legs"]


def test_fleet_prefers_artifacts_and_writes(spark, root, tmp_path):
    model = fleet_model(spark, root)
    assert sorted((r["project"], r["source"], r["tables"]) for r in model.stats.collect()) == [
        ("freight_yard", "yml", 8), ("reading_room", "manifest", 7)]
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        read_model(spark, path)
    write_model(model.parts(), path, repo="org/fleet", branch="main")
    back = stored_model(spark, path)
    assert back.columns.where("project = 'freight_yard'").count() == 29
    for name, part in model.parts().items():
        again = back.parts()[name]
        assert again.schema.fieldNames() == part.schema.fieldNames()
        assert again.exceptAll(part).isEmpty() and part.exceptAll(again).isEmpty()
    meta = read_model(spark, path)["meta"].where("project = 'reading_room'").first()
    assert (meta["title"], meta["mode"], meta["repo"], meta["branch"], meta["tables"]) == ("reading_room", "erd", "org/fleet", "main", 7)
    assert [r["line"] for r in export_model(back, "mermaid").where("project = 'reading_room' and line like '%||--o{%'").orderBy(*ORDER).collect()]


def test_files_follow_rows_and_readers_the_last_commit(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = spark.range(6000).selectExpr("concat('p', cast(if(id < 3000, 0, id) AS string)) AS project", "'erd' AS mode", "id AS ord")
    first = write_model({"tables": rows}, path, file_rows=500)
    files = spark.read.parquet(f"{path}/{first}/tables").select(F.input_file_name().alias("f"), "project")
    assert 10 <= files.select("f").distinct().count() <= 13
    # the large project is several files, most files hold many projects
    assert files.where("project = 'p0'").select("f").distinct().count() >= 5
    second = write_model({"tables": rows.limit(10)}, path, fmt="json")
    # a write that broke off: rows, but no commit
    rows.write.parquet(f"{path}/broken/tables")
    assert read_model(spark, path)["tables"].count() == 10 and read_model(spark, path, first)["tables"].count() == 6000
    assert second != first and read_model(spark, path, first)["tables"].exceptAll(rows).isEmpty()


def test_a_node_without_edges_is_its_own_neighbourhood(spark):
    joined = spark.createDataFrame([("p", "a", "b")], "project string, from_key string, to_key string")
    listed = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "z")], "project string, node string")
    assert [r["node"] for r in neighbours(joined, "z", ["project"], listed).collect()] == ["z"]
    assert sorted(r["node"] for r in neighbours(joined, "a", ["project"], listed).collect()) == ["a", "b"]
