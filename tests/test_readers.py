"""Readers on files: what is opened, decoded how often, and from workers that know nothing of this folder."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from schemaloom.plans.model import schema_file_model
from schemaloom.sources import projects, schema_files

REPO = Path(__file__).resolve().parent.parent
PROBE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from schemaloom.plans.model import fleet_model
model = fleet_model(spark, {root!r})
print("found", sorted(r["name"] for r in model.tables.collect()))
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("readers")
    files = {"a/dbt_project.yml": "name: alpha\nmodel-paths: [defs]\n", "a/defs/one.yml": "models:\n  - name: ships\n    columns:\n      - name: id\n",
             "a/defs/ships.sql": "select 1", "a/defs/ports.sql": "select 2", "a/other/two.yml": "models:\n  - name: hidden\n",
             "a/node_modules/x/dbt_project.yml": "name: vendored\n" + "# " + "x" * 5000, "a/node_modules/x/defs/bad.yml": "{" * 5000,
             "a/defs/venv/three.yml": "models: [{name: built}]" + " " * 5000}
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


@pytest.fixture
def small_files_only(spark):
    """Opening any file of over 2,000 bytes is an error."""
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    yield
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_vendored_files_are_never_opened(spark, root, small_files_only):
    known = projects.discover_projects(spark, root)
    assert [r["project"] for r in known.collect()] == ["alpha"]
    objects = schema_files.read_schema_yaml(spark, root, known, root)
    assert [r["name"] for r in objects.collect()] == ["ships"]


def test_only_files_of_project_folders_are_decoded_and_once(spark, root, monkeypatch):
    decoded = []
    plain = projects.yaml_documents

    def counting(files):
        decoded.append(sorted(Path(r["file"]).name for r in files.select("file").collect()))
        return plain(files)

    monkeypatch.setattr(projects, "yaml_documents", counting)
    model = schema_file_model(spark, root)
    assert {r["name"] for r in model.tables.collect()} == {"ships", "ports"}
    assert decoded == [["dbt_project.yml"], ["one.yml"]]
    for part in model.parts().values():
        assert "MapInPandas" not in part._jdf.queryExecution().executedPlan().toString()


def test_a_session_started_in_another_folder(root, tmp_path):
    """A plain session without this package on its workers' path reads the model."""
    script = tmp_path / "probe.py"
    script.write_text(PROBE.format(repo=str(REPO), root=root))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300,
                          env={k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED")})
    assert "found ['ports', 'ships']" in done.stdout, done.stderr[-3000:]


def test_documents_kept_in_a_table_are_decoded_once(spark):
    """The four sections and the join with the projects read one decoded table; tests of columns and tables are read together."""
    text = ("models: [null, {name: a, schema: s, tests: [{x.unique: {column_name: id}}], columns: [{name: id, tests: not_null}, {name: ' '}]}]\n"
            "seeds: [{name: b, config: {enabled: false}}]\nsources: [null, {name: raw, schema: S, tables: [{name: t}, {name: u, schema: own, enabled: false}]}, "
            "{name: off, enabled: false, tables: [{name: v}]}, {name: none}]\n")
    files = spark.createDataFrame([("/p/models/core/x.yml", bytearray(text.encode())), ("/p/models/y.yml", bytearray(b"seeds: 3"))], "file string, content binary")
    known = spark.createDataFrame([("/p", "p", ["models"], ["seeds"], ["snapshots"])],
                                  "project_dir string, project string, model_paths array<string>, seed_paths array<string>, snapshot_paths array<string>")
    objects = schema_files.schema_objects(projects.yaml_documents(files), known)
    assert "MapInPandas" not in objects._jdf.queryExecution().toString()
    got = {(r["kind"], r["uid"], r["source_name"], r["schema"], r["path_qualifier"], r["ord"] >> 60, r["skipped"]) for r in objects.collect()}
    assert got == {("model", "model.yml:models/core/x.yml:1:a", "", "s", "models/core", 0, False),
                   ("seed", "seed.yml:models/core/x.yml:0:b", "", "", "models/core", 1, True),
                   ("source", "source.yml:models/core/x.yml:1:0:raw.t", "raw", "S", "models/core", 3, False),
                   ("source", "source.yml:models/core/x.yml:1:1:raw.u", "raw", "own", "models/core", 3, True)}
    tests = schema_files.yaml_tests(objects)
    assert tests._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 1
    assert {(r["uid"][-1], r["test"], r["column"]) for r in tests.collect()} == {("a", "not_null", "id"), ("a", "unique", "id")}


@pytest.mark.parametrize("text", ["a:\tb", "a: !\n", "|# x", "{a: b:c}", "a: yes\nb: True\nc: 2020-01-01", "a: [", "a: \x07", "%x"])
def test_both_parsers_say_the_same(text):
    def word(load):
        try:
            return repr(load())
        except projects.yaml.YAMLError as error:
            return str(error)

    own = word(lambda: projects.yaml.load(text.encode(), Loader=projects._PlainLoader))
    assert word(lambda: projects._loaded(text.encode())) == own
