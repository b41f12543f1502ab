"""Schema YAML, model SQL, seed CSV headers and snapshot SQL of projects without artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_disabled, is_skipped
from ..functions.text import clean_scalar, first_text, trim_space
from ..functions.arrays import NESTED, json_items, parse_yaml_test
from ..session import cut_lineage
from .artifacts import with_names
from .projects import listed, read_yaml

# Tests and constraints are JSON text: a single value counts as a list of one.
YAML_COLUMN = ("name string, data_type string, type string, dtype string, tests string, "
               "data_tests string, constraints string")
YAML_TABLE = (
    "name string, schema string, enabled boolean, materialized string, "
    "config struct<enabled:boolean, materialized:string, schema:string>, "
    "tests string, data_tests string, "
    f"columns array<struct<{YAML_COLUMN}>>, constraints string"
)
YAML_SOURCE = (f"name string, schema string, enabled boolean, config struct<enabled:boolean>, "
               f"tables array<struct<{YAML_TABLE}>>")
YAML_FILE = (f"models array<struct<{YAML_TABLE}>>, seeds array<struct<{YAML_TABLE}>>, "
             f"snapshots array<struct<{YAML_TABLE}>>, sources array<struct<{YAML_SOURCE}>>")

# Positions inside one file: models, seeds, snapshots, then sources; sources by their place, 2^30 tables apart.
SECTION_STEP, SOURCE_STEP = 1 << 60, 1 << 30
# Place of table-level tests, behind every column.
TABLE_LEVEL = 1 << 32
SECTIONS = (("models", "model"), ("seeds", "seed"), ("snapshots", "snapshot"))


def locate(files: DataFrame, projects: DataFrame, folders: str | list[str]) -> DataFrame:
    """Attach project and relative path; keep files that lie in one of the project's folders.

    Projects may nest, so the file's ancestors are exploded and matched by equality and the deepest
    project wins. That keeps the join a hash join where a prefix test would be a nested loop.
    """
    wanted = [folders] if isinstance(folders, str) else folders
    depth = F.size(F.split("file", "/"))
    ancestors = F.transform(F.sequence(F.lit(1), depth - 1), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(F.split("file", "/"), F.lit(1), n), "/").alias("project_dir")))
    owner = (
        files.select("file", F.explode(ancestors).alias("a")).select("file", "a.depth", "a.project_dir")
        .join(projects.select("project_dir", "project", F.concat(*wanted).alias("folders")), "project_dir")
        .groupBy("file")
        .agg(F.max_by(F.struct("project_dir", "project", "folders"), "depth").alias("o"))
        .select("file", "o.*")
        .withColumn("relative", F.expr("substring(file, length(project_dir) + 2)"))
        .where(F.exists("folders", lambda d: F.col("relative").startswith(F.concat(
            F.regexp_replace(d, r"\A\./|/+\z", ""), F.lit("/")))))
        .drop("folders")
    )
    return files.join(owner, "file")


def _folder(relative: str = "relative") -> Column:
    return F.when(F.contains(F.col(relative), F.lit("/")),
                  F.regexp_replace(relative, r"/[^/]*\z", "")).otherwise("")


def _stem(file: str = "file") -> Column:
    return F.regexp_replace(F.substring_index(file, "/", -1), r"(?<=.)\.[^.]*\z", "")


def _tests(owner: Column) -> Column:
    return F.transform(F.concat(json_items(owner["tests"]), json_items(owner["data_tests"])), parse_yaml_test)


YAML_GLOB, FOLDERS = "*.{yml,yaml,YML,YAML}", ["model_paths", "seed_paths", "snapshot_paths"]


def read_schema_yaml(spark: SparkSession, paths, projects: DataFrame, root: str | None = None) -> DataFrame:
    """Table objects of every YAML file in a project's model, seed and snapshot folders.

    The files are listed and given their project first, so only files of such folders are decoded, each once.
    """
    owned = cut_lineage(locate(listed(spark, paths, YAML_GLOB, root).select("file"), projects, FOLDERS))
    return _objects(read_yaml(spark, paths, YAML_GLOB, root, owned).where(F.col("document").isNotNull()).join(owned, "file"))


def schema_objects(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """YAML documents -> one row per table object, skipped ones included and flagged.

    Columns: project, file, kind, uid, name, source_name, schema, path_qualifier, ord, skipped, object.
    """
    # the join with their projects reads the documents twice; written, each is decoded once
    decoded = cut_lineage(documents.where(F.col("document").isNotNull()).select("file", "document"))
    return _objects(locate(decoded, projects, FOLDERS))


def _section(kind: str, index: int) -> Column:
    """The objects of a section with their places, null sections as none."""
    field = SECTIONS[index][0]
    return F.coalesce(F.transform(F.col(f"doc.{field}"), lambda t, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("spos"), i.alias("pos"), F.lit("").alias("source_name"),
        F.lit("").alias("source_schema"), (i + F.lit(index * SECTION_STEP).cast("bigint")).alias("ord"), t.alias("object"))), F.array())


def _source_tables() -> Column:
    """The tables of every source that is named and not disabled."""
    def tables(source: Column, spos: Column) -> Column:
        named = ~is_disabled(source["enabled"], source["config"]["enabled"]) & (first_text(source["name"]) != "")
        found = F.transform(source["tables"], lambda t, i: F.struct(
            F.lit("source").alias("kind"), spos.alias("spos"), i.alias("pos"), first_text(source["name"]).alias("source_name"),
            first_text(source["schema"]).alias("source_schema"),
            (F.lit(3 * SECTION_STEP).cast("bigint") + spos * F.lit(SOURCE_STEP) + i).alias("ord"), t.alias("object")))
        return F.coalesce(F.when(named, found), F.array())

    return F.coalesce(F.flatten(F.transform(F.col("doc.sources"), tables)), F.array())


def _objects(docs: DataFrame) -> DataFrame:
    """All sections come from one explode, so that a document is parsed once for them."""
    docs = docs.select("project", "file", "relative", F.from_json("document", YAML_FILE).alias("doc"))
    members = F.concat(*[_section(kind, n) for n, (_, kind) in enumerate(SECTIONS)], _source_tables())
    t, source = F.col("object"), F.col("kind") == "source"
    name = first_text(t["name"])
    return docs.select("project", "file", "relative", F.inline(members)).select(
        "project", "file", "kind",
        F.concat_ws(":", F.concat("kind", F.lit(".yml")), "relative", F.col("spos").cast("string"), F.col("pos").cast("string"),
                    F.when(source, F.concat("source_name", F.lit("."), name)).otherwise(name)).alias("uid"),
        name.alias("name"), "source_name",
        F.when(source, first_text(t["schema"], "source_schema")).otherwise(first_text(t["schema"], t["config"]["schema"])).alias("schema"),
        _folder().alias("path_qualifier"), "ord",
        F.when(source, is_disabled(t["enabled"], t["config"]["enabled"])).otherwise(
            is_skipped("kind", t["enabled"], t["config"]["enabled"], t["materialized"], t["config"]["materialized"])).alias("skipped"),
        "object").where(F.col("name") != "")


def yaml_columns(objects: DataFrame) -> DataFrame:
    """Declared columns: (project, uid, pos, name, type, constraints, tests)."""
    c = F.col("column")
    return (
        objects.select("project", "uid", F.posexplode("object.columns").alias("pos", "column"))
        .select("project", "uid", F.col("pos").cast("bigint").alias("pos"), first_text(c["name"]).alias("name"),
                first_text(c["data_type"], c["type"], c["dtype"]).alias("type"),
                c["constraints"].alias("constraints"), _tests(c).alias("tests"))
        .where(F.col("name") != "")
    )


def yaml_tests(objects: DataFrame) -> DataFrame:
    """Declared tests: (project, uid, pos, test, column, target, field), column tests first."""
    def declared(pos, owner, of):
        return F.struct(pos.cast("bigint").alias("pos"), owner.alias("owner"), of["tests"].alias("tests"), of["data_tests"].alias("data_tests"))

    # the tests of the columns and of the table itself come from one explode, so that the objects are read once
    columns = F.transform("object.columns", lambda c, i: declared(i, first_text(c["name"]), c))
    owners = F.concat(F.filter(F.coalesce(columns, F.array()), lambda o: o["owner"] != ""),
                      F.array(declared(F.lit(TABLE_LEVEL), F.lit(""), F.col("object"))))
    args = F.col("t.args")

    def arg(key):
        return F.coalesce(F.get_json_object(args, f"$.arguments.{key}"), F.get_json_object(args, f"$.{key}"))

    return (
        objects.select("project", "uid", F.explode(owners).alias("o"))
        .select("project", "uid", "o.owner", "o.pos", F.posexplode(_tests(F.col("o"))).alias("tpos", "t"))
        .select("project", "uid", (F.col("pos") * F.lit(NESTED) + F.col("tpos")).alias("pos"),
                F.col("t.name").alias("test"),
                first_text("owner", arg("column_name"), arg("column")).alias("column"),
                first_text(arg("to"), arg("model")).alias("target"),
                first_text(arg("field"), arg("to_field")).alias("field"))
        .where(F.col("test") != "")
    )


def _text_files(spark: SparkSession, paths, glob: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def model_scripts(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(file, value) -> (project, file, relative, kind, name, sql); the file stem is the model's name."""
    return locate(files, projects, "model_paths").select(
        "project", "file", "relative", F.lit("model").alias("kind"), _stem().alias("name"),
        F.col("value").alias("sql"))


def read_model_sql(spark: SparkSession, paths, projects: DataFrame) -> DataFrame:
    return model_scripts(_text_files(spark, paths, "*.{sql,SQL}"), projects)


def snapshot_name(sql) -> Column:
    """Name in the opening tag of a snapshot block, '' when there is none."""
    return first_text(F.regexp_extract(sql, r"(?i)\{%-?\s*snapshot\s+([^\s%}]+)\s*-?%\}", 1))


def snapshot_scripts(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Like models, but the name stands in the script's opening tag."""
    return locate(files, projects, "snapshot_paths").select(
        "project", "file", "relative", F.lit("snapshot").alias("kind"),
        first_text(snapshot_name(F.col("value")), _stem()).alias("name"), F.col("value").alias("sql"))


def read_snapshot_sql(spark: SparkSession, paths, projects: DataFrame) -> DataFrame:
    return snapshot_scripts(_text_files(spark, paths, "*.{sql,SQL}"), projects)


def header_columns(line) -> Column:
    """Cells of a CSV header line."""
    cells = F.transform(F.split(line, ","), lambda c: F.regexp_replace(clean_scalar(c), r"\A\ufeff", ""))
    return F.filter(cells, lambda c: c != "")


def first_lines(lines: DataFrame) -> DataFrame:
    """First non-blank line per file from (file, at, value); min_by keeps one line per file and task."""
    return lines.where(trim_space("value") != "").groupBy("file").agg(F.min_by("value", "at").alias("line"))


def seed_headers(files: DataFrame, lines: DataFrame, projects: DataFrame) -> DataFrame:
    """Seed files: (project, file, relative, kind, name, header array); no line, no columns."""
    return locate(files.join(first_lines(lines), "file", "left"), projects, "seed_paths").select(
        "project", "file", "relative", F.lit("seed").alias("kind"), _stem().alias("name"),
        header_columns(F.coalesce("line", F.lit(""))).alias("header"))


def read_seed_headers(spark: SparkSession, paths, projects: DataFrame) -> DataFrame:
    """The lines stay splittable: a line's place is its block's start and its place in the task."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,CSV}").text(paths)
        .select(F.col("_metadata.file_path").alias("file"),
                F.struct(F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("line")).alias("at"), "value")
    )
    # an empty seed still is a table, so the files come from a listing (no content is read for it)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
              .option("pathGlobFilter", "*.{csv,CSV}").load(paths)
              .select(F.col("_metadata.file_path").alias("file")))
    return seed_headers(listed, lines, projects)


def file_entries(files: DataFrame, origin: Column) -> DataFrame:
    """Entries for files no YAML object describes."""
    return files.select(
        "project", "file", "kind", F.concat(origin, F.lit(":"), F.col("relative")).alias("uid"), "name",
        F.lit("").alias("source_name"), F.lit("").alias("schema"), _folder().alias("path_qualifier"),
        F.lit(0).cast("bigint").alias("ord"))


def finish_entries(rows: DataFrame) -> DataFrame:
    """Common entry columns of the schema-file path."""
    return rows.select(
        "project", "uid", "kind", F.col("kind").alias("resource_type"), "name", F.col("name").alias("ref_name"),
        "source_name", F.col("project").alias("package"), "schema", F.lit("").alias("database"),
        "path_qualifier", F.lit("").alias("original_file_path"), F.lit("").alias("path"),
        F.lit("").alias("relation_name"), "phase", "file", "ord").transform(with_names)
