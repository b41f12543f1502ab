"""Compiled artifacts: one manifest and one optional catalog per project, many projects per scan.

Every file is read with an explicit schema, so nothing is inferred and unused fields are never
parsed. A file of usual size is one task, whose node map is exploded right after the scan; a large one is
taken apart by several tasks (``split_json``). The rows travel on their own from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import merge_test_args
from ..functions.keys import build_group_keys
from ..functions.predicates import is_disabled, is_skipped, is_table_resource
from ..functions.text import entry_base_name, first_text, physical_name, test_name
from .split_json import split_members

COLUMN = "name string, data_type string, type string, dtype string, constraints string"
NODE = (
    "unique_id string, resource_type string, package_name string, source_name string, name string, "
    "alias string, identifier string, relation_name string, schema string, database string, "
    "original_file_path string, path string, enabled boolean, materialized string, "
    "config struct<enabled:boolean, materialized:string>, "
    f"columns map<string, struct<{COLUMN}>>, constraints string, "
    "depends_on struct<nodes:array<string>>, attached_node string, column_name string, "
    "test_metadata struct<name:string, kwargs:string>"
)
MANIFEST = f"nodes map<string, struct<{NODE}>>, sources map<string, struct<{NODE}>>"
CATALOG_NODE = "columns map<string, struct<name:string, type:string>>"
CATALOG = f"nodes map<string, struct<{CATALOG_NODE}>>, sources map<string, struct<{CATALOG_NODE}>>"

# Position bases that keep nodes ahead of sources when rows are put back in file order.
SOURCE_BASE = 1 << 40


def _project_dir(artifact: str) -> Column:
    """Folder above ``target/<artifact>``."""
    return F.regexp_replace(F.col("_metadata.file_path"), rf"/target/{artifact}\z", "")


def _members(nodes: Column, kind: str, base: int) -> Column:
    """Entries of a node map as (kind, pos, key, value), null maps as none."""
    return F.coalesce(F.transform(F.map_entries(nodes), lambda e, i: F.struct(
        F.lit(kind).alias("kind"), (i + F.lit(base).cast("bigint")).alias("pos"), e["key"].alias("key"), e["value"].alias("value"))), F.array())


def manifest_rows(documents: DataFrame) -> DataFrame:
    """Parsed manifests (project_dir, nodes, sources) -> one row per node: (project_dir, kind, pos, key, node).

    Nodes and sources come from one explode, so that a document is parsed once for both.
    """
    both = F.concat(_members(F.col("nodes"), "model", 0), _members(F.col("sources"), "source", SOURCE_BASE))
    return documents.select("project_dir", F.inline(both)).withColumnRenamed("value", "node")


# Files above this size (bytes) are taken apart by several tasks.
SPLIT_FROM = 1 << 26


def _whole(spark: SparkSession, paths, name: str, schema: str, most: int) -> DataFrame:
    """Documents of at most so many bytes, one task each."""
    return (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", name).json(paths).where(F.col("_metadata.file_size") <= most)
            .select(_project_dir(name).alias("project_dir"), "nodes", "sources"))


def _split(spark: SparkSession, paths, name: str, member: str, more_than: int, source_base: int) -> DataFrame:
    """Members of larger documents: (project_dir, kind, pos, key, value)."""
    found = split_members(spark, paths, name, more_than).where(F.col("section").isin("nodes", "sources"))
    is_source = F.col("section") == "sources"
    return found.select(
        F.regexp_replace("file", rf"/target/{name}\z", "").alias("project_dir"), F.when(is_source, "source").otherwise("model").alias("kind"),
        (F.col("pos") + F.when(is_source, source_base).otherwise(0).cast("bigint")).alias("pos"), "key", F.from_json("text", member).alias("value"))


def _any_larger(spark: SparkSession, paths, name: str, than: int) -> bool:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(paths)
    return not files.where(F.col("length") > than).select("path").isEmpty()


def read_manifest(spark: SparkSession, paths, split_from: int = SPLIT_FROM) -> DataFrame:
    """Manifest files below the paths -> node rows; a file of more than ``split_from`` bytes is read by several tasks."""
    rows = manifest_rows(_whole(spark, paths, "manifest.json", MANIFEST, split_from))
    if _any_larger(spark, paths, "manifest.json", split_from):
        rows = rows.unionByName(_split(spark, paths, "manifest.json", NODE, split_from, SOURCE_BASE).withColumnRenamed("value", "node"))
    return rows


def parse_manifests(documents: DataFrame, text: str = "text") -> DataFrame:
    """Manifests kept as texts in a table (project_dir, text) -> node rows."""
    return manifest_rows(documents.select("project_dir", F.from_json(text, MANIFEST).alias("m"))
                         .select("project_dir", "m.nodes", "m.sources"))


def compiled_projects(spark: SparkSession, root) -> DataFrame:
    """Folders of the projects that have a manifest, from the file listing alone."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "manifest.json").load(root)
            .where(F.col("_metadata.file_path").rlike(r"/target/manifest\.json\z"))
            .select(_project_dir("manifest.json").alias("project_dir")))


def _entries(rows: DataFrame) -> DataFrame:
    node = F.col("node")
    uid = first_text(node["unique_id"], F.col("key"))
    tail = F.substring_index(F.col("uid"), ".", -1)
    source_part = F.coalesce(F.try_element_at(F.split(F.col("uid"), r"\."), F.lit(-2)), F.lit(""))
    is_source = F.col("kind") == "source"
    return (
        rows.withColumn("uid", uid)
        .select(
            "project_dir", "uid", "kind",
            F.when(is_source, "source").otherwise(first_text(node["resource_type"])).alias("resource_type"),
            physical_name("kind", node["alias"], node["identifier"], node["relation_name"], node["name"],
                          "uid").alias("name"),
            first_text(node["name"], tail).alias("ref_name"),
            F.when(is_source, first_text(node["source_name"], source_part)).otherwise("").alias("source_name"),
            first_text(node["package_name"]).alias("package"),
            first_text(node["schema"]).alias("schema"),
            first_text(node["database"]).alias("database"),
            F.lit("").alias("path_qualifier"),
            first_text(node["original_file_path"]).alias("original_file_path"),
            first_text(node["path"]).alias("path"),
            first_text(node["relation_name"]).alias("relation_name"),
            F.col("pos").alias("ord"),
            F.coalesce(node["depends_on"]["nodes"], F.array().cast("array<string>")).alias("depends_on"),
            node["columns"].alias("column_map"),
            node["constraints"].alias("constraints"),
        )
        .transform(with_names)
    )


def with_names(entries: DataFrame) -> DataFrame:
    """Base name and group keys, shared by both metadata paths."""
    return entries.withColumn("base_name", entry_base_name("kind", "source_name", "name")).withColumn(
        "groups", build_group_keys("kind", "resource_type", "source_name", "ref_name", "name", "base_name",
                                   "schema", "path_qualifier", "original_file_path", "path"))


def _skipped() -> Column:
    node = F.col("node")
    return is_skipped("kind", node["enabled"], node["config"]["enabled"], node["materialized"],
                      node["config"]["materialized"])


def read_entries(manifest: DataFrame) -> DataFrame:
    """Everything that is a table: models, seeds, snapshots and sources, skipped ones left out."""
    table = (F.col("kind") == "source") | is_table_resource(F.col("node.resource_type"))
    return _entries(manifest.where(table & ~_skipped()))


def read_manifest_nodes(manifest: DataFrame) -> DataFrame:
    """Models, seeds and snapshots that exist in the warehouse."""
    return _entries(manifest.where(
        (F.col("kind") == "model") & is_table_resource(F.col("node.resource_type")) & ~_skipped()))


def read_manifest_sources(manifest: DataFrame) -> DataFrame:
    return _entries(manifest.where((F.col("kind") == "source") & ~_skipped()))


def read_manifest_tests(manifest: DataFrame) -> DataFrame:
    """Enabled declared tests: (project_dir, test_id, pos, test, column, target, field, attached, deps)."""
    node = F.col("node")
    kwargs = node["test_metadata"]["kwargs"]

    def arg(key):
        return merge_test_args(kwargs, key)

    return (
        manifest.where(
            (F.col("kind") == "model") & (first_text(node["resource_type"]) == "test")
            & ~is_disabled(node["enabled"], node["config"]["enabled"]))
        .select(
            "project_dir", F.col("key").alias("test_id"), "pos",
            test_name(node["test_metadata"]["name"]).alias("test"),
            first_text(node["column_name"], arg("column_name"), arg("column")).alias("column"),
            first_text(arg("to")).alias("target"),
            first_text(arg("field")).alias("field"),
            first_text(node["attached_node"]).alias("attached"),
            F.coalesce(node["depends_on"]["nodes"], F.array().cast("array<string>")).alias("deps"),
        )
        .where(F.col("test") != "")
    )


def catalog_rows(documents: DataFrame) -> DataFrame:
    """Parsed catalogs (project_dir, nodes, sources) -> (project_dir, kind, uid, pos, name, type)."""
    both = F.concat(_members(F.col("nodes"), "model", 0), _members(F.col("sources"), "source", 0))
    return _catalog_columns(documents.select("project_dir", F.inline(both)))


def _catalog_columns(members: DataFrame) -> DataFrame:
    return (members.select("project_dir", "kind", F.col("key").alias("uid"), F.posexplode(F.map_entries("value.columns")).alias("pos", "column"))
            .select("project_dir", "kind", "uid", F.col("pos").cast("bigint").alias("pos"),
                    first_text(F.col("column.value.name"), F.col("column.key")).alias("name"),
                    first_text(F.col("column.value.type")).alias("type"))
            .where(F.col("name") != ""))


def read_catalog_columns(spark: SparkSession, paths, split_from: int = SPLIT_FROM) -> DataFrame:
    """Warehouse column types. No catalog file below the paths, no rows."""
    rows = catalog_rows(_whole(spark, paths, "catalog.json", CATALOG, split_from))
    if _any_larger(spark, paths, "catalog.json", split_from):
        rows = rows.unionByName(_catalog_columns(_split(spark, paths, "catalog.json", CATALOG_NODE, split_from, 0)))
    return rows


def parse_catalogs(documents: DataFrame, text: str = "text") -> DataFrame:
    """Catalogs kept as texts in a table."""
    return catalog_rows(documents.select("project_dir", F.from_json(text, CATALOG).alias("c"))
                        .select("project_dir", "c.nodes", "c.sources"))
