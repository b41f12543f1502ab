"""Finding projects below a root and reading their settings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_col, first_text, json_text_list
from ..session import cut_lineage, ship

# Fixed value: the file that makes a folder a project.
PROJECT_FILE = "dbt_project.yml"
# Folders that hold built or vendored files.
SKIP_DIRS = ("node_modules", ".git", "target", "dbt_packages", "venv", ".venv")

SETTINGS = {
    "model_paths": "models",
    "seed_paths": "seeds",
    "snapshot_paths": "snapshots",
}


class _PlainLoader(yaml.SafeLoader):
    """YAML 1.2 scalars: only true/false are booleans, dates stay text."""


class _FastLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """The same over the parser in C, where there is one."""


for _loader in (_PlainLoader, _FastLoader):
    _loader.yaml_implicit_resolvers = {
        first: [(tag, rule) for tag, rule in rules
                if tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")]
        for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    _loader.add_implicit_resolver(
        "tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def _loaded(content: bytes):
    """A document. The parsers differ on tabs, tags and comments right behind a block mark, and in error texts; there Python's word counts."""
    if any(mark in content for mark in (b"\t", b"!", b"|#", b">#")):
        return yaml.load(content, Loader=_PlainLoader)
    try:
        return yaml.load(content, Loader=_FastLoader)
    except yaml.YAMLError:
        return yaml.load(content, Loader=_PlainLoader)


def _yaml_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        documents, errors = [], []
        for content in batch["content"]:
            try:
                documents.append(json.dumps(_loaded(bytes(content)) or {}, default=str))
                errors.append(None)
            except yaml.YAMLError as error:
                documents.append(None)
                errors.append(str(error))
        yield pd.DataFrame({"file": batch["file"], "document": documents, "error": errors})


def below_skipped_dir(file, root: str | None = None) -> Column:
    """True when a folder of the path, counted from the root, holds built or vendored files."""
    file = as_col(file)
    inside = F.substring_index(file, root.rstrip("/"), -1) if root else file
    return F.arrays_overlap(F.split(F.regexp_replace(inside, r"/[^/]*\z", ""), "/"),
                            F.array(*[F.lit(d) for d in SKIP_DIRS]))


def yaml_documents(files: DataFrame) -> DataFrame:
    """(file, content) -> (file, document JSON, error). The one place of the readers that runs Python on rows."""
    ship(files.sparkSession)
    return files.select("file", "content").mapInPandas(_yaml_batches, "file string, document string, error string")


def listed(spark: SparkSession, paths, glob: str, root: str | None = None) -> DataFrame:
    """Files by name, from the listing alone; those in built or vendored folders below the root are left out.

    The condition is on the path, which the file source knows before it opens anything: content read
    further on is read of the remaining files only.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(paths).withColumn("file", F.col("_metadata.file_path")))
    return files.where(~below_skipped_dir(F.col("_metadata.file_path"), root))


def read_yaml(spark: SparkSession, paths, glob: str, root: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Decoded documents, each file once: they are written, and whoever reads them parses no YAML again.

    ``wanted`` (file) keeps what Python sees to these files.
    """
    files = listed(spark, paths, glob, root).select("file", "content")
    if wanted is not None:
        files = files.join(wanted.select("file"), "file", "left_semi")
    return cut_lineage(yaml_documents(files))


def project_settings(projects: DataFrame) -> DataFrame:
    """Settings document -> project name and its folders, with defaults.

    Input columns: project_dir, document (JSON). Dashed keys win over underscored ones.
    """
    document = F.col("document")

    def folders(key: str, default: str) -> Column:
        raw = F.coalesce(F.get_json_object(document, f"$['{key.replace('_', '-')}']"),
                         F.get_json_object(document, f"$['{key}']"))
        listed = F.filter(F.transform(json_text_list(raw), lambda x: first_text(x)), lambda x: x != "")
        # an explicit list stands even when it is empty; only a missing or blank value takes the default
        return F.when(raw.startswith("[") | (F.size(listed) > 0), listed).otherwise(F.array(F.lit(default)))

    name = first_text(F.get_json_object(document, "$.name"), F.substring_index("project_dir", "/", -1))
    return projects.select("project_dir", name.alias("project"),
                           *[folders(k, d).alias(k) for k, d in SETTINGS.items()])


def find_projects(files: DataFrame, root: str) -> DataFrame:
    """Settings documents (file, document) -> projects, vendored copies left out."""
    found = files.where(~below_skipped_dir(F.col("file"), root))
    return project_settings(found.select(
        F.regexp_replace("file", r"/[^/]*\z", "").alias("project_dir"),
        F.coalesce("document", F.lit("{}")).alias("document")))


def discover_projects(spark: SparkSession, root: str) -> DataFrame:
    """Every project below the root with its settings."""
    return find_projects(read_yaml(spark, root, PROJECT_FILE, root), root)


def pick_source(manifest: DataFrame, schema_files: DataFrame, key: str = "project") -> DataFrame:
    """Per project: rows of the compiled artifacts win, rows of the schema files fill in."""
    return manifest.unionByName(schema_files.join(manifest.select(key).distinct(), key, "left_anti"))
