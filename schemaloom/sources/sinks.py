"""Writers."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def model_meta(stats: DataFrame, repo: str = "", branch: str = "") -> DataFrame:
    """Per project and mode: title, mode, source, counts, repo and branch."""
    title = F.concat("project", F.when(F.col("mode") == "lineage", " (lineage)").otherwise(""))
    return stats.select("project", "mode", title.alias("title"), "source", "tables", "relations", "columns",
                        "columns_typed", F.lit(repo).alias("repo"), F.lit(branch).alias("branch"))


def payload(row: DataFrame, *keys: str) -> DataFrame:
    """Rows -> (keys, JSON text) with '<' escaped for use inside a script element."""
    from ..functions.text import json_script_escape

    body = [c for c in row.columns if c not in keys]
    return row.select(*keys, json_script_escape(F.to_json(F.struct(*body))).alias("payload"))


# Rows of a file of a written model.
FILE_ROWS = 500_000
COMMITS = "version string, seq bigint, format string, parts array<struct<name:string, rows:bigint, files:int, schema:string>>"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """Finished writes, the latest first; none where nothing was written yet."""
    try:
        found = spark.read.schema(COMMITS).option("recursiveFileLookup", True).json(f"{path}/_commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], COMMITS)
    return found.orderBy(F.col("seq").desc(), "version")


def write_model(model: dict[str, DataFrame], path: str, fmt: str = "parquet", repo: str = "", branch: str = "", file_rows: int = FILE_ROWS) -> str:
    """One folder per part of the model, in files of about ``file_rows`` rows, and a commit that names them.

    Rows stay rows, in the order of project and place: many small projects share a file, a large one is
    several, and a reader of one project opens the files whose range holds it. The model's meta rows are a
    part of their own. Readers see a write once its commit is there and all of it then; a write that
    breaks off leaves the model as it was. Returns the version.
    """
    spark = next(iter(model.values())).sparkSession
    parts = dict(model)
    if "stats" in parts:
        parts["meta"] = model_meta(parts["stats"], repo, branch)
    last, version, written = _commits(spark, path).first(), uuid.uuid4().hex, []
    for part, rows in parts.items():
        count = rows.count()
        files = max(1, -(-count // file_rows))
        keys = [k for k in ("project", "mode", "ord", "table_name") if k in rows.columns]
        placed = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys) if files > 1 else rows.coalesce(1).sortWithinPartitions(*keys)
        placed.write.format(fmt).save(f"{path}/{version}/{part}")
        written.append((part, count, files, rows.schema.json()))
    commit = spark.createDataFrame([(version, (last["seq"] if last else 0) + 1, fmt, written)], COMMITS)
    commit.coalesce(1).write.json(f"{path}/_commits/{version}")
    return version


def read_model(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The parts of the latest finished write, or of a given one."""
    commits = _commits(spark, path)
    found = (commits.where(F.col("version") == version) if version else commits).first()
    if found is None:
        raise FileNotFoundError(f"no finished model below {path}")
    return {p["name"]: spark.read.schema(StructType.fromJson(json.loads(p["schema"]))).format(found["format"]).load(
        f"{path}/{found['version']}/{p['name']}") for p in found["parts"]}


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Ordered export lines -> text files, one folder per project, line order kept across files."""
    (lines.repartitionByRange("project", *order).sortWithinPartitions("project", *order)
     .select("project", "line").write.mode("overwrite").partitionBy("project").text(path))
