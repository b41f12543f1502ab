"""JSON-lines input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_space


def parse_json_lines(lines: DataFrame, schema: str, key: str, text: str = "value") -> DataFrame:
    """One object per line; blank lines, malformed lines and rows without the key go."""
    checked = f"{schema}, _broken string"
    parsed = F.from_json(F.col(text), checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return (
        lines.where(trim_space(text) != "")
        .withColumn("_row", parsed)
        .where(F.col("_row._broken").isNull() & F.col(f"_row.{key}").isNotNull() & (F.col(f"_row.{key}") != ""))
        .select(*[c for c in lines.columns if c != text], "_row.*")
        .drop("_broken")
    )


def read_json_lines(spark: SparkSession, paths, schema: str, key: str) -> DataFrame:
    """The reader form; the scan itself drops what cannot be parsed."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    return rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
