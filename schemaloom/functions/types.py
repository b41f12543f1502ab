"""Dialect type labels and the Spark types they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, trim_space

# The type a new column gets in each dialect.
DIALECT_DEFAULTS = {
    "postgres": "text",
    "mysql": "varchar(255)",
    "sqlite": "TEXT",
    "sqlserver": "nvarchar(255)",
    "snowflake": "VARCHAR",
}
# SQL type words per Spark type.
TYPE_WORDS = {
    "int": ("int", "integer", "serial", "mediumint"),
    "bigint": ("bigint", "bigserial"),
    "smallint": ("smallint",),
    "tinyint": ("tinyint",),
    "float": ("real", "float"),
    "double": ("double",),
    "string": ("text", "longtext", "varchar", "char", "nvarchar", "nchar", "string", "uuid",
               "uniqueidentifier", "inet", "enum", "xml", "time", "geography"),
    "boolean": ("boolean", "bool", "bit"),
    "timestamp": ("timestamptz", "timestamp_tz"),
    "timestamp_ntz": ("timestamp", "datetime", "datetime2", "timestamp_ntz"),
    "date": ("date",),
    "interval day to second": ("interval",),
    "variant": ("json", "jsonb", "variant", "object"),
    "array<string>": ("array",),
    "binary": ("bytea", "blob", "binary", "varbinary"),
}
DECIMAL_WORDS = ("numeric", "decimal", "number", "money")


def map_sql_type(label) -> Column:
    """Spark type name for a SQL type label, null when the label is unknown.

    The table is fixed and short, so it is a CASE in the scan's own stage instead of a join. The
    labels mean the same in every dialect; ``tinyint(1)`` is how MySQL spells boolean.
    """
    text = F.lower(trim_space(F.coalesce(as_col(label), F.lit(""))))
    word = F.regexp_extract(text, r"\A([a-z_0-9]+)", 1)
    precision = F.regexp_extract(text, r"\(\s*(\d+)", 1)
    scale = F.regexp_extract(text, r"\(\s*\d+\s*,\s*(\d+)", 1)
    decimal = F.concat(
        F.lit("decimal("), F.when(precision == "", "38").otherwise(precision), F.lit(","),
        F.when(scale == "", F.when((precision == "") & (word == "money"), "4").otherwise("0")).otherwise(scale),
        F.lit(")"))
    result = F.when(text.rlike(r"\Atinyint\s*\(\s*1\s*\)"), "boolean").when(word.isin(*DECIMAL_WORDS), decimal)
    for spark_type, words in TYPE_WORDS.items():
        result = result.when(word.isin(*words), spark_type)
    return result


def dialect_default(dialect) -> Column:
    dialect = as_col(dialect)
    result = F.lit(DIALECT_DEFAULTS["postgres"])
    for name, label in DIALECT_DEFAULTS.items():
        result = F.when(dialect == name, label).otherwise(result)
    return result
