"""Given tables as a model: their own schemas, so that links can be inferred and then verified on their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.checks import verify_links
from ..operators.links import infer_links

COLUMNS = "project string, table_key string, name string, type string, pk boolean, ord bigint"


def live_columns(datasets: dict[str, DataFrame], keys: dict[str, str], project: str = "live") -> tuple[DataFrame, DataFrame]:
    """(tables, columns) as the link rules read them; ``keys`` names the key column of each table that has one.

    Only schemas are looked at, which the driver knows already.
    """
    spark = next(iter(datasets.values())).sparkSession
    tables = [(project, name.lower(), i) for i, name in enumerate(datasets)]
    columns = [(project, name.lower(), column, kind, keys.get(name) == column)
               for name, df in datasets.items() for column, kind in df.dtypes]
    return (spark.createDataFrame(tables, "project string, table_key string, ord bigint"),
            spark.createDataFrame([(*row, i) for i, row in enumerate(columns)], COLUMNS))


def found_links(datasets: dict[str, DataFrame], keys: dict[str, str], known: DataFrame | None = None) -> DataFrame:
    """Links inferred from the names of the given tables' columns, each with the share of its values found."""
    tables, columns = live_columns(datasets, keys)
    return verify_links(infer_links(columns, tables, known), datasets)
