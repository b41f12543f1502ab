"""Scripts -> tables, columns, edges and errors: one plan per format, and one that routes a mixed corpus."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mining
from ..session import cut_lineage


@dataclass(frozen=True)
class MinedDdl:
    """Parts of DDL scripts (ids, text). A part is worked out when it is asked for; what several read is written once."""

    scripts: DataFrame
    ids: list[str]
    text: str = "text"

    @cached_property
    def statements(self) -> DataFrame:
        return cut_lineage(mining.ddl_statements(self.scripts.select(*self.ids, self.text), self.ids, self.text))

    @cached_property
    def bodies(self) -> DataFrame:
        return cut_lineage(mining.ddl_bodies(self.statements, self.ids))

    @cached_property
    def items(self) -> DataFrame:
        return cut_lineage(mining.ddl_items(self.bodies, self.ids))

    @cached_property
    def tables(self) -> DataFrame:
        return mining.ddl_tables(self.bodies, self.ids)

    @cached_property
    def relations(self) -> DataFrame:
        return cut_lineage(mining.ddl_foreign_keys(self.statements, self.items, self.tables, self.ids))

    @cached_property
    def columns(self) -> DataFrame:
        return mining.ddl_columns(self.items, self.ids, self.relations)

    @cached_property
    def errors(self) -> DataFrame:
        return mining.ddl_errors(self.bodies, self.ids)


def mine_ddl(scripts: DataFrame, ids: list[str], text: str = "text") -> MinedDdl:
    """All DDL operators over one parse."""
    return MinedDdl(scripts, ids, text)


@dataclass(frozen=True)
class MinedScripts:
    """A corpus of scripts of any format: formats (ids, format); tables (ids, format, name), CTEs and the base tables
    they read among them; columns (ids, format, table_name, place, name); relations (ids, format, from_table, from_cols,
    to_table, to_cols, to_missing); errors (ids, format, error), one for each script or statement nothing can be read from."""

    formats: DataFrame
    tables: DataFrame
    columns: DataFrame
    relations: DataFrame
    errors: DataFrame


def mine_scripts(scripts: DataFrame, ids: list[str], text: str = "text", format: str | None = None) -> MinedScripts:
    """Classify each script (unless ``format`` names a column that says it) and read it by its format.

    Plain SQL is read as DDL, SQL with quoted dotted names behind a WITH as a chain of CTEs. Every other
    format, and a script that yields no table, becomes an error row, so that each script is accounted for.
    """
    told = mining.classify_format(text) if format is None else F.coalesce(F.nullif(F.trim(F.lower(format)), F.lit("")), mining.classify_format(text))
    kinds = cut_lineage(scripts.select(*ids, F.col(text).alias("text"), told.alias("format")))
    ddl = mine_ddl(kinds.where("format = 'sql'"), ids)
    bodies = cut_lineage(mining.cte_bodies(kinds.where("format = 'bigquery'"), ids))
    edges = cut_lineage(mining.cte_edges(bodies, ids))
    none = F.array().cast("array<string>")
    tables = ddl.tables.select(*ids, F.lit("sql").alias("format"), "name").unionByName(
        bodies.where("closed").select(*ids, "name").unionByName(edges.where("to_base").select(*ids, F.col("to_table").alias("name")))
        .groupBy(*ids, F.lower("name").alias("_key")).agg(F.min("name").alias("name")).drop("_key").withColumn("format", F.lit("bigquery")))
    names = ddl.tables.select(*ids, "table_key", F.col("name").alias("table_name"))
    columns = ddl.columns.join(names, [*ids, "table_key"]).select(
        *ids, F.lit("sql").alias("format"), "table_name", F.col("at").alias("place"), "name").unionByName(
        mining.cte_columns(bodies, ids).select(*ids, F.lit("bigquery").alias("format"), F.col("cte").alias("table_name"),
                                               (F.col("cte_no") * mining.IN_STATEMENT + F.col("col_no")).alias("place"), "name"))
    relations = ddl.relations.select(*ids, F.lit("sql").alias("format"), "from_table", "from_cols", "to_table", "to_cols", "to_missing").unionByName(
        edges.select(*ids, F.lit("bigquery").alias("format"), "from_table", none.alias("from_cols"), "to_table", none.alias("to_cols"),
                     F.lit(False).alias("to_missing")))
    open_ = ddl.errors.select(*ids, F.lit("sql").alias("format"), F.concat_ws(": ", "name", "error").alias("error")).unionByName(
        bodies.where("closed is null or not closed").select(*ids, F.lit("bigquery").alias("format"),
                                                            F.concat_ws(": ", "name", F.lit("unbalanced parentheses")).alias("error")))
    # scripts that no table and no other error accounts for
    read = tables.select(*ids).unionByName(open_.select(*ids)).distinct()
    silent = kinds.select(*ids, "format").join(read, ids, "left_anti").select(
        *ids, "format", F.when(F.col("format").isin("sql", "bigquery"), "no tables found").otherwise("format is not read").alias("error"))
    return MinedScripts(kinds.select(*ids, "format"), tables, columns, relations, open_.unionByName(silent))
