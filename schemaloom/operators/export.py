"""Text exports as ordered lines.

An export is rows (project, section, t_ord, c_ord, line). Lines of a project in that order are the
file. Nothing is glued into one string: the largest project is sorted and written like any other data
(``sources.sinks.write_lines``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import first_column
from ..functions.text import as_col, dbml_type, json_quote, mermaid_name, mermaid_type, quote
from .ordering import unique_alias
from .relations import export_edges

ORDER = ["section", "t_ord", "c_ord"]
# Places of a table's opening line, the rule between keys and the rest, and its closing lines.
OPEN, RULE, CLOSE, AFTER = -1, (1 << 61), (1 << 62), (1 << 62) + 1


def _lines(rows: DataFrame, section: int, t_ord, c_ord, line: Column) -> DataFrame:
    return rows.select("project", F.lit(section).alias("section"), as_col(t_ord).cast("bigint").alias("t_ord"),
                       as_col(c_ord).cast("bigint").alias("c_ord"), line.alias("line"))


def _fixed(tables: DataFrame, section: int, texts: list[str]) -> DataFrame:
    """Lines every project has once."""
    each = tables.select("project").distinct().select("project", F.posexplode(F.array(*[F.lit(t) for t in texts]))
                                                      .alias("pos", "text"))
    return _lines(each, section, F.lit(0), "pos", F.col("text"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _suffix(texts: list[Column], joiner: str, before: str, after: str = "") -> Column:
    """Non-null texts joined and wrapped; blank when there are none."""
    kept = F.filter(F.array(*texts), lambda t: t.isNotNull())
    return F.when(F.size(kept) > 0, F.concat(F.lit(before), F.array_join(kept, joiner), F.lit(after))).otherwise("")


def to_mermaid(tables: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    """Entity blocks with key marks, then ``parent ||--o{ child : "column"``.

    ``tables``: project, name, t_ord. ``columns``: project, t_ord, ord, name, type, pk, fk, uniq, nn.
    ``relations``: project, ord, from_table, from_cols, to_table, to_cols, to_missing.
    """
    marks = _suffix([F.when(F.col("pk"), "PK"), F.when(F.col("fk"), "FK"),
                     F.when(F.col("uniq") & ~F.col("pk"), "UK")], ",", " ")
    first = first_column("from_cols")
    label = json_quote(F.when(first == "", "fk").otherwise(first))
    return _union([
        _fixed(tables, 0, ["erDiagram"]),
        _lines(tables, 1, "t_ord", F.lit(OPEN), F.concat(F.lit("    "), mermaid_name("name"), F.lit(" {"))),
        _lines(columns, 1, "t_ord", "ord", F.concat(
            F.lit("        "), mermaid_type("type"), F.lit(" "), mermaid_name("name"), marks)),
        _lines(tables, 1, "t_ord", F.lit(CLOSE), F.lit("    }")),
        _lines(export_edges(relations), 2, "ord", F.lit(0), F.concat(
            F.lit("    "), mermaid_name("to_table"), F.lit(" ||--o{ "), mermaid_name("from_table"), F.lit(" : "),
            label)),
    ])


def to_dbml(tables: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    """Table blocks with settings, then one Ref per edge on its first columns."""
    settings = _suffix([F.when(F.col("pk"), "pk"), F.when(F.col("uniq") & ~F.col("pk"), "unique"),
                        F.when(F.col("nn") & ~F.col("pk"), "not null")], ", ", " [", "]")
    return _union([
        _lines(tables, 1, "t_ord", F.lit(OPEN), F.concat(F.lit("Table "), quote("name"), F.lit(" {"))),
        _lines(columns, 1, "t_ord", "ord", F.concat(
            F.lit("  "), quote("name"), F.lit(" "), dbml_type("type"), settings)),
        _lines(tables, 1, "t_ord", F.lit(CLOSE), F.lit("}")),
        _lines(tables, 1, "t_ord", F.lit(AFTER), F.lit("")),
        _lines(export_edges(relations, columns_needed=True), 2, "ord", F.lit(0), F.concat(
            F.lit("Ref: "), quote("from_table"), F.lit("."), quote(first_column("from_cols")), F.lit(" > "),
            quote("to_table"), F.lit("."), quote(first_column("to_cols")))),
    ])


def to_plantuml(tables: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities with the key block first, under aliases that stay unique per project."""
    aliases = unique_alias(tables.select("project", "name", "t_ord"), ["project"], "t_ord").select(
        "project", "t_ord", F.lower("name").alias("key"), "name", "alias")
    sides = columns.groupBy("project", "t_ord").agg(
        F.bool_or("pk").alias("has_key"), F.bool_or(~F.col("pk")).alias("has_rest"))
    a = aliases.select("project", F.col("key").alias("_from"), F.col("alias").alias("_a"))
    b = aliases.select("project", F.col("key").alias("_to"), F.col("alias").alias("_b"))
    edges = (export_edges(relations).withColumn("_from", F.lower("from_table")).withColumn("_to", F.lower("to_table"))
             .join(a, ["project", "_from"]).join(b, ["project", "_to"]))
    described = F.concat(F.col("name"), F.lit(" : "), F.coalesce("type", F.lit("")))
    return _union([
        _fixed(tables, 0, ["@startuml", "hide circle", "skinparam linetype ortho", ""]),
        _lines(aliases, 1, "t_ord", F.lit(OPEN), F.concat(
            F.lit("entity "), json_quote("name"), F.lit(" as "), F.col("alias"), F.lit(" {"))),
        _lines(columns.where("pk"), 1, "t_ord", "ord", F.concat(F.lit("  * "), described, F.lit(" <<PK>>"))),
        _lines(sides.where("has_key and has_rest"), 1, "t_ord", F.lit(RULE), F.lit("  --")),
        _lines(columns.where("not pk"), 1, "t_ord", F.col("ord") + F.lit(RULE + 1), F.concat(
            F.lit("  "), described, F.when(F.col("fk"), " <<FK>>").otherwise(""))),
        _lines(tables, 1, "t_ord", F.lit(CLOSE), F.lit("}")),
        _lines(tables, 1, "t_ord", F.lit(AFTER), F.lit("")),
        _lines(edges, 2, "ord", F.lit(0), F.concat("_b", F.lit(" ||--o{ "), "_a")),
        _fixed(tables, 3, ["@enduml"]),
    ])


# Label, file extension and function of each format.
FORMATS: dict[str, tuple[str, str, Callable[..., DataFrame]]] = {
    "mermaid": ("Mermaid", "mmd", to_mermaid),
    "dbml": ("DBML", "dbml", to_dbml),
    "plantuml": ("PlantUML", "puml", to_plantuml),
}


def export(fmt: str, tables: DataFrame, columns: DataFrame, relations: DataFrame) -> DataFrame:
    """Lines of a format; an unknown format has none."""
    if fmt not in FORMATS:
        return to_dbml(tables, columns, relations).limit(0)
    return FORMATS[fmt][2](tables, columns, relations)
