"""Project metadata -> finished model, for every project below a root at once."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.constraints import assemble_columns, constraint_flags, constraint_rows, test_flags
from ..operators.graph import lineage_from_artifacts, lineage_from_sql
from ..operators.grouping import model_stats
from ..operators.ordering import number_by, qualify_names
from ..operators.relations import (edge_order, finalize_relations, fk_from_constraint, fk_from_test, fk_from_yaml,
                                   mark_fk_columns, resolve_tests, union_edges)
from ..operators.resolve import exclude_skipped_files, first_of_name, match_file_to_entry
from ..functions.arrays import columns_from_map
from ..operators.export import export
from ..sources import artifacts, projects, schema_files
from ..sources.sinks import read_model
from ..session import cut_lineage


@dataclass(frozen=True)
class Model:
    """tables: project, uid, name, table_key, groups, ord. columns: project, table_name, name, type,
    flags, ord. relations: project, from/to with columns, to_missing, ord. stats: counts per project."""

    tables: DataFrame
    columns: DataFrame
    relations: DataFrame
    stats: DataFrame

    def parts(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _finish(entries: DataFrame, columns: DataFrame, raw: DataFrame, source: str, mode: str) -> Model:
    tables = entries.select("project", "uid", F.col("display_name").alias("name"),
                            F.lower("display_name").alias("table_key"), "groups", "ord")
    # flags, counts and the caller all read the edges
    relations = number_by(finalize_relations(raw, tables), ["project"], ["ord", "from_table", "to_table"], "ord")
    named = mark_fk_columns(columns, relations, tables).join(
        tables.select("project", "uid", F.col("name").alias("table_name"), "table_key"), ["project", "uid"])
    columns = named.select("project", "table_name", "table_key", "name", "type", F.col("type").alias("type_raw"),
                           "pk", "nn", "uniq", "fk", "ord")
    labels = {"source": F.lit(source), "mode": F.lit(mode)}
    tables, columns, relations = (d.withColumns(labels) for d in (tables, columns, relations))
    return Model(tables, columns, relations, model_stats(tables, columns, relations, ["project", "source", "mode"]))


def _column_constraints(rows: DataFrame) -> DataFrame:
    """Constraints written on columns of a manifest node."""
    entry = F.col("entry")
    return rows.select("project", "uid", F.posexplode(F.map_entries("column_map")).alias("pos", "entry")).select(
        "project", "uid", F.coalesce(F.nullif(F.trim(entry["value"]["name"]), F.lit("")), entry["key"]).alias("owner"),
        "pos", entry["value"]["constraints"].alias("constraints"))


def artifact_model(spark: SparkSession, root: str, lineage: bool = False) -> Model:
    """Compiled manifests and catalogs of all projects below the root."""
    known = projects.discover_projects(spark, root).select("project_dir", "project")
    return model_from_artifacts(artifacts.read_manifest(spark, root), artifacts.read_catalog_columns(spark, root),
                                known, lineage)


def model_from_artifacts(manifest: DataFrame, catalog: DataFrame, known: DataFrame, lineage: bool = False) -> Model:
    """Node rows, catalog rows and (project_dir, project) -> model."""
    # entries, tests and lineage read the nodes: the documents are parsed once, for all of them
    manifest = cut_lineage(manifest)
    entries = qualify_names(artifacts.read_entries(manifest).join(known, "project_dir").drop("project_dir"))

    declared = entries.select("project", "uid", F.explode(columns_from_map("column_map")).alias("c")).select(
        "project", "uid", "c.*")
    kinds = entries.select("project", "uid", "kind")
    catalog = (catalog.join(known, "project_dir")
               .join(kinds, ["project", "uid", "kind"], "left_semi").select("project", "uid", "name", "type", "pos"))
    catalog = cut_lineage(catalog)
    tests = artifacts.read_manifest_tests(manifest).join(known, "project_dir").drop("project_dir")
    seen = declared.select("project", "uid", "name").unionByName(catalog.select("project", "uid", "name"))

    owned = cut_lineage(resolve_tests(tests, entries, seen))
    flags = test_flags(owned.where(F.col("owner").isNotNull()).withColumn("uid", F.col("owner.uid")))
    if lineage:
        columns = assemble_columns(declared, catalog, flags)
        raw = lineage_from_artifacts(entries)
        return _finish(entries, columns, raw, "manifest", "lineage")
    constraints = constraint_rows(entries, _column_constraints(entries))
    # three operators read the columns from here on, so they are computed once
    columns = cut_lineage(assemble_columns(declared, catalog, flags, constraint_flags(constraints)))
    raw = union_edges(fk_from_test(owned), fk_from_constraint(constraints, entries, columns))
    return _finish(entries, columns, raw, "manifest", "erd")


def schema_file_model(spark: SparkSession, root: str, lineage: bool = False,
                      compiled: DataFrame | None = None) -> Model:
    """Schema YAML, model SQL, seeds and snapshots of the projects below the root.

    ``compiled``: project folders to leave out, because their artifacts say it better.
    """
    known = projects.discover_projects(spark, root)
    if compiled is not None:
        known = known.join(compiled, "project_dir", "left_anti")
    every = schema_files.read_schema_yaml(spark, root, known, root)
    objects = cut_lineage(every.where("not skipped"))
    skipped = every.where("skipped").select("project", "kind", "name")
    models = schema_files.read_model_sql(spark, root, known)
    snapshots = schema_files.read_snapshot_sql(spark, root, known)
    seeds = schema_files.read_seed_headers(spark, root, known)

    declared_entries = objects.drop("object", "skipped").withColumn("phase", F.lit(0))
    files = []
    for rows, origin, phase in ((models, "model.sql", 1), (seeds, "seed.csv", 2), (snapshots, "snapshot.sql", 3)):
        kept = exclude_skipped_files(rows.where(~projects.below_skipped_dir("file", root)), skipped)
        matched = match_file_to_entry(first_of_name(kept, declared_entries), declared_entries)
        files.append((matched.withColumnRenamed("uid", "known"), origin, phase))
    fresh = [schema_files.file_entries(rows.where("known is null and relative = stands_in"), F.lit(origin)).withColumn("phase", F.lit(phase))
             for rows, origin, phase in files]
    entries = declared_entries.select(*fresh[0].columns)
    for more in fresh:
        entries = entries.unionByName(more)
    # tables in the order they are met: declared ones by file and place, then files
    entries = number_by(schema_files.finish_entries(entries), ["project"], ["phase", "file", "ord", "uid"], "ord")
    entries = qualify_names(entries)

    uid = F.coalesce("known", F.concat(F.lit("seed.csv:"), F.col("stands_in")))
    header = files[1][0].select("project", uid.alias("uid"), F.posexplode("header").alias("pos", "name"))
    yaml_cols = schema_files.yaml_columns(objects)
    tests = schema_files.yaml_tests(objects)
    flags = test_flags(tests)
    # declared first, then columns only tests know, then header cells: the order they are met in
    declared = yaml_cols.select("project", "uid", "name", "type", "pos")
    names = entries.select("project", "uid", "display_name", F.col("ord").alias("_entry"))
    if lineage:
        scripts = None
        for rows, origin, phase in (files[0], files[2]):
            own = F.coalesce("known", F.concat(F.lit(f"{origin}:"), F.col("stands_in")))
            place = F.struct(F.lit(phase).alias("phase"), "file")
            part = rows.select("project", own.alias("uid"), "sql", place.alias("ord")).join(
                names, ["project", "uid"]).select("project", F.col("display_name").alias("to_table"), "sql", "ord")
            scripts = part if scripts is None else scripts.unionByName(part)
        columns = assemble_columns(declared, tests=flags, header=header)
        return _finish(entries, columns, lineage_from_sql(scripts, entries), "yml", "lineage")
    on_columns = yaml_cols.select("project", "uid", F.col("name").alias("owner"), "pos", "constraints")
    constraints = constraint_rows(objects.select("project", "uid", F.col("object.constraints").alias("constraints")),
                                  on_columns)
    columns = cut_lineage(assemble_columns(declared, tests=flags, header=header,
                                           constraints=constraint_flags(constraints)))
    specs = (tests.where((F.col("test") == "relationships") & (F.col("column") != "") & (F.col("target") != ""))
             .join(names, ["project", "uid"])
             .select("project", F.col("display_name").alias("from_table"), "column", F.col("target").alias("to_text"),
                     "field", edge_order(0, "_entry", "pos").alias("ord")))
    raw = union_edges(fk_from_yaml(specs, entries), fk_from_constraint(constraints, entries, columns))
    return _finish(entries, columns, raw, "yml", "erd")


def fleet_model(spark: SparkSession, root: str, lineage: bool = False) -> Model:
    """Artifacts where a project has them, schema files for the rest."""
    compiled = artifacts.compiled_projects(spark, root)
    parts = artifact_model(spark, root, lineage), schema_file_model(spark, root, lineage, compiled)
    return Model(*[a.unionByName(b) for a, b in zip(*(list(p.parts().values()) for p in parts), strict=True)])


def stored_model(spark: SparkSession, path: str) -> Model:
    """The model ``sinks.write_model`` wrote last."""
    parts = read_model(spark, path)
    return Model(*[parts[f.name] for f in fields(Model)])


def export_model(model: Model, kind: str) -> DataFrame:
    """A model's tables, columns and edges as ordered lines of a text format (``operators.export``)."""
    tables = model.tables.select("project", "name", "table_key", F.col("ord").alias("t_ord"))
    columns = model.columns.join(tables.select("project", "table_key", "t_ord"), ["project", "table_key"])
    return export(kind, tables.drop("table_key"), columns, model.relations)
