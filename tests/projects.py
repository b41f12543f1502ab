"""Two projects written to a folder: a reading room with compiled artifacts, a freight yard with schema files only."""

from __future__ import annotations

import json
from pathlib import Path


def _model(name, columns, package="rr", schema="circ", **more):
    uid = f"model.{package}.{name}"
    return uid, {"unique_id": uid, "resource_type": "model", "package_name": package, "name": name, "schema": schema,
                 "columns": {c: {"name": c, **spec} for c, spec in columns.items()}, **more}


def _declared_test(uid, name, deps, kwargs, attached=None):
    return uid, {"unique_id": uid, "resource_type": "test", "test_metadata": {"name": name, "kwargs": kwargs},
                 "attached_node": attached, "depends_on": {"nodes": [f"model.rr.{d}" for d in deps]}}


def write_artifact_project(root: Path) -> None:
    """Constraints as lists and as single objects, one name in two packages, a column only a test knows."""
    nodes = dict([
        _model("members", {"card_no": {"data_type": "varchar"}, "full_name": {}}),
        _model("titles", {"isbn": {}, "edition": {}}, constraints={"type": "primary_key", "columns": ["isbn", "edition"]}),
        _model("copies", {"barcode": {"constraints": {"type": "primary_key"}}, "isbn": {}, "edition": {}},
               constraints=[{"type": "foreign_key", "columns": ["isbn", "edition"], "to": "ref('titles')"}]),
        _model("loans", {"loan_no": {}, "card_no": {},
                         "barcode": {"constraints": [{"type": "foreign_key", "expression": "circ.copies (barcode)"}]}},
               depends_on={"nodes": ["model.rr.members", "model.rr.copies", "source.rr.desk.scans"]}),
        _model("fines", {"fine_no": {}}),
        _model("loans", {"loan_no": {}}, package="branch", schema="branch"),
        _model("draft", {"barcode": {}}, config={"materialized": "ephemeral"}, depends_on={"nodes": ["model.rr.copies"]}),
        _model("old_fines", {"fine_no": {}}, config={"enabled": False}),
        _declared_test("test.rr.a", "unique", ["members"], {"column_name": "card_no"}, "model.rr.members"),
        _declared_test("test.rr.b", "not_null", ["members"], {"column_name": "card_no"}, "model.rr.members"),
        _declared_test("test.rr.c", "relationships", ["loans", "members"],
                       {"column_name": "card_no", "to": "ref('members')", "field": "card_no"}, "model.rr.loans"),
        # the column comes from this test, so the next one finds its owner by it
        _declared_test("test.rr.d", "unique", ["fines"], {"column_name": "loan_ref"}, "model.rr.fines"),
        _declared_test("test.rr.e", "relationships", ["members", "fines", "loans"],
                       {"column_name": "loan_ref", "to": "ref('rr', 'loans')", "field": "loan_no"}),
    ])
    scans = {"unique_id": "source.rr.desk.scans", "resource_type": "source", "package_name": "rr", "source_name": "desk",
             "name": "scans", "schema": "desk", "columns": {c: {"name": c} for c in ("barcode", "scanned_at")}}
    catalog = {"nodes": {"model.rr.members": {"columns": {"FULL_NAME": {"name": "FULL_NAME", "type": "text"}}}},
               "sources": {scans["unique_id"]: {"columns": {"scanned_at": {"name": "scanned_at", "type": "timestamp"}}}}}
    files = {"dbt_project.yml": "name: reading_room\n", "dbt_packages/lent/dbt_project.yml": "name: lent\n",
             "target/manifest.json": json.dumps({"nodes": nodes, "sources": {scans["unique_id"]: scans}}),
             "target/catalog.json": json.dumps(catalog)}
    _write(root / "reading_room", files)


CORE = """
models:
  - name: carriers
    columns:
      - name: code
        tests: unique
        constraints:
          type: not_null
      - name: title
        data_type: varchar
  - name: ports
    columns: [{name: code, data_type: char(5), tests: [unique, not_null]}]
sources:
  - name: yard
    tables:
      - name: gates
        columns:
          - name: gate_no
          - name: port
            tests:
              relationships: {to: "ref('ports')", field: code}
"""

# Twenty columns; foreign keys on the sixteenth and the eighteenth.
KEYS = {15: ', constraints: {type: foreign_key, to: "ref(\'carriers\')", to_columns: [code]}',
        17: ', constraints: [{type: foreign_key, to: "ref(\'ports\')"}]'}
WIDE = "\n".join(["models:", "  - name: waybills", "    columns:",
                  *(f"      - {{name: c{n}{KEYS.get(n, '')}}}" for n in range(20)),
                  "  - name: legs", "    constraints: {type: foreign_key, columns: [port], to: \"ref('ports')\", to_columns: [code]}",
                  "    columns: [{name: leg_no}, {name: port}]", "  - {name: parked, enabled: false}", ""])

YARD = {
    "dbt_project.yml": "name: freight_yard\n",
    "models/a_core.yml": CORE,
    "models/b_wide.yml": WIDE,
    "models/carriers.sql": "select 'x' as code",
    "models/parked.sql": "select 0",
    "models/legs.sql": "select * from {{ source('yard', 'gates') }} g cross join {{ ref('carriers') }}",
    "models/north/delays.sql": "select * from {{ ref('ports') }}",
    "models/south/delays.sql": "select * from {{ ref('legs') }}",
    "seeds/tariffs.csv": "\nport,rate\nNLRTM,3\n",
    "snapshots/history.sql": "{% snapshot leg_states %} select * from {{ ref('legs') }} {% endsnapshot %}",
}


def write_schema_file_project(root: Path) -> None:
    """Two schema files, single values where lists are usual, two scripts of one name."""
    _write(root / "freight_yard", YARD)


def _write(folder: Path, files: dict[str, str]) -> None:
    for path, text in files.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(text)
