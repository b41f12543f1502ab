"""Registered queries: a sample against the same query in SQL, and the shape of the registry."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from schemaloom.plans.registry import TABLES  # noqa: E402
from tools.compare import rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("check_unique", "check_relationship_composite", "column_profile", "domain_key", "parse_call", "read_manifest_tests",
          "constraint_flags", "resolve_relation", "finalize_relations", "group_signal", "infer_links", "hub_weight", "cte_edges")

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = db.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
