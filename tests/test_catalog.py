"""Registered queries: names, and a sample checked against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from voxloom.plans import catalog
from tools.check import rows_of

SAMPLE = (
    "scan_products", "normalize_appstore", "pii_stats", "write_reviews", "dedupe_last_wins", "newest_first", "top_clusters",
    "token_budget", "embed_budget", "assign_windows", "idempotency_decision", "counts_by_store", "parse_iso_week",
    "degrade_broken_files", "landed_reviews", "density_cluster", "delivery_plan", "ledger_upsert", "stream_rolling_counts", "render_all", "cluster_stats", "build_prompts")


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for file in os.listdir(sf):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    return connection


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalog.QUERIES) == 115


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    rows = entry.entry(spark)
    assert set(rows.columns) == {"product", "iso_year", "iso_week", "total", "appstore", "playstore"} and rows.count() > 0
