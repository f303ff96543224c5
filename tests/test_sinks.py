"""What is written can be read back, saves replace only their own runs, and step tables can be dropped."""

import datetime as dt
import os

from pyspark.sql import functions as F

from voxloom.operators import readside, render
from voxloom.schemas import PRODUCT, REPORT, RUN_KEY
from voxloom.session import durable, release, scratch_path
from voxloom.sources import review_store

STATS = (3, 2, 1, 1, 0, 1, 1, 1, (10, 5, 0.1))


def report(product, week, name):
    quote = ("q \"x\"", "r1", 5, "appstore", dt.datetime(2026, 6, 2), True)
    theme = (name, "About", [quote], [("Do...", "Do it", name)], 3, 0)
    return (product, product.upper(), 2026, week, dt.datetime(2026, 6, 8), dt.datetime(2026, 3, 29), dt.datetime(2026, 6, 7),
            [theme], STATS)


def test_reports(spark):
    path = scratch_path(spark, "reports")
    review_store.write_reports(spark.createDataFrame([report("p", 23, "A"), report("p", 24, "B")], REPORT), path)
    review_store.write_reports(spark.createDataFrame([report("p", 24, "C")], REPORT), path)
    rows = {r["iso_week"]: r for r in review_store.read_reports(spark, path).collect()}
    assert {w: r["themes"][0]["name"] for w, r in rows.items()} == {23: "A", 24: "C"}
    assert rows[23]["themes"][0]["quotes"][0]["date"] == dt.datetime(2026, 6, 2)
    assert rows[23]["stats"]["llm_usage"]["estimated_cost_usd"] == 0.1


def test_markdown(spark):
    path = scratch_path(spark, "markdown")
    reports = spark.createDataFrame([report("p", 23, "A"), report("q", 24, "B")], REPORT)
    texts = render.report_markdown(reports, "Weekly")
    review_store.write_markdown(texts, path)
    back = spark.read.text(path, wholetext=True)
    got = {r["product"]: r["value"] for r in back.collect()}
    assert got == {r["product"]: r["text"] + "\n" for r in texts.collect()}
    assert got["p"].startswith("# Weekly\n\n## Top Themes\n### 1. A (3 reviews)\n")


def test_snapshot(spark):
    path = scratch_path(spark, "snapshot")
    products = spark.createDataFrame([("p", "P", "", "", "d1", "", [])], PRODUCT)
    reports = spark.createDataFrame([report("p", 23, "A")], REPORT)
    ledger = spark.createDataFrame([("p", 2026, 23, "r1"), ("p", 2026, 24, "r2")], "product string, iso_year int, iso_week int, run_id string")
    runs = readside.runs_with_preview(ledger, products, reports)
    review_store.write_snapshot(runs, readside.reports_with_product(reports, products), path)
    listed = {r["run_id"]: r for r in spark.read.schema(runs.schema).json(f"{path}/runs").collect()}
    assert listed["r1"]["preview"]["quote"] == 'q "x"' and listed["r2"]["preview"] is None and listed["r2"]["doc_id"] == "d1"
    one = spark.read.json(f"{path}/reports").first()
    assert (one["product"], one["iso_week"], one["doc_id"]) == ("p", 23, "d1")


def test_hot_run_is_saved_whole(spark):
    path = scratch_path(spark, "hot")
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, "q").otherwise("p").alias("product"), F.lit(2026).alias("iso_year"),
        F.lit(23).alias("iso_week"), F.col("id").cast("string").alias("id"))
    review_store.write_reviews(rows, path)
    back = review_store.read_reviews(spark, path)
    assert back.count() == 5000 and set(RUN_KEY) <= set(back.columns)


def test_step_tables_are_dropped(spark):
    frame = durable(spark.range(10))
    folder = frame.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(folder) and frame.count() == 10
    assert release(spark) >= 1 and not os.path.exists(folder)
