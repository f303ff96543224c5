"""Streams over landed files give what the batch operators give, in whatever order the files come."""

import os
from glob import glob

import pytest
from pyspark.sql import functions as F

from voxloom.operators import ingest
from voxloom.functions.pii import scrub_columns
from voxloom.functions.weeks import assign_windows
from voxloom.plans import tables
from voxloom.session import scratch_path
from voxloom.streaming import feeds


def landed(spark, sf):
    """Reviews in three files, the newest reviews first and the oldest last, and a repeated file after them."""
    path = scratch_path(spark, "landed")
    rows = tables.reviews(spark, sf).repartition(1)
    rows.where("seq >= 120").coalesce(1).write.parquet(f"{path}/a")
    rows.where("seq < 60").coalesce(1).write.parquet(f"{path}/b")
    rows.where("seq >= 60 AND seq < 120").coalesce(1).write.parquet(f"{path}/c")
    again = rows.where("seq % 10 = 0").withColumns({"body": F.concat("body", F.lit(" again")), "seq": F.col("seq") + 10_000})
    again.coalesce(1).write.parquet(f"{path}/d")
    stored = spark.read.parquet(f"{path}/*")
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*/")
    return stream, stored


def test_first_poll_wins_in_the_stream(spark, sf):
    stream, stored = landed(spark, sf)
    path = scratch_path(spark, "out")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    feeds.run_stream_ingest(stream, f"{path}/out", f"{path}/checkpoint")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = spark.read.parquet(f"{path}/out")
    assert len(glob(f"{path}/out/batch=*")) >= 4
    assert got.where(F.col("author") != "[NAME]").isEmpty()
    want = scrub_columns(stored.where("seq < 10000")).select("id", "body", "title", "rating", "date", "seq")
    mine = got.select("id", "body", "title", "rating", "date", "seq")
    assert mine.count() == want.count() and want.exceptAll(mine).isEmpty()


def test_a_batch_reads_only_itself(spark, sf):
    """What is stored is not read again: without it, a second run over new files still knows the ids."""
    path = scratch_path(spark, "out")
    rows = tables.reviews(spark, sf).where("seq < 40")
    rows.write.parquet(f"{path}/in/a")
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in/*/")
    feeds.run_stream_ingest(stream, f"{path}/out", f"{path}/checkpoint")
    os.rename(f"{path}/out", f"{path}/elsewhere")
    more = rows.withColumn("seq", F.col("seq") + 10_000).unionByName(tables.reviews(spark, sf).where("seq >= 40 AND seq < 50"))
    more.write.parquet(f"{path}/in/b")
    feeds.run_stream_ingest(stream, f"{path}/out", f"{path}/checkpoint")
    assert sorted(r["seq"] for r in spark.read.parquet(f"{path}/out").select("seq").collect()) == list(range(40, 50))


def test_latest_poll_equals_batch(spark, sf):
    stream, stored = landed(spark, sf)
    path = scratch_path(spark, "out")
    feeds.run_stream_latest(stream, f"{path}/out", f"{path}/checkpoint")
    want = scrub_columns(ingest.dedupe_last_wins(stored)).select("id", "body", "title", "seq")
    got = feeds.latest_reviews(spark, f"{path}/out").select("id", "body", "title", "seq")
    assert got.count() == want.count() and want.exceptAll(got).count() == 0


def test_rolling_counts_equal_batch(spark, sf):
    stream, stored = landed(spark, sf)
    path = scratch_path(spark, "out")
    feeds.run_rolling_counts(stream.select("product", "date", "rating"), f"{path}/out", f"{path}/checkpoint")
    assert len(glob(f"{path}/out/batch=*")) >= 4
    want = assign_windows(stored).groupBy("product", "iso_year", "iso_week").agg(F.count("*").alias("n"), F.sum("rating").alias("r"))
    got = feeds.latest_counts(spark, f"{path}/out")
    key = lambda rows: sorted((r[0], r[1], r[2]) for r in rows.collect())
    assert key(got.select("product", "reviews", "rating_sum")) == key(want.select("product", "n", "r"))


@pytest.fixture
def encoder():
    return lambda texts: [[float(len(t))] for t in texts]


def test_embed_only_what_is_missing(spark, sf, encoder):
    stream, stored = landed(spark, sf)
    path = scratch_path(spark, "out")
    count = lambda: spark.read.parquet(f"{path}/cache").count() if os.path.exists(f"{path}/cache") else 0
    feeds.run_embed_missing(stream, f"{path}/cache", f"{path}/c1", "m", encoder)
    first = count()
    feeds.run_embed_missing(stream, f"{path}/cache", f"{path}/c2", "m", encoder)
    assert first == stored.select("id").distinct().count() == count()
    feeds.run_embed_missing(stream, f"{path}/cache", f"{path}/c3", "other", encoder)
    assert count() == 2 * first and feeds.read_cache(spark, f"{path}/cache").count() == 2 * first


def test_files_of_a_bucket_stay_few(spark, sf, encoder):
    """Ten batches: a bucket never has more files than the bound, and no vector is lost or twice."""
    path = scratch_path(spark, "out")
    rows = tables.reviews(spark, sf)
    for part in range(10):
        rows.where(F.col("seq") % 10 == part).coalesce(1).write.parquet(f"{path}/in/{part}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*/")
    most, compact = [], feeds.compact_cache

    def watched(*given):
        most.append(max(len(files) for files in feeds._files(spark, f"{path}/cache").values()))
        return compact(*given)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(feeds, "compact_cache", watched)
        feeds.run_embed_missing(stream, f"{path}/cache", f"{path}/c", "m", encoder, 4, 2)
    assert len(most) >= 10 and max(most) <= 3
    got = spark.read.parquet(f"{path}/cache")
    assert got.count() == got.select("review_id").distinct().count() == rows.count()
    # a failure between writing anew and deleting leaves vectors twice: readers see one, the next call puts it right
    feeds._add(got.select("review_id", "embedding", "model"), f"{path}/cache", 4)
    assert feeds.read_cache(spark, f"{path}/cache").count() == rows.count()
    feeds.compact_cache(spark, f"{path}/cache", 4, 0)
    assert spark.read.parquet(f"{path}/cache").count() == rows.count()
