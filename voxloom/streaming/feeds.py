"""Incremental work over landed files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxloom.functions.pii import scrub_lettered
from voxloom.functions.text import embedding_text
from voxloom.operators.embed import Encoder, encode_with, merge_cache, split_cached
from voxloom.operators.ingest import dedupe_last_wins
from voxloom.schemas import EMBEDDING
from voxloom.session import durable

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Buckets of a cache, and files of a bucket before they are made one.
BUCKETS, MOST_FILES = 32, 4


class FirstPoll(StatefulProcessor):
    """Keeps the number of the first poll of an id; later ones give nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.first.exists():
            return
        best = min(rows, key=lambda r: r["seq"])
        self.first.update((best["seq"],))
        yield best

    def close(self) -> None:
        pass


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """State on the executors' disks, with changes in the checkpoint folder; the session's own setting comes back afterwards."""
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STATE_STORE, before)


def first_polls(reviews: DataFrame) -> DataFrame:
    """Of a stream of polls the first of each id: in a batch that with the least `seq`, and none whose id came in an earlier batch."""
    return reviews.groupBy("id").transformWithState(FirstPoll(), reviews.schema, "Append", "None")


def run_stream_ingest(reviews: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has landed and stop: scrubbed reviews, each id once, from the first poll that delivers it.

    The ids are keyed state (one number each), so a batch reads only itself and not what is stored. No watermark: a review of any age
    counts, in whatever order files land. A batch that is retried meets the state as it was, and replaces its own folder.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        scrub_lettered(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with _keyed_state(reviews.sparkSession):
        first_polls(reviews).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()


def run_stream_latest(reviews: DataFrame, path: str, checkpoint: str) -> None:
    """Land scrubbed polls batch by batch; `latest_reviews` then gives the last poll of each id."""
    def land(batch: DataFrame, batch_id: int) -> None:
        # A batch that is retried after a failure replaces its own folder.
        unique = scrub_lettered(dedupe_last_wins(batch))
        unique.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    reviews.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def latest_reviews(spark: SparkSession, path: str) -> DataFrame:
    return dedupe_last_wins(spark.read.parquet(path).drop("batch"))


def rolling_counts(reviews: DataFrame, weeks: int = 10) -> DataFrame:
    """Reviews and mean rating per product and rolling Sunday-to-Sunday window; rows of any age count.

    The state is one row per product and window, so it needs no watermark to stay small.
    """
    # 1970-01-01 was a Thursday: a start of three days puts the windows on Sundays.
    sliding = F.window("date", f"{7 * weeks + 1} days", "7 days", "3 days")
    return reviews.groupBy(sliding.alias("window"), "product").agg(
        F.count("*").alias("reviews"), F.sum("rating").alias("rating_sum"))


def run_rolling_counts(reviews: DataFrame, path: str, checkpoint: str, weeks: int = 10) -> None:
    """Write changed windows batch by batch; `latest_counts` keeps the newest figure of each."""
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.select(
            F.lit(batch_id).cast("long").alias("update_no"), "product", F.col("window.start").alias("window_start"),
            "reviews", "rating_sum").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    rolling_counts(reviews, weeks).writeStream.outputMode("update").foreachBatch(land).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path).groupBy("product", "window_start").agg(
        F.max_by(F.struct("reviews", "rating_sum"), "update_no").alias("v"))
    return rows.select(
        "product", "window_start", "v.reviews", "v.rating_sum",
        (F.col("v.rating_sum") / F.col("v.reviews")).alias("avg_rating"))


def run_embed_missing(reviews: DataFrame, path: str, checkpoint: str, model: str, encoder: Encoder,
                      buckets: int = BUCKETS, most_files: int = MOST_FILES) -> None:
    """Encode only ids without a vector, and add the new vectors to the cache.

    The cache lies in buckets by the id's hash: a batch reads the ids of its own buckets, and a bucket of more than `most_files` files is
    written anew as one, so what a batch opens does not grow with the batches before it. A batch that is retried finds what its first try
    has stored. One stream at a time writes to a cache.
    """
    spark = reviews.sparkSession

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = dedupe_last_wins(batch)
        mine = [r[0] for r in rows.select(_bucket(F.col("id"), buckets)).distinct().collect()]  # so many as there are buckets
        known = _cache_rows(spark, path).where(F.col("bucket").isin(mine))
        _, missing = split_cached(scrub_lettered(rows), known, model)
        texts = missing.select(F.col("id").alias("review_id"), embedding_text(F.col("title"), F.col("body")).alias("text"))
        _add(encode_with(texts, encoder, model), path, buckets)
        compact_cache(spark, path, buckets, most_files)

    reviews.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def _bucket(id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(buckets)).cast("int")


def _add(vectors: DataFrame, path: str, buckets: int) -> None:
    vectors.withColumn("bucket", _bucket(F.col("review_id"), buckets)).repartition(buckets, "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def _files(spark: SparkSession, path: str) -> dict[int, list]:
    """Data files of each bucket."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found: dict[int, list] = {}
    for folder in fs.listStatus(root) if fs.exists(root) else []:
        name = folder.getPath().getName()
        if name.startswith("bucket="):
            found[int(name[7:])] = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
    return found


def compact_cache(spark: SparkSession, path: str, buckets: int = BUCKETS, most_files: int = MOST_FILES) -> list[int]:
    """Write buckets of many files anew as one file each; gives their numbers.

    What is new is complete before what is old goes, so a failure in between leaves vectors twice, which readers and the next call put right.
    """
    crowded = {b: files for b, files in _files(spark, path).items() if len(files) > most_files}
    if crowded:
        rows = _cache_rows(spark, path).where(F.col("bucket").isin(list(crowded))).select(*EMBEDDING.names)
        _add(durable(merge_cache(spark.createDataFrame([], EMBEDDING), rows)), path, buckets)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for old in (f for files in crowded.values() for f in files):
            old.getFileSystem(conf).delete(old, False)
    return sorted(crowded)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(conf).exists(root)


def _cache_rows(spark: SparkSession, path: str) -> DataFrame:
    """All vectors as they were written, with their bucket."""
    schema = T.StructType([*EMBEDDING, T.StructField("bucket", T.IntegerType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached vectors, one per id and model."""
    return merge_cache(spark.createDataFrame([], EMBEDDING), _cache_rows(spark, path).drop("bucket"))
