"""Vectors for review texts: what is cached, what is missing, and how the missing ones are made."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from voxloom.functions import ranking
from voxloom.functions.text import embedding_text
from voxloom.schemas import EMBEDDING, RUN_KEY
from voxloom.session import durable

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def split_cached(reviews: DataFrame, cache: DataFrame, model: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(reviews with a vector of this model, reviews without)."""
    known = cache.where(F.col("model") == model).select(F.col("review_id").alias(key))
    return reviews.join(known, key, "left_semi"), reviews.join(known, key, "left_anti")


def merge_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by `(review_id, model)`; a new vector wins."""
    both = cache.select(*EMBEDDING.names, F.lit(0).alias("_age")).unionByName(
        new.select(*EMBEDDING.names, F.lit(1).alias("_age")))
    return both.groupBy("review_id", "model").agg(F.max_by("embedding", "_age").alias("embedding")).select(
        *EMBEDDING.names)


def embed_budget(reviews: DataFrame, tokens: str, budget: int, batch: int = 100, start: int = 0,
                 keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Reviews of the batches that fit the budget; the batch that crosses it is lost.

    Needs `pos` (1 to the cap). Only batch totals, a handful per run, meet in a window.
    """
    numbered = reviews.withColumn("batch", F.floor((F.col("pos") - 1) / batch).cast("long"))
    totals = numbered.groupBy(*keys, "batch").agg(F.sum(tokens).alias("_tokens"))
    running = Window.partitionBy(*keys).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    fits = totals.withColumn("_total", F.sum("_tokens").over(running) + start).where(F.col("_total") <= budget)
    return numbered.join(fits.select(*keys, "batch"), [*keys, "batch"], "left_semi")


def within_budget(reviews: DataFrame, cache: DataFrame, model: str, budget: int, batch: int = 100,
                  keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Reviews of each run that have a vector, or get one before the run's budget is spent: those without are taken in batches by `pos`, and
    a batch that crosses the budget, and all after it, are left out. A token is four characters of a text."""
    have, lack = split_cached(reviews, cache, model)
    missing = ranking.position(lack.withColumnRenamed("pos", "_pos"), keys, [F.col("_pos")])
    tokens = F.ceil(F.length(embedding_text(F.col("title"), F.col("body"))) / 4)
    kept = embed_budget(missing.withColumn("_tokens", tokens), "_tokens", budget, batch, keys=keys)
    return have.unionByName(kept.drop("pos", "batch", "_tokens").withColumnRenamed("_pos", "pos")).select(*reviews.columns)


def encode_with(texts: DataFrame, encoder: Encoder, model: str, batch: int = 100) -> DataFrame:
    """Vectors from a pluggable encoder, in Arrow batches on the executors; any failure is fatal.

    `texts` has `review_id` and `text`.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), batch):
                part = frame.iloc[first:first + batch]
                vectors = [[float(x) for x in v] for v in encoder(part["text"].tolist())]
                if len(vectors) != len(part):
                    raise ValueError("the encoder must give one vector per text")
                yield pd.DataFrame({"review_id": part["review_id"].to_numpy(), "embedding": vectors, "model": model})

    return texts.select("review_id", "text").mapInPandas(run, EMBEDDING)


def encode_hashed(texts: DataFrame, model: str, dims: int = 128) -> DataFrame:
    """Built-in encoder without a model file: signed feature hashing of the words, log-scaled, unit length; all in the JVM.

    A word counts in the dimension that the first eight hex digits of its MD5 give, with the sign of the ninth (0 to 7 is plus), so any
    engine can state the vector. Nothing is fitted: a text has the same vector whatever else is in the batch or the cache. Words are added up
    in the map tasks, so at most `dims` rows of a text are exchanged.
    """
    words = texts.select("review_id", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("_w"))
    mark = F.md5("_w")
    placed = words.select("review_id", (F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") % dims).cast("int").alias("at"),
                          F.when(F.substring(mark, 9, 1) < "8", 1).otherwise(-1).alias("_s"))
    summed = placed.groupBy("review_id", "at").agg(F.sum("_s").alias("_n")).select(
        "review_id", F.when(F.col("at").isNotNull() & (F.col("_n") != 0), F.struct("at", (F.signum("_n") * F.log1p(F.abs("_n"))).alias("v"))).alias("e"))
    listed = summed.groupBy("review_id").agg(F.map_from_entries(F.collect_list("e")).alias("_m"))  # at most `dims` entries
    norm = F.sqrt(F.aggregate(F.map_values("_m"), F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("_m", i) / norm, F.lit(0.0)))
    return listed.select("review_id", unit.cast("array<float>").alias("embedding"), F.lit(model).alias("model"))


def embed_reviews(reviews: DataFrame, cache: DataFrame, model: str, encoder: Encoder | None = None,
                  batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """(`id, embedding` of every review, the new cache rows). Each distinct review is encoded once."""
    distinct = reviews.select("id", "title", "body").dropDuplicates(["id"])
    _, missing = split_cached(distinct, cache, model)
    texts = missing.select(F.col("id").alias("review_id"), embedding_text(F.col("title"), F.col("body")).alias("text"))
    # Vectors are costly and read twice (by the run and by the cache): they are stored at once.
    new = durable(encode_hashed(texts, model) if encoder is None else encode_with(texts, encoder, model, batch))
    cached = cache.where(F.col("model") == model).join(
        distinct.select(F.col("id").alias("review_id")), "review_id", "left_semi")
    every = cached.select(*EMBEDDING.names).unionByName(new)
    return every.select(F.col("review_id").alias("id"), "embedding"), new


def numbered_by_run(reviews: DataFrame, cap: int, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Positions for frames that have none yet."""
    return ranking.top_n(reviews, keys, [F.col("date").desc(), F.col("id")], cap)
