"""From the reviews of both stores to the cleaned reviews of every requested run."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions import ranking
from voxloom.functions.pii import COUNTERS, count_hits, scrub_lettered
from voxloom.functions.weeks import assign_windows
from voxloom.schemas import RUN_KEY
from voxloom.settings import Settings

#: What the second source's `seq` is moved by; polls and positions of the first stay below.
SEQ_PER_SOURCE = 1 << 60
Week = tuple[int, int]


def union_sources(appstore: DataFrame, playstore: DataFrame) -> DataFrame:
    """App-store rows, then play-store rows; `seq` keeps that order."""
    later = playstore.withColumn("seq", F.col("seq") + F.lit(SEQ_PER_SOURCE))
    return appstore.unionByName(later)


def dedupe_last_wins(df: DataFrame, keys: tuple[str, ...] = ("id",), order: str = "seq") -> DataFrame:
    """One row per key: the values of the last row at the position of the first.

    Copies collapse in the map tasks before the shuffle, so many copies of one id do no harm.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    merged = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("_last"), F.min(order).alias(order))
    return merged.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest], order).select(*df.columns)


def newest_order() -> list:
    return [F.col("date").desc(), F.col("seq")]


def newest_first(df: DataFrame, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Add `pos`: 1 for the newest row of a key, ties in input order; no row is dropped."""
    return ranking.position(df, keys, newest_order())


def cap_per_product(df: DataFrame, cap: int = 500, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """The newest `cap` rows per key with their `pos`."""
    return ranking.top_n(df, keys, newest_order(), cap)


def newest_per_window(df: DataFrame, cap: int = 500, weeks: int = 10) -> DataFrame:
    """The newest `cap` rows of every rolling window, with the window's run key and `pos`.

    A window holds whole days, so no more than the newest `cap` rows of a product's day can
    matter. They are cut first: a hot product is thinned before its rows are multiplied.
    """
    days = df.withColumn("_day", F.to_date("date"))
    daily = ranking.top_n(days, ("product", "_day"), newest_order(), cap, "_day_pos").drop("_day", "_day_pos")
    return cap_per_product(assign_windows(daily, weeks=weeks), cap)


def cap_per_store(df: DataFrame, cap: int = 500, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """The first `cap` rows per key and store, in input order."""
    return ranking.top_n(df, (*keys, "store"), [F.col("seq")], cap, "_store_pos").drop("_store_pos")


def source_configured(df: DataFrame, products: DataFrame) -> DataFrame:
    """Drop rows of a store for which the product has no id."""
    pairs = products.select(
        F.col("slug").alias("product"),
        F.explode(F.map_from_arrays(
            F.array(F.lit("appstore"), F.lit("playstore")), F.array("appstore_id", "playstore_id"))
        ).alias("store", "_app")).where(F.coalesce(F.col("_app"), F.lit("")) != "")
    return df.join(pairs, ["product", "store"], "left_semi")


def review_product(df: DataFrame, products: DataFrame) -> DataFrame:
    """Attach names, ids and recipients of the product."""
    return df.join(products.withColumnRenamed("slug", "product"), "product")


def _sunday(year: int, week: int) -> date:
    return date.fromisocalendar(year, week, 7)


def run_grid(products: DataFrame, weeks: Sequence[Week], window_weeks: int = 10) -> DataFrame:
    """All runs to compute: every product with every listed week, and the window of each."""
    listed = F.array(*[
        F.struct(F.lit(y).alias("iso_year"), F.lit(w).alias("iso_week"), F.lit(_sunday(y, w)).alias("window_end"))
        for y, w in weeks])
    runs = products.withColumn("_w", F.explode(listed))
    return runs.select(
        F.col("slug").alias("product"), "_w.iso_year", "_w.iso_week", "display_name", "doc_id", "stakeholder_emails",
        F.date_sub("_w.window_end", 7 * window_weeks).alias("window_start"), "_w.window_end")


def _listed(weeks: Sequence[Week], settings: Settings) -> Column:
    """The listed weeks whose window a row may belong to, as an array.

    As fetched, a run sees everything from its window start on, also what is newer than the
    window; with `cap_after_end` only what lies inside.
    """
    listed = F.array(*[
        F.struct(F.lit(y).alias("iso_year"), F.lit(w).alias("iso_week"), F.lit(_sunday(y, w)).alias("_end"))
        for y, w in weeks])
    day = F.col("date").cast("date")

    def belongs(w):
        inside = day >= F.date_sub(w["_end"], 7 * settings.review_window_weeks)
        return inside & (day <= w["_end"]) if settings.cap_after_end else inside

    return F.filter(listed, belongs)


def candidate_runs(df: DataFrame, weeks: Sequence[Week], settings: Settings) -> DataFrame:
    """One row per listed week whose window the row may belong to."""
    return df.withColumn("_w", F.explode(_listed(weeks, settings))).select(*df.columns, "_w.*")


def thin_candidates(df: DataFrame, weeks: Sequence[Week], settings: Settings) -> DataFrame:
    """The rows that can survive the cap per store, before they are multiplied by weeks.

    Rows of a product and store with the same first and last listed week belong to the same runs, so no more than the
    first rows of such a share, up to the cap, can be among the first of any run. Map tasks cut their own rows first.
    """
    ends = F.transform(_listed(weeks, settings), lambda w: w["_end"])
    marked = df.withColumn("_ends", ends).select(*df.columns, F.array_min("_ends").alias("_from"), F.array_max("_ends").alias("_to"))
    share = ("product", "store", "_from", "_to")
    return ranking.top_n(marked.where("_to IS NOT NULL"), share, [F.col("seq")], settings.max_reviews_per_product, "_turn").select(*df.columns)


def window_start_filter(df: DataFrame, start) -> DataFrame:
    return df.where(F.col("date") >= start)


def window_end_filter(df: DataFrame, end_day) -> DataFrame:
    """Keep rows up to the last instant of `end_day`."""
    return df.where(F.col("date") < F.date_add(end_day, 1).cast("timestamp"))


def select_run_rows(reviews: DataFrame, weeks: Sequence[Week], settings: Settings,
                    runs: DataFrame | None = None) -> DataFrame:
    """Which reviews each run keeps: caps, dedup and order, decided on slim rows without any text."""
    slim = reviews.select("product", "store", "id", "date", "seq")
    seen = candidate_runs(thin_candidates(slim, weeks, settings), weeks, settings)
    if runs is not None:
        seen = seen.join(runs.select(*RUN_KEY), list(RUN_KEY), "left_semi")
    capped = cap_per_store(seen, settings.max_reviews_per_product)
    # Last value, first position: the text is fetched by the last `seq`, the order kept by the first.
    unique = capped.groupBy(*RUN_KEY, "id").agg(
        F.max("seq").alias("last_seq"), F.max_by("date", "seq").alias("date"), F.min("seq").alias("seq"),
        F.first("_end").alias("_end"))
    kept = cap_per_product(unique, settings.max_reviews_per_product)
    return window_end_filter(kept, F.col("_end")).select(*RUN_KEY, "id", "last_seq", "pos")


def ingest_runs(reviews: DataFrame, weeks: Sequence[Week], settings: Settings | None = None,
                runs: DataFrame | None = None) -> DataFrame:
    """Cleaned reviews of every run (of those in `runs`, when given), newest first by `pos`.

    `reviews` holds all polls of both stores with `seq`. Text is read once, for the kept rows
    only, and scrubbed once per review, not once per run.
    """
    return clean_runs(*chosen_texts(reviews, weeks, settings or Settings(), runs))


def chosen_texts(reviews: DataFrame, weeks: Sequence[Week], settings: Settings, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(which reviews each run keeps, the kept reviews as they came, each once)."""
    chosen = select_run_rows(reviews, weeks, settings, runs)
    used = chosen.select("id", F.col("last_seq").alias("seq")).distinct()
    # polls without numbers may repeat a place: one text per place
    texts = reviews.drop("product").join(used, ["id", "seq"], "left_semi").dropDuplicates(["id", "seq"])
    return chosen, texts.withColumnRenamed("seq", "last_seq")


def clean_runs(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """The chosen reviews of every run with their scrubbed texts."""
    return chosen.join(scrub_lettered(texts), ["id", "last_seq"]).drop("last_seq")


def scrub_stats(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """What scrubbing finds in the reviews of each run, by kind; every review is searched once, not once per run."""
    counters = [*COUNTERS, "authors_anonymized"]
    found = count_hits(texts.select("id", "last_seq", "title", "body", "author")).select("id", "last_seq", *counters)
    return chosen.select(*RUN_KEY, "id", "last_seq").join(found, ["id", "last_seq"]).groupBy(*RUN_KEY).agg(*[F.sum(c).alias(c) for c in counters])
