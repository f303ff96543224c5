"""Counters and nested reports per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.weeks import assign_windows
from voxloom.operators.quotes import quote_validation_rate
from voxloom.schemas import ACTION, QUOTE, RUN_KEY, STATS, THEME
from pyspark.sql import types as T


def counts_by_store(reviews: DataFrame, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Reviews in total and per store of each run."""
    return reviews.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("store") == "appstore").alias("appstore"),
        F.count_if(F.col("store") == "playstore").alias("playstore"))


def rolling_counts_by_store(reviews: DataFrame, weeks: int = 10) -> DataFrame:
    """The same for every rolling window, from daily counts: rows are multiplied only after they are counted."""
    daily = reviews.groupBy("product", F.to_date("date").alias("date")).agg(
        F.count("*").alias("_all"), F.count_if(F.col("store") == "appstore").alias("_app"),
        F.count_if(F.col("store") == "playstore").alias("_play"))
    return assign_windows(daily, "date", weeks).groupBy(*RUN_KEY).agg(
        F.sum("_all").alias("total"), F.sum("_app").alias("appstore"), F.sum("_play").alias("playstore"))


def run_stats(counts: DataFrame, noise: DataFrame, clusters: DataFrame, themes: DataFrame, quotes: DataFrame,
              costs: DataFrame, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """All counters of a report in one row per run."""
    ids = list(keys)
    found = clusters.groupBy(*keys).agg(F.count("*").alias("clusters_found"))
    made = themes.groupBy(*keys).agg(F.count("*").alias("themes_generated"))
    checked = quote_validation_rate(quotes, keys).select(*keys, "quotes_proposed", "quotes_validated")
    joined = counts.join(noise.select(*keys, "noise_reviews"), ids, "left")
    for part in (found, made, checked, costs):
        joined = joined.join(part, ids, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        *keys, F.col("total").alias("total_reviews"), F.col("appstore").alias("appstore_reviews"),
        F.col("playstore").alias("playstore_reviews"),
        *[zero(c) for c in ("clusters_found", "noise_reviews", "themes_generated", "quotes_proposed",
                            "quotes_validated", "input_tokens", "output_tokens")],
        F.coalesce("estimated_cost_usd", F.lit(0.0)).alias("estimated_cost_usd"))


def _stats_struct(present: Column) -> Column:
    count = lambda c: F.when(present, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    usage = F.struct(
        count("input_tokens"), count("output_tokens"),
        F.when(present, F.col("estimated_cost_usd")).otherwise(F.lit(0.0)).alias("estimated_cost_usd"))
    return F.struct(*[count(f.name) for f in STATS if f.name != "llm_usage"], usage.alias("llm_usage"))


def theme_structs(themes: DataFrame, quotes: DataFrame, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """`themes` array per run, in theme order; of the quotes only validated ones stay."""
    quote = F.struct(
        F.col("text").alias("text"), F.col("review_id").alias("review_id"), F.col("rating").alias("rating"),
        F.col("store").alias("store"), F.col("date").alias("date"), F.col("validated").alias("validated"))
    valid = quotes.where("validated").groupBy(*keys, "label").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("quote_no", quote.alias("q")))), lambda q: q["q"]
    ).cast(T.ArrayType(QUOTE)).alias("_quotes"))
    theme = F.struct(
        F.col("name").alias("name"), F.col("description").alias("description"),
        F.coalesce("_quotes", F.array().cast(T.ArrayType(QUOTE))).alias("quotes"),
        F.coalesce(F.col("actions").cast(T.ArrayType(ACTION)), F.array().cast(T.ArrayType(ACTION))).alias("actions"),
        F.col("review_count").cast("int").alias("review_count"), F.col("label").cast("int").alias("cluster_label"))
    joined = themes.join(valid, [*keys, "label"], "left")
    return joined.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("theme_no", theme.alias("t")))), lambda t: t["t"]
    ).cast(T.ArrayType(THEME)).alias("themes"))


def assemble_report(grid: DataFrame, themes: DataFrame, quotes: DataFrame, stats: DataFrame,
                    generated_at: Column) -> DataFrame:
    """One nested report per run of the grid; a run without reviews gets an empty report."""
    ids = list(RUN_KEY)
    nested = theme_structs(themes, quotes)
    joined = grid.join(nested, ids, "left").join(stats.withColumn("_has", F.lit(True)), ids, "left")
    return joined.select(
        "product", "display_name", "iso_year", "iso_week", generated_at.alias("generated_at"),
        F.col("window_start").cast("timestamp").alias("review_window_start"),
        F.col("window_end").cast("timestamp").alias("review_window_end"),
        F.coalesce("themes", F.array().cast(T.ArrayType(THEME))).alias("themes"),
        _stats_struct(F.coalesce("_has", F.lit(False))).alias("stats"))


def run_metadata(reports: DataFrame, grid: DataFrame) -> DataFrame:
    """Stamp display name and window of the run on bare reports."""
    stamp = grid.select(*RUN_KEY, F.col("display_name").alias("_name"), "window_start", "window_end")
    return reports.join(stamp, list(RUN_KEY), "left").withColumns({
        "display_name": F.coalesce("_name", F.col("display_name")),
        "review_window_start": F.col("window_start").cast("timestamp"),
        "review_window_end": F.col("window_end").cast("timestamp")}).drop("_name", "window_start", "window_end")


def validated_only(quotes: Column) -> Column:
    return F.filter(quotes, lambda q: q["validated"])


def report_summary(reports: DataFrame) -> DataFrame:
    """Summary line, leading theme and its first action, `N/A` when there is none."""
    first = F.get("themes", F.lit(0))
    name = first["name"]
    lead = F.coalesce(
        F.concat(F.lit(" The leading concern was related to '"), name, F.lit("'.")), F.lit(""))
    # Fixed value: the wording of the summary.
    text = F.concat(
        F.format_string("We analyzed %d reviews and extracted %d core themes.",
                        F.col("stats.total_reviews"), F.col("stats.clusters_found")), lead)
    return reports.select(
        *RUN_KEY, text.alias("summary"), F.coalesce(name, F.lit("N/A")).alias("primary_signal"),
        F.format_string("%d reviews analyzed", F.col("stats.total_reviews")).alias("evidence"),
        F.coalesce(F.get(first["actions"], F.lit(0))["title"], F.lit("N/A")).alias("focus"))
