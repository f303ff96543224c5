"""The weekly run: all products and any number of weeks in one chain of Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.keys import section_anchor
from voxloom.operators import cluster, cost, embed, ingest, ledger as ledger_ops, quotes, render, report, themes
from voxloom.schemas import RUN_KEY, RUN_RECORD
from voxloom.session import durable
from voxloom.settings import Settings


@dataclass(frozen=True)
class WeeklyRun:
    """Everything a run leaves behind, one frame per table."""

    runs: DataFrame
    reviews: DataFrame
    labelled: DataFrame
    themes: DataFrame
    quotes: DataFrame
    reports: DataFrame
    payloads: DataFrame
    delivery: DataFrame
    records: DataFrame
    vectors: DataFrame
    scrubbed: DataFrame
    alerts: DataFrame


def analyze(cleaned: DataFrame, cache: DataFrame, settings: Settings, encoder: embed.Encoder | None = None,
            summarizer: themes.Summarizer | None = None) -> tuple[DataFrame, ...]:
    """(labelled reviews, top clusters, ranked themes, checked quotes, token totals, new vectors)."""
    ids = list(RUN_KEY)
    paid = cleaned
    if settings.max_embedding_tokens is not None:
        paid = durable(embed.within_budget(
            cleaned, cache, settings.embedding_model, settings.max_embedding_tokens, settings.embedding_batch))
    vectors, new = embed.embed_reviews(paid, cache, settings.embedding_model, encoder, settings.embedding_batch)
    embedded = paid.select(*RUN_KEY, "pos", "id", "store", "rating", "date").join(vectors, "id")
    labelled = durable(cluster.cluster_reviews(embedded, settings.min_cluster_size).drop("embedding"))
    top = durable(cluster.top_clusters(cluster.cluster_stats(labelled), settings.max_themes))
    members = labelled.join(top.select(*RUN_KEY, "label"), [*ids, "label"], "left_semi").join(
        cleaned.select(*RUN_KEY, "id", "title", "body"), [*ids, "id"])
    prompts = themes.build_prompts(members, settings.quotes_per_theme, settings.actions_per_theme).join(
        top.select(*RUN_KEY, "label", "rank"), [*ids, "label"])
    if summarizer is None:
        told = themes.summarize_builtin(
            members, prompts, quotes=settings.quotes_per_theme, actions=settings.actions_per_theme)
        ranked = told.join(top.select(*RUN_KEY, "label", "rank"), [*ids, "label"])
        answers = cost.token_budget(
            ranked.withColumn("_tokens", F.col("input_tokens") + F.col("output_tokens")), "_tokens",
            settings.max_tokens_per_run)
    else:
        answers = themes.summarize_clusters(prompts, summarizer, budget=settings.max_tokens_per_run)
    # The answers come from a model: they are stored before anything reads them twice.
    answers = durable(answers.withColumn("review_count", F.col("size")))
    parsed = themes.rank_themes(themes.parse_themes(answers))
    asked = parsed.select(*RUN_KEY, "label", F.posexplode("quotes").alias("quote_no", "text"))
    checked = durable(quotes.attribute_quotes(
        asked, labelled, cleaned.select(*RUN_KEY, "id", "body")))
    totals = cost.run_cost(answers.withColumn("model", F.lit(settings.summary_model)))
    return labelled, top, parsed, checked, totals, new


def start_records(runs: DataFrame, ledger: DataFrame, now: Column, update_seq: int) -> DataFrame:
    """Running records: a known run keeps its id and start, a new one gets both."""
    known = ledger.select(*RUN_KEY, F.struct(*[c for c in RUN_RECORD.names if c not in RUN_KEY]).alias("_k"))
    joined = runs.select(*RUN_KEY, "window_start", "window_end").join(known, list(RUN_KEY), "left")
    name = F.concat_ws("-", section_anchor(F.col("product"), F.col("iso_year"), F.col("iso_week")),
                       F.lit(str(update_seq)))
    window = F.struct(
        F.col("window_start").cast("timestamp").alias("start"), F.col("window_end").cast("timestamp").alias("end"))
    fresh = {
        "run_id": F.coalesce("_k.run_id", F.substring(F.sha2(name, 256), 1, 32)), "status": F.lit("running"),
        "started_at": F.coalesce("_k.started_at", now), "review_window": window,
        "update_seq": F.lit(update_seq).cast("long")}
    return joined.select(*RUN_KEY, *[
        fresh.get(c, F.col(f"_k.{c}")).alias(c) for c in RUN_RECORD.names if c not in RUN_KEY]).select(*RUN_RECORD.names)


def run_weekly(reviews: DataFrame, products: DataFrame, weeks: Sequence[ingest.Week], ledger: DataFrame,
               published: DataFrame, cache: DataFrame, now: Column, update_seq: int, settings: Settings | None = None,
               encoder: embed.Encoder | None = None, summarizer: themes.Summarizer | None = None) -> WeeklyRun:
    """Decide which runs to compute, and compute them all together.

    `reviews` holds the polls of both stores with `seq`. Nothing is sent: `payloads` and `delivery`
    are the hand-off, and `apply_outcomes` puts what became of it into the ledger.
    """
    settings = settings or Settings()
    grid = ingest.run_grid(products, weeks, settings.review_window_weeks)
    decided = ledger_ops.idempotency_decision(grid, ledger, published, products)
    runs = durable(decided.where(F.col("decision") != "skip"))
    known = ingest.source_configured(reviews, products)
    chosen, texts = ingest.chosen_texts(known, weeks, settings, runs)
    chosen = durable(chosen)
    texts = durable(texts)
    cleaned = durable(ingest.clean_runs(chosen, texts))
    labelled, top, ranked, checked, totals, new = analyze(cleaned, cache, settings, encoder, summarizer)
    stats = durable(report.run_stats(
        report.counts_by_store(cleaned), cluster.noise_count(labelled), top, ranked, checked, totals))
    reports = durable(report.assemble_report(runs, ranked, checked, stats, now))
    records = ledger_ops.ledger_metrics(start_records(runs, ledger, now, update_seq), stats)
    delivery = ledger_ops.delivery_plan(
        runs.drop("status", "decision"), published, products, settings.email_mode, ledger)
    alerts = cost.cost_alerts(totals, settings.max_tokens_per_run, settings.cost_alert_threshold_usd)
    return WeeklyRun(
        runs, cleaned, labelled, ranked, checked, reports, render.render_all(reports, products), delivery,
        records.select(*RUN_RECORD.names), new, ingest.scrub_stats(chosen, texts), alerts)
