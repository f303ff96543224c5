"""Queries: sources, sinks, normalisation, filters, scrubbing, set operations."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.functions import keys, pii, text, weeks
from voxloom.operators import cluster, ingest, ledger as ledger_ops, normalise, readside, render, report
from voxloom.plans import landed as landed_plan, tables
from voxloom.plans.catalog import RUN_SQL, longs, query, run_columns, when_sql, when_text
from voxloom.plans.oracle import RUN, STAGES, hits, scrub, scrub_stage, sql
from voxloom.schemas import RAW_PAGE, RUN_KEY, SCRAPE_ROW
from voxloom.session import durable, scratch_path
from voxloom.settings import Settings
from voxloom.sources import feeds, ledger_store, registry, review_store

# The wording of markdown, previews and scrubbing placeholders in the SQL below has to equal that of the operators.

PAGE_ROWS = 1000


def _digest(column: str) -> Column:
    return F.md5(column)


# ---------------------------------------------------------------- sources and sinks

def _label(value: Column) -> Column:
    return F.struct(value.cast("string").alias("label"))


def _entry(date_label: Column, rating_label: Column, version: Column) -> Column:
    return F.struct(
        _label(F.col("seq")).alias("id"), F.struct(_label(F.col("author")).alias("name")).alias("author"),
        _label(F.col("title")).alias("title"), _label(F.col("body")).alias("content"),
        _label(rating_label).alias("im:rating"), _label(version).alias("im:version"), _label(date_label).alias("updated"))


def _iso(when: str = "date") -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")


def _landed_pages(reviews: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """App-store reviews as feed pages; a page with one entry holds an object instead of a list."""
    rows = reviews.where(F.col("store") == "appstore").select(
        "product", F.floor(F.col("seq") / page_rows).cast("int").alias("page"), "seq",
        _entry(_iso(), F.col("rating"), F.lit("1.0")).alias("e"))
    paged = rows.groupBy("product", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "e"))).alias("l"))
    many = F.to_json(F.struct(F.struct(F.transform("l", lambda x: x["e"]).alias("entry")).alias("feed")))
    one = F.to_json(F.struct(F.struct(F.get("l", F.lit(0))["e"].alias("entry")).alias("feed")))
    return paged.select(
        "product", F.lit("app").alias("app_id"), (F.col("page") + 1).alias("page"),
        F.when(F.size("l") == 1, one).otherwise(many).alias("payload"))


@query("scan_appstore_pages", sql(f"""
    SELECT product, seq // {PAGE_ROWS} + 1 AS page, CAST(seq AS VARCHAR) AS source_id, md5(body) AS body,
      CAST(rating AS VARCHAR) AS rating
    FROM reviews WHERE store = 'appstore'""", "reviews"))
def scan_appstore_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pages")
    _landed_pages(tables.reviews(spark, sf_dir)).write.json(path)
    rows = feeds.scan_appstore_pages(feeds.read_pages(spark, path))
    return rows.select(
        "product", F.col("page").cast("long").alias("page"), F.col("entry.id.label").alias("source_id"),
        F.md5("entry.content.label").alias("body"), F.col("entry.`im:rating`.label").alias("rating"))


def _scraped(reviews: DataFrame) -> DataFrame:
    rows = reviews.where(F.col("store") == "playstore").select(
        "product", F.lit("app").alias("app_id"), F.floor(F.col("seq") / 100).cast("int").alias("batch"),
        F.pmod("seq", F.lit(100)).cast("int").alias("pos"), F.col("seq").cast("string").alias("reviewId"),
        F.col("author").alias("userName"), F.col("body").alias("content"), F.col("rating").cast("string").alias("score"),
        F.col("version").alias("reviewCreatedVersion"), _iso().alias("at"))
    return rows.select(*SCRAPE_ROW.names)


@query("scan_playstore_batches", sql(f"""
    SELECT product, seq // 100 AS batch, seq % 100 AS pos, CAST(seq AS VARCHAR) AS review_id, md5(body) AS body,
      version, strftime(date, '%Y-%m-%dT%H:%M:%S') AS at
    FROM reviews WHERE store = 'playstore'""", "reviews"))
def scan_playstore_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "batches")
    _scraped(tables.reviews(spark, sf_dir)).write.json(path)
    rows = feeds.scan_playstore_batches(feeds.read_batches(spark, path))
    return longs(rows.select(
        "product", "batch", "pos", F.col("reviewId").alias("review_id"), F.md5("content").alias("body"),
        F.col("reviewCreatedVersion").alias("version"), "at"), "batch", "pos")


@query("scan_products", sql("SELECT slug, display_name, appstore_id, playstore_id, doc_id, doc_title, recipients FROM products",
                            "products"))
def scan_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "products")
    listed = tables.products(spark, sf_dir)
    # Every slug occurs twice in its file; the later entry is the one that counts.
    versions = listed.withColumn("display_name", F.lit("Old name")).withColumn("v", F.lit(0)).unionByName(
        listed.withColumn("v", F.lit(1)))
    entry = F.struct("v", "slug", "display_name", "appstore_id", "playstore_id", "doc_id", "doc_title",
                     "stakeholder_emails")
    versions.groupBy("slug").agg(F.sort_array(F.collect_list(entry)).alias("products")).select("products").write.json(path)
    return registry.scan_products(spark, path, multi_line=False).withColumn(
        "recipients", F.array_join("stakeholder_emails", ", ")).drop("stakeholder_emails")


@query("scan_review_dump", sql(f"""
    SELECT id, store, product, author, rating, title, md5(body) AS body, {when_sql('date')} AS date, version, language,
      raw_length FROM reviews""", "reviews"))
def scan_review_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "dump")
    tables.reviews(spark, sf_dir).drop("seq").write.json(path)
    return review_store.scan_review_dump(spark, path, multi_line=False).withColumns({
        "body": F.md5("body"), "date": when_text("date")})


@query("write_reviews", sql(f"""
    SELECT product, isoyear(date) AS iso_year, week(date) AS iso_week, count(*) AS reviews,
      CAST(sum(rating) AS BIGINT) AS ratings
    FROM reviews WHERE week(date) % 2 = 1 OR seq % 3 = 0
      OR NOT EXISTS (SELECT 1 FROM reviews o WHERE o.seq % 3 = 0 AND o.product = reviews.product
        AND isoyear(o.date) = isoyear(reviews.date) AND week(o.date) = week(reviews.date))
    GROUP BY ALL""", "reviews"))
def write_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "reviews")
    rows = weeks.own_week(tables.reviews(spark, sf_dir))
    review_store.write_reviews(rows, path)
    # A second save replaces the runs it has rows for and leaves the others as they are.
    review_store.write_reviews(rows.where((F.col("iso_week") % 2 == 0) & (F.col("seq") % 3 == 0)), path)
    back = review_store.read_reviews(spark, path).groupBy(*RUN_KEY).agg(
        F.count("*").alias("reviews"), F.sum("rating").cast("long").alias("ratings"))
    return back.select(*run_columns(), "reviews", "ratings")


@query("write_reports", sql(f"""
    SELECT {RUN_SQL}, display_name, CAST(len(themes) AS BIGINT) AS themes, themes[1].name AS first_theme,
      themes[1].quotes[1].text AS first_quote, {when_sql('CAST(window_end AS TIMESTAMP)')} AS window_end,
      total_reviews, quotes_validated FROM reports""", "reports"))
def write_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "reports")
    review_store.write_reports(tables.Given(spark, sf_dir, shared=True).reports, path)
    first = F.get("themes", F.lit(0))
    return review_store.read_reports(spark, path).select(
        *run_columns(), "display_name", F.size("themes").cast("long").alias("themes"), first["name"].alias("first_theme"),
        F.get(first["quotes"], F.lit(0))["text"].alias("first_quote"),
        when_text("review_window_end").alias("window_end"), "stats.total_reviews", "stats.quotes_validated")


@query("ledger_store", sql(f"SELECT {RUN_SQL}, run_id, status, {when_sql('started_at')} AS started_at FROM ledger", "ledger"))
def ledger_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ledger")
    rows = tables.updates(spark, sf_dir)
    ledger_store.save_records(spark, path, rows.where(F.col("update_seq") % 2 == 1))
    ledger_store.save_records(spark, path, rows.where(F.col("update_seq") % 2 == 0))
    return ledger_store.load_ledger(spark, path).select(
        *run_columns(), "run_id", "status", when_text("started_at").alias("started_at"))


_PREVIEW_SQL = f"""
    SELECT {RUN_SQL}, run_id, status, doc_id, themes[1].name AS theme_name, themes[1].quotes[1].text AS quote,
      themes[1].actions[1].title AS action FROM run_ledger JOIN reports USING ({RUN})"""


def _with_preview(given: tables.Given, reports: DataFrame) -> DataFrame:
    return readside.runs_with_preview(tables.run_records(given.grid), given.products, reports)


@query("static_snapshot", sql(_PREVIEW_SQL, "run_ledger", "reports"))
def static_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "snapshot")
    given = tables.Given(spark, sf_dir, shared=True)
    reports = durable(given.reports)
    runs = _with_preview(given, reports)
    review_store.write_snapshot(runs, readside.reports_with_product(reports, given.products), path)
    return spark.read.schema(runs.schema).json(f"{path}/runs").select(
        *run_columns(), "run_id", "status", "doc_id", "preview.theme_name", "preview.quote", "preview.action")


@query("report_markdown", sql(f"""
    SELECT {RUN_SQL}, '# Groq Analysis Output\n\n## Top Themes\n' || array_to_string(list_transform(themes, lambda t:
      '### ' || t.theme_no || '. ' || t.name || ' (' || t.size || ' reviews)\n' || t.description || '\n\n**Quotes:**\n'
      || array_to_string(list_transform(t.quotes, lambda q: '- "' || q.text || '" (' || q.rating || ' stars)\n'), '')
      || '\n**Action Ideas:**\n'
      || array_to_string(list_transform(t.actions, lambda a: '- ' || a.title || ': ' || a.details || '\n'), '')
      || '\n---\n\n'), '') AS text FROM reports""", "reports"))
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = render.report_markdown(tables.Given(spark, sf_dir, shared=True).reports)
    return texts.select(*run_columns(), "text")


# ---------------------------------------------------------------- projections

@query("normalize_appstore", sql(f"""
    SELECT substr(sha256('appstore:app:' || seq), 1, 16) AS id, product, author,
      CAST(greatest(1, least(5, seq % 9 - 1)) AS BIGINT) AS rating, title, md5(body) AS body,
      {when_sql("date + INTERVAL 7 HOUR")} AS date, '2.' || (seq % 4) AS version, CAST(raw_length AS BIGINT) AS raw_length
    FROM reviews WHERE store = 'appstore' AND seq % 11 <> 0 AND seq % 13 <> 0 AND seq % 7 <> 0""", "reviews"))
def normalize_appstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    when = F.when(seq % 11 == 0, "not a date").otherwise(F.concat(_iso(), F.lit("-07:00")))
    rating = F.when(seq % 13 == 0, "good").otherwise((seq % 9 - 1).cast("string"))
    version = F.when(seq % 7 != 0, F.concat(F.lit("2."), (seq % 4).cast("string")))
    entries = tables.reviews(spark, sf_dir).where(F.col("store") == "appstore").select(
        "product", F.lit("app").alias("app_id"), F.floor(seq / PAGE_ROWS).cast("int").alias("page"),
        F.pmod(seq, F.lit(PAGE_ROWS)).cast("int").alias("pos"), _entry(when, rating, version).alias("entry"))
    rows = normalise.normalize_appstore(entries)
    return longs(rows.select(
        "id", "product", "author", "rating", "title", F.md5("body").alias("body"), when_text("date").alias("date"),
        "version", "raw_length"), "rating", "raw_length")


@query("normalize_playstore", sql(f"""
    SELECT substr(sha256('playstore:app:' || seq), 1, 16) AS id, product,
      CASE WHEN seq % 9 = 0 THEN 'Unknown' ELSE author END AS author,
      CAST(CASE WHEN seq % 11 = 0 THEN 1 ELSE rating END AS BIGINT) AS rating,
      md5(CASE WHEN seq % 15 = 0 THEN '' ELSE body END) AS body, {when_sql('date')} AS date, version,
      CAST(CASE WHEN seq % 15 = 0 THEN 0 ELSE raw_length END AS BIGINT) AS raw_length
    FROM reviews WHERE store = 'playstore' AND seq % 7 <> 0 AND seq % 13 <> 0 AND seq % 17 <> 0""", "reviews"))
def normalize_playstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("reviewId").cast("long")
    gap = lambda every, column: F.when(n % every != 0, F.col(column))
    raw = _scraped(tables.reviews(spark, sf_dir)).withColumns({
        "userName": gap(9, "userName"), "content": gap(15, "content"), "score": F.when(n % 17 == 0, "bad").when(
            n % 11 != 0, F.col("score")), "at": F.when(n % 13 == 0, "soon").otherwise(F.col("at"))})
    raw = raw.withColumn("reviewId", F.when(n % 7 == 0, "").otherwise(F.col("reviewId")))
    return longs(normalise.normalize_playstore(raw).select(
        "id", "product", "author", "rating", F.md5("body").alias("body"), when_text("date").alias("date"), "version",
        "raw_length"), "rating", "raw_length")


@query("review_id", "SELECT doc_id, substr(sha256('playstore:' || source || ':' || doc_id), 1, 16) AS id FROM documents")
def review_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select(
        "doc_id", keys.review_id(F.lit("playstore"), F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@query("rating_clamp", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,"
       " CAST(greatest(1, least(5, l_linenumber * 2 - 3)) AS BIGINT) AS rating FROM lineitem")
def rating_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", keys.clamp_rating(F.col("l_linenumber") * 2 - 3).alias("rating")),
        "l_linenumber", "rating")


@query("to_utc", f"""
    SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN {when_sql('ts')}
      WHEN 1 THEN {when_sql("ts - INTERVAL 330 MINUTE")} ELSE {when_sql("ts + INTERVAL 7 HOUR")} END AS utc FROM events""")
def to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    n = F.col("event_id") % 4
    label = (F.when(n == 3, F.concat(F.lit("on "), base)).when(n == 2, base)
             .when(n == 1, F.concat(base, F.lit("+05:30"))).otherwise(F.concat(base, F.lit("-07:00"))))
    return tables.table(spark, sf_dir, "events").select("event_id", when_text(keys.to_utc(label)).alias("utc"))


@query("raw_length", "SELECT doc_id, length(text) AS raw_length, n_chars FROM documents")
def raw_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(tables.documents(spark, sf_dir).select(
        "doc_id", keys.raw_length(F.col("text")).alias("raw_length"), "n_chars"), "raw_length")


@query("quarantine_invalid", sql("""
    SELECT id, CASE WHEN seq % 23 = 0 THEN 'unknown store' WHEN seq % 19 = 0 THEN 'rating out of range'
      WHEN seq % 17 = 0 THEN 'no body' WHEN seq % 29 = 0 THEN 'no date' END AS reason FROM reviews""", "reviews"))
def quarantine_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    rows = tables.reviews(spark, sf_dir).withColumns({
        "store": F.when(seq % 23 == 0, "webstore").otherwise(F.col("store")),
        "rating": F.when(seq % 19 == 0, F.lit(9)).otherwise(F.col("rating")),
        "body": F.when(seq % 17 != 0, F.col("body")), "date": F.when(seq % 29 != 0, F.col("date"))})
    valid, rejected = normalise.quarantine_invalid(rows)
    return valid.select("id", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("id", "reason"))


@query("embedding_text", sql(r"""
    SELECT id, md5(CASE WHEN title IS NULL OR seq % 6 = 0 THEN body ELSE title || chr(10) || body END) AS text
    FROM reviews""", "reviews"))
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("seq") % 6 == 0, "").otherwise(F.col("title"))
    return tables.reviews(spark, sf_dir).select(
        "id", F.md5(text.embedding_text(title, F.col("body"))).alias("text"))


@query("joined_text", sql("""
    SELECT id, md5(CASE WHEN title IS NULL THEN body ELSE title || ' ' || body END) AS plain,
      md5(CASE WHEN title IS NULL THEN body ELSE title || ' - ' || body END) AS dashed FROM reviews""", "reviews"))
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, body = F.col("title"), F.col("body")
    return tables.reviews(spark, sf_dir).select(
        "id", F.md5(text.join_title(title, body, " ")).alias("plain"),
        F.md5(text.join_title(title, body, " - ")).alias("dashed"))


def _keyed(spark: SparkSession, sf_dir: str, build, name: str) -> DataFrame:
    rows = tables.updates(spark, sf_dir)
    return rows.select("run_id", build(F.col("product"), F.col("iso_year"), F.col("iso_week")).alias(name))


def _keyed_sql(a: str, b: str, name: str) -> str:
    return sql(f"SELECT run_id, product || '{a}' || iso_year || '{b}W' || lpad(CAST(iso_week AS VARCHAR), 2, '0')"
               f" AS {name} FROM updates", "updates")


@query("run_key", _keyed_sql(":", ":", "run_key"))
def run_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, keys.run_key, "run_key")


@query("section_anchor", _keyed_sql("-", "-", "anchor"))
def section_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, keys.section_anchor, "anchor")


@query("report_key", _keyed_sql("_", "_", "report_key"))
def report_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, keys.report_key, "report_key")


@query("run_flags", sql("""
    SELECT run_id, done AS is_complete, status = 'partial' AS is_partial, done OR n % 4 = 0 AS doc_delivered,
      done AS email_delivered FROM updates""", "updates"))
def run_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_ops.run_flags(tables.updates(spark, sf_dir)).select(
        "run_id", "is_complete", "is_partial", "doc_delivered", "email_delivered")


@query("run_metadata", sql(f"""
    SELECT {RUN_SQL}, display_name, {when_sql('CAST(window_start AS TIMESTAMP)')} AS window_start,
      {when_sql('CAST(window_end AS TIMESTAMP)')} AS window_end, total_reviews
    FROM grid JOIN (SELECT {RUN}, count(*) AS total_reviews FROM all_members GROUP BY ALL) USING ({RUN})""",
                           "grid", "all_members"))
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = tables.Given(spark, sf_dir)
    bare = report.rolling_counts_by_store(given.reviews.select("product", "store", "date")).select(
        *RUN_KEY, F.lit("").alias("display_name"), F.col("total").alias("total_reviews"))
    stamped = report.run_metadata(bare, tables.grid_of(bare, given.products))
    return stamped.select(
        *run_columns(), "display_name", when_text("review_window_start").alias("window_start"),
        when_text("review_window_end").alias("window_end"), "total_reviews")


@query("report_summary", sql(f"""
    SELECT {RUN_SQL}, 'We analyzed ' || total_reviews || ' reviews and extracted ' || clusters_found || ' core themes.'
      || CASE WHEN len(themes) > 0 THEN ' The leading concern was related to ''' || themes[1].name || '''.' ELSE '' END
      AS summary, coalesce(themes[1].name, 'N/A') AS primary_signal, total_reviews || ' reviews analyzed' AS evidence,
      coalesce(themes[1].actions[1].title, 'N/A') AS focus FROM reports""", "reports"))
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.report_summary(tables.Given(spark, sf_dir, shared=True).reports)
    return rows.select(*run_columns(), "summary", "primary_signal", "evidence", "focus")


# ---------------------------------------------------------------- filters

@query("window_start_filter", sql("SELECT id, product FROM reviews WHERE date >= TIMESTAMP '2024-01-14 00:00:00'", "reviews"))
def window_start_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = weeks.window_start(F.lit(2024), F.lit(12)).cast("timestamp")
    return ingest.window_start_filter(tables.reviews(spark, sf_dir), start).select("id", "product")


@query("window_end_filter", sql("SELECT id, product FROM reviews WHERE date < TIMESTAMP '2024-02-19 00:00:00'", "reviews"))
def window_end_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.window_end_filter(tables.reviews(spark, sf_dir), weeks.week_sunday(F.lit(2024), F.lit(7))).select(
        "id", "product")


@query("has_letter", sql(r"""
    SELECT id FROM (SELECT id, CASE seq % 5 WHEN 0 THEN '12 !!' WHEN 1 THEN '😀' WHEN 2 THEN '' WHEN 3 THEN
      CAST(raw_length AS VARCHAR) ELSE body END AS body FROM reviews) WHERE regexp_matches(body, '\p{L}')""", "reviews"))
def has_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("seq") % 5
    body = (F.when(kind == 0, "12 !!").when(kind == 1, "😀").when(kind == 2, "")
            .when(kind == 3, F.col("raw_length").cast("string")).otherwise(F.col("body")))
    return tables.reviews(spark, sf_dir).withColumn("body", body).where(text.has_letter(F.col("body"))).select("id")


@query("source_configured", sql("""
    SELECT id, product, store FROM reviews JOIN products ON slug = product
    WHERE CASE WHEN store = 'appstore' THEN appstore_id ELSE playstore_id END <> ''""", "reviews", "products"))
def source_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir).select("id", "product", "store")
    return ingest.source_configured(rows, tables.products(spark, sf_dir)).select("id", "product", "store")


@query("incremental_cutoff", sql(f"""
    SELECT product, count(*) AS reviews, {when_sql('min(date)')} AS oldest FROM reviews
    WHERE date >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY product""", "reviews"))
def incremental_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "by-day")
    review_store.write_by_day(tables.reviews(spark, sf_dir).select("id", "product", "date"), path)
    recent = review_store.read_since(spark, path, datetime(2024, 1, 20, 12))
    return recent.groupBy("product").agg(
        F.count("*").alias("reviews"), when_text(F.min("date")).alias("oldest"))


@query("noise_exclude", sql(f"SELECT {RUN_SQL}, id, CAST(label AS BIGINT) AS label FROM all_members WHERE label <> -1", "all_members"))
def noise_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.noise_exclude(tables.every_member(spark, sf_dir))
    return rows.select(*run_columns(), "id", F.col("label").cast("long").alias("label"))


@query("validated_only", sql(f"""
    SELECT {RUN_SQL}, CAST(label AS BIGINT) AS label, count(*) FILTER (validated) AS quotes,
      coalesce(string_agg(text, '|' ORDER BY quote_no) FILTER (validated), '') AS texts
    FROM checked GROUP BY ALL""", "checked"))
def validated_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tables.Given(spark, sf_dir, shared=True).checked.groupBy(*RUN_KEY, "label").agg(
        F.sort_array(F.collect_list(F.struct("quote_no", "text", "validated"))).alias("quotes"))
    kept = lists.withColumn("kept", report.validated_only(F.col("quotes")))
    return kept.select(
        *run_columns(), F.col("label").cast("long").alias("label"), F.size("kept").cast("long").alias("quotes"),
        F.array_join(F.transform("kept", lambda q: q["text"]), "|").alias("texts"))


@query("failed_runs", sql(f"""
    SELECT {RUN_SQL}, run_id, status FROM ledger WHERE status IN ('partial', 'failed')
    ORDER BY started_at DESC, run_id LIMIT 100""", "ledger"))
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_ops.failed_runs(tables.ledger(spark, sf_dir), 100).select(*run_columns(), "run_id", "status")


@query("required_key_lookup", sql("""
    SELECT DISTINCT 'src' || (user_id % 25) AS slug, slug IS NOT NULL AS known
    FROM events LEFT JOIN products ON slug = 'src' || (user_id % 25)""", "products"))
def required_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = tables.table(spark, sf_dir, "events").select(
        F.concat(F.lit("src"), F.pmod("user_id", F.lit(25)).cast("string")).alias("slug")).distinct()
    missing = registry.unknown_products(requested, tables.products(spark, sf_dir)).withColumn("known", F.lit(False))
    return requested.join(missing, "slug", "left").withColumn("known", F.coalesce("known", F.lit(True)))


# ---------------------------------------------------------------- scrubbing

def _register_scrub(name: str, rule: str) -> None:
    @query(name, sql(f"SELECT id, md5({scrub_stage(rule, 'body')}) AS body FROM reviews", "reviews"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.reviews(spark, sf_dir).select("id", F.md5(pii.scrub_one(F.col("body"), rule)).alias("body"))


for _name, _rule in (("scrub_email", "email"), ("scrub_upi", "upi"), ("scrub_phone_in", "phone_in"),
                     ("scrub_national_id", "national_id"), ("scrub_phone_intl", "phone_intl"), ("scrub_pan", "pan")):
    _register_scrub(_name, _rule)


@query("anonymize_author", sql("""
    SELECT id, CASE WHEN seq % 4 = 0 THEN '' ELSE '[NAME]' END AS author FROM reviews""", "reviews"))
def anonymize_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("author"))
    return tables.reviews(spark, sf_dir).select("id", pii.anonymize_author(author).alias("author"))


@query("pii_scrub", sql(f"SELECT id, '[NAME]' AS author, {scrub('title')} AS title, {scrub('body')} AS body FROM reviews",
                        "reviews"))
def pii_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir).select("id", "author", "title", "body")
    return pii.scrub_columns(rows)


def _stats_sql() -> str:
    """Per stage and column: how many placeholders it added."""
    placeholder = {"email": "[EMAIL]", "upi": "[UPI_ID]", "phone_in": "[PHONE]", "national_id": "[ID]",
                   "phone_intl": "[PHONE]", "pan": "[PAN]"}
    counter = {"email": "emails_scrubbed", "upi": "upi_scrubbed", "phone_in": "phones_scrubbed",
               "national_id": "ids_scrubbed", "phone_intl": "phones_scrubbed", "pan": "pan_scrubbed"}
    inner = "SELECT product, date, coalesce(title, '') AS t0, body AS b0 FROM reviews"
    for i, rule in enumerate(STAGES):
        inner = (f"SELECT *, {scrub_stage(rule, f't{i}')} AS t{i + 1}, {scrub_stage(rule, f'b{i}')} AS b{i + 1}"
                 f" FROM ({inner})")
    sums: dict[str, list[str]] = {}
    for i, rule in enumerate(STAGES):
        for c in "tb":
            sums.setdefault(counter[rule], []).append(hits(f"{c}{i}", f"{c}{i + 1}", placeholder[rule]))
    totals = ", ".join(f"CAST(sum({' + '.join(parts)}) AS BIGINT) AS {name}" for name, parts in sums.items())
    return sql(f"SELECT product, isoyear(date) AS iso_year, week(date) AS iso_week, {totals},"
               f" count(*) AS authors_anonymized FROM ({inner}) GROUP BY ALL", "reviews")


@query("pii_stats", _stats_sql())
def pii_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weeks.own_week(tables.reviews(spark, sf_dir))
    stats = pii.pii_stats(rows, RUN_KEY)
    return stats.select(*run_columns(), *pii.COUNTERS, "authors_anonymized")


_TITLE_NAME = r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"


def _find_names(texts: pd.Series) -> tuple[pd.Series, pd.Series]:
    """A stand-in detector: two capitalised words in a row."""
    return texts.str.replace(_TITLE_NAME, "[NAME]", regex=True), texts.str.count(_TITLE_NAME)


@query("scrub_names", rf"""
    SELECT doc_id, md5(regexp_replace(text, '{_TITLE_NAME}', '[NAME]', 'g')) AS text,
      len(regexp_extract_all(text, '{_TITLE_NAME}')) AS names_scrubbed FROM
      (SELECT doc_id, regexp_replace(text, '[^ -~]', '.', 'g') AS text FROM documents)""")
def scrub_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_only = tables.documents(spark, sf_dir).select(
        "doc_id", F.regexp_replace("text", "[^ -~]", ".").alias("text"))
    return pii.scrub_names(ascii_only, "text", _find_names).withColumn("text", F.md5("text"))


# ---------------------------------------------------------------- set operations

@query("union_sources", sql(f"""
    SELECT id, store, seq + CASE WHEN store = 'playstore' THEN {ingest.SEQ_PER_SOURCE} ELSE 0 END AS seq FROM reviews""", "reviews"))
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir).select("id", "store", "seq")
    return ingest.union_sources(rows.where("store = 'appstore'"), rows.where("store = 'playstore'"))


@query("dedupe_last_wins", sql("""
    SELECT id, md5(arg_max(body, seq)) AS body, min(seq) AS seq FROM polls GROUP BY id""", "polls"))
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.dedupe_last_wins(tables.polls(spark, sf_dir))
    return rows.select("id", F.md5("body").alias("body"), "seq")


@query("degrade_missing_source", sql("""
    SELECT store AS source, count(*) AS reviews, true AS ok FROM reviews WHERE store = 'playstore' GROUP BY ALL
    UNION ALL SELECT 'appstore', 0, false""", "reviews"))
def degrade_missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir)
    app, app_status = feeds.read_or_empty(
        spark, "appstore", rows.schema, lambda: spark.read.schema(rows.schema).parquet(f"{sf_dir}/appstore-feed-missing"))
    play, play_status = feeds.read_or_empty(
        spark, "playstore", rows.schema, lambda: rows.where("store = 'playstore'"))
    counts = ingest.union_sources(app, play).groupBy(F.col("store").alias("source")).agg(F.count("*").alias("reviews"))
    return app_status.unionByName(play_status).join(counts, "source", "left").select(
        "source", F.coalesce("reviews", F.lit(0)).alias("reviews"), "ok")


def _spoil(spark: SparkSession, path: str) -> None:
    """A file that is cut off in the middle of a line, and one that is not what its name says."""
    spark.range(1).select(F.lit('{"product": "x", "batch": 7, "content": "cut o').alias("value")).coalesce(1).write.text(f"{path}/part=cut")
    spark.range(1).select(F.lit("no archive at all").alias("value")).coalesce(1).write.text(f"{path}/part=gz")
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/part=gz")
    fs = folder.getFileSystem(conf)
    for status in fs.listStatus(folder):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, "rows.json.gz"))


@query("degrade_broken_files", sql("""
    SELECT 'playstore' AS source, CAST(seq % 4 AS VARCHAR) AS part, count(*) AS rows, 0::BIGINT AS broken, true AS ok FROM reviews
    WHERE store = 'playstore' GROUP BY ALL
    UNION ALL SELECT 'appstore', '', (SELECT count(DISTINCT (product, seq // 1000)) FROM reviews WHERE store = 'appstore'), 0, true
    UNION ALL SELECT 'playstore', 'cut', 0, 1, false UNION ALL SELECT 'playstore', 'gz', 0, 0, false
    UNION ALL SELECT 'missing', '', 0, 0, false""", "reviews"))
def degrade_broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two stores, one cut off, one unreadable, and a folder that is not there: what each gave."""
    path = scratch_path(spark, "landed")
    reviews = tables.reviews(spark, sf_dir)
    _landed_pages(reviews).write.json(f"{path}/app")
    _scraped(reviews).withColumn("part", F.pmod(F.col("reviewId").cast("long"), F.lit(4))).write.partitionBy("part").json(f"{path}/play")
    _spoil(spark, f"{path}/play")
    found = [feeds.read_landed(spark, "appstore", f"{path}/app", RAW_PAGE), feeds.read_landed(spark, "playstore", f"{path}/play/*/", SCRAPE_ROW),
             feeds.read_landed(spark, "missing", f"{path}/nowhere", SCRAPE_ROW)]
    files = found[0][1].unionByName(found[1][1]).unionByName(found[2][1])
    part = F.regexp_extract("file", r"part=(\w+)/", 1)
    return files.where("NOT (ok AND bytes = 0)").groupBy("source", part.alias("part")).agg(
        F.sum("rows").alias("rows"), F.sum("broken").alias("broken"), F.min("ok").alias("ok"))


LANDED_PAGE = 50


@query("landed_reviews", sql(f"""
    SELECT id, store, product, md5(arg_max(body, poll)) AS body FROM (
      SELECT id, store, product, body, 0 AS poll FROM reviews
      UNION ALL SELECT id, store, product, body || ' (edited)', 1 FROM (SELECT *, seq // {LANDED_PAGE} AS page FROM reviews WHERE seq % 10 = 0)
        LEFT JOIN (SELECT product, min(seq // {LANDED_PAGE}) AS broken FROM reviews
          WHERE store = 'appstore' AND seq % 10 = 0 AND (seq // {LANDED_PAGE}) % 7 = 3 GROUP BY product) USING (product)
        WHERE store = 'playstore' OR broken IS NULL OR page < broken) GROUP BY ALL""", "reviews"))
def landed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two polls of both stores from landed folders, some pages of the second broken, with spoilt files among the rest: the last polls."""
    path = scratch_path(spark, "landed")
    first = tables.reviews(spark, sf_dir)
    second = first.where(F.col("seq") % 10 == 0).withColumn("body", F.concat("body", F.lit(" (edited)")))
    for poll, rows in enumerate((first, second)):
        pages = _landed_pages(rows, LANDED_PAGE)
        if poll:
            pages = pages.withColumn("payload", F.when((F.col("page") - 1) % 7 == 3, F.substring("payload", 1, 30)).otherwise(F.col("payload")))
        pages.withColumn("poll", F.lit(poll)).write.json(f"{path}/app/poll={poll}")
        _scraped(rows).withColumn("poll", F.lit(poll)).write.json(f"{path}/play/poll={poll}")
    _spoil(spark, f"{path}/play")
    landed = landed_plan.landed_reviews(spark, f"{path}/app/*/", f"{path}/play/*/", Settings(max_feed_pages=1 << 30))
    return ingest.dedupe_last_wins(landed.reviews).select("id", "store", "product", F.md5("body").alias("body"))
