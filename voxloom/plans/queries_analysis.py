"""Queries: order and top-k, joins, aggregations, vectors, clusters, themes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.functions import ranking, text
from voxloom.functions.pii import scrub_columns
from voxloom.functions.pricing import price_of
from voxloom.functions.weeks import assign_windows
from voxloom.operators import cluster, cost, embed, ingest, ledger as ledger_ops, quotes, readside, reduce, render, report
from voxloom.operators import density, themes
from voxloom.plans import tables
from voxloom.plans.catalog import RUN_SQL, longs, query, run_columns, when_sql, when_text
from voxloom.plans.oracle import RUN, price, scrub, sql, windows
from voxloom.plans.queries_ingest import _PREVIEW_SQL, _with_preview
from voxloom.schemas import RUN_KEY

# The wording of prompts, theme names and control characters in the SQL below has to equal that of the operators.

LABEL_SQL = "CAST(label AS BIGINT) AS label"


def label() -> Column:
    return F.col("label").cast("long").alias("label")


def pos_column(name: str = "pos") -> Column:
    return F.col(name).cast("long").alias(name)


# ---------------------------------------------------------------- order and top-k

@query("newest_first", sql("""
    SELECT product, id, row_number() OVER (PARTITION BY product ORDER BY date DESC, seq) AS pos FROM reviews""", "reviews"))
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir).select("product", "id", "date", "seq")
    return ingest.newest_first(rows, ("product",)).select("product", "id", pos_column())


@query("cap_per_product", sql(f"SELECT product, id, pos FROM newest WHERE pos <= {tables.MAX_RUN}", "newest"))
def cap_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir).select("product", "id", "date", "seq")
    return ingest.cap_per_product(rows, tables.MAX_RUN, ("product",)).select("product", "id", pos_column())


@query("cap_per_store", sql("""
    SELECT product, store, id FROM (SELECT *, row_number() OVER (PARTITION BY product, store ORDER BY seq) AS n
    FROM reviews) WHERE n <= 20""", "reviews"))
def cap_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir).select("product", "store", "id", "seq")
    return ingest.cap_per_store(rows, 20, ("product",)).drop("seq")


@query("top_clusters", sql(f"SELECT {RUN_SQL}, {LABEL_SQL}, size, rank FROM all_top", "all_top"))
def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.Given(spark, sf_dir).every_cluster.select(*run_columns(), label(), "size", pos_column("rank"))


@query("rank_themes", sql(f"SELECT {RUN_SQL}, {LABEL_SQL}, name, theme_no FROM themes", "themes"))
def rank_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.Given(spark, sf_dir).themes.select(*run_columns(), label(), "name", pos_column("theme_no"))


@query("email_topk", sql(f"""
    SELECT {RUN_SQL}, array_to_string(list_transform(themes[1:3], lambda t: t.name), '|') AS themes,
      array_to_string(flatten(list_transform(themes[1:3], lambda t: list_transform(t.actions[1:2],
        lambda a: t.name || ':' || a.title))), '|') AS actions FROM reports""", "reports"))
def email_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, actions = render.email_topk(F.col("themes"))
    return tables.Given(spark, sf_dir, shared=True).reports.select(
        *run_columns(), F.array_join(F.transform(top, lambda t: t["name"]), "|").alias("themes"),
        F.array_join(F.transform(actions, lambda a: F.concat(a["theme"], F.lit(":"), a["title"])), "|").alias("actions"))


@query("quote_topk", sql(f"""
    SELECT {RUN_SQL}, t.label::BIGINT AS label, array_to_string(list_transform(t.quotes[1:3], lambda q: q.text), '|') AS quotes
    FROM (SELECT {RUN}, unnest(themes) AS t FROM reports)""", "reports"))
def quote_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.Given(spark, sf_dir, shared=True).reports.select(*RUN_KEY, F.explode("themes").alias("t"))
    return rows.select(
        *run_columns(), F.col("t.cluster_label").cast("long").alias("label"),
        F.array_join(F.transform(render.quote_topk(F.col("t.quotes")), lambda q: q["text"]), "|").alias("quotes"))


@query("run_history", sql(f"""
    SELECT {RUN_SQL}, run_id, status FROM ledger WHERE product = 'src3' ORDER BY started_at DESC, run_id LIMIT 10""", "ledger"))
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_ops.run_history(tables.ledger(spark, sf_dir), "src3", 10).select(*run_columns(), "run_id", "status")


@query("runs_by_product", sql(f"""
    SELECT {RUN_SQL}, run_id, run_no FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY started_at DESC, run_id)
      AS run_no FROM ledger)""", "ledger"))
def runs_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_ops.runs_by_product(tables.ledger(spark, sf_dir))
    return rows.select(*run_columns(), "run_id", pos_column("run_no"))


@query("number_items", sql(f"""
    SELECT {RUN_SQL}, {LABEL_SQL}, id, row_number() OVER (PARTITION BY {RUN}, label ORDER BY pos) AS n
    FROM all_members WHERE label <> -1""", "all_members"))
def number_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.noise_exclude(tables.every_member(spark, sf_dir))
    numbered = cluster.number_items(found, (*RUN_KEY, "label"), [F.col("pos")])
    return numbered.select(*run_columns(), label(), "id", pos_column("n"))


@query("token_budget", """
    SELECT conv_id, turn, tokens, tokens_before FROM (
      SELECT *, coalesce(CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING) AS BIGINT), 0) AS tokens_before
      FROM (SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS tokens
            FROM conversations))
    WHERE tokens_before <= 120""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = tables.calls(spark, sf_dir).withColumn("tokens", F.col("input_tokens") + F.col("output_tokens"))
    kept = cost.token_budget(calls, "tokens", 120, ("conv_id",), rank="turn")
    return kept.select("conv_id", "turn", "tokens", "tokens_before")


@query("embed_budget", sql("""
    SELECT product, id, batch FROM (SELECT *, sum(total) OVER (PARTITION BY product ORDER BY batch) AS spent
      FROM (SELECT product, (pos - 1) // 10 AS batch, sum(raw_length) AS total FROM newest GROUP BY ALL))
    JOIN (SELECT product, id, (pos - 1) // 10 AS batch FROM newest) USING (product, batch)
    WHERE spent <= 60000""", "newest"))
def embed_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir).select("product", "id", "raw_length", "date", "seq")
    kept = embed.embed_budget(ingest.newest_first(rows, ("product",)), "raw_length", 60_000, 10, keys=("product",))
    return kept.select("product", "id", "batch")


# ---------------------------------------------------------------- joins

@query("assign_windows", sql(f"SELECT {RUN_SQL}, id FROM ({windows('reviews')})", "reviews"))
def assign_windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir).select("product", "id", "date")
    return assign_windows(rows).select(*run_columns(), "id")


@query("cluster_members", sql(f"""
    SELECT {RUN_SQL}, {LABEL_SQL}, id, row_number() OVER (PARTITION BY {RUN}, label ORDER BY pos) - 1 AS member_no,
      CAST(rating AS BIGINT) AS rating FROM all_members WHERE label <> -1""", "all_members"))
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.cluster_members(tables.every_member(spark, sf_dir), tables.reviews(spark, sf_dir).select("id", "rating"))
    return rows.select(*run_columns(), label(), "id", pos_column("member_no"), pos_column("rating"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as a cache of two models, for the reviews with the same number."""
    vectors = tables.table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("vec_id").cast("string").alias("review_id"), "embedding",
        F.when(F.col("vec_id") % 3 == 0, "old-model").otherwise("new-model").alias("model"))


@query("embedding_cache_split", """
    SELECT doc_id, vec_id IS NOT NULL AS cached FROM documents
    LEFT JOIN embeddings ON vec_id = doc_id AND vec_id % 3 <> 0""")
def embedding_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    have, lack = embed.split_cached(docs, _cache(spark, sf_dir), "new-model")
    return have.withColumn("cached", F.lit(True)).unionByName(lack.withColumn("cached", F.lit(False))).drop("id")


@query("validate_quotes", sql(f"SELECT {RUN_SQL}, {LABEL_SQL}, quote_no, text, validated FROM checked", "checked"))
def validate_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = tables.Given(spark, sf_dir, shared=True)
    checked = quotes.validate_quotes(given.quotes, given.chosen, given.reviews.select("id", "body"))
    return checked.select(*run_columns(), label(), pos_column("quote_no"), "text", "validated")


@query("quote_attribution", sql(f"""
    SELECT {RUN_SQL}, {LABEL_SQL}, quote_no, review_id, CAST(rating AS BIGINT) AS rating, store, {when_sql('date')} AS date
    FROM checked WHERE validated""", "checked"))
def quote_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.Given(spark, sf_dir, shared=True).checked.where("validated").select(
        *run_columns(), label(), pos_column("quote_no"), "review_id", pos_column("rating"), "store",
        when_text("date").alias("date"))


@query("runs_with_preview", sql(_PREVIEW_SQL, "run_ledger", "reports"))
def runs_with_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = tables.Given(spark, sf_dir, shared=True)
    rows = _with_preview(given, given.reports)
    return rows.select(
        *run_columns(), "run_id", "status", "doc_id", "preview.theme_name", "preview.quote", "preview.action")


@query("report_with_product", sql(f"""
    SELECT {RUN_SQL}, display_name, doc_id, total_reviews, CAST(len(themes) AS BIGINT) AS themes FROM reports""", "reports"))
def report_with_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = tables.Given(spark, sf_dir, shared=True)
    rows = readside.reports_with_product(given.reports, given.products)
    return rows.select(
        *run_columns(), "display_name", "doc_id", "stats.total_reviews", F.size("themes").cast("long").alias("themes"))


_WEEKS = tables.all_weeks()
_LAST_MONDAY = date.fromisocalendar(*_WEEKS[-1], 1)
_GRID_SQL = f"""
    SELECT slug AS product, isoyear(d) AS iso_year, week(d) AS iso_week, display_name, doc_id, d - 64 AS window_start,
      d + 6 AS window_end FROM products, (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '{_LAST_MONDAY}',
      INTERVAL 7 DAY)) AS DATE) AS d)"""


@query("run_grid", sql(f"""
    SELECT product, iso_year, iso_week, display_name, {when_sql('CAST(window_start AS TIMESTAMP)')} AS window_start,
      {when_sql('CAST(window_end AS TIMESTAMP)')} AS window_end FROM ({_GRID_SQL})""", "products"))
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = ingest.run_grid(tables.products(spark, sf_dir), _WEEKS)
    return grid.select(
        *run_columns(), "display_name", when_text("window_start").alias("window_start"),
        when_text("window_end").alias("window_end"))


_DELIVERED_SQL = """
    SELECT g.*, EXISTS (SELECT 1 FROM published p WHERE p.doc_id = g.doc_id AND contains(p.text, g.product || '-' ||
      g.iso_year || '-W' || lpad(CAST(g.iso_week AS VARCHAR), 2, '0'))) AS delivered"""


@query("anchor_exists", sql(f"SELECT product, iso_year, iso_week, delivered FROM ({_DELIVERED_SQL} FROM ({_GRID_SQL}) g)",
                            "products", "published"))
def anchor_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = tables.products(spark, sf_dir)
    rows = ledger_ops.anchor_exists(ingest.run_grid(listed, _WEEKS), tables.published(spark, sf_dir), listed)
    return rows.select(*run_columns(), "delivered")


@query("idempotency_decision", sql(f"""
    SELECT product, iso_year, iso_week, CASE WHEN status = 'completed' THEN 'skip' WHEN status IN ('partial', 'running')
      THEN 'resume' WHEN status = 'failed' THEN 'run' WHEN delivered THEN 'skip' ELSE 'run' END AS decision
    FROM ({_DELIVERED_SQL} FROM ({_GRID_SQL}) g) LEFT JOIN run_ledger USING ({RUN})""", "products", "published", "run_ledger"))
def idempotency_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = tables.Given(spark, sf_dir)
    listed, known = given.products, tables.run_records(given.grid)
    rows = ledger_ops.idempotency_decision(
        ingest.run_grid(listed, _WEEKS), known, tables.published(spark, sf_dir), listed)
    return rows.select(*run_columns(), "decision")


@query("price_lookup", sql(f"""
    SELECT conv_id, turn, model, {price('model', 'input')} AS price_in, {price('model', 'output')} AS price_out FROM calls""",
                           "calls"))
def price_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = price_of(F.col("model"))
    return tables.calls(spark, sf_dir).select(
        "conv_id", "turn", "model", row["input"].alias("price_in"), row["output"].alias("price_out"))


@query("review_product", sql("""
    SELECT id, product, display_name, doc_id, recipients FROM reviews JOIN products ON slug = product""", "reviews", "products"))
def review_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.review_product(tables.reviews(spark, sf_dir).select("id", "product"), tables.products(spark, sf_dir))
    return rows.select("id", "product", "display_name", "doc_id", F.array_join("stakeholder_emails", ", ").alias("recipients"))


# ---------------------------------------------------------------- aggregations

@query("counts_by_store", sql(f"""
    SELECT {RUN_SQL}, count(*) AS total, count(*) FILTER (store = 'appstore') AS appstore,
      count(*) FILTER (store = 'playstore') AS playstore FROM ({windows('reviews')}) GROUP BY ALL""", "reviews"))
def counts_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.reviews(spark, sf_dir).select("product", "store", "date")
    return report.rolling_counts_by_store(rows).select(*run_columns(), "total", "appstore", "playstore")


@query("cluster_stats", sql(f"""
    SELECT {RUN_SQL}, {LABEL_SQL}, count(*) AS size, round(avg(rating), 6) AS avg_rating,
      arg_min(id, pos) AS first_id, arg_max(id, pos) AS last_id FROM all_members WHERE label <> -1 GROUP BY ALL""", "all_members"))
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.cluster_stats(tables.every_member(spark, sf_dir))
    return rows.select(*run_columns(), label(), "size", F.round("avg_rating", 6).alias("avg_rating"), "first_id", "last_id")


@query("noise_count", sql(f"""
    SELECT {RUN_SQL}, count(*) FILTER (label = -1) AS noise_reviews, count(*) FILTER (label <> -1) AS clustered_reviews
    FROM all_members GROUP BY ALL""", "all_members"))
def noise_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.noise_count(tables.every_member(spark, sf_dir))
    return rows.select(*run_columns(), "noise_reviews", "clustered_reviews")


@query("quote_validation_rate", sql(f"""
    SELECT {RUN_SQL}, {LABEL_SQL}, count(*) AS proposed, count(*) FILTER (validated) AS validated,
      round(count(*) FILTER (validated) / count(*), 6) AS rate,
      count(*) FILTER (validated) / count(*) < 0.5 AS low FROM checked GROUP BY ALL""", "checked"))
def quote_validation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes.quote_validation_rate(tables.Given(spark, sf_dir, shared=True).checked, (*RUN_KEY, "label"))
    return rows.select(
        *run_columns(), label(), F.col("quotes_proposed").alias("proposed"), F.col("quotes_validated").alias("validated"),
        F.round("rate", 6).alias("rate"), "low")


@query("token_cost", sql(f"""
    SELECT conv_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
      round(sum(input_tokens / 1000.0::DOUBLE * {price('model', 'input')} + output_tokens / 1000.0::DOUBLE
        * {price('model', 'output')}), 8) AS cost_usd FROM calls GROUP BY conv_id""", "calls"))
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cost.run_cost(tables.calls(spark, sf_dir), ("conv_id",))
    return rows.select(
        "conv_id", "input_tokens", "output_tokens", F.round("estimated_cost_usd", 8).alias("cost_usd"))


@query("cost_alerts", sql(f"""
    SELECT {RUN_SQL}, input_tokens, output_tokens, round(cost, 6) AS cost_usd,
      input_tokens + output_tokens > 20000 AS over_tokens, cost > 0.02 AS over_cost
    FROM all_costs WHERE input_tokens + output_tokens > 20000 OR cost > 0.02""", "all_costs"))
def cost_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = cost.run_cost(tables.run_calls(tables.Given(spark, sf_dir).every_cluster))
    rows = cost.cost_alerts(totals, 20_000, 0.02)
    return rows.select(
        *run_columns(), "input_tokens", "output_tokens", F.round("estimated_cost_usd", 6).alias("cost_usd"),
        "over_tokens", "over_cost")


_COUNTERS = ("total_reviews", "appstore_reviews", "playstore_reviews", "clusters_found", "noise_reviews",
             "themes_generated", "quotes_proposed", "quotes_validated", "input_tokens", "output_tokens")


@query("run_stats", sql(f"SELECT {RUN_SQL}, {', '.join(_COUNTERS)}, round(cost, 8) AS cost_usd FROM stats", "stats"))
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.Given(spark, sf_dir, shared=True).stats
    return rows.select(*run_columns(), *_COUNTERS, F.round("estimated_cost_usd", 8).alias("cost_usd"))


@query("assemble_report", sql(f"""
    SELECT {RUN_SQL}, display_name, {when_sql('CAST(window_start AS TIMESTAMP)')} AS window_start,
      array_to_string(list_transform(themes, lambda t: t.name || '/' || t.size || '/' || t.description), '|') AS themes,
      array_to_string(flatten(list_transform(themes, lambda t: list_transform(t.quotes, lambda q: q.text))), '|') AS quotes,
      array_to_string(flatten(list_transform(themes, lambda t: list_transform(t.actions, lambda a: a.title))), '|') AS actions,
      total_reviews, noise_reviews, input_tokens FROM reports""", "reports"))
def assemble_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = lambda field, sub: F.array_join(F.flatten(F.transform(
        "themes", lambda t: F.transform(t[field], lambda x: x[sub]))), "|")
    return tables.Given(spark, sf_dir, shared=True).reports.select(
        *run_columns(), "display_name", when_text("review_window_start").alias("window_start"),
        F.array_join(F.transform("themes", lambda t: F.concat_ws(
            "/", t["name"], t["review_count"].cast("string"), t["description"])), "|").alias("themes"),
        texts("quotes", "text").alias("quotes"), texts("actions", "title").alias("actions"),
        "stats.total_reviews", "stats.noise_reviews", "stats.llm_usage.input_tokens")


@query("overview_totals", sql("""
    SELECT CAST(sum(n % 50 + n % 70) AS BIGINT) AS reviews, CAST(sum(n % 5) AS BIGINT) AS themes,
      CAST(3 * sum(n % 5) AS BIGINT) AS actions, CAST(sum(n % 13) AS BIGINT) AS quotes
    FROM ledger WHERE status IN ('completed', 'partial')""", "ledger"))
def overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_ops.overview_totals(tables.ledger(spark, sf_dir))


@query("audit_questions", sql(f"""
    SELECT {RUN_SQL}, run_id, status, CASE WHEN n % 2 = 0 THEN 'draft' ELSE 'send' END AS email_mode,
      CASE WHEN done THEN CASE WHEN n % 2 = 0 THEN 'd' ELSE 'm' END || n END AS email_ref, n % 50 + n % 70 AS reviews,
      0.0::DOUBLE AS cost_usd, done AS delivered, status = 'partial' AS is_partial FROM ledger""", "ledger"))
def audit_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_ops.audit_questions(tables.ledger(spark, sf_dir)).select(
        *run_columns(), "run_id", "status", "email_mode", "email_ref", "reviews", "cost_usd", "delivered", "is_partial")


@query("latest_run_health", sql("""
    SELECT run_id, status, CASE status WHEN 'failed' THEN 'critical' WHEN 'partial' THEN 'warning' WHEN 'running' THEN 'info'
      WHEN 'completed' THEN 'ok' ELSE 'unknown' END AS severity,
      CAST(CASE status WHEN 'failed' THEN 2 ELSE 0 END AS BIGINT) AS exit_code
    FROM ledger ORDER BY started_at DESC, n DESC LIMIT 1""", "ledger"))
def latest_run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(ledger_ops.latest_run_health(tables.ledger(spark, sf_dir)), "exit_code")


# ---------------------------------------------------------------- vectors and clusters

_THOUSANDTHS_SQL = "array_to_string(list_transform({v}, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ',')"


@query("embed_reviews", sql(f"""
    SELECT id, {_THOUSANDTHS_SQL.format(v='embedding')} AS vector FROM (
      SELECT CAST(seq AS VARCHAR) AS id, embedding FROM reviews JOIN embeddings ON vec_id = seq AND vec_id % 3 <> 0
      UNION ALL SELECT id, list(CAST(coalesce(v / norm, 0) AS FLOAT) ORDER BY i) FROM (
        SELECT k.id, k.i, v, sqrt(sum(v * v) OVER (PARTITION BY k.id)) AS norm
        FROM (SELECT CAST(seq AS VARCHAR) AS id, i FROM reviews ANTI JOIN (SELECT vec_id AS seq FROM embeddings WHERE vec_id % 3 <> 0) USING (seq),
          range(128) t(i)) k
        LEFT JOIN (SELECT id, i, sign(sum(s)) * ln(1 + abs(sum(s))) AS v FROM (
            SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 128 AS i, CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM (
              SELECT id, unnest(regexp_extract_all(lower(CASE WHEN title IS NULL THEN body ELSE title || chr(10) || body END), '[\\p{{L}}\\p{{N}}]+')) AS w
              FROM (SELECT CAST(seq AS VARCHAR) AS id, {scrub('title')} AS title, {scrub('body')} AS body FROM reviews)))
          GROUP BY id, i) w ON w.id = k.id AND w.i = k.i) GROUP BY id)""", "reviews"))
def embed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the scrubbed texts of all reviews; those with a number below the cache size have a vector already."""
    rows = scrub_columns(tables.reviews(spark, sf_dir)).select(F.col("seq").cast("string").alias("id"), "title", "body")
    vectors, _ = embed.embed_reviews(rows, _cache(spark, sf_dir), "new-model")
    thousandths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string"))
    return vectors.select("id", F.array_join(thousandths, ",").alias("vector"))


#: Three arcs of a circle a run, members in turn; far apart, and points of an arc close and evenly spaced.
_ARC, _STEP = 1.2, 0.0004


def _planted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` on arcs, as long as their own first component says: what is near what is known."""
    n = F.col("vec_id")
    at = n % 3 * F.lit(_ARC) + F.floor(F.pmod(n, F.lit(500)) / 3) * F.lit(_STEP)
    first = F.get("embedding", F.lit(0)).cast("double")
    far = 1 + first * first
    given = tables.table(spark, sf_dir, "embeddings").withColumns({"_at": at, "_far": far})
    vector = F.concat(F.array(F.col("_far") * F.cos("_at"), F.col("_far") * F.sin("_at")), F.array_repeat(F.lit(0.0), 62))
    return given.select(
        F.lit("vectors").alias("product"), F.lit(2024).alias("iso_year"), (F.floor(n / 500) + 1).cast("int").alias("iso_week"),
        (F.pmod(n, F.lit(500)) + 1).cast("int").alias("pos"), n.cast("string").alias("id"), vector.alias("embedding"),
        (n % 5 + 1).cast("int").alias("rating"))


# Two dimensions have their principal axes in closed form; the largest part of an axis is positive.
_PLANTED_SQL = f"""
    WITH points AS (SELECT 'vectors' AS product, 2024::BIGINT AS iso_year, vec_id // 500 + 1 AS iso_week, vec_id % 500 + 1 AS pos, CAST(vec_id AS VARCHAR) AS id,
        vec_id % 3 AS arc, vec_id % 5 + 1 AS rating, vec_id % 3 * {_ARC}::DOUBLE + (vec_id % 500) // 3 * {_STEP}::DOUBLE AS t FROM embeddings),
      axes AS (SELECT iso_week, avg(cos(t)) AS mx, avg(sin(t)) AS my, atan2(2 * covar_pop(cos(t), sin(t)), var_pop(cos(t)) - var_pop(sin(t))) / 2 AS turn
        FROM points GROUP BY iso_week),
      signed AS (SELECT *, CASE WHEN abs(cos(turn)) >= abs(sin(turn)) THEN sign(cos(turn)) ELSE sign(sin(turn)) END AS s1,
        CASE WHEN abs(sin(turn)) > abs(cos(turn)) THEN -sign(sin(turn)) ELSE sign(cos(turn)) END AS s2 FROM axes),
      labelled AS (SELECT *, CAST(CASE WHEN n < 10 THEN 0 ELSE dense_rank() OVER (PARTITION BY iso_week ORDER BY first) - 1 END AS BIGINT) AS label
        FROM (SELECT *, min(pos) OVER (PARTITION BY iso_week, arc) AS first, count(*) OVER (PARTITION BY iso_week) AS n FROM points))"""


def _vector_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` in runs of at most 500 consecutive vectors."""
    n = F.col("vec_id")
    return tables.table(spark, sf_dir, "embeddings").select(
        F.lit("vectors").alias("product"), F.lit(2024).alias("iso_year"), (F.floor(n / 500) + 1).cast("int").alias("iso_week"),
        (F.pmod(n, F.lit(500)) + 1).cast("int").alias("pos"), n.cast("string").alias("id"), "embedding",
        (n % 5 + 1).cast("int").alias("rating"))


@query("reduce_dims", f"""{_PLANTED_SQL}
    SELECT product, iso_year, iso_week, id, round(s1 * (cos(turn) * (cos(t) - mx) + sin(turn) * (sin(t) - my)), 6) + 0.0::DOUBLE AS c0,
      round(s2 * (cos(turn) * (sin(t) - my) - sin(turn) * (cos(t) - mx)), 6) + 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3, 0.0::DOUBLE AS c4
    FROM points JOIN signed USING (iso_week)""")
def reduce_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reduce.reduce_dims(_planted_runs(spark, sf_dir), RUN_KEY)
    return rows.select(*run_columns(), "id", *[(F.round(F.get("reduced", F.lit(i)), 6) + F.lit(0.0)).alias(f"c{i}") for i in range(5)])


@query("density_cluster", f"{_PLANTED_SQL} SELECT product, iso_year, iso_week, id, label FROM labelled")
def density_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = density.density_cluster(reduce.reduce_dims(_planted_runs(spark, sf_dir), RUN_KEY), RUN_KEY)
    return rows.select(*run_columns(), "id", label())


def _top(rows: DataFrame) -> DataFrame:
    top = cluster.top_clusters(cluster.cluster_stats(rows))
    return top.select(*run_columns(), label(), "size", F.round("avg_rating", 6).alias("avg_rating"), pos_column("rank"))


@query("cluster_reviews", f"""{_PLANTED_SQL}
    SELECT product, iso_year, iso_week, label, size, round(avg_rating, 6) AS avg_rating,
      row_number() OVER (PARTITION BY iso_week ORDER BY size DESC, first_pos) AS rank
    FROM (SELECT product, iso_year, iso_week, label, count(*) AS size, avg(rating) AS avg_rating, min(pos) AS first_pos FROM labelled GROUP BY ALL)""")
def cluster_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(cluster.cluster_reviews(_planted_runs(spark, sf_dir)))


@query("cluster_reviews_vectors")
def cluster_reviews_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors themselves: what is near what is not known to SQL, so tests compare bounds on tasks with each other."""
    return _top(cluster.cluster_reviews(_vector_runs(spark, sf_dir)))


@query("embedding_cache_merge", """
    SELECT CAST(vec_id AS VARCHAR) AS review_id, CASE WHEN vec_id % 3 = 0 THEN 'old-model' ELSE 'new-model' END AS model,
      CAST(CASE WHEN vec_id % 3 <> 0 AND vec_id % 2 = 0 THEN 0 ELSE 1 END AS BIGINT) AS kept FROM embeddings
    UNION ALL SELECT CAST(vec_id AS VARCHAR), 'new-model', 0 FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 0""")
def embedding_cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = _cache(spark, sf_dir)
    again = cache.where(F.col("review_id").cast("long") % 2 == 0).withColumns({
        "embedding": F.transform("embedding", lambda x: x * F.lit(0).cast("float")), "model": F.lit("new-model")})
    zero = F.forall("embedding", lambda x: x == 0)
    return embed.merge_cache(cache, again).select(
        "review_id", "model", F.when(zero, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("kept"))


# ---------------------------------------------------------------- themes

_SANITIZE_SQL = (
    "replace(replace(CASE WHEN length({c}) > 2000 THEN substr({c}, 1, 1997) || '...' ELSE {c} END, '<', '&lt;'), '>', '&gt;')")
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def _sanitize_sql(expr: str) -> str:
    return _SANITIZE_SQL.format(c=f"regexp_replace({expr}, '{_CONTROL}', '', 'g')")


@query("sanitize_text", sql(f"""
    SELECT id, md5({_sanitize_sql("body || chr(7) || ' <b>' || chr(31) || repeat('x', CAST(seq % 2100 AS INTEGER))")}) AS text
    FROM reviews""", "reviews"))
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat("body", F.lit("\x07 <b>\x1f"), F.repeat(F.lit("x"), F.pmod("seq", F.lit(2100)).cast("int")))
    return tables.reviews(spark, sf_dir).select("id", F.md5(text.sanitize(dirty)).alias("text"))


_SHOWN = _sanitize_sql("CASE WHEN title IS NULL THEN body ELSE title || ' - ' || body END")


_PROMPT_SQL = f"""
    SELECT {RUN_SQL}, {LABEL_SQL}, 'Analyze the following ' || count(*) || ' reviews to extract a theme.' || chr(10) || chr(10)
      || 'Provide exactly 3 representative quotes and 2 action ideas.' || chr(10) || chr(10) || '<REVIEWS>' || chr(10) AS head,
      string_agg(n || '. [' || rating || '⭐] ' || shown || chr(10), '' ORDER BY n) || '</REVIEWS>' || chr(10) AS listed
    FROM (SELECT {RUN}, label, rating, {_SHOWN} AS shown,
          row_number() OVER (PARTITION BY {RUN}, label ORDER BY pos) AS n
          FROM members JOIN (SELECT {RUN}, label FROM top) USING ({RUN}, label)) GROUP BY ALL"""


@query("build_prompts", sql(f"SELECT {RUN}, label, md5(head || listed) AS prompt FROM ({_PROMPT_SQL})", "members", "top"))
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.Given(spark, sf_dir, shared=True).top_members
    return themes.build_prompts(found).select(*run_columns(), label(), F.md5("prompt").alias("prompt"))


def _first_review(prompt: str) -> tuple[str, int, int]:
    """A stand-in summariser: the first listed review is the quote; short prompts fail."""
    import json
    lines = prompt.split("<REVIEWS>\n", 1)[1].split("\n")
    if len(prompt) < 400:
        raise RuntimeError("nothing to say")
    quote = lines[0].split("] ", 1)[1][:50]
    answer = {"name": f"About {len(lines) - 2} reviews", "quotes": [quote], "action_ideas": ["Read them again, with care"]}
    return json.dumps(answer), len(prompt) // 4, 25


@query("summarize_clusters", sql(f"""
    SELECT {RUN}, label, 'About ' || (len(string_split(listed, chr(10))) - 2) || ' reviews' AS name, 1::BIGINT AS quotes,
      'Read them again, with care...' AS action, length(head || listed) // 4 AS input_tokens, 25::BIGINT AS output_tokens
    FROM ({_PROMPT_SQL}) WHERE length(head || listed) >= 400""", "members", "top"))
def summarize_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.Given(spark, sf_dir, shared=True).top_members
    answers = themes.summarize_clusters(themes.build_prompts(found), _first_review)
    parsed = themes.parse_themes(answers)
    return parsed.select(
        *run_columns(), label(), "name", F.size("quotes").cast("long").alias("quotes"), F.get("actions", F.lit(0))["title"].alias("action"),
        "input_tokens", "output_tokens")


_RAW_SQL = """CASE doc_id % 7
      WHEN 0 THEN '{"name": "T' || doc_id || '", "description": "d", "quotes": ["a", "b"], "action_ideas": ["Do it"]}'
      WHEN 1 THEN '{"name": "T' || doc_id || '"}' WHEN 2 THEN '{}' WHEN 3 THEN '{"name": "T", "quotes": ["a"'
      WHEN 4 THEN '{"name": "T", "quotes": "not a list"}' WHEN 5 THEN 'no json'
      ELSE '{"description": "only ' || source || '", "action_ideas": ["' || source || ' needs more than thirty characters"]}' END"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 7
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"name": "T'), n, F.lit(
            '", "description": "d", "quotes": ["a", "b"], "action_ideas": ["Do it"]}')))
        .when(kind == 1, F.concat(F.lit('{"name": "T'), n, F.lit('"}'))).when(kind == 2, "{}")
        .when(kind == 3, '{"name": "T", "quotes": ["a"').when(kind == 4, '{"name": "T", "quotes": "not a list"}')
        .when(kind == 5, "no json").otherwise(F.concat(
            F.lit('{"description": "only '), F.col("source"), F.lit('", "action_ideas": ["'), F.col("source"),
            F.lit(' needs more than thirty characters"]}'))))
    return tables.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


@query("parse_themes", f"""
    SELECT doc_id, CASE WHEN doc_id % 7 < 2 THEN 'T' || doc_id ELSE 'Unknown Theme' END AS name,
      CASE doc_id % 7 WHEN 0 THEN 'd' WHEN 6 THEN 'only ' || source ELSE '' END AS description,
      CASE WHEN doc_id % 7 = 0 THEN 'a|b' ELSE '' END AS quotes,
      CAST(CASE WHEN doc_id % 7 IN (0, 6) THEN 1 ELSE 0 END AS BIGINT) AS actions
    FROM documents WHERE doc_id % 7 IN (0, 1, 2, 6)""")
def parse_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.parse_themes(_answers(spark, sf_dir)).select(
        "doc_id", "name", "description", F.array_join("quotes", "|").alias("quotes"),
        F.size("actions").cast("long").alias("actions"))


@query("action_titles", """
    SELECT doc_id, substr(idea, 1, 30) || '...' AS title, idea AS details,
      CASE WHEN doc_id % 7 = 0 THEN 'T' || doc_id ELSE '' END AS related_theme
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Do it' ELSE source || ' needs more than thirty characters' END AS idea
          FROM documents WHERE doc_id % 7 IN (0, 6))""")
def action_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = themes.parse_themes(_answers(spark, sf_dir))
    return parsed.select("doc_id", F.explode("actions").alias("a")).select("doc_id", "a.*")
