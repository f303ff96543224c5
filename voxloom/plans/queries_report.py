"""Queries: dates, rendering, ledger state, streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.functions import keys, weeks
from voxloom.operators import ingest, ledger as ledger_ops, render
from voxloom.plans import tables
from voxloom.plans.catalog import RUN_SQL, longs, query, run_columns, when_sql, when_text
from voxloom.plans.oracle import RUN, scrub, sql
from voxloom.plans.queries_analysis import _DELIVERED_SQL, _GRID_SQL, _WEEKS
from voxloom.schemas import RUN_KEY
from voxloom.session import scratch_path
from voxloom.streaming import feeds as streams

# The wording of document blocks, mails, HTML and markdown in the SQL below has to equal that of the operators.

# ---------------------------------------------------------------- dates

_DATES = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))


def _day(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


@query("parse_iso_week", f"""
    SELECT o_orderkey, label, CASE WHEN kind IN (0, 1) OR (kind = 4 AND weeks = 53) THEN y END AS iso_year,
      CASE WHEN kind IN (0, 1) THEN w WHEN kind = 4 AND weeks = 53 THEN 53 END AS iso_week,
      CASE WHEN kind = 2 THEN 'bad format' WHEN kind = 3 THEN 'week out of range'
        WHEN kind = 4 AND weeks < 53 THEN 'no such week in year' END AS reason
    FROM (SELECT *, week(make_date(y, 12, 28)) AS weeks, CASE kind WHEN 0 THEN y || '-W' || lpad(CAST(w AS VARCHAR), 2, '0')
        WHEN 1 THEN '  ' || y || '-W' || w || ' ' WHEN 2 THEN y || 'W' || w
        WHEN 3 THEN y || '-W' || (CASE WHEN w % 2 = 0 THEN '0' ELSE '54' END) ELSE y || '-W53' END AS label
      FROM (SELECT o_orderkey, o_orderkey % 5 AS kind, isoyear(d) AS y, week(d) AS w FROM {_DATES}))""")
def parse_iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 5
    year = weeks.iso_year_of(F.col("d")).cast("string")
    week = weeks.iso_week_of(F.col("d"))
    text = week.cast("string")
    label = (
        F.when(kind == 0, F.concat(year, F.lit("-W"), F.lpad(text, 2, "0")))
        .when(kind == 1, F.concat(F.lit("  "), year, F.lit("-W"), text, F.lit(" ")))
        .when(kind == 2, F.concat(year, F.lit("W"), text))
        .when(kind == 3, F.concat(year, F.lit("-W"), F.when(week % 2 == 0, "0").otherwise("54")))
        .otherwise(F.concat(year, F.lit("-W53"))))
    rows = weeks.parse_iso_week(_orders(spark, sf_dir).select("o_orderkey", label.alias("label")), "label")
    return longs(rows.select("o_orderkey", "label", "iso_year", "iso_week", "reason"), "iso_year", "iso_week")


def _with_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).withColumns({"y": weeks.iso_year_of(F.col("d")), "w": weeks.iso_week_of(F.col("d"))})


@query("iso_week_range", f"""
    SELECT o_orderkey, strftime(date_trunc('week', d), '%Y-%m-%d') AS monday,
      strftime(CAST(date_trunc('week', d) AS DATE) + 6, '%Y-%m-%d') AS sunday FROM {_DATES}""")
def iso_week_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, w = F.col("y"), F.col("w")
    return _with_week(spark, sf_dir).select(
        "o_orderkey", _day(weeks.week_monday(y, w)).alias("monday"), _day(weeks.week_sunday(y, w)).alias("sunday"))


@query("review_window", f"""
    SELECT o_orderkey, strftime(CAST(date_trunc('week', d) AS DATE) + 6 - 70, '%Y-%m-%d') AS first_day,
      strftime(CAST(date_trunc('week', d) AS DATE) + 6, '%Y-%m-%d') AS last_day FROM {_DATES}""")
def review_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, w = F.col("y"), F.col("w")
    return _with_week(spark, sf_dir).select(
        "o_orderkey", _day(weeks.window_start(y, w)).alias("first_day"), _day(weeks.window_end(y, w)).alias("last_day"))


@query("format_iso_week", f"""
    SELECT o_orderkey, isoyear(d) || '-W' || lpad(CAST(week(d) AS VARCHAR), 2, '0') AS label FROM {_DATES}""")
def format_iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_week(spark, sf_dir).select("o_orderkey", weeks.format_iso_week(F.col("y"), F.col("w")).alias("label"))


@query("max_iso_week", f"SELECT o_orderkey, week(make_date(year(d), 12, 28)) AS weeks FROM {_DATES}")
def max_iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_orders(spark, sf_dir).select("o_orderkey", weeks.max_iso_week(F.year("d")).alias("weeks")), "weeks")


@query("iso_week_of", "SELECT event_id, isoyear(ts) AS iso_year, week(ts) AS iso_week FROM events")
def iso_week_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weeks.own_week(tables.table(spark, sf_dir, "events"), "ts")
    return longs(rows.select("event_id", "iso_year", "iso_week"), "iso_year", "iso_week")


# ---------------------------------------------------------------- rendering

_D = "strftime({}, '%Y-%m-%d')"
_QUOTE_LINE = f"""'"' || q.text || '" - [' || q.rating || '⭐ | ' || q.store || ' | ' || {_D.format('q.date')} || ']\n'"""
_BLOCKS_SQL = f"""
    list_concat([{{text: display_name || ' — Weekly Review Pulse — W' || iso_week || ' (' || {_D.format('window_start')} ||
        ' to ' || {_D.format('window_end')} || ')\n', bold: true}}],
      CASE WHEN len(themes) = 0 THEN [{{text: 'No significant themes discovered this week.\n', bold: false}}]
      ELSE list_concat([{{text: '\nTOP THEMES:\n', bold: true}}],
        list_transform(themes, lambda t: {{text: t.theme_no || '. ' || t.name || ' (' || t.size || ' reviews)\n   '
          || t.description || '\n', bold: false}}),
        [{{text: '\nREAL USER QUOTES:\n', bold: true}}],
        flatten(list_transform(themes, lambda t: CASE WHEN len(t.quotes) = 0 THEN [] ELSE list_concat(
          [{{text: '\n' || t.name || ':\n', bold: true}}],
          list_transform(t.quotes, lambda q: {{text: {_QUOTE_LINE}, bold: false}})) END)),
        [{{text: '\nACTION IDEAS:\n', bold: true}}],
        flatten(list_transform(themes, lambda t: list_transform(t.actions, lambda a:
          {{text: '• ' || a.title || ': ' || a.details || ' (Related to: ' || t.name || ')\n', bold: false}})))) END,
      [{{text: '\nAbout This Pulse:\n- Analyzed ' || total_reviews || ' reviews (' || appstore_reviews || ' App Store, '
        || playstore_reviews || ' Play Store)\n- Found ' || clusters_found || ' clusters\n- Anchor ID: ' || anchor
        || '\n--- \n', bold: false}}])"""


@query("doc_blocks", sql(f"""
    SELECT {RUN_SQL}, unnest(generate_series(0, len(blocks) - 1)) AS block_no, unnest(blocks).text AS text,
      unnest(blocks).bold AS bold FROM (SELECT {RUN}, {_BLOCKS_SQL} AS blocks FROM reports)""", "reports"))
def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = render.doc_blocks(tables.Given(spark, sf_dir, shared=True).reports)
    return rows.select(*run_columns(), F.col("block_no").cast("long").alias("block_no"), "text", "bold")


@query("date_label", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown Date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS label
    FROM orders""")
def date_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", keys.date_label(when).alias("label"))


_LINK = "'https://docs.google.com/document/d/' || doc_id || '/edit#heading=h.' || anchor"
_STAMP = "2026-01-05T06:07:08+00:00"
_ACTIONS = """flatten(list_transform(themes[1:3], lambda t: list_transform(t.actions[1:2],
      lambda a: {theme: t.name, title: a.title, details: a.details})))"""
_SUBJECT_SQL = "'📊 ' || display_name || ' Review Pulse — Week ' || iso_week"
_TEXT_SQL = f"""'Review Pulse for ' || display_name || ' (Week ' || iso_week || ', ' || iso_year || ')\n\nTop Themes:\n'
    || array_to_string(list_transform(themes[1:3], lambda t: '• ' || t.name || ': ' || t.description || '\n'), '')
    || CASE WHEN len(actions) > 0 THEN '\nTop Action Ideas:\n' || array_to_string(list_transform(actions,
      lambda a: '• [' || a.theme || '] ' || a.title || ': ' || a.details || '\n'), '') ELSE '' END
    || '\nStats:\n- ' || total_reviews || ' reviews analyzed\n- ' || clusters_found || ' clusters found\n\nRead Full Report -> '
    || {_LINK} || '\n\nGenerated at: {_STAMP}'"""
_HTML_SQL = f"""'
    <html>
      <body style="font-family: sans-serif; line-height: 1.5; color: #333;">
        <h2>📊 Review Pulse for ' || display_name || ' (Week ' || iso_week || ', ' || iso_year || ')</h2>
        
        <h3>Top Themes:</h3>
        <ul>
          ' || array_to_string(list_transform(themes[1:3], lambda t:
            '<li><strong>' || t.name || '</strong>: ' || t.description || '</li>'), '') || '
        </ul>
        ' || CASE WHEN len(actions) > 0 THEN '
        <h3>Top Action Ideas:</h3>
        <ul>
          ' || array_to_string(list_transform(actions, lambda a:
            '<li><strong>[' || a.theme || '] ' || a.title || '</strong>: ' || a.details || '</li>'), '') || '
        </ul>
        ' ELSE '' END || '
        <div style="background-color: #f5f5f5; padding: 15px; border-radius: 5px; margin: 20px 0;">
            <p style="margin: 0;"><strong>Stats:</strong> ' || total_reviews || ' reviews analyzed | ' || clusters_found || ' clusters found</p>
        </div>
        
        <a href="' || {_LINK} || '" style="display: inline-block; background-color: #1a73e8; color: white; padding: 10px 20px; text-decoration: none; border-radius: 4px; font-weight: bold;">
            Read Full Report →
        </a>
        
        <hr style="margin-top: 30px; border: 0; border-top: 1px solid #eee;" />
        <p style="font-size: 0.8em; color: #777;">
            Generated at: {_STAMP}
        </p>
      </body>
    </html>
    '"""
_MAILED = f"(SELECT *, {_ACTIONS} AS actions FROM reports)"


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = tables.Given(spark, sf_dir, shared=True)
    return render.render_all(given.reports, given.products)


@query("email_text", sql(f"SELECT {RUN_SQL}, {_SUBJECT_SQL} AS subject, {_TEXT_SQL} AS text_body FROM {_MAILED}", "reports"))
def email_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select(*run_columns(), "subject", "text_body")


@query("email_html", sql(f"SELECT {RUN_SQL}, {_HTML_SQL} AS html_body FROM {_MAILED}", "reports"))
def email_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select(*run_columns(), "html_body")


@query("deep_link", sql(f"SELECT run_id, 'https://docs.google.com/document/d/doc-' || product || '/edit#heading=h.' || anchor AS link"
                        " FROM updates", "updates"))
def deep_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = keys.section_anchor(F.col("product"), F.col("iso_year"), F.col("iso_week"))
    return tables.updates(spark, sf_dir).select(
        "run_id", keys.deep_link(F.concat(F.lit("doc-"), F.col("product")), anchor).alias("link"))


@query("render_all", sql(f"""
    SELECT {RUN_SQL}, CAST(len(blocks) AS BIGINT) AS blocks, md5(array_to_string(list_transform(blocks, lambda b: b.text), ''))
      AS doc, {_SUBJECT_SQL} AS subject, md5({_TEXT_SQL}) AS text_body, md5({_HTML_SQL}) AS html_body
    FROM (SELECT *, {_BLOCKS_SQL} AS blocks FROM {_MAILED})""", "reports"))
def render_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir).select(
        *run_columns(), F.size("blocks").cast("long").alias("blocks"),
        F.md5(F.array_join(F.transform("blocks", lambda b: b["text"]), "")).alias("doc"), "subject",
        F.md5("text_body").alias("text_body"), F.md5("html_body").alias("html_body"))


# ---------------------------------------------------------------- ledger

@query("ledger_upsert", sql(f"""
    SELECT {RUN_SQL}, run_id, status, n AS update_seq, {when_sql('later')} AS completed_at FROM ledger""", "ledger"))
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.updates(spark, sf_dir)
    merged = ledger_ops.ledger_upsert(rows.where(F.col("update_seq") % 3 == 0), rows.where(F.col("update_seq") % 3 != 0))
    return merged.select(*run_columns(), "run_id", "status", "update_seq", when_text("completed_at").alias("completed_at"))


@query("ledger_get", sql(f"""
    SELECT {RUN_SQL}, run_id, status FROM ledger WHERE product = 'src7' AND iso_year = 1996 AND iso_week = 20""", "ledger"))
def ledger_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_ops.ledger_get_key(tables.ledger(spark, sf_dir), "src7:1996:W20").select(*run_columns(), "run_id", "status")


_OUTCOMES_SQL = """
    SELECT *, CASE o % 4 WHEN 0 THEN 'Success' WHEN 1 THEN 'Skipped: Section exists.' WHEN 2 THEN 'Error: timeout'
        ELSE 'Success' END AS docs, CASE o % 5 WHEN 0 THEN 'Success (draft ID: abc' || o || ')' WHEN 1 THEN 'Error: refused'
        WHEN 2 THEN 'Skipped: Email mode is ''none''' WHEN 3 THEN 'Success (send ID:  x y' || o || ' ) )'
        ELSE 'Success (draft ok)' END AS mail, CASE WHEN o % 2 = 0 THEN 'draft' ELSE 'send' END AS mode,
      o % 11 = 0 AS dry_run, o % 13 = 0 AS crashed FROM (SELECT o_orderkey AS o FROM orders)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    text = n.cast("string")
    docs = (F.when(n % 4 == 1, "Skipped: Section exists.").when(n % 4 == 2, "Error: timeout").otherwise("Success"))
    mail = (
        F.when(n % 5 == 0, F.concat(F.lit("Success (draft ID: abc"), text, F.lit(")"))).when(n % 5 == 1, "Error: refused")
        .when(n % 5 == 2, "Skipped: Email mode is 'none'")
        .when(n % 5 == 3, F.concat(F.lit("Success (send ID:  x y"), text, F.lit(" ) )"))).otherwise("Success (draft ok)"))
    return tables.table(spark, sf_dir, "orders").select(
        n.alias("o"), docs.alias("docs_delivery"), mail.alias("email_delivery"),
        F.when(n % 2 == 0, "draft").otherwise("send").alias("mode"), (n % 11 == 0).alias("dry_run"),
        (n % 13 == 0).alias("crashed"))


@query("run_status", f"""
    SELECT o, CASE WHEN crashed THEN 'failed' WHEN dry_run THEN 'completed' WHEN contains(docs, 'Error') OR contains(mail, 'Error')
      THEN 'partial' ELSE 'completed' END AS status FROM ({_OUTCOMES_SQL})""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = ledger_ops.run_status(*[F.col(c) for c in ("docs_delivery", "email_delivery", "dry_run", "crashed")])
    return _outcomes(spark, sf_dir).select("o", status.alias("status"))


@query("delivery_plan", sql(f"""
    SELECT product, iso_year, iso_week, doc_id, CASE WHEN delivered THEN 'skip' ELSE 'append' END AS doc_action,
      CASE WHEN run_id IS NOT NULL AND iso_week % 3 = 0 THEN 'skip' ELSE 'draft' END AS email_action, recipients
    FROM ({_DELIVERED_SQL} FROM ({_GRID_SQL}) g) JOIN (SELECT slug AS product, recipients FROM products) USING (product)
    LEFT JOIN run_ledger USING ({RUN})""", "products", "published", "run_ledger"))
def delivery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = tables.products(spark, sf_dir)
    known = tables.run_records(tables.Given(spark, sf_dir).grid)
    mail = F.struct(F.lit("d1").alias("draft_id"), F.lit(None).cast("string").alias("message_id"), F.array(F.lit("a@example.com")).alias("recipients"),
                    F.lit("draft").alias("mode"), F.col("started_at").alias("delivered_at"))
    known = known.withColumn("email_delivery", F.when(F.col("iso_week") % 3 == 0, mail))
    rows = ledger_ops.delivery_plan(ingest.run_grid(listed, _WEEKS), tables.published(spark, sf_dir), listed, ledger=known)
    return rows.select(*run_columns(), "doc_id", "doc_action", "email_action", "recipients")


@query("delivery_ids", f"""
    SELECT o, CASE WHEN mode = 'draft' THEN found END AS draft_id, CASE WHEN mode <> 'draft' THEN found END AS message_id
    FROM (SELECT *, CASE WHEN contains(mail, 'Success') AND contains(mail, 'ID:') THEN trim(string_split(mail, 'ID:')[2], ' )')
      END AS found FROM ({_OUTCOMES_SQL}))""")
def delivery_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_ops.delivery_ids(_outcomes(spark, sf_dir)).select("o", "draft_id", "message_id")


@query("ledger_metrics", sql(f"""
    SELECT {RUN_SQL}, run_id, total_reviews AS reviews, clusters_found, themes_generated, quotes_proposed, quotes_validated,
      input_tokens AS tokens_in FROM run_ledger JOIN stats USING ({RUN})""", "run_ledger", "stats"))
def ledger_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = tables.Given(spark, sf_dir, shared=True)
    runs, stats = tables.run_records(given.grid), given.stats
    return ledger_ops.ledger_metrics(runs, stats).select(
        *run_columns(), "run_id", F.col("reviews_fetched.total").alias("reviews"), "clusters_found", "themes_generated",
        "quotes_proposed", "quotes_validated", F.col("llm_tokens.input").alias("tokens_in"))


# ---------------------------------------------------------------- streaming

def _review_stream(spark: SparkSession, sf_dir: str, path: str, again: bool = True) -> DataFrame:
    """Reviews that land in three parts, out of date order; with `again`, the last part also holds edited polls of reviews of the first."""
    tables.pin_utc(spark)
    rows = tables.reviews(spark, sf_dir)
    files = 0
    for turn, part in enumerate((2, 0, 1)):
        mine = rows.where(F.col("seq") % 3 == part)
        if again and turn == 2:
            edited = rows.where(F.col("seq") % 3 == 2).where(F.col("seq") % 10 == 0)
            mine = mine.unionByName(edited.withColumns({"body": F.concat("body", F.lit(" (edited)")), "seq": F.col("seq") + tables.EDIT_SEQ}))
        mine.write.parquet(f"{path}/landed/{turn}")
        files = max(files, len(spark.read.parquet(f"{path}/landed/{turn}").inputFiles()))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/landed/*/")


@query("stream_ingest", sql("SELECT id, product, seq FROM reviews", "reviews"))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stream")
    streams.run_stream_ingest(_review_stream(spark, sf_dir, path), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("id", "product", "seq")


@query("stream_rolling_counts", sql(f"""
    SELECT product, strftime(sunday - 70, '%Y-%m-%d') AS window_start, count(*) AS reviews, CAST(sum(rating) AS BIGINT) AS rating_sum,
      round(avg(rating), 6) AS avg_rating
    FROM (SELECT s.*, CAST(date AS DATE) + CAST(7 - isodow(date) AS INTEGER) + CAST(7 * k AS INTEGER) AS sunday
      FROM reviews s, (SELECT unnest(generate_series(0, 10)) AS k)) WHERE CAST(date AS DATE) >= sunday - 70
    GROUP BY ALL""", "reviews"))
def stream_rolling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stream")
    rows = _review_stream(spark, sf_dir, path, again=False).select("product", "date", "rating")
    streams.run_rolling_counts(rows, f"{path}/out", f"{path}/checkpoint")
    return streams.latest_counts(spark, f"{path}/out").select(
        "product", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "reviews", "rating_sum",
        F.round("avg_rating", 6).alias("avg_rating"))


def _letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in encoder: length and blanks."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("stream_embed_missing", sql(f"""
    SELECT id, CAST(length(CASE WHEN title IS NULL THEN body ELSE title || chr(10) || body END) AS BIGINT) AS chars
    FROM (SELECT id, {scrub('title')} AS title, {scrub('body')} AS body FROM reviews)""", "reviews"))
def stream_embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stream")
    rows = _review_stream(spark, sf_dir, path)
    for feed in ("first", "again"):  # the second pass finds every id in the cache
        streams.run_embed_missing(rows, f"{path}/cache", f"{path}/checkpoint-{feed}", "letters", _letter_counts)
    return streams.read_cache(spark, f"{path}/cache").select(
        F.col("review_id").alias("id"), F.get("embedding", F.lit(0)).cast("long").alias("chars"))
