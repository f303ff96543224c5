"""The ledger of runs: records, decisions, delivery and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions import ranking
from voxloom.functions.keys import section_anchor
from voxloom.schemas import RUN_KEY, RUN_RECORD

# Fixed value: how an anchor ends.
_WEEK = r"-\d{4}-W\d{2}"


def latest_records(updates: DataFrame) -> DataFrame:
    """One record per run; the last write wins. Updates collapse before the shuffle."""
    rest = [c for c in RUN_RECORD.names if c not in RUN_KEY]
    last = updates.groupBy(*RUN_KEY).agg(F.max_by(F.struct(*rest), "update_seq").alias("_r"))
    return last.select(*RUN_KEY, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*RUN_RECORD.names)


def ledger_upsert(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Insert or replace the record of every run in `records`."""
    columns = RUN_RECORD.names
    return latest_records(ledger.select(*columns).unionByName(records.select(*columns)))


def ledger_get(ledger: DataFrame, product: str, iso_year: int, iso_week: int) -> DataFrame:
    return ledger.where(
        (F.col("product") == product) & (F.col("iso_year") == iso_year) & (F.col("iso_week") == iso_week))


def ledger_get_key(ledger: DataFrame, key: str) -> DataFrame:
    """The record of a key `product:year:Wnn`; filters on the stored key columns, so they prune."""
    product, year, week = key.rsplit(":", 2)
    return ledger_get(ledger, product, int(year), int(week.lstrip("W")))


def run_flags(ledger: DataFrame) -> DataFrame:
    return ledger.withColumns({
        "is_complete": F.col("status") == "completed",
        "is_partial": F.col("status") == "partial",
        "doc_delivered": F.col("doc_delivery.heading_id").isNotNull(),
        "email_delivered": F.col("email_delivery.draft_id").isNotNull() | F.col("email_delivery.message_id").isNotNull()})


def _newest() -> list[Column]:
    return [F.col("started_at").desc(), F.col("run_id")]


def run_history(ledger: DataFrame, product: str | None = None, limit: int = 10) -> DataFrame:
    """The newest runs, of one product or of all."""
    rows = ledger if product is None else ledger.where(F.col("product") == product)
    return rows.orderBy(*_newest()).limit(limit)


def runs_by_product(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs of every product, newest first by `run_no`; with `limit`, the newest per product."""
    if limit is None:
        return ranking.position(ledger, ("product",), _newest(), "run_no")
    return ranking.top_n(ledger, ("product",), _newest(), limit, "run_no")


def failed_runs(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs that failed or were only partly delivered, newest first."""
    rows = ledger.where(F.col("status").isin("partial", "failed")).orderBy(*_newest())
    return rows if limit is None else rows.limit(limit)


def anchors_in(published: DataFrame, products: DataFrame) -> DataFrame:
    """Every section anchor of a document's own product that occurs in its text.

    One pass over the texts, with a pattern that is the same for all of them, leaves a short piece for each week that is written in a text:
    the week and as many characters before it as the longest slug has. Only these pieces are exchanged, and meet the slugs of their document.
    """
    slugs = products.select("doc_id", "slug").where((F.col("doc_id") != "") & (F.col("slug") != ""))
    longest = slugs.agg(F.max(F.length("slug"))).first()[0] or 1
    # a look-ahead takes nothing, so weeks close to each other are all found; blanks stand before the text for a slug at its start
    padded = F.concat(F.lit(" " * longest), F.col("text"))
    pattern = rf"(?s)(?=(.{{{longest}}}{_WEEK}))"
    pieces = published.where(F.col("text").rlike(_WEEK)).select(
        "doc_id", F.explode(F.regexp_extract_all(padded, F.lit(pattern), F.lit(1))).alias("piece")).distinct()
    before, week = F.substring("piece", 1, longest), F.expr(f"substring(piece, {longest + 1})")
    return pieces.join(slugs, "doc_id").where(F.endswith(before, F.col("slug"))).select(
        "doc_id", F.concat("slug", week).alias("anchor")).distinct()


def anchor_exists(runs: DataFrame, published: DataFrame, products: DataFrame) -> DataFrame:
    """Add `delivered`: does the published text of the run's document hold its anchor?"""
    anchors = anchors_in(published, products).withColumn("_there", F.lit(True))
    keyed = runs.withColumn("anchor", section_anchor(F.col("product"), F.col("iso_year"), F.col("iso_week")))
    return keyed.join(anchors, ["doc_id", "anchor"], "left").withColumn(
        "delivered", F.coalesce("_there", F.lit(False))).drop("_there")


def decide(status: Column, delivered: Column) -> Column:
    return (
        F.when(status == "completed", "skip").when(status.isin("partial", "running"), "resume")
        .when(status == "failed", "run").when(delivered, "skip").otherwise("run"))


def idempotency_decision(grid: DataFrame, ledger: DataFrame, published: DataFrame, products: DataFrame) -> DataFrame:
    """Skip, resume or run each run of the grid; without a record the published document decides."""
    known = ledger.select(*RUN_KEY, "status")
    checked = anchor_exists(grid, published, products).join(known, list(RUN_KEY), "left")
    return checked.withColumn("decision", decide(F.col("status"), F.col("delivered")))


def pending_channels(decided: DataFrame, ledger: DataFrame) -> DataFrame:
    """Which channels a resumed run still has to serve; a run that is skipped has none."""
    flags = run_flags(ledger).select(*RUN_KEY, "doc_delivered", "email_delivered")
    active = F.col("decision") != "skip"
    joined = decided.join(flags, list(RUN_KEY), "left")
    return joined.withColumns({
        "doc_pending": active & ~(F.coalesce("doc_delivered", F.lit(False)) | F.col("delivered")),
        "email_pending": active & ~F.coalesce("email_delivered", F.lit(False))})


def delivery_plan(runs: DataFrame, published: DataFrame, products: DataFrame, mode: str = "draft",
                  ledger: DataFrame | None = None) -> DataFrame:
    """Per run: append or skip the section, and how to mail whom. The table is the hand-off.

    With the ledger, a resumed run does not mail again what has been mailed.
    """
    checked = runs if {"anchor", "delivered"} <= set(runs.columns) else anchor_exists(runs, published, products)
    mailed = F.lit(False)
    if ledger is not None:
        flags = run_flags(ledger).select(*RUN_KEY, F.col("email_delivered").alias("_mailed"))
        checked, mailed = checked.join(flags, list(RUN_KEY), "left"), F.coalesce("_mailed", F.lit(False))
    return checked.select(
        *RUN_KEY, "doc_id", "anchor", F.when(F.col("delivered"), "skip").otherwise("append").alias("doc_action"),
        F.when(mailed, "skip").otherwise({"none": "skip", "send": "send"}.get(mode, "draft")).alias("email_action"),
        F.array_join("stakeholder_emails", ", ").alias("recipients"))


def run_status(docs: Column, email: Column, dry_run: Column, crashed: Column) -> Column:
    """Final status from the outcome texts of both channels."""
    error = F.contains(F.coalesce(docs, F.lit("")), F.lit("Error")) | F.contains(
        F.coalesce(email, F.lit("")), F.lit("Error"))
    return F.when(crashed, "failed").when(dry_run, "completed").when(error, "partial").otherwise("completed")


def delivery_id(email: Column) -> Column:
    """Text after the first `ID:` up to the next one, without blanks and closing brackets around it."""
    return F.when(F.contains(email, F.lit("ID:")), F.btrim(
        F.get(F.split(email, "ID:"), F.lit(1)), F.lit(" )")))


def delivery_ids(outcomes: DataFrame, mode: str = "mode") -> DataFrame:
    """Put the id of a successful mail into `draft_id` or `message_id`."""
    success = F.contains("email_delivery", F.lit("Success"))
    found = F.when(success, delivery_id(F.col("email_delivery")))
    draft = F.col(mode) == "draft"
    return outcomes.withColumns({"draft_id": F.when(draft, found), "message_id": F.when(~draft, found)})


def apply_outcomes(records: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Fill status and delivery fields of the records from the outcome texts of both channels.

    `outcomes` has the run key, `docs_delivery, email_delivery, mode, dry_run, crashed, doc_id, recipients`.
    """
    ids = list(RUN_KEY)
    joined = delivery_ids(records.join(
        outcomes.withColumnsRenamed({"email_delivery": "_mail"}), ids).withColumnRenamed("email_delivery", "_email")
        .withColumnRenamed("_mail", "email_delivery")).withColumnsRenamed(
            {"email_delivery": "_mail", "_email": "email_delivery"})
    live = ~F.col("dry_run") & ~F.col("crashed")
    doc_ok = live & (F.contains("docs_delivery", F.lit("Success")) | F.contains("docs_delivery", F.lit("Skipped")))
    mail_ok = live & F.contains("_mail", F.lit("Success"))
    anchor = section_anchor(F.col("product"), F.col("iso_year"), F.col("iso_week"))
    doc = F.struct(
        F.col("doc_id").alias("document_id"), anchor.alias("heading_id"), anchor.alias("section_anchor"),
        now.alias("delivered_at"))
    mail = F.struct(
        F.col("draft_id").alias("draft_id"), F.col("message_id").alias("message_id"),
        F.col("recipients").alias("recipients"), F.col("mode").alias("mode"), now.alias("delivered_at"))
    status = run_status(F.col("docs_delivery"), F.col("_mail"), F.col("dry_run"), F.col("crashed"))
    out = joined.withColumns({
        "status": status,
        "completed_at": F.when(status == "completed", now).otherwise(F.col("completed_at")),
        "doc_delivery": F.when(doc_ok, doc).otherwise(F.col("doc_delivery")),
        "email_delivery": F.when(mail_ok, mail).otherwise(F.col("email_delivery"))})
    return out.select(*RUN_RECORD.names)


def ledger_metrics(ledger: DataFrame, stats: DataFrame) -> DataFrame:
    """Copy the counters of the report into the record of its run."""
    s = stats.select(*RUN_KEY, F.struct(*[c for c in stats.columns if c not in RUN_KEY]).alias("_s"))
    has = F.col("_s").isNotNull()
    pick = lambda new, old: F.when(has, new).otherwise(F.col(old))
    fetched = F.struct(
        F.col("_s.appstore_reviews").alias("appstore"), F.col("_s.playstore_reviews").alias("playstore"),
        F.col("_s.total_reviews").alias("total"))
    tokens = F.struct(
        F.col("_s.input_tokens").alias("input"), F.col("_s.output_tokens").alias("output"),
        F.col("_s.estimated_cost_usd").alias("estimated_cost_usd"))
    return ledger.join(s, list(RUN_KEY), "left").withColumns({
        "reviews_fetched": pick(fetched, "reviews_fetched"),
        "llm_tokens": pick(tokens, "llm_tokens"),
        **{c: pick(F.col(f"_s.{c}"), c) for c in (
            "clusters_found", "themes_generated", "quotes_proposed", "quotes_validated")}}).drop("_s")


def overview_totals(ledger: DataFrame, actions_per_theme: int = 3) -> DataFrame:
    """Totals over completed and partial runs; three actions are counted for every theme."""
    done = ledger.where(F.col("status").isin("completed", "partial"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return done.agg(
        total("reviews_fetched.total").alias("reviews"), total("themes_generated").alias("themes"),
        (total("themes_generated") * actions_per_theme).alias("actions"), total("quotes_validated").alias("quotes"))


def audit_questions(ledger: DataFrame) -> DataFrame:
    """What was sent, how, on how many reviews, at what cost, and is it delivered: one row per run."""
    return run_flags(ledger).select(
        *RUN_KEY, "run_id", "status", F.col("email_delivery.mode").alias("email_mode"),
        F.coalesce("email_delivery.message_id", "email_delivery.draft_id").alias("email_ref"),
        F.col("reviews_fetched.total").alias("reviews"), F.col("llm_tokens.estimated_cost_usd").alias("cost_usd"),
        F.col("is_complete").alias("delivered"), "is_partial", "doc_delivered", "email_delivered")


def latest_run_health(ledger: DataFrame) -> DataFrame:
    """Severity of the newest run; a ledger without runs is healthy."""
    last = ledger.agg(F.max_by(F.struct("run_id", "status"), F.struct("started_at", "update_seq")).alias("r"))
    # Severity and exit code per status.
    severity = (
        F.when(F.col("r").isNull(), "healthy").when(F.col("r.status") == "failed", "critical")
        .when(F.col("r.status") == "partial", "warning").when(F.col("r.status") == "running", "info")
        .when(F.col("r.status") == "completed", "ok").otherwise("unknown"))
    code = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "unknown", 3).otherwise(0)
    return last.select("r.run_id", "r.status", severity.alias("severity")).withColumn("exit_code", code)
