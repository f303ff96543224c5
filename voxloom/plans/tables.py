"""The given tables as reviews, runs, clusters, themes and ledger, for the registered queries.

Reviews, windows and clusters hold every row. Reports and what goes into them (`slim`, `chosen`, `themes`, `quotes`, `reports`) are those of
capped runs, since a cap on the reviews of a run is part of what they are: here MAX_RUN.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.functions import ranking
from voxloom.functions.keys import review_id, section_anchor
from voxloom.functions.weeks import assign_windows, iso_week_of, iso_year_of, week_sunday, window_start
from voxloom.operators import cluster, cost, ingest, quotes as quote_ops, report, themes as theme_ops
from voxloom.operators.ledger import latest_records
from voxloom.schemas import RUN_KEY, RUN_RECORD
from voxloom.session import durable, pin_utc, spread

FIRST_DAY = 1_704_067_200  # 2024-01-01 00:00:00 UTC
MINUTES_APART = 97
#: Documents of one round of the calendar: dates span a fixed time, so runs grow with the tables.
CALENDAR = 10_000
#: Cap of a run in the queries about capped runs; small enough to cut runs of the small tables too.
MAX_RUN = 40
LABELS = 7
EDIT_SEQ = 1_000_000_000_000
MODELS = ("gpt-4o-mini", "gpt-4o-2024", "llama-3.1-8b", "some-other-model", "text-embedding-3-small")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def calendar(doc: Column) -> Column:
    """The time of a document."""
    return F.timestamp_seconds(F.lit(FIRST_DAY) + F.pmod(doc, F.lit(CALENDAR)) * (60 * MINUTES_APART))


def all_weeks(window_weeks: int = 10) -> list[tuple[int, int]]:
    """Every ISO week that has a document of the calendar in its window."""
    first = date(1970, 1, 1) + timedelta(seconds=FIRST_DAY)
    last = first + timedelta(minutes=(CALENDAR - 1) * MINUTES_APART, weeks=window_weeks)
    return [(first + timedelta(weeks=n)).isocalendar()[:2] for n in range((last - first).days // 7 + 1)]


def as_reviews(docs: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    digits = lambda n: F.lpad(F.pmod(doc, F.lit(10 ** n)).cast("string"), n, "0")
    kind = doc % 8
    tail = (
        F.when(kind == 0, F.concat(F.lit(" Call 98765"), digits(5)))
        .when(kind == 1, F.concat(F.lit(" UPI u"), doc.cast("string"), F.lit("@okbank")))
        .when(kind == 2, F.concat(F.lit(" PAN ABCDE"), digits(4), F.lit("F")))
        .when(kind == 3, F.concat(F.lit(" id 1234 5678 "), digits(4)))
        .when(kind == 4, F.concat(F.lit(" mail u"), doc.cast("string"), F.lit("@example.com")))
        .otherwise(F.lit("")))
    store = F.when(doc % 2 == 0, "appstore").otherwise("playstore")
    body = F.concat("text", tail)
    return docs.select(
        review_id(store, F.lit("app"), doc.cast("string")).alias("id"), store.alias("store"),
        F.col("source").alias("product"), F.concat(F.lit("user_"), (doc % 97).cast("string")).alias("author"),
        (doc % 5 + 1).cast("int").alias("rating"),
        F.when(doc % 2 == 0, F.substring("text", 1, 40)).alias("title"), body.alias("body"),
        calendar(doc).alias("date"),
        F.when(doc % 3 != 0, F.concat(F.lit("1."), (doc % 10).cast("string"))).alias("version"),
        F.col("lang").alias("language"), F.length(body).alias("raw_length"), doc.alias("seq"))


def products_of(docs: DataFrame) -> DataFrame:
    """One product per source; some lack an id for a store."""
    slugs = docs.select(F.col("source").alias("slug")).distinct()
    number = F.regexp_extract("slug", r"(\d+)$", 1).cast("int")
    return slugs.select(
        "slug", F.concat(F.lit("Product "), F.upper("slug")).alias("display_name"),
        F.when(number % 4 == 0, "").otherwise(F.concat(F.lit("id"), number.cast("string"))).alias("appstore_id"),
        F.when(number % 5 == 0, "").otherwise(F.concat(F.lit("com."), F.col("slug"))).alias("playstore_id"),
        F.concat(F.lit("doc-"), F.col("slug")).alias("doc_id"), F.concat(F.lit("Doc "), F.col("slug")).alias("doc_title"),
        F.array(F.concat(F.col("slug"), F.lit("@example.com")), F.concat(F.lit("team@"), F.col("slug"), F.lit(".org"))
                ).alias("stakeholder_emails"))


def grid_of(runs: DataFrame, listed: DataFrame) -> DataFrame:
    """Window and product of the given run keys."""
    return runs.select(*RUN_KEY).distinct().join(
        listed.select(F.col("slug").alias("product"), "display_name", "doc_id", "stakeholder_emails"), "product"
    ).withColumns({
        "window_start": window_start(F.col("iso_year"), F.col("iso_week")),
        "window_end": week_sunday(F.col("iso_year"), F.col("iso_week"))})


class Given:
    """The given tables in one session; what several results share is built once."""

    def __init__(self, spark: SparkSession, sf_dir: str, shared: bool = False) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        # A plan that reads the ranked runs several times stores them first.
        self._keep = durable if shared else lambda df: df

    @cached_property
    def reviews(self) -> DataFrame:
        """`documents` as reviews, with planted personal data; `seq` is the document id."""
        return as_reviews(documents(self.spark, self.sf_dir))

    @cached_property
    def products(self) -> DataFrame:
        return products_of(table(self.spark, self.sf_dir, "documents"))

    @cached_property
    def slim(self) -> DataFrame:
        """Reviews of every rolling window without their texts: run key, `pos` (capped) and `label`."""
        rows = self.reviews.select("product", "id", "store", "rating", "date", "seq")
        ranked = ingest.newest_per_window(rows, MAX_RUN)
        return self._keep(ranked.withColumn("label", (F.pmod(F.col("seq"), F.lit(LABELS)) - 1).cast("int")))

    @cached_property
    def every_member(self) -> DataFrame:
        """Reviews of every rolling window, however many, with `pos` and `label`."""
        rows = ingest.newest_first(assign_windows(self.reviews.select("product", "id", "store", "rating", "date", "seq")))
        return rows.withColumn("label", (F.pmod(F.col("seq"), F.lit(LABELS)) - 1).cast("int"))

    @cached_property
    def clusters(self) -> DataFrame:
        """The largest clusters of every window, by the planted labels."""
        return cluster.top_clusters(cluster.cluster_stats(self.slim))

    @cached_property
    def every_cluster(self) -> DataFrame:
        """The largest clusters of every window, all reviews counted."""
        return cluster.top_clusters(cluster.cluster_stats(self.every_member))

    @cached_property
    def chosen(self) -> DataFrame:
        """Members of the largest clusters, without texts."""
        return self.slim.join(self.clusters.select(*RUN_KEY, "label", "rank", "size"), [*RUN_KEY, "label"])

    @cached_property
    def top_members(self) -> DataFrame:
        """Members of the largest clusters with title and body."""
        return self.chosen.join(self.reviews.select("id", "title", "body"), "id")

    @cached_property
    def answers(self) -> DataFrame:
        """What a summariser might say: the first three members quoted, the third one wrongly."""
        first = ranking.top_n(
            self.chosen.select(*RUN_KEY, "label", "rank", "size", "pos", "id"), (*RUN_KEY, "label"), [F.col("pos")], 3,
            "quote_no")
        told = first.join(self.reviews.select("id", F.substring("body", 1, 60).alias("head")), "id")
        text = (
            F.when(F.col("quote_no") == 1, F.concat(F.lit("  "), F.col("head"), F.lit("  ")))
            .when(F.col("quote_no") == 2, F.substring("head", 11, 50))
            .otherwise(F.concat(F.lit("zz"), F.substring("head", 1, 30))))
        quoted = told.groupBy(*RUN_KEY, "label", "rank", "size").agg(F.transform(
            F.sort_array(F.collect_list(F.struct("quote_no", text.alias("text")))), lambda q: q["text"]).alias("quotes"))
        name = F.format_string("Theme %d of %s", F.col("label"), F.col("product"))
        ideas = F.array(
            F.concat(F.lit("Improve what reviewers of group "), F.col("label").cast("string"), F.lit(" mention first")),
            F.lit("Reply soon"))
        return quoted.select(
            *RUN_KEY, "label", "rank", "size", F.to_json(F.struct(
                name.alias("name"), F.format_string("About %d reviews.", F.col("size")).alias("description"),
                "quotes", ideas.alias("action_ideas"))).alias("raw"))

    @cached_property
    def themes(self) -> DataFrame:
        parsed = theme_ops.parse_themes(self.answers)
        return self._keep(theme_ops.rank_themes(parsed.withColumn("review_count", F.col("size"))))

    @cached_property
    def quotes(self) -> DataFrame:
        """The proposed quotes of the themes, one per row."""
        asked = self.themes.select(*RUN_KEY, "label", F.posexplode("quotes").alias("quote_no", "text"))
        return asked.withColumn("quote_no", F.col("quote_no") + 1)

    @cached_property
    def checked(self) -> DataFrame:
        return self._keep(quote_ops.attribute_quotes(
            self.quotes, self.chosen, self.reviews.select("id", "body")))

    @cached_property
    def stats(self) -> DataFrame:
        return report.run_stats(
            report.counts_by_store(self.slim), cluster.noise_count(self.slim), self.clusters, self.themes, self.checked,
            cost.run_cost(run_calls(self.clusters)))

    @cached_property
    def grid(self) -> DataFrame:
        return grid_of(self.slim, self.products)

    @cached_property
    def reports(self) -> DataFrame:
        """A full report of every rolling window, from the planted clusters."""
        at = F.lit("2026-01-05 06:07:08").cast("timestamp")
        return report.assemble_report(self.grid, self.themes, self.checked, self.stats, at)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Given(spark, sf_dir).reviews


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First poll, and a second one that delivers every tenth review again, edited."""
    first = reviews(spark, sf_dir)
    second = first.where(F.col("seq") % 10 == 0).withColumns({
        "body": F.concat("body", F.lit(" (edited)")), "seq": F.col("seq") + EDIT_SEQ})
    return first.unionByName(second)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Given(spark, sf_dir).products


def slim_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Given(spark, sf_dir).slim


def every_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Given(spark, sf_dir).every_member


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model call per turn of `conversations`: words asked and words answered."""
    talk = table(spark, sf_dir, "conversations")
    words = F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long")
    user = F.col("role") == "user"
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), F.pmod(F.col("conv_id"), F.lit(len(MODELS))).cast("int"))
    return talk.select(
        "conv_id", "turn", model.alias("model"), F.when(user, words).otherwise(F.lit(0)).alias("input_tokens"),
        F.when(user, F.lit(0)).otherwise(words).alias("output_tokens"))


def run_calls(top: DataFrame) -> DataFrame:
    """A call per summarised cluster, with figures that follow from the cluster."""
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), F.pmod(F.col("label"), F.lit(len(MODELS))).cast("int"))
    return top.select(
        *RUN_KEY, "label", "rank", model.alias("model"), (F.col("size") * 700).alias("input_tokens"),
        (F.col("size") * 90).alias("output_tokens"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`orders` as ledger updates: many per product and ISO week."""
    key = F.col("o_orderkey")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "partial")
        .when(key % 3 == 0, "failed").otherwise("running"))
    started = F.col("o_orderdate").cast("timestamp")
    year, week = iso_year_of(F.col("o_orderdate")), iso_week_of(F.col("o_orderdate"))
    product = F.concat(F.lit("src"), F.pmod("o_custkey", F.lit(20)).cast("string"))
    base = table(spark, sf_dir, "orders").select(
        key.alias("update_seq"), F.concat(F.lit("run-"), key.cast("string")).alias("run_id"), product.alias("product"),
        year.alias("iso_year"), week.alias("iso_week"), status.alias("status"), started.alias("started_at"),
        (F.round(F.col("o_totalprice")).cast("long")).alias("amount"))
    n = F.col("update_seq")
    done = F.col("status") == "completed"
    anchor = section_anchor(F.col("product"), F.col("iso_year"), F.col("iso_week"))
    later = F.when(done, F.col("started_at") + F.expr("interval 1 hour"))
    doc = F.struct(
        F.when(done, F.concat(F.lit("doc-"), F.col("product"))).otherwise("").alias("document_id"),
        F.when(done | (n % 4 == 0), anchor).alias("heading_id"), F.when(done, anchor).otherwise("").alias("section_anchor"),
        later.alias("delivered_at"))
    mail = F.struct(
        F.when(done & (n % 2 == 0), F.concat(F.lit("d"), n.cast("string"))).alias("draft_id"),
        F.when(done & (n % 2 == 1), F.concat(F.lit("m"), n.cast("string"))).alias("message_id"),
        F.array(F.concat(F.col("product"), F.lit("@example.com"))).alias("recipients"),
        F.when(n % 2 == 0, "draft").otherwise("send").alias("mode"), later.alias("delivered_at"))
    return base.select(
        "run_id", "product", "iso_year", "iso_week", "status", "started_at", later.alias("completed_at"),
        F.struct((n % 50).alias("appstore"), (n % 70).alias("playstore"), (n % 50 + n % 70).alias("total")
                 ).alias("reviews_fetched"),
        F.struct(F.col("started_at").alias("start"), F.col("started_at").alias("end")).alias("review_window"),
        (n % 6).alias("clusters_found"), (n % 5).alias("themes_generated"), (n % 16).alias("quotes_proposed"),
        (n % 13).alias("quotes_validated"),
        F.struct(F.col("amount").alias("input"), (n % 100).alias("output"),
                 F.lit(0.0).alias("estimated_cost_usd")).alias("llm_tokens"),
        doc.alias("doc_delivery"), mail.alias("email_delivery"), "update_seq")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_records(updates(spark, sf_dir))


def run_records(runs: DataFrame) -> DataFrame:
    """Records for the runs of even-numbered products; the others have none yet."""
    number = F.regexp_extract("product", r"(\d+)$", 1).cast("int")
    week = F.col("iso_week")
    status = F.get(F.array(*[F.lit(s) for s in ("completed", "partial", "failed", "running")]), (week % 4).cast("int"))
    started = F.col("window_end").cast("timestamp") + F.expr("interval 6 hours")
    none = lambda kind: F.lit(None).cast(kind)
    seq = F.col("iso_year").cast("long") * 100 + week
    return runs.where(number % 2 == 0).select(
        F.concat(F.lit("r-"), section_anchor(F.col("product"), F.col("iso_year"), week)).alias("run_id"),
        *RUN_KEY, status.alias("status"), started.alias("started_at"), none("timestamp").alias("completed_at"),
        *[F.lit(None).cast(RUN_RECORD[c].dataType).alias(c) for c in RUN_RECORD.names[7:-1]],
        seq.alias("update_seq"))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as text blocks of the published documents; every third one holds an anchor."""
    day = calendar(F.col("doc_id"))
    anchor = section_anchor(F.col("source"), iso_year_of(day), iso_week_of(day))
    return documents(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("source")).alias("doc_id"),
        F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" - Anchor ID: "), anchor, F.lit(" end"))
               ).otherwise(F.col("text")).alias("text"))
