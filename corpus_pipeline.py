"""From raw documents to a training mix: toxicity, line dedup, near-dedup, benchmark decontamination, source mixing.

Every stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the next stage's documents. All
but the last return the columns of `documents`, whatever their names and types; the mix adds `size`, `source_size`, `target` and `taken`, and
a column of such a name gives way to it. Rows with null ids are documents of their own in every stage; null and empty texts pass as they
are until the mix, which takes no words of them and so leaves them out. Of rows that share an id the near-dedup stage keeps one, by a hash
of the whole row. A table without rows goes through all stages; without labels nothing is toxic, without a benchmark nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxloom.functions.ranking import position
from voxloom.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from voxloom.session import durable

#: A document whose probability of being toxic reaches this goes.
TOXIC = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(docs: DataFrame, *but: str) -> Column:
    """All columns as one, so that none can clash with those of a stage."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("row")


def _columns(docs: DataFrame, *but: str) -> list[Column]:
    """What `_row` packed, and the columns left out of it, under their names and in their order."""
    return [F.col(c) if c in but else F.col("row").getField(c).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal model, fitted on the labels, finds toxic."""
    model = toxicity.fit(docs, toxicity.graded(docs, _table(spark, sf_dir, "labels")))
    found = toxicity.annotate(docs.select("text", _row(docs, "text")), model)
    return found.where(F.col("_p_toxic") < TOXIC).select(*_columns(docs, "text"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier line (up to two edits); a document that has nothing else left goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = line_dedup.remove_repeated_lines(docs, carry=tuple(rest), short=True)
    left = cut.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept_text", r"\s+", " ")) != ""))
    columns = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("carried.no_text"), F.col("kept_text"))}
    columns |= {c: F.col(f"carried.c{i}") for i, c in enumerate(rest)}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more; of rows with one id, one stays."""
    found = near_dedup.near_duplicates(docs, words_each=5, percent=80).where("doc_id IS NOT NULL")
    named = found.groupBy("doc_id").agg(F.min("kept").alias("_kept"), F.count("*").alias("_rows")).where("NOT _kept OR _rows > 1")
    joined = docs.select("doc_id", _row(docs, "doc_id")).join(named, "doc_id", "left").where("_kept IS NULL OR _kept")
    once = joined.where("_rows IS NULL")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.to_json("row")))  # a map has no hash, its text has
    several = joined.where("_rows IS NOT NULL").withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")
    return once.unionByName(several).select(*_columns(docs, "doc_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark, edited or not."""
    found = decontamination.leaks(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many of their words (repeats counted) it takes towards their source's target."""
    each = durable(mixing.mix(docs, weights=(5, 2, 1), most=3)[0])
    added = ("size", "source_size", "target", "taken")
    kept = docs.drop(*added)
    packed = kept.select("doc_id", _row(kept, "doc_id"))
    several = durable(each.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"))
    alone = each.join(several, "doc_id", "left_anti").where("doc_id IS NOT NULL AND taken > 0")
    once = packed.join(alone.select("doc_id", *added), "doc_id")
    # rows that share an id, or have none: those of one source and size are as good as each other, so they are matched by turn
    size = F.size(F.regexp_extract_all(F.coalesce(F.col("row.text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    same = lambda df: df.join(several.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    keys = ("doc_id", "source", "size")
    rows = position(same(packed).select("doc_id", F.col("row.source").cast("string").alias("source"), size.alias("size"), "row"), keys, [F.xxhash64(F.to_json("row"))])
    taken = position(same(each), keys, [F.col("taken")]).select(*[F.col(c).alias(f"_{c}") for c in (*keys, "pos")], "source_size", "target", "taken")
    match = F.lit(True)
    for c in (*keys, "pos"):
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    shared = rows.join(taken, match).where("taken > 0").select("doc_id", "row", *added)
    return once.unionByName(shared).select(*_columns(kept, "doc_id"), *added)


STAGES = [
    ("toxicity", drop_toxic), ("line_dedup", drop_lines), ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks), ("source_mixing", mix_sources)]

#: SQL can express neither the model nor the edit join; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
