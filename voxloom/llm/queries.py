"""Registered queries of the operators for training data, with their parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm import (
    decontamination, embedding_dedup, language_id, line_dedup, mixing, near_dedup, page_diff, resident_lloyd, sharded_lloyd, suffix_dedup, token_files,
    toxicity, window_dedup)

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The tokenizer file of the queries, on the driver."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes of 100-byte strings that also start earlier."""
    cut = suffix_dedup.remove_later_copies(table(spark, sf_dir, "documents"), length=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that equal an earlier line, or differ from it by two edits or less."""
    cut = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"), errors=2, short=True)
    return cut.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles overlap by 85 % or more."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words_each=3, percent=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    learned = language_id.samples(docs.where(language_id.remainder(F.col("doc_id")) != 1))
    found = language_id.predict(docs, learned)
    held = F.coalesce(language_id.remainder(F.col("doc_id")) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.graded(docs, labels))
    return toxicity.predict(docs, model).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_diff.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of every document; sources weigh 5, 2, 1 in turn, at most three passes each."""
    each, _ = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return each.select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 50 words that also start in a smaller document."""
    cut = window_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that align with an item of the benchmark."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of vectors of one label whose cosine is 0.93 or more."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op11_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of 16 centroids of every vector of 64 components, after three rounds over column blocks."""
    found = sharded_lloyd.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dimensions=64, scale=64)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector: 8 parts, 16 entries for each, six rounds."""
    found = resident_lloyd.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, dimensions=64, scale=4096)
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document starts in the token files, how many ids it has, and their checksum, read from the files."""
    folder = token_files.write_files(table(spark, sf_dir, "documents"), vocabulary(), end=2)
    return token_files.read_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_line_dedup, op3_minhash_near_dedup, op4_language_id, op5_toxicity, op6_html_extraction, op7_source_mixing, op8_substring_dedup, op9_benchmark_decontamination, op10_embedding_near_dedup, op11_sharded_lloyd, op12_resident_lloyd, op13_token_files)}
ORACLES: dict[str, str] = {
    "op7_source_mixing": mixing.oracle_sql((5, 2, 1), 3), "op11_sharded_lloyd": sharded_lloyd.oracle_sql(), "op12_resident_lloyd": resident_lloyd.oracle_sql()}
