"""The corpus pipeline, stage by stage, and the registered queries."""

from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm import queries
from voxloom.session import durable


def test_stages_keep_columns_and_clean_documents(spark, sf):
    """Planted cases go, each at its stage, and what no stage is about stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 150").orderBy("item_id").first().text
    clean = "A short and friendly note about gardens, tools and the weather of the coming week."
    near = " ".join(f"tree{i} leaf{i * 7 % 31}" for i in range(120))
    rows = [(900001, clean), (900002, near), (900003, near.replace("tree5 ", "bush5 ")), (900004, "Opening words of a page. " + item),
            (900005, None), (900006, ""), (None, "no id at all but a text long enough to be a line")]
    extra = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], docs.schema)
    frame = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        made = durable(stage(spark, frame, sf))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
        seen[name] = {r.doc_id for r in made.select("doc_id").collect()}
        frame = made
    kept = seen["benchmark_decontamination"]
    assert {900001, 900002, 900005, 900006, None} <= kept and not {900003, 900004} & kept
    assert 900004 in seen["minhash_near_dedup"] and 900003 in seen["line_dedup"]
    assert frame.where("taken > 3 * size OR taken = 0").count() == 0


def test_any_columns_and_odd_rows(spark, sf, odd):
    """Columns of the names that stages use themselves, a map, repeated ids, nulls, and no rows at all."""
    names = ("_low", "_p_toxic", "_kept", "_rows", "target", "taken", "source_size", "row", "kept", "n_removed", "carried")
    wide = odd.withColumns({n: F.lit(n) for n in names}).withColumn("marks", F.create_map(F.lit("a"), F.col("doc_id")))
    for docs in (wide, wide.where("doc_id > 1000")):
        frame, left = docs, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            made = durable(stage(spark, frame, sf))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == docs.columns and made.schema["marks"].dataType == docs.schema["marks"].dataType
                assert made.count() <= left
                left, frame = made.count(), made
        assert set(made.columns) == set(docs.columns)
    mixed = corpus_pipeline.mix_sources(spark, durable(wide), sf)
    words = wide.where("length(trim(text)) > 0").count()
    got = mixed.collect()
    assert len(got) <= words and all(0 < r.taken <= 3 * r.size for r in got) and any(r.doc_id is None for r in got)
    totals = {r.source: r.target for r in got}
    for source, target in totals.items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 1
    assert sum(1 for r in got if r.doc_id == 2) == 3


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and {"doc_id", "text", "taken", "target"} <= set(out.columns)


def test_queries_return_a_row_per_document(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_suffix_array_dedup", "op2_line_dedup", "op4_language_id", "op5_toxicity", "op7_source_mixing"):
        assert queries.QUERIES[name](spark, sf).count() == n
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
