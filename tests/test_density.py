"""Planted blobs: clusters must come back, whatever the order and the partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from voxloom.operators import cluster, density, forest, reduce

KEYS = ("product", "iso_year", "iso_week")
SCHEMA = T.StructType([
    T.StructField("product", T.StringType()), T.StructField("iso_year", T.IntegerType()),
    T.StructField("iso_week", T.IntegerType()), T.StructField("pos", T.IntegerType()),
    T.StructField("id", T.StringType()), T.StructField("rating", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("truth", T.IntegerType())])


def planted(product, sizes, noise, repeated, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(len(sizes), 20))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    parts = [c + rng.normal(scale=0.05, size=(n, 20)) for c, n in zip(centers, sizes)]
    truth = np.repeat(np.arange(len(sizes)), sizes)
    vectors = np.vstack(parts)
    if repeated:
        copies = rng.choice(len(vectors), size=len(vectors) // 5, replace=False)
        vectors[copies] = vectors[(copies // 2)]
        truth[copies] = truth[copies // 2]
    extra = int(len(vectors) * noise)
    vectors = np.vstack([vectors, rng.normal(size=(extra, 20))])
    truth = np.concatenate([truth, np.full(extra, -1)])
    order = rng.permutation(len(vectors))
    return [
        (product, 2024, 1, i + 1, f"{product}-{i}", int(i % 5) + 1, vectors[j].tolist(), int(truth[j]))
        for i, j in enumerate(order)]


def adjusted_rand(a, b):
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, left, right = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    expected = left * right / pairs(np.array([len(a)], dtype=float))
    top = (left + right) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


CASES = {
    "two": ([25, 40], 0.0, False, 1), "three": ([25, 40, 55], 0.1, False, 2), "four": ([25, 40, 55, 30], 0.2, True, 3),
    "five": ([25, 40, 55, 30, 45], 0.3, False, 4), "copies": ([30, 30], 0.1, True, 5)}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [r for name, case in CASES.items() for r in planted(name, *case)]
    rows += [r for n, k in (("one", 1), ("nine", 9)) for r in planted(n, [k], 0.0, False, 7)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return cluster.cluster_reviews(frame).select("product", "pos", "id", "truth", "label", "rating", *KEYS[1:]).toPandas()


@pytest.mark.parametrize("name", list(CASES))
def test_blobs_are_found(labelled, name):
    part = labelled[labelled["product"] == name]
    blob = part[part["truth"] >= 0]
    assert adjusted_rand(blob["truth"].to_numpy(), blob["label"].to_numpy()) == 1.0
    assert (part["label"] >= -1).all() and len(part) == len(planted(name, *CASES[name]))


def test_small_runs_are_one_cluster(labelled):
    for name, n in (("one", 1), ("nine", 9)):
        part = labelled[labelled["product"] == name]
        assert len(part) == n and (part["label"] == 0).all()


def test_labels_follow_first_member(labelled):
    found = labelled[labelled["label"] >= 0].groupby(["product", "label"])["pos"].min().reset_index()
    for _, part in found.groupby("product"):
        assert part.sort_values("pos")["label"].tolist() == list(range(len(part)))


def test_order_of_input_has_no_effect(spark, labelled):
    rows = [r for name in ("three", "copies") for r in planted(name, *CASES[name])]
    again = cluster.cluster_reviews(
        spark.createDataFrame(rows[::-1], SCHEMA).repartition(3, "pos")).select("id", "label").toPandas()
    before = labelled.set_index("id")["label"]
    assert (again.set_index("id")["label"] == before.loc[again["id"]]).all()


def test_two_far_blobs_after_reduction(spark):
    rng = np.random.default_rng(42)
    vectors = np.vstack([rng.normal(0.0, 0.1, (25, 64)), rng.normal(10.0, 0.1, (25, 64))])
    rows = [("p", 2024, 1, i + 1, str(i), 5, v.tolist(), i // 25) for i, v in enumerate(vectors)]
    out = cluster.cluster_reviews(spark.createDataFrame(rows, SCHEMA)).select("truth", "label").toPandas()
    far = out[out["truth"] == 1]["label"]
    assert far.nunique() == 1 and far.iloc[0] >= 0


def test_blocks_give_the_same_neighbours(spark):
    rows = planted("p", [60, 60], 0.2, True, 9)
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = density.neighbours(frame, KEYS, "pos", "embedding", 6).select("a", "b", F.round("d", 6).alias("d"), "rank")
    cut = density.neighbours(frame, KEYS, "pos", "embedding", 6, block_rows=20).select(
        "a", "b", F.round("d", 6).alias("d"), "rank")
    assert whole.exceptAll(cut).count() == 0 and whole.count() == cut.count() == 6 * len(rows)


def kruskal(edges):
    """Forest and, for a distance, the parts of a graph, by plain union-find."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    chosen = []
    for a, b, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            chosen.append((a, b, w))
    return chosen


def parts(edges, nodes):
    groups = {n: {n} for n in nodes}
    for a, b, _ in edges:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for n in groups[b]:
                groups[n] = groups[a]
    return {frozenset(g) for g in groups.values()}


def graphs():
    rng = np.random.default_rng(5)
    yield "chain", [(i, i + 1, float(200 - i)) for i in range(1, 200)] + [(300, 301, 0.0)]
    yield "star", [(0, i, 1.0) for i in range(1, 60)]
    for name, n, m, kinds in (("ties", 40, 200, 4), ("sparse", 120, 90, 1000), ("dense", 60, 900, 30)):
        pairs = {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(m)}
        yield name, [(a, b, float(rng.integers(kinds))) for a, b in sorted(pairs)]


@pytest.mark.parametrize("held", [forest.HELD, 20])
def test_merge_tree_equals_kruskal(spark, held):
    """The forest, and the parts at every distance, in one task a run or by rounds of joins."""
    given = dict(graphs())
    rows = [(name, a, b, w) for name, edges in given.items() for a, b, w in edges]
    frame = spark.createDataFrame(rows, "product string, a long, b long, w double").repartition(3)
    tree, chosen = forest.merge_tree(frame, ("product",), held)
    tree, chosen = tree.collect(), chosen.collect()
    for name, edges in given.items():
        want = kruskal(edges)
        assert sorted((r["a"], r["b"], r["w"]) for r in chosen if r["product"] == name) == sorted(want)
        paths = {r["node"]: r["path"] for r in tree if r["product"] == name}
        assert set(paths) == {n for a, b, _ in edges for n in (a, b)}
        for limit in {w for *_, w in edges} | {-1.0}:
            groups = {}
            for node, path in paths.items():
                height = sum(1 for x in path if x["w"] <= limit)
                groups.setdefault((height, path[height - 1]["comp"] if height else node), set()).add(node)
            assert {frozenset(g) for g in groups.values()} == parts([e for e in want if e[2] <= limit], paths)
    assert forest.merge_tree(frame.where("a < 0"), ("product",))[1].collect() == []


def test_bounds_on_tasks_do_not_change_labels(spark, labelled):
    rows = [r for name in ("three", "copies", "five") for r in planted(name, *CASES[name])]
    reduced = reduce.reduce_dims(spark.createDataFrame(rows, SCHEMA), KEYS, block_rows=30)
    again = density.density_cluster(reduced, KEYS, block_rows=25, held=4).select("id", "label").toPandas()
    before = labelled.set_index("id")["label"]
    assert (again.set_index("id")["label"] == before.loc[again["id"]]).all()


def test_neighbours_of_a_large_run(spark, record_property):
    """50,000 rows in groups: equal to brute force, and most pairs of blocks are never compared."""
    rng = np.random.default_rng(3)
    n, k = 50_000, 15
    centers = rng.normal(size=(40, 5))
    x = (centers[rng.integers(40, size=n)] + rng.normal(scale=0.05, size=(n, 5))).round(6)
    x[:500] = x[500]  # a heap of copies
    frame = spark.createDataFrame([("p", i, v) for i, v in enumerate(x.tolist())], "product string, pos int, reduced array<double>")
    rows, asked = density.searches(frame, ("product",), "pos", "reduced", k)
    sizes = rows.groupBy(F.col("block").alias("other")).agg(F.count("*").alias("size"))
    compared = asked.join(sizes, "other").agg(F.sum("size")).first()[0]
    record_property("share of pairs compared", compared / n ** 2)
    assert compared < 0.25 * n ** 2
    some = rng.choice(n, 1500, replace=False)
    found = {}
    near = density.neighbours(frame, ("product",), "pos", "reduced", k)
    for r in near.join(spark.createDataFrame([(int(i),) for i in some], "a long"), "a").collect():
        found.setdefault(r["a"], []).append((r["d"], r["b"]))
    for i in some.tolist():
        d = np.sqrt(((x - x[i]) ** 2).sum(1)).round(9)
        d[i] = np.inf
        best = np.lexsort((np.arange(n), d))[:k]
        got = sorted(found[i])
        assert [b for _, b in got] == best.tolist() and np.allclose([a for a, _ in got], d[best], atol=2e-9)


def test_many_small_runs_of_many_dimensions(spark):
    """2,000 vectors of 384 dimensions in 200 runs, and the same cut into blocks: equal to numpy up to sign."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 384)) * np.linspace(3, 1, 384)
    rows = [(f"p{i % 200}", i, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame(rows, "product string, pos int, embedding array<double>").repartition(8)
    for block_rows in (reduce.BLOCK_ROWS, 3):
        out = {r["pos"]: r["reduced"] for r in reduce.reduce_dims(frame, ("product",), block_rows=block_rows).collect()}
        for run in (0, 77, 199):
            mine = x[run::200] / np.linalg.norm(x[run::200], axis=1, keepdims=True)
            u, s, _ = np.linalg.svd(mine - mine.mean(0), full_matrices=False)
            assert np.allclose(np.abs([out[i] for i in range(run, 2000, 200)]), np.abs(u[:, :5] * s[:5]), atol=1e-6)


def test_reduction_matches_numpy(spark):
    rows = planted("p", [40, 40], 0.1, False, 11)
    out = reduce.reduce_dims(spark.createDataFrame(rows, SCHEMA).repartition(4), KEYS).select("pos", "reduced").collect()
    got = np.array([r["reduced"] for r in sorted(out, key=lambda r: r["pos"])])
    x = np.array([r[6] for r in sorted(rows, key=lambda r: r[3])])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = u[:, :5] * s[:5]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
