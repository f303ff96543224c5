"""Centroid clustering and vector codes, against brute force on Python integers."""

import hashlib
import math
import random

import pytest

from voxloom.llm import queries, resident_lloyd, sharded_lloyd
from voxloom.llm.vectors import MOST, distances, narrow, scaled

INF, NAN = float("inf"), float("nan")


def squared(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))


def lloyd(x, centres, rounds):
    """Labels, distances and centroids of plain Lloyd rounds on integers."""
    centres = [list(c) for c in centres]
    for turn in range(rounds + 1):
        label = [min(range(len(centres)), key=lambda c: (squared(v, centres[c]), c)) for v in x]
        if turn == rounds:
            return label, [squared(v, centres[c]) for v, c in zip(x, label, strict=True)], centres
        for c in range(len(centres)):
            mine = [v for v, k in zip(x, label, strict=True) if k == c]
            if mine:
                centres[c] = [sum(part) // len(mine) for part in zip(*mine, strict=True)]


def floored(v, scale):
    return [math.floor(int(a) * scale if abs(a) >= 1 << 52 else a * scale) for a in v]


def good(v, d=None):
    return v is not None and (d is None or len(v) == d) and all(a is not None and math.isfinite(a) for a in v)


def brute_clusters(rows, k, rounds, d, scale):
    kept = [(i, floored(v, scale), v) for i, v, *_ in rows if good(v, d)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, x) for i, x, v in kept if i is not None)[:k]
    label, distance, centres = lloyd([x for _, x, _ in kept], [x for *_, x in starts], rounds)
    out = []
    for (i, *_), c, near in zip(kept, label, distance, strict=True):
        mine = sum(n for n, o in zip(distance, label, strict=True) if o == c)
        out.append((i, c, *(min(s, MOST) for s in (near, mine, sum(distance))), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_codes(rows, parts, entries, rounds, d, scale):
    kept = [(i, label, floored(v, scale), v) for i, v, label, *_ in rows if good(v)]
    whole = [r for r in kept if len(r[2]) == d]
    starts = [x for _, _, x in sorted((i, v, x) for i, _, x, v in whole if i is not None)[:entries]]
    width, codes, errors, books = d // parts, [""] * len(whole), [0] * len(whole), []
    for p in range(parts):
        cut = slice(p * width, (p + 1) * width)
        label, distance, centres = lloyd([x[cut] for _, _, x, _ in whole], [s[cut] for s in starts], rounds)
        codes = [a + f"{c:02x}" for a, c in zip(codes, label, strict=True)]
        errors = [a + b for a, b in zip(errors, distance, strict=True)]
        books += [v for c in centres for v in c]
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    found = [(i, label, c, e) for (i, label, *_), c, e in zip(whole, codes, errors, strict=True)]
    found += [(i, label, None, None) for i, label, x, _ in kept if len(x) != d]
    by_label = {l: sum(e or 0 for _, o, _, e in found if o == l) for _, l, _, _ in found}
    return sorted(((i, c, e, by_label[l], digest) for i, l, c, e in found), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label string, distance int, block int, id string, n int, data string"


def rows_of(seed, n=150, d=8, hot=None):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    out = []
    for i in range(n):
        v = hot if hot and draw.random() < 0.6 else [m + draw.gauss(0, 0.3) for m in draw.choice(middles)]
        out.append((i, v, draw.choice(["a", "b", None])))
    odd = [(900, None, "a"), (901, [], "a"), (902, [1.0] * (d - 1), "b"), (903, [NAN] + [0.0] * (d - 1), "a"), (904, [INF] + [0.0] * (d - 1), None),
           (905, [None] + [0.0] * (d - 1), "b"), (None, [0.1] * d, "a"), (None, None, None), (3, [0.5] * d, "b"), (3, [0.5] * d, "b"), (3, [-0.5] * d, "b"),
           (906, [0.0] * d, "a")]
    return [(*r, 1, 2, "x", 3, "y") for r in out + odd]


@pytest.mark.parametrize(("seed", "hot"), [(1, None), (2, [0.25] * 8)])
def test_clusters_equal_brute_force(spark, seed, hot):
    rows = rows_of(seed, hot=hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = sharded_lloyd.cluster(df, k=6, rounds=3, dimensions=8, scale=64).drop("centroid").collect()
    assert sorted(map(tuple, found), key=repr) == brute_clusters(rows, 6, 3, 8, 64)


@pytest.mark.parametrize(("seed", "hot"), [(3, None), (4, [0.25] * 8)])
def test_codes_equal_brute_force(spark, seed, hot):
    rows = rows_of(seed, hot=hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = resident_lloyd.compress(df, parts=4, entries=5, rounds=4, dimensions=8, scale=4096).drop("label").collect()
    assert sorted(map(tuple, found), key=repr) == brute_codes(rows, 4, 5, 4, 8, 4096)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i), -float(i)], None) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, sharded_lloyd.cluster(df, k=16, rounds=2, dimensions=2, scale=64).drop("centroid").collect())) == brute_clusters(rows, 16, 2, 2, 64)
    found = resident_lloyd.compress(df, parts=2, entries=16, rounds=2, dimensions=2, scale=8).drop("label").collect()
    assert sorted(map(tuple, found)) == brute_codes(rows, 2, 16, 2, 2, 8)
    empty = df.where("vec_id < 0")
    assert sharded_lloyd.cluster(empty, dimensions=2).collect() == []
    assert resident_lloyd.compress(empty, parts=2, dimensions=2).collect() == []
    odd = spark.createDataFrame([(1, None, 1), (2, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert sharded_lloyd.cluster(odd, dimensions=2).collect() == []
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in resident_lloyd.compress(odd, parts=2, dimensions=2).collect()] == [(2, None, None, 0)]


def test_numbers_beyond_a_long(spark):
    """Integers stay exact; what does not fit into a long is returned as the largest one."""
    rows = [(1, [1e300, 2.0], "a"), (2, [1e9, -3e9], "a"), (3, [-1e300, 0.5], "b"), (4, [3e9, 7.0], "b"), (5, [0.25, 0.75], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = sharded_lloyd.cluster(df, k=2, rounds=2, dimensions=2, scale=64).drop("centroid", "centroid_sha256").collect()
    assert sorted(map(tuple, found)) == [r[:5] for r in brute_clusters(rows, 2, 2, 2, 64)]
    codes = resident_lloyd.compress(df, parts=1, entries=2, rounds=2, dimensions=2, scale=4096).select("vec_id", "code").collect()
    assert sorted(map(tuple, codes)) == [r[:2] for r in brute_codes(rows, 1, 2, 2, 2, 4096)]


def test_integers_are_exact():
    import numpy as np

    x = np.array([[1e300, -0.1, 2.0 ** 52 + 1]])
    assert scaled(x, 64).tolist() == [[int(1e300) * 64, -7, (2 ** 52 + 1) * 64]]
    big = np.array([[1 << 40, -(1 << 40)]])
    assert distances(big, -big).tolist() == [[2 * (1 << 41) ** 2]]
    assert narrow(np.array([127, -128])).dtype == np.int16 and narrow(np.array([127, -127])).dtype == np.int8


def test_registered_queries(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_sharded_lloyd(spark, sf).collect()), key=repr) == brute_clusters(rows, 16, 3, 64, 64)
    assert sorted(map(tuple, queries.op12_resident_lloyd(spark, sf).collect()), key=repr) == brute_codes(rows, 8, 16, 6, 64, 4096)
