"""Operators that remove copies, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from voxloom.llm import kernels as K, line_dedup, near_dedup, queries, suffix_dedup, window_dedup
from voxloom.llm.components import components


def texts_of(df):
    return sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def planted(spark, n=60, seed=3):
    """Documents of few different words with shared passages, so that strings repeat within and across documents."""
    draw = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(500)]
    passages = [" ".join(draw.choices(words, k=k)) for k in (8, 20, 60, 70, 120)]
    rows = []
    for i in range(n):
        parts = [" ".join(draw.choices(words, k=draw.randint(0, 80))) for _ in range(3)]
        rows.append((i, "\n".join(x for p in parts for x in (p, draw.choice(passages)))))
    rows += [(n + i, rows[i][1]) for i in range(8)] + [(n + 20, None), (n + 21, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, text in rows:
        data = text.encode()
        later = []
        for k in range(len(data) - length + 1):
            piece = data[k:k + length]
            later.append(piece in seen)
            seen.add(piece)
        covered = bytearray(len(data))
        for k, x in enumerate(later):
            if x:
                covered[k:k + length] = b"\x01" * length
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        out[i] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_repeated_row_is_one_document(spark):
    """A row that is there three times, in one slice and in others, keeps its whole text; its copy under another id goes."""
    draw = random.Random(8)
    alone, copied = (" ".join(draw.choices([f"v{i}" for i in range(300)], k=80)) for _ in range(2))
    rows = [(1, alone), (1, alone), (2, copied), (2, copied), (3, copied), (1, alone)]
    for parts in (1, 6):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_later_copies(docs, 100).collect())
        assert found == [(1, 0), (1, 0), (1, 0), (2, 0), (2, 0), (3, len(copied))]


@pytest.mark.parametrize("block", [8192, 3])
def test_suffix_dedup_removes_what_brute_force_removes(spark, block):
    """With tiny blocks every repeated gram is hot: local firsts meet again across blocks."""
    docs = planted(spark)
    got = {r.doc_id: tuple(r[1:5]) for r in suffix_dedup.remove_later_copies(docs, 100, block=block).collect()}
    assert got == brute_bytes(texts_of(docs), 100)


def crowded(spark, n=400):
    """Texts around one line of 40 bytes (many contexts of its grams), some with more in common, with copies of each kind, and periodic texts."""
    draw = random.Random(5)
    line = "".join(draw.choices("abcdefgh", k=40))
    left, right = ("".join(draw.choices("ijkl", k=150)) for _ in range(2))
    noise = lambda k: "".join(draw.choices("mnopqrstuvwxyz", k=k))
    kinds = [
        lambda: noise(120) + line + noise(120), lambda: noise(30) + left + line + noise(120), lambda: noise(120) + line + right + noise(30),
        lambda: noise(90) + left[-20:] + line + right[:draw.randint(10, 60)] + noise(90), lambda: line * draw.randint(2, 6) + noise(9)]
    rows = [(i, kinds[draw.choice([0, 0, 0, 0, 1, 2, 3, 4])]()) for i in range(n)]
    rows += [(n + i, "x" + rows[i][1][60:250] + "y") for i in range(0, n, 10)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


@pytest.mark.parametrize("block,halvings", [(8192, 1), (3, 0), (3, 1), (1, 2)])
def test_suffix_dedup_of_crowded_grams_removes_what_brute_force_removes(spark, block, halvings):
    docs = crowded(spark)
    got = {r.doc_id: tuple(r[1:5]) for r in suffix_dedup.remove_later_copies(docs, 100, block=block, halvings=halvings).collect()}
    assert got == brute_bytes(texts_of(docs), 100)


def test_suffix_dedup_blocks_of_a_gram_send_the_same_beside_each_other_and_apart():
    """Two blocks of one gram hold the same 120 bytes: the strings of both stay open, also where one task has both blocks."""
    text = bytes(range(120))
    names = ["gram", "salt", "id", "place", "size", "bytes"]
    rows = [pa.RecordBatch.from_arrays([
        pa.array([5]), pa.array([salt], pa.int32()), pa.array([salt + 1]), pa.array([0]), pa.array([120], pa.int32()), pa.array([text])], names=names) for salt in (0, 1)]
    sent = [[r for b in suffix_dedup._solve(iter(x), 100) for r in b.to_pylist()] for x in (rows, rows[:1], rows[1:])]
    assert len(sent[0]) == 42 and sent[0] == sent[1] + sent[2] and all(r["print"] is not None for r in sent[0])


def python_rows(df, column):
    """Rows that Python made in the plan of `df`, which has run, where `column` is among their columns."""
    todo, seen, total = [df._jdf.queryExecution().executedPlan()], set(), 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if node.id() in seen:
            continue
        seen.add(node.id())
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [
            node.children().apply(i) for i in range(node.children().size())]
        if kind == "MapInArrowExec" and column in [node.output().apply(i).name() for i in range(node.output().size())][3:]:
            total += node.metrics().apply("pythonNumRowsReceived").value()
    return total


def test_suffix_dedup_sends_no_strings_of_a_gram_in_several_blocks_one_by_one(spark):
    """A line of 40 bytes in texts that have nothing else in common: its grams have a context per text, no two of which share a string."""
    draw = random.Random(6)
    line = "".join(draw.choices("abcdefgh", k=40))
    noise = lambda k: "".join(draw.choices("mnopqrstuvwxyz", k=k))
    docs = spark.createDataFrame([(i, noise(150) + line + noise(150)) for i in range(500)], "doc_id long, text string")
    found = suffix_dedup.remove_later_copies(docs, 100, block=16)
    assert {r.n_removed for r in found.collect()} == {0}
    assert python_rows(found, "print") < 500


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12), st.randoms())
def test_longest_previous_factors(texts, draw):
    """Suffixes of texts in any order of positions: removed are those that start with four bytes of a smaller position."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum([0, *map(len, texts)])
    ids = draw.sample(range(100), len(texts))
    spots = [(first[i] + k, ids[i], k) for i, t in enumerate(texts) for k in range(len(t) - 3)]
    suffix, owner, place = (np.array(c, np.int64) for c in zip(*spots, strict=True))
    later, heads = suffix_dedup.previous_factors(data, K.prefix_hash(K.byte_values(data)), suffix, owner, place, 4)
    held = {}
    for at, i, k in spots:
        held.setdefault(bytes(data[at:at + 4]), []).append((i, k))
    want = [n for n, (at, i, k) in enumerate(spots) if min(held[bytes(data[at:at + 4])]) < (i, k)]
    assert later.tolist() == want and sorted([*later, *heads]) == list(range(len(spots)))


def test_fingerprints_of_long_spans():
    """Thue-Morse texts, which differ in every byte, have one polynomial modulo 2**64."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024)).encode()
    data = np.frombuffer(one + one.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    ends = np.array([0, 1024]), np.array([1024, 2048])
    prefix = K.prefix_hash(K.byte_values(data))
    assert len(set(K.span_hash(prefix, *ends).tolist())) == 1
    assert len(set(K.prints(data, *ends).tolist())) == len(set(K.span_prints(data, prefix, *ends).tolist())) == 2


def test_long_words_that_differ_everywhere_are_no_copies(spark):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one), (4, f"{one} " * 60), (5, f"{two} " * 60)], "doc_id long, text string")
    lines = {r.doc_id: r.n_removed for r in line_dedup.remove_repeated_lines(docs.where("doc_id < 4"), short=True).collect()}
    assert lines == {1: 0, 2: 0, 3: 1}
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, words_each=3, percent=85).collect()}
    assert near == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    windows = {r.doc_id: r.n_removed for r in window_dedup.remove_repeated_windows(docs).collect()}
    assert set(windows.values()) == {0}


def test_suffix_dedup_odd_rows(spark, odd):
    rows = suffix_dedup.remove_later_copies(odd, 50).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id != 2}
    assert by[1].n_removed == 0 and by[3].n_bytes == 0 and by[4].n_spans == 0
    assert by[7].n_removed == 15000 - 5 and by[None].n_removed >= len("The quick brown fox")
    assert sorted(r.n_removed for r in rows if r.doc_id == 2)[-2:] == [75, 75] or sum(r.n_removed > 0 for r in rows if r.doc_id == 2) >= 2
    assert suffix_dedup.remove_later_copies(odd.limit(0)).count() == 0


def test_window_dedup_removes_what_brute_force_removes(spark):
    docs = planted(spark)
    first, rows = {}, [(i, t.split()) for i, t in texts_of(docs)]
    for i, words in rows:
        for k in range(len(words) - 49):
            first.setdefault(tuple(words[k:k + 50]), i)
    want = {}
    for i, words in rows:
        gone = set()
        for k in range(len(words) - 49):
            if first[tuple(words[k:k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.doc_id: tuple(r[1:4]) for r in window_dedup.remove_repeated_windows(docs, 50).collect()}
    assert got == want


def test_window_dedup_odd_rows(odd):
    rows = window_dedup.remove_repeated_windows(odd, window=14).collect()
    assert len(rows) == odd.count()
    assert all(r.n_removed == 15 for r in rows if r.doc_id == 2 and r.n_words == 15)
    assert [r.n_removed for r in rows if r.doc_id == 7] == [0]
    assert window_dedup.remove_repeated_windows(odd.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(0, 3)), max_size=5), st.integers(1, 4))
def test_banded_distance(one, edits, errors):
    two = bytearray(one)
    for kind, at, byte in edits:
        at = min(at, len(two))
        if kind == 0:
            two.insert(at, byte)
        elif at < len(two):
            two[at:at + 1] = b"" if kind == 1 else bytes([byte])
    row = list(range(len(two) + 1))
    for i, x in enumerate(one, 1):
        new = [i]
        for j, y in enumerate(two, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert line_dedup.within(one, bytes(two), errors) == (row[-1] <= errors)


@pytest.mark.parametrize("small", [16, 2])
def test_line_dedup_against_brute_force(spark, small):
    """With tiny buckets the tiles do the work; the result is the same."""
    draw = random.Random(5)
    base = ["".join(draw.choices("abcdefghij ", k=40)).strip().ljust(40, "x") for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for line in draw.sample(base, 4):
            chars = list(line)
            for _ in range(draw.choice([0, 1, 2, 3])):
                k = draw.randrange(len(chars))
                chars[k:k + 1] = draw.choice([[], ["z"], [chars[k], "z"]])
            lines.append("".join(chars))
        rows.append((i, "\n".join([*lines, "ok"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            if len(line.strip()) >= 24:
                first.setdefault(line.strip(), (i, k))
    root = {x: x for x in first}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in first:
        for y in first:
            if x < y and line_dedup.within(x.encode(), y.encode(), 2):
                root[top(x)] = top(y)
    head = {}
    for x, at in first.items():
        head[top(x)] = min(head.get(top(x), at), at)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if len(x.strip()) < 24 or head[top(x.strip())] == (i, k)) for i, t in rows}
    got = {r.doc_id: r.kept_text for r in line_dedup.remove_repeated_lines(docs, small=small).collect()}
    assert got == want


def test_short_lines_that_repeat_go(spark, tmp_path):
    """Equal lines of any length keep the first only; short lines that are a letter apart, and blank ones, stay."""
    docs = spark.createDataFrame([(1, "Yes\n\nNo\nYes"), (2, " Yes \nNo!\n\nx"), (3, "x\nNo"), (4, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: "Yes\n\nNo", 2: "No!\n\nx", 3: "", 4: ""}
    assert {r.doc_id: r.kept_text for r in line_dedup.remove_repeated_lines(docs, short=True).collect()} == want
    found = {r.doc_id: (r.n_removed, r.kept_sha256) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {i: ({1: 1, 2: 1, 3: 2, 4: 0}[i], hashlib.sha256(t.encode()).hexdigest()) for i, t in want.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()} == {1: want[1], 2: want[2], 4: None}


def test_line_dedup_odd_rows(odd):
    rows = line_dedup.remove_repeated_lines(odd, carry=("size", "id")).collect()
    assert len(rows) == odd.count()
    assert {r.carried.c0 for r in rows} == {7}
    assert [r.n_removed for r in rows if r.doc_id == 1] == [0] and [r.n_lines for r in rows if r.doc_id == 3] == [0]
    assert sum(r.n_removed for r in rows if r.doc_id == 2) >= 2
    assert line_dedup.remove_repeated_lines(odd.limit(0)).count() == 0


def jaccard_groups(rows, words_each, percent):
    sets = {}
    for i, text in rows:
        words = text.encode().lower().split()
        grams = [tuple(words[k:k + words_each]) for k in range(len(words) - words_each + 1)] or ([tuple(words)] if words else [])
        sets[i] = set(grams)
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("small", [24, 2])
def test_near_dedup_against_brute_force(spark, small):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(6):
        base = draw.choices(words, k=90)
        for _ in range(14):
            copy = list(base)
            for _ in range(draw.randint(0, 9)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(200, None), (201, " "), (202, "one two"), (203, "one  TWO")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 3, 85, small=small).collect()}
    assert got == jaccard_groups([(i, t or "") for i, t in rows], 3, 85)


def test_near_dedup_odd_rows(odd):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id == 1 and not r.kept for r in rows if r.doc_id == 2)
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert all(r.kept and r.n_shingles == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (None, 4)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}}
