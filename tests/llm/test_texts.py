"""Operators on single texts, pages, vectors and sources."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import decontamination, embedding_dedup, language_id, mixing, page_diff, toxicity
from voxloom.llm.html_text import common, lines


def test_language_of_held_out_documents(corpus):
    fold = language_id.remainder(F.col("doc_id"))
    found = language_id.predict(corpus, language_id.samples(corpus.where(fold != 1)))
    both = found.join(corpus.select("doc_id", "lang", fold.alias("fold")), "doc_id").where("fold = 1")
    right, rows = both.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows > 50 and right > 0.95
    assert both.where("score < 0 OR score > 1").count() == 0


@pytest.mark.parametrize("rare", ["a", "ok then", " ", "???"])
def test_a_language_with_a_tiny_sample_takes_no_texts(corpus, rare):
    fold = language_id.remainder(F.col("doc_id"))
    learned = language_id.samples(corpus.where(fold != 1)) | {"aa": [rare]}
    found = language_id.predict(corpus.where(fold == 1), learned).join(corpus.select("doc_id", "lang"), "doc_id")
    right, taken, n = found.where("lang IS NOT NULL AND lang_pred != 'und'").agg(
        F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.sum((F.col("lang_pred") == "aa").cast("int")), F.count("*")).first()
    assert n and right >= 0.97 and taken == 0


def test_samples_come_from_whole_texts(spark):
    """Documents that begin with one header of 600 characters do not teach the header alone."""
    docs = spark.createDataFrame([(i, "h" * 600 + "xyz " * 600, "en") for i in range(64)], "doc_id long, text string, lang string")
    texts = language_id.samples(docs)["en"]
    assert len(texts) == 64 and all(len(t) == 512 for t in texts) and sum("xyz" in t for t in texts) > 32


def test_language_odd_rows(odd):
    rows = language_id.predict(odd, {"en": ["the quick brown fox"], "fr": ["le renard brun"]}).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 10)} == {"und"}
    assert [r.lang_pred for r in rows if r.doc_id == 1] == ["en"]
    assert {r.lang_pred for r in language_id.predict(odd, {}).collect()} == {"und"}
    assert language_id.samples(odd.limit(0)) == {}


def test_phrases_are_longest_matches():
    """The automaton's walk parses as repeated longest substring search does."""
    draw = random.Random(2)
    sample = "".join(draw.choices("ab ", k=60))
    parser = language_id.Parser({"x": [sample], "y": ["".join(draw.choices("ab ", k=50))]})
    spelled = parser.symbols(sample)
    text = parser.symbols("".join(draw.choices("abc ", k=300)))
    known = {tuple(spelled[i:j]) for i in range(len(spelled)) for j in range(i + 1, len(spelled) + 1)}
    count = at = 0
    while at < len(text):
        n = 0
        while at + n < len(text) and tuple(text[at:at + n + 1]) in known:
            n += 1
        at += max(n, 1)
        count += 1
    walked = parser._walk(np.concatenate([text, np.zeros(4, np.uint8)]), np.array([0]), np.array([len(text)]))
    assert walked[0][0] == count


def test_toxic_documents_are_found(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = toxicity.fit(docs, toxicity.graded(docs, labels.where(half == 0)))
    assert list(model.thresholds) == sorted(model.thresholds)
    tested = toxicity.predict(docs, model).join(labels.where(half == 1), "doc_id")
    hit, clear = tested.select(F.avg(F.when(F.col("toxic") == 1, (F.col("p_toxic") >= 0.5).cast("int"))),
                               F.avg(F.when(F.col("toxic") == 0, (F.col("p_toxic") < 0.5).cast("int")))).first()
    assert hit > 0.75 and clear > 0.99


def test_more_toxic_labels_than_the_sample_keep_their_share(spark, monkeypatch):
    """240 toxic labels of 640, 40 of them fitted, and a clean row with the mark: the prior is that of all labels."""
    rows = [(i, f"garden tools and weather number{i}" + (" vileword" if i < 240 or i == 300 else "")) for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 240)) for i in range(640)] + [(i, 0) for i in range(240)], "doc_id long, toxic int")
    shares = []
    solve = toxicity._solve
    monkeypatch.setattr(toxicity, "_solve", lambda rows, target, share, width: shares.append(share) or solve(rows, target, share, width))
    model = toxicity.fit(docs, toxicity.graded(docs, labels, per_grade=40), per_grade=40)
    assert [(s[0], pytest.approx(sum(s[1:]))) for s in shares] == [(400, 240), (400, 240)]
    found = {r.doc_id: r.p_toxic for r in toxicity.predict(docs, model).collect()}
    assert all(found[i] > 0.5 for i in range(240)) and found[600] < 0.5


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (99, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, toxicity.graded(odd, labels))
    rows = toxicity.annotate(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["_p_toxic"] <= 1 and r["size"] == 7 for r in rows)
    assert toxicity.fit(odd, labels.limit(0).withColumnRenamed("toxic", "grade")) is None
    assert toxicity.predict(odd.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
<header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article class="post has-sidebar"><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>&nbsp;text<br>next<p>a &lt; b<div class="ad-slot">Buy
</div><aside>Related</aside><form><input>Send</form></article><section id="comments"><p>Nice!</p></section><footer>&copy; F</footer></body></html>"""


def test_markup_decides():
    assert [t for t, kind in lines(PAGE) if kind == 0] == ["Head & line", "First bold text", "next", "a < b"]
    assert lines("<article><p>cut off <b>here") == [("cut off here", 0)]
    assert lines("plain <i>text</i>") == [("plain text", 1)]
    assert lines("<script>x") == [] and lines("<!-- <p>x</p>") == []
    assert lines("<ul><li><a>One</a><li><a>Two</a></ul><p>Text</p>") == [("One", 2), ("Two", 2), ("Text", 1)]


@pytest.mark.parametrize("seed", range(20))
def test_common_is_a_longest_common_subsequence(seed):
    draw = random.Random(seed)
    one, two = (draw.choices(range(6), k=draw.randint(0, 30)) for _ in range(2))
    best = [[0] * (len(two) + 1) for _ in range(len(one) + 1)]
    for i, x in enumerate(one, 1):
        for j, y in enumerate(two, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    places = sorted(common(one, two))
    rest = iter(two)
    assert len(places) == best[-1][-1] and all(one[p] in rest for p in places)


def test_shared_lines_of_nearest_pages_go(spark):
    body = "<div>Top of site</div><div>Story {0} about {0}</div><div>Bottom of site</div>"
    rows = [(i, f"http://h.example/a/{i:03d}?q", body.format(i)) for i in range(150)] + [
        (900, "http://other.example/", body.format(900)), (901, None, body.format(901)), (902, "nonsense", None), (903, "http://e.example/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1))
    found = {r.page_id: r for r in page_diff.main_text(pages).collect()}
    assert all(found[i].text == f"Story {i} about {i}" and found[i].n_deleted == 2 for i in range(150))
    assert found[900].text == found[901].text.replace("901", "900") == "Top of site Story 900 about 900 Bottom of site"
    assert found[902].text == found[903].text == "" and found[902].n_chars == 0
    assert page_diff.main_text(pages.limit(0)).count() == 0


def kept(html):
    return [t for t, k in lines(html) if k in (0, 1)]


def test_wrappers_of_a_page_are_no_chrome():
    """A form or a class name around the whole page does not hide the article; inside an article only a name that says nothing else is a mark."""
    nav = "<nav><a href=x>Home</a></nav>"
    assert kept(f"<form id=aspnetForm>{nav}<article><p>The story.</p></article><footer>F</footer></form>") == ["The story."]
    assert kept(f"<div class='layout sidebar-right'>{nav}<main><p>The story.</p></main><aside>S</aside></div>") == ["The story."]
    assert kept("<article><p class='related-work'>Earlier work.</p><section class='comment-analysis'>Numbers.</section></article>") == ["Earlier work.", "Numbers."]
    assert kept("<article><p>A.</p><div class='related-posts'>R</div><ol class='comment-list'><li>C</li></ol><div class=ad>D</div></article>") == ["A."]
    assert kept("<article><p>A.</p></article><div class=comments><article>Nice!</article></div>") == ["A."]
    assert kept(f"<form>{nav}<p>All there is.</p><div class=sidebar>S</div></form>") == ["All there is."]
    assert kept("<form><p>Search</p></form><p>Text.</p>") == ["Text."]
    assert kept("<div class=sidebar><p>S</p></div>") == []


def test_copies_of_a_page_keep_their_text(spark):
    """Two pages with the same unmarked blocks keep them; a third of the template still tells what is shared."""
    menu, rows = "<p>Menu line</p>", []
    rows += [(i, "http://a.org/x", "<div><p>Same words.</p><p>More of them.</p></div>") for i in (1, 2)]
    rows += [(i, f"http://b.org/n/{1 if i < 5 else 2}", f"<div>{menu}<p>Story {min(i, 4)}.</p></div>") for i in (3, 4, 5)]
    rows += [(6, "http://c.org/1", "<div><p>One.</p></div>"), (7, "http://c.org/2", "<div><p>One.</p><p>Two.</p></div>")]
    found = {r.page_id: r.text for r in page_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == found[2] == "Same words. More of them."
    assert found[3] == "Story 3." and found[4].endswith("Story 4.") and found[6] == "One." and found[7] == "Two."


def test_articles_of_the_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = page_diff.main_text(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) > 0 and "<" not in r.text for r in rows)


def test_targets_are_filled_by_weight():
    assert mixing.fill([100, 100, 100], [1, 1, 1], 3) == [100, 100, 100]
    assert mixing.fill([10, 100, 190], [5, 2, 1], 3) == pytest.approx([30, 180, 90])
    assert mixing.fill([0, 10], [5, 2], 3) == [0, 10]
    draw = random.Random(1)
    for _ in range(50):
        sizes = [draw.randint(0, 1000) for _ in range(9)]
        targets = mixing.fill(sizes, [(5, 2, 1)[i % 3] for i in range(9)], 3)
        assert sum(targets) == pytest.approx(sum(sizes)) and all(t <= 3 * n + 1e-9 for t, n in zip(targets, sizes))


def test_mix_reads_its_targets_in_even_shares(spark, corpus):
    each, pieces = mixing.mix(corpus, block=64)
    rows = each.collect()
    assert len(rows) == corpus.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(v) - target) <= 0.5 for (_, target), v in by.items())
    slots = pieces.groupBy("slot", "source").agg(F.sum(F.col("stop") - F.col("start")).alias("n")).orderBy("slot").collect()
    half = slots[:len(slots) // 2]
    for (source, target), taken in by.items():
        assert abs(sum(r.n for r in half if r.source == source) - target / 2) <= 64 * 4
    assert sorted(r.taken for r in mixing.mix(corpus, block=64)[0].collect()) == sorted(r.taken for r in rows)


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd)[0].collect()
    assert len(rows) == odd.count() and {r.source for r in rows} == {"src1", None}
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(odd.limit(0))[0].count() == 0


def brute_alignment(item, words):
    best, row = 0, [0] * (len(words) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(words, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row = new
        best = max(best, *row)
    return best


@pytest.mark.parametrize("seed", range(15))
def test_alignment_score(seed):
    draw = np.random.default_rng(seed)
    item, words = draw.integers(0, 5, 12), draw.integers(0, 5, 40)
    score, start, end = decontamination.smith_waterman(item, words)
    assert score == brute_alignment(item.tolist(), words.tolist()) == brute_alignment(item.tolist(), words[start:end].tolist())


def test_leaks_exact_edited_and_clean(spark, odd):
    draw = random.Random(4)
    words = [f"term{i}" for i in range(2000)]
    items = [(i, " ".join(draw.choices(words, k=30))) for i in range(8)] + [(8, None), (9, "too short"), (None, "x y z w v")]
    rows = [(i, " ".join(draw.choices(words, k=120))) for i in range(30)]
    rows[3] = (3, rows[3][1] + " " + items[2][1].upper() + " " + rows[4][1])
    edited = items[5][1].split()
    edited[4], edited[15:16] = "changed", ["two", "more"]
    rows[7] = (7, rows[7][1] + ". " + ", ".join(edited))
    rows[9] = (9, items[1][1] + " " + items[1][1])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert set(found) == {(3, 2), (7, 5), (9, 1)}
    assert found[3, 2].score == 1 and (found[3, 2].start, found[3, 2].end) == (120, 150) and 0.7 < found[7, 5].score < 1
    assert decontamination.leaks(odd, benchmark).count() == 0
    assert decontamination.leaks(odd, benchmark.limit(0)).count() == 0 and decontamination.leaks(odd.limit(0), benchmark).count() == 0


def test_edited_copies_beside_an_exact_one_are_found(spark):
    """1,000 copies with every tenth word changed, and one exact copy whose n-grams the edits break."""
    item = [f"term{i}" for i in range(40)]
    edited = [f"other{i}" if i % 10 == 5 else w for i, w in enumerate(item)]
    rows = [(0, " ".join(item))] + [(i, f"page {i} says " + " ".join(edited)) for i in range(1, 1001)] + [(2000, " ".join(item[:4]) + " and no more")]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: r.score for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert set(found) == set(range(1001)) and found[0] == 1
    assert all(found[i] == pytest.approx((36 * 2 - 4) / 80) for i in range(1, 1001))


def edited(draw, item, rate, period):
    """An item with words changed, left out or added: every `period`-th one, or each with probability `rate`."""
    out = []
    for i, w in enumerate(item):
        if (i % period == period - 1) if period else draw.random() < rate:
            out += draw.choice([[f"new{draw.randrange(10**9)}"], [], [w, f"new{draw.randrange(10**9)}"]]) if rate else [f"new{i}"]
        else:
            out.append(w)
    return out


def test_leaks_against_all_items_times_all_documents(spark):
    """Every pair whose alignment reaches the limit is found, by the rate of edits; items share frequent words, and a phrase is in all documents."""
    draw = random.Random(12)
    common = [f"the{i}" for i in range(12)]
    items = [[draw.choice(common) if draw.random() < 0.4 else f"w{draw.randrange(3000)}" for _ in range(draw.randrange(16, 60))] for _ in range(24)]
    cases = [(0, 1), (0, 2), (0.1, 0), (0.2, 0), (0.3, 0), (0, 3), (0, 4), (0, 5), (0.4, 0)]
    docs, case = [], []
    for rate, period in cases:
        for i, item in enumerate(items):
            around = [[draw.choice(common) if draw.random() < 0.4 else f"w{draw.randrange(3000)}" for _ in range(40)] for _ in range(2)]
            docs.append([*common[:8], *around[0], *edited(draw, item, rate, period), *around[1]])
            case.append((rate, period))
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(
        spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()}
    number = {w: n for n, w in enumerate(sorted({w for x in docs + items for w in x}))}
    coded = [[np.array([number[w] for w in x]) for x in kind] for kind in (docs, items)]
    want = {}
    for d, words in enumerate(coded[0]):
        for i, item in enumerate(coded[1]):
            score = decontamination.smith_waterman(item, words)[0] / (2 * len(item))
            if score >= 0.5:
                want[d, i] = score
    assert found.keys() <= want.keys() and all(found[k] == pytest.approx(want[k]) for k in found)
    for c in cases:
        asked = [k for k in want if case[k[0]] == c]
        kept = sum(k in found for k in asked)
        print(c, kept, len(asked))
        assert kept == len(asked), c


def test_one_long_item_does_not_widen_the_passages_of_others(spark):
    items = spark.createDataFrame([(1, " ".join(f"s{i}" for i in range(16))), (2, " ".join(f"l{i}" for i in range(5000)))], "item_id long, text string")
    text = " ".join([*(f"x{i}" for i in range(3000)), *(f"s{i}" for i in range(16)), *(f"y{i}" for i in range(3000))])
    grams = items.limit(0)  # no items, no filter
    assert decontamination.leaks(items.select(F.col("item_id").alias("doc_id"), "text"), grams).count() == 0
    found = decontamination.leaks(spark.createDataFrame([(5, text)], "doc_id long, text string"), items).collect()
    assert [(r.doc_id, r.item_id, r.score, r.start, r.end) for r in found] == [(5, 1, 1.0, 3000, 3016)]


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(12, 20))
    rows = [(i, [float(x) for x in base[i % 12] * draw.uniform(0.5, 3) + draw.normal(size=20) * draw.choice([0.1, 0.3, 0.5])], int(i % 12 % 3)) for i in range(120)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(10)]
    odd = [(300, None, 1), (301, [0.0] * 20, 1), (302, [float("nan")] * 20, 1), (303, [1.0, None], 1), (304, rows[0][1], None), (305, [], 0),
           (306, [1e300, 1e300], 1), (307, [2e300, 2e300], 1), (308, [float("inf"), 1.0], 1), (None, rows[0][1], rows[0][2])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("tile", F.lit("x"))
    n, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, v, a in rows:
        for j, w, b in rows:
            if i < j and a == b and float(np.dot(v, w)) / math.sqrt(float(np.dot(v, v)) * float(np.dot(w, w))) >= 0.93:
                n[i] += 1
                n[j] += 1
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors).collect()}
    assert sum(n.values()) > 100
    assert {i: got[i] for i in n} == {i: (n[i], top(i), top(i) == i) for i in n}
    assert got[306] == (1, 306, True) and got[307] == (1, 306, False) and got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (300, 301, 302, 303, 304, 305, 308))
    assert embedding_dedup.near_vectors(vectors.limit(0)).count() == 0
