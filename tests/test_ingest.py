"""Feeds, normalisation, dedup, caps, windows, storage."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import ingest, normalise
from voxloom.schemas import PRODUCT, RAW_PAGE, REVIEW, SCRAPE_ROW
from voxloom.session import scratch_path
from voxloom.settings import Settings
from voxloom.sources import feeds, registry, review_store


def entry(i, **other):
    label = lambda v: {"label": v}
    made = {"id": label(str(i)), "author": {"name": label(f"user {i}")}, "title": label("t"), "content": label(f"body {i}"),
            "im:rating": label("4"), "im:version": label("1.2"), "updated": label("2026-06-01T10:00:00-07:00")}
    made.update({k: label(v) for k, v in other.items()})
    return made


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        ("p", "app", 1, json.dumps({"feed": {"entry": [entry(1), entry(2, **{"im:rating": "77"})]}})),
        ("p", "app", 2, json.dumps({"feed": {"entry": entry(3)}})), ("p", "app", 3, json.dumps({"feed": {}})),
        ("p", "app", 4, json.dumps({"feed": {"entry": [{"id": {"label": "bare"}}, entry(4, updated="soon"),
                                                       entry(5, **{"im:rating": "good"})]}})),
        ("p", "app", 5, '{"feed": {"entry": [{"id"'), ("p", "app", 6, json.dumps({"feed": {"entry": [entry(6)]}})),
        ("p", "app", 11, json.dumps({"feed": {"entry": [entry(7)]}}))]
    path = scratch_path(spark, "pages")
    spark.createDataFrame(rows, RAW_PAGE).write.json(path)
    return feeds.read_pages(spark, path)


def test_pages(pages):
    rows = feeds.scan_appstore_pages(pages, max_pages=10).select("page", "pos", F.col("entry.id.label").alias("id")).collect()
    assert sorted((r["page"], r["pos"], r["id"]) for r in rows) == [
        (1, 0, "1"), (1, 1, "2"), (2, 0, "3"), (4, 0, "bare"), (4, 1, "4"), (4, 2, "5"), (6, 0, "6")]
    good = {r["body"]: r for r in normalise.normalize_appstore(feeds.scan_appstore_pages(pages, max_pages=10)).collect()}
    assert set(good) == {"body 1", "body 2", "body 3", "body 6"}
    assert good["body 2"]["rating"] == 5 and good["body 1"]["date"] == dt.datetime(2026, 6, 1, 17)
    assert good["body 1"]["seq"] < good["body 2"]["seq"] < good["body 3"]["seq"]


def test_pages_after_a_failure_are_dropped(pages):
    assert sorted(r["page"] for r in feeds.drop_after_failure(pages).collect()) == [1, 2, 3, 4]
    status = feeds.page_status(pages).first()
    assert (status["pages"], status["usable"], status["failed_page"]) == (7, 6, 5)


def test_missing_source_counts_as_empty(spark):
    rows, status = feeds.read_or_empty(
        spark, "playstore", SCRAPE_ROW, lambda: feeds.read_batches(spark, "/nowhere/at/all"))
    assert rows.count() == 0 and not status.first()["ok"] and status.first()["error"]


def test_playstore_rows(spark):
    rows = [("g1", "Jo", "fine", "3", "2.0", "2026-06-01 10:00:00"), ("g2", None, None, None, None, "2026-06-01T10:00:00Z"),
            ("", "Jo", "x", "3", None, "2026-06-01"), ("g3", "Jo", "x", "3", None, "soon"), (None, "Jo", "x", "3", None, "2026-06-01"),
            ("g4", "Jo", "x", "a lot", None, "2026-06-01"), ("g5", "Jo", "😀", "9", None, "2026-06-01T00:00:00+05:30")]
    raw = spark.createDataFrame([("p", "com.p", 0, i, *r) for i, r in enumerate(rows)], SCRAPE_ROW)
    got = {r["seq"]: r for r in normalise.normalize_playstore(raw).collect()}
    assert set(got) == {0, 1, 6}
    assert (got[1]["author"], got[1]["body"], got[1]["rating"], got[1]["title"]) == ("Unknown", "", 1, None)
    assert got[6]["rating"] == 5 and got[6]["raw_length"] == 1 and got[6]["date"] == dt.datetime(2026, 5, 31, 18, 30)


def test_quarantine(spark):
    ok = ("i", "appstore", "p", "a", 3, None, "b", dt.datetime(2026, 1, 1), None, "en", 1)
    bad = [ok[:4] + (0,) + ok[5:], ok[:1] + ("web",) + ok[2:], ok[:6] + (None,) + ok[7:], ok[:7] + (None,) + ok[8:],
           (None,) + ok[1:], ok[:10] + (-1,)]
    valid, rejected = normalise.quarantine_invalid(spark.createDataFrame([ok, *bad], REVIEW))
    assert valid.count() == 1
    assert sorted(r["reason"] for r in rejected.collect()) == sorted([
        "rating out of range", "unknown store", "no body", "no date", "no id", "negative length"])


SLIM = "product string, store string, id string, date timestamp, seq long, body string"
NOW = dt.datetime(2026, 6, 5)


def test_dedupe_keeps_last_value_and_first_place(spark):
    rng = random.Random(4)
    rows = [("p", "appstore", f"r{rng.randrange(30) if i % 3 else 0}", NOW, i, f"v{i}") for i in range(400)]
    frame = spark.createDataFrame(rows, SLIM).repartition(5)
    want = {}
    for r in rows:
        first = want[r[2]][1] if r[2] in want else r[4]
        want[r[2]] = (r[5], first)
    once = ingest.dedupe_last_wins(frame)
    assert {r["id"]: (r["body"], r["seq"]) for r in once.collect()} == want
    assert ingest.dedupe_last_wins(once).exceptAll(once).count() == 0


def test_union_keeps_source_order(spark):
    row = lambda store, i: ("p", store, i, NOW, 5, "b")
    both = ingest.union_sources(spark.createDataFrame([row("appstore", "a")], SLIM),
                                spark.createDataFrame([row("playstore", "a")], SLIM))
    assert ingest.dedupe_last_wins(both).first()["store"] == "playstore"


def brute_run(rows, week, settings):
    """The same steps for one product and week on plain lists."""
    sunday = dt.date.fromisocalendar(*week, 7)
    start = dt.datetime.combine(sunday - dt.timedelta(weeks=settings.review_window_weeks), dt.time())
    end = dt.datetime.combine(sunday + dt.timedelta(days=1), dt.time())
    by_id = {}
    for store in ("appstore", "playstore"):
        fed = [r for r in rows if r[1] == store and r[3] >= start and (not settings.cap_after_end or r[3] < end)]
        for r in fed[:settings.max_reviews_per_product]:
            by_id[r[2]] = r
    merged = sorted(by_id.values(), key=lambda r: r[3], reverse=True)[:settings.max_reviews_per_product]
    return [r[2] for r in merged if r[3] < end]


@pytest.mark.parametrize("cap_after_end", [False, True])
def test_runs_equal_the_list_version(spark, cap_after_end):
    rng = random.Random(6)
    rows = []
    for product in ("p", "q"):
        for store in ("appstore", "playstore"):
            for _ in range(60):
                rows.append((product, store, f"{product}{rng.randrange(90)}",
                             NOW - dt.timedelta(hours=rng.randrange(24 * 120)) + dt.timedelta(days=20), len(rows), "b"))
    settings = Settings(max_reviews_per_product=25, cap_after_end=cap_after_end)
    listed = [(2026, 18), (2026, 23), (2026, 25)]
    chosen = ingest.select_run_rows(spark.createDataFrame(rows, SLIM).repartition(3), listed, settings).collect()
    got = {}
    for r in sorted(chosen, key=lambda r: r["pos"]):
        got.setdefault((r["product"], r["iso_year"], r["iso_week"]), []).append(r["id"])
    for product in ("p", "q"):
        for week in listed:
            want = brute_run([r for r in rows if r[0] == product], week, settings)
            assert got.get((product, *week), []) == want


def test_ingest_cleans_kept_rows(spark):
    columns = ("id", "store", "product", "author", "rating", "title", "body", "date", "version", "language", "raw_length", "seq")
    row = lambda i, body, day: (f"r{i}", "playstore", "p", "Jo", 5, None, body, dt.datetime(2026, 6, day), None, "en", 1, i)
    reviews = spark.createDataFrame(
        [row(1, "ring 9812345678", 1), row(2, "12 !!", 2), row(3, "9812345678", 3), row(4, "too new", 9), row(5, "old", 4)],
        ", ".join(f"`{c}` {t}" for c, t in zip(columns, ("string", "string", "string", "string", "int", "string", "string",
                                                         "timestamp", "string", "string", "int", "long"))))
    rows = sorted(ingest.ingest_runs(reviews, [(2026, 23)]).collect(), key=lambda r: r["pos"])
    assert [(r["id"], r["body"], r["author"]) for r in rows] == [
        ("r5", "old", "[NAME]"), ("r3", "[PHONE]", "[NAME]"), ("r1", "ring [PHONE]", "[NAME]")]


def test_products(spark, tmp_path):
    listed = {"products": [
        {"slug": "b", "display_name": "Old"}, {"slug": "a", "display_name": "A", "appstore_id": "1", "stakeholder_emails": ["x"]},
        {"slug": "b", "display_name": "B", "playstore_id": "com.b"}]}
    (tmp_path / "products.json").write_text(json.dumps(listed, indent=2))
    products = registry.scan_products(spark, str(tmp_path / "products.json"))
    got = {r["slug"]: r for r in products.collect()}
    assert got["b"]["display_name"] == "B" and got["b"]["appstore_id"] == "" and got["b"]["stakeholder_emails"] == []
    ask = lambda *slugs: spark.createDataFrame([(s,) for s in slugs], "slug string")
    assert registry.require_products(ask("a"), products).count() == 1
    with pytest.raises(KeyError, match="Available: a, b"):
        registry.require_products(ask("a", "zz"), products)
    rows = spark.createDataFrame([("a", "appstore"), ("a", "playstore"), ("b", "appstore"), ("b", "playstore")],
                                 "product string, store string")
    kept = {tuple(r) for r in ingest.source_configured(rows, products).select("product", "store").collect()}
    assert kept == {("a", "appstore"), ("b", "playstore")}


def test_grid_has_every_product_and_week(spark):
    products = spark.createDataFrame([("a", "A", "", "", "d", "", []), ("b", "B", "", "", "d", "", [])], PRODUCT)
    grid = ingest.run_grid(products, [(2026, 1), (2025, 52)])
    assert grid.count() == 4 and "CartesianProduct" not in grid._jdf.queryExecution().executedPlan().toString()
    week = grid.where("product = 'a' AND iso_year = 2026").first()
    assert week["window_end"] == dt.date(2026, 1, 4) and week["window_start"] == dt.date(2025, 10, 26)


def test_reads_skip_what_is_before_the_window(spark):
    path = scratch_path(spark, "days")
    rows = [("p", f"r{i}", dt.datetime(2026, 6, 1) + dt.timedelta(hours=6 * i)) for i in range(60)]
    review_store.write_by_day(spark.createDataFrame(rows, "product string, id string, date timestamp"), path)
    recent = review_store.read_since(spark, path, dt.datetime(2026, 6, 10, 12))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(review_date" in plan and "GreaterThanOrEqual(date" in plan
    assert recent.count() == sum(r[2] >= dt.datetime(2026, 6, 10, 12) for r in rows)


def test_dump_is_reloaded(spark, tmp_path):
    rows = [{"id": "x", "store": "playstore", "product": "p", "author": "[NAME]", "rating": 5, "title": None, "body": "good",
             "date": "2026-06-20T23:24:39Z", "version": "1.8", "language": "en", "raw_length": 4}]
    (tmp_path / "dump.json").write_text(json.dumps(rows, indent=2))
    row = review_store.scan_review_dump(spark, str(tmp_path / "dump.json")).first()
    assert row["date"] == dt.datetime(2026, 6, 20, 23, 24, 39) and row["rating"] == 5


def test_caps_are_applied_before_the_shuffle(spark):
    rows = spark.createDataFrame([("p", "appstore", str(i), NOW, i, "b") for i in range(50)], SLIM)
    capped = ingest.cap_per_product(rows, 5, ("product",))
    assert capped._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert sorted(r["id"] for r in capped.collect()) == ["0", "1", "2", "3", "4"]


def test_newest_per_window_equals_capping_all_rows(spark):
    from voxloom.functions.weeks import assign_windows
    rng = random.Random(8)
    rows = [("hot" if i % 4 else "q", "appstore", str(i), NOW + dt.timedelta(hours=rng.randrange(24 * 30)), i, "b")
            for i in range(800)]
    frame = spark.createDataFrame(rows, SLIM).repartition(4)
    thinned = ingest.newest_per_window(frame, 7).select("product", "iso_year", "iso_week", "id", "pos")
    plain = ingest.cap_per_product(assign_windows(frame), 7).select("product", "iso_year", "iso_week", "id", "pos")
    assert thinned.count() == plain.count() and plain.exceptAll(thinned).count() == 0


def test_the_later_poll_of_a_place_wins(spark):
    """Two polls hold one review in the same place, edited in between."""
    def entry(text):
        label = lambda v: {"label": v}
        return {"id": label("7"), "author": {"name": label("A")}, "title": label("t"), "content": label(text),
                "im:rating": label("4"), "im:version": label("1"), "updated": label("2026-06-01T10:00:00-07:00")}

    rows = [("p", "1", 1, json.dumps({"feed": {"entry": [entry(text)]}}), poll) for poll, text in ((1, "before"), (2, "after"))]
    pages = spark.createDataFrame(rows, "product string, app_id string, page int, payload string, poll int")
    reviews = normalise.normalize_appstore(feeds.scan_appstore_pages(pages))
    assert reviews.select("seq").distinct().count() == 2
    assert [r["body"] for r in ingest.dedupe_last_wins(reviews).collect()] == ["after"]


@pytest.mark.parametrize("inside", [False, True])
def test_thinned_candidates_leave_every_run_as_it_is(spark, inside):
    """A hot product and a quiet one, weeks out of order with gaps, rows before all windows; equal to every run on its own."""
    draw = random.Random(9)
    first = dt.date(2025, 1, 1)
    rows = []
    for i, seq in enumerate(draw.sample(range(5000), 1200)):
        day = first + dt.timedelta(days=draw.randrange(420))
        rows.append(("hot" if i % 12 else "quiet", draw.choice(["appstore", "playstore"]), f"r{i % 1100}", dt.datetime(day.year, day.month, day.day, 12), seq))
    weeks = [(2026, 2), (2025, 30), (2025, 31), (2025, 52), (2025, 12)]
    settings = Settings(max_reviews_per_product=25, cap_after_end=inside)
    reviews = spark.createDataFrame(rows, "product string, store string, id string, date timestamp, seq long")
    thin = ingest.thin_candidates(reviews, weeks, settings)
    assert thin.columns == reviews.columns
    kept = ingest.candidate_runs(thin, weeks, settings)
    assert kept.count() <= 4 * len(weeks) ** 2 * 25 and kept.count() < ingest.candidate_runs(reviews, weeks, settings).count()
    found = {}
    for r in ingest.cap_per_store(kept, 25).collect():
        found.setdefault((r.product, r.store, r.iso_year, r.iso_week), set()).add(r.seq)
    want = {}
    for y, w in weeks:
        end = dt.date.fromisocalendar(y, w, 7)
        start = end - dt.timedelta(weeks=settings.review_window_weeks)
        for product, store in {r[:2] for r in rows}:
            own = sorted(r[4] for r in rows if r[:2] == (product, store) and r[3].date() >= start and (not inside or r[3].date() <= end))
            if own:
                want[product, store, y, w] = set(own[:25])
    assert found == want
