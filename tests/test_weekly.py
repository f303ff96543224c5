"""The weekly run end to end on planted reviews with disjoint vocabularies."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxloom.operators import embed, ledger as ledger_ops
from voxloom.plans.landed import run_landed
from voxloom.plans.weekly import run_weekly
from voxloom.schemas import EMBEDDING, PRODUCT, RUN_RECORD
from voxloom.settings import Settings
from voxloom.sources import feeds

TOPICS = {
    "login": ["cannot login password", "password login fails", "login screen password broken", "login password again"],
    "charts": ["charts lag slowly", "slow charts loading", "loading charts slow today", "charts freeze loading slow"]}


def planted(product, store):
    rows = []
    for i in range(24):
        topic = "login" if i % 2 else "charts"
        words = TOPICS[topic][(i // 2) % 4]
        body = f"{words} call 9876543210" if i == 3 else words
        rows.append((f"{product}-{i}", store, product, "Some One", i % 5 + 1, None, body,
                     dt.datetime(2026, 5, 1) + dt.timedelta(hours=i), "1", "en", len(body), i))
    rows.append((f"{product}-late", store, product, "x", 5, None, "after the window", dt.datetime(2026, 7, 1), "1", "en", 16, 90))
    rows.append((f"{product}-empty", store, product, "x", 5, None, "12 !!", dt.datetime(2026, 5, 2), "1", "en", 5, 91))
    return rows


@pytest.fixture(scope="module")
def result(spark):
    columns = ("id string, store string, product string, author string, rating int, title string, body string,"
               " date timestamp, version string, language string, raw_length int, seq long")
    reviews = spark.createDataFrame(planted("alpha", "playstore") + planted("beta", "appstore"), columns)
    products = spark.createDataFrame(
        [("alpha", "Alpha", "1", "com.a", "doc-a", "A", ["a@x.org"]), ("beta", "", "", "com.b", "doc-b", "B", []),
         ("gamma", "Gamma", "3", "com.c", "doc-c", "C", ["c@x.org"])], PRODUCT)
    published = spark.createDataFrame([("doc-c", "old text - Anchor ID: gamma-2026-W23 end")], "doc_id string, text string")
    encoder = lambda texts: [[float(t.count("login")), float(t.count("charts")), 0.01 * len(t)] for t in texts]
    return run_weekly(
        reviews, products, [(2026, 23)], spark.createDataFrame([], RUN_RECORD), published,
        spark.createDataFrame([], EMBEDDING), F.lit("2026-06-08 00:00:00").cast("timestamp"), 1, Settings(), encoder)


def test_published_run_is_skipped(result):
    assert {(r["product"], r["decision"]) for r in result.runs.collect()} == {("alpha", "run"), ("beta", "run")}


def test_reviews_are_cleaned(result):
    rows = result.reviews.collect()
    assert len(rows) == 24 and {r["product"] for r in rows} == {"alpha"}  # beta has no app-store id
    assert {r["author"] for r in rows} == {"[NAME]"}
    assert sum("[PHONE]" in r["body"] for r in rows) == 1 and not any("9876543210" in r["body"] for r in rows)


def test_reports(result):
    reports = {r["product"]: r for r in result.reports.collect()}
    assert set(reports) == {"alpha", "beta"}
    assert reports["beta"]["themes"] == [] and reports["beta"]["stats"]["total_reviews"] == 0
    alpha = reports["alpha"]
    assert alpha["stats"]["total_reviews"] == alpha["stats"]["playstore_reviews"] == 24
    assert alpha["themes"] and alpha["stats"]["quotes_validated"] == alpha["stats"]["quotes_proposed"] > 0
    for theme in alpha["themes"]:
        words = {w for t in TOPICS for text in TOPICS[t] for w in text.split()} | {"call", "phone"}
        assert set(theme["name"].lower().replace(",", "").split()) <= words
        assert all(q["validated"] and q["review_id"].startswith("alpha-") for q in theme["quotes"])
        assert all(len(a["title"]) <= 33 and a["title"].endswith("...") for a in theme["actions"])
    counts = [t["review_count"] for t in alpha["themes"]]
    assert counts == sorted(counts, reverse=True)


def test_payloads_and_records(result):
    mails = {r["product"]: r for r in result.payloads.collect()}
    assert "Alpha Review Pulse — Week 23" in mails["alpha"]["subject"] and "doc-a" in mails["alpha"]["text_body"]
    assert "beta Review Pulse" in mails["beta"]["subject"]
    assert mails["beta"]["blocks"][1]["text"] == "No significant themes discovered this week.\n"
    record = {r["product"]: r for r in result.records.collect()}["alpha"]
    assert record["status"] == "running" and record["reviews_fetched"]["total"] == 24
    assert record["llm_tokens"]["input"] > 0 and record["review_window"]["start"] == dt.datetime(2026, 3, 29)
    plan = {r["product"]: r for r in result.delivery.collect()}
    assert plan["alpha"]["doc_action"] == "append" and plan["alpha"]["recipients"] == "a@x.org"


def test_outcomes(spark, result):
    outcomes = spark.createDataFrame(
        [("alpha", 2026, 23, "Success", "Success (draft ID: abc )", "draft", False, False, "doc-a", ["a@x.org"]),
         ("beta", 2026, 23, "Error: no", "Skipped", "draft", False, False, "doc-b", [])],
        "product string, iso_year int, iso_week int, docs_delivery string, email_delivery string, mode string,"
        " dry_run boolean, crashed boolean, doc_id string, recipients array<string>")
    done = {r["product"]: r for r in ledger_ops.apply_outcomes(result.records, outcomes, F.current_timestamp()).collect()}
    assert done["alpha"]["status"] == "completed" and done["alpha"]["email_delivery"]["draft_id"] == "abc"
    assert done["alpha"]["doc_delivery"]["heading_id"] == "alpha-2026-W23"
    assert done["beta"]["status"] == "partial" and done["beta"]["completed_at"] is None


def _line(product, batch, pos, review_id, text, at, poll):
    return (product, "com.a", batch, pos, review_id, "Some One", text, "5", "1", at, poll)


def test_from_landed_feeds_to_a_run(spark, tmp_path):
    """Two polls, a missing store, a cut line and an unreadable file: the rest becomes a run."""
    rows = spark.createDataFrame(
        [_line("alpha", 0, i, f"r{i}", TOPICS["login" if i % 2 else "charts"][(i // 2) % 4], f"2026-05-01T{i:02d}:00:00", 0) for i in range(20)]
        + [_line("alpha", 0, 0, "r0", "charts lag slowly, mail a@b.org", "2026-05-01T00:00:00", 1), _line("alpha", 0, 1, "", "no id", "2026-05-01T00:00:00", 1)],
        "product string, app_id string, batch int, pos int, reviewId string, userName string, content string, score string, reviewCreatedVersion string,"
        " at string, poll int")
    rows.repartition(3).write.json(str(tmp_path / "play"))
    (tmp_path / "play" / "cut.json").write_text('{"product": "alpha", "content": "cut o')
    (tmp_path / "play" / "bad.json.gz").write_text("no archive")
    products = spark.createDataFrame([("alpha", "Alpha", "1", "com.a", "doc-a", "A", [])], PRODUCT)
    run, landed = run_landed(
        spark, str(tmp_path / "app"), str(tmp_path / "play"), products, [(2026, 23)], spark.createDataFrame([], RUN_RECORD),
        spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([], EMBEDDING),
        F.lit("2026-06-08 00:00:00").cast("timestamp"), 1, Settings(cost_alert_threshold_usd=-1.0))
    files = {r["file"].rsplit("/", 1)[-1].split("-")[0]: (r["ok"], r["error"]) for r in landed.files.where("source = 'playstore'").collect()}
    assert files["cut.json"] == (False, "broken lines") and files["bad.json.gz"] == (False, "not readable") and files["part"] == (True, None)
    assert [(r["ok"], r["error"]) for r in landed.files.where("source = 'appstore'").collect()] == [(False, "PATH_NOT_FOUND")]
    reviews = run.reviews.collect()
    assert len(reviews) == 20 and sum("[EMAIL]" in r["body"] for r in reviews) == 1
    assert run.reports.first()["stats"]["total_reviews"] == 20
    found = run.scrubbed.first()
    assert (found["product"], found["emails_scrubbed"] if "emails_scrubbed" in found else found[3], found["authors_anonymized"]) == ("alpha", 1, 20)
    assert [(r["product"], r["over_tokens"], r["over_cost"]) for r in run.alerts.collect()] == [("alpha", False, True)]


def test_expected_files(spark, tmp_path):
    """A manifest tells a file that has not landed and one that lacks rows."""
    from voxloom.schemas import SCRAPE_ROW
    for name, n in (("a.json", 2), ("b.json", 1)):
        (tmp_path / name).write_text('{"product": "p", "batch": 1}\n' * n)
    expected = spark.createDataFrame([(f"file:{tmp_path}/{f}", n) for f, n in (("a.json", 2), ("b.json", 5), ("c.json", 1))], "file string, rows long")
    rows, status = feeds.read_landed(spark, "play", str(tmp_path), SCRAPE_ROW, expected)
    got = {r["file"].rsplit("/", 1)[-1]: (r["ok"], r["error"], r["rows"]) for r in status.collect()}
    assert got == {"a.json": (True, None, 2), "b.json": (False, "rows missing", 1), "c.json": (False, "not landed", 0)}
    assert rows.count() == 3


def test_embedding_budget(spark):
    """Reviews without a vector are taken in batches until the budget is spent; those with one cost nothing."""
    rows = [("p", 2026, 1, i, f"r{i}", None, "x" * 40) for i in range(1, 11)]
    reviews = spark.createDataFrame(rows, "product string, iso_year int, iso_week int, pos int, id string, title string, body string")
    cache = spark.createDataFrame([("r1", [1.0], "m"), ("r9", [1.0], "m"), ("r2", [1.0], "other")], EMBEDDING)
    kept = embed.within_budget(reviews, cache, "m", 45, 2)
    assert kept.columns == reviews.columns
    assert sorted(r["id"] for r in kept.collect()) == ["r1", "r2", "r3", "r4", "r5", "r9"]
