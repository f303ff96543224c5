"""Records, decisions, delivery, history and the versioned store."""

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from voxloom.operators import ledger as ops, readside
from voxloom.schemas import PRODUCT, REPORT, RUN_KEY, RUN_RECORD
from voxloom.session import scratch_path
from voxloom.sources import ledger_store


def record(product, week, status="completed", seq=1, started=None, **other):
    made = dict.fromkeys(RUN_RECORD.names)
    made.update(run_id=f"{product}-{week}-{seq}", product=product, iso_year=2026, iso_week=week, status=status, update_seq=seq,
                started_at=started or dt.datetime(2026, 1, 1) + dt.timedelta(days=week, seconds=seq))
    made.update(other)
    return tuple(made[c] for c in RUN_RECORD.names)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RUN_RECORD)


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(
        [("p1", "One", "1", "c1", "d1", "", ["a@x.org", "b@x.org"]), ("p2", "Two", "2", "c2", "d2", "", []),
         ("p10", "Ten", "3", "c3", "d1", "", [])], PRODUCT)


def grid(spark, products, weeks=(23, 24)):
    from voxloom.operators.ingest import run_grid
    return run_grid(products, [(2026, w) for w in weeks])


def test_upsert_and_lookup(spark):
    old = frame(spark, record("p1", 23, "running", 1), record("p2", 23, "failed", 2))
    merged = ops.ledger_upsert(old, frame(spark, record("p1", 23, "completed", 3), record("p1", 24, "partial", 4)))
    got = {(r["product"], r["iso_week"]): r["status"] for r in merged.collect()}
    assert got == {("p1", 23): "completed", ("p2", 23): "failed", ("p1", 24): "partial"}
    assert ops.ledger_get_key(merged, "p1:2026:W24").first()["status"] == "partial"
    assert ops.ledger_get(merged, "p1", 2026, 25).isEmpty()


def test_store(spark):
    path = scratch_path(spark, "ledger")
    assert ledger_store.load_ledger(spark, path).count() == 0
    assert ledger_store.save_records(spark, path, frame(spark, record("p1", 23, "running", 1))) == 1
    assert ledger_store.save_records(spark, path, frame(spark, record("p1", 23, "completed", 2), record("p2", 1, seq=3))) == 2
    got = {r["product"]: r["status"] for r in ledger_store.load_ledger(spark, path).collect()}
    assert got == {"p1": "completed", "p2": "completed"}


def test_corrupt_store_counts_as_empty(spark, tmp_path):
    folder = tmp_path / "ledger" / "v00000001"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_text("not parquet")
    (folder / "_SUCCESS").write_text("")
    assert ledger_store.load_ledger(spark, str(tmp_path / "ledger")).count() == 0


def test_unfinished_version_is_not_seen(spark):
    path = scratch_path(spark, "ledger")
    ledger_store.save_records(spark, path, frame(spark, record("p1", 23, seq=1)))
    frame(spark, record("p2", 23)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/v00000002")
    assert [r["product"] for r in ledger_store.load_ledger(spark, path).collect()] == ["p1"]


def test_two_savers_lose_nothing(spark, monkeypatch):
    """A saves between the load and the save of B: B merges again into what A wrote."""
    path = scratch_path(spark, "ledger")
    ledger_store.save_records(spark, path, frame(spark, *[record("p0", w, seq=w) for w in range(1, 20)]))
    merge, turns = ledger_store.ledger_upsert, []

    def merge_late(known, records):
        merged = merge(known, records)
        turns.append(1)
        if len(turns) == 1:
            ledger_store.save_records(spark, path, frame(spark, *[record("p1", w, seq=100 + w) for w in range(1, 21)]))
        return merged

    monkeypatch.setattr(ledger_store, "ledger_upsert", merge_late)
    assert ledger_store.save_records(spark, path, frame(spark, *[record("p2", w, seq=200 + w) for w in range(1, 21)])) == 3
    assert len(turns) == 3 and ledger_store.load_ledger(spark, path).count() == 59


def test_savers_at_once(spark):
    path = scratch_path(spark, "ledger")
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda n: ledger_store.save_records(spark, path, frame(spark, record(f"p{n}", 1, seq=n))), range(8)))
    assert sorted(versions) == list(range(1, 9))
    assert {r["product"] for r in ledger_store.load_ledger(spark, path).collect()} == {f"p{n}" for n in range(8)}


def test_stale_save_is_refused(spark):
    path = scratch_path(spark, "ledger")
    base, known = ledger_store.load_version(spark, path)
    assert ledger_store.save_ledger(frame(spark, record("p1", 1)), path, base) == 1
    with pytest.raises(ledger_store.StaleLedger):
        ledger_store.save_ledger(known, path, base)
    assert ledger_store.load_ledger(spark, path).count() == 1


def test_dead_savers_block_nobody(spark, tmp_path):
    """A claim or an unfinished version of a saver that died; what it left aside goes when it is old."""
    path = tmp_path / "ledger"
    ledger_store.save_records(spark, str(path), frame(spark, record("p1", 1)))
    (path / "claim-00000002").write_text("")
    (path / "v00000002").mkdir()
    (path / "v00000002" / "part-0.parquet").write_text("half")
    for left in (".aside-1000-x", f".aside-{int(time.time())}-y"):
        (path / left).mkdir()
    assert ledger_store.save_records(spark, str(path), frame(spark, record("p2", 1, seq=2))) == 3
    assert {r["product"] for r in ledger_store.load_ledger(spark, str(path)).collect()} == {"p1", "p2"}
    assert [p.name[-1] for p in path.iterdir() if p.name.startswith(".aside")] == ["y"]


def test_a_damaged_version_falls_back(spark, tmp_path):
    path = tmp_path / "ledger"
    for n in (1, 2):
        ledger_store.save_records(spark, str(path), frame(spark, record(f"p{n}", 1, seq=n)))
    for file in (path / "v00000002").glob("*.parquet"):
        file.write_bytes(file.read_bytes()[:100])
    for crc in (path / "v00000002").glob(".*.crc"):
        crc.unlink()
    assert [r["product"] for r in ledger_store.load_ledger(spark, str(path)).collect()] == ["p1"]
    assert ledger_store.save_records(spark, str(path), frame(spark, record("p3", 1, seq=3))) == 3
    assert {r["product"] for r in ledger_store.load_ledger(spark, str(path)).collect()} == {"p1", "p3"}


def test_mailed_runs_are_not_mailed_again(spark, products):
    mailed = record("p1", 23, "partial", email_delivery=("d1", None, [], "draft", None))
    plan = ops.delivery_plan(grid(spark, products), spark.createDataFrame([], "doc_id string, text string"), products, "draft",
                             frame(spark, mailed, record("p1", 24, "partial")))
    got = {(r["product"], r["iso_week"]): r["email_action"] for r in plan.collect()}
    assert got[("p1", 23)] == "skip" and got[("p1", 24)] == got[("p2", 23)] == "draft"


def test_only_pieces_of_texts_are_exchanged(spark, products):
    """No text is above the first exchange, and slugs of any length and place are found."""
    published = spark.createDataFrame(
        [("d1", "p1-2026-W23"), ("d1", "a p10-2026-W24p1-2026-W24"), ("d2", None), ("", "p2-2026-W23"), ("d2", "-2026-W23")], "doc_id string, text string")
    rows = ops.anchor_exists(grid(spark, products), published, products)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line]
    assert joined and not any("text#" in line for line in joined)
    assert {(r["product"], r["iso_week"]) for r in rows.where("delivered").collect()} == {("p1", 23), ("p1", 24), ("p10", 24)}


def test_decisions(spark, products):
    known = frame(spark, record("p1", 23, "completed"), record("p1", 24, "partial"), record("p2", 23, "running"),
                  record("p2", 24, "failed"))
    published = spark.createDataFrame(
        [("d1", "head"), ("d1", "x - Anchor ID: p10-2026-W23\n---"), ("d2", "p2-2026-W24")], "doc_id string, text string")
    rows = ops.idempotency_decision(grid(spark, products), known, published, products)
    got = {(r["product"], r["iso_week"]): r["decision"] for r in rows.collect()}
    assert got == {("p1", 23): "skip", ("p1", 24): "resume", ("p2", 23): "resume", ("p2", 24): "run", ("p10", 23): "skip",
                   ("p10", 24): "run"}
    pending = {(r["product"], r["iso_week"]): (r["doc_pending"], r["email_pending"])
               for r in ops.pending_channels(rows.drop("status"), known).collect()}
    assert pending[("p1", 23)] == (False, False) and pending[("p1", 24)] == (True, True)
    assert pending[("p2", 24)] == (False, True)


def test_anchors_are_substrings(spark, products):
    """An anchor counts wherever it occurs, also inside a longer word or next to another one."""
    text = "xp1-2026-W239 and p1-2026-W24-2026-W25; p1-2026-w26"
    published = spark.createDataFrame([("d1", text)], "doc_id string, text string")
    rows = ops.anchor_exists(grid(spark, products, range(20, 30)), published, products)
    got = {(r["product"], r["iso_week"]) for r in rows.where("delivered").collect()}
    want = {(p, w) for p in ("p1", "p10") for w in range(20, 30) if f"{p}-2026-W{w}" in text}
    assert got == want and want


def test_plan_and_status(spark, products):
    published = spark.createDataFrame([("d1", "p1-2026-W23")], "doc_id string, text string")
    plan = {(r["product"], r["iso_week"]): r for r in ops.delivery_plan(
        grid(spark, products), published, products, "none").collect()}
    assert plan[("p1", 23)]["doc_action"] == "skip" and plan[("p1", 24)]["doc_action"] == "append"
    assert plan[("p1", 23)]["recipients"] == "a@x.org, b@x.org" and plan[("p2", 23)]["email_action"] == "skip"
    rows = spark.createDataFrame(
        [("Success", "Success (draft ID: x1)", False, False), ("Error: a", "Success", False, False),
         ("Success", "Error: b", False, False), ("Success", "Skipped", False, True), (None, None, True, False)],
        "d string, e string, dry boolean, crash boolean")
    status = ops.run_status(F.col("d"), F.col("e"), F.col("dry"), F.col("crash"))
    assert [r[0] for r in rows.coalesce(1).select(status).collect()] == [
        "completed", "partial", "partial", "failed", "completed"]


def test_history(spark):
    same = dt.datetime(2026, 5, 5)
    rows = frame(spark, record("p1", 1), record("p1", 2, "partial"), record("p2", 3, "failed"), record("p2", 4, "running"),
                 record("p1", 5, "partial", started=same), record("p2", 5, "partial", started=same))
    assert [r["iso_week"] for r in ops.run_history(rows, "p1", 2).collect()] == [5, 2]
    assert [r["run_id"] for r in ops.failed_runs(rows, 2).collect()] == ["p1-5-1", "p2-5-1"]
    whole = {(r["product"], r["iso_week"]): r["run_no"] for r in ops.runs_by_product(rows).collect()}
    assert whole == {("p1", 5): 1, ("p1", 2): 2, ("p1", 1): 3, ("p2", 5): 1, ("p2", 4): 2, ("p2", 3): 3}
    assert ops.runs_by_product(rows, 1).count() == 2


@pytest.mark.parametrize("status,severity,code", [
    ("failed", "critical", 2), ("partial", "warning", 0), ("running", "info", 0), ("completed", "ok", 0), ("odd", "unknown", 3)])
def test_health(spark, status, severity, code):
    row = ops.latest_run_health(frame(spark, record("p", 9, status), record("p", 8, "completed"))).first()
    assert (row["run_id"], row["severity"], row["exit_code"]) == ("p-9-1", severity, code)


def test_health_without_runs(spark):
    row = ops.latest_run_health(frame(spark)).first()
    assert (row["severity"], row["exit_code"]) == ("healthy", 0)


def test_overview_and_audit(spark):
    rows = frame(spark, record("p", 1, themes_generated=2, quotes_validated=5, reviews_fetched=(1, 2, 3)),
                 record("p", 2, "failed", themes_generated=9), record("p", 3, "partial", themes_generated=1,
                                                                      email_delivery=(None, "m1", [], "send", None)))
    total = ops.overview_totals(rows).first()
    assert tuple(total) == (3, 3, 9, 5)
    audit = {r["iso_week"]: r for r in ops.audit_questions(rows).collect()}
    assert audit[3]["email_ref"] == "m1" and audit[3]["is_partial"] and audit[3]["email_delivered"]
    assert audit[1]["delivered"] and audit[1]["reviews"] == 3


def test_missing_report_is_an_error(spark, products):
    reports = spark.createDataFrame([], REPORT)
    with pytest.raises(KeyError, match="p1_2026_W03"):
        readside.report_with_product(reports, products, "p1", 2026, 3)
    runs = readside.runs_with_preview(frame(spark, record("p1", 1)), products, reports).first()
    assert runs["doc_id"] == "d1" and runs["preview"] is None
    assert set(RUN_KEY) <= set(runs.asDict())
