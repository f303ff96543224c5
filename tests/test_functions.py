"""Weeks, keys, texts, prices, ranking."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from voxloom.functions import keys, pricing, ranking, text, weeks
from voxloom.operators import cost
from voxloom.settings import Settings


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_parse_iso_week(spark):
    given = {
        "2026-W23": (2026, 23, None), "2026-W3": (2026, 3, None), " \t2020-W53\n": (2020, 53, None),
        "2026-W01": (2026, 1, None), "2026W23": (None, None, "bad format"), "2026-23": (None, None, "bad format"),
        "26-W23": (None, None, "bad format"), "2026-W0": (None, None, "week out of range"),
        "2026-W54": (None, None, "week out of range"), "2025-W53": (None, None, "no such week in year"),
        "": (None, None, "bad format")}
    rows = weeks.parse_iso_week(spark.createDataFrame([(k,) for k in given], "w string"), "w").collect()
    assert {r["w"]: (r["iso_year"], r["iso_week"], r["reason"]) for r in rows} == given


def test_weeks_agree_with_the_calendar(spark):
    rng = random.Random(2)
    days = [dt.date(1999, 12, 25) + dt.timedelta(days=rng.randrange(11000)) for _ in range(300)]
    frame = spark.createDataFrame([(d,) for d in days], "d date").withColumns(
        {"y": weeks.iso_year_of(F.col("d")), "w": weeks.iso_week_of(F.col("d"))})
    rows = frame.select("d", "y", "w", weeks.week_monday(F.col("y"), F.col("w")).alias("mon"),
                        weeks.week_sunday(F.col("y"), F.col("w")).alias("sun"),
                        weeks.window_start(F.col("y"), F.col("w")).alias("start"),
                        weeks.max_iso_week(F.col("y")).alias("last"),
                        weeks.format_iso_week(F.col("y"), F.col("w")).alias("label")).collect()
    for r in rows:
        year, week, day = r["d"].isocalendar()
        assert (r["y"], r["w"]) == (year, week)
        assert r["mon"] == r["d"] - dt.timedelta(days=day - 1) and r["sun"] == r["mon"] + dt.timedelta(days=6)
        assert r["start"] == r["sun"] - dt.timedelta(days=70)
        assert r["last"] == dt.date(year, 12, 28).isocalendar()[1] and r["label"] == f"{year}-W{week:02d}"


def test_windows_of_a_row(spark):
    rows = spark.createDataFrame(
        [(1, dt.datetime(2026, 6, 7, 23, 59, 59)), (2, dt.datetime(2026, 6, 8)), (3, dt.datetime(2024, 12, 31))],
        "id int, date timestamp")
    got = {}
    for r in weeks.assign_windows(rows).collect():
        got.setdefault(r["id"], set()).add((r["iso_year"], r["iso_week"]))
    assert len(got[1]) == 11 and len(got[2]) == 10 and len(got[3]) == 10
    assert (2026, 23) in got[1] and (2026, 23) not in got[2] and (2025, 1) in got[3] and (2024, 53) not in got[3]


def test_keys(spark):
    row = one(spark, keys.review_id(F.lit("appstore"), F.lit("42"), F.lit("é7")),
              keys.run_key(F.lit("p"), F.lit(2026), F.lit(3)), keys.section_anchor(F.lit("p"), F.lit(2026), F.lit(3)),
              keys.report_key(F.lit("p"), F.lit(2026), F.lit(3)), keys.raw_length(F.lit("a😀é")),
              keys.date_label(F.lit(None).cast("timestamp")), keys.clamp_rating(F.lit(0)), keys.clamp_rating(F.lit(9)))
    assert row["c0"] == hashlib.sha256("appstore:42:é7".encode()).hexdigest()[:16]
    assert tuple(row)[1:] == ("p:2026:W03", "p-2026-W03", "p_2026_W03", 3, "Unknown Date", 1, 5)


def test_to_utc(spark):
    row = one(spark, *[F.date_format(keys.to_utc(F.lit(t)), "yyyy-MM-dd HH:mm") for t in (
        "2026-06-15T12:00:00-07:00", "2026-06-15T12:00:00", "2026-06-15T12:00:00Z", "yesterday")])
    assert tuple(row) == ("2026-06-15 19:00", "2026-06-15 12:00", "2026-06-15 12:00", None)


def test_texts(spark):
    dirty = "Bad\x00 \x0bapp\x1f\t\n<b>"
    row = one(spark, text.sanitize(F.lit(dirty)), text.sanitize(F.lit("<" + "y" * 2500)), text.sanitize(F.lit(None)),
              text.strip(F.lit("  a b\n")), text.embedding_text(F.lit(""), F.lit("b")),
              text.embedding_text(F.lit("t"), F.lit("b")), text.join_title(F.lit(None), F.lit("b"), " - "))
    assert row["c0"] == "Bad app\t\n&lt;b&gt;"
    assert row["c1"] == "&lt;" + "y" * 1996 + "..." and row["c2"] == ""
    assert tuple(row)[3:] == ("a b", "b", "t\nb", "b")
    bodies = ["12 !!", "😀", "", "[PHONE]", "é", "Ж9", "…"]
    kept = spark.createDataFrame([(b,) for b in bodies], "b string").where(text.has_letter(F.col("b"))).collect()
    assert {r["b"] for r in kept} == {"[PHONE]", "é", "Ж9"}


def test_prices_and_budget(spark):
    row = one(spark, pricing.token_cost(F.lit("gpt-4o-mini"), F.lit(1000), F.lit(0)),
              pricing.token_cost(F.lit("gpt-4o-2024-08-06"), F.lit(0), F.lit(1000)),
              pricing.token_cost(F.lit("who-knows"), F.lit(0), F.lit(1000)),
              pricing.token_cost(F.lit("llama-3"), F.lit(9), F.lit(9)))
    assert [round(c, 8) for c in row] == [0.00015, 0.01, 0.0006, 0.0]
    ranked = spark.createDataFrame([("r", i, t) for i, t in enumerate((600, 600, 1, 1), 1)], "k string, rank int, t int")
    assert sorted(r["rank"] for r in cost.token_budget(ranked, "t", 1000, ("k",)).collect()) == [1, 2]
    assert cost.token_budget(ranked, "t", 1000, ("k",), start=1500).count() == 0
    totals = spark.createDataFrame([("a", 59000, 1001, 0.1), ("b", 60000, 0, 2.0), ("c", 1, 1, 2.01)],
                                   "k string, input_tokens long, output_tokens long, estimated_cost_usd double")
    alerts = {r["k"]: (r["over_tokens"], r["over_cost"]) for r in cost.cost_alerts(totals).collect()}
    assert alerts == {"a": (True, False), "c": (False, True)}


def test_positions_in_a_hot_key(spark):
    """One key holds nearly all rows and many equal dates: positions still equal those of a plain sort."""
    rng = random.Random(5)
    rows = [("hot" if i % 50 else f"k{i % 7}", rng.randrange(40), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, d int, seq int").repartition(7)
    order = [F.col("d").desc(), F.col("seq")]
    got = {r["seq"]: r["pos"] for r in ranking.position(frame, ("k",), order).collect()}
    before = {r["seq"]: r["t"] for r in ranking.total_before(frame, ("k",), order, F.col("d"), "t").collect()}
    want, sums = {}, {}
    for key in {r[0] for r in rows}:
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]], sums[r[2]] = n, total
            total += r[1]
    assert got == want and before == sums


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(min_cluster_size=1)
    with pytest.raises(ValueError):
        Settings(email_mode="fax")
    assert Settings().max_tokens_per_run == 60_000
