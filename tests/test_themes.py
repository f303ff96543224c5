"""Prompts, summaries, parsing, quotes, reports and their rendering."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from voxloom.operators import quotes, render, report, themes
from voxloom.schemas import PRODUCT, REPORT

RUN = ("p", 2026, 23)
MEMBERS = "product string, iso_year int, iso_week int, label int, pos int, id string, rating int, store string, title string, body string, date timestamp"


@pytest.fixture(scope="module")
def members(spark):
    day = dt.datetime(2026, 6, 1)
    rows = [(*RUN, 0, 2, "b", 4, "playstore", None, "This is a great app. \n", day),
            (*RUN, 0, 1, "a", 5, "appstore", "Nice", "great <app>", day + dt.timedelta(days=1)),
            (*RUN, 1, 3, "c", 1, "appstore", None, "an awful app", day), (*RUN, 1, 4, "d", 1, "appstore", None, None, day)]
    return spark.createDataFrame(rows, MEMBERS)


def test_prompt(members):
    prompts = {r["label"]: r for r in themes.build_prompts(members.where("body IS NOT NULL"), 2, 1).collect()}
    assert prompts[0]["prompt"] == (
        "Analyze the following 2 reviews to extract a theme.\n\nProvide exactly 2 representative quotes and 1 action ideas.\n\n"
        "<REVIEWS>\n1. [5⭐] Nice - great &lt;app&gt;\n2. [4⭐] This is a great app. \n\n</REVIEWS>\n")


def test_quotes(spark, members):
    asked = spark.createDataFrame(
        [(*RUN, 0, 1, " great app "), (*RUN, 0, 2, "great"), (*RUN, 0, 3, "awful app"), (*RUN, 0, 4, ""), (*RUN, 1, 1, "Awful")],
        "product string, iso_year int, iso_week int, label int, quote_no int, text string")
    texts = members.select("id", "body")
    got = {(r["label"], r["quote_no"]): r for r in quotes.attribute_quotes(asked, members, texts).collect()}
    assert {k: v["validated"] for k, v in got.items()} == {
        (0, 1): True, (0, 2): True, (0, 3): False, (0, 4): True, (1, 1): False}
    assert got[(0, 1)]["review_id"] == "b" and got[(0, 2)]["review_id"] == "a" and got[(0, 2)]["rating"] == 5
    plain = {(r["label"], r["quote_no"]): r["validated"] for r in quotes.validate_quotes(asked, members, texts).collect()}
    assert plain == {k: v["validated"] for k, v in got.items()}
    rate = {r["label"]: r for r in quotes.quote_validation_rate(
        quotes.validate_quotes(asked, members, texts), ("label",)).collect()}
    assert (rate[0]["rate"], rate[0]["low"], rate[1]["rate"], rate[1]["low"]) == (0.75, False, 0.0, True)


def test_parse(spark):
    raws = {
        1: json.dumps({"name": "N", "description": "D", "quotes": ["q"], "action_ideas": ["x" * 40, "y"]}),
        2: '{"name": "Only"}', 3: "{}", 4: "", 5: "[]", 6: '{"name": ', 7: '{"quotes": "text"}', 8: None}
    rows = spark.createDataFrame(list(raws.items()), "label int, raw string")
    got = {r["label"]: r for r in themes.parse_themes(rows).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["actions"][0]["title"] == "x" * 30 + "..." and got[1]["actions"][1]["title"] == "y..."
    assert got[1]["actions"][0]["related_theme"] == "N" and got[2]["quotes"] == [] and got[3]["name"] == "Unknown Theme"


def test_summariser_is_retried_and_stopped_by_the_budget(spark):
    prompts = spark.createDataFrame(
        [("r", i, i, t) for i, t in enumerate(["ok", "ok", "never", "ok"], 1)], "k string, label int, rank int, prompt string")

    def answer(prompt):
        if prompt == "never":
            raise RuntimeError("no")
        return '{"name": "T"}', 300, 300

    free = themes.summarize_clusters(prompts, answer, ("k",)).collect()
    assert [r["raw"] for r in sorted(free, key=lambda r: r["rank"])] == ['{"name": "T"}', '{"name": "T"}', None, '{"name": "T"}']
    capped = themes.summarize_clusters(prompts, answer, ("k",), budget=1000).collect()
    assert sorted(r["rank"] for r in capped) == [1, 2] and sum(r["input_tokens"] + r["output_tokens"] for r in capped) == 1200
    assert themes.summarize_clusters(prompts, answer, ("k",), budget=1000, start=1500).count() == 0


QUOTE = ("A quote", "r1", 5, "appstore", dt.datetime(2026, 6, 2), True)
BAD = ("Wrong", "r2", 1, "playstore", None, False)
STATS = (100, 60, 40, 1, 0, 1, 2, 1, (10, 5, 0.1))


def made(name, themes_, display="Test App"):
    return (name, display, 2026, 23, dt.datetime(2026, 6, 8, 1, 2, 3, 45), dt.datetime(2026, 3, 29), None, themes_, STATS)


@pytest.fixture(scope="module")
def reports(spark):
    theme = lambda n: (f"Theme {n}", f"About {n}", [BAD, QUOTE], [("Do...", "Do it", f"Theme {n}")] * 3, 10 - n, n)
    return spark.createDataFrame([made("full", [theme(n) for n in range(4)]), made("none", [], "")], REPORT)


def test_blocks(reports):
    rows = render.doc_blocks(reports).collect()
    full = [(r["text"], r["bold"]) for r in sorted((r for r in rows if r["product"] == "full"), key=lambda r: r["block_no"])]
    assert full[0] == ("Test App — Weekly Review Pulse — W23 (2026-03-29 to Unknown Date)\n", True)
    assert full[1] == ("\nTOP THEMES:\n", True) and full[2] == ("1. Theme 0 (10 reviews)\n   About 0\n", False)
    assert ('"A quote" - [5⭐ | appstore | 2026-06-02]\n', False) in full and not any("Wrong" in t for t, _ in full)
    assert ("• Do...: Do it (Related to: Theme 3)\n", False) in full
    assert full[-1][0].startswith("\nAbout This Pulse:\n- Analyzed 100 reviews (60 App Store, 40 Play Store)\n- Found 1 clusters\n")
    assert "Anchor ID: full-2026-W23" in full[-1][0]
    none = [r["text"] for r in rows if r["product"] == "none"]
    assert len(none) == 3 and any(t.startswith("none — Weekly") for t in none)
    assert "No significant themes discovered this week.\n" in none


def test_mail(spark, reports):
    products = spark.createDataFrame([("full", "", "", "", "doc1", "", [])], PRODUCT)
    got = {r["product"]: r for r in render.render_all(reports, products).collect()}
    text, html = got["full"]["text_body"], got["full"]["html_body"]
    assert got["full"]["subject"] == "📊 Test App Review Pulse — Week 23"
    assert text.count("• Theme") == 3 and text.count("• [Theme") == 6
    assert "Read Full Report -> https://docs.google.com/document/d/doc1/edit#heading=h.full-2026-W23\n" in text
    assert text.endswith("Generated at: 2026-06-08T01:02:03.000045+00:00")
    assert html.count("<li><strong>Theme") == 3 and html.count("<li><strong>[") == 6 and "doc1/edit#heading=h.full" in html
    assert "Top Action Ideas" not in got["none"]["text_body"] and "Top Action Ideas" not in got["none"]["html_body"]
    assert "default_doc_id" in got["none"]["html_body"]


def test_summary_and_markdown(reports):
    got = {r["product"]: r for r in report.report_summary(reports).collect()}
    assert got["full"]["summary"].endswith("The leading concern was related to 'Theme 0'.") and got["full"]["focus"] == "Do..."
    assert (got["none"]["primary_signal"], got["none"]["focus"]) == ("N/A", "N/A")
    text = {r["product"]: r["text"] for r in render.report_markdown(reports).collect()}["full"]
    assert "### 2. Theme 1 (9 reviews)\nAbout 1\n\n**Quotes:**\n- \"A quote\" (5 stars)\n\n**Action Ideas:**\n- Do...: Do it\n" in text
