"""Scrubbing: our own pairs per rule, statistics, and the pluggable detector."""

import random
import re

from pyspark.sql import functions as F

from voxloom.functions import pii

PAIRS = {
    # e-mail
    "write to ann.lee@mail.example.org now": "write to [EMAIL] now",
    "ANN+X@SUB.EXAMPLE.CO.UK!": "[EMAIL]!",
    "two: a@b.io, c_d%e@f-g.com": "two: [EMAIL], [EMAIL]",
    "mail-me_7@99.net": "[EMAIL]",
    # payment handles
    "pay ann.lee@okaxis": "pay [UPI_ID]",
    "9812345678@ybl and x-1@upi": "[UPI_ID] and [UPI_ID]",
    "at the @ sign": "at the @ sign",
    # Indian phones
    "ring 9812345678.": "ring [PHONE].",
    "ring +919812345678": "ring [PHONE]",
    "ring +91-9812345678": "ring [PHONE]",
    "ring 91 7012345678": "ring [PHONE]",
    "ring 06012345678": "ring [PHONE]",
    "٩٨١٢٣٤٥٦٧٨ in other digits": "[PHONE] in other digits",
    # identity numbers
    "id 2345 6789 0123 ok": "id [ID] ok",
    "id 2345-6789-0123": "id [ID]",
    "id 234567890123": "id [ID]",
    "id 2345 6789 0123": "id [ID]",
    # other phones
    "office +1 (212) 555-0188": "office [PHONE]",
    "office (212) 555-0188": "office [PHONE]",
    "office +44 207 946 0958": "office [PHONE]",
    "order 12345678": "order [PHONE]",
    "+33 1 22 33 44 55": "+33 1 22 33 44 55",
    "pin 123456": "pin 123456",
    "pin 1234567": "pin 1234567",
    # tax ids
    "pan BNZPM2501F": "pan [PAN]",
    "pan bnzpm2501f": "pan [PAN]",
    "pan BNZP2501F": "pan BNZP2501F",
    "pan BNZPMX2501F": "pan BNZPMX2501F",
    "pan BNZPM25019": "pan BNZPM25019",
    # mixed
    "call 9812345678 or mail a@b.com, pan BNZPM2501F": "call [PHONE] or mail [EMAIL], pan [PAN]",
    "nothing to hide": "nothing to hide",
    "": "",
}


def frame(spark, bodies):
    return spark.createDataFrame(
        [(i, b, None if i % 2 else b, "Jo" if i % 3 else "") for i, b in enumerate(bodies)],
        "i int, body string, title string, author string")


def test_pairs(spark):
    rows = pii.scrub_columns(frame(spark, PAIRS)).collect()
    given = list(PAIRS)
    assert {given[r["i"]]: r["body"] for r in rows} == PAIRS
    assert all(r["title"] == (None if r["i"] % 2 else r["body"]) for r in rows)
    assert all(r["author"] == ("[NAME]" if r["i"] % 3 else "") for r in rows)


def test_random_texts_agree_with_the_same_patterns_in_python(spark):
    rng = random.Random(3)
    bits = ["9812345678", "a@b.com", "x@upi", "BNZPM2501F", "2345 6789 0123", " word ", "+1", "-", "(212)", " 555 ",
            "0188", "é", "\u00a0", "٣", "@", "."]
    bodies = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    want = []
    for body in bodies:
        for rule in pii.RULES:
            body = re.sub(rule.pattern.removeprefix("(?iU)"), rule.placeholder, body, flags=re.IGNORECASE)
        want.append(body)
    rows = pii.scrub_columns(frame(spark, bodies)).select("i", "body").collect()
    assert [r["body"] for r in sorted(rows, key=lambda r: r["i"])] == want


def test_guards_do_not_change_results(spark):
    for rule in pii.RULES:
        plain = F.regexp_replace("body", rule.pattern, rule.placeholder)
        rows = frame(spark, PAIRS).where(pii.scrub_one(F.col("body"), rule.name) != plain)
        assert rows.count() == 0


def test_stats_are_taken_along_the_chain(spark):
    rows = spark.createDataFrame(
        [("p", "mail a@b.com, ring 9812345678", None, "Jo"), ("p", "x@upi and c@d.org", "2345 6789 0123", "[NAME]"),
         ("q", None, None, None)], "k string, body string, title string, author string")
    stats = {r["k"]: r.asDict() for r in pii.pii_stats(rows, ("k",)).collect()}
    assert stats["p"] == {"k": "p", "emails_scrubbed": 2, "upi_scrubbed": 1, "phones_scrubbed": 1, "ids_scrubbed": 1,
                          "pan_scrubbed": 0, "authors_anonymized": 1}
    assert all(v == 0 for c, v in stats["q"].items() if c != "k")


def test_name_detector(spark):
    rows = spark.createDataFrame([("Ann wrote",), ("no one",)], "body string")
    assert pii.scrub_names(rows, "body").agg(F.sum("names_scrubbed")).first()[0] == 0
    found = pii.scrub_names(rows, "body", lambda s: (s.str.replace("Ann", "[NAME]"), s.str.count("Ann"))).collect()
    assert {(r["body"], r["names_scrubbed"]) for r in found} == {("[NAME] wrote", 1), ("no one", 0)}


def test_one_pass_without_python(spark):
    plan = pii.scrub_columns(frame(spark, PAIRS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_letter_filter_equals_filtering_afterwards(spark):
    bodies = [*PAIRS, "12 !!", "9812345678", "123@456", "😀", "12345678", "é", "2345 6789 0123", "..."]
    early = pii.scrub_lettered(frame(spark, bodies))
    late = pii.scrub_columns(frame(spark, bodies)).where(F.col("body").rlike(r"\p{L}"))
    assert early.count() == late.count() > len(PAIRS) and late.exceptAll(early).count() == 0
