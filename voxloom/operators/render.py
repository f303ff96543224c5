"""Reports as document blocks, e-mail and markdown: column expressions over one report per row.

The wording, symbols and layout below are fixed values of the published formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.keys import date_label, deep_link, section_anchor
from voxloom.operators.report import validated_only
from voxloom.schemas import RUN_KEY

EMAIL_THEMES = 3
EMAIL_ACTIONS = 2
_BLOCKS = "array<struct<text:string,bold:boolean>>"


def _title() -> Column:
    return F.coalesce(F.nullif("display_name", F.lit("")), F.col("product"))


def _anchor() -> Column:
    return section_anchor(F.col("product"), F.col("iso_year"), F.col("iso_week"))


def _block(text: Column, bold: bool = False) -> Column:
    return F.struct(text.alias("text"), F.lit(bold).alias("bold"))


def _only_if(condition: Column, blocks: Column) -> Column:
    return F.when(condition, blocks).otherwise(F.array().cast(_BLOCKS))


def blocks_of_report() -> Column:
    """All blocks of a report as one array."""
    heading = F.format_string(
        "%s — Weekly Review Pulse — W%d (%s to %s)\n", _title(), F.col("iso_week"),
        date_label(F.col("review_window_start")), date_label(F.col("review_window_end")))
    listed = F.transform("themes", lambda t, i: _block(F.format_string(
        "%d. %s (%d reviews)\n   %s\n", i + 1, t["name"], t["review_count"], t["description"])))

    def quotes_of(theme: Column) -> Column:
        valid = validated_only(theme["quotes"])
        lines = F.transform(valid, lambda q: _block(F.format_string(
            '"%s" - [%d⭐ | %s | %s]\n', q["text"], q["rating"], q["store"], date_label(q["date"]))))
        return _only_if(F.size(valid) > 0, F.concat(
            F.array(_block(F.concat(F.lit("\n"), theme["name"], F.lit(":\n")), True)), lines))

    def actions_of(theme: Column) -> Column:
        return F.transform(theme["actions"], lambda a: _block(F.format_string(
            "• %s: %s (Related to: %s)\n", a["title"], a["details"], theme["name"])))

    some = F.size("themes") > 0
    any_action = F.exists("themes", lambda t: F.size(t["actions"]) > 0)
    about = F.format_string(
        "\nAbout This Pulse:\n- Analyzed %d reviews (%d App Store, %d Play Store)\n- Found %d clusters\n"
        "- Anchor ID: %s\n--- \n",
        F.col("stats.total_reviews"), F.col("stats.appstore_reviews"), F.col("stats.playstore_reviews"),
        F.col("stats.clusters_found"), _anchor())
    line = lambda text, bold: F.array(_block(F.lit(text), bold))
    body = F.concat(
        line("\nTOP THEMES:\n", True), listed, line("\nREAL USER QUOTES:\n", True),
        F.flatten(F.transform("themes", quotes_of)),
        _only_if(any_action, F.concat(
            line("\nACTION IDEAS:\n", True), F.flatten(F.transform("themes", actions_of)))))
    none = line("No significant themes discovered this week.\n", False)
    return F.concat(
        F.array(_block(heading, True)), F.when(some, body).otherwise(none), F.array(_block(about)))


def doc_blocks(reports: DataFrame) -> DataFrame:
    """One row per block, numbered."""
    return reports.select(*RUN_KEY, F.posexplode(blocks_of_report()).alias("block_no", "b")).select(
        *RUN_KEY, "block_no", "b.text", "b.bold")


def email_topk(themes: Column) -> tuple[Column, Column]:
    """(first three themes, the first two actions of each as `theme, title, details`)."""
    top = F.slice(themes, 1, EMAIL_THEMES)
    actions = F.flatten(F.transform(top, lambda t: F.transform(
        F.slice(t["actions"], 1, EMAIL_ACTIONS), lambda a: F.struct(
            t["name"].alias("theme"), a["title"].alias("title"), a["details"].alias("details")))))
    return top, actions


def quote_topk(quotes: Column, n: int = 3) -> Column:
    """The first validated quotes of a theme."""
    return F.slice(validated_only(quotes), 1, n)


def _stamp() -> Column:
    fraction = F.date_format("generated_at", "SSSSSS")
    return F.concat(
        F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def email_subject() -> Column:
    return F.format_string("📊 %s Review Pulse — Week %d", _title(), F.col("iso_week"))


def email_text(doc_id: Column) -> Column:
    top, actions = email_topk(F.col("themes"))
    lines = F.concat(
        F.array(F.format_string("Review Pulse for %s (Week %d, %d)", _title(), F.col("iso_week"), F.col("iso_year")),
                F.lit(""), F.lit("Top Themes:")),
        F.transform(top, lambda t: F.format_string("• %s: %s", t["name"], t["description"])),
        F.when(F.size(actions) > 0, F.concat(
            F.array(F.lit(""), F.lit("Top Action Ideas:")),
            F.transform(actions, lambda a: F.format_string("• [%s] %s: %s", a["theme"], a["title"], a["details"]))
        )).otherwise(F.array().cast("array<string>")),
        F.array(F.lit(""), F.lit("Stats:"),
                F.format_string("- %d reviews analyzed", F.col("stats.total_reviews")),
                F.format_string("- %d clusters found", F.col("stats.clusters_found")), F.lit(""),
                F.concat(F.lit("Read Full Report -> "), deep_link(doc_id, _anchor())), F.lit(""),
                F.concat(F.lit("Generated at: "), _stamp())))
    return F.array_join(lines, "\n")


def email_html(doc_id: Column) -> Column:
    """The same as HTML; texts are not escaped."""
    top, actions = email_topk(F.col("themes"))
    themes = F.array_join(F.transform(top, lambda t: F.concat(
        F.lit("<li><strong>"), t["name"], F.lit("</strong>: "), t["description"], F.lit("</li>"))), "")
    ideas = F.array_join(F.transform(actions, lambda a: F.concat(
        F.lit("<li><strong>["), a["theme"], F.lit("] "), a["title"], F.lit("</strong>: "), a["details"],
        F.lit("</li>"))), "")

    def section(heading: str, items: Column) -> Column:
        return F.concat(F.lit(f"        <h3>{heading}</h3>\n        <ul>\n          "), items, F.lit("\n        </ul>\n"))

    head = F.concat(
        F.lit('\n    <html>\n      <body style="font-family: sans-serif; line-height: 1.5; color: #333;">\n'
              "        <h2>📊 Review Pulse for "),
        F.format_string("%s (Week %d, %d)", _title(), F.col("iso_week"), F.col("iso_year")),
        F.lit("</h2>\n        \n"))
    stats = F.concat(
        F.lit('        <div style="background-color: #f5f5f5; padding: 15px; border-radius: 5px; margin: 20px 0;">\n'
              '            <p style="margin: 0;"><strong>Stats:</strong> '),
        F.format_string("%d reviews analyzed | %d clusters found", F.col("stats.total_reviews"),
                        F.col("stats.clusters_found")), F.lit("</p>\n        </div>\n        \n"))
    link = F.concat(
        F.lit('        <a href="'), deep_link(doc_id, _anchor()),
        F.lit('" style="display: inline-block; background-color: #1a73e8; color: white; padding: 10px 20px; '
              'text-decoration: none; border-radius: 4px; font-weight: bold;">\n'
              "            Read Full Report →\n        </a>\n        \n"))
    foot = F.concat(
        F.lit('        <hr style="margin-top: 30px; border: 0; border-top: 1px solid #eee;" />\n'
              '        <p style="font-size: 0.8em; color: #777;">\n            Generated at: '),
        _stamp(), F.lit("\n        </p>\n      </body>\n    </html>\n    "))
    gap = F.lit("        \n")
    some = F.when(F.size(actions) > 0, F.concat(gap, section("Top Action Ideas:", ideas))).otherwise(F.lit(""))
    # Every section ends with an indented blank, which the next one starts on.
    return F.concat(head, section("Top Themes:", themes), some, gap, stats, link, foot)


def render_all(reports: DataFrame, products: DataFrame) -> DataFrame:
    """Document blocks and e-mail of every report; the product supplies the document."""
    docs = products.select(F.col("slug").alias("product"), "doc_id")
    doc_id = F.coalesce("doc_id", F.lit("default_doc_id"))
    return reports.join(docs, "product", "left").select(
        *RUN_KEY, blocks_of_report().alias("blocks"), email_subject().alias("subject"),
        email_text(doc_id).alias("text_body"), email_html(doc_id).alias("html_body"))


def report_markdown(reports: DataFrame, title: str = "Groq Analysis Output") -> DataFrame:
    """Report as markdown text; the default title is a fixed value."""
    def part(t: Column, i: Column) -> Column:
        quotes = F.array_join(F.transform(validated_only(t["quotes"]), lambda q: F.format_string(
            '- "%s" (%d stars)\n', q["text"], q["rating"])), "")
        actions = F.array_join(F.transform(t["actions"], lambda a: F.format_string(
            "- %s: %s\n", a["title"], a["details"])), "")
        return F.concat(
            F.format_string("### %d. %s (%d reviews)\n%s\n\n**Quotes:**\n", i + 1, t["name"], t["review_count"],
                            t["description"]), quotes, F.lit("\n**Action Ideas:**\n"), actions, F.lit("\n---\n\n"))

    return reports.select(*RUN_KEY, F.concat(
        F.lit(f"# {title}\n\n## Top Themes\n"), F.array_join(F.transform("themes", part), "")).alias("text"))
