"""From clusters to themes: prompts, summaries, parsing, ranking."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.functions import ranking
from voxloom.functions.text import join_title, sanitize
from voxloom.schemas import RAW_THEME, RUN_KEY

# prompt -> (theme as JSON text, input tokens, output tokens)
Summarizer = Callable[[str], tuple[str, int, int]]
# Fixed values of the theme text.
UNKNOWN_THEME = "Unknown Theme"
ACTION_TITLE_CHARS = 30


def build_prompts(members: DataFrame, quotes: int = 3, actions: int = 2,
                  keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """One prompt per cluster: what is asked for, then the numbered, sanitised reviews.

    `members` has the run key, `label`, `pos`, `rating`, `title` and `body`; a cluster's reviews
    are bounded by the cap on a run.
    """
    shown = sanitize(join_title(F.col("title"), F.col("body"), " - "))
    listed = members.select(*keys, "label", "pos", F.struct("pos", "rating", shown.alias("text")).alias("m"))
    grouped = listed.groupBy(*keys, "label").agg(
        F.count("*").alias("size"), F.sort_array(F.collect_list("m")).alias("m"))
    # Fixed value: the wording and line format of a prompt.
    lines = F.transform("m", lambda m, i: F.format_string("%d. [%d⭐] %s\n", i + 1, m["rating"], m["text"]))
    head = F.format_string(
        "Analyze the following %d reviews to extract a theme.\n\n"
        "Provide exactly %d representative quotes and %d action ideas.\n\n<REVIEWS>\n",
        F.col("size"), F.lit(quotes), F.lit(actions))
    return grouped.select(
        *keys, "label", "size", F.concat(head, F.array_join(lines, ""), F.lit("</REVIEWS>\n")).alias("prompt"))


def summarize_clusters(prompts: DataFrame, summarizer: Summarizer, keys: tuple[str, ...] = RUN_KEY,
                       tries: int = 3, budget: int | None = None, start: int = 0, pause: float = 0.2) -> DataFrame:
    """Ask a pluggable summariser on the executors; a prompt that fails `tries` times gives a NULL answer
    and costs nothing; `failure` says why, for the last try. An answer that is no JSON object is a failure; an empty one counts as `{}`.

    With `budget`, the clusters of a run (a handful, by `rank`) are asked one after the other and
    none is asked once the tokens so far exceed the budget.
    """
    def ask(prompt: str) -> tuple[str | None, int, int, str | None]:
        why = None
        for turn in range(tries):
            if turn:
                time.sleep(pause)
            try:
                raw, asked, told = summarizer(prompt)
                raw = raw or "{}"
                if not isinstance(json.loads(raw), dict):
                    raise ValueError("the answer is no JSON object")
                return raw, asked, told, None
            except Exception as failure:  # noqa: BLE001 - any failure of the callable costs one try
                why = f"{type(failure).__name__}: {failure}"
        return None, 0, 0, why

    def with_answers(frame: pd.DataFrame, answers: list[tuple[str | None, int, int, str | None]]) -> pd.DataFrame:
        if not answers:
            return pd.DataFrame()
        kept = {c: frame[c].tolist()[:len(answers)] for c in frame.columns if c != "prompt"}
        told = {n: [a[i] for a in answers] for i, n in enumerate(("raw", "input_tokens", "output_tokens", "failure"))}
        return pd.DataFrame({**kept, **told})

    def all_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield with_answers(frame, [ask(p) for p in frame["prompt"]])

    def in_turn(frame: pd.DataFrame) -> pd.DataFrame:
        ordered, answers, spent = frame.sort_values("rank"), [], start
        for prompt in ordered["prompt"]:
            if spent > budget:
                break
            answers.append(ask(prompt))
            spent += answers[-1][1] + answers[-1][2]
        return with_answers(ordered, answers)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema if f.name != "prompt")
    schema = f"{kept}, raw string, input_tokens long, output_tokens long, failure string"
    if budget is None:
        return prompts.mapInPandas(all_of, schema)
    return prompts.groupBy(*keys).applyInPandas(in_turn, schema)


def summarize_builtin(members: DataFrame, prompts: DataFrame, terms: int = 3, quotes: int = 3, actions: int = 2,
                      keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Themes without a model: named by the terms typical of a cluster against the other clusters
    of its run, quoted from the members nearest to its centre. Joins and aggregations only.

    `members` also has `reduced`.
    """
    of = [*keys, "label"]
    words = members.select(*of, "id", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("body"), F.lit(r"(?U)\p{L}{3,}"), F.lit(0)))).alias("term"))
    in_cluster = words.groupBy(*of, "term").agg(F.count("*").alias("tf"))
    in_run = in_cluster.groupBy(*keys, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("all_tf"))
    score = F.round(F.col("tf") * F.log1p(F.col("tf") / F.col("all_tf")) / F.col("df"), 9)
    scored = in_cluster.join(in_run, [*keys, "term"]).withColumn("score", score)
    best = ranking.top_n(scored, tuple(of), [F.col("score").desc(), F.col("term")], terms, "n")
    names = best.groupBy(*of).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("n", "term"))), lambda t: F.initcap(t["term"])), ", ").alias("name"))

    dims = range(5)
    at = lambda i: F.coalesce(F.get("reduced", F.lit(i)), F.lit(0.0))
    centers = members.groupBy(*of).agg(*[F.avg(at(i)).alias(f"_c{i}") for i in dims])
    away = sum(((at(i) - F.col(f"_c{i}")) ** 2 for i in dims), F.lit(0.0))
    near = ranking.top_n(
        members.join(centers, of).withColumn("_away", F.round(away, 9)), tuple(of),
        [F.col("_away"), F.col("pos")], quotes, "n")
    quoted = near.groupBy(*of).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("n", "body"))), lambda q: q["body"]).alias("quotes"))
    told = prompts.join(names, of, "left").join(quoted, of, "left")
    name = F.coalesce("name", F.lit(UNKNOWN_THEME))
    ideas = [F.concat(F.lit("Look into what users say about "), name),
             F.concat(F.lit("Answer the reviews that mention "), name)]
    raw = F.to_json(F.struct(
        name.alias("name"), F.concat(F.col("size").cast("string"), F.lit(" reviews mention "), name).alias("description"),
        F.coalesce("quotes", F.array().cast("array<string>")).alias("quotes"),
        F.array(*[ideas[i % 2] for i in range(actions)]).alias("action_ideas")))
    count = lambda text: F.size(F.split(text, r"\s+")).cast("long")
    return told.withColumn("raw", raw).select(
        *of, "size", "raw", count(F.col("prompt")).alias("input_tokens"), count(F.col("raw")).alias("output_tokens"))


def action_ideas(ideas: Column, theme: Column) -> Column:
    """Title = first 30 characters and an ellipsis, details = full text."""
    return F.transform(ideas, lambda a: F.struct(
        F.concat(F.substring(a, 1, ACTION_TITLE_CHARS), F.lit("...")).alias("title"), a.alias("details"),
        theme.alias("related_theme")))


def parse_themes(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """JSON answers to `name, description, quotes, actions`; broken text or a wrong shape gives no theme."""
    parsed = answers.withColumn("_t", F.from_json(raw, RAW_THEME, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    good = parsed.where(F.col("_t").isNotNull() & F.col("_t._corrupt_record").isNull() & F.col(raw).rlike(r"^\s*\{"))
    empty = F.array().cast("array<string>")
    return good.select(
        *answers.columns, F.coalesce("_t.name", F.lit(UNKNOWN_THEME)).alias("name"),
        F.coalesce("_t.description", F.lit("")).alias("description"),
        F.coalesce("_t.quotes", empty).alias("quotes"),
        action_ideas(F.coalesce("_t.action_ideas", empty), F.coalesce("_t.name", F.lit(""))).alias("actions"))


def rank_themes(themes: DataFrame, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Themes by number of reviews, ties by cluster rank; a run has at most `max_themes`."""
    order = Window.partitionBy(*keys).orderBy(F.col("review_count").desc(), F.col("rank"))
    return themes.withColumn("theme_no", F.row_number().over(order))
