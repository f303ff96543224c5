"""The same tables and results as SQL common table expressions, for checks against another engine."""

from __future__ import annotations

from voxloom.plans.tables import MAX_RUN

RUN = "product, iso_year, iso_week"

_DIGITS = "lpad(CAST(doc_id % {m} AS VARCHAR), {n}, '0')"


def _tail() -> str:
    return (
        "CASE doc_id % 8"
        f" WHEN 0 THEN ' Call 98765' || {_DIGITS.format(m=100000, n=5)}"
        " WHEN 1 THEN ' UPI u' || doc_id || '@okbank'"
        f" WHEN 2 THEN ' PAN ABCDE' || {_DIGITS.format(m=10000, n=4)} || 'F'"
        f" WHEN 3 THEN ' id 1234 5678 ' || {_DIGITS.format(m=10000, n=4)}"
        " WHEN 4 THEN ' mail u' || doc_id || '@example.com' ELSE '' END")


# The lookarounds of the Spark rules, for an engine whose patterns have none: the neighbours are
# matched and put back, twice since a neighbour may belong to two hits.
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_UPI = r"\b[a-zA-Z0-9.\-_]+@[a-zA-Z0-9.\-_]+\b"
_IN = r"(^|[^0-9])(?:\+91[\-\s]?|91[\-\s]?|0)?(?:[6-9]\d{9})($|[^0-9])"
_ID = r"(^|[^+0-9A-Za-z_])\d{4}[\-\s]?\d{4}[\-\s]?\d{4}\b"
_INTL = (r"(^|[^0-9])(?:\+\d{1,3}[\-\s]?)?\(?\d{2,4}\)?[\-\s]?\d{3,4}[\-\s]?\d{3,4}(?:[\-\s]?\d{3,4})?($|[^0-9])")
_PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b"


def _replace(text: str, pattern: str, to: str, times: int = 1) -> str:
    for _ in range(times):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'gi')"
    return text


def scrub_stage(rule: str, text: str) -> str:
    """One rule as a SQL expression."""
    return {
        "email": lambda t: _replace(t, _EMAIL, "[EMAIL]"),
        "upi": lambda t: _replace(t, _UPI, "[UPI_ID]"),
        "phone_in": lambda t: _replace(t, _IN, r"\1[PHONE]\2", 2),
        "national_id": lambda t: _replace(t, _ID, r"\1[ID]", 2),
        "phone_intl": lambda t: _replace(t, _INTL, r"\1[PHONE]\2", 2),
        "pan": lambda t: _replace(t, _PAN, "[PAN]"),
    }[rule](text)


STAGES = ("email", "upi", "phone_in", "national_id", "phone_intl", "pan")


def scrub(text: str) -> str:
    for rule in STAGES:
        text = scrub_stage(rule, text)
    return text


def hits(before: str, after: str, placeholder: str) -> str:
    """How many placeholders a stage added."""
    count = lambda t: f"(length({t}) - length(replace({t}, '{placeholder}', ''))) // {len(placeholder)}"
    return f"({count(after)} - {count(before)})"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def windows(source: str, date: str = "date") -> str:
    """Rows of `source`, once per rolling window they lie in."""
    first = f"(CAST({date} AS DATE) + CAST(7 - isodow({date}) AS INTEGER))"
    return (
        f"SELECT s.*, isoyear(sunday) AS iso_year, week(sunday) AS iso_week, sunday FROM ("
        f"SELECT r.*, {first} + CAST(7 * k AS INTEGER) AS sunday FROM {source} r, "
        f"(SELECT unnest(generate_series(0, 10)) AS k)) s WHERE CAST({date} AS DATE) >= sunday - 70")


_MODELS = "['gpt-4o-mini', 'gpt-4o-2024', 'llama-3.1-8b', 'some-other-model', 'text-embedding-3-small']"

# Prices per 1,000 tokens, input and output.
_PRICES = {
    "text-embedding-3-small": (0.00002, 0.0), "gpt-4o-mini": (0.00015, 0.0006), "gpt-4o": (0.0025, 0.01), "llama": (0.0, 0.0),
    "all-MiniLM": (0.0, 0.0)}


def price(model: str, side: str) -> str:
    at = ("input", "output").index(side)
    whens = " ".join(f"WHEN contains({model}, '{part}') THEN {prices[at]}::DOUBLE" for part, prices in _PRICES.items())
    return f"(CASE {whens} ELSE {_PRICES['gpt-4o-mini'][at]}::DOUBLE END)"


def _costs(top: str) -> str:
    """Tokens and cost per run of a call for each cluster of `top`."""
    return f"""
        SELECT {RUN}, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
          sum(input_tokens / 1000.0::DOUBLE * {price('model', 'input')} + output_tokens / 1000.0::DOUBLE
              * {price('model', 'output')}) AS cost
        FROM (SELECT {RUN}, label, rank, {_MODELS}[(label % 5) + 1] AS model, size * 700 AS input_tokens,
          size * 90 AS output_tokens FROM {top}) GROUP BY ALL"""


_ANCHOR = "product || '-' || iso_year || '-W' || lpad(CAST(iso_week AS VARCHAR), 2, '0')"
_DAY = "(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(97 * (doc_id % 10000)))"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "reviews": ((), f"""
        SELECT substr(sha256(store || ':app:' || doc_id), 1, 16) AS id, * EXCLUDE (doc_id, text), length(body) AS raw_length
        FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'appstore' ELSE 'playstore' END AS store, source AS product,
          'user_' || (doc_id % 97) AS author, CAST(doc_id % 5 + 1 AS INTEGER) AS rating,
          CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 40) END AS title, text || {_tail()} AS body,
          {_DAY} AS date, CASE WHEN doc_id % 3 <> 0 THEN '1.' || (doc_id % 10) END AS version, lang AS language,
          doc_id AS seq, doc_id, text FROM documents)"""),
    "polls": (("reviews",), """
        SELECT * FROM reviews UNION ALL BY NAME
        SELECT * REPLACE (body || ' (edited)' AS body, seq + 1000000000000 AS seq) FROM reviews WHERE seq % 10 = 0"""),
    "products": ((), """
        SELECT slug, 'Product ' || upper(slug) AS display_name,
          CASE WHEN n % 4 = 0 THEN '' ELSE 'id' || n END AS appstore_id,
          CASE WHEN n % 5 = 0 THEN '' ELSE 'com.' || slug END AS playstore_id, 'doc-' || slug AS doc_id,
          'Doc ' || slug AS doc_title, slug || '@example.com, team@' || slug || '.org' AS recipients
        FROM (SELECT DISTINCT source AS slug, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents)"""),
    "all_members": (("reviews",), f"""
        SELECT *, CAST(seq % 7 - 1 AS INTEGER) AS label FROM (
          SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY date DESC, seq) AS pos
          FROM ({windows('reviews')}))"""),
    "members": (("all_members",), f"SELECT * FROM all_members WHERE pos <= {MAX_RUN}"),
    "sizes": (("members",), f"""
        SELECT {RUN}, label, count(*) AS size, avg(rating) AS avg_rating, min(pos) AS first_pos
        FROM members WHERE label <> -1 GROUP BY ALL"""),
    "top": (("sizes",), f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY size DESC, first_pos) AS rank FROM sizes)
        WHERE rank <= 5"""),
    "all_top": (("all_members",), f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY size DESC, first_pos) AS rank FROM (
          SELECT {RUN}, label, count(*) AS size, min(pos) AS first_pos FROM all_members WHERE label <> -1 GROUP BY ALL))
        WHERE rank <= 5"""),
    "themes": (("top",), f"""
        SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY size DESC, rank) AS theme_no,
          'Theme ' || label || ' of ' || product AS name, 'About ' || size || ' reviews.' AS description,
          ['Improve what reviewers of group ' || label || ' mention first', 'Reply soon'] AS ideas FROM top"""),
    "quotes": (("themes", "members"), f"""
        SELECT {RUN}, label, quote_no, CASE quote_no WHEN 1 THEN '  ' || substr(body, 1, 60) || '  '
            WHEN 2 THEN substr(substr(body, 1, 60), 11, 50) ELSE 'zz' || substr(body, 1, 30) END AS text
        FROM (SELECT m.*, row_number() OVER (PARTITION BY {RUN}, label ORDER BY pos) AS quote_no
              FROM members m JOIN (SELECT {RUN}, label FROM themes) USING ({RUN}, label)) WHERE quote_no <= 3"""),
    "checked": (("quotes", "members"), f"""
        SELECT q.*, h.id IS NOT NULL AS validated, h.id AS review_id, h.rating, h.store, h.date
        FROM quotes q LEFT JOIN (
          SELECT q.product, q.iso_year, q.iso_week, q.label, q.quote_no, arg_min(m.id, m.pos) AS id,
            arg_min(m.rating, m.pos) AS rating, arg_min(m.store, m.pos) AS store, arg_min(m.date, m.pos) AS date
          FROM quotes q JOIN members m USING ({RUN}, label)
          WHERE m.body <> '' AND contains(m.body, {strip('q.text')}) GROUP BY ALL) h USING ({RUN}, label, quote_no)"""),
    "costs": (("top",), _costs("top")),
    "all_costs": (("all_top",), _costs("all_top")),
    "stats": (("members", "top", "themes", "checked", "costs"), f"""
        SELECT {RUN}, total_reviews, appstore_reviews, playstore_reviews, noise_reviews,
          coalesce(clusters_found, 0) AS clusters_found, coalesce(clusters_found, 0) AS themes_generated,
          coalesce(quotes_proposed, 0) AS quotes_proposed, coalesce(quotes_validated, 0) AS quotes_validated,
          coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens,
          coalesce(cost, 0.0) AS cost
        FROM (SELECT {RUN}, count(*) AS total_reviews, count(*) FILTER (store = 'appstore') AS appstore_reviews,
              count(*) FILTER (store = 'playstore') AS playstore_reviews, count(*) FILTER (label = -1) AS noise_reviews
              FROM members GROUP BY ALL)
        LEFT JOIN (SELECT {RUN}, count(*) AS clusters_found FROM top GROUP BY ALL) USING ({RUN})
        LEFT JOIN (SELECT {RUN}, count(*) AS quotes_proposed, count(*) FILTER (validated) AS quotes_validated
                   FROM checked GROUP BY ALL) USING ({RUN})
        LEFT JOIN costs USING ({RUN})"""),
    "grid": (("members", "products"), f"""
        SELECT {RUN}, display_name, doc_id, recipients, sunday AS window_end, sunday - 70 AS window_start
        FROM (SELECT DISTINCT {RUN}, sunday FROM members) JOIN products ON slug = product"""),
    "theme_lists": (("themes", "checked"), f"""
        SELECT {RUN}, list({{theme_no: theme_no, name: name, description: description, size: size, label: label,
            actions: list_transform(ideas, lambda a: {{title: substr(a, 1, 30) || '...', details: a}}),
            quotes: coalesce(quotes, [])}} ORDER BY theme_no) AS themes
        FROM themes LEFT JOIN (SELECT {RUN}, label, list({{text: text, rating: rating, store: store, date: date}}
            ORDER BY quote_no) AS quotes FROM checked WHERE validated GROUP BY ALL) USING ({RUN}, label) GROUP BY ALL"""),
    "reports": (("grid", "theme_lists", "stats"), f"""
        SELECT g.*, coalesce(themes, []) AS themes, s.* EXCLUDE ({RUN}), {_ANCHOR.replace('product', 'g.product')
            .replace('iso_year', 'g.iso_year').replace('iso_week', 'g.iso_week')} AS anchor
        FROM grid g LEFT JOIN theme_lists t USING ({RUN}) LEFT JOIN stats s USING ({RUN})"""),
    "calls": ((), f"""
        SELECT conv_id, turn, {_MODELS}[(conv_id % 5) + 1] AS model,
          CASE WHEN role = 'user' THEN words ELSE 0 END AS input_tokens,
          CASE WHEN role = 'user' THEN 0 ELSE words END AS output_tokens
        FROM (SELECT *, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words FROM conversations)"""),
    "updates": ((), f"""
        SELECT *, status = 'completed' AS done, {_ANCHOR} AS anchor,
          CASE WHEN status = 'completed' THEN started_at + INTERVAL 1 HOUR END AS later
        FROM (SELECT o_orderkey AS n, 'run-' || o_orderkey AS run_id, 'src' || (o_custkey % 20) AS product,
          isoyear(o_orderdate) AS iso_year, week(o_orderdate) AS iso_week, o_orderdate AS started_at,
          CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'partial'
               WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'running' END AS status,
          CAST(round(o_totalprice) AS BIGINT) AS amount FROM orders)"""),
    "ledger": (("updates",), f"""
        SELECT * EXCLUDE (last) FROM (SELECT *, row_number() OVER (PARTITION BY {RUN} ORDER BY n DESC) AS last FROM updates)
        WHERE last = 1"""),
    "run_ledger": (("grid",), f"""
        SELECT 'r-' || {_ANCHOR} AS run_id, {RUN}, ['completed', 'partial', 'failed', 'running'][(iso_week % 4) + 1] AS status,
          CAST(window_end AS TIMESTAMP) + INTERVAL 6 HOUR AS started_at FROM grid
        WHERE CAST(regexp_extract(product, '(\\d+)$', 1) AS INTEGER) % 2 = 0"""),
    "published": ((), f"""
        SELECT 'doc-' || source AS doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' - Anchor ID: ' || source || '-' ||
          isoyear({_DAY}) || '-W' || lpad(CAST(week({_DAY}) AS VARCHAR), 2, '0') || ' end' ELSE text END AS text
        FROM documents"""),
    "newest": (("reviews",), """
        SELECT *, row_number() OVER (PARTITION BY product ORDER BY date DESC, seq) AS pos FROM reviews"""),
}


def sql(select: str, *needed: str) -> str:
    """`select` with the expressions it needs in front, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in needed:
        visit(name)
    if not ordered:
        return select
    parts = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    return f"WITH {parts}\n{select}"
