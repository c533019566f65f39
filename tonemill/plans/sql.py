"""Builders for the DuckDB reference SQL.

The reference SQL is written from the labeler's specification in the plain
substring form (one ``contains`` per lexicon entry) rather than from the
engine's token/array form, so that the two are independent.
"""

from __future__ import annotations

from tonemill.lexicon import DEFAULT_LEXICON, Lexicon


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def d(x: float) -> str:
    """DOUBLE literal (bare decimals are DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def _hits(padded: str, words) -> str:
    if not words:
        return "0"
    return "(" + " + ".join(f"CAST(contains({padded}, {q(' ' + w + ' ')}) AS INTEGER)" for w in words) + ")"


def _any(t: str, needles) -> str:
    if not needles:
        return "FALSE"
    return "(" + " OR ".join(f"contains({t}, {q(n)})" for n in needles) + ")"


def _count(t: str, needles) -> str:
    if not needles:
        return "0"
    return "(" + " + ".join(f"CAST(contains({t}, {q(n)}) AS INTEGER)" for n in needles) + ")"


def rules_ctes(src: str, text_expr: str = "text", lexicon: Lexicon = DEFAULT_LEXICON, p: str = "r") -> str:
    """CTE chain over relation ``src`` ending in relation ``{p}`` that has all
    columns of ``src`` plus ``{p}_label`` and ``{p}_conf`` (0..1) and the
    features ``{p}_ph``, ``{p}_nh``, ``{p}_nf``, ``{p}_am``."""
    L = lexicon
    t = f"{p}_t"
    padded = f"(' ' || {t} || ' ')"
    w, s, aw = d(L.weight), d(L.swap), d(L.amplifier_weight)
    conf = lambda side: (
        f"least({d(L.base)} + ({side} / ({p}_tot + {d(L.smoothing)})) * {d(L.span)}, {d(L.cap)})"
    )
    return f"""
{p}_lt AS (SELECT *, lower(coalesce(CAST({text_expr} AS VARCHAR), 'nan')) AS {t} FROM {src}),
{p}_f AS (SELECT *, {_hits(padded, L.positive)} AS {p}_ph, {_hits(padded, L.negative)} AS {p}_nh,
          {_any(t, L.negations)} AS {p}_nf, {_count(t, L.amplifiers)} AS {p}_am FROM {p}_lt),
{p}_s AS (SELECT *,
          CASE WHEN {p}_nf THEN ({p}_nh * {w}) * {s} ELSE {p}_ph * {w} END AS {p}_p1,
          CASE WHEN {p}_nf THEN ({p}_ph * {w}) * {s} ELSE {p}_nh * {w} END AS {p}_n1 FROM {p}_f),
{p}_a AS (SELECT *,
          CASE WHEN {p}_p1 > {p}_n1 THEN {p}_p1 + {p}_am * {aw} ELSE {p}_p1 END AS {p}_p,
          CASE WHEN {p}_n1 > {p}_p1 THEN {p}_n1 + {p}_am * {aw} ELSE {p}_n1 END AS {p}_n FROM {p}_s),
{p}_b AS (SELECT *, {p}_p + {p}_n AS {p}_tot FROM {p}_a),
{p} AS (SELECT * EXCLUDE ({t}, {p}_p1, {p}_n1, {p}_p, {p}_n, {p}_tot),
        CASE WHEN {p}_tot = 0 THEN 'Neutral' WHEN {p}_p > {p}_n THEN 'Positive'
             WHEN {p}_n > {p}_p THEN 'Negative' ELSE 'Neutral' END AS {p}_label,
        CASE WHEN {p}_tot = 0 THEN {d(L.empty)} WHEN {p}_p > {p}_n THEN {conf(f'{p}_p')}
             WHEN {p}_n > {p}_p THEN {conf(f'{p}_n')} ELSE {d(L.tie)} END AS {p}_conf
        FROM {p}_b)"""


def pct(expr: str) -> str:
    """Percent with two decimals, rounded as Python's ``round``."""
    return py_round_sql(f"({expr}) * {d(100.0)}", 2)


VALENCE_TOKEN_SQL = "[\\p{L}\\p{N}]+(?:'[\\p{L}\\p{N}]+)*"


def valence_ctes(src: str, key: str, lexicon_sql: str, text_expr: str = "text", p: str = "v") -> str:
    """CTE chain ending in relation ``{p}``: all columns of ``src`` plus
    ``{p}_compound`` and the valence result ``{p}_label``, ``{p}_conf``.

    Tokens are the regex matches in the lower-cased text; every occurrence
    counts; valences are summed as exact decimals."""
    toks = f"regexp_extract_all(lower(coalesce(CAST({text_expr} AS VARCHAR), 'nan')), {q(VALENCE_TOKEN_SQL)}, 0)"
    s = f"(CAST(coalesce({p}_sum, 0) AS DOUBLE) / {d(1e10)})"
    comp = py_round_sql(f"least(greatest({s} / sqrt({s} * {s} + {d(15.0)}), {d(-1.0)}), {d(1.0)})", 4)
    c = f"{p}_compound"
    conf = f"least((abs({c}) + {d(1.0)}) / {d(2.0)} + {d(0.2)}, {d(0.95)})"
    return f"""
{p}_tok AS (SELECT {key} AS {p}_key, unnest({toks}) AS {p}_token FROM {src}),
{p}_hit AS (SELECT {p}_key, CAST(sum(CAST(CAST(lex.valence AS DECIMAL(18,10)) * 10000000000 AS BIGINT)) AS BIGINT) AS {p}_sum
            FROM {p}_tok JOIN {lexicon_sql} ON lex.token = {p}_token GROUP BY {p}_key),
{p}_c AS (SELECT s.*, {comp} AS {c} FROM {src} s LEFT JOIN {p}_hit h ON h.{p}_key = s.{key}),
{p} AS (SELECT *,
        CASE WHEN {c} >= {d(0.05)} THEN 'Positive' WHEN {c} <= {d(-0.05)} THEN 'Negative' ELSE 'Neutral' END
          AS {p}_label,
        CASE WHEN {c} >= {d(0.05)} OR {c} <= {d(-0.05)} THEN {conf} ELSE {d(0.65)} END AS {p}_conf
        FROM {p}_c)"""


def binary_sql(label: str, score: str) -> tuple[str, str]:
    """Two-class classifier output → (label, confidence) SQL; NULLs if no label or score."""
    up = f"upper({label})"
    boosted = f"least({score} + {d(0.05)}, {d(0.98)})"
    lab = (f"CASE WHEN {label} IS NULL OR {score} IS NULL OR isnan({score}) THEN NULL WHEN contains({up}, 'POS') THEN 'Positive' "
           f"WHEN contains({up}, 'NEG') THEN 'Negative' ELSE 'Neutral' END")
    conf = (f"CASE WHEN {label} IS NULL OR {score} IS NULL OR isnan({score}) THEN NULL WHEN contains({up}, 'POS') OR contains({up}, 'NEG') "
            f"THEN {boosted} ELSE {score} END")
    return lab, conf


def ternary_sql(label: str, score: str) -> tuple[str, str]:
    low = f"lower({label})"
    boosted = f"least({score} + {d(0.02)}, {d(0.98)})"
    lab = (f"CASE WHEN {label} IS NULL OR {score} IS NULL OR isnan({score}) THEN NULL WHEN contains({low}, 'positive') THEN 'Positive' "
           f"WHEN contains({low}, 'negative') THEN 'Negative' ELSE 'Neutral' END")
    conf = (f"CASE WHEN {label} IS NULL OR {score} IS NULL OR isnan({score}) THEN NULL WHEN contains({low}, 'positive') OR contains({low}, 'negative') "
            f"THEN {boosted} ELSE least({score}, {d(0.90)}) END")
    return lab, conf


def scored_answer_sql(r: str) -> tuple[str, str]:
    digits = f"regexp_replace({r}, '[^0-9]', '', 'g')"
    lab = (f"CASE WHEN {r} IS NULL THEN NULL WHEN contains({r}, 'Positive') THEN 'Positive' "
           f"WHEN contains({r}, 'Negative') THEN 'Negative' ELSE 'Neutral' END")
    conf = (f"CASE WHEN {r} IS NULL THEN NULL WHEN {digits} = '' THEN {d(0.95)} "
            f"ELSE least(greatest(CAST({digits} AS DOUBLE) / {d(100.0)}, {d(0.7)}), {d(0.98)}) END")
    return lab, conf


def plain_answer_sql(r: str) -> tuple[str, str]:
    low = f"lower({r})"
    lab = (f"CASE WHEN {r} IS NULL THEN NULL WHEN contains({low}, 'positive') THEN 'Positive' "
           f"WHEN contains({low}, 'negative') THEN 'Negative' ELSE 'Neutral' END")
    conf = (f"CASE WHEN {r} IS NULL THEN NULL WHEN contains({low}, 'positive') OR contains({low}, 'negative') "
            f"THEN {d(0.96)} ELSE {d(0.85)} END")
    return lab, conf


def vote_sql(votes: str, key: str) -> str:
    """Majority vote over a relation ``votes(key, ord, label, conf)``:
    most votes, then the earliest first vote; mean of the winners (summed in
    model order), +0.1 (cap 0.98) when unanimous. Yields ``(key, e_label,
    e_conf)``."""
    return f"""(
  WITH g AS (SELECT {key}, label, count(*) AS n, min(ord) AS first,
                    list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(conf ORDER BY ord)), lambda a, b: a + b) AS total
             FROM {votes} GROUP BY {key}, label),
  k AS (SELECT {key}, count(*) AS n_labels FROM g GROUP BY {key}),
  w AS (SELECT g.*, row_number() OVER (PARTITION BY g.{key} ORDER BY n DESC, first ASC) AS rn FROM g)
  SELECT w.{key}, w.label AS e_label,
         CASE WHEN k.n_labels = 1 THEN least(w.total / w.n + {d(0.1)}, {d(0.98)}) ELSE w.total / w.n END AS e_conf
  FROM w JOIN k ON k.{key} = w.{key} WHERE w.rn = 1)"""


def py_round_sql(x: str, n: int = 2) -> str:
    """Python's ``round(x, n)`` in SQL: only next to a rounding midpoint the
    exact side is decided with error-free arithmetic (Veltkamp split)."""
    s = d(10 ** (n + 1))
    y = f"CAST({x} AS DOUBLE)"
    t = f"round({y} * {s})"
    c = f"({y} * {d(134217729.0)})"
    hi = f"({c} - ({c} - {y}))"
    lo = f"({y} - {hi})"
    side = f"sign(({hi} * {s} - {t}) + {lo} * {s})"
    down = f"(({t} - {d(5.0)}) / {s})"
    up = f"(({t} + {d(5.0)}) / {s})"
    lower_even = f"((CAST(({t} - {d(5.0)}) / {d(10.0)} AS BIGINT) % 2 + 2) % 2 = 0)"
    return (f"(CASE WHEN {y} IS NULL THEN NULL WHEN ((CAST({t} AS BIGINT) % 10) + 10) % 10 = 5 THEN "
            f"(CASE WHEN {side} > 0 THEN {up} WHEN {side} < 0 THEN {down} WHEN {lower_even} THEN {down} ELSE {up} END) "
            f"ELSE round({y}, {n}) END + {d(0.0)})")


def valence_rules_sql(src: str, key: str, lexicon: dict, rules, text_expr: str = "text") -> str:
    """``SELECT key, compound`` with the context rules: for each hit, the up
    to ``window`` preceding tokens nearest first (booster, then negator),
    summed in token order, then the emphasis."""
    keys = "[" + ", ".join(q(k) for k in lexicon) + "]"
    val = "CASE toks[i] " + " ".join(f"WHEN {q(k)} THEN {d(v)}" for k, v in lexicon.items()) + " END"
    v = f"({val})"
    for j in range(1, rules.window + 1):
        prev = f"(CASE WHEN i - {j} >= 1 THEN toks[i - {j}] END)"
        if rules.boosters:
            b = "CASE " + prev + " " + " ".join(f"WHEN {q(k)} THEN {d(x)}" for k, x in rules.boosters.items()) + " END"
            inc = f"(coalesce({b}, {d(0.0)}) * {d(rules.damping[j - 1])})"
            v = f"({v} + CASE WHEN {v} < 0 THEN -{inc} ELSE {inc} END)"
        if rules.negators:
            negs = ", ".join(q(w) for w in rules.negators)
            v = f"(CASE WHEN {prev} IN ({negs}) THEN {v} * {d(rules.negation_scalar)} ELSE {v} END)"
    low = f"lower(coalesce(CAST({text_expr} AS VARCHAR), 'nan'))"
    raw = f"coalesce(CAST({text_expr} AS VARCHAR), 'nan')"
    s0 = ("list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_transform(pos, lambda i: " + v + ")), "
          "lambda a, b: a + b)")
    marks = f"least(length({raw}) - length(replace({raw}, '!', '')), {rules.exclamation_max})"
    emph = f"(CAST({marks} AS DOUBLE) * {d(rules.exclamation_step)})"
    s = "s0" if not rules.exclamation_step else \
        f"(CASE WHEN s0 > 0 THEN s0 + {emph} WHEN s0 < 0 THEN s0 - {emph} ELSE s0 END)"
    comp = py_round_sql(f"least(greatest({s} / sqrt({s} * {s} + {d(15.0)}), {d(-1.0)}), {d(1.0)})", 4)
    return f"""WITH vt AS (SELECT {key}, {text_expr}, regexp_extract_all({low}, {q(VALENCE_TOKEN_SQL)}, 0) AS toks FROM {src}),
vp AS (SELECT *, list_filter(range(1, len(toks) + 1), lambda i: list_contains({keys}, toks[i])) AS pos FROM vt),
vs AS MATERIALIZED (SELECT *, {s0} AS s0 FROM vp)
SELECT {key}, {comp} AS compound FROM vs"""
