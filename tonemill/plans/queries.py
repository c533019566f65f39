"""Named queries over the test tables, each with its DuckDB reference SQL.

Every query reads whole tables (``documents`` unless stated) and returns a
DataFrame; nothing is collected. Column names match the SQL's aliases.
"""

from __future__ import annotations

from tonemill.lexicon import COVERAGE_LEXICON, DEFAULT_LEXICON
from tonemill.operators import labeling, report
from tonemill.plans.registry import query
from tonemill.plans.sql import pct, py_round_sql, rules_ctes
from tonemill.sources.tables import load_table

DOC_COLS = "doc_id, text, lang, source, n_chars"


def documents(spark, sf_dir):
    return load_table(spark, sf_dir, "documents")


def labeled_documents(spark, sf_dir, lexicon=DEFAULT_LEXICON):
    return labeling.label_rules(documents(spark, sf_dir), "text", lexicon)


def _rules_sql(select: str, lexicon=DEFAULT_LEXICON, src: str = "documents", tail: str = "") -> str:
    return f"WITH {rules_ctes(src, 'text', lexicon).strip()}\nSELECT {select} FROM r {tail}"


LABELED_SQL_COLS = f"{DOC_COLS}, r_label AS label, {pct('r_conf')} AS confidence"


# --- T10: the rule labeler -------------------------------------------------
@query("label_rules", _rules_sql(LABELED_SQL_COLS))
def q_label_rules(spark, sf_dir):
    return labeled_documents(spark, sf_dir)


@query("label_rules_coverage", _rules_sql(LABELED_SQL_COLS, COVERAGE_LEXICON))
def q_label_rules_coverage(spark, sf_dir):
    return labeled_documents(spark, sf_dir, COVERAGE_LEXICON)


# --- A1: label counts -------------------------------------------------------
_COUNTS_SQL = """
WITH {ctes}
SELECT d.label, CAST(coalesce(sum(CASE WHEN r.r_label = d.label THEN 1 ELSE 0 END), 0) AS BIGINT) AS n
FROM (VALUES ('Positive'), ('Negative'), ('Neutral')) AS d(label) LEFT JOIN r ON r.r_label = d.label
GROUP BY d.label"""


@query("label_counts", _COUNTS_SQL.format(ctes=rules_ctes("documents").strip()))
def q_label_counts(spark, sf_dir):
    return report.label_counts(labeled_documents(spark, sf_dir))


@query("label_counts_coverage", _COUNTS_SQL.format(ctes=rules_ctes("documents", "text", COVERAGE_LEXICON).strip()))
def q_label_counts_coverage(spark, sf_dir):
    return report.label_counts(labeled_documents(spark, sf_dir, COVERAGE_LEXICON))


# --- A2-A5: report ----------------------------------------------------------
_MEAN = "CAST(sum(CAST(round(confidence * 100.0) AS BIGINT)) AS DOUBLE) / count(confidence) / 100.0"
_AVG = f"{_MEAN} END AS avg_confidence, CASE WHEN count(confidence) > 0 THEN {py_round_sql(_MEAN, 1)} END AS avg_confidence_display"
_SHARE = py_round_sql("CAST(n AS DOUBLE) / total * 100.0", 1)
_STATS_SQL = """
WITH {ctes}, l AS (SELECT {pct} AS confidence FROM r)
SELECT CAST(count(*) AS BIGINT) AS total,
       CASE WHEN count(confidence) > 0 THEN {avg},
       CAST(count_if(confidence >= 85.0) AS BIGINT) AS high_count,
       CAST(count_if(confidence >= 90.0) AS BIGINT) AS very_high_count,
       CAST(count_if(confidence < 60.0) AS BIGINT) AS low_count
FROM l"""


@query("confidence_stats", _STATS_SQL.format(ctes=rules_ctes("documents").strip(), pct=pct("r_conf"), avg=_AVG))
def q_confidence_stats(spark, sf_dir):
    return report.confidence_stats(labeled_documents(spark, sf_dir))


_DIST_SQL = """
WITH {ctes}, c AS (SELECT count(*) AS total,
    count_if(r_label = 'Positive') AS p, count_if(r_label = 'Negative') AS n, count_if(r_label = 'Neutral') AS u FROM r),
k AS (SELECT 'Positive' AS label, p AS n, total FROM c UNION ALL SELECT 'Negative', n, total FROM c
      UNION ALL SELECT 'Neutral', u, total FROM c)
SELECT label, CAST(n AS BIGINT) AS n,
       CASE WHEN total > 0 THEN {share} ELSE 0.0 END AS share
FROM k"""


@query("label_distribution", _DIST_SQL.format(ctes=rules_ctes("documents").strip(), share=_SHARE))
def q_label_distribution(spark, sf_dir):
    return report.label_distribution(labeled_documents(spark, sf_dir))
