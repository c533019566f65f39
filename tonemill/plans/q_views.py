"""Queries: rule features, the review view, report, filters and positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions.report import confidence_band
from tonemill.lexicon import COVERAGE_LEXICON
from tonemill.operators import labeling, lexicon_scan, live_report, report, row_index, schema, views
from tonemill.plans.fixtures import review_view, review_view_sql
from tonemill.plans.registry import ORACLE, query
from tonemill.plans.sql import _any, _count, _hits, d, pct, py_round_sql, rules_ctes
from tonemill.session import keep_table, scratch_path
from tonemill.sources.tables import load_table

REVIEW_SRC = f"src AS ({review_view_sql()}),"
REVIEW_LABELED = f"WITH {REVIEW_SRC} {rules_ctes('src').strip()}, lab AS MATERIALIZED (SELECT doc_id, text, lang, source, n_chars, r_label AS label, {pct('r_conf')} AS confidence FROM r)"
LAB_COLS = "doc_id, text, lang, source, n_chars, label, confidence"


def labeled_reviews(spark, sf_dir):
    return labeling.label_rules(review_view(spark, sf_dir))


# --- T2, T4, T6: rule features (coverage lexicon) ---------------------------
def _features(spark, sf_dir):
    return labeling.rule_features(load_table(spark, sf_dir, "documents"), "text", COVERAGE_LEXICON)


_LT = "lower(coalesce(text, 'nan'))"
_PADDED = f"(' ' || {_LT} || ' ')"


@query("lexicon_hits", f"SELECT doc_id, {_hits(_PADDED, COVERAGE_LEXICON.positive)} AS pos_hits, "
                       f"{_hits(_PADDED, COVERAGE_LEXICON.negative)} AS neg_hits FROM documents")
def q_lexicon_hits(spark, sf_dir):
    return _features(spark, sf_dir).select("doc_id", "pos_hits", "neg_hits")


@query("negation_flag", f"SELECT doc_id, {_any(_LT, COVERAGE_LEXICON.negations)} AS negated FROM documents")
def q_negation_flag(spark, sf_dir):
    return _features(spark, sf_dir).select("doc_id", "negated")


@query("amplifier_count", f"SELECT doc_id, {_count(_LT, COVERAGE_LEXICON.amplifiers)} AS amplifiers FROM documents")
def q_amplifier_count(spark, sf_dir):
    return _features(spark, sf_dir).select("doc_id", "amplifiers")


# --- T10 on the review view and the report over it ---------------------------
@query("label_rules_reviews", f"{REVIEW_LABELED} SELECT {LAB_COLS} FROM lab")
def q_label_rules_reviews(spark, sf_dir):
    return labeled_reviews(spark, sf_dir)


@query("report_reviews", f"""{REVIEW_LABELED}
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(label = 'Positive') AS BIGINT) AS positive,
       CAST(count_if(label = 'Negative') AS BIGINT) AS negative,
       CAST(count_if(label = 'Neutral') AS BIGINT) AS neutral,
       CAST(count_if(confidence >= 85.0) AS BIGINT) AS high_count,
       CAST(count_if(confidence >= 90.0) AS BIGINT) AS very_high_count,
       CAST(count_if(confidence < 60.0) AS BIGINT) AS low_count,
       CASE WHEN count(confidence) > 0 THEN CAST(sum(CAST(round(confidence * 100.0) AS BIGINT)) AS DOUBLE) / count(confidence) / 100.0 END
         AS avg_confidence,
       {py_round_sql('CAST(sum(CAST(round(confidence * 100.0) AS BIGINT)) AS DOUBLE) / count(confidence) / 100.0', 1)}
         AS avg_confidence_display
FROM lab""")
def q_report_reviews(spark, sf_dir):
    return report.report_metrics(labeled_reviews(spark, sf_dir))


# --- A1-A5 kept up to date: two deliveries of files, the second one read alone ------
@query("live_report", ORACLE["report_reviews"])
def q_live_report(spark, sf_dir):
    folder, rows = scratch_path(spark, "deliveries"), review_view(spark, sf_dir)
    kept = live_report.LiveReport(spark, scratch_path(spark, "report"))
    for k in range(2):
        rows.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(folder)
        kept.update(folder)
    return kept.report(folder)


# --- P6: confidence band -------------------------------------------------------
@query("confidence_band", f"""{REVIEW_LABELED}
SELECT doc_id, confidence, CASE WHEN confidence >= 85.0 THEN 'high' WHEN confidence >= 60.0 THEN 'medium'
       ELSE 'low' END AS band FROM lab""")
def q_confidence_band(spark, sf_dir):
    return labeled_reviews(spark, sf_dir).select("doc_id", "confidence", confidence_band("confidence").alias("band"))


# --- F1-F5: filters ------------------------------------------------------------
@query("high_confidence", f"{REVIEW_LABELED} SELECT {LAB_COLS} FROM lab WHERE confidence >= 85.0")
def q_high_confidence(spark, sf_dir):
    return views.high_confidence(labeled_reviews(spark, sf_dir))


@query("very_high_confidence", f"{REVIEW_LABELED} SELECT {LAB_COLS} FROM lab WHERE confidence >= 90.0")
def q_very_high_confidence(spark, sf_dir):
    return views.very_high_confidence(labeled_reviews(spark, sf_dir))


@query("low_confidence", f"{REVIEW_LABELED} SELECT {LAB_COLS} FROM lab WHERE confidence < 60.0")
def q_low_confidence(spark, sf_dir):
    return views.low_confidence(labeled_reviews(spark, sf_dir))


FILTER_LABELS = ("Positive", "Negative")
FILTER_MIN = 70


@query("filter_labeled", f"{REVIEW_LABELED} SELECT {LAB_COLS} FROM lab "
                         f"WHERE label IN ('Positive', 'Negative') AND confidence >= {d(FILTER_MIN)}")
def q_filter_labeled(spark, sf_dir):
    return views.filter_labeled(labeled_reviews(spark, sf_dir), FILTER_LABELS, FILTER_MIN)


@query("filter_labeled_none", f"{REVIEW_LABELED} SELECT {LAB_COLS} FROM lab WHERE FALSE")
def q_filter_labeled_none(spark, sf_dir):
    return views.filter_labeled(labeled_reviews(spark, sf_dir), [], 0)


@query("filter_counts", f"""{REVIEW_LABELED}
SELECT CAST(count_if(label IN ('Positive', 'Negative') AND confidence >= {d(FILTER_MIN)}) AS BIGINT) AS shown,
       CAST(count(*) AS BIGINT) AS total FROM lab""")
def q_filter_counts(spark, sf_dir):
    return report.filter_counts(labeled_reviews(spark, sf_dir), views.label_filter(FILTER_LABELS, FILTER_MIN))


# --- W1-W4: positions --------------------------------------------------------
ROW_AT = 123
PAGE_OFFSET, PAGE_SIZE = 100, 25


@query("head", f"{REVIEW_LABELED} SELECT {LAB_COLS} FROM lab ORDER BY doc_id LIMIT 5")
def q_head(spark, sf_dir):
    return views.head(labeled_reviews(spark, sf_dir), "doc_id", 5)


_INDEXED = f"{REVIEW_LABELED}, ix AS (SELECT doc_id, text, label, confidence, " \
           f"CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_idx FROM lab)"


@query("row_at", f"{_INDEXED} SELECT doc_id, text, label, confidence, row_idx, row_idx + 1 AS position "
                 f"FROM ix WHERE row_idx = {ROW_AT}")
def q_row_at(spark, sf_dir):
    labeled = labeled_reviews(spark, sf_dir).select("doc_id", "text", "label", "confidence")
    return views.row_at(views.page_at(labeled, "doc_id", ROW_AT, 1), ROW_AT)


@query("preview_page", f"{_INDEXED} SELECT doc_id, text, label, confidence, row_idx FROM ix "
                       f"WHERE row_idx >= {PAGE_OFFSET} AND row_idx < {PAGE_OFFSET + PAGE_SIZE}")
def q_preview_page(spark, sf_dir):
    labeled = labeled_reviews(spark, sf_dir).select("doc_id", "text", "label", "confidence")
    return views.page_at(labeled, "doc_id", PAGE_OFFSET, PAGE_SIZE)


@query("pages_of_kept_index", f"{_INDEXED} SELECT doc_id, text, label, confidence, row_idx FROM ix WHERE row_idx = {ROW_AT} "
                              f"OR (row_idx >= {PAGE_OFFSET} AND row_idx < {PAGE_OFFSET + PAGE_SIZE})")
def q_pages_of_kept_index(spark, sf_dir):
    # Built once; the row and the page are pruned scans of what was written.
    path = scratch_path(spark, "row-index")
    row_index.build(labeled_reviews(spark, sf_dir).select("doc_id", "text", "label", "confidence"), "doc_id", path)
    index = row_index.RowIndex(spark, path)
    return index.row_at(ROW_AT).drop("position").unionByName(index.page(PAGE_OFFSET, PAGE_SIZE)).distinct()


@query("row_index", f"{_INDEXED} SELECT doc_id, text, label, row_idx FROM ix")
def q_row_index(spark, sf_dir):
    return views.with_row_index(labeled_reviews(spark, sf_dir), "doc_id").select("doc_id", "text", "label", "row_idx")


# --- P1-P3: schema -----------------------------------------------------------
@query("ensure_text", f"""WITH src AS (SELECT page_id, url, html AS text FROM pages), {rules_ctes('src').strip()}
SELECT page_id, url, text, r_label AS label, {pct('r_conf')} AS confidence FROM r""")
def q_ensure_text(spark, sf_dir):
    pages = schema.ensure_text(load_table(spark, sf_dir, "pages"), "html")
    return labeling.label_rules(pages)


@query("with_label_slots", "SELECT doc_id, text, lang, source, n_chars, '' AS label, "
                           "CAST(0.0 AS DOUBLE) AS confidence FROM documents")
def q_with_label_slots(spark, sf_dir):
    return schema.with_label_slots(load_table(spark, sf_dir, "documents"))


@query("label_conversations", f"""WITH src AS (SELECT * FROM conversations), {rules_ctes('src').strip()}
SELECT conv_id, turn, role, r_label AS label, {pct('r_conf')} AS confidence FROM r""")
def q_label_conversations(spark, sf_dir):
    conv = load_table(spark, sf_dir, "conversations")
    return labeling.label_rules(conv).select("conv_id", "turn", "role", "label", "confidence")



# --- Keep the labeled table, then report from the stored rows ---------------
@query("kept_report", f"""{REVIEW_LABELED}
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count_if(label = 'Positive') AS BIGINT) AS positive,
       CAST(count_if(label = 'Negative') AS BIGINT) AS negative,
       CAST(count_if(label = 'Neutral') AS BIGINT) AS neutral,
       CAST(count_if(confidence >= 85.0) AS BIGINT) AS high_count,
       CAST(count_if(confidence >= 90.0) AS BIGINT) AS very_high_count,
       CAST(count_if(confidence < 60.0) AS BIGINT) AS low_count,
       CASE WHEN count(confidence) > 0 THEN CAST(sum(CAST(round(confidence * 100.0) AS BIGINT)) AS DOUBLE) / count(confidence) / 100.0 END
         AS avg_confidence,
       {py_round_sql('CAST(sum(CAST(round(confidence * 100.0) AS BIGINT)) AS DOUBLE) / count(confidence) / 100.0', 1)}
         AS avg_confidence_display
FROM lab""")
def q_kept_report(spark, sf_dir):
    kept = keep_table(labeled_reviews(spark, sf_dir))
    return report.report_metrics(kept)


KEYSET_AFTER = 500


@query("page_after", f"{REVIEW_LABELED} SELECT {LAB_COLS} FROM lab WHERE doc_id > {KEYSET_AFTER} "
                     f"ORDER BY doc_id LIMIT {PAGE_SIZE}")
def q_page_after(spark, sf_dir):
    return views.page_after(labeled_reviews(spark, sf_dir), "doc_id", KEYSET_AFTER, PAGE_SIZE)


# --- W2: all pages of a table, forward and back, by keys that repeat and are null ----
_WALKED = "CASE WHEN turn % 3 <> 0 THEN role END"


@query("walk_pages", f"SELECT way, conv_id, turn, {_WALKED} AS speaker FROM conversations, (VALUES ('next'), ('previous')) w(way)")
def q_walk_pages(spark, sf_dir):
    # Keys (speaker, turn) repeat across conversations and are null; pages of an eighth of the rows.
    conv = load_table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_WALKED} AS speaker")
    size, pages = -(-conv.count() // 8), []
    for way, end in (("next", -1), ("previous", 0)):
        cursor = None
        while True:
            page = views.page_by_cursor(conv, ["speaker", "turn"], cursor, size, way)
            edge = page.select("speaker", "turn").collect()[end:][:1]  # bounded by the page
            if not edge:
                break
            pages.append(page.select(F.lit(way).alias("way"), "conv_id", "turn", "speaker"))
            cursor = tuple(edge[0])
    return reduce(DataFrame.unionByName, pages) if pages else conv.selectExpr("CAST(NULL AS STRING) AS way", "*")


# --- T2, T4, T6 with a large lexicon: 20,000 words of the corpus and phrases --------
LEXICON_WORDS = 20_000
_CORPUS_LEXICON = f"""t AS (SELECT doc_id, {_LT} AS t FROM documents),
w AS (SELECT DISTINCT doc_id, unnest(string_split(t, ' ')) AS entry FROM t),
words AS (SELECT entry FROM (SELECT DISTINCT entry FROM w WHERE entry <> '') ORDER BY md5(entry) LIMIT {LEXICON_WORDS}),
phrases AS (SELECT DISTINCT s[1] || ' ' || s[2] AS entry FROM (SELECT string_split(t, ' ') AS s FROM t) WHERE len(s) > 1 AND s[1] <> '' AND s[2] <> ''),
lex AS (SELECT entry, CASE WHEN md5(entry) < '8' THEN 'pos' ELSE 'neg' END AS kind FROM (SELECT * FROM words UNION SELECT * FROM phrases))"""


@query("lexicon_hits_large", f"""WITH {_CORPUS_LEXICON},
hits AS (SELECT w.doc_id, kind FROM w JOIN lex USING (entry)
  UNION ALL SELECT t.doc_id, kind FROM t JOIN lex ON contains(entry, ' ') AND contains(' ' || t || ' ', ' ' || entry || ' ')),
n AS (SELECT doc_id, count_if(kind = 'pos') AS p, count_if(kind = 'neg') AS n FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(p, 0) AS INTEGER) AS pos_hits, CAST(coalesce(n, 0) AS INTEGER) AS neg_hits FROM t LEFT JOIN n USING (doc_id)""")
def q_lexicon_hits_large(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    parts = docs.select(F.split(F.lower(F.coalesce("text", F.lit("nan"))), " ").alias("s"))
    words = parts.select(F.explode("s").alias("entry")).where("entry <> ''").distinct().orderBy(F.md5(F.col("entry").cast("binary"))).limit(LEXICON_WORDS)
    phrases = parts.where("size(s) > 1 AND s[0] <> '' AND s[1] <> ''").select(F.concat_ws(" ", F.col("s")[0], F.col("s")[1]).alias("entry")).distinct()
    entries = keep_table(words.union(phrases).select("entry", F.when(F.md5(F.col("entry").cast("binary")) < "8", "pos").otherwise("neg").alias("kind")))
    return lexicon_scan.lexicon_counts(docs, entries, ["pos", "neg"]).select("doc_id", "pos_hits", "neg_hits")
