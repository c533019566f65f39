"""Queries: ingest (S1-S9), exports (K1-K6) and the streaming path.

Each writes its input files from ``documents`` below the shared checkpoint
folder, then reads them back through the operator under test, so the work
grows with the table.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F

from tonemill.operators import labeling
from tonemill.plans.fixtures import review_view, review_view_sql
from tonemill.plans.registry import query
from tonemill.plans.sql import d, pct, q, rules_ctes
from tonemill.session import scratch_path
from tonemill.sinks import csv as sinks
from tonemill.sources.reviews import NA_VALUES, read_reviews
from tonemill.sources.tables import load_table
from tonemill.streaming.labels import label_files_once

_NA_SQL = ", ".join(q(v) for v in NA_VALUES)
_TEXT_NA = f"CASE WHEN text IN ({_NA_SQL}) THEN NULL ELSE text END"
_DOCS_AS_READ = f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_TEXT_NA} AS text FROM documents"


def _labeled_sql(src_sql: str, cols: str) -> str:
    return f"WITH src AS ({src_sql}), {rules_ctes('src').strip()} SELECT {cols}, r_label AS label, " \
           f"{pct('r_conf')} AS confidence FROM r"


# --- K1 + S1/S2/S9: export, then read back tolerantly ------------------------
@query("read_reviews", _labeled_sql(_DOCS_AS_READ, "doc_id, text"))
def q_read_reviews(spark, sf_dir):
    path = scratch_path(spark, "documents-csv")
    sinks.export_csv(load_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return labeling.label_rules(read_reviews(spark, path))


# --- S2: quoted newlines in files that many tasks share -----------------------
_BROKEN = "replace(replace(text, ', ', ',' || chr(10)), '. ', '.' || chr(10) || '\"')"


@query("read_quoted_newlines", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN {_BROKEN} IN ({_NA_SQL}) THEN NULL ELSE {_BROKEN} END AS text FROM documents")
def q_read_quoted_newlines(spark, sf_dir):
    path = scratch_path(spark, "quoted-newlines-csv")
    broken = F.replace(F.replace("text", F.lit(", "), F.lit(",\n")), F.lit(". "), F.lit('.\n"'))
    sinks.export_csv(load_table(spark, sf_dir, "documents").select("doc_id", broken.alias("text")), path)
    return read_reviews(spark, path, multi_line="split").select("doc_id", "text")


# --- S3: records with too many fields are skipped, short ones padded ----------
BAD_EVERY, LONG_AT, SHORT_AT, BLANK_AT, INNER_AT, SPACES_AT = 13, 4, 7, 9, 5, 2
HEADER = "doc_id,text"


def _with_header(batches):
    first = True
    for pdf in batches:
        if first:
            pdf = pd.concat([pd.DataFrame({"value": [HEADER]}), pdf], ignore_index=True)
            first = False
        yield pdf


def _malformed_lines(docs):
    field = F.concat(F.lit('"'), F.regexp_replace("text", '"', '""'), F.lit('"'))
    good = F.concat(F.col("doc_id").cast("string"), F.lit(","), field)
    k = F.col("doc_id") % F.lit(BAD_EVERY)
    line = (
        F.when(k == LONG_AT, F.concat(good, F.lit(",extra")))
        .when(k == SHORT_AT, F.col("doc_id").cast("string"))
        .when(k == BLANK_AT, F.concat(F.lit("\n"), good))
        .when(k == SPACES_AT, F.concat(F.lit("   \n"), good))
        .when(k == INNER_AT, F.concat(F.col("doc_id").cast("string"), F.lit(',say "hi, there" now')))
        .otherwise(good)
    )
    # Every part file starts with the header line.
    return docs.select(line.alias("value")).mapInPandas(_with_header, "value string")


_SKIP_SRC = (f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % {BAD_EVERY} = {SHORT_AT} THEN NULL "
             f"ELSE {_TEXT_NA} END AS text FROM documents WHERE doc_id % {BAD_EVERY} NOT IN ({LONG_AT}, {INNER_AT})")


@query("skip_bad_lines", _labeled_sql(_SKIP_SRC, "doc_id, text"))
def q_skip_bad_lines(spark, sf_dir):
    path = scratch_path(spark, "malformed-txt")
    _malformed_lines(load_table(spark, sf_dir, "documents")).write.text(path)
    return labeling.label_rules(read_reviews(spark, path))


# --- S4: a Latin-1 file is detected and decoded --------------------------------
@query("encoding_fallback", _labeled_sql(_DOCS_AS_READ, "doc_id, text"))
def q_encoding_fallback(spark, sf_dir):
    path = scratch_path(spark, "latin1-csv")
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.write.option("header", True).option("quote", '"').option("escape", '"').option(
        "encoding", "ISO-8859-1").csv(path)
    return labeling.label_rules(read_reviews(spark, path))


# --- S1, S4-S6: every file has its own header, separator and encoding ------------
@query("read_mixed_folder", f"SELECT doc_id, text, CASE WHEN CAST(doc_id AS BIGINT) % 3 = 2 THEN lang END AS lang "
                            f"FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_TEXT_NA} AS text, lang FROM documents)")
def q_read_mixed_folder(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    part = F.col("doc_id") % 3
    base = scratch_path(spark, "mixed-reviews")
    sinks.export_csv(docs.where(part == 0).select("doc_id", "text"), f"{base}/comma")
    sinks.export_csv(docs.where(part == 1).select("text", "doc_id"), f"{base}/tab", sep="\t", extension="tsv")
    sinks.export_csv(docs.where(part == 2).select("lang", "doc_id", "text"), f"{base}/latin", encoding="ISO-8859-1")
    return read_reviews(spark, [f"{base}/{name}" for name in ("comma", "tab", "latin")]).select("doc_id", "text", "lang")


# --- K1-K4, K6: exports of the labeled review view, read back ------------------
_REV_LAB = _labeled_sql(review_view_sql(), "doc_id, text")
_EXPORT_COLS = "doc_id, text, label, confidence"


def _labeled_reviews(spark, sf_dir):
    return labeling.label_rules(review_view(spark, sf_dir).select("doc_id", "text"))


def _read_back(spark, path):
    back = read_reviews(spark, path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label",
                       F.col("confidence").cast("double").alias("confidence"))


@query("export_all", _REV_LAB)
def q_export_all(spark, sf_dir):
    path = scratch_path(spark, "labeled-export")
    sinks.export_csv(_labeled_reviews(spark, sf_dir), path)
    return _read_back(spark, path)


@query("export_high", f"SELECT * FROM ({_REV_LAB}) WHERE confidence >= 85.0")
def q_export_high(spark, sf_dir):
    path = scratch_path(spark, sinks.HIGH_NAME)
    if not sinks.export_high(_labeled_reviews(spark, sf_dir), path):
        return _labeled_reviews(spark, sf_dir).limit(0)
    return _read_back(spark, path)


@query("export_very_high", f"SELECT * FROM ({_REV_LAB}) WHERE confidence >= 90.0")
def q_export_very_high(spark, sf_dir):
    path = scratch_path(spark, sinks.VERY_HIGH_NAME)
    if not sinks.export_very_high(_labeled_reviews(spark, sf_dir), path):
        return _labeled_reviews(spark, sf_dir).limit(0)
    return _read_back(spark, path)


@query("export_filtered", f"SELECT * FROM ({_REV_LAB}) WHERE label IN ('Negative', 'Neutral') "
                          f"AND confidence >= {d(60)}")
def q_export_filtered(spark, sf_dir):
    path = scratch_path(spark, sinks.FILTERED_NAME)
    if not sinks.export_filtered(_labeled_reviews(spark, sf_dir), path, ["Negative", "Neutral"], 60):
        return _labeled_reviews(spark, sf_dir).limit(0)
    return _read_back(spark, path)


@query("export_tiers", f"""SELECT *, CASE WHEN confidence >= 90.0 THEN 'very_high' ELSE 'high' END AS confidence_tier
FROM ({_REV_LAB}) WHERE confidence >= 85.0""")
def q_export_tiers(spark, sf_dir):
    path = scratch_path(spark, "tiers")
    sinks.export_tiers(_labeled_reviews(spark, sf_dir), path)
    back = sinks.read_tiers(spark, path, ["very_high", "high"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label",
                       F.col("confidence").cast("double").alias("confidence"), "confidence_tier")


# --- Streaming: the file stream gives the batch labels -------------------------
@query("label_rules_stream", _labeled_sql("SELECT doc_id, text, lang, source, n_chars FROM documents",
                                          "doc_id, text, lang, source, n_chars"))
def q_label_rules_stream(spark, sf_dir):
    # The table is a file or a folder of files. A stream takes a folder as it is, a
    # single file only as a pattern that matches it.
    docs = load_table(spark, sf_dir, "documents")
    return label_files_once(spark, os.path.join(sf_dir, "documents.parque[t]"), docs.schema)
