"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import alignment, bpe, decontam, langid, licenses, quality, simhash, suffix_dedup, token_counts, topk, toxicity, warc_zip, whitening
from tonemill.llm.ragged import table, train_rows, written
from tonemill.session import scratch_path

LLM_QUERIES: dict = {}
LLM_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLE[name] = sql
        return fn

    return add


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids again; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, vocabulary=bpe.default_vocabulary(), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document (majority rule at boundaries)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary=bpe.default_vocabulary())


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and its component over links of 3 bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs, shingle=3, max_bits=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def held_out(folds: int, held: int):
    return (~train_rows(F.col("doc_id"), folds, held)).alias("held_out")


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(quality.with_statistics(docs).select("doc_id", "statistics"), "statistics")
    labels = table(spark, sf_dir, "labels").where(train_rows(F.col("doc_id"), 5, 0))
    model = quality.fit(quality.labelled(stats, labels, "quality"))
    return quality.with_score(stats, model).select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document's restored text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(train_rows(F.col("doc_id"), 5, 0))
    model = toxicity.character_model(docs)
    scorer = toxicity.fit(docs, labels, model)
    return toxicity.with_score(docs, model, scorer).select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(train_rows(F.col("doc_id"), 4, 2)))
    return langid.with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2), "lang_pred", "score")


@query("op7_suffix_dedup", """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT rid, b, unnest(range(octet_length(b) - 399)) AS i FROM docs WHERE octet_length(b) >= 400),
counted AS (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM (SELECT rid, i, md5(b[i + 1:i + 400]) AS h FROM starts)),
repeated AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM counted WHERE n > 1),
numbered AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM repeated),
runs AS (SELECT rid, min(i) AS a, max(i) + 400 AS z FROM numbered GROUP BY rid, run),
gone AS (SELECT rid, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS begins, list(z ORDER BY a) AS ends FROM runs GROUP BY rid),
kept AS (SELECT doc_id, b, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  list_concat([0], coalesce(ends, [])) AS froms, list_concat(coalesce(begins, []), [octet_length(b)]) AS upto FROM docs LEFT JOIN gone USING (rid)),
pieces AS (SELECT *, list_transform(range(1, len(froms) + 1), lambda k: CASE WHEN froms[k] < upto[k] THEN hex(b[froms[k] + 1:upto[k]]) ELSE '' END) AS left_over FROM kept)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, n_removed, n_spans, sha256(unhex(array_to_string(left_over, ''))) AS kept_sha256,
  decode(unhex(array_to_string(list_transform(left_over, lambda h: regexp_replace(regexp_replace(h, '^([89AB].)+', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', '')), ''))) AS text
FROM pieces
""")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left after repeated 400-byte strings are cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.strip_repeats(docs, length=400, without=("text", "kept"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_text").alias("text"))


@query("op10_decontam")
def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in its own or in other values."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.matches(docs, table(spark, sf_dir, "benchmark"))


@query("op9_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 10
""")
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every hundredth vector against all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024)


def license_sql() -> str:
    """Plain SQL for the license scan: every block of every text that holds a
    template's telling words against the template."""
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES)
    templates = ", ".join(f"({i}, '{t.label}', '{t.body}', '{t.telling}', '{t.barred}')" for i, t in enumerate(licenses.TEMPLATES))
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {words.format("coalesce(text, '')")} AS w FROM documents),
phrases AS (SELECT string_split(col0, ' ') AS p, col1 AS label FROM (VALUES {phrases})),
templates AS (
  SELECT col0 AS template, col1 AS label, list_distinct(string_split(col2, ' ')) AS body, len(string_split(col2, ' ')) * 3 // 2 AS span, string_split(col3, ' ') AS telling,
    string_split(col4, ' ') AS barred FROM (VALUES {templates})
),
starts AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) AS i FROM docs, phrases),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM starts GROUP BY doc_id),
blocks AS (
  SELECT doc_id, template, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(body, w[i])), lambda i: w[i:i + span - 1])) AS block
  FROM docs JOIN templates ON list_has_all(w, telling)
),
near AS (
  SELECT doc_id, label, len(list_intersect(list_distinct(block), body)) AS n, len(body) AS size FROM blocks JOIN templates USING (template)
  WHERE list_has_all(block, telling) AND NOT list_has_any(block, barred)
),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(n / size) AS best FROM near WHERE n >= ceil({licenses.THRESHOLD} * size - 1e-9) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


@query("op6_licenses", license_sql())
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template lines of every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and linked ids of two tokenizers over every document."""
    return alignment.alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=16, scale=64)


@query("op13_warc")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record into ZIP archives and read back."""
    path = scratch_path(spark, "archives")
    warc_zip.write_archives(table(spark, sf_dir, "pages"), path, "page_id", "url", "html", least_bytes=0)
    name = lambda column: warc_zip.page_name(F.col(column)).cast("long")
    out = warc_zip.read_archives(spark, path, payloads=False)
    return out.select(name("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", name("refers_to").alias("refers_to"))
