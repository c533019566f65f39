"""License scans: phrase places and an exact set-similarity join (DataFrame only).

Words are runs of ASCII letters and digits and of characters beyond ASCII, with
A-Z lower-cased. Two findings per document:

* *Base*: the places where the words of a fixed phrase stand consecutively.
* *Join*: text blocks that hold at least ``threshold`` of the distinct words of a
  license template. A block of a template begins at any of the template's words
  and has half as many words again as the template, whatever line ends lie
  between. It must hold all of the template's *telling* words, without which the
  rest could speak of another license, and none of its *barred* words, which
  name a variant. Both sides' words are ordered by their frequency over all
  documents, rarest first. A block that reaches the threshold must share a word
  with the template's *prefix* (its ``n - need + 1`` rarest words); it must have
  at least ``need`` template words (*length* filter); and where the first shared
  word is the template's ``i``-th and the block's ``j``-th, only the words after
  both can add to the overlap (*positional* filter). Candidates that pass are
  verified by their whole word sets.

Texts without a prefix word of some template never build their words. The others
are cut into pieces of ``PIECE`` block starts (with the words that blocks from
there on reach), so a row stays small however long its text; the join with the
templates is a broadcast of a handful of rows, and the frequencies counted are
those of the templates' words. Documents are told apart by their key and text.

Defined cases: null and empty texts have no words, places or labels and score 0;
repeated rows give repeated rows of the result; blocks that reach several
templates give all their labels; a block at the end of a text is shorter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.llm.ragged import written

# The phrases of the base scan and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


class Template(NamedTuple):
    """A template's words, those that a block must hold, and those it must not."""

    label: str
    body: str
    telling: str = ""
    barred: str = ""


# The templates of the join.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission hereby granted software", "organization font"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless law license basis"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", "sa nd"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial", "sharealike noderivatives noderivs"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general 3", "lesser affero library"),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3", "gnu general 3", "lesser affero library"),
    Template("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", "gnu general 2", "lesser affero library"),
    Template("bsd", "released under the bsd license", "bsd license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution source binary permitted"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2"),
)
THRESHOLD = 0.8
PIECE = 256
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda w: w != "")


def phrase_pattern(phrase: str) -> str:
    """The phrase's words with any gaps, in any ASCII case, not inside longer words."""
    return rf"(?i)(?<!{WORD}){GAP.join(phrase.split(' '))}(?!{WORD})"


def count_words(text: Column) -> Column:
    """Number of words, without building them in lower case."""
    parts = F.split(text, GAP)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def places(tokens: str, phrase: str) -> Column:
    """Starts (from 0) of the phrase in the array column ``tokens``."""
    parts = phrase.split(" ")
    at = F.filter(F.transform(F.col(tokens), lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.filter(at, lambda i: F.slice(F.col(tokens), i + 1, len(parts)) == F.array(*[F.lit(p) for p in parts]))


def base_scan(texts: DataFrame) -> DataFrame:
    """(row, n_words, n_base, first_word, last_word, base): word counts and
    phrase places. Texts without any phrase never build their word arrays."""
    found = texts.withColumn("hit", F.coalesce(F.col("text"), F.lit("")).rlike("|".join(phrase_pattern(p) for p, _ in PHRASES)))
    found = found.withColumn("tokens", F.when(F.col("hit"), words(F.col("text"))).otherwise(F.array().cast("array<string>")))
    found = found.withColumns({f"p{k}": places("tokens", p) for k, (p, _) in enumerate(PHRASES)})
    every = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    labels = F.filter(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    return found.select("row", "text", F.coalesce(count_words(F.col("text")), F.lit(0)).cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
                        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))


def template_table(frequency: DataFrame, templates, threshold: float) -> DataFrame:
    """(template, label, n, need, span, telling, barred, pairs): each template's
    distinct words, rarest first, the overlap that reaches the threshold, and the
    words of a block."""
    spark = frequency.sparkSession
    rows = [(i, t.label, t.body, len(t.body.split()) * 3 // 2, t.telling.split(), t.barred.split()) for i, t in enumerate(Template(*t) for t in templates)]
    rows = spark.createDataFrame(rows, "template int, label string, body string, span int, telling array<string>, barred array<string>")
    same = ["template", "label", "span", "telling", "barred"]
    each = rows.select(*same, F.explode(F.array_distinct(words(F.col("body")))).alias("word")).join(frequency, "word", "left")
    each = each.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("pairs"))
    n = F.size("pairs")
    return each.select(*same, n.alias("n"), F.ceil(F.lit(threshold) * n - 1e-9).cast("int").alias("need"), "pairs")


def word_frequency(texts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, n): documents that hold each of these words, over all documents.
    The order made of them needs no exact case rule, so plain ``lower`` does."""
    held = F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.split(F.lower("text"), GAP))
    return texts.where("text is not null").select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pieces(texts: DataFrame, span: int) -> DataFrame:
    """(row, tokens, n_starts): each text's words in pieces of PIECE block starts,
    with the ``span - 1`` words that blocks from there on reach."""
    tokens = texts.select("row", words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    cut = lambda b: F.struct(F.slice("tokens", b, F.lit(PIECE + span - 1)).alias("piece"))
    cut = tokens.select("row", F.inline(F.transform(F.sequence(F.lit(1), F.size("tokens"), F.lit(PIECE)), cut)))
    return cut.select("row", F.col("piece").alias("tokens"), F.least(F.size("piece"), F.lit(PIECE)).alias("n_starts"))


def matching_blocks(texts: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, label, containment) of every block that holds ``threshold`` of a
    template's distinct words, all telling ones and no barred one."""
    vocabulary = sorted({w for t in templates for w in t[1].split()})
    frequency = written(word_frequency(texts, vocabulary), "word_frequency")
    rules = template_table(frequency, templates, threshold).collect()  # one row per template
    rank = {w: i for i, (_, w) in enumerate(sorted({(p.n, p.word) for r in rules for p in r.pairs}))}
    prefix = {r.template: [p.word for p in r.pairs[:r.n - r.need + 1]] for r in rules}
    prefix_words = sorted({w for ws in prefix.values() for w in ws}, key=rank.get)
    any_prefix = rf"(?i)(?<!{WORD})(?:{'|'.join(prefix_words)})(?!{WORD})"
    array = lambda ws: F.array(*[F.lit(w) for w in ws])
    index = texts.sparkSession.createDataFrame(
        [(w, prefix[r.template], r.label, r.n, r.need, r.span, r.telling, r.barred, [p.word for p in r.pairs]) for r in rules for w in prefix[r.template]],
        "word string, prefix array<string>, label string, n int, need int, span int, telling array<string>, barred array<string>, body array<string>")

    holding = lambda ws, column: F.size(F.array_intersect(ws, column)) == F.size(ws)
    held = pieces(texts.where(F.col("text").rlike(any_prefix)), max(r.span for r in rules)).withColumn("shared", F.array_intersect(array(prefix_words), "tokens"))
    probes = held.where(F.size("shared") > 0).select("row", "tokens", "n_starts", F.explode("shared").alias("word")).join(F.broadcast(index), "word")
    # A piece meets a template once: by the rarest prefix word that they share.
    probes = probes.where((F.get(F.array_intersect("prefix", "tokens"), F.lit(0)) == F.col("word")) & holding("telling", "tokens"))
    starts = F.filter(F.sequence(F.lit(1), F.col("n_starts")), lambda i: F.array_contains("body", F.element_at("tokens", i)))
    blocks = probes.select("row", "label", "n", "need", "telling", "barred", "body", "prefix", F.explode(F.transform(starts, lambda i: F.slice("tokens", i, F.col("span")))).alias("block"))
    # A word of no template never adds to an overlap, so ordering the rest is enough.
    blocks = blocks.withColumns({"ordered": F.array_intersect(array(sorted(rank, key=rank.get)), "block"), "first": F.get(F.array_intersect("prefix", "block"), F.lit(0))})
    length = F.size("ordered") >= F.col("need")
    i, j = F.array_position("body", F.col("first")) - 1, F.array_position("ordered", F.col("first")) - 1
    position = F.least(F.size("ordered") - j, F.col("n") - i) >= F.col("need")
    near = blocks.where(F.col("first").isNotNull() & length & position & holding("telling", "block") & ~F.arrays_overlap("barred", "block"))
    overlap = F.size(F.array_intersect("ordered", "body"))
    return near.withColumn("overlap", overlap).where("overlap >= need").select("row", "label", (F.col("overlap") / F.col("n")).alias("containment"))


def scan(df: DataFrame, key: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: key, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels`` (base and join), ``score``: 1 with a base place,
    else the best containment found, else 0."""
    row = F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    texts = df.select(row.alias("row"), F.col(text_col).alias("text"))
    found = matching_blocks(texts, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = base_scan(texts).drop("text")
    same = F.col("row.text_hash").eqNullSafe(F.col("m_row.text_hash")) & F.col("row.id").eqNullSafe(F.col("m_row.id"))
    out = base.join(found.withColumnRenamed("row", "m_row"), same, "left")
    labels = F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(F.col("row.id").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
