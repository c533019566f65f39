"""Benchmark decontamination by template canonicalisation (DataFrame only).

Numbers (digits, and the words up to twenty and the tens, which stand for their
digits), names (capitalised words wherever they stand, but for the ``OPENERS`` of
sentences) and units after a number become typed placeholders; the rest is
lower-cased words. Windows of ``window``
tokens of these templates are hashed on both sides and joined, so a question
whose numbers or names were exchanged still matches. Windows with fewer than
``LITERALS`` plain words (or, if shorter, with any slot) are too common as
templates; they are hashed with their slots' values and match verbatim only.
For each document and item

* ``coverage`` is the share of the item's distinct windows found, and
* ``consistency`` the share of slot pairs (value in the item, value at the same
  place in the document) that agree with the most frequent partner of the
  item's value: an item re-parameterised in earnest maps each of its values to
  one new value throughout.

A document is reported with an item if both reach their thresholds, over the
item's template windows or, if it has exact ones too, over all its windows, in
any of three readings: the first place of each window in the whole document, a
run of places in the item's order, or the places of one alignment (place less
start). So a copy counts whatever else of the template stands in the document.
The row gives the first of these readings that passes. Items with
fewer tokens than ``window`` use one window of their own length. Brief items, of
less than ``LEAST_EVIDENCE`` tokens (a number counts twice, as its value must be
the same), are common phrases inside a text ("Why?", "True or false?"): they are
found only in a document that is the item and nothing else. ``brief_items`` lists
them.

The window join carries keys, positions and hashes, no text. The benchmark's
windows are broadcast only up to ``BROADCAST_ROWS`` of them, and the reported
documents' keys likewise; beyond that both are shuffle joins. Texts are cut into
blocks of ``BLOCK`` tokens (the next ones overlap, so no window is lost). With
broadcast windows, only places whose first ``LEAD`` tokens begin some item window
are hashed in full: the hash of these tokens, one for each place and cheap, meets
the broadcast table first.

Defined cases: null and empty texts and items match nothing; a capitalised word
that is no opener and its lower-case form are different tokens; signs between words
do not count, so "12 * 34" is "12 + 34"; a repeated document row is reported
once per distinct text of its key; repeated items with one id count as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.llm.ragged import written

WINDOW = 8
LITERALS = 4
LEAD = 3
BLOCK = 256
LEAST_EVIDENCE = 5
COVERAGE, CONSISTENCY = 0.3, 0.8
BROADCAST_ROWS = 1_000_000
OWNER = ["doc_id", "text_hash", "item_id"]
READ = [*OWNER, "reading", "part"]
# Readings: by template windows, and those plus ALL by all windows.
WHOLE, RUN, ALIGNED, ALL = 0, 1, 2, 3
# Units of measure that become placeholders after a number.
UNITS = (
    "mm", "cm", "m", "km", "inches", "inch", "feet", "foot", "ft", "yards", "yard", "miles", "mile", "mg", "g", "kg", "grams", "gram", "kilograms", "kilogram",
    "tons", "ton", "pounds", "pound", "lb", "lbs", "ounces", "ounce", "oz", "ml", "l", "liters", "liter", "litres", "litre", "gallons", "gallon", "cups", "cup",
    "seconds", "second", "s", "minutes", "minute", "min", "hours", "hour", "h", "days", "day", "weeks", "week", "months", "month", "years", "year",
    "dollars", "dollar", "cents", "cent", "euros", "euro", "percent", "degrees", "degree", "mph", "kmh", "watts", "watt", "volts", "volt",
)
# Number words, and what they stand for.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
# Words that open sentences and are no names there.
OPENERS = (
    "a", "an", "the", "this", "that", "these", "those", "each", "every", "all", "both", "some", "any", "no", "none", "many", "most", "several", "few", "another", "other",
    "i", "he", "she", "it", "we", "they", "you", "his", "her", "its", "our", "their", "your", "my",
    "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "whether",
    "is", "are", "was", "were", "am", "be", "do", "does", "did", "has", "have", "had", "can", "could", "will", "would", "shall", "should", "may", "might", "must",
    "in", "on", "at", "by", "for", "from", "to", "of", "with", "without", "during", "after", "before", "since", "until", "under", "over", "between", "among", "into", "about", "as", "per",
    "and", "or", "but", "nor", "so", "if", "then", "than", "because", "although", "though", "while", "once", "unless", "however", "therefore", "thus", "hence", "also", "now", "here", "there", "not", "only", "just", "later", "next", "finally", "first", "second", "last", "yes",
    "true", "false", "answer", "question", "solve", "find", "compute", "calculate", "evaluate", "simplify", "determine", "prove", "show", "add", "subtract", "multiply", "divide", "let", "given", "suppose", "assume", "consider", "choose", "write", "explain", "describe", "name", "list", "complete",
)
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
UNIT = rf"(\u0002{NUMBER}\s?)((?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{Nd}}]))"
NAME = r"\p{Lu}(?<![\p{L}\p{M}].)\p{Ll}+(?!\p{L})"
MARKS = "\u0001\u0002\u0003"  # name, number, unit
PIECE = rf"\u0002{NUMBER}|[\u0001\u0003]\p{{L}}+|[\p{{L}}\p{{M}}]+"


def pieces(text: Column) -> Column:
    """Lower-cased words of a text; a placeholder's mark stands before its value."""
    text = F.regexp_replace(F.translate(text, MARKS, "   "), NAME, "\u0001$0")
    text = F.regexp_replace(F.regexp_replace(text, NUMBER, "\u0002$0"), UNIT, "$1\u0003$2")
    parts = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), F.lower)
    return F.element_at(F.transform(F.array(parts), read_words), 1)


def read_words(parts: Column) -> Column:
    """Openers among the pieces are plain words, number words numbers in digits,
    and a unit that is the next word after one its placeholder."""
    openers, counts = [f"\u0001{w}" for w in OPENERS], [m + w for w in NUMBER_WORDS for m in ("", "\u0001")]
    digits = F.create_map(*[F.lit(v) for w in counts for v in (w, f"\u0002{NUMBER_WORDS[w.lstrip(MARKS)]}")])

    def read(piece: Column, i: Column) -> Column:
        number = F.when(piece.isin(*counts), F.try_element_at(digits, piece))
        unit = piece.isin(*UNITS) & F.get(parts, i - 1).isin(*counts)
        known = number.when(piece.isin(*openers), F.substr(piece, F.lit(2))).when(unit, F.concat(F.lit("\u0003"), piece)).otherwise(piece)
        return F.when(piece.isin(*counts, *openers, *UNITS), known).otherwise(piece)  # one lookup for most pieces

    return F.transform(parts, read)


def is_slot(piece: Column) -> Column:
    return F.substring(piece, 1, 1).between("\u0001", "\u0003")


def as_token(piece: Column) -> Column:
    """A piece without its value, if it is a placeholder."""
    return F.when(is_slot(piece), F.substring(piece, 1, 1)).otherwise(piece)


def template(text: Column) -> Column:
    """Tokens of a text's template."""
    return F.transform(pieces(text), as_token)


def slots(parts: Column) -> Column:
    """(place from 0, value) of every placeholder among a text's pieces."""
    found = F.transform(parts, lambda t, i: F.when(is_slot(t), F.struct(i.alias("place"), F.substr(t, F.lit(2)).alias("value"))))
    return F.filter(found, lambda s: s.isNotNull())


def slot_values(text: Column) -> Column:
    """What the placeholders of ``template`` stand for, in their order."""
    return F.transform(slots(pieces(text)), lambda s: s["value"])


def hashed(parts: Column) -> list[Column]:
    """What ``windows`` needs of a text's pieces."""
    return [F.transform(parts, lambda t: F.xxhash64(as_token(t))).alias("tokens"), F.transform(parts, lambda t: F.xxhash64(t)).alias("exact_tokens"), F.transform(parts, is_slot).alias("slot")]


def window_at(i: Column, size: Column, literals: int) -> list[Column]:
    """Hash of the window of ``size`` pieces from place ``i`` (from 1) on, and
    whether it is exact: hashed with its slots' values, since it has fewer than
    ``literals`` plain words."""
    exact = F.size(F.filter(F.slice("slot", i, size), lambda s: ~s)) < F.least(F.lit(literals), size)
    return [F.xxhash64(F.when(exact, F.slice("exact_tokens", i, size)).otherwise(F.slice("tokens", i, size))).alias("hash"), exact.alias("exact")]


def lead_at(i: Column, size: Column | int) -> Column:
    """Hash of the first LEAD tokens (of ``size``, if fewer) from place ``i`` (from 0) on."""
    each = [F.when(F.lit(size) > k, F.get("tokens", i + k)) for k in range(LEAD)]
    return F.xxhash64(F.least(F.lit(size), F.lit(LEAD)), *each)


def is_brief(parts: Column) -> Column:
    """Whether an item's pieces say too little to be looked for inside a text."""
    numbers = F.size(F.filter(parts, lambda t: F.substring(t, 1, 1) == "\u0002"))
    return F.size(parts) + numbers < LEAST_EVIDENCE


def brief_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_tokens): items with a token that only whole documents match."""
    parts = benchmark.where("text is not null").select("item_id", pieces(F.col("text")).alias("pieces")).where(F.size("pieces") > 0)
    return parts.where(is_brief(F.col("pieces"))).select("item_id", F.size("pieces").alias("n_tokens")).distinct()


def item_windows(items: DataFrame, window: int, literals: int) -> DataFrame:
    """(item_id, n_tokens, brief, size, lead, hash, exact, starts, n_windows, n_all):
    distinct windows of each item, ``starts`` counted from 0; ``n_windows`` are
    those not exact."""
    parts = items.select("item_id", F.size("pieces").alias("n_tokens"), is_brief(F.col("pieces")).alias("brief"), *hashed(F.col("pieces"))).withColumn("size", F.least(F.size("tokens"), F.lit(window))).where("size > 0")
    starts = F.sequence(F.lit(0), F.size("tokens") - F.col("size"))
    each = F.transform(starts, lambda i: F.struct(i.alias("start"), lead_at(i, F.col("size")).alias("lead"), *window_at(i + 1, F.col("size"), literals)))
    rows = parts.select("item_id", "n_tokens", "brief", "size", F.inline(each))
    rows = rows.groupBy("item_id", "n_tokens", "brief", "size", "lead", "hash", "exact").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    totals = rows.groupBy("item_id").agg(F.count_if(~F.col("exact")).alias("n_windows"), F.count(F.lit(1)).alias("n_all"))
    return rows.join(totals, "item_id")


def blocks(parts: DataFrame, window: int) -> DataFrame:
    """Rows of at most BLOCK places (``base`` is the first one's) and the tokens
    that windows from there on reach."""
    begins = F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens"), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    cut = lambda b: F.struct((b - 1).alias("base"), *[F.slice(c, b, F.lit(BLOCK + window - 1)).alias(c) for c in ("tokens", "exact_tokens", "slot")])
    return parts.select("doc_id", "text_hash", F.size("tokens").alias("n_doc"), F.inline(F.transform(begins, cut)))


def doc_windows(parts: DataFrame, leads: DataFrame | None, sizes: list[int], window: int, literals: int) -> DataFrame:
    """(doc_id, text_hash, n_doc, size, place, hash, exact): windows of all sizes from
    every place, or only from those where one of ``leads`` (lead, size) stands."""
    places = F.slice("tokens", 1, BLOCK)
    if leads is None:
        at = F.transform(places, lambda _, i: F.transform(F.array(*map(F.lit, sizes)), lambda s: F.struct(i.alias("place"), s.alias("size"))))
        rows = blocks(parts, window).select("*", F.inline(F.flatten(at)))
    else:
        leading = lambda n: F.transform(places, lambda _, i: F.struct(i.alias("place"), lead_at(i, n).alias("lead")))
        at = [leading(n) for n in sorted({min(s, LEAD) for s in sizes})]
        rows = blocks(parts, window).select("*", F.inline(F.concat(*at))).join(F.broadcast(leads), "lead")
    rows = rows.where(F.col("place") + F.col("size") <= F.size("tokens"))
    return rows.select("doc_id", "text_hash", "n_doc", "size", (F.col("base") + F.col("place")).alias("place"), *window_at(F.col("place") + 1, F.col("size"), literals))


def within(rows: int, df: DataFrame) -> DataFrame:
    """Broadcast ``df`` if it has no more rows than BROADCAST_ROWS."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text_col: str = "text", window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """Rows (key, item_id, n_matched, n_windows, coverage, n_slots, consistency,
    reworded): the documents that hold an item, or one like it in other values."""
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).where("text is not null")
    items = benchmark.select("item_id", F.col("text").alias("item")).where("item is not null").groupBy("item_id").agg(F.min("item").alias("item"))
    items = items.withColumn("pieces", pieces(F.col("item")))
    wanted = written(item_windows(items, window, literals), "item_windows")
    sizes = sorted(r.size for r in wanted.select("size").distinct().collect())  # at most ``window`` numbers
    n_wanted = wanted.count()

    parts = texts.select("doc_id", "text_hash", pieces(F.col("text")).alias("pieces")).select("doc_id", "text_hash", *hashed(F.col("pieces")))
    leads = wanted.select("lead", "size").distinct() if n_wanted <= BROADCAST_ROWS else None
    found = doc_windows(parts, leads, sizes or [window], window, literals)
    found = found.join(within(n_wanted, wanted.drop("lead")), ["size", "hash", "exact"]).where("not brief or n_doc = n_tokens")
    found = found.groupBy(*OWNER, "hash", "exact", "place").agg(*[F.first(c).alias(c) for c in ("starts", "n_tokens", "n_windows", "n_all", "size")])
    found = in_runs(found).withColumn("read", F.explode(readings())).select("*", "read.*")
    total = F.when(F.col("reading") < ALL, F.col("n_windows")).otherwise(F.col("n_all"))
    pairs = found.groupBy(*READ).agg(F.size(F.collect_set("hash")).alias("n_matched"), F.first(total).alias("n_windows"), F.sort_array(F.collect_list(F.struct("start", "place", "size"))).alias("hits"))
    pairs = pairs.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    pairs = pairs.groupBy(*OWNER, "n_matched", "n_windows", "coverage", "hits").agg(F.min(F.struct("reading", "part")).alias("read"))  # readings of the same hits are one
    pairs = written(pairs.select("*", "read.*").drop("read"), "pairs")

    paired = slot_pairs(pairs, texts, items)
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in READ]
    judged = pairs.drop("hits").join(paired.select(*[F.col(c).alias(f"s_{c}") for c in READ], "n_slots", "agreeing", "changed"), reduce(Column.__and__, same), "left")
    judged = judged.withColumns({"n_slots": F.coalesce("n_slots", F.lit(0)), "consistency": F.coalesce(F.col("agreeing") / F.col("n_slots"), F.lit(1.0)), "reworded": F.coalesce("changed", F.lit(False))})
    out = ["n_matched", "n_windows", "coverage", "n_slots", "consistency", "reworded"]
    best = judged.where(F.col("consistency") >= consistency).groupBy(*OWNER).agg(F.min(F.struct("reading", -F.col("coverage"), -F.col("consistency"), "part", *out)).alias("best"))
    return best.select(F.col("doc_id").alias(key), "item_id", *[f"best.{c}" for c in out])


def in_runs(found: DataFrame) -> DataFrame:
    """Add ``first``, whether a hit is its window's first place in the document,
    and ``run``: a hit that stands no later in the item than the hit before, or
    more than the item's length further on, begins another copy."""
    by_place = Window.partitionBy(*OWNER).orderBy("place")
    start = F.element_at("starts", 1)
    ahead = F.col("place") - start - F.lag(F.col("place") - start).over(by_place)
    begins = F.coalesce((start <= F.lag(start).over(by_place)) | (ahead > F.col("n_tokens")), F.lit(True))
    out = found.withColumn("begins", begins.cast("long")).withColumn("run", F.sum("begins").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")
    return out.withColumn("first", F.row_number().over(Window.partitionBy(*OWNER, "hash").orderBy("place")) == 1)


def readings() -> Column:
    """(reading, part, start) that a hit counts for: the first places in the whole
    document, its run, and its alignment with each of the window's starts. An item
    with exact windows is read by its template windows alone (values may change)
    and by all of its windows."""
    read = lambda kind, part, start: F.struct(F.lit(kind).alias("reading"), part.cast("long").alias("part"), start.alias("start"))
    start = F.element_at("starts", 1)
    every = F.concat(F.array(F.when(F.col("first"), read(WHOLE, F.lit(0), start)), read(RUN, F.col("run"), start)), F.transform("starts", lambda s: read(ALIGNED, F.col("place") - s, s)))
    by_all = F.transform(every, lambda r: F.when(r.isNotNull(), F.struct((r["reading"] + ALL).alias("reading"), r["part"].alias("part"), r["start"].alias("start"))))
    none = F.slice(every, 1, 0)
    both = F.concat(F.when(F.col("exact"), none).otherwise(every), F.when(F.col("n_all") > F.col("n_windows"), by_all).otherwise(none))
    return F.filter(both, lambda r: r.isNotNull())


def slot_pairs(pairs: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """Per READ: slot pairs, those that agree with the
    most frequent partner of the item's value, and whether any value changed."""
    marks = items.select("item_id", F.inline(slots(F.col("pieces"))).alias("mark", "value"))
    hits = pairs.select(*READ, F.inline("hits"))
    met = hits.join(marks, "item_id").where("mark >= start and mark < start + size")
    met = written(met.select(*READ, "value", "mark", (F.col("mark") - F.col("start") + F.col("place")).alias("at")).distinct(), "slots")
    keys = met.select("doc_id", "text_hash").distinct().select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"))
    n_keys = keys.count()
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))
    whole = texts.join(within(n_keys, keys), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    values = whole.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), F.inline(slots(pieces(F.col("text")))).alias("at_doc", "other"))
    both = met.join(values, same & (F.col("at") == F.col("at_doc"))).select(*READ, "mark", "value", "other")
    counted = both.groupBy(*READ, "value", "other").agg(F.count(F.lit(1)).alias("n"))
    per_value = counted.groupBy(*READ, "value").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max(F.col("other") != F.col("value")).alias("changed"))
    return per_value.groupBy(*READ).agg(F.sum("n").alias("n_slots"), F.sum("top").alias("agreeing"), F.max("changed").alias("changed"))
