"""Hits of large lexicons: one automaton over all entries, one pass over the text.

The built-in rule features name each entry in the plan, which suits the default
word lists; a lexicon of tens of thousands of entries is a table. Its entries,
words and phrases alike, become one Aho-Corasick automaton that is broadcast
once, built once in each Python worker and fed the lower-cased text: every
occurrence of every entry is found in one pass, whatever their number, and the
plan stays as small as for one entry.

``kind`` names what an entry counts for. Entries of the kinds in ``whole`` stand
between blanks or text ends (as the rule labeler's words do), others anywhere
(as its negations and amplifiers do). A text's hits of a kind are its *different*
entries found. A null text reads ``nan``, as in the rule labeler. Null and empty
entries and null kinds say nothing; a repeated entry counts once per kind.
Scan only: no shuffle, the lower-cased text alone crosses into Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 500_000
MAX_BYTES = 32 << 20
_AUTOMATA: dict = {}


def _automaton(token: str, entries: list[tuple[str, list[int]]]):
    """The automaton of a broadcast lexicon, built once per worker process."""
    if token not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        found = ahocorasick.Automaton()
        for k, (needle, kinds) in enumerate(entries):
            found.add_word(needle, (k, kinds))
        if entries:
            found.make_automaton()
        _AUTOMATA[token] = found
    return _AUTOMATA[token]


def _needles(lexicon: DataFrame, kinds: Sequence[str], whole: Iterable[str]) -> list[tuple[str, list[int]]]:
    """(string to find, kinds it counts for), in the driver: the size is checked."""
    rows = lexicon.select(F.lower("entry").alias("entry"), "kind").where((F.col("entry") != "") & F.col("kind").isin(list(kinds))).distinct()
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("entry")), F.lit(0))).first()
    if n > MAX_ENTRIES or size > MAX_BYTES:
        raise ValueError(f"a lexicon of {n} entries and {size} bytes is over {MAX_ENTRIES} entries or {MAX_BYTES} bytes")
    whole, out = set(whole), {}
    for r in rows.collect():
        needle = f" {r['entry']} " if r["kind"] in whole else r["entry"]
        out.setdefault(needle, []).append(list(kinds).index(r["kind"]))
    return sorted(out.items())


def lexicon_counts(df: DataFrame, lexicon: DataFrame, kinds: Sequence[str], whole: Iterable[str] | None = None,
                   text_col: str = "text") -> DataFrame:
    """Add ``<kind>_hits`` for each of ``kinds`` from ``lexicon(entry, kind)``;
    ``whole`` (all kinds, unless given) are those that match whole words only."""
    entries = _needles(lexicon, kinds, kinds if whole is None else whole)
    sent, token, n = df.sparkSession.sparkContext.broadcast(entries), uuid.uuid4().hex, len(kinds)

    def hits(texts: pd.Series) -> pd.DataFrame:
        automaton, rows = _automaton(token, sent.value), []
        for text in texts:
            counts = [0] * n
            for of in {k: of for _, (k, of) in automaton.iter(f" {text} ")}.values() if len(automaton) else ():
                for kind in of:
                    counts[kind] += 1
            rows.append(counts)
        return pd.DataFrame(rows, columns=[f"k{i}" for i in range(n)], dtype="int32")

    find = F.pandas_udf(hits, ", ".join(f"k{i} int" for i in range(n))).asNondeterministic()
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("nan")))
    found = df.withColumn("__tm_hits", find(text))
    return found.withColumns({f"{kind}_hits": F.col(f"__tm_hits.k{i}") for i, kind in enumerate(kinds)}).drop("__tm_hits")
