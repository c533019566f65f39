"""Template decontamination against a plain Python version."""

import re
from collections import Counter

import pytest
import regex

from tonemill.llm import decontam as dc
from tonemill.llm.ragged import table

COUNTS = "|".join(dc.NUMBER_WORDS)
SLOT = {
    "unit": rf"(?<=\p{{Nd}}|\p{{Nd}}\s|(?<![\p{{L}}\p{{M}}])(?i:{COUNTS})[^\p{{L}}\p{{M}}\p{{Nd}}]+)(?:{'|'.join(sorted(dc.UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{Nd}}])",
    "number": rf"\p{{Nd}}+(?:[.,]\p{{Nd}}+)*|(?<![\p{{L}}\p{{M}}])(?i:{COUNTS})(?![\p{{L}}\p{{M}}])",
    "name": r"(?<![\p{L}\p{M}])\p{Lu}\p{Ll}+(?!\p{L})",
}


def plain_template(text):
    """[(token, value or None)] of a text."""
    out, at = [], 0
    for m in regex.finditer("|".join(f"(?P<{k}>{v})" for k, v in SLOT.items()), text):
        out += [(w, None) for w in regex.findall(r"[\p{L}\p{M}]+", text[at:m.start()].lower())]
        value = m.group().lower()
        opens = m.lastgroup == "name" and value in dc.OPENERS
        out.append((value, None) if opens else (f"<{m.lastgroup}>", str(dc.NUMBER_WORDS.get(value, value))))
        at = m.end()
    return out + [(w, None) for w in regex.findall(r"[\p{L}\p{M}]+", text[at:].lower())]


def brute(docs, items, window=8, literals=4, coverage=0.3, consistency=0.8):
    out = []
    for doc_id, text in {(d, t) for d, t in docs if t is not None}:
        tokens = plain_template(text)
        for item_id, item in items.items():
            parts = plain_template(item)
            size = min(window, len(parts))
            if not size or len(parts) + sum(t == "<number>" for t, _ in parts) < 5 and len(parts) != len(tokens):
                continue
            grams = {}
            for i in range(len(parts) - size + 1):
                g = tuple(t for t, _ in parts[i:i + size])
                if sum(not t.startswith("<") for t in g) >= min(literals, size):
                    grams.setdefault(g, i)
            hits = {}
            for p in range(len(tokens) - size + 1):
                g = tuple(t for t, _ in tokens[p:p + size])
                if g in grams:
                    hits.setdefault(g, p)
            if not grams or len(hits) / len(grams) < coverage:
                continue
            pairs = {(grams[g] + k, hits[g] + k) for g in hits for k in range(size) if parts[grams[g] + k][1] is not None}
            count = Counter((parts[a][1], tokens[b][1]) for a, b in pairs)
            best = Counter()
            for (v, _), n in count.items():
                best[v] = max(best[v], n)
            n = sum(count.values())
            share = sum(best.values()) / n if n else 1.0
            if share >= consistency:
                out.append((doc_id, item_id, len(hits), len(grams), n, round(share, 9), any(v != o for v, o in count)))
    return out


def rows(df):
    return sorted((r.doc_id, r.item_id, r.n_matched, r.n_windows, r.n_slots, round(r.consistency, 9), r.reworded) for r in df.collect())


ITEMS = {
    1: "A farmer named Alice sells 12 boxes of apples for 3.50 dollars each. On the way Alice loses 2 boxes and meets Bob near the old river mill. How many boxes does Alice have left?",
    2: "the quick brown fox jumps over the lazy dog while seven old sheep look on from the green hill beyond",
    3: "short text only",
    4: "5 10 15 20 25 30 35 40 45 50",
    5: "",
}


def test_templates_agree(spark):
    texts = [*ITEMS.values(), "Run 5km in 20 min. Then Paris, London Berlin 7 kg! New York\nOslo été Ünder x1y2 3,5.", " \u0001 a \u0002", "É à Ñandú"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", dc.template(dc.F.col("text")).alias("t"), dc.slot_values(dc.F.col("text")).alias("v"))
    names = {"\u0001": "<name>", "\u0002": "<number>", "\u0003": "<unit>"}
    for r in df.collect():
        want = plain_template(re.sub("[\u0001-\u0003]", " ", r.text))
        assert [names.get(t, t) for t in r.t] == [t for t, _ in want]
        assert [v.lower() for v in r.v] == [v for _, v in want if v is not None]


def test_reparameterised_and_inconsistent(spark, monkeypatch):
    new = ITEMS[1].replace("Alice", "Clara").replace("12", "40").replace("3.50", "9").replace("Bob", "Dieter")
    mixed = ITEMS[1].replace("named Alice", "named Clara").replace("way Alice", "way Edith").replace("does Alice", "does Ferdi")
    docs = [(1, "Intro text here. " + ITEMS[1]), (2, new + " And some more."), (3, mixed), (4, ITEMS[2].upper()), (5, None), (6, ""), (7, ITEMS[2] + " " + ITEMS[1]), (7, ITEMS[2]), (7, ITEMS[2]),
            (8, "nothing in common with any of these items at all, really nothing"), (9, ITEMS[3]), (10, "1 2 3 4 5 6 7 8 9 10 11"), (None, ITEMS[2]), (11, "word " * 60_000 + ITEMS[2]), (12, " ".join(ITEMS[2].split()[:10]))]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, ITEM_ID string")
    bench = spark.createDataFrame([*ITEMS.items(), (2, ITEMS[2]), (6, None)], "item_id long, text string")
    want = brute(docs, ITEMS)
    by = {(w[0], w[1]): w for w in want}
    assert (2, 1) in by and by[2, 1][6] and not by[1, 1][6] and (3, 1) not in by
    key = lambda w: (w[0] is None, w[0] or 0, *w[1:])
    order = lambda ws: sorted(ws, key=key)
    got = [(r.doc_id, r.item_id, r.n_matched, r.n_windows, r.n_slots, round(r.consistency, 9), r.reworded) for r in dc.matches(df, bench).collect()]
    assert order(got) == order(want)
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    got = [(r.doc_id, r.item_id, r.n_matched, r.n_windows, r.n_slots, round(r.consistency, 9), r.reworded) for r in dc.matches(df, bench).collect()]
    assert order(got) == order(want)


def test_name_straight_after_a_unit(spark):
    texts = ["Wait 5 days Tom said, then Ann had 7 kg Bob left", "Run 5km Paris 3 m\u0301 Rome 2 h. Oslo"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", dc.template(dc.F.col("text")).alias("t"), dc.slot_values(dc.F.col("text")).alias("v"))
    for r in df.collect():
        want = plain_template(r.text)
        assert [{"\u0001": "<name>", "\u0002": "<number>", "\u0003": "<unit>"}.get(t, t) for t in r.t] == [t for t, _ in want]
        assert [v.lower() for v in r.v] == [v for _, v in want if v is not None]
    docs, bench = [(1, "After 5 days Tom and 7 hours Ann left. " + ITEMS[1])], [(1, ITEMS[1])]
    got = rows(dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")))
    assert got == brute(docs, dict(bench)) and got[0][5:] == (1.0, False)


def test_items_with_few_plain_words(spark):
    items = [(1, "What is 15% of 240?"), (2, "Solve 3x + 5 = 20"), (3, "Compute 12 * 34"), (4, ITEMS[4]), (5, "Add 1 2 3 4 5 6 7 8 9 to the sum of all the old apples")]
    docs = [(k, f"Some words before. {t} And some more.") for k, t in items]
    docs += [(11, "What is 16% of 240?"), (12, "Solve 3x + 5 = 21"), (13, "compute 13 * 34"), (14, "1 2 3 4 5 6 7 8 9 10 11"), (15, items[4][1].replace(" 9 ", " 77 ")), (16, "5 10 15 20 25 30 35 40 and others"), (17, "1 2 3 4 5 6 7 8 9 to the end")]
    got = {(r.doc_id, r.item_id): r for r in dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (15, 5), (16, 4), (17, 5)}
    assert all(r.consistency == 1 for r in got.values()) and [k for k, r in got.items() if r.reworded] == [(15, 5)]
    assert got[16, 4].coverage == 1 / 3 and got[15, 5].coverage == 1


def test_brief_items(spark):
    items = [(1, "Why?"), (2, "True or false?"), (3, "What is 2 + 2?"), (4, "Chapter 3"), (5, "?"), (6, None), (7, "Why?")]
    docs = [(1, "Nobody knows why the sea is salt."), (2, "He said it was true or false"), (3, "Tell me: what is 2 + 2? Well."), (4, "In chapter 3 they meet."), (5, "WHY"), (6, "True, or false!"), (7, "Chapter three"), (8, "Chapter 4"), (9, "why why")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.matches(docs, bench).collect()} == {(3, 3), (5, 1), (5, 7), (6, 2), (7, 4)}
    assert {tuple(r) for r in dc.brief_items(bench).collect()} == {(1, 1), (2, 3), (4, 2), (7, 1)}


def test_number_words_and_opening_names(spark):
    items = [(1, "Tom has 3 apples and eats 2 now"), (2, "How far does the red train go in three hours at 60 miles an hour?")]
    docs = [(1, "Ann has 5 apples and eats 4 now"), (2, "So it goes. Ann has five apples and eats four now, he said."), (3, "Yesterday Tom has three apples and eats two now"),
            (4, "Question: How far does the red train go in 3 hours at sixty miles an hour?"), (5, "How far does the red train go in Seven hours at forty miles an hour"), (6, "someone has threefold apples and eats two now")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reworded for r in dc.matches(docs, bench).collect()}
    assert got == {(1, 1): True, (2, 1): True, (3, 1): False, (4, 2): False, (5, 2): True}


def test_copy_after_an_inconsistent_one(spark):
    mixed = ITEMS[1].replace("named Alice", "named Clara").replace("way Alice", "way Edith").replace("does Alice", "does Ferdi")
    new = ITEMS[1].replace("Alice", "Clara").replace("12", "40").replace("3.50", "9").replace("Bob", "Dieter")
    spaced = ITEMS[1].replace("dollars each", "dollars indeed each").replace("near the", "near indeed the")
    texts = [mixed + " " + ITEMS[1], mixed + " filler text" * 300 + ". " + new, mixed + " " + spaced, mixed + " " + mixed, ITEMS[1] + " " + mixed]
    docs = list(enumerate(texts)) + [(0, texts[0])]
    got = {r.doc_id: r for r in dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ITEMS[1])], "item_id long, text string")).collect()}
    assert {k: (r.n_matched, r.n_windows, r.consistency, r.reworded) for k, r in got.items()} == {0: (28, 28, 1, False), 1: (28, 28, 1, True), 2: (14, 28, 1, False), 4: (28, 28, 1, False)}
    twice = "In the old town a baker sells 12 loaves of white bread daily. Of those 12 loaves he eats some. In the old town a baker sells 15 loaves of white bread daily."
    half = twice[twice.index("Of those"):] + " " + twice[twice.index("Of those"):].replace("15", "18")
    got = dc.matches(spark.createDataFrame([(1, half)], "doc_id long, text string"), spark.createDataFrame([(1, twice)], "item_id long, text string")).collect()
    assert [(r.consistency, r.reworded) for r in got] == [(1, False)]


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, ITEMS[2])], "doc_id long, text string")
    bench = spark.createDataFrame([(2, ITEMS[2])], "item_id long, text string")
    assert dc.matches(df.limit(0), bench).count() == 0 and dc.matches(df, bench.limit(0)).count() == 0
    assert dc.matches(df, bench).count() == 1


def test_no_python_in_the_plan(spark):
    df = dc.matches(table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    from tonemill.llm.queries import LLM_QUERIES

    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    got = rows(LLM_QUERIES["op10_decontam"](spark, sf))
    assert got == sorted(brute(docs, items))
    held = {d for d, t in docs if t and any(i in t for i in items.values())}
    assert held and held <= {g[0] for g in got}
