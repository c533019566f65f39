"""Section token counts against the tokenizers library's offsets."""

import pytest
from pyspark.sql import functions as F

from tonemill.llm.token_counts import count_tokens
from tonemill.llm import bpe




def brute(library, text, sections, rule):
    n, c = [0] * len(sections), [0] * len(sections)
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(e, b) - max(s, a)) for s, e in sections]
        held = [i for i, x in enumerate(share) if x]
        whole = any(s <= a and b <= e for s, e in sections)
        if rule == "each":
            chosen = held
        elif rule == "start":
            chosen = [i for i in held if sections[i][0] <= a < sections[i][1]]
        else:
            top = max(share)
            chosen = [share.index(top)] if top and top >= b - a - sum(share) else []
        for i in chosen:
            n[i] += 1
            c[i] += not whole
    return n, c


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


TEXTS = ["", None, "one line", "a\n\n\nb\n", "\n\n\n   x\n\n  漢字 😀\nend", "x" * 70_000 + "\n" + "y z " * 9, "!!!\n\n???\n", "été\nGröße😀😀"]


@pytest.mark.parametrize("rule", ["start", "majority", "each"])
def test_lines(spark, library, rule):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(2, "one line")], "doc_id long, text string")
    got = {}
    for r in count_tokens(df, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start_char, r.end_char, r.n_tokens, r.n_crossing))
    for i, t in enumerate(TEXTS):
        at, parts = 0, []
        for p in (t or "").split("\n"):
            parts.append((at, at + len(p) + 1))
            at += len(p) + 1
        parts[-1] = (parts[-1][0], len(t or ""))
        if len(parts) > 1 and parts[-1][0] == parts[-1][1]:
            parts.pop()
        n, c = brute(library, t or "", parts, rule)
        want = [(k, s, e, n[k], c[k]) for k, (s, e) in enumerate(parts)]
        assert sorted(got[i]) == sorted(want * (2 if i == 2 else 1))


@pytest.mark.parametrize("rule", ["start", "majority", "each"])
def test_given_sections(spark, library, rule):
    text = "Internationalization of tokenizers, 漢字 and emoji 😀 everywhere in counterrevolutionary texts."
    cuts = [(2, 9), (9, 30), (33, 37), (37, 38), (41, 80)]
    df = spark.createDataFrame([(1, text, [(f"s{k}", s, e) for k, (s, e) in enumerate(cuts)], 5), (2, text, [], 5), (3, text, None, 5)],
                               "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>, n_tokens int")
    out = sorted(count_tokens(df, sections="parts", rule=rule).collect(), key=lambda r: r.section)
    n, c = brute(library, text, cuts, rule)
    assert [(r.doc_id, r.name, r.n_tokens, r.n_crossing) for r in out] == [(1, f"s{k}", n[k], c[k]) for k in range(len(cuts))]


def test_empty_and_bad(spark):
    df = spark.createDataFrame([(1, "abc", [("a", 0, 2), ("b", 1, 3)])], "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>")
    assert count_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        count_tokens(df, rule="other")
    with pytest.raises(Exception, match="overlap"):
        count_tokens(df, sections="parts").collect()


def test_query_sums_to_documents(spark, library):
    from tonemill.llm.queries import LLM_QUERIES
    from tonemill.llm.ragged import table

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    out = LLM_QUERIES["op8_token_counts"](spark, sf)
    for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("d"), F.max("end_char").alias("e")).collect():
        assert r.n == r.d == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) and r.e == len(texts[r.doc_id])
    one = [r for r in out.collect() if r.doc_id == 7]
    at, parts = 0, []
    for p in texts[7].split("\n"):
        parts.append((at, min(len(texts[7]), at + len(p) + 1)))
        at += len(p) + 1
    n, c = brute(library, texts[7], [p for p in parts if p[0] < p[1]], "majority")
    assert [(r.n_tokens, r.n_crossing) for r in sorted(one, key=lambda r: r.section)] == list(zip(n, c))


def test_sections_without_bounds_have_null_counts(spark, library):
    text = "Some words here and there, 漢字 too."
    parts = [("a", 0, 4), ("b", None, 9), None, ("c", 5, None), ("d", 5, 20), (None, 20, 33)]
    rows = [(1, text, parts), (2, text, [("x", None, None)]), (3, None, [("y", 0, 0), None]), (None, text, parts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<name:string,start:int,end:int>>")
    n, c = brute(library, text, [(0, 4), (5, 20), (20, 33)], "majority")
    got = {(r.doc_id, r.section): tuple(r)[2:] for r in count_tokens(df, sections="parts").collect()}
    total = len(library.encode(text, add_special_tokens=False).ids)
    for i in (1, None):
        assert [got[i, k] for k in range(6)] == [
            ("a", 0, 4, n[0], c[0], total), ("b", None, None, None, None, total), (None, None, None, None, None, total),
            ("c", None, None, None, None, total), ("d", 5, 20, n[1], c[1], total), (None, 20, 33, n[2], c[2], total)]
    assert got[2, 0] == ("x", None, None, None, None, total) and got[3, 0] == ("y", 0, 0, 0, 0, 0) and got[3, 1][1:5] == (None,) * 4
