"""The pipeline against a brute-force version of each stage's decision."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline as cp
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_simhash import brute_components, brute_print
from tonemill.llm import bpe, quality
from tonemill.llm.ragged import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cut_text(text, texts, length, least_words):
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    r = (text or "").encode()
    gone = bytearray(len(r))
    for i in range(len(r) - length + 1):
        if count[r[i:i + length]] > 1:
            gone[i:i + length] = b"\x01" * length
    out, at, changed = "", 0, False
    while at < len(r):
        end = at + 1
        while end < len(r) and gone[end] == gone[at]:
            end += 1
        if gone[at] and len(r[at:end].split()) >= least_words:
            changed, gone[at:end] = True, b"\x02" * (end - at)
        at = end
    pieces = "".join(chr(x) for x in gone).replace("\x01", "\x00")
    at = 0
    for part in pieces.split("\x02"):
        out += r[at:at + len(part)].decode("utf-8", "ignore")
        at += len(part) + 1
    return out, changed


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_stages_against_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs = table(spark, sf, "documents")
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    kept = written(cp.quality_stage(spark, docs, sf), "t_quality")
    assert kept.columns == COLUMNS
    marks = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    left = {r.doc_id for r in kept.collect()}
    good = [i for i in rows if marks.get(i) == 1]
    assert np.mean([i in left for i in good]) > 0.95 and np.mean([i in left for i in rows if marks.get(i) == 0]) < 0.3

    near = written(cp.near_dedup_stage(spark, kept, sf), "t_near")
    ids = sorted(left)
    comps = brute_components(ids, [brute_print(rows[i][1]) for i in ids])
    assert sorted(map(tuple, near.collect())) == sorted(rows[i] for i, c in zip(ids, comps) if i == c)

    third = written(cp.repeats_stage(spark, near, sf), "t_repeats")
    before = {r.doc_id: r for r in near.collect()}
    texts = [r.text for r in before.values()]
    want = {}
    for i, r in before.items():
        text, changed = cut_text(r.text, texts, cp.PASSAGE_BYTES, cp.PASSAGE_WORDS)
        if not changed or text.strip():
            want[i] = (i, text, r.lang, r.source, len(text) if changed else r.n_chars)
    assert {r.doc_id: tuple(r) for r in third.collect()} == want

    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    bad = {x[0] for x in leaks([(i, w[1]) for i, w in want.items()], items)}
    fourth = written(cp.decontamination_stage(spark, third, sf), "t_decontam")
    assert {r.doc_id: tuple(r) for r in fourth.collect()} == {i: w for i, w in want.items() if i not in bad}

    library = Tokenizer.from_file(bpe.default_vocabulary())
    last = cp.tokenize_stage(spark, fourth, sf).collect()
    assert len(last) == len(want) - len(bad)
    for r in last:
        e = library.encode(want[r.doc_id][1], add_special_tokens=False).ids
        assert r.n_tokens == len(e) and r.decoded_sha256 == hashlib.sha256(want[r.doc_id][1].encode()).hexdigest()
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, last))


def test_defined_cases(spark, tmp_path):
    long = "abcdefgh " * 60
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, "Some words here to keep.", "en", None, 24), (3, "Some words here to keep.", "en", None, 24), (None, "Some words here to keep.", "en", "b", 24), (5, "é" + long + "tail é", "en", "b", 1), (6, long * 20, "en", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sf = str(tmp_path)
    spark.createDataFrame([(3, 1, 0), (77, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert cp.quality_stage(spark, docs, sf).count() == len(rows)
    near = cp.near_dedup_stage(spark, docs, sf)
    assert near.columns == COLUMNS and sorted((r.doc_id or 0) for r in near.collect()) in ([0, 1, 3, 5, 6], [0, 1, 3, 5])
    third = {r.doc_id: r for r in cp.repeats_stage(spark, docs, sf).collect()}
    assert third[5].text == "étail é" and third[5].n_chars == 7 and 6 not in third and third[1].text is None or third[1].text == ""
    assert cp.decontamination_stage(spark, docs, sf).count() == len(rows)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert quality.STATISTICS


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_passages_of_just_over_fifty_words_are_cut(spark):
    """51 to 60 words go, 40 words stay, whatever stands around them."""
    passages = {n: prose(n, n) for n in (40, 51, 52, 55, 60)}
    rows, want = [], {}
    for n, passage in passages.items():
        for k in range(3):
            head, tail = prose(1000 + 10 * n + k, 30), prose(2000 + 10 * n + k, 30)
            rows.append((10 * n + k, f"{head} X{k} {passage} Y{k} {tail}", "en", "a", 1))
            want[10 * n + k] = (head, tail, passage)
    out = {r.doc_id: r.text for r in cp.repeats_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    for i, (head, tail, passage) in want.items():
        assert out[i].startswith(head) and out[i].endswith(tail)
        assert (passage in out[i]) == (i < 500)


def test_documents_under_one_id_are_told_apart(spark, tmp_path):
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a, "en", "a", 1), (1, b, "en", "a", 1), (2, b + " more", "en", "a", 2), (3, a, "en", "a", 1), (1, a, "en", "a", 1), (None, a, "en", "a", 1)]
    near = cp.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    texts = sorted((r.doc_id or 0, r.text) for r in near.collect())
    assert (0, a) in texts and texts.count((1, a)) == 1 and (1, b) in texts and not any(i == 3 for i, _ in texts)
    item = "the quick brown fox jumps over the lazy dog while seven old sheep look on from the green hill"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(None, "so " + item, "en", "a", 1), (None, a, "en", "a", 1), (4, item, "en", "a", 1), (4, b, "en", "a", 1)]
    left = cp.decontamination_stage(spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, a), (4, b)] and left.columns == COLUMNS
