"""Deobfuscation, character model and toxicity scores."""

import re
import zlib

import numpy as np
import pytest

from tonemill.llm import toxicity
from tonemill.llm.ragged import table


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.character_model(table(spark, "/root/testdata/sf0.01", "documents"))


def plain_trigrams(text):
    s = [0]
    for ch in text:
        code = toxicity.TABLE[ch.encode()[0]]
        if code in (0, 27) and s[-1] == code and len(s) > 1:
            continue
        s.append(int(code))
    out = np.zeros((28, 28, 28), int)
    for t in zip(s, s[1:], s[2:]):
        out[t] += 1
    return out


def test_character_counts():
    for text in ("ab  c, dé!", "", "a", "éé x", " a b", "Zz\n\n1é"):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = toxicity.trigrams(raw, np.array([0, len(raw)])).reshape(28, 28, 28) if len(raw) else np.zeros((28, 28, 28), int)
        assert (got == plain_trigrams(text)).all(), text


def test_viterbi_is_the_best_path(model):
    from itertools import product

    for word in ("m0r0n", "st11", "1d10t", "$ca", "oo7", "stuuup", "a s c u m", "s s s c", "u u m"):
        choices = toxicity.lattice(word)

        def score(pieces):
            a, b, s = 0, 0, sum(w for _, w in pieces)
            for c in "".join(p for p, _ in pieces) + " ":
                z = toxicity.symbol(c)
                if z == b and z in (0, 27):
                    continue
                s += model[a, b, z]
                a, b = b, z
            return s

        best = max(product(*choices), key=score)
        got = toxicity.viterbi(choices, model)
        same = [p for p in product(*choices) if "".join(x for x, _ in p).strip() == got]
        assert np.isclose(max(map(score, same)), score(best))


@pytest.mark.parametrize("seen,want", [
    ("1d10t", "idiot"), ("m0r0n.", "moron"), ("stuuupid", "stupid"), ("$tup!d", "stupid"), ("s t u p i d", "stupid"), ("i.d.i.o.t", "idiot"),
    ("l0s3r", "loser"), ("s-c-u-m", "scum"), ("w0rthl3ss", "worthless"), ("tr@$h!!", "trash"),
])
def test_restores(spark, model, seen, want):
    text = f"Reand the {seen} of thing"
    got = toxicity.restore_texts(spark.createDataFrame([(text,)], "text string"), model).first().restored
    assert want in re.findall("[a-z]+", got) and got.startswith("reand the ") and got.endswith(" of thing")


@pytest.mark.parametrize("seen,want", [
    ("i.d.i.o.t.", "idiot"), ("i-d-i-o-t!", "idiot"), ("(i-d-i-o-t)", "idiot"), ("i-d-1-o-t", "idiot"), ("s c u m.", "scum"), ("s c u m. s c u m!", "scum"),
])
def test_restores_beside_punctuation(spark, model, seen, want):
    test_restores(spark, model, seen, want)


@pytest.mark.parametrize("seen,want", [
    ("i d i o t s c u m", "idiot scum"), ("a m o r o n", "a moron"), ("1 2 3 4 5 a b c d", "1 2 3 4 5 a b c d"), ("a b c d", "a b c d"), ("i d 1 0 t", "idiot"), ("s t u u u p i d", "stupid"),
    ("s-t-u-u-u-p-i-d", "stupid"), ("i\u00b7d\u00b7i\u00b7o\u00b7t", "idiot"), ("i\u200bd\u200bi\u200bo\u200bt", "idiot"), ("id\u200b\u2060iot", "idiot"), ("s\u2022c\u2022u\u2022m!", "scum"),
    ("thing\u2014another", "thing\u2014another"), ("x y z", "x y z"), ("l\u00a0o\u00a0s\u00a0e\u00a0r", "loser"),
])
def test_blanks_and_wide_separators(spark, model, seen, want):
    got = toxicity.restore_texts(spark.createDataFrame([(f"Reand the {seen} of thing",)], "text string"), model).first().restored
    assert got == f"reand the {want} of thing"


def test_long_runs_of_single_characters(spark, model):
    rows = [("s c u m " * 20_000,), ("q " * 100_000,), ("z\u200b" * 50_000,)]
    out = [r.restored for r in toxicity.restore_texts(spark.createDataFrame(rows, "text string"), model).collect()]
    assert out[0].count("scum") > 10_000 and out[1] == ("q " * 100_000).strip() and "\u200bz" not in out[2]


def test_plain_text_stays(spark, model):
    rows = [("The a$$$ of,### Été über ñandú 12.5 wow!! I a",), (None,), ("",), ("ox " * 50_000,), ("a b",)]
    out = toxicity.restore_texts(spark.createDataFrame(rows, "text string"), model).collect()
    for r in out:
        assert r.restored == " ".join(re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "").split())


def test_held_out_accuracy(spark):
    from tonemill.llm.queries import LLM_QUERIES

    sf = "/root/testdata/sf0.1"
    rows = LLM_QUERIES["op3_toxicity"](spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    marks = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.held_out for r in rows) == len(held)
    y = np.array([marks[r.doc_id] for r in held if r.doc_id in marks])
    p = np.array([r.predicted for r in held if r.doc_id in marks])
    assert p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.02


def test_defined_cases(spark, model):
    docs = spark.createDataFrame([(1, "you idiot", 1), (2, None, 1), (2, None, 1), (None, "", 1), (4, "1d10t " * 20_000, 1)] + [(k, "idiot thing" if k % 2 else "nice thing", 0) for k in range(10, 90)], "doc_id long, text string, SCORE int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10, 90)] + [(None, 1), (10, None), (10, 1), (10, 0)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels, model)
    out = toxicity.with_score(docs, model, scorer)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == docs.count()
    got = {r.doc_id: r.score for r in out.collect()}
    assert got[1] > 0.5 and got[4] > 0.5 and got[2] < 0.5 and got[None] == got[2] == got[12]
    for part in (labels.limit(0), labels.where("toxic = 0")):
        none = toxicity.fit(docs, part, model)
        assert len({r.score for r in toxicity.with_score(docs, model, none).collect()}) == 1
    assert toxicity.with_score(docs.limit(0), model, scorer).count() == 0
    assert np.isfinite(toxicity.character_model(docs.limit(0))).all()
