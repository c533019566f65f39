"""Language identification: features, machines, hierarchy, held-out accuracy."""

import re
import zlib

import numpy as np

from tonemill.llm import langid
from tonemill.llm.ragged import table


def feats(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return langid.features(np.frombuffer(b"".join(raw), np.uint8), offsets)


def test_features_by_hand():
    texts = ["Ab, c!", "", "été 12 x", "a" * 300_000]
    got = feats(texts)
    for t, row in zip(texts, got):
        s = re.sub(rb" +", b" ", re.sub(rb"[^a-z\x80-\xff]", b" ", re.sub(rb"[A-Z]", lambda m: m.group().lower(), t.encode())))
        want = np.zeros(1 << langid.BITS)
        for k in (1, 2, 3):
            for i in range(len(s) - k + 1):
                g = sum(c << (8 * j) for j, c in enumerate(reversed(s[i:i + k]))) + ((k - 1) << 24)
                want[int(langid.spread(np.array([g]))[0])] += 1
        want = np.sqrt(want)
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-6), atol=1e-5)


def test_svm_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.2, 1.0, -1.0)
    w = langid.train_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.98


def test_held_out_accuracy(spark):
    from tonemill.llm.queries import LLM_QUERIES

    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    rows = LLM_QUERIES["op4_langid"](spark, sf).collect()
    assert len(rows) == len(want) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and want[r.doc_id]]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.95


def test_hierarchy_and_defined_cases(spark):
    texts = {"en": "the thing and the other of it", "de": "der und die nicht ein schön", "es": "el niño que la año de", "fr": "le été que les où des ça", "xx": "zzz qqq jjj kkk"}
    rows = [(i, f"{texts[c]} {i % 7}", c, "x") for i, c in enumerate(list(texts) * 12)]
    rows += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "12 34 !?", None, "x"), (903, "the other thing", None, "x"), (903, "the other thing", None, "x"), (904, "zzz qqq jjj kkk " * 15_000, None, "x"), (None, "le été", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, SCORE string")
    model = langid.fit(df, per_language=5)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    assert set(model.pairs) == {("de", "en"), ("es", "fr")}
    out = langid.with_language(df, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred"] and out.count() == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert all(got[i][0] == c for i, _, c, _ in rows if i is not None and i < 900)
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "en" and got[904][0] == "xx" and got[None][0] == "fr"
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.with_language(df, none).collect()} == {"und"}
    one = langid.fit(df.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.with_language(df.where("doc_id < 900"), one).collect()} == {"en"}
    assert langid.with_language(df.limit(0), model).count() == 0
    assert langid.has_letter(np.frombuffer("12 漢!?".encode(), np.uint8), np.array([0, 3, 6, 8])).tolist() == [False, True, False]
