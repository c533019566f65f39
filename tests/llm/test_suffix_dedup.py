"""Repeated-passage removal against brute force; runs, merge and anchors."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tonemill.llm import suffix_dedup as sd
from tonemill.llm.ragged import table


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_runs_of_any_size_agree(monkeypatch):
    """Runs and ranges cut anywhere give the same repeated starts."""
    rng, length = random.Random(5), 32
    core = length - sd.window_of(length) + 1
    base = "".join(rng.choice("abcd ") for _ in range(300))
    texts = [base, base[40:200] + "zz" + base[:90], "q" + base[100:260], base[:150] + "!" + base[151:]]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    doc, place, back, fore = sd.anchors(np.frombuffer(b"".join(raw), np.uint8), offsets, length)
    items = [(raw[d][a:a - f + length], raw[d][a - b:a], d, 0, int(a)) for d, a, b, f in zip(doc.tolist(), (place - offsets[doc]).tolist(), back.tolist(), fore.tolist())]
    want = {(d, i) for d, r in enumerate(raw) for i in range(len(r) - length + 1) if sum(x[j:j + length] == r[i:i + length] for x in raw for j in range(len(x))) > 1}
    for k in (1, 2, 5, 20):
        dealt = [sorted(items[i::k]) for i in range(k)]
        got = list(sd.repeated_starts(sd.merge([sd.encode_run(r) for r in dealt]), length, core))
        assert {(d, i) for d, _, low, high in got for i in range(low, high + 1)} == want


def check(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.strip_repeats(df, length=length).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def test_anchors_cover_every_start():
    rng = random.Random(3)
    for alphabet in ("ab", "abcdefgh ", "a"):
        texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 5, 31, 32, 33, 300, 2000)]
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        doc, place, back, fore = sd.anchors(np.frombuffer(b"".join(raw), np.uint8), offsets, 32)
        covered = [(d, p) for d, a, b, f in zip(doc, place - offsets[doc], back, fore) for p in range(a - b, a - f + 1)]
        assert sorted(covered) == [(d, p) for d, r in enumerate(raw) for p in range(len(r) - 31)]
        assert (back < sd.window_of(32)).all() and (fore >= 0).all()


def test_merge_is_sorted_with_true_prefixes():
    rng = random.Random(4)
    for k in (1, 2, 3, 7, 8):
        runs = []
        for _ in range(k):
            items = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"x" * rng.randint(0, 3)) for _ in range(rng.randint(0, 40)))
            runs.append([(s, b, 1, 2, i) for i, (s, b) in enumerate(items)])
        out = list(sd.merge([sd.encode_run(r) for r in runs]))
        want = sorted(i for r in runs for i in r)
        assert sorted(i for _, i in out) == want and [i[0] for _, i in out] == sorted(i[0] for i in want)
        last = b""
        for lcp, item in out:
            assert lcp == sd.shared_prefix(last, item[0])
            last = item[0]


def test_merge_never_compares_known_prefixes(monkeypatch):
    seen = []
    real = sd.shared_prefix
    runs = [sd.encode_run([(b"p" * 50 + bytes([65 + i, 65 + k]), b"", 0, 0, 0) for i in range(20)]) for k in range(4)]
    monkeypatch.setattr(sd, "shared_prefix", lambda a, b, start=0: (seen.append((start, m := real(a, b, start))), m)[1])
    assert len(list(sd.merge(runs))) == 80
    assert sum(start == 0 for start, _ in seen) <= 3  # only while the tree is built


@pytest.mark.parametrize("seed", range(4))
def test_random_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(sd, "HOT_PLACES", 4 if seed == 3 else 100_000)
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(6)]
    texts = [None, "", "ab", "a" * 200, "abc" * 60, "x" * 31, "x" * 32]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                i = rng.randrange(len(p))
                p = p[:i] + rng.choice("xyz") + p[i + rng.randint(0, 2):]
            parts += [p[rng.randrange(4):] if rng.random() < 0.5 else p, " ".join(word() for _ in range(rng.randint(0, 12)))]
        texts.append(" ".join(parts))
    texts += texts[10:14] + [texts[20]] * 5
    check(spark, texts, 32)


@pytest.mark.parametrize("hot", [3, 40, 10**6])
def test_hot_passage_in_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT_PLACES", hot)
    rng = random.Random(9)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120))
    texts = [base]
    for k in range(80):
        i = rng.randrange(len(base))
        texts.append(base[:i] + f"<{k}>" + base[i + 1:])
    check(spark, texts, 100)


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "q" * 900, 5, None), (2, None, 6, "z"), (None, "short", 7, "z")], "doc_id long, text string, N_bytes int, `odd.name` string")
    out = sd.strip_repeats(df)
    assert out.columns == ["doc_id", "text", "odd.name", "kept", "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r["odd.name"]) for r in out.collect()) == [(0, 5, 0, "z"), (1, 900, 900, None), (2, 0, 0, "z")]
    assert sd.strip_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sd.window_of(10)


def test_query_against_brute_force(spark):
    from tonemill.llm.queries import LLM_QUERIES

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    want = {i: w for (i, _), w in zip(rows, brute([t for _, t in rows], 400))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in LLM_QUERIES["op7_suffix_dedup"](spark, sf).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_many_strings_behind_one_phrase(spark, monkeypatch):
    """Places that share only their first bytes are dealt to several ranges."""
    monkeypatch.setattr(sd, "RANGE_BYTES", 2000)
    monkeypatch.setattr(sd, "SAMPLE", 3)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    phrase, texts = word(32), []
    for _ in range(60):
        tail = word(120)
        texts += [word(40) + phrase + tail, word(40) + phrase + tail + word(9)]
    check(spark, texts, 64)


def test_texts_are_worked_on_in_segments(spark, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 100)
    monkeypatch.setattr(sd, "chunks", lambda offsets: ((k, k + 1) for k in range(len(offsets) - 1)))
    offsets = np.array([0, 950, 960, 1200])
    covered = [(a, s) for a, _, begin, end in sd.segments(offsets, 50) for s in range(begin, end - 50 + 1)]
    assert sorted(covered) == [(a, s) for a in range(3) for s in range(offsets[a], offsets[a + 1] - 50 + 1)]
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = word(700)
    check(spark, [word(300) + shared + word(50), shared[100:], word(20) + shared[:333] + word(10), shared[5:300] * 3], 64)


def test_lengths_that_cannot_be_packed_are_refused(spark):
    with pytest.raises(ValueError, match="16 to 4096"):
        sd.window_of(8000)
    check(spark, ["q" + "abc" * 2000, "z" + "abc" * 1500], 4096)


def test_short_runs_stay():
    raw = b"one two three four five six seven"
    assert sd.cut(raw, [4], [4], 9, False, least_words=3) == ([raw], 0, 0)
    assert sd.cut(raw, [4], [4], 9, False, least_words=2) == ([b"one ", raw[13:]], 9, 1)
    assert sd.cut(raw, [], [], 9, True) == ([b"", b""], len(raw), 1)


def last_step(monkeypatch, df, **options):
    """The function that cuts the texts, as the last step runs it."""
    steps, real = [], sd.in_batches
    monkeypatch.setattr(sd, "in_batches", lambda *step: (steps.append(step[1]), real(*step))[1])
    out = sd.strip_repeats(df, length=32, **options)
    return out, steps[-1]


def test_batches_follow_the_bytes_of_the_texts(spark, monkeypatch):
    """Texts that compress well do not leave a small batch as one huge one."""
    _, run = last_step(monkeypatch, spark.createDataFrame([(1, "ab")], "doc_id long, text string"))
    texts = [bytes([97 + k]) * (1 << 20) for k in range(26)]
    columns = {"row": [{"doc_id": k} for k in range(26)], "packed": [sd.squeezed(t) for t in texts], "low": [[0]] * 26, "high": [[k] for k in range(26)], "whole": [None] * 26}
    batch = pa.RecordBatch.from_pydict(columns, pa.schema([("row", pa.struct([("doc_id", pa.int64())])), ("packed", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("whole", pa.bool_())]))
    assert batch.nbytes < 20_000
    out = list(run([batch]))
    assert max(b.num_rows for b in out) <= 5
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["row"]["doc_id"] for r in rows] == list(range(26))
    assert all(r["kept"] == t[32 + k:] and r["n_removed"] == 32 + k and r["original"] == t for k, (r, t) in enumerate(zip(rows, texts)))


def test_columns_left_out_are_not_built(spark, monkeypatch):
    shared = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, "é" + shared + "x", "z"), (2, shared, None), (3, None, "y")], "doc_id long, text string, other string")
    every = sd.strip_repeats(df, length=32)
    out, _ = last_step(monkeypatch, df, without=("text", "kept"))
    assert out.columns == [c for c in every.columns if c not in ("text", "kept")]
    assert sorted(out.collect()) == sorted(every.select(*out.columns).collect())
