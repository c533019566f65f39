"""Cross-tokenizer alignment against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tonemill.llm import alignment
from tonemill.llm.bpe import byte_alphabet, default_vocabulary

LETTERS = byte_alphabet()


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_vocabulary())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())

    def both(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        raw_a = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        return ids_a, raw_a, ids_b, raw_b

    return both


def brute(coders, texts):
    """Per text (n_a, n_b, groups, links); links are (a, b) per common end."""
    out = []
    for text in texts:
        ids_a, raw_a, ids_b, raw_b = coders(text) if text else ([], [], [], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            out.append((0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, links, done = [], [], 0
        for end in common:
            groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if done < e <= end) + "|" + ",".join(str(i) for i, e in zip(ids_b, ends_b) if done < e <= end))
            links.append((ids_a[ends_a.index(end)], ids_b[ends_b.index(end)]))
            done = end
        out.append((len(ids_a), len(ids_b), groups, links))
    return out


def expected(found, ids):
    counts = Counter(link for *_, links in found for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    rows = []
    for i, (n_a, n_b, groups, links) in zip(ids, found):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        rows.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(rows, key=repr)


WORDS = ["the", "and", " ", "  ", "\n", "\t", "größe", "ñandú", "漢字", "😀", "don't", "A1b2", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "...", "　", " ", "é", "supercalifragilistic", "\x00", "®"]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(WORDS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    return made + ["", None, " ", "   ", "a", " a", "a ", "a▁b", "▁", "\n", "x" * 500, "the the the " * 50, "the the the " * 50]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, groups int, n_a string, row int")
    return sorted(map(tuple, alignment.alignment(df).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_against_libraries(spark, coders):
    made = texts()
    ids = [None if i % 17 == 3 else i // 2 for i in range(len(made))]
    rows = [(i, t, 1, "clash", 2) for i, t in zip(ids, made)]
    assert run(spark, rows) == expected(brute(coders, made), ids)


def test_pieces_and_shuffled_counts(spark, coders, monkeypatch):
    """Long texts cut in pieces, and more pairs than may be broadcast."""
    monkeypatch.setattr(alignment, "PIECE_BYTES", 64)
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 3)
    made = [t for t in texts() if t] + [" ".join(WORDS) * 20]
    found = alignment.aligned(aligner(), [alignment.pieces_of(t.encode()) for t in made])
    assert [(n_a, n_b, g.decode()) for n_a, n_b, _, g, _, _ in found] == [(n_a, n_b, ";".join(groups)) for n_a, n_b, groups, _ in brute(coders, made)]
    links = [{(int(p) >> 17, int(p) & 0x1FFFF): int(t) for p, t in zip(x[4], x[5])} for x in found]
    assert links == [dict(Counter(x)) for *_, x in brute(coders, made)]
    assert run(spark, [(i, t, 1, "", 2) for i, t in enumerate(made)]) == expected(brute(coders, made), range(len(made)))


def aligner():
    with open(default_vocabulary(), encoding="utf-8") as a, open(alignment.default_pieces(), "rb") as b:
        return alignment.Aligner(a.read(), b.read())


def test_groups_and_links_are_returned(spark, coders):
    df = spark.createDataFrame([(1, "größe und 漢字"), (2, None)], "doc_id long, text string")
    one, two = sorted(alignment.align(df).collect(), key=lambda r: r.doc_id)
    (n_a, n_b, groups, links), = brute(coders, ["größe und 漢字"])
    assert (one.n_a, one.n_b, one.groups) == (n_a, n_b, ";".join(groups))
    assert {(x.a, x.b): x.times for x in one.links} == Counter(links)
    assert (two.n_a, two.groups, two.links) == (0, "", [])


def test_empty_table(spark):
    assert run(spark, []) == []


def test_jumping_reaches_the_last_token_of_long_chains():
    a, b = np.arange(2, 4000, 2), np.append(np.arange(1, 3998, 2), 3998)  # every token overlaps two of the other side
    assert set(alignment.terminals(a, b).tolist()) == {len(a) - 1}


def test_query_over_documents(spark, coders):
    import pyarrow.parquet as pq
    from conftest import SF001
    from tonemill.llm.queries import LLM_QUERIES

    docs = pq.read_table(f"{SF001}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(map(tuple, LLM_QUERIES["op11_alignment"](spark, SF001).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)
    assert got == expected(brute(coders, [d["text"] for d in docs]), [d["doc_id"] for d in docs])
