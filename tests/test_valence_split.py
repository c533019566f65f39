"""Lexicons over the broadcast bound: common entries in place, the rest joined."""

import math
import random

import pytest

from tonemill.operators import valence as op
from tonemill.operators.valence import valence_compound


def _texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    out = [" ".join(rng.choices(words[: 1 + k % 60], k=k % 23)) for k in range(200)]
    return [*out, None, "", "w1 " * 700, "no such word", "w59 w59 w58 w1"]


LEX = {f"w{k}": round((k % 9 - 4) * 0.31, 2) for k in range(60) if k % 7}


def _want(text):
    s = sum(LEX.get(t, 0.0) for t in (text if text is not None else "nan").split())
    return round(s / math.sqrt(s * s + 15), 4)


@pytest.mark.parametrize("bound", [0, 1, 13, 40, 1000])
def test_arrow_joins_what_is_over_the_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(op, "BROADCAST_MAX", bound)
    texts = _texts()
    df = spark.createDataFrame([(k % 190, t) for k, t in enumerate(texts)], "id long, text string").repartition(3)
    lex = spark.createDataFrame(list(LEX.items()), "token string, valence double")
    want = sorted((k % 190, _want(t)) for k, t in enumerate(texts))
    for how in ({"over": "join"}, {"strategy": "join"}):
        out = valence_compound(df, lex, **how)
        assert out.columns == ["id", "text", "compound"]
        got = sorted((r.id, r.compound) for r in out.collect())
        assert [k for k, _ in got] == [k for k, _ in want]
        assert all(abs(a - b) < 2e-4 for (_, a), (_, b) in zip(got, want))
    with pytest.raises(ValueError, match="unknown over"):
        valence_compound(df, lex, over="cut")


def test_common_entries_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_MAX", 2)
    df = spark.createDataFrame([(k, "often much " * 3 + f"rare{k}") for k in range(40)], "id long, text string")
    lex = spark.createDataFrame([("often", 1.0), ("much", 2.0), *((f"rare{k}", -1.0) for k in range(40))], "token string, valence double")
    known = op.heard(df, op.lexicon_frame(spark, lex))
    assert {r.token: r.rows for r in known.collect() if r.rows > 1} == {"often": 40, "much": 40}
    common = known.where(op._commonness() >= op._common(known))
    assert {r.token for r in common.collect()} == {"often", "much"}
    split = op._lexicon_split(spark, common)
    rest = df.select(split(op.V.valence_tokens("text")).alias("f")).select("f.*").collect()
    assert sorted((r.sum, [(x.token, x.n) for x in r.rest]) for r in rest) == sorted((9 * 10**10, [(f"rare{k}", 1)]) for k in range(40))


def test_pieces_hold_whole_rows_and_few_tokens(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(op, "PIECE_TOKENS", 10)
    rows = [["a"] * k for k in (3, 0, 9, 25, 1, 1, 8, 0, 10, 10)] + [[]]
    tokens = pa.array([["x"], *rows], pa.list_(pa.string())).slice(1)
    pieces = [p.to_pylist() for p in op._pieces(tokens, 2)]
    assert sum(pieces, []) == rows
    assert all(len(p) == 1 or sum(map(len, p)) <= 10 for p in pieces)
    assert [p for p in op._pieces(pa.array([], pa.list_(pa.string())), 2)] == []
