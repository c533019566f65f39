"""Valence labeler: sum the valences of a text's tokens, normalise the sum
to a compound score in [-1, 1], and map it to a label.

The lexicon is an input (a ``(token, valence)`` table or a dict). The caller
picks the physical strategy; the results are the same:

* ``arrow`` (the default): tokens are extracted in the JVM and looked up in the
  broadcast lexicon with a hashed ``index_in``. Only the token column crosses into
  Python; no shuffle, works on streams. The lexicon is broadcast, so it may have
  ``BROADCAST_MAX`` entries at most; more is an error, unless ``over="join"`` sends
  it the way of ``join``.
* ``join`` (any lexicon size): the corpus's distinct tokens, folded in each task
  before they move, are joined with the lexicon; what is left of the lexicon, the
  entries that some text holds, is written and looked up as in ``arrow``, so no
  text is shuffled or stored. Only if more than ``BROADCAST_MAX`` entries are left,
  rows get an id and the entries that stand in most rows are broadcast, as many as
  may be; each row's other tokens are counted within the row, checkpointed with it,
  joined with the other entries and summed per row id; the sums are joined back.
  Without context rules only these tokens move, at most once. (With them, tokens
  are exploded with their places, and all of them are joined.)

Valences are decimals of ``VALENCE_DECIMALS`` places, summed as whole numbers, so
the sum is exact and does not depend on the order of the tokens. With context
rules the adjusted valences are added in token order, in doubles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tonemill.functions import valence as V
from tonemill.functions.rules import to_percent
from tonemill.session import checkpointed, keep_table

BROADCAST_MAX = 2_000_000  # lexicon entries broadcast to every task
PIECE_TOKENS = 500_000  # tokens of an Arrow batch that are looked up together
STRATEGIES = ("arrow", "join")
_ROW = "__tm_row"
_FOUND = "__tm_found"


def lexicon_frame(spark: SparkSession, lexicon) -> DataFrame:
    """``(token string, valence double, scaled long)`` from a dict, pairs or a
    DataFrame (which is computed once and written). Tokens are lower-cased; entries
    without a token or a valence say nothing and are left out; a token that occurs
    twice is an error."""
    if isinstance(lexicon, DataFrame):
        cols = lexicon.columns
        out = lexicon.select(F.lower(F.col(cols[0]).cast("string")).alias("token"),
                             F.col(cols[1]).cast("double").alias("valence"))
    else:
        items = lexicon.items() if isinstance(lexicon, dict) else lexicon
        rows = [(None if k is None else str(k), None if v is None else float(v)) for k, v in items]
        out = spark.createDataFrame(rows, "token string, valence double").withColumn("token", F.lower("token"))
    out = out.where(F.col("token").isNotNull() & F.col("valence").isNotNull() & ~F.isnan("valence"))
    if isinstance(lexicon, DataFrame):
        out = keep_table(out, name="lexicon")
    twice = out.groupBy("token").count().where("count > 1").select("token").take(1)
    if twice:
        raise ValueError(f"the lexicon repeats the token {twice[0][0]!r}")
    return out.withColumn("scaled", V.scaled_valence("valence"))


_LEXICONS: dict = {}


def _sent(spark: SparkSession, lex: DataFrame, value: str):
    """The broadcast (Arrow keys, Arrow values) of a lexicon, as columns all the way."""
    table = lex.select("token", value).toArrow()  # bounded: the caller has checked the count
    if table.column(1).null_count:
        raise ValueError(f"valences are decimals of {V.VALENCE_DECIMALS} places and of 18 digits at most")
    return spark.sparkContext.broadcast([table.column(i).combine_chunks() for i in (0, 1)])


def _lexicon_arrays(name: str, broadcast):
    """The broadcast lexicon as (Arrow keys, numpy values), built once per
    Python worker and kept for the last few lexicons only."""
    if name not in _LEXICONS:
        keys, values = broadcast.value
        if len(_LEXICONS) >= 4:
            _LEXICONS.clear()
        _LEXICONS[name] = (keys, values.to_numpy(zero_copy_only=False))
    return _LEXICONS[name]


def _pieces(tokens, n_keys: int):
    """An Arrow array of token lists in slices of whole rows, about ``PIECE_TOKENS``
    tokens each (more for a large lexicon, whose hash is built for every slice), so
    that what is made of a slice does not grow with the batch."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    size, a = max(PIECE_TOKENS, 2 * n_keys), 0
    while a < len(tokens):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield tokens.slice(a, z - a)
        a = z


def _hits(tokens, keys):
    """Of an Arrow array of token lists: flat tokens, where each row's begin (and
    the end), which of them are lexicon tokens and their lexicon entries."""
    import numpy as np
    import pyarrow.compute as pc

    flat = pc.list_flatten(tokens)
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    entry = pc.index_in(flat, value_set=keys)
    return flat, begins, entry.is_valid().to_numpy(zero_copy_only=False), entry.drop_null().to_numpy(zero_copy_only=False)


def _row_sums(begins, hit, weights):
    """Per row, the exact sum of the whole-numbered weights of its hits."""
    import numpy as np

    total = np.concatenate([[0], np.cumsum(weights.astype(np.int64))])
    upto = np.searchsorted(np.flatnonzero(hit), begins)
    return total[upto[1:]] - total[upto[:-1]]


def _lexicon_sum(spark: SparkSession, lex: DataFrame):
    """Arrow UDF: token list -> exact sum of scaled valences."""
    known, name = _sent(spark, lex, "scaled"), uuid.uuid4().hex

    def run(tokens):
        import numpy as np
        import pyarrow as pa

        from tonemill.operators.valence import _hits, _lexicon_arrays, _pieces, _row_sums

        keys, scaled = _lexicon_arrays(name, known)
        if not len(scaled) or not len(tokens):
            return pa.array(np.zeros(len(tokens), np.int64))
        sums = []
        for piece in _pieces(tokens, len(keys)):
            _, begins, hit, entry = _hits(piece, keys)
            sums.append(_row_sums(begins, hit, scaled[entry]))
        return pa.array(np.concatenate(sums))

    return F.arrow_udf(_typed(run, "tokens"), LongType())


def _lexicon_split(spark: SparkSession, lex: DataFrame):
    """Arrow UDF: token list -> the exact sum of scaled valences, and the row's
    different tokens that are not in the lexicon with how often each stands there."""
    known, name = _sent(spark, lex, "scaled"), uuid.uuid4().hex

    def run(tokens):
        import numpy as np
        import pyarrow as pa

        from tonemill.operators.valence import _hits, _lexicon_arrays, _pieces, _row_sums

        keys, scaled = _lexicon_arrays(name, known)
        sums, others, counts, lengths = [], [], [], []
        for piece in _pieces(tokens, len(keys)):
            flat, begins, hit, entry = _hits(piece, keys)
            sums.append(_row_sums(begins, hit, scaled[entry]))
            other = np.flatnonzero(~hit)
            codes = flat.take(pa.array(other)).dictionary_encode()
            row = np.searchsorted(begins, other, "right") - 1
            size = max(1, len(codes.dictionary))
            pairs, n = np.unique(row * size + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
            others.append(codes.dictionary.take(pa.array(pairs % size)))
            counts.append(n)
            lengths.append(np.bincount(pairs // size, minlength=len(piece)))
        ends = np.concatenate([[0], *lengths]).cumsum().astype(np.int32)
        rest = pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], pa.string()), *others]), pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], ["token", "n"])
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sums])), pa.ListArray.from_arrays(pa.array(ends), rest)], ["sum", "rest"])

    return F.arrow_udf(_typed(run, "tokens"), "sum long, rest array<struct<token: string, n: long>>")


def _rules_sum(spark: SparkSession, lex: DataFrame, rules: V.ValenceRules):
    """Arrow UDF: token list -> sum of rule-adjusted valences in token order.

    Every hit looks back at the ``window`` preceding tokens of its own row,
    nearest first: booster, then negator."""
    if len(rules.damping) < rules.window:
        raise ValueError("damping needs one factor per window step")
    known, name = _sent(spark, lex, "valence"), uuid.uuid4().hex
    boosters, negators = dict(rules.boosters), list(rules.negators)
    window, scalar, damping = rules.window, float(rules.negation_scalar), [float(x) for x in rules.damping]

    def run(tokens):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from tonemill.operators.valence import _hits, _lexicon_arrays, _pieces

        keys, values = _lexicon_arrays(name, known)
        if not len(values) or not len(tokens):
            return pa.array(np.zeros(len(tokens)))
        steps = np.append(np.asarray(list(boosters.values()), np.float64), 0.0)
        boosting, negating = pa.array(list(boosters), pa.string()), pa.array(negators, pa.string())
        sums = []
        for piece in _pieces(tokens, len(keys)):
            flat, begins, hit, entry = _hits(piece, keys)
            at = np.flatnonzero(hit)
            row = np.searchsorted(begins, at, "right") - 1
            v = values[entry].astype(np.float64)
            step = steps[pc.fill_null(pc.index_in(flat, value_set=boosting), -1).to_numpy(zero_copy_only=False)]
            negates = pc.is_in(flat, value_set=negating).to_numpy(zero_copy_only=False)
            for j in range(1, window + 1):
                p = np.maximum(at - j, 0)
                near = at - j >= begins[row]
                inc = np.where(near, step[p], 0.0) * damping[j - 1]
                v = v + np.where(v < 0, -inc, inc)
                v = v * np.where(near & negates[p], scalar, 1.0)
            sums.append(np.bincount(row, weights=v, minlength=len(piece)))
        return pa.array(np.concatenate(sums))

    return F.arrow_udf(_typed(run, "tokens"), DoubleType())


def _typed(fn, name: str):
    """Give an Arrow UDF its type hints without importing pyarrow up front."""
    import pyarrow as pa

    fn.__annotations__ = {name: pa.Array, "return": pa.Array}
    return fn


def valence_compound(
    df: DataFrame,
    lexicon,
    text_col: str = "text",
    out: str = "compound",
    strategy: str = "arrow",
    rules: V.ValenceRules | None = None,
    over: str = "error",
) -> DataFrame:
    """Add ``out`` = compound score of ``text_col`` (4 decimals). ``rules``
    (negation and booster windows, emphasis) run in both strategies. ``over``:
    what ``arrow`` does with a lexicon over ``BROADCAST_MAX``, ``"error"`` or
    ``"join"`` (see above)."""
    if over not in ("error", "join"):
        raise ValueError(f"unknown over {over!r}; choose 'error' or 'join'")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {STRATEGIES}")
    spark = df.sparkSession
    lex = lexicon_frame(spark, lexicon)
    n_entries = lex.count()
    active = rules if rules is not None and rules.active else None
    total = "__tm_vsum"
    if strategy == "arrow" and n_entries > BROADCAST_MAX and over == "error":
        raise ValueError(f"the lexicon has {n_entries} entries; over {BROADCAST_MAX} take strategy='join'")
    if strategy == "join" or n_entries > BROADCAST_MAX:
        lex = heard(df, lex, text_col)
        n_entries = lex.count()
    if n_entries <= BROADCAST_MAX:
        udf = _rules_sum(spark, lex, active) if active else _lexicon_sum(spark, lex)
        staged = df.withColumn(total, udf(V.valence_tokens(text_col)))
    elif active:
        # The id is fixed by the checkpoint: both uses below see the same rows.
        rows = checkpointed(df.withColumn(_ROW, F.monotonically_increasing_id()))
        sums = _join_rules_sums(rows, lex, text_col, active)
        staged = rows.join(sums.withColumnRenamed("sum", total), _ROW, "left").drop(_ROW)
    else:
        staged = _with_split_sum(df, lex, text_col, total)
    if not active:
        return staged.withColumn(out, V.compound_from_sum(total)).drop(total)
    emphasised = V.with_emphasis(F.coalesce(F.col(total), F.lit(0.0)), F.col(text_col), active)
    return staged.withColumn(total, emphasised).withColumn(out, V.compound_from_double(total)).drop(total)


def heard(df: DataFrame, lex: DataFrame, text_col: str = "text") -> DataFrame:
    """The lexicon entries whose token stands in some text, with the number of
    rows it stands in (``rows``), as a written table."""
    tokens = df.select(F.explode(F.array_distinct(V.valence_tokens(text_col))).alias("token"))
    return keep_table(lex.join(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows")), "token"), name="heard-lexicon")


def _commonness() -> Column:
    """A class of the number of rows, some tens at most for any corpus size."""
    return F.floor(F.log2(F.col("rows").cast("double")) * 8).cast("int")


def _common(lex: DataFrame) -> int:
    """The least class of commonness from which on the entries of ``lex`` are
    ``BROADCAST_MAX`` at most."""
    n, least = 0, 1 << 30
    for r in sorted(lex.groupBy(_commonness().alias("c")).count().collect(), reverse=True):
        n += r["count"]
        if n > BROADCAST_MAX:
            break
        least = r["c"]
    return least


def _with_split_sum(df: DataFrame, lex: DataFrame, text_col: str, total: str) -> DataFrame:
    """Add ``total``, the exact sum of scaled valences: the most common entries
    are looked up in place, and only the other tokens of a row are joined."""
    least = _common(lex)
    split = _lexicon_split(df.sparkSession, lex.where(_commonness() >= least))
    # The id is fixed by the checkpoint: both uses below see the same rows.
    rows = checkpointed(df.withColumns({_ROW: F.monotonically_increasing_id(), _FOUND: split(V.valence_tokens(text_col))}))
    others = rows.select(_ROW, F.inline(f"{_FOUND}.rest"))
    joined = others.join(lex.where(_commonness() < least).select("token", "scaled"), "token")
    sums = joined.groupBy(_ROW).agg(F.sum(F.col("scaled") * F.col("n")).alias(total))
    staged = rows.join(sums, _ROW, "left")
    return staged.withColumn(total, F.col(f"{_FOUND}.sum") + F.coalesce(F.col(total), F.lit(0))).drop(_ROW, _FOUND)


def _join_rules_sums(rows: DataFrame, lex_side: DataFrame, text_col: str, rules: V.ValenceRules) -> DataFrame:
    """(row id, sum) with context rules: lexicon hits and rule words are kept
    with their positions, and a window per row looks back at the up to
    ``window`` previous kept tokens; no window group is larger than a text.
    Hit valences are summed in token order by a running window sum."""
    toks = rows.select(_ROW, F.posexplode(V.valence_tokens(text_col)).alias("pos", "token"))
    rule_words = list(dict.fromkeys(list(rules.negators) + list(rules.boosters)))
    tagged = toks.join(lex_side.select("token", "valence"), "token", "left")
    kept = tagged.filter(F.col("valence").isNotNull() | F.col("token").isin(rule_words))
    w = Window.partitionBy(_ROW).orderBy("pos")
    for k in range(1, rules.window + 1):
        kept = kept.withColumn(f"__tm_p{k}", F.lag("pos", k).over(w)).withColumn(f"__tm_t{k}", F.lag("token", k).over(w))
    neg = F.array(*[F.lit(x) for x in rules.negators]) if rules.negators else None
    boost = (F.create_map(*[x for k, v in rules.boosters.items() for x in (F.lit(k), F.lit(float(v)))])
             if rules.boosters else None)
    v = F.col("valence")
    for k in range(1, rules.window + 1):  # nearest kept token first
        dist = F.col("pos") - F.col(f"__tm_p{k}")
        near = F.col(f"__tm_p{k}").isNotNull() & (dist <= rules.window)
        prev = F.when(near, F.col(f"__tm_t{k}"))
        if boost is not None:
            damp = F.element_at(F.array(*[F.lit(float(x)) for x in rules.damping[: rules.window]]), dist.cast("int"))
            inc = F.coalesce(F.element_at(boost, prev) * damp, F.lit(0.0))
            v = F.when(v < 0, v - inc).otherwise(v + inc)
        if neg is not None:
            v = F.when(F.array_contains(neg, prev), v * F.lit(rules.negation_scalar)).otherwise(v)
        kept = kept.withColumn("__tm_v", v)
        v = F.col("__tm_v")
    hits = kept.filter(F.col("valence").isNotNull())
    # Running sum in token order, so the total adds up exactly as in the
    # row-wise form; the last hit of a key carries it.
    running = hits.withColumn("__tm_run", F.sum("__tm_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return running.groupBy(_ROW).agg(F.max_by("__tm_run", "pos").alias("sum"))


def with_valence_struct(df: DataFrame, lexicon, text_col: str = "text", out: str = "valence", **kw) -> DataFrame:
    """Add ``out`` = ``struct<label, confidence>`` from the compound score."""
    comp = "__tm_compound"
    staged = valence_compound(df, lexicon, text_col, comp, **kw)
    return staged.withColumn(out, V.label_from_compound(comp)).drop(comp)


def label_valence(
    df: DataFrame,
    lexicon,
    text_col: str = "text",
    label_col: str = "label",
    confidence_col: str = "confidence",
    keep_compound: bool = True,
    **kw,
) -> DataFrame:
    """Label every row with the valence labeler; confidence in percent."""
    staged = valence_compound(df, lexicon, text_col, "compound", **kw)
    res = V.label_from_compound("compound")
    out = staged.withColumns({label_col: res.getField("label"), confidence_col: to_percent(res.getField("confidence"))})
    return out if keep_compound else out.drop("compound")

