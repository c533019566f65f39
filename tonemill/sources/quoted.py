"""Records of delimited files with quoted newlines, read by many tasks.

A line break ends a record only outside quotes, and whether it is outside
depends on all the file before it. But a line can do no more than map "begins
outside" and "begins inside" each to one of the two, and such maps compose. So
the lines are read twice, in splits:

1. each task walks its splits for both beginnings and gives one row per split:
   where the split ends for either, and where the record begins that is open
   there. A window over a file's splits then tells how each really begins;
2. each task walks its splits again, now from the real beginning, and writes the
   lines with the record each belongs to. A line that is a record of its own stays
   where it is; only the lines of records over several lines are shuffled and
   joined, once, and these records are written too. So however often the records
   are read, the lines are walked twice.

Only flags of the lines go to Python, never their text. The table of splits (a
row per split, at most ``MAX_SPLITS``) is broadcast; a split that it does not
name, because the cluster cut the files otherwise in between, is an error.

Defined cases: lines end with LF or CRLF, and are joined by LF; the first line
that is not blank is the header and is left out with the lines before it; a
quote inside an unquoted field is a character like any other; a quote that is
never closed makes the rest of its file one record, as in the one-task parse
(without the file's last line end). Only
encodings in which ASCII bytes stand for themselves can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType, pandas_udf

from tonemill.session import keep_table

MAX_SPLITS = 1_000_000
CARRIED, DROPPED = -1, -2
_SPLITS = "fid long, block long, end0 int, end1 int, tail0 long, tail1 long"
_PLACES = "record long, line long, whole boolean"


class _Walk:
    """States and record begins along the lines of one split, for a beginning
    outside (0) and inside (1) quotes; batches follow one another."""

    def __init__(self, first_of_file: bool):
        self.header_seen, self.n = not first_of_file, 0
        self.state, self.begin = [0, 1], [CARRIED, CARRIED]

    def lines(self, blank, opens, stays, starts=(0, 1)):
        """``{start: (record begin, whole)}`` of the next lines, and which are
        no records (up to the header)."""
        import numpy as np

        opens, stays = opens.copy(), stays.copy()
        dropped = np.zeros(len(blank), bool)
        if not self.header_seen:
            named = np.flatnonzero(~blank)
            self.header_seen = bool(len(named))
            dropped[: named[0] + 1 if len(named) else len(blank)] = True
            opens[dropped], stays[dropped] = False, True
        at = np.arange(len(blank))
        fixed = np.maximum.accumulate(np.where(opens == stays, at, -1))  # the last line whose end does not depend on its beginning
        flips = np.cumsum(opens & ~stays) & 1
        out = {}
        for s in starts:
            after = np.where(fixed >= 0, opens[fixed] ^ flips[fixed], self.state[s]) ^ flips
            before = np.concatenate([[self.state[s]], after[:-1]])
            record = np.maximum.accumulate(np.where(before == 0, self.n + at, CARRIED))
            record = np.where(record == CARRIED, self.begin[s], record)
            out[s] = record, (before == 0) & (after == 0)
            self.state[s], self.begin[s] = int(after[-1]), int(record[-1])
        self.n += len(blank)
        return out, dropped


def _runs(fid, block):
    """Ranges of lines of one split each."""
    import numpy as np

    cut = np.flatnonzero((fid[1:] != fid[:-1]) | (block[1:] != block[:-1])) + 1
    return list(zip([0, *cut], [*cut, len(fid)])) if len(fid) else []


def _summaries(batches):
    """One row per split (see ``_SPLITS``)."""
    import numpy as np
    import pyarrow as pa

    walk, key, rows = None, None, []
    for batch in batches:
        fid, block, blank, opens, stays = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for a, z in _runs(fid, block):
            if key != (fid[a], block[a]):
                if walk:
                    rows.append((*key, *walk.state, *walk.begin))
                key, walk = (int(fid[a]), int(block[a])), _Walk(block[a] == 0)
            walk.lines(blank[a:z], opens[a:z], stays[a:z])
    if walk:
        rows.append((*key, *walk.state, *walk.begin))
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [f.split()[0] for f in _SPLITS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(np.asarray([r[k] for r in rows]), t) if rows else pa.array([], t) for k, t in enumerate(types)], names=names)


def _places(batches):
    """Per line: the line its record begins with, its own number in the split,
    and whether it is a whole record."""
    import numpy as np
    import pandas as pd

    walk, key = None, None
    for fid, block, blank, opens, stays, start in batches:
        fid, block, blank, opens, stays, start = [c.to_numpy() for c in (fid, block, blank, opens, stays, start)]
        parts = []
        for a, z in _runs(fid, block):
            if key != (fid[a], block[a]):
                key, walk = (fid[a], block[a]), _Walk(block[a] == 0)
            line, s = walk.n + np.arange(z - a), int(start[a])
            found, dropped = walk.lines(blank[a:z], opens[a:z], stays[a:z], (s,))
            record, whole = found[s]
            parts.append(pd.DataFrame({"record": np.where(dropped, DROPPED, record), "line": line, "whole": whole}))
        yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"record": np.zeros(0, np.int64), "line": np.zeros(0, np.int64), "whole": np.zeros(0, bool)})


def _flagged(spark: SparkSession, path, sep: str, encoding: str, glob: str) -> DataFrame:
    """The lines with their split, whether they are blank, and whether they end
    inside quotes if they begin outside (``opens``) or inside (``stays``)."""
    esc = "\\t" if sep == "\t" else "\\" + sep
    raw = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    text = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    cut = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r$", "")).otherwise(text)
    lines = raw.select(cut.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    single = F.replace("value", F.lit('""'), F.lit(""))  # a doubled quote opens and closes nothing
    quoted = F.contains("value", F.lit('"'))
    opened = lambda text: F.regexp_replace(text, f'(^|{esc})"[^"]*"', "$1").rlike(f'(^|{esc})"')
    # What follows the closing quote belongs to the same field up to the next separator.
    rest = F.regexp_replace(single, '^[^"]*"', "x")
    return lines.select(
        "value", "file", F.xxhash64("file").alias("fid"), "block", (F.btrim("value", F.lit(" \t")) == "").alias("blank"),
        (quoted & opened(single)).alias("opens"), F.when(quoted & F.contains(single, F.lit('"')), opened(rest)).otherwise(True).alias("stays"))


def split_states(lines: DataFrame) -> DataFrame:
    """(fid, block, start, rblock, rrecord): how each split really begins, and,
    if inside a record, the split and line that this record begins with."""
    ends = lines.select("fid", "block", "blank", "opens", "stays").mapInArrow(_summaries, _SPLITS)
    upto = Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("fid").orderBy("block")
    ends = ends.withColumn("flips", F.sum(F.when((F.col("end0") == 1) & (F.col("end1") == 0), 1).otherwise(0)).over(upto) % 2)
    fixed = F.when(F.col("end0") == F.col("end1"), (F.col("end0") + F.col("flips")) % 2)
    ends = ends.withColumn("after", ((F.coalesce(F.last(fixed, ignorenulls=True).over(upto), F.lit(0)) + F.col("flips")) % 2).cast("int"))
    ends = ends.withColumn("start", F.coalesce(F.lag("after").over(before), F.lit(0)))
    tail = F.when(F.col("start") == 0, F.col("tail0")).otherwise(F.col("tail1"))
    ends = ends.withColumn("open", F.when(tail != CARRIED, F.struct("block", tail.alias("record"))))
    carried = F.last("open", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    return ends.select("fid", "block", "start", carried.alias("carried")).select("fid", "block", "start", F.col("carried.block").alias("rblock"), F.col("carried.record").alias("rrecord"))


def read_records(spark: SparkSession, path, sep: str, encoding: str, glob: str) -> DataFrame:
    """``(record, file)``: every record after the header, quoted newlines and
    all; blank lines outside quotes are left out."""
    lines = _flagged(spark, path, sep, encoding, glob)
    states = keep_table(split_states(lines), name="splits")
    n = states.count()
    if n > MAX_SPLITS:
        raise ValueError(f"the files have {n} splits; raise spark.sql.files.maxPartitionBytes")
    lines = lines.join(F.broadcast(states), ["fid", "block"], "left")
    start = F.coalesce("start", F.raise_error(F.lit("the files were split otherwise than before; read them again")).cast("int"))
    place = pandas_udf(_places, _PLACES, PandasUDFType.SCALAR_ITER).asNondeterministic()
    placed = lines.select("value", "file", "block", "rblock", "rrecord", place("fid", "block", "blank", "opens", "stays", start).alias("at"))
    placed = keep_table(placed.where(F.col("at.record") != DROPPED), name="placed-lines")
    whole = placed.where("at.whole").select(F.col("value").alias("record"), "file")
    inside = F.col("at.record") == CARRIED
    parts = placed.where(~F.col("at.whole")).select(
        "file", F.when(inside, F.col("rblock")).otherwise(F.col("block")).alias("b"), F.when(inside, F.col("rrecord")).otherwise(F.col("at.record")).alias("r"),
        F.struct("block", F.col("at.line").alias("line"), "value").alias("part"))
    joined = parts.groupBy("file", "b", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["value"]), "\n").alias("record"))
    joined = keep_table(joined.select("record", "file"), name="joined-records")
    return whole.unionByName(joined).where("record <> ''")
