"""Model answers that outlive a run: each different input is asked once.

An answer table is a folder of Parquet files below a path the caller names: two
64-bit hashes of the model input (together its key) and what the model said. A
run takes the distinct inputs of the data, drops those the table knows (an
anti-join on keys), asks the model for the rest and appends. Copies in other
batches, tasks or runs are never asked again; an input for which the model gave
nothing at all (it raised, or had no answer) is. Answers are stored in
``batches`` jobs, so a run that fails loses one batch and the next one goes on
from there. ``per_minute`` bounds the inputs asked a minute over all tasks.

What moves: the cut model inputs (512 characters at most, merged in each task
before the exchange), never whole texts. Answers are attached by key: broadcast
up to ``BROADCAST_ANSWERS`` of them, else by a merge join that moves the rows once.
Of several answers for one key (two runs at once) the smallest one counts.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.session import keep_table

BROADCAST_ANSWERS = 1_000_000
_K1, _K2, _INPUT, _BATCH = "__tm_k1", "__tm_k2", "__tm_input", "__tm_batch"


def _keys(text: Column) -> dict[str, Column]:
    return {_K1: F.xxhash64(text), _K2: F.xxhash64(F.lit("second"), text)}


class paced:
    """A model whose callers wait, so that one task asks ``per_minute`` inputs a
    minute at most: it gets about a second's worth at a time, and what is left of
    the time these are due is slept."""

    def __init__(self, model: Callable, per_minute: float):
        self.model, self.per_minute = model, per_minute

    def __call__(self, inputs):
        step, parts = max(1, int(self.per_minute / 60)), []
        for first in range(0, len(inputs), step):
            part, began = inputs.iloc[first:first + step], time.monotonic()
            parts.append(self.model(part))
            time.sleep(max(0.0, 60.0 * len(part) / self.per_minute - (time.monotonic() - began)))
        return pd.concat(parts, ignore_index=True) if parts and isinstance(parts[0], pd.DataFrame) else [x for p in parts for x in p]


class AnswerTable:
    """The stored answers of one model: ``columns`` is their DDL."""

    def __init__(self, spark: SparkSession, path: str, columns: str):
        self.spark, self.path = spark, path
        self.names = [c.split()[0] for c in columns.split(",")]
        self.schema = f"{_K1} long, {_K2} long, {columns}"

    def stored(self) -> DataFrame:
        """One row per key; empty before the first run."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows.groupBy(_K1, _K2).agg(F.min(F.struct(*self.names)).alias("a")).select(_K1, _K2, "a.*")

    def unseen(self, inputs: DataFrame, text: Column) -> DataFrame:
        """The distinct inputs without a stored answer (key and input)."""
        asked = inputs.select(text.alias(_INPUT)).where(F.col(_INPUT).isNotNull()).withColumns(_keys(F.col(_INPUT)))
        return asked.groupBy(_K1, _K2).agg(F.min(_INPUT).alias(_INPUT)).join(self.stored().select(_K1, _K2), [_K1, _K2], "left_anti")

    def fill(self, inputs: DataFrame, text: Column, udf_of: Callable, model: Callable, batches: int = 1,
             per_minute: float | None = None, tasks: int = 1) -> None:
        """Ask ``model`` for every unseen input of ``inputs`` and store what it
        says. ``udf_of(model)`` is the pandas UDF that asks; with ``per_minute``
        ``tasks`` tasks share that rate."""
        if batches < 1 or tasks < 1:
            raise ValueError("batches and tasks must be 1 or more")
        batch = F.pmod(_K2, F.lit(batches)).alias(_BATCH)
        todo = keep_table(self.unseen(inputs, text).select(_K1, _K2, _INPUT, batch), name="unseen-inputs")
        model = paced(model, per_minute / tasks) if per_minute else model
        for k in range(batches):
            part = todo.where(F.col(_BATCH) == k)
            if per_minute:
                part = part.repartition(tasks, _K1)
            said = part.select(_K1, _K2, udf_of(model)(F.col(_INPUT)).alias("a"))
            said = said.select(_K1, _K2, "a.*") if len(self.names) > 1 else said.withColumnRenamed("a", self.names[0])
            said.where(F.coalesce(*[F.col(n).cast("string") for n in self.names]).isNotNull()).write.mode("append").parquet(self.path)

    def attach(self, df: DataFrame, text: Column) -> DataFrame:
        """``df`` with the stored answers of its inputs (null where there is none)."""
        answers = self.stored()
        few = answers.limit(BROADCAST_ANSWERS + 1).count() <= BROADCAST_ANSWERS
        keyed = df.withColumns(_keys(text))
        joined = keyed.join(F.broadcast(answers), [_K1, _K2], "left") if few else keyed.hint("merge").join(answers, [_K1, _K2], "left")
        return joined.drop(_K1, _K2)


class FallbackError(RuntimeError):
    """The model gave no result for a larger share of the rows than allowed."""


def check_fallback(labeled: DataFrame, source_col: str = "source_of_label", most: float = 0.2) -> DataFrame:
    """``labeled``, unless the rules stood in for the model in more than the
    share ``most`` of its rows: then an error, as an outage should be. Run it on a
    kept table, since it reads the column once."""
    total, fell = labeled.agg(F.count(F.lit(1)), F.count_if(F.col(source_col) == "rules")).first()
    if total and fell / total > most:
        raise FallbackError(f"{fell} of {total} rows were labeled by the rules in place of the model")
    return labeled
