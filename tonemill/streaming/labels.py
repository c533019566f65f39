"""Labeling a stream of files with Structured Streaming.

The rule and valence (arrow) labelers are projections, so they apply to a
streaming DataFrame unchanged; the running label counts are a stateful
aggregate whose state is one row per label. Checkpoints go below the shared
checkpoint folder unless a location is given.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonemill.lexicon import DEFAULT_LEXICON, LABELS, Lexicon
from tonemill.operators.labeling import label_rules
from tonemill.session import scratch_path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files_per_trigger: int | None = None,
                **options) -> DataFrame:
    """A file stream over ``path`` (new files are picked up as they land)."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def label_stream(stream: DataFrame, text_col: str = "text", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Rule labels on a streaming DataFrame (stateless)."""
    return label_rules(stream, text_col, lexicon)


def running_label_counts(labeled: DataFrame, label_col: str = "label") -> DataFrame:
    """Stateful running count per label (use output mode ``complete`` or
    ``update``); only the three labels are counted."""
    return labeled.filter(F.col(label_col).isin(list(LABELS))).groupBy(label_col).agg(
        F.count(F.lit(1)).cast("long").alias("n")
    )


def write_stream(stream: DataFrame, out_path: str, checkpoint: str | None = None, fmt: str = "parquet",
                 available_now: bool = True, output_mode: str = "append") -> StreamingQuery:
    """Start writing ``stream`` to files; ``available_now`` processes what
    is there and stops (exactly-once through the checkpoint)."""
    spark = stream.sparkSession
    ckpt = checkpoint or scratch_path(spark, "stream-checkpoint")
    writer = stream.writeStream.format(fmt).option("checkpointLocation", ckpt).outputMode(output_mode)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(out_path)


def label_files_once(spark: SparkSession, in_dir: str, schema, out_path: str | None = None,
                     fmt: str = "parquet", text_col: str = "text", lexicon: Lexicon = DEFAULT_LEXICON,
                     path_glob: str | None = None) -> DataFrame:
    """Label every file in ``in_dir``, a folder or a pattern of files and folders
    (optionally only file names matching ``path_glob``), through the streaming engine (available-now
    trigger) and return the written result as a table."""
    out = out_path or scratch_path(spark, "stream-out")
    opts = {"pathGlobFilter": path_glob} if path_glob else {}
    q = write_stream(label_stream(read_stream(spark, in_dir, schema, fmt, **opts), text_col, lexicon), out,
                     checkpoint=os.path.join(out, "_checkpoint") if out_path is None else None)
    q.awaitTermination()
    return spark.read.parquet(out)
