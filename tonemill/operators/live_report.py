"""A report that is kept up to date file by file.

Every number of the report is a sum of counters, so the counters of each input
file are stored (one row per file, known by path, length and time of change)
and the report is their sum. An update lists the folder, labels only files whose
counters are not stored, appends their rows and adds up the rows of the files
that are there now: a new file costs that file, a changed one is read again,
one that is gone no longer counts. A failed update loses nothing that it stored.

The listing and the stored rows are tables, joined by Spark; only the names of
``FILES_AT_ONCE`` new files at a time come to the driver, which hands them to
the reader. Files without rows have counters of zero. Two updates at once may
store a file twice; one of the rows counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.operators.labeling import label_rules
from tonemill.operators.report import COUNTERS, counters, metrics_of
from tonemill.sources.reviews import literal_path

FILES_AT_ONCE = 100_000
FILE = ["file", "length", "modified"]
STATE = "file string, length long, modified timestamp, " + ", ".join(f"{c} long" for c in COUNTERS)


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Path, length and time of change of every file below ``path``; no content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "length", F.col("modificationTime").alias("modified"))


class LiveReport:
    """Counters of labeled files, stored below ``store``.

    ``read`` turns a list of paths into a table (one file source scan, Parquet by
    default); ``label`` labels it."""

    def __init__(self, spark: SparkSession, store: str, read: Callable[[list[str]], DataFrame] | None = None,
                 label: Callable[[DataFrame], DataFrame] = label_rules):
        self.spark, self.store, self.label = spark, store, label
        self.read = read or (lambda paths: spark.read.parquet(*paths))

    def stored(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.store)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(self.store).dropDuplicates(FILE)

    def update(self, path: str | list[str]) -> int:
        """Label the files below ``path`` whose counters are not stored; how many."""
        done = 0
        while True:
            new = listed(self.spark, path).join(self.stored().select(*FILE), FILE, "left_anti").limit(FILES_AT_ONCE).collect()
            if not new:
                return done
            self._store(new)
            done += len(new)

    def _store(self, new: list) -> None:
        rows = self.read([literal_path(r["file"]) for r in new]).withColumn("__tm_file", F.col("_metadata.file_path"))
        counted = self.label(rows).groupBy(F.col("__tm_file").alias("file")).agg(*counters("label", "confidence"))
        files = self.spark.createDataFrame(new, "file string, length long, modified timestamp")
        files.join(counted, "file", "left").fillna(0, COUNTERS).select(*FILE, *COUNTERS).write.mode("append").parquet(self.store)

    def report(self, path: str | list[str]) -> DataFrame:
        """The report over the files that are below ``path`` now (after an update)."""
        self.update(path)
        there = self.stored().join(listed(self.spark, path), FILE, "left_semi")
        return metrics_of(there.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]))
