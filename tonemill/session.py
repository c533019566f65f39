"""Session helpers: a sensibly configured local session for tests and the
bench, and the shared checkpoint folder.

On a cluster the session is created by the platform; nothing here overrides
settings that are already present. A checkpoint folder is only invented for a
local master whose session names none (tests); on any other master a missing
``spark.checkpoint.dir`` is an error, since executors would write to folders
that the others cannot see.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINT_ROOT = None
_SCRATCH: list[str] = []


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "tonemill") -> SparkSession:
    """Create (or fetch) a session with AQE on, UI off and Arrow enabled."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints and intermediate tables.

    Uses the directory already set on the context, else the session's
    ``spark.checkpoint.dir``; only on a local master that names neither (tests)
    is one created under the system temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(configured or _local_checkpoint_root(sc.master))
    return sc.getCheckpointDir()


def _local_checkpoint_root(master: str) -> str:
    global _LOCAL_CHECKPOINT_ROOT
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
    if _LOCAL_CHECKPOINT_ROOT is None:
        _LOCAL_CHECKPOINT_ROOT = tempfile.mkdtemp(prefix="tonemill-ckpt-")
    return _LOCAL_CHECKPOINT_ROOT


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables;
    :func:`clear_scratch` removes all of them."""
    path = os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables written below :func:`scratch_path` paths of this
    process; returns how many. Frames read from them are of no use afterwards."""
    jvm, removed = spark.sparkContext._jvm, 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        removed += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable (not local) eager checkpoint: cuts lineage and survives the
    loss of the executors that computed it. Its files go when the frame is
    garbage if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame, path: str | None = None, name: str = "labeled") -> DataFrame:
    """Write a (labeled) table once as parquet — to ``path`` or below the
    shared checkpoint folder — and return it read back.

    This is where a labeled table lives between the report, preview, filter
    and export steps: every later action reads the stored rows instead of
    labeling again (a model would be called again), and the rows survive
    the loss of the executors that computed them."""
    target = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.parquet(target)
