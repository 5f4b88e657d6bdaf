"""Session settings and the few facts operators ask the session for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most bytes an operator hands to ``broadcast``, as counted rows times the bytes of
# one.  Everything beyond goes through a shuffled join with the same result.
BROADCAST_BYTES = 128 << 20


def build_session(app: str = "terrapanel", master: str | None = None, shuffle_partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", "12g").config("spark.driver.host", "127.0.0.1")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from ``spark.checkpoint.dir``.  A folder of its own is made only on a single
    machine whose session names none; anywhere else that is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "checkpoints")
    context.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(rows: int, row_bytes: int) -> bool:
    """Whether ``rows``, a counted or proven bound, of ``row_bytes`` each may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a flat table: eight bytes a field and the length of its strings."""
    strings = [n for n, t in df.dtypes if t in ("string", "binary")]
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(0))
    rows, length = df.agg(F.count("*"), F.coalesce(F.sum(text.cast("long")), F.lit(0))).first()
    return rows, length + rows * (16 + 8 * len(df.columns))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
