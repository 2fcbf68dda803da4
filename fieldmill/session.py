"""Session helpers: durable cuts of lineage and guarded broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of known width is broadcast. A row of the tables broadcast here is well under
#: 200 bytes, so this is some 20 MB on each executor.
BROADCAST_ROWS = 100_000


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once per context, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_fieldmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="fieldmill-package-")) / "fieldmill.zip"
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("fieldmill") / p.relative_to(root))
    context.addPyFile(str(made))
    context._fieldmill_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session was given, else a new local one (tests only)."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="fieldmill-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def durable(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, so that later passes and retries read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def widened(df: DataFrame) -> DataFrame:
    """df spread over the session's cores if it comes in fewer parts than there are, as from a file of one row group; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def col(name: str):
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
