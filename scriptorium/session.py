"""Session set-up and the few helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "scriptorium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; on a cluster, master comes from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder; a table may be a file or a folder of part files."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder. The cluster's spark.checkpoint.dir wins; only where it is
    unset (tests, local runs) a folder of our own is made."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scriptorium-checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="scriptorium-"), "scriptorium_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"scriptorium/{p.relative_to(root)}")
    sc.addPyFile(out)
    sc._scriptorium_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Repartition only when the scan gives fewer tasks than there are cores, so that a Python stage
    over one small file is not a single task. Large inputs are left as they are scanned."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than that. Guards every broadcast of a
    side whose size is not fixed."""
    return df.limit(max_rows + 1).count() <= max_rows
