"""Session, checkpoints and size checks shared by all operators."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast, or a table collected, up to these sizes.
BROADCAST_ROWS = 200_000
COLLECT_ROWS = 2_000_000


def get_spark(app: str = "lekha", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = b.config(map=base | conf).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: on a cluster they
    don't see the driver's disk."""
    sc = spark.sparkContext
    if getattr(sc, "_lekha", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # A copy for the driver's file server only; nothing is computed there.
    out = tempfile.mkdtemp(prefix="lekha-package-")
    try:
        shutil.copytree(os.path.join(root, "lekha"), os.path.join(out, "src", "lekha"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(out, "lekha"), "zip", os.path.join(out, "src")))
    finally:
        shutil.rmtree(os.path.join(out, "src"), ignore_errors=True)
    sc._lekha = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, shared by all executors: that of
    ``spark.checkpoint.dir``. Only where all run on this machine and it is unset, as
    in tests, it is a temporary folder; else an unset one is an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="lekha-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` now and cut its lineage by a reliable checkpoint. A lost
    executor then costs a read, not a new run of everything before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that of it."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where its size was checked, else as it is, so
    that the join shuffles."""
    return F.broadcast(df) if small(df, rows) else df


def hash_sample(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """About ``n`` rows of ``df`` (all where it has fewer, 2 n at most), the same on
    every run: those whose hash of ``columns`` is low enough. Rows are dropped where
    they are read; ordering by the hash would send n rows of every task to one."""
    rows = df.count()
    if rows <= n:
        return df
    return df.filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < int(n / rows * (1 << 40))).limit(2 * n)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", broadcast_rows: int = 0) -> DataFrame:
    """Join on equal ``keys``, where null equals null. With ``broadcast_rows`` the
    right side is broadcast if it has at most so many rows."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    if broadcast_rows:
        right = broadcast_if_small(right, broadcast_rows)
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"__right_{k}" for k in keys])


def tokenizer_dir() -> str:
    """Folder of the public tokenizers' vocabulary files."""
    return os.environ.get("LEKHA_TOKENIZERS", "/opt/tokenizers")


__all__ = ["BROADCAST_ROWS", "COLLECT_ROWS", "StorageLevel", "broadcast_if_small", "checkpoint_dir", "cut", "get_spark", "hash_sample", "join_same", "ship", "small", "tokenizer_dir"]
