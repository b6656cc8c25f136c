"""Streaming forms of the resumable and stateful steps.

Every stream has a checkpoint folder, so it goes on after a lost driver or executor;
sinks are idempotent per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lekha.functions.text import clean, drop_reason
from lekha.operators.ordered import running_sum
from lekha.session import broadcast_if_small, cut


def first_seen(stream: DataFrame, key: str, at: str, within: str = "7 days") -> DataFrame:
    """Rows whose key was not seen within the time: state is dropped by watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def cleaned(stream: DataFrame, text: str = "text") -> DataFrame:
    """Cleaning and drop reason, row by row, as in a batch."""
    return stream.withColumn(text, clean(F.col(text))).withColumn("reason", drop_reason(F.col(text)))


def append_shards(stream: DataFrame, path: str, checkpoint: str):
    """Append-only shards, one per batch: a batch that runs again overwrites its own
    shard. Read them back with ``latest``."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    from lekha.operators.dedup import keep_last

    return keep_last(spark.read.parquet(path).drop("batch"), keys, order)


def within_budget(stream: DataFrame, group: str, tokens: str, budget: int, columns: list[str]) -> DataFrame:
    """Rows of each group until their tokens reach the budget; the running sum is
    the group's state. Rows of one batch are taken in the order of ``columns``. A
    group's rows of one batch come into one task; ``budgeted`` spreads them."""
    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in columns)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(columns)
        before = used + rows[tokens].cumsum() - rows[tokens]
        kept = rows[before < budget]
        state.update((int(used + kept[tokens].sum()),))
        yield kept[columns]

    return stream.groupBy(group).applyInPandasWithState(run, schema, "used bigint", "append", GroupStateTimeout.NoTimeout)


def budgeted(stream: DataFrame, group: str, order: list[str], tokens: str, budget: int, path: str, checkpoint: str):
    """As ``within_budget``, for groups of any size: a batch is one running sum over all
    tasks, and what earlier batches gave is read back from their sums. Rows go to
    ``path``/rows, sums to ``path``/used, a batch that runs again overwrites its own.
    ``order`` must tell a group's rows apart; rows without group are left out."""

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        spark.createDataFrame([], f"{group} {df.schema[group].dataType.simpleString()}, used bigint").write.mode("overwrite").parquet(f"{path}/used/batch=-1")
        used = spark.read.parquet(f"{path}/used").filter(F.col("batch") < batch).groupBy(group).agg(F.sum("used").alias("__used"))
        x = running_sum(df.filter(F.col(group).isNotNull()), [group, *order], tokens, "__at")
        start = x.groupBy(group).agg(F.min("__at").alias("__start"))
        x = x.join(broadcast_if_small(start), group).join(broadcast_if_small(used), group, "left")
        kept = cut(x.filter(F.col("__at") - F.col("__start") + F.coalesce("__used", F.lit(0)) < budget).select(*df.columns))
        kept.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        kept.groupBy(group).agg(F.sum(tokens).cast("bigint").alias("used")).write.mode("overwrite").parquet(f"{path}/used/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def regression_gate(stream: DataFrame, run_id: str, step: str, accuracy: str, soft: float = 0.02, hard: float = 0.05) -> DataFrame:
    """Verdict per measurement against the run's baseline (its first step): OK, WARN
    past ``soft``, HARD_STOP past ``hard``."""
    out = f"{run_id} string, {step} bigint, {accuracy} double, drop double, verdict string"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(step)
        base = state.get[0] if state.exists else float(rows[accuracy].iloc[0])
        state.update((base,))
        drop = base - rows[accuracy]
        verdict = pd.Series("OK", rows.index).mask(drop > soft, "WARN").mask(drop > hard, "HARD_STOP")
        yield pd.DataFrame({run_id: rows[run_id], step: rows[step], accuracy: rows[accuracy], "drop": drop, "verdict": verdict})

    return stream.groupBy(run_id).applyInPandasWithState(run, out, "base double", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per time window and kind; rows later than ``late`` are not counted."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"))
