"""Seeded samples and splits in the order of a hash, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order(seed: int, key: Column) -> Column:
    """Place of a row in the seeded order: SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def uniform(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement; a limit that is the feature."""
    return rows.withColumn("__o", order(seed, F.col(key))).orderBy("__o", key).limit(n).drop("__o")


def fraction(rows: DataFrame, key: Column, share: float) -> DataFrame:
    """Rows whose first four bytes of SHA-256, as a share of their range, are below
    ``share``; decided row by row."""
    u = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)
    return rows.filter(u < share)


def repeat(rows: DataFrame, key: str, times: str) -> DataFrame:
    """Each row floor(times) times, and once more for the share of rows that the
    fraction gives; rep_no from 0. Null times count as 1."""
    t = F.coalesce(F.col(times), F.lit(1.0))
    whole = F.floor(t).cast("int")
    u = F.conv(F.substring(F.sha2(F.concat(F.col(key).cast("string"), F.lit("#"), whole.cast("string")), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)
    n = whole + F.when(u < t - whole, 1).otherwise(0)
    return rows.withColumn("__n", n).filter("__n > 0").withColumn("rep_no", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")


def first_per_group(rows: DataFrame, group: list[str], key: str, n: int, seed: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group, by key or in seeded order. Rows past ``n``
    go before the shuffle of a group's rest, by a group limit on the rank."""
    o = [F.col(key)] if seed is None else [order(seed, F.col(key)), F.col(key)]
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*group).orderBy(*o))).filter(F.col("__k") <= n).drop("__k")


def stratified(rows: DataFrame, stratum: list[str], key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (or all): of each stratum max(1, n // strata), then trimmed
    or filled up in seeded order. Adds stratum_key. ``n`` is the sample's size, so
    what is ranked over the whole table is at most ``n`` rows a stratum."""
    x = rows.withColumn("stratum_key", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stratum])).withColumn("__o", order(seed, F.col(key)))
    strata = x.select("stratum_key").distinct().count()
    per = max(1, n // max(1, strata))
    # No stratum can give more than n rows.
    x = x.withColumn("__k", F.row_number().over(W.partitionBy("stratum_key").orderBy("__o", key))).filter(F.col("__k") <= n)
    return x.orderBy(F.col("__k") > per, "__o", key).limit(n).drop("__o", "__k")


def split(rows: DataFrame, group: str, key: str, share: float, seed: int) -> DataFrame:
    """``rows`` with part, valid for max(1, floor(n share)) rows of each group and
    train for the others. Group sizes come from an aggregate; the rank is taken
    among the rows whose hash is low enough to be valid at all."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    x = rows.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, group).withColumn("__o", order(seed, F.col(key)))
    take = F.greatest(F.lit(1), F.floor(F.col("__n") * share))
    u = F.conv(F.substring("__o", 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    # Of n hashes the k-th smallest is below this bound but for a chance under 1e-12; small groups rank whole.
    bound = take / F.col("__n") + 8 * F.sqrt(take) / F.col("__n") + 40 / F.col("__n")
    low = x.filter(u < bound)
    valid = low.withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy("__o", key))).filter(F.col("__k") <= take).select(F.col(key).alias("__key"), F.lit(True).alias("__v"))
    return x.join(valid, F.col(key) == F.col("__key"), "left").withColumn("part", F.when(F.col("__v"), "valid").otherwise("train")).drop("__n", "__o", "__key", "__v")
