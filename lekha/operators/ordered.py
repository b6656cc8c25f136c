"""Running sums, budgets, packing of token streams: state carried along an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekha.session import cut

#: Rows of a range of an order, on average over the whole table.
RANGE_ROWS = 20_000
#: Of a table's order, as rows of a range may be spilled while they are sorted.
ORDER_ROWS = 5_000_000


def _ranges(rows: DataFrame, parts: int) -> int:
    """Ranges of the whole table's order: a task each, and more where that is too many
    rows for a task."""
    return parts or max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ORDER_ROWS))


def running_sum(rows: DataFrame, order: list[str], value: str, out: str = "before", parts: int = 0) -> DataFrame:
    """``rows`` with the sum of ``value`` over all earlier rows of the whole table.

    Two steps, as a window without partitions would be one task: rows are cut into
    ranges of the order, the ranges' sums are summed up, and each range is summed
    by itself. ``order`` must tell rows apart; null values count as 0.
    """
    n = _ranges(rows, parts)
    ranges = cut(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    zero = F.coalesce(F.col(value), F.lit(0))
    sums = ranges.groupBy("__part").agg(F.sum(zero).alias("__sum"))
    # One row per range.
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = F.coalesce(F.sum(zero).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranges.withColumn("__inside", inside).join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__inside")).drop("__part", "__inside", "__start")


def later_min(rows: DataFrame, order: str, value: str, out: str, parts: int = 0) -> DataFrame:
    """``rows`` with the least ``value`` of themselves and all later rows of the whole
    table, by ranges as in ``running_sum``."""
    n = _ranges(rows, parts)
    ranges = cut(rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()))
    least = ranges.groupBy("__part").agg(F.min(value).alias("__least"))
    # One row per range.
    after = least.withColumn("__after", F.min("__least").over(W.orderBy("__part").rowsBetween(1, W.unboundedFollowing))).drop("__least")
    inside = F.min(value).over(W.partitionBy("__part").orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing))
    return ranges.withColumn("__inside", inside).join(F.broadcast(after), "__part").withColumn(out, F.least("__inside", "__after")).drop("__part", "__inside", "__after")


def group_running_sum(rows: DataFrame, group: str, order: list[str], value: str, out: str = "before", ranges: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over the earlier rows of their group. A
    group of any size is spread over ``ranges`` ranges (else as many as the table has
    RANGE_ROWS rows) of a hash of its order, which here must begin with a column of
    hash digits (hexadecimal)."""
    ranges = ranges or min(1 << 20, max(16, -(-rows.select(group).count() // RANGE_ROWS)))
    bucket = F.pmod(F.conv(F.substring(order[0], 1, 8), 16, 10).cast("bigint"), F.lit(1 << 32))
    x = rows.withColumn("__b", F.floor(bucket / ((1 << 32) // ranges)))
    sums = x.groupBy(group, "__b").agg(F.sum(value).alias("__sum"))
    starts = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col(group).alias("__g"), F.col("__b").alias("__c"), "__start")
    inside = F.coalesce(F.sum(value).over(W.partitionBy(group, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("__inside", inside).join(starts, (F.col(group).eqNullSafe(F.col("__g"))) & (F.col("__b") == F.col("__c")))
    return x.withColumn(out, F.col("__start") + F.col("__inside")).drop("__b", "__inside", "__start", "__g", "__c")


def within_budget(rows: DataFrame, group: str, order: list[str], value: str, cap: str) -> DataFrame:
    """Rows of each group as long as those before them have not reached the group's
    cap; null caps are none. The last row may pass the cap."""
    return group_running_sum(rows, group, order, value, "__before").filter(F.col(cap).isNull() | (F.col("__before") < F.col(cap))).drop("__before")


def pack_stream(docs: DataFrame, order: list[str], ids: str, length: int, eos: int, bos: int | None = None) -> DataFrame:
    """Rows of exactly ``length`` ids cut from the stream of all documents, each
    ended by ``eos`` (and begun by ``bos``, once). The tail that fills no row is
    dropped. seq_no and input_ids. Empty or null lists add no ids.

    Documents get their place in the stream by a running sum, are cut into the rows
    they reach into, and rows are put together from these pieces.
    """
    # Ids may be dear to compute: once, and not again where rows are sampled and counted.
    docs = cut(docs.select(*order, F.col(ids).cast("array<int>").alias(ids)))
    framed = docs.filter(F.size(ids) > 0).select(*order, F.concat(F.when(F.col(ids)[0] == bos, F.array().cast("array<int>")).otherwise(F.array(F.lit(bos)).cast("array<int>")) if bos is not None else F.array().cast("array<int>"), F.col(ids).cast("array<int>"), F.array(F.lit(eos))).alias("__ids"))
    at = running_sum(framed.withColumn("__n", F.size("__ids").cast("bigint")), order, "__n", "__at")
    total = at.agg(F.max(F.col("__at") + F.col("__n"))).first()[0] or 0
    pieces = at.withColumn("seq_no", F.explode(F.sequence(F.floor(F.col("__at") / length), F.floor((F.col("__at") + F.col("__n") - 1) / length)))).filter(F.col("seq_no") < total // length)
    begin = F.greatest(F.lit(0), F.col("seq_no") * length - F.col("__at"))
    stop = F.least(F.col("__n"), (F.col("seq_no") + 1) * length - F.col("__at"))
    pieces = pieces.select("seq_no", "__at", F.slice("__ids", (begin + 1).cast("int"), (stop - begin).cast("int")).alias("__p"))
    return pieces.groupBy("seq_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__p"))), lambda x: x["__p"])).alias("input_ids"))


def islands(rows: DataFrame, group: str, order: str, flag: str) -> DataFrame:
    """Runs of rows in a group for which ``flag`` holds: group, first, last, n. The
    run's number is a running count of the other rows over the whole table, so one
    large group is spread over all tasks. ``order`` must tell a group's rows apart;
    a null flag doesn't hold."""
    x = rows.withColumn("__off", F.when(F.col(flag), 0).otherwise(1))
    x = running_sum(x, [group, order], "__off", "__gap").filter("__off = 0")
    return x.groupBy(group, "__gap").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__gap")
