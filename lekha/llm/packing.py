"""Filling containers of fixed capacity: bounded-space online best-fit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BestFit:
    """Packs items as they come, with at most ``open_bins`` open containers.

    The open containers' free space is kept as bits of one integer, bit f set
    where some container has f free, so the tightest fit for an item of size s is
    the lowest bit at s or above. Where none fits and all are open, the fullest
    (lowest bit) closes. A full container closes at once.
    """

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most = capacity, open_bins
        self.bits, self.n_open, self.n_bins = 0, 0, 0
        self.at: dict[int, list[tuple[int, list]]] = {}

    def _take(self, free: int) -> tuple[int, list]:
        bins = self.at[free]
        one = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n_open -= 1
        return one

    def _keep(self, free: int, one: tuple[int, list]) -> None:
        self.at.setdefault(free, []).append(one)
        self.bits |= 1 << free
        self.n_open += 1

    def add(self, size: int, item: tuple) -> Iterator[tuple[int, list]]:
        """Place one item; gives the containers that this closes."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            one = self._take(free)
        else:
            if self.n_open >= self.most:
                yield self._take((self.bits & -self.bits).bit_length() - 1)
            free, one = self.capacity, (self.n_bins, [])
            self.n_bins += 1
        one[1].append(item)
        if free == size:
            yield one
        else:
            self._keep(free - size, one)

    def close(self) -> Iterator[tuple[int, list]]:
        for free in sorted(self.at):
            yield from self.at[free]
        self.at, self.bits, self.n_open = {}, 0, 0


def pieces(size: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the parts of an item: itself where it fits, else full
    containers and a rest."""
    start = 0
    while size - start > capacity:
        yield start, capacity
        start += capacity
    yield start, size - start


def _schema(key_type: str) -> str:
    return f"pack_name string, capacity int, container_id string, is_open boolean, doc_id {key_type}, piece_no int, start_token bigint, n_tokens bigint"


def _packer(targets: list[tuple[str, int]], open_bins: int, stage: str, types: pa.Schema, last: bool):
    """mapInArrow function over rows (part, doc_id, pack, piece_no, start, n): pack
    is the target's number, or -1 for an item that goes to every target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [BestFit(c, open_bins) for _, c in targets]
        part = ""

        def rows(closed, is_open: bool) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in types]
            for k, (n, items) in closed:
                name, capacity = targets[k]
                bin_id = f"{name}-{stage}{part}-{n}"
                for doc, piece, start, size in items:
                    for c, v in zip(cols, (name, capacity, bin_id, is_open, doc, piece, start, size), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, types, strict=True)], schema=types)

        for b in batches:
            closed: list = []
            part = str(b.column(0)[0].as_py()) if b.num_rows else part
            for doc, pack, piece, start, size in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                if pack < 0:
                    for k, (_, capacity) in enumerate(targets):
                        for p, (s, n) in enumerate(pieces(size, capacity)):
                            closed += [(k, x) for x in packers[k].add(n, (doc, p, s, n))]
                else:
                    closed += [(pack, x) for x in packers[pack].add(size, (doc, piece, start, size))]
            yield rows(closed, False)
        yield rows([(k, x) for k, p in enumerate(packers) for x in p.close()], not last)

    return run


def pack(items: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens", open_bins: int = 512, part_rows: int = 20_000, name: str = "pack_name", capacity: str = "capacity") -> DataFrame:
    """Every item of ``items`` assigned to containers of each capacity.

    Columns: pack_name, capacity, container_id, doc_id (the item's key), piece_no,
    start_token and n_tokens. An item is whole, in one piece, unless it is larger
    than the capacity; then it is cut into full containers and one rest.

    The items go in equal shares to parts of about ``part_rows`` rows, each packed
    online in the order of key and size. What is still in open containers at a
    part's end is packed again, that of 64 parts together, so that parts leave
    hardly more room than one long run would.

    Items of size 0 or null need no space but are placed too, with n_tokens 0.
    Null keys, ties and repeated rows are items like any others. Targets with a
    null name, or a capacity that is null or under 1, are left out; of repeated
    names the first capacity counts. Empty tables give an empty result; other
    columns are not carried. ``targets`` is a table of settings: it is collected,
    and over 10,000 rows are an error.
    """
    from lekha.session import cut

    rows = targets.filter(F.col(capacity) >= 1).filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("n")).agg(F.min(F.col(capacity)).alias("c")).orderBy("n").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("pack: more than 10,000 targets")
    sizes = [(str(r.n), int(r.c)) for r in rows]
    src = items.select(F.col(key).alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    key_type = src.schema[0].dataType.simpleString()
    schema = _schema(key_type)
    spark = items.sparkSession
    if not sizes:
        return spark.createDataFrame([], schema).drop("is_open")
    types = spark.createDataFrame([], schema).toArrow().schema
    # Sizes may be dear to compute, and are counted before they are packed.
    src = cut(src)
    parts = max(1, -(-src.count() // part_rows))

    def shared(df: DataFrame, n: int, order: list[str]) -> DataFrame:
        return df.repartition(n).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "pack", "piece_no", "start_token", "n")

    order = ["pack", "doc_id", "piece_no", "n"]
    first = shared(src.select("doc_id", F.lit(-1).alias("pack"), F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_token"), "n"), parts, order)
    if parts == 1:
        return first.mapInArrow(_packer(sizes, open_bins, "a", types, True), schema).drop("is_open")
    done = cut(first.mapInArrow(_packer(sizes, open_bins, "a", types, False), schema))
    number = F.create_map(*[F.lit(x) for k, (n, _) in enumerate(sizes) for x in (n, k)])
    rest = done.filter("is_open").select("doc_id", number[F.col("pack_name")].alias("pack"), "piece_no", "start_token", F.col("n_tokens").alias("n"))
    second = shared(rest, -(-parts // 64), order).mapInArrow(_packer(sizes, open_bins, "b", types, True), schema)
    return done.filter("NOT is_open").unionByName(second).drop("is_open")


def fill(packed: DataFrame) -> DataFrame:
    """Per pack: containers, tokens and the share of the room that they fill."""
    return packed.groupBy("pack_name", "capacity").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")).withColumn("fill_share", F.round(F.col("n_tokens") / (F.col("capacity") * F.col("n_containers")), 6))
