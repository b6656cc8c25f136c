"""Exact and near duplicates, the first in a defined order kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.functions.text import bind, tokens
from lekha.session import cut


def _ends(rows: DataFrame, same: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in same]
    end = rows.groupBy(*same).agg(pick(F.struct(*order, *[c for c in rest if c not in order])).alias("__end"))
    return end.select(*[F.col(c) if c in same else F.col(f"__end.{c}").alias(c) for c in rows.columns])


def keep_first(rows: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal ``same``, that which is first by ``order``; of ties the one
    with the smallest content. Nulls in ``same`` are equal, nulls in ``order`` come
    first.

    The first is found by a minimum over whole rows, which is partly computed before
    the one shuffle, so one value may hold any share of the rows; a window would
    bring its rows into one task. Empty tables give an empty result.
    """
    return _ends(rows, same, order, F.min)


def keep_last(rows: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal ``same``, that which is last by ``order``; of ties the one
    with the largest content. All columns are kept, none is shuffled but once."""
    return _ends(rows, same, order, F.max)


def duplicated(rows: DataFrame, same: list[str]) -> DataFrame:
    """Groups of more than one row: ``same`` and n."""
    return rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def shingles(text: Column, n: int = 5) -> Column:
    """Different runs of ``n`` words as 64-bit hashes, none for shorter texts."""
    none = F.array().cast("array<bigint>")
    return bind(tokens(text), lambda t: F.when(F.size(t) >= n, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.slice(t, i, n)))))).otherwise(none))


class NearDuplicates:
    """Near-duplicate documents by exact Jaccard similarity of word shingles.

    Documents with the same shingles are one class, represented by its first
    document, so copies are never paired with each other. Classes are paired by a
    prefix join: of two sets with similarity t, one of the n - ceil(t n) + 1
    rarest members of either is in both. Candidates are verified exactly; no link
    is lost. Documents without shingles are classes of their own without links.
    """

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", order: list[str] | None = None, threshold: float = 0.8, n: int = 5) -> None:
        order = order or [key]
        rows = docs.select(F.col(key).alias("doc"), F.struct(*order).alias("rank"), shingles(F.col(text), n).alias("set")).withColumn("id", F.when(F.size("set") > 0, F.struct(F.xxhash64("set"), F.hash("set"), F.size("set"))))
        self.members = cut(rows.select("doc", "rank", "id", "set"))
        full = self.members.filter("id IS NOT NULL")
        firsts = full.groupBy("id").agg(F.min(F.struct("rank", "doc")).alias("first"), F.count(F.lit(1)).alias("n_docs"), F.min("set").alias("set"))
        self.classes = cut(firsts.select("id", F.col("first.doc").alias("doc"), F.col("first.rank").alias("rank"), "n_docs", F.size("set").alias("n"), "set"))
        each = self.classes.select("doc", "n", F.explode("set").alias("s"))
        often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        # A shingle of one class alone pairs nothing, but is the rarest and counts for the prefix.
        shared = each.join(often, "s").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))
        most = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
        alone = F.col("n") - F.size("shared")
        prefix = shared.withColumn("k", most - alone).filter("k > 0").select("doc", "n", F.explode(F.slice("shared", 1, F.col("k"))).alias("x")).select("doc", "n", F.col("x.s").alias("s"))
        other = prefix.withColumnsRenamed({"doc": "doc_b", "n": "n_b"})
        pairs = prefix.join(other, "s").filter("doc < doc_b").filter((F.col("n") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n"))).select("doc", "doc_b").distinct()
        a, b = (self.classes.select(F.col("doc").alias(c), F.col("set").alias(f"set_{c}"), F.col("rank").alias(f"rank_{c}")) for c in ("doc", "doc_b"))
        both = pairs.join(a, "doc").join(b, "doc_b").withColumn("common", F.size(F.array_intersect("set_doc", "set_doc_b")))
        both = both.withColumn("jaccard", F.col("common") / (F.size("set_doc") + F.size("set_doc_b") - F.col("common"))).filter(F.col("jaccard") >= threshold - 1e-12)
        self.links = cut(both.select(F.col("doc").alias("doc_a"), "doc_b", "jaccard", F.col("rank_doc").alias("rank_a"), F.col("rank_doc_b").alias("rank_b")))

    def pairs(self) -> DataFrame:
        """doc_a, doc_b and jaccard of linked classes, named by their first documents."""
        return self.links.select("doc_a", "doc_b", "jaccard")

    def linked(self) -> DataFrame:
        """Every document with its class and the number of other classes that its class is
        linked to."""
        ends = self.links.select(F.explode(F.array("doc_a", "doc_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
        named = self.members.join(self.classes.select("id", F.col("doc").alias("class_id")), "id", "left").select("doc", F.coalesce("class_id", "doc").alias("class_id"))
        return named.join(ends, "class_id", "left").select("doc", "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))

    def documents(self) -> DataFrame:
        """``linked``, and whether each document is kept."""
        gone = self.dropped().withColumnRenamed("doc", "class_id").withColumn("gone", F.lit(True))
        return self.linked().join(gone, "class_id", "left").select("doc", "class_id", "n_links", ((F.col("doc") == F.col("class_id")) & F.col("gone").isNull()).alias("kept"))

    def dropped(self) -> DataFrame:
        """Classes that go because an earlier class that stays is like them. A class
        that goes makes none go, so of a chain a-b-c the ends stay. Each round
        decides all classes whose earlier neighbours are decided."""
        earlier = F.col("rank_a") < F.col("rank_b")
        edges = cut(self.links.select(F.when(earlier, F.col("doc_a")).otherwise(F.col("doc_b")).alias("first"), F.when(earlier, F.col("doc_b")).otherwise(F.col("doc_a")).alias("later")))
        gone = edges.select(F.col("later").alias("doc")).limit(0)
        while True:
            # Undecided later ends; an end that nothing undecided precedes stays.
            waiting = edges.select(F.col("later").alias("doc")).distinct()
            stays = edges.select(F.col("first").alias("doc")).distinct().join(waiting, "doc", "left_anti")
            new = cut(edges.join(stays.withColumnRenamed("doc", "first"), "first", "left_semi").select(F.col("later").alias("doc")).distinct())
            if new.isEmpty():
                return gone
            gone = cut(gone.unionByName(new))
            # Edges from what goes, and to it, no longer count; nor do edges from what stays.
            edges = edges.join(new.withColumnRenamed("doc", "first"), "first", "left_anti").join(new.withColumnRenamed("doc", "later"), "later", "left_anti")
            edges = cut(edges)


def near_duplicates(docs: DataFrame, **options: object) -> DataFrame:
    """doc, class_id, n_links and kept of every document."""
    return NearDuplicates(docs, **options).documents()
