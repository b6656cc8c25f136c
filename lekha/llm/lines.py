"""Lines repeated across one source's documents.

A source's documents are laid out as one sequence of line identifiers and a suffix
array of it is built; neighbours in the array with a common prefix are repeated
blocks of lines, and a block that spans many documents is site matter. A source
is cut into shards of bounded size, each with its own suffix array: what stands in
5 % of a source's rows stands in 5 % of the rows of at least one shard, so no case
is lost. The blocks that shards find are then counted over all their source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.session import BROADCAST_ROWS, cut, join_same

#: ASCII punctuation and digits, and white space but the line feed, as Java classes.
_PUNCT = r"!-@\[-`{-~"
_SPACE = r"\t\x0B\x0C\r\x1C-\x1F \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

#: A case is a line in at least so many documents and so large a share of the rows.
LEAST_DOCS, LEAST_SHARE = 5, 0.05
SHARD_ROWS = 20_000


def normal_lines(text: Column) -> Column:
    """The lines of a text, split at the line feed only: ASCII punctuation and
    digits as spaces, white space runs as one space, trimmed, in lower case."""
    flat = F.regexp_replace(text, f"[{_PUNCT}{_SPACE}]+", " ")
    return F.split(F.trim(F.regexp_replace(F.lower(flat), " ?\n ?", "\n")), "\n", -1)


def line_ids(text: Column) -> Column:
    """A 64-bit identifier per line; 0 for lines left empty."""
    return F.transform(normal_lines(text), lambda x: F.when(F.trim(x) == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.trim(x))))


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks at each doubling. Identifiers
    that stand once end a comparison, so documents need a unique one between them."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    ranks, step, n = [rank], 1, len(ids)
    while n and step < n:
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = new
        ranks.append(rank)
        step *= 2
        if rank.max() == n - 1:
            break
    return np.argsort(rank, kind="stable"), ranks


def common_prefixes(array: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it."""
    n = len(array)
    a, b = array[:-1].copy(), array[1:].copy()
    out = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        out[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


def blocks(ids: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int, bool]]:
    """Right-maximal repeated blocks in at least ``least`` documents: (start of one
    occurrence, lines, documents, whether also left-maximal). ``doc`` has the
    document of each position, -1 between documents.

    The intervals of the suffix array with a common prefix are walked from the
    outermost in, all of one depth at a time; an interval in too few documents has
    none in enough.
    """
    n = len(ids)
    if not n:
        return []
    array, ranks = suffix_array(ids)
    lcp = common_prefixes(array, ranks)
    before = np.where(array > 0, ids[array - 1], -1)
    found = []
    # members: positions in the array; group: the interval of each; cut: where a new interval begins.
    members = np.arange(n)[doc[array] >= 0]
    group = np.cumsum(np.concatenate(([True], lcp[1:] < 1)))[members]
    while len(members):
        order = np.lexsort((doc[array[members]], group))
        g, d = group[order], doc[array[members[order]]]
        fresh = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))
        names, docs = np.unique(g[fresh], return_counts=True)
        kept = names[docs >= least]
        inside = np.isin(group, kept)
        members, group = members[inside], group[inside]
        if not len(members):
            break
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        counts = dict(zip(names.tolist(), docs.tolist(), strict=True))
        inner = lcp[members].copy()
        inner[starts] = np.iinfo(np.int64).max
        depth = np.minimum.reduceat(inner, starts)
        sizes = np.diff(np.concatenate((starts, [len(members)])))
        single = sizes == 1
        first = before[members[starts]]
        mixed = np.logical_or.reduceat(before[members] != np.repeat(first, sizes), starts)
        for s, l, one, m in zip(starts.tolist(), depth.tolist(), single.tolist(), mixed.tolist(), strict=True):
            at = int(array[members[s]])
            found.append((at, 1 if one else int(l), counts[int(group[s])], bool(m)))
        # An interval of one suffix goes no further; the others split where the prefix is no longer than theirs.
        go = np.repeat(~single, sizes)
        new = inner <= np.repeat(depth, sizes)
        new[starts] = True
        ids_of = np.cumsum(new)
        members, group = members[go], ids_of[go]
    return found


def _shard(least_share: float, least: int):
    """applyInArrow function over one shard's rows (source, doc_id, ids, whole)."""

    def run(rows: pa.Table) -> pa.Table:
        has = rows.filter(pc.is_valid(rows["ids"]))
        code = pc.dictionary_encode(has["doc_id"], null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
        lists = has["ids"].combine_chunks()
        raw, per = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        doc = np.repeat(code.astype(np.int64), per)
        # A separator after each document, with an identifier of its own, apart from all lines.
        ends = np.cumsum(per)
        full = raw != 0
        doc, ends, raw = doc[full], np.concatenate(([0], np.cumsum(full)))[ends], raw[full]
        ids = np.unique(raw, return_inverse=True)[1].astype(np.int64)
        ids = np.insert(ids, ends, len(raw) + np.arange(len(ends)))
        doc, raw = np.insert(doc, ends, -1), np.insert(raw, ends, 0)
        need = max(int(np.ceil(least_share * rows.num_rows - 1e-9)), least if rows["whole"][0].as_py() else 1, 1)
        out = [(raw[a : a + n], k, m) for a, n, k, m in blocks(ids, doc, need)]
        columns = [pa.array([rows["source"][0].as_py()] * len(out), rows.schema.field("source").type), pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_())]
        return pa.Table.from_arrays(columns, names=["source", "block", "shard_docs", "left_maximal"])

    return run


def lines_of(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """source, doc_id and the line identifiers of every row; checkpointed, as it is
    read for the shards and again for the counts."""
    return cut(docs.select(F.col(source).alias("source"), F.col(key).alias("doc_id"), line_ids(F.col(text).cast("string")).alias("ids")))


def shard_blocks(lines: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Blocks of lines that span enough documents of some shard: source, block
    (identifiers), shard_docs, left_maximal."""
    sizes = lines.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).withColumn("shards", F.ceil(F.col("rows") / shard_rows))
    many = join_same(lines, sizes, ["source"], broadcast_rows=BROADCAST_ROWS)
    shard = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.hash("ids"))), F.col("shards"))
    grouped = many.select("source", "doc_id", "ids", (F.col("shards") == 1).alias("whole"), shard.alias("shard"))
    kind = lines.schema["source"].dataType.simpleString()
    return grouped.groupBy("source", "shard").applyInArrow(_shard(least_share, least_docs), f"source {kind}, block array<bigint>, shard_docs bigint, left_maximal boolean")


def occurrences(lines: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every occurrence of a repeated line: source, doc_id, line_no, line_id.

    The lines of the shards' blocks are counted over their whole source; a case is
    in at least ``least_docs`` documents and ``least_share`` of the source's rows.
    """
    found = shard_blocks(lines, least_docs, least_share, shard_rows)
    # A line that is always followed by the same line stands only in longer blocks.
    some = cut(found.select("source", F.explode("block").alias("line_id")).distinct())
    at = lines.select("source", "doc_id", F.posexplode("ids").alias("line_no", "line_id")).filter("line_id <> 0")
    both = ["source", "line_id"]
    at = join_same(at, some, both, "left_semi", BROADCAST_ROWS)
    rows = lines.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    # Documents are counted in two steps, so that one line of one large source is spread first.
    per = at.select("source", "line_id", "doc_id").distinct().groupBy("source", "line_id").agg(F.count(F.lit(1)).alias("n_docs"))
    per = join_same(per, rows, ["source"], broadcast_rows=BROADCAST_ROWS)
    per = cut(per.filter((F.col("n_docs") >= least_docs) & (F.col("n_docs") >= F.ceil(F.col("rows") * least_share - 1e-9))).select("source", "line_id", "n_docs"))
    return join_same(at, per, both, "left_semi", BROADCAST_ROWS)


def repeated(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id and line_no (from 0) of each line that recurs within its source.

    Lines left empty are never cases. A null text has no lines but counts as a row
    of its source; a null source is a source of its own, and rows with a null key
    count as one document. Repeated rows of one key are one document and give each
    case once. An empty table gives an empty result; other columns are not carried.
    """
    lines = lines_of(docs, key, source, text)
    return occurrences(lines, least_docs, least_share, shard_rows).select(F.col("doc_id").alias(key), "line_no").distinct()


def recurring_ids(lines: DataFrame, **rule: float) -> DataFrame:
    """source and line_id of the lines that recur within their source."""
    return occurrences(lines, **rule).select("source", "line_id").distinct()


def removed(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` without the found lines, and n_removed, the number of
    lines taken out. Texts without such lines, and null texts, stay as they are."""
    gone = found.groupBy(F.col(key).alias("__key")).agg(F.collect_set("line_no").alias("__gone"))
    out = docs.join(gone, docs[key] == gone["__key"], "left")
    keep = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return out.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(keep)).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0))).drop("__gone", "__key")
