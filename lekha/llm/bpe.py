"""Byte-level BPE encoding and decoding with the vocabulary of a public tokenizer.

A text is cut into pieces by the tokenizer's public pattern; each piece's bytes
are merged by a priority queue of merge ranks over a doubly linked list of
symbols. Pieces repeat, so each worker keeps what it has merged, up to a bound.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.session import tokenizer_dir

#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bounds of a worker's memory of merged pieces: entries, and bytes of a piece.
CACHE_PIECES, CACHE_BYTES = 400_000, 96


def load_ranks(name: str, folder: str | None = None) -> dict[bytes, int]:
    """Token bytes to rank, from ``name``.tiktoken. A vocabulary is of fixed size
    (about 50,000 tokens), so it may be broadcast."""
    with open(f"{folder or tokenizer_dir()}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece.

    The queue holds (rank, start, end) of neighbours that could merge. An entry
    is stale, and skipped, if a symbol no longer starts at ``start`` or it and its
    right neighbour no longer end at ``end``.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # end of the symbol that starts here; 0 once merged away
    before = list(range(-1, n - 1))  # start of the symbol to the left
    rank = ranks.get
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(queue)
    while queue:
        _, i, stop = heappop(queue)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank(piece[i : end[stop]])) is not None:
                heappush(queue, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := rank(piece[left:stop])) is not None:
            heappush(queue, (r, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


#: The tokenizer that is meant where none is named.
USUAL = "byte_bpe_50k"


class _Merged(dict):
    """Piece to its ids as int32 bytes; fills itself."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        ids = np.array(merge(raw, self.ranks), dtype=np.int32).tobytes()
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encoder of one vocabulary in one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.pieces = regex.compile(pattern).findall
        self.merged = _Merged(ranks).__getitem__

    def raw(self, text: str | None) -> bytes:
        """Ids as int32 bytes; none for a null or empty text."""
        return b"".join(map(self.merged, self.pieces(text))) if text else b""

    def __call__(self, text: str | None) -> list[int]:
        return np.frombuffer(self.raw(text), np.int32).tolist()


def _with_broadcast(df: DataFrame, name: str, folder: str | None, pattern: str = PATTERN) -> Callable[[], Encoder]:
    """A maker of encoders that runs on workers: the vocabulary goes out once per
    executor, and one encoder serves all batches of a task."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(name, folder))
    return lambda: Encoder(ranks.value, pattern)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = USUAL, folder: str | None = None, out: str = "ids") -> DataFrame:
    """``key`` and the list of token ids of ``text``, without special tokens, of
    every row.

    Null and empty texts give an empty list, white space its own ids. Repeated
    rows, ties and null keys stay as they are, one row out for each in; other
    columns are not carried. An empty table gives an empty table. Long texts are
    encoded whole.
    """
    encoder = _with_broadcast(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoder().raw
        for b in batches:
            ids = [raw(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, out=offsets[1:])
            flat = b"".join(ids)
            values = pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[key, out])

    src = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, `{out}` array<int>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = USUAL, folder: str | None = None, out: str = "text") -> DataFrame:
    """``key`` and the text of ``ids``: the tokens' bytes put together and read as
    UTF-8, with U+FFFD for what is none. An empty or null list gives an empty
    text; an id outside the vocabulary is an error."""
    tokens = df.sparkSession.sparkContext.broadcast({r: t for t, r in load_ranks(name, folder).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = tokens.value.__getitem__
        for b in batches:
            texts = [b"".join(map(get, x)).decode("utf-8", "replace") if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, out])

    src = df.select(F.col(key).alias(key), F.col(ids).cast("array<int>").alias("ids"))
    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, `{out}` string")


def count(df: DataFrame, text: str = "text", name: str = USUAL, folder: str | None = None, out: str = "n_tokens", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of every row and its number of tokens, 0 for a null or
    empty text."""
    encoder = _with_broadcast(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoder().raw
        for b in batches:
            n = [len(raw(t)) // 4 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, out])

    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1])
    return src.mapInArrow(run, f"{fields}, `{out}` bigint")
