"""Evaluation leakage by id, by text hash and by word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.functions.text import SPACE, bind, digest, one_line, tokens, word_count
from lekha.session import broadcast_if_small, cut, join_same

#: Widths of the word n-grams, and least words of a hashed text.
WIDTHS, HASH_WORDS = (25, 50), 8

#: Words of a probe: a run of n words holds such a piece at every n - PROBE + 1 places.
PROBE = 8

#: Fields of a payload that are compared.
FIELDS = ("question", "question_text", "answer_text", "model_answer", "source_text", "explanation")


def fields(payload: Column) -> Column:
    """Non-blank texts of the compared fields of a JSON payload."""
    return F.filter(F.array(*[F.get_json_object(payload, f"$.{f}") for f in FIELDS]), lambda x: x.isNotNull() & (F.regexp_replace(x, f"{SPACE}+", "") != ""))


def gram_hashes(text: Column, n: int, step: int = 1, least: int | None = None) -> Column:
    """Different 64-bit hashes of the runs of ``n`` loose tokens that begin at every
    ``step``-th token; none for texts of fewer than ``least`` (or ``n``) tokens."""
    none = F.array().cast("array<bigint>")
    return bind(tokens(text), lambda t: F.when(F.size(t) >= (least or n), F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - n + 1, F.lit(step)), lambda i: F.xxhash64(F.slice(t, i, n))))).otherwise(none))


class EvalIndex:
    """Ids, text hashes and n-grams of an evaluation set (qid, payload)."""

    def __init__(self, evals: DataFrame, key: str = "question_id", payload: str = "gold_payload") -> None:
        self.ids = evals.select(F.col(key).alias("qid")).filter("qid IS NOT NULL").distinct()
        self.texts = evals.select(F.col(key).alias("qid"), F.explode(fields(F.col(payload))).alias("text")).distinct()
        self.hashes = self.texts.filter(word_count(F.col("text")) >= HASH_WORDS).select("qid", digest(one_line(F.col("text"))).alias("h")).distinct()

    def grams(self, n: int) -> DataFrame:
        return self.texts.select("qid", F.explode(gram_hashes(F.col("text"), n)).alias("g")).distinct()

    def hash_hits(self, corpus: DataFrame, text: str = "text") -> DataFrame:
        """Rows of ``corpus`` (with qid) whose whole text is an evaluation text."""
        return corpus.withColumn("h", digest(one_line(F.col(text)))).join(broadcast_if_small(self.hashes), "h").drop("h")

    def gram_hits(self, corpus: DataFrame, key: str, text: str = "text", n: int = WIDTHS[0]) -> DataFrame:
        """(qid, key) of every text that shares ``n`` words in a row with an evaluation
        text.

        Such a run holds a piece of PROBE words that begins at one of every n - PROBE + 1
        places of the text, so these few pieces are looked up first among all pieces of
        the evaluation texts. Only texts with a hit are taken apart word by word. No hit
        is lost. The evaluation side is broadcast up to a checked size.
        """
        least = min(PROBE, n)
        pieces = cut(self.texts.filter(F.size(tokens(F.col("text"))) >= n).select(F.explode(gram_hashes(F.col("text"), least)).alias("g")).distinct())
        probes = corpus.select(key, F.explode(gram_hashes(F.col(text), least, n - least + 1, n)).alias("g"))
        some = cut(probes.join(broadcast_if_small(pieces, 2_000_000), "g", "left_semi").select(key).distinct())
        own = join_same(corpus, some, [key], "left_semi", 200_000).select(key, F.explode(gram_hashes(F.col(text), n)).alias("g"))
        return own.join(broadcast_if_small(cut(self.grams(n)), 2_000_000), "g").select("qid", key).distinct()

    def purge(self, corpus: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
        """``corpus`` without the texts that a hash or n-gram hit names."""
        row = F.struct(*keys).alias("__key")
        bad = self.gram_hits(corpus.withColumn("__key", row), "__key", text).select("__key")
        bad = bad.unionByName(self.hash_hits(corpus.withColumn("__key", row), text).select("__key")).distinct()
        return corpus.withColumn("__key", row).join(bad, "__key", "left_anti").drop("__key")


class LeakageError(RuntimeError):
    """Raised by a gate that found leakage."""


def gate(hits: DataFrame, show: int = 10) -> None:
    """Stop a pipeline if there are hits; an action."""
    some = hits.limit(show).collect()
    if some:
        raise LeakageError(f"leakage: {[tuple(r) for r in some]}")
