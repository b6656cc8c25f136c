"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekha.llm import bpe, defects, lines, mixing, overlap, packing, passages, quality, scans
from lekha.session import cut
from lekha.sources import table

Query = Callable[[SparkSession, str], DataFrame]


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Documents in tokens, with their source and the hashes of their text."""
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    docs = docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})
    return cut(bpe.count(docs, keep=("doc_id", "source", "h1", "h2")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_marks(table(spark, d, "file_results", "file_id", "md_text", "n_pages"))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "file_results", "file_id", "md_text", "n_pages"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    locked = table(spark, d, "eval_set").select(F.lit("locked").alias("split"), "question_id", F.col("gold_payload").alias("payload"), "source_db", "source_table")
    holdout = table(spark, d, "holdout").select(F.lit("holdout").alias("split"), "question_id", F.to_json(F.struct("question")).alias("payload"))
    return locked.unionByName(holdout, allowMissingColumns=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(_splits(spark, d), table(spark, d, "ft_corpus", "pair_id", "input"))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "ft_corpus", "pair_id", "source_db", "source_table").distinct()
    found = cut(p2_found(spark, d))
    return found.join(train, "pair_id").groupBy("split", "source_db", "source_table").agg(F.countDistinct("question_id").alias("n_questions"), F.countDistinct("pair_id").alias("n_records"), F.count(F.lit(1)).alias("n_overlaps"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "ft_corpus", "pair_id", "task", "language", "input", "output")
    predictions = table(spark, d, "predictions", *defects.PREDICTION_KEY, "language", "input_text", "raw_output", "created_at")
    ends = defects.fit_ends(corpus.select(F.col("output").alias("answer")).unionByName(predictions.select(F.col("raw_output").alias("answer"))))
    a = defects.corpus_defects(corpus, ends).select(F.lit("ft_corpus").alias("tbl"), F.col("pair_id").alias("rec_key"), "defect")
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in defects.PREDICTION_KEY])
    return a.unionByName(defects.prediction_defects(predictions, ends).select(F.lit("predictions").alias("tbl"), key.alias("rec_key"), "defect"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("tbl", "defect").agg(F.count(F.lit(1)).alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated(table(spark, d, "documents", "doc_id", "source", "text"))


def p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "dst_path", "text")
    return lines.removed(docs, lines.repeated(docs)).select("dst_path", "source", "text", "n_removed")


def p4_removed(spark: SparkSession, d: str) -> DataFrame:
    at = lines.occurrences(lines.lines_of(table(spark, d, "documents", "doc_id", "source", "text")))
    return at.groupBy("source").agg(F.count(F.lit(1)).alias("lines_removed"), F.countDistinct("line_id").alias("different_lines"), F.countDistinct("doc_id").alias("docs"))


def p5_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.select(_sized(spark, d), table(spark, d, "source_mix"), total_tokens="corpus")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, mix = _sized(spark, d), table(spark, d, "source_mix")
    return mixing.shares(docs, mix, mixing.select(docs, mix, total_tokens="corpus"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return passages.leaked(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_set", "question_id", "gold_payload"))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    return passages.leaked(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_set", "question_id", "gold_payload"), slack=2, stride=1)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("question_id").agg(F.countDistinct("doc_id").alias("n_docs"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents", "doc_id", "text"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return bpe.decode(p7_ids(spark, d))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "pack_targets")
    # A container without a tokenizer is measured in tokens of the usual one.
    targets = targets.withColumn("tokenizer", F.coalesce("tokenizer", F.lit(bpe.USUAL)))
    names = sorted(r.tokenizer for r in targets.select("tokenizer").distinct().collect()) or [bpe.USUAL]
    docs = table(spark, d, "documents", "doc_id", "text")
    return reduce(DataFrame.unionByName, [packing.pack(bpe.count(docs, name=n, keep=("doc_id",)), targets.filter(F.col("tokenizer") == n)) for n in names])


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    return quality.not_prose(docs, table(spark, d, "common_words", "word")).select("doc_id", "kind")


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    recurring = lines.recurring_ids(lines.lines_of(docs))
    return quality.stats(docs, table(spark, d, "common_words", "word"), recurring)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_text, p2_found, p2_counts, p3_found, p3_counts, p4_found, p4_cleaned, p4_removed, p5_selection, p5_shares, p6_found, p6_near, p6_items, p7_ids, p7_decoded, p8_packed, p8_fill, p9_found, p9_stats)}


#: Lines as the operators compare them: ASCII punctuation, digits and white space
#: but the line feed become one space.
_LINES = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
n AS (SELECT doc_id, source, line_no, trim(regexp_replace(lower(line), '[!-@\[-`{-~\t\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS line FROM l),
k AS (SELECT source, line, count(DISTINCT doc_id) AS docs FROM n WHERE line <> '' GROUP BY source, line),
c AS (SELECT k.source, k.line FROM k JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) r ON k.source = r.source WHERE docs >= 5 AND docs * 20 >= total),
f AS (SELECT n.doc_id, n.source, n.line_no, n.line FROM n JOIN c ON n.source = c.source AND n.line = c.line)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _LINES + "SELECT DISTINCT doc_id, CAST(line_no AS INT) AS line_no FROM f",
        "p4_removed": _LINES + "SELECT source, count(*) AS lines_removed, count(DISTINCT line) AS different_lines, count(DISTINCT doc_id) AS docs FROM f GROUP BY source",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
