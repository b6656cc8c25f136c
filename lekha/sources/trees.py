"""Readers of document trees, record files and JSON lines; all lazy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekha.functions.text import strip_ends

DELIMITER = "<<<END-RECORD>>>"


def _located(df: DataFrame, root: str) -> DataFrame:
    """Path below ``root``, source (its first part) and format of each file."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), scheme, ""), F.lit("+"), F.lit("%2B")))
    at = re.sub(scheme, "", root).rstrip("/") + "/"
    rel = F.when(F.contains(path, F.lit(at)), F.substr(path, F.locate(at, path) + F.lit(len(at)), F.length(path))).otherwise(path)
    return df.withColumn("rel_path", rel).withColumn("source", F.element_at(F.split("rel_path", "/"), 1)).withColumn("format", F.regexp_extract("rel_path", r"\.([A-Za-z0-9]+)$", 1))


def documents(spark: SparkSession, root: str, pattern: str = "*.{md,txt}") -> DataFrame:
    """rel_path, source, format and text of every text file below ``root``, whole. A
    missing or empty tree gives an error or no rows as Spark's reader does."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return _located(raw.select(F.col("value").alias("text"), "_metadata"), root).select("rel_path", "source", "format", "text")


def records(docs: DataFrame) -> DataFrame:
    """One row per record of delimited files, rec_no from 0; other files are one
    record. Blank records are left out, null texts have none."""
    out = docs.filter("text IS NOT NULL").select("*", F.posexplode(F.split("text", DELIMITER)).alias("rec_no", "__t")).withColumn("text", strip_ends(F.col("__t"))).drop("__t")
    return out.filter("text <> ''")


def paragraphs(docs: DataFrame) -> DataFrame:
    """One row per paragraph (blank lines between them), para_no from 0."""
    out = docs.filter("text IS NOT NULL").select("*", F.posexplode(F.split("text", r"\n[ \t]*\n+")).alias("para_no", "__t")).withColumn("text", strip_ends(F.col("__t"))).drop("__t")
    return out.filter("text <> ''")


def json_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """rel_path, source and text of JSON lines of either shape ({text} or {prompt,
    completion}); lines that can't be read and rows without text are left out."""
    schema = "text string, prompt string, completion string, title string, _bad string"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema(schema).json(root, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    text = F.coalesce(F.nullif("text", F.lit("")), F.nullif(F.concat_ws(" ", "prompt", "completion"), F.lit("")))
    good = _located(raw.select("text", "prompt", "completion", "title", "_bad", "_metadata"), root).filter("_bad IS NULL")
    return good.select("rel_path", "source", "title", text.alias("text")).filter("text IS NOT NULL")


def overlay(raw: DataFrame, text: DataFrame, path: str = "rel_path") -> DataFrame:
    """``text`` and what only ``raw`` has, by path."""
    return text.unionByName(raw.join(text.select(path), path, "left_anti"), allowMissingColumns=True)


def extracted(spark: SparkSession, root: str, extract: Callable[[bytes], tuple[str, int]], pattern: str = "*.pdf") -> DataFrame:
    """rel_path, source, text, n_pages and error of binary files, taken apart by
    ``extract`` (bytes to text and number of pages) where the files are read. A file
    that can't be taken apart has a null text and the error's name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = _located(raw.select("content", "_metadata"), root).select("rel_path", "source", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for content in b.column(2).to_pylist():
                try:
                    text, n = extract(content)
                    out.append((text, n, None))
                except Exception as e:  # noqa: BLE001 - a broken file must not end the job
                    out.append((None, None, type(e).__name__))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string())], names=["rel_path", "source", "text", "n_pages", "error"])

    return files.mapInArrow(run, "rel_path string, source string, text string, n_pages int, error string")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A pinned projection read from a database, in one repeatable-read snapshot."""
    return spark.read.format("jdbc").options(url=url, query=query, isolationLevel="REPEATABLE_READ", **options).load()
