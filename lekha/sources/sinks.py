"""Writers. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, order: list[str] | None = None, by: list[str] | None = None, codec: str = "zstd") -> None:
    """Replace ``path``; with ``order`` rows are sorted within files, so the same rows
    give the same content."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    w = out.write.mode("overwrite").option("compression", codec)
    (w.partitionBy(*by) if by else w).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def conversation(prompt: Column, completion: Column) -> tuple[Column, Column]:
    """Prompt and completion as lists of one turn each."""
    turn = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return turn("user", prompt), turn("assistant", completion)


def chat(prompt: Column, completion: Column) -> Column:
    """Both turns as one list of messages."""
    return F.concat(*conversation(prompt, completion))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def merge_shards(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Rows of all shards, of equal keys the last written."""
    from lekha.operators.dedup import keep_last

    return keep_last(df, same, order)


def json_table(df: DataFrame, path: str, json_columns: list[str], about: dict[str, str]) -> None:
    """Replace ``path`` by ``df`` with its nested columns as JSON texts and ``about`` kept
    with the schema (see ``metadata``)."""
    as_json = {c: F.to_json(c, {"ignoreNullFields": "false"}) for c in json_columns}
    out = df.withColumns(as_json)
    first = out.columns[0]
    out.withMetadata(first, {"about": about}).write.mode("overwrite").parquet(path)


def metadata(df: DataFrame) -> dict[str, str]:
    """What ``json_table`` kept with a table."""
    return df.schema[0].metadata.get("about", {})


def row_batches(df: DataFrame, path: str, rows: int = 1000) -> None:
    """Replace ``path`` by files of at most ``rows`` rows, compressed as they are written."""
    df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def json_object(df: DataFrame, path: str, key: str) -> None:
    """A small table as one JSON object: a member per row, named by ``key``; null keys
    are left out. It is one file, so over 10,000 rows are an error."""
    if df.limit(10_001).count() > 10_000:
        raise ValueError("json_object: more than 10,000 rows")
    rest = F.struct(*[c for c in df.columns if c != key])
    one = df.filter(F.col(key).isNotNull()).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), rest.alias("v")))))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def tree(df: DataFrame, path: str, by: str, text: str, delimiter: str) -> None:
    """Replace ``path`` by text files in a folder per value of ``by``, a record per row;
    a folder without rows is not there."""
    record = F.concat(F.lit("\n"), F.col(text), F.lit(f"\n{delimiter}"))
    df.select(by, record.alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """n and a sum of row hashes that doesn't depend on the rows' order."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    h = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("fingerprint"))
