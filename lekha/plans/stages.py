"""Queries of the stages between operators: writers read back, gates, paired counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lekha.functions import text as T
from lekha.operators import dedup, evaluation, leakage, ordered
from lekha.plans.corpus import _EV, _FT, _HASH, _NWORDS, _SH, _eval_index, _ft_text, _grams_sql
from lekha.plans.registry import register
from lekha.plans.statistics import _WITH, _long
from lekha.plans.text import _STRIP
from lekha.session import checkpoint_dir
from lekha.sources import sinks, table, trees

col = F.col


def _folder(s) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(s)}/queries/{uuid.uuid4()}"


# Writers, read back.
def _json_table(s, d):
    """A table whose nested columns are JSON texts, with what it was made of."""
    at = _folder(s)
    x = table(s, d, "leakage_reports", "run_id", "checked_at", "id_overlaps", "ngram_hits")
    sinks.json_table(x, at, ["id_overlaps", "ngram_hits"], {"table": "leakage_reports", "version": "1"})
    back = s.read.parquet(at)
    made = sinks.metadata(back)
    return back.select("run_id", F.coalesce(F.size(F.from_json("id_overlaps", "array<string>")), F.lit(-1)).alias("ids"), F.coalesce(F.size(F.from_json("ngram_hits", "array<struct<question_id:string,src:string>>")), F.lit(-1)).alias("hits"), F.lit(made["table"]).alias("made_of"))


register("snk01_json_table", _json_table, "SELECT run_id, CAST(coalesce(len(id_overlaps), -1) AS INT) AS ids, CAST(coalesce(len(ngram_hits), -1) AS INT) AS hits, 'leakage_reports' AS made_of FROM leakage_reports")


def _packed_rows(s, d):
    docs = table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", T.token_ids(T.tokens(col("text"))).alias("ids"))
    return ordered.pack_stream(docs, ["doc_id"], "ids", 512, eos=0)


def _packed_shards(s, d):
    """Packed rows in files of a bounded number of rows each."""
    at = _folder(s)
    sinks.row_batches(_packed_rows(s, d), at, rows=100)
    per = s.read.parquet(at).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("input_ids")).alias("ids"))
    return per.agg(F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"), (F.max("n") <= 100).alias("bounded"))


_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
register("snk04_row_batches", _packed_shards, f"SELECT n // 512 AS n_rows, n // 512 * 512 AS n_ids, true AS bounded FROM (SELECT CAST(sum(len({_TOK}) + 1) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND len({_TOK}) > 0)")


# Every packed row is as long as it must be, not only the first.
register("fl19_row_lengths", lambda s, d: _packed_rows(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.size("input_ids") != 512, 1)).alias("bad")), f"SELECT n // 512 AS n_rows, CAST(0 AS BIGINT) AS bad FROM (SELECT CAST(sum(len({_TOK}) + 1) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL AND len({_TOK}) > 0)")


def _conversations(s, d):
    at = _folder(s)
    x = table(s, d, "ft_corpus", "pair_id", "instruction", "output").distinct()
    prompt, completion = sinks.conversation(F.coalesce("instruction", F.lit("")), F.coalesce("output", F.lit("")))
    sinks.json_lines(x.select("pair_id", prompt.alias("prompt"), completion.alias("completion")), at)
    turn = "array<struct<role:string,content:string>>"
    back = s.read.schema(f"pair_id string, prompt {turn}, completion {turn}").json(at)
    return back.select("pair_id", col("prompt")[0]["role"].alias("asks"), col("completion")[0]["role"].alias("answers"), F.sha2(F.concat(col("prompt")[0]["content"], F.lit("|"), col("completion")[0]["content"]), 256).alias("sha"))


register("snk06_conversations", _conversations, "SELECT pair_id, 'user' AS asks, 'assistant' AS answers, sha256(coalesce(instruction, '') || '|' || coalesce(output, '')) AS sha FROM (SELECT DISTINCT pair_id, instruction, output FROM ft_corpus)")


def _log(s, d):
    """A log that three runs append to, two of them the same rows; read, each entry counts once."""
    at = _folder(s)
    x = table(s, d, "clean_results", "src_path", "dropped", "out_chars")
    part = F.pmod(F.xxhash64("src_path"), F.lit(2))
    for k in (0, 1, 1):
        sinks.append_log(x.filter(part == k), at)
    return s.read.parquet(at).distinct().groupBy("dropped").agg(F.count(F.lit(1)).alias("n"), F.sum("out_chars").alias("chars"))


register("snk09_log", _log, "SELECT dropped, count(*) AS n, CAST(sum(out_chars) AS BIGINT) AS chars FROM (SELECT DISTINCT src_path, dropped, out_chars FROM clean_results WHERE src_path IS NOT NULL) GROUP BY dropped")


def _side_file(s, d):
    """Results that are no table, as one JSON object beside the tables."""
    at = _folder(s)
    x = table(s, d, "predictions", "condition", "inference_task").groupBy("condition").pivot("inference_task", list("ABCEFG")).count()
    sinks.json_object(x, at, "condition")
    return s.read.text(at).select(F.explode(F.from_json("value", "map<string,map<string,bigint>>")).alias("condition", "m")).select("condition", F.explode("m").alias("task", "n"))


register("snk13_side_file", _side_file, "SELECT condition, inference_task AS task, count(*) AS n FROM predictions WHERE inference_task IN ('A', 'B', 'C', 'E', 'F', 'G') AND condition IS NOT NULL GROUP BY ALL")


def _kept_tree(s, d):
    """Kept documents as text files under their source, read back record by record."""
    at = _folder(s)
    docs = table(s, d, "documents", "source", "text").filter(T.drop_reason(col("text")) == "")
    sinks.tree(docs, at, "source", "text", trees.DELIMITER)
    back = trees.records(trees.documents(s, at))
    return back.groupBy(F.regexp_replace("source", "^source=", "").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))


_WRD = "list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '')".replace("{S}", T.SPACE.replace("'", "''"))
_KEPT = f"len({_WRD}) >= 50 AND CASE WHEN len(regexp_extract_all(text, '\\p{{L}}')) > 0 THEN len(regexp_extract_all(text, '[\\x{{0900}}-\\x{{097F}}]')) / len(regexp_extract_all(text, '\\p{{L}}')) ELSE 0.0 END <= 0.30"
register("snk08_tree_of_kept", _kept_tree, f"SELECT source, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT source, {_STRIP.replace('{0}', 'text')} AS t FROM documents WHERE text IS NOT NULL AND {_KEPT}) WHERE t <> '' GROUP BY source")


def _tree_scan(s, d):
    """Whole texts as a tree of text files, found again by their folder."""
    at = _folder(s)
    docs = table(s, d, "documents", "source", "lang", "text").filter("text IS NOT NULL AND source IS NOT NULL")
    docs.select("source", F.translate("text", "\r\n", "  ").alias("value")).write.partitionBy("source").text(at)
    lines = trees.documents(s, at).select(F.regexp_replace("source", "^source=", "").alias("source"), "format", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("t"))
    return lines.groupBy("source", "format").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t").cast("bigint")).alias("bytes"))


register("src06_tree_scan", _tree_scan, "SELECT source, 'txt' AS format, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source")


def _extracted(s, d):
    """Binary files taken apart where they are read."""
    at = _folder(s)
    docs = table(s, d, "eval_set", "task", "gold_payload").filter("gold_payload IS NOT NULL AND task IS NOT NULL")
    docs.select("task", F.translate("gold_payload", "\r\n", "  ").alias("value")).write.partitionBy("task").text(at)

    def take_apart(content: bytes) -> tuple[str, int]:
        text = content.decode()
        return text, text.count("\n")

    files = trees.extracted(s, at, take_apart, "*.txt")
    return files.groupBy(F.regexp_replace("source", "^task=", "").alias("task")).agg(F.sum("n_pages").alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"), F.count("error").alias("errors"))


register("src13_extracted", _extracted, "SELECT task, count(*) AS n, CAST(sum(strlen(gold_payload) + 1) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS errors FROM eval_set WHERE gold_payload IS NOT NULL AND task IS NOT NULL GROUP BY task")


# The gate between leakage and what trains: nothing passes it that hits, and what is purged does.
def _gated(s, d):
    index, corpus = _eval_index(s, d), _ft_text(s, d)
    hits = index.gram_hits(corpus, "pair_id")
    try:
        leakage.gate(hits)
        raised = False
    except leakage.LeakageError:
        raised = True
    clean = index.purge(corpus, ["pair_id"])
    leakage.gate(index.gram_hits(clean, "pair_id"))
    return clean.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pair_id").alias("records")).withColumn("stopped", F.lit(raised))


_BAD = f"(SELECT pair_id FROM {_grams_sql('pair_id', _FT, 25)} JOIN {_grams_sql('qid', _EV, 25)} USING (g))"
register("ml04_gate", _gated, f"SELECT count(*) AS n, count(DISTINCT pair_id) AS records, EXISTS (SELECT 1 FROM {_BAD}) AS stopped FROM {_FT} WHERE pair_id NOT IN (SELECT pair_id FROM {_BAD}) AND pair_id NOT IN (SELECT pair_id FROM (SELECT pair_id, {_HASH} AS h FROM {_FT}) JOIN (SELECT qid, {_HASH} AS h FROM {_EV} WHERE {_NWORDS} >= 8) USING (h))")

# Links of near copies per document: its class of equal texts and how many classes are near.
register("jn12_near_links", lambda s, d: dedup.NearDuplicates(table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL")).linked(), f"WITH m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class_id FROM {_SH}), c AS (SELECT DISTINCT class_id, s FROM m), e AS (SELECT class_id, len(s) AS n, unnest(s) AS g FROM c), p AS (SELECT a.class_id AS a, b.class_id AS b FROM e a JOIN e b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8 - 1e-12), k AS (SELECT a, count(*) AS n FROM p GROUP BY a) SELECT d.doc_id AS doc, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(k.n, 0) AS n_links FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN k ON m.class_id = k.a WHERE d.text IS NOT NULL")


# Two conditions on the same questions.
def _right_pairs(s, d):
    return evaluation.pairs(_long(s, d).filter("metric = 'is_correct'"), ["task"])


_PAIRS = _WITH + ", v AS (SELECT task, question_id, condition, avg(value) AS value FROM lg WHERE metric = 'is_correct' GROUP BY ALL), pr AS (SELECT x.task, x.question_id, x.condition AS condition_a, y.condition AS condition_b, x.value AS a, y.value AS b FROM v x JOIN v y ON x.task = y.task AND x.question_id = y.question_id AND x.condition < y.condition) "
_LF = "list_sum(list_transform(range(greatest(b, c), b + c + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0))))"
_SIGNS = "SELECT task, condition_a, condition_b, count(*) AS n, CAST(sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN a < b THEN 1 ELSE 0 END) AS BIGINT) AS c FROM pr GROUP BY ALL"
register("st05_mcnemar", lambda s, d: evaluation.discordant(_right_pairs(s, d), ["task", "condition_a", "condition_b"]).select("task", "condition_a", "condition_b", "n", "b", "c", F.round("p", 6).alias("p")), _PAIRS + f"SELECT task, condition_a, condition_b, n, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * {_LF}) END, 6) AS p FROM ({_SIGNS})")
register("st13_sign_tests", lambda s, d: evaluation.false_discovery(evaluation.discordant(_right_pairs(s, d), ["task", "condition_a", "condition_b"]), "p", "q").select("task", "condition_a", "condition_b", F.round("q", 6).alias("q"), (col("q") < 0.05).alias("significant")), _PAIRS + f", t AS (SELECT task, condition_a, condition_b, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * {_LF}) END AS p FROM ({_SIGNS})), r AS (SELECT *, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank, count(*) OVER () AS m FROM t), q AS (SELECT *, least(1.0, min(p * m / rank) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r) SELECT task, condition_a, condition_b, round(q, 6) AS q, q < 0.05 AS significant FROM q")


def _intervals(s, d):
    """Verdicts by an interval of the mean difference: its mean and 1.96 standard errors."""
    x = _right_pairs(s, d).groupBy("task", "condition_a", "condition_b").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("sd")).filter("n >= 5")
    half = 1.96 * col("sd") / F.sqrt("n")
    return x.select("task", "condition_a", "condition_b", F.round(col("m") - half, 6).alias("lo"), F.round(col("m") + half, 6).alias("hi"), evaluation.interval_verdict(col("m") - half, col("m") + half).alias("verdict"))


register("st16_normal_verdicts", _intervals, _PAIRS + "SELECT task, condition_a, condition_b, round(m - h, 6) AS lo, round(m + h, 6) AS hi, CASE WHEN m - h > 0 THEN 'WIN' WHEN m + h < 0 THEN 'LOSS' ELSE 'TIE' END AS verdict FROM (SELECT task, condition_a, condition_b, count(*) AS n, avg(a - b) AS m, 1.96 * stddev_samp(a - b) / sqrt(count(*)) AS h FROM pr GROUP BY ALL) WHERE n >= 5")

# Questions that are there in both languages, of all splits of the evaluation.
register("jn14_both_languages", lambda s, d: table(s, d, "eval_set", "question_id").filter(col("question_id").rlike(":(en|hi)$")).groupBy(F.regexp_replace("question_id", ":(en|hi)$", "").alias("stem")).agg(F.max(F.when(col("question_id").endswith(":en"), col("question_id"))).alias("en"), F.max(F.when(col("question_id").endswith(":hi"), col("question_id"))).alias("hi")).filter("en IS NOT NULL AND hi IS NOT NULL"), "SELECT regexp_replace(question_id, ':(en|hi)$', '') AS stem, max(CASE WHEN question_id LIKE '%:en' THEN question_id END) AS en, max(CASE WHEN question_id LIKE '%:hi' THEN question_id END) AS hi FROM eval_set WHERE regexp_matches(question_id, ':(en|hi)$') GROUP BY 1 HAVING en IS NOT NULL AND hi IS NOT NULL")
