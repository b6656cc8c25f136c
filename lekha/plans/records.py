"""Queries over records: scans, JSON columns, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekha.plans.registry import register
from lekha.session import broadcast_if_small
from lekha.sources import table


def _json_columns(s, d):
    x = table(s, d, "eval_set", "question_id", "task", "gold_payload")
    v = F.from_json("gold_payload", "question string, question_text string, title string, correct_option string, word_count int, max_score double, score double")
    return x.select("question_id", "task", v.alias("v")).select("question_id", "task", "v.question", "v.title", "v.correct_option", "v.word_count", "v.max_score")


register("src02_json_columns", _json_columns, "SELECT question_id, task, json_extract_string(gold_payload, '$.question') AS question, json_extract_string(gold_payload, '$.title') AS title, json_extract_string(gold_payload, '$.correct_option') AS correct_option, TRY_CAST(json_extract_string(gold_payload, '$.word_count') AS INT) AS word_count, TRY_CAST(json_extract_string(gold_payload, '$.max_score') AS DOUBLE) AS max_score FROM eval_set")
register("src03_extract", lambda s, d: table(s, d, "ft_corpus", "pair_id", "task", "language", "source_db").filter("language = 'en' AND task IN ('A', 'B') AND source_db <> 'prod-db'").select("pair_id", "task").distinct().orderBy("pair_id"), "SELECT DISTINCT pair_id, task FROM ft_corpus WHERE language = 'en' AND task IN ('A', 'B') AND source_db <> 'prod-db' ORDER BY pair_id")
register("src04_pruned_scan", lambda s, d: table(s, d, "predictions", "condition", "latency_ms").filter("latency_ms > 1000").groupBy("condition").agg(F.count(F.lit(1)).alias("n")), "SELECT condition, count(*) AS n FROM predictions WHERE latency_ms > 1000 GROUP BY condition")
register("src05_row_count", lambda s, d: table(s, d, "documents").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM documents")
register("src07_overlay", lambda s, d: table(s, d, "clean_results", F.col("dst_path").alias("path")).filter("path IS NOT NULL").distinct().join(table(s, d, "documents", F.col("dst_path").alias("path")), "path", "left_anti").select("path", F.lit("raw").alias("root")).unionByName(table(s, d, "documents", F.col("dst_path").alias("path")).select("path", F.lit("text").alias("root"))), "SELECT DISTINCT dst_path AS path, 'raw' AS root FROM clean_results WHERE dst_path IS NOT NULL AND dst_path NOT IN (SELECT dst_path FROM documents WHERE dst_path IS NOT NULL) UNION ALL SELECT dst_path, 'text' FROM documents")
register("src11_json_rows", lambda s, d: table(s, d, "ft_corpus", "pair_id", "task", "output").distinct().filter(F.try_parse_json("output").isNotNull()).select("pair_id", "task", F.coalesce(F.get_json_object("output", "$.answer"), F.get_json_object("output", "$.mains_info"), F.lit("")).alias("t")).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars")), "SELECT task, count(*) AS n, CAST(sum(length(coalesce(json_extract_string(output, '$.answer'), json_extract_string(output, '$.mains_info'), ''))) AS BIGINT) AS chars FROM (SELECT DISTINCT pair_id, task, output FROM ft_corpus WHERE json_valid(output)) GROUP BY task")
register("src12_index_ids", lambda s, d: table(s, d, "holdout", "question_id").join(table(s, d, "ft_corpus", F.col("pair_id").alias("question_id")), "question_id", "left_semi"), "SELECT question_id FROM holdout WHERE question_id IN (SELECT pair_id FROM ft_corpus)")
register("src23_chunk_source", lambda s, d: table(s, d, "documents", "doc_id", "source", "text").filter("source IN ('ref_books', 'encyclo') AND text IS NOT NULL").select("doc_id", F.posexplode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(5000))).alias("chunk_no", "at"), "text").select("doc_id", "chunk_no", F.length(F.substr("text", F.col("at") + 1, F.lit(5000))).alias("n")), "SELECT doc_id, CAST(k AS INT) AS chunk_no, CAST(length(substr(text, k * 5000 + 1, 5000)) AS INT) AS n FROM (SELECT doc_id, text, unnest(range(CAST(greatest(0, length(text) - 1) // 5000 + 1 AS BIGINT))) AS k FROM documents WHERE source IN ('ref_books', 'encyclo') AND text IS NOT NULL)")
register("snk03_fingerprint", lambda s, d: table(s, d, "eval_set", "question_id", "task").select(F.conv(F.substring(F.sha2(F.concat_ws("|", F.coalesce("question_id", F.lit("")), F.coalesce("task", F.lit(""))), 256), 1, 8), 16, 10).cast("bigint").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("fingerprint")), "SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(coalesce(question_id, '') || '|' || coalesce(task, '')), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM eval_set")
register("jn01_left_join", lambda s, d: table(s, d, "predictions", "question_id", "condition").join(table(s, d, "eval_set", "question_id", "subject"), "question_id", "left").groupBy("condition", F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count(F.lit(1)).alias("n")), "SELECT p.condition, coalesce(e.subject, 'none') AS subject, count(*) AS n FROM predictions p LEFT JOIN eval_set e ON p.question_id = e.question_id GROUP BY ALL")
register("jn02_lookup", lambda s, d: table(s, d, "ft_corpus", "pair_id", "task", "input").distinct().filter("task = 'B'").select("pair_id", F.coalesce(F.nullif(F.get_json_object("input", "$.word_count").cast("int"), F.lit(0)), F.lit(250)).alias("target")), "SELECT DISTINCT pair_id, coalesce(nullif(TRY_CAST(json_extract_string(input, '$.word_count') AS INT), 0), 250) AS target FROM ft_corpus WHERE task = 'B'")
register("jn07_skip_counts", lambda s, d: table(s, d, "ft_corpus", "pair_id", "task").distinct().join(table(s, d, "holdout", "question_id").select(F.col("question_id").alias("pair_id"), F.lit(1).alias("skip")), "pair_id", "left").groupBy("task").agg(F.count("skip").alias("skipped"), F.sum(F.when(F.col("skip").isNull(), 1).otherwise(0)).alias("kept")), "SELECT task, count(question_id) AS skipped, CAST(sum(CASE WHEN question_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM (SELECT DISTINCT pair_id, task FROM ft_corpus) LEFT JOIN holdout ON question_id = pair_id GROUP BY task")
register("fl06_flags", lambda s, d: table(s, d, "source_mix", "source", "optional").filter(~F.coalesce("optional", F.lit(False))).select("source"), "SELECT source FROM source_mix WHERE NOT coalesce(optional, false)")
register("fl08_cutoff", lambda s, d: table(s, d, "ft_corpus", "pair_id", "task", "input").distinct().filter("task = 'E'").withColumn("date", F.get_json_object("input", "$.date")).filter("date < '2025-09-01'").groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n")), "SELECT substr(json_extract_string(input, '$.date'), 1, 7) AS month, count(*) AS n FROM (SELECT DISTINCT pair_id, input FROM ft_corpus WHERE task = 'E') WHERE json_extract_string(input, '$.date') < '2025-09-01' GROUP BY 1")
register("fl13_language_counts", lambda s, d: table(s, d, "ft_corpus", "pair_id", "language").distinct().groupBy((F.col("language") == "en").alias("kept")).agg(F.count(F.lit(1)).alias("n")), "SELECT language = 'en' AS kept, count(*) AS n FROM (SELECT DISTINCT pair_id, language FROM ft_corpus) GROUP BY 1")


def _budgeted_mix(s, d):
    """Tokens seen per source of the last build of each model, against its cap."""
    p = table(s, d, "pack_stats", "model", "source", "packed_at", "run_id", "per_source_tokens").filter("packed_at IS NOT NULL")
    last = p.groupBy("model", "source").agg(F.max(F.struct("packed_at", "run_id", "per_source_tokens")).alias("x"))
    mix = table(s, d, "source_mix", "source", "cap_tokens")
    return last.join(broadcast_if_small(mix), "source").select("model", "source", F.col("x.per_source_tokens").alias("tokens"), (F.col("x.per_source_tokens") > F.col("cap_tokens")).alias("over"))


register("ag10_mix_caps", _budgeted_mix, "SELECT model, source, per_source_tokens AS tokens, per_source_tokens > cap_tokens AS over FROM (SELECT *, row_number() OVER (PARTITION BY model, source ORDER BY packed_at DESC, run_id DESC NULLS LAST, per_source_tokens DESC NULLS LAST) AS k FROM pack_stats WHERE packed_at IS NOT NULL) JOIN source_mix USING (source) WHERE k = 1")
register("ev01_windows", lambda s, d: table(s, d, "events", "ts", "event_type", "value").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("v", 6).alias("v")), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS v FROM events GROUP BY ALL")


def _gate(s, d):
    """The regression gate over measurements made from predictions, as a batch."""
    from pyspark.sql import Window as W

    x = table(s, d, "predictions", "condition", "run_id", "latency_ms", "output_tokens").filter("run_id IS NOT NULL").groupBy("condition", "run_id").agg(F.avg("output_tokens").alias("v"))
    w = W.partitionBy("condition").orderBy("run_id")  # runs: a few hundred rows
    x = x.withColumn("drop", (F.first("v").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("v")) / F.first("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.select("condition", "run_id", F.round("drop", 6).alias("drop"), F.when(F.col("drop") > 0.5, "HARD_STOP").when(F.col("drop") > 0.2, "WARN").otherwise("OK").alias("verdict"))


register("sr05_regression_gate", _gate, "SELECT condition, run_id, round((f - v) / f, 6) AS drop, CASE WHEN (f - v) / f > 0.5 THEN 'HARD_STOP' WHEN (f - v) / f > 0.2 THEN 'WARN' ELSE 'OK' END AS verdict FROM (SELECT condition, run_id, v, first_value(v) OVER (PARTITION BY condition ORDER BY run_id) AS f FROM (SELECT condition, run_id, avg(output_tokens) AS v FROM predictions WHERE run_id IS NOT NULL GROUP BY ALL))")


def _stream_first_seen(s, d):
    """Online duplicates by the streaming form, run to its end over the events."""
    import uuid

    from lekha.session import checkpoint_dir
    from lekha.streaming import stateful

    base = f"{checkpoint_dir(s)}/streams/{uuid.uuid4()}"
    src = table(s, d, "events", "event_id", "ts", "user_id", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(f"{base}/in")
    stream = s.readStream.schema(src.schema).parquet(f"{base}/in")
    q = stateful.append_shards(stateful.first_seen(stream, "user_id", "ts", "3650 days"), f"{base}/out", f"{base}/state")
    q.awaitTermination()
    return s.read.parquet(f"{base}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


register("sr08_stream_first_seen", _stream_first_seen, "SELECT user_id, CAST(1 AS BIGINT) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
