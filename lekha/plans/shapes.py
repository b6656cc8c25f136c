"""Queries that assemble prompts, payloads and report values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekha.functions import scores as C
from lekha.functions import shapes as X
from lekha.functions import text as T
from lekha.operators import evaluation
from lekha.plans.registry import register
from lekha.plans.scores import _A, _K, _KEY, _answers, _nt
from lekha.plans.statistics import _WITH, _long, _scored
from lekha.sources import table

#: A lexicon of dimensions for the subject queries.
LEXICON = {"economy": ("budget", "treasury", "tariff", "export", "bank", "fund"), "geography": ("delta", "glacier", "monsoon", "valley", "reef"), "history": ("dynasty", "sultanate", "colonial", "inscription", "stupa"), "polity": ("assembly", "tribunal", "ordinance", "council", "constituency")}


def _options_map():
    """The options of a payload as a map with upper-case keys, of either shape."""
    raw = F.get_json_object("gold_payload", "$.options")
    as_list = F.map_from_entries(F.transform(F.from_json(raw, "array<struct<id:string,text:string>>"), lambda o: F.struct(F.upper(o["id"]), o["text"])))
    return F.when(raw.startswith("["), as_list).otherwise(F.transform_keys(F.from_json(raw, "map<string,string>"), lambda k, v: F.upper(k)))


_OPT_LINES = "(SELECT string_agg(k || '{0}' || v, chr(10) ORDER BY k) FROM (SELECT upper(json_extract_string(o, '$.id')) AS k, json_extract_string(o, '$.text') AS v FROM (SELECT unnest(CASE WHEN json_type(gold_payload, '$.options') = 'ARRAY' THEN CAST(json_extract(gold_payload, '$.options') AS JSON[]) ELSE [] END) AS o) UNION ALL SELECT upper(k) AS k, json_extract_string(gold_payload, '$.options.\"' || k || '\"') AS v FROM (SELECT unnest(CASE WHEN json_type(gold_payload, '$.options') = 'OBJECT' THEN json_keys(gold_payload, '$.options') ELSE [] END) AS k)))"

register("tx14_english_lines", lambda s, d: table(s, d, "holdout", "question_id", "options").select("question_id", X.english_lines(F.col("options")).alias("t")), "SELECT question_id, coalesce((SELECT string_agg(x, chr(10) ORDER BY x) FROM (SELECT CASE WHEN length(k) = 1 THEN upper(k) || ') ' || v ELSE v END AS x FROM (SELECT k, json_extract_string(options, '$.\"' || k || '\"') AS v FROM (SELECT unnest(json_keys(options)) AS k)) WHERE v IS NOT NULL AND NOT regexp_matches(substr(v, 1, 20), '[\\x{0900}-\\x{097F}]'))), CASE WHEN options IS NULL THEN NULL ELSE '' END) AS t FROM holdout")
register("tx15_record_blocks", lambda s, d: table(s, d, "holdout", "question_id", "question", "correct_option_letter").select("question_id", X.record_block([F.col("question"), F.col("correct_option_letter")]).alias("t")).select("question_id", F.sha2("t", 256).alias("sha"), F.octet_length("t").cast("bigint").alias("bytes")), "SELECT question_id, sha256(t) AS sha, CAST(strlen(t) AS BIGINT) AS bytes FROM (SELECT question_id, concat_ws(chr(10) || chr(10), nullif(trim(question), ''), nullif(trim(correct_option_letter), '')) AS t FROM holdout)")
register("tx26_choice_prompts", lambda s, d: table(s, d, "eval_set", "question_id", "task", "gold_payload").filter("task = 'A'").select("question_id", F.sha2(X.choice_prompt(F.get_json_object("gold_payload", "$.question"), _options_map()), 256).alias("sha")), f"SELECT question_id, sha256(json_extract_string(gold_payload, '$.question') || chr(10) || {_OPT_LINES.replace('{0}', '. ')} || chr(10) || 'Answer:') AS sha FROM eval_set WHERE task = 'A'")
register("tx26_front_matter", lambda s, d: table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.sha2(X.after_front_matter(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a: 1\n---\n"), "text")).otherwise(F.col("text"))), 256).alias("sha")), "SELECT doc_id, sha256(CASE WHEN strpos(chr(10) || t, chr(10) || '---') > 0 AND regexp_matches(chr(10) || t, '\\n---[ \\t]*\\n') THEN regexp_replace(chr(10) || t, '(?s)^.*?\\n---[ \\t]*\\n', '') ELSE t END) AS sha FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a: 1' || chr(10) || '---' || chr(10) || text ELSE text END AS t FROM documents WHERE text IS NOT NULL)")
_W = "coalesce(nullif(TRY_CAST(json_extract_string(gold_payload, '$.word_count') AS INT), 0), 250)"
register("tx25_input_words", lambda s, d: table(s, d, "eval_set", "question_id", "task", "gold_payload").withColumn("p", X.input_payload(F.col("task"), F.col("gold_payload"))).select("question_id", "task", F.get_json_object("p", "$.question").alias("question"), F.get_json_object("p", "$.word_count").cast("int").alias("word_count"), F.length(F.get_json_object("p", "$.article")).alias("article_chars")), f"SELECT question_id, task, CASE WHEN task IN ('A', 'B') THEN json_extract_string(gold_payload, '$.question') END AS question, CASE WHEN task = 'B' THEN {_W} END AS word_count, CASE WHEN task = 'E' THEN CAST(length(json_extract_string(gold_payload, '$.source_text')) AS INT) END AS article_chars FROM eval_set")
register("tx20_first_turn", lambda s, d: table(s, d, "ft_corpus", "pair_id", "instruction", "output").distinct().select("pair_id", F.array(F.struct(F.lit("user").alias("role"), F.coalesce("instruction", F.lit("")).alias("content"))).alias("prompt"), F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("output", F.lit("")).alias("content"))).alias("completion")).select("pair_id", F.col("prompt")[0]["content"].alias("p"), F.length(F.col("completion")[0]["content"]).alias("n")).distinct(), "SELECT DISTINCT pair_id, coalesce(instruction, '') AS p, CAST(length(coalesce(output, '')) AS INT) AS n FROM ft_corpus")
_DIMS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])({'|'.join(ws)})([^a-z0-9_]|$)') THEN '{n}' END" for n, ws in sorted(LEXICON.items())) + "], lambda x: x IS NOT NULL)"
register("tx22_dimensions", lambda s, d: table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.array_join(X.dimensions(F.col("text"), LEXICON), ",").alias("dimensions")), f"SELECT doc_id, array_to_string({_DIMS}, ',') AS dimensions FROM documents WHERE text IS NOT NULL")
_CNT = ", ".join(f"({{'n': -len(regexp_extract_all(regexp_replace(lower(text), '([^a-z0-9_])', '\\1\\1', 'g'), '(?:^|[^a-z0-9_])(?:{'|'.join(ws)})(?:[^a-z0-9_]|$)')), 'd': '{n}'}})" for n, ws in sorted(LEXICON.items()))
register("fn31_strongest_dimension", lambda s, d: table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", X.strongest_dimension(F.col("text"), LEXICON).alias("dimension")), f"SELECT doc_id, list_min([{_CNT}]).d AS dimension FROM documents WHERE text IS NOT NULL")
register("fn21_distractors_cited", lambda s, d: _answers(s, d).filter("inference_task = 'A'").select(*_KEY, F.round(X.distractors_cited(F.col("explanation"), _options_map(), F.col("correct"), C.COMMON), 6).alias("share")).distinct())
register("se07_set_algebra", lambda s, d: _answers(s, d).filter("inference_task = 'B'").select(*_KEY, F.size(F.array_intersect(F.array_distinct(C.word_tokens(F.lower("answer"))), F.array_distinct(C.word_tokens(F.lower("model_answer"))))).alias("both"), F.size(F.array_except(C.word_tokens(F.lower("answer")), C.word_tokens(F.lower("model_answer")))).alias("extra")).distinct(), f"SELECT DISTINCT {_K}, CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS INT) AS both, CAST(len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS INT) AS extra FROM (SELECT *, regexp_extract_all(lower(answer), '{C.LETTERS}') AS a, regexp_extract_all(lower(model_answer), '{C.LETTERS}') AS b FROM {_A} WHERE inference_task = 'B')")
_CONF = "least(1.0, greatest(0.0, TRY_CAST(json_extract_string(p, '$.confidence') AS DOUBLE) / 100.0))"


def _confidence(s, d):
    """Confidence out of predictions that state one: it is put in first, as the test
    tables have none."""
    x = _answers(s, d).filter("inference_task = 'A'").withColumn("p", F.concat(F.lit('{"confidence": "'), F.when(F.col("latency_ms") % 5 == 0, "unsure").otherwise((F.coalesce("latency_ms", F.lit(0)) % 130).cast("string")), F.lit('"}')))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get_json_object("p", "$.confidence").try_cast("double") / 100.0))
    right = (F.upper(F.substring(F.trim("answer"), 1, 1)) == F.upper("correct")).cast("int")
    c = F.when(F.get_json_object("p", "$.confidence").try_cast("double").isNotNull(), conf)
    return x.select(*_KEY, F.round(c, 6).alias("confidence"), F.round((c - right) * (c - right), 6).alias("brier")).distinct()


_P = "'{\"confidence\": \"' || CASE WHEN latency_ms % 5 = 0 THEN 'unsure' ELSE CAST(coalesce(latency_ms, 0) % 130 AS VARCHAR) END || '\"}'"
_CQ = "CASE WHEN TRY_CAST(json_extract_string(p, '$.confidence') AS DOUBLE) IS NOT NULL THEN " + _CONF + " END"
register("fn17_confidence", _confidence, f"SELECT DISTINCT {_K}, round(c, 6) AS confidence, round((c - r) * (c - r), 6) AS brier FROM (SELECT *, {_CQ} AS c, CAST(upper(substr(trim(answer), 1, 1)) = upper(correct) AS INT) AS r FROM (SELECT *, {_P} AS p FROM {_A} WHERE inference_task = 'A'))")
register("fn20_format_valid", lambda s, d: _answers(s, d).select(*_KEY, F.when(F.col("inference_task").isin("A", "F"), F.upper(F.substring(F.trim("answer"), 1, 1)).isin(*"ABCD")).when(F.col("inference_task") == "C", F.get_json_object("prediction", "$.score").isNotNull()).when(F.col("inference_task") == "E", F.get_json_object("prediction", "$.prelims_info").isNotNull()).otherwise(F.col("answer") != "").cast("int").alias("valid")).distinct(), f"SELECT DISTINCT {_K}, CAST(CASE WHEN inference_task IN ('A', 'F') THEN upper(substr(trim(answer), 1, 1)) IN ('A', 'B', 'C', 'D') WHEN inference_task = 'C' THEN json_extract_string(prediction, '$.score') IS NOT NULL WHEN inference_task = 'E' THEN json_extract_string(prediction, '$.prelims_info') IS NOT NULL ELSE answer <> '' END AS INT) AS valid FROM {_A}")
register("fl16_parse_gate", lambda s, d: _answers(s, d).withColumn("ok", C.recovered_json(F.col("raw")).isNotNull().cast("int")).groupBy("inference_task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("share")), "SELECT inference_task, count(*) AS n, round(avg(CASE WHEN (json_valid(trim(raw)) AND trim(raw) LIKE '{%') OR json_valid(nullif(regexp_extract(raw, '(?s)```(?:json)?[ \\t\\n]*(\\{.*\\})[ \\t\\n]*```', 1), '')) OR json_valid(nullif(regexp_extract(raw, '(?s)(\\{.*\\})', 1), '')) THEN 1 ELSE 0 END), 6) AS share FROM " + _A + " GROUP BY inference_task")
register("fl19_vector_lengths", lambda s, d: table(s, d, "embeddings", "vec_id", "embedding").filter(F.size("embedding") != 64).agg(F.count(F.lit(1)).alias("bad")), "SELECT count(*) AS bad FROM embeddings WHERE len(embedding) <> 64")
register("fl05_json_shapes", lambda s, d: table(s, d, "eval_set", "task", "gold_payload").groupBy("task", F.when(F.get_json_object("gold_payload", "$.options").isNull(), "none").when(F.get_json_object("gold_payload", "$.options").startswith("["), "list").otherwise("map").alias("shape")).agg(F.count(F.lit(1)).alias("n")), "SELECT task, CASE WHEN json_extract(gold_payload, '$.options') IS NULL OR json_type(gold_payload, '$.options') = 'NULL' THEN 'none' WHEN json_type(gold_payload, '$.options') = 'ARRAY' THEN 'list' ELSE 'map' END AS shape, count(*) AS n FROM eval_set GROUP BY ALL")
register("fl07_membership", lambda s, d: table(s, d, "eval_set", "question_id", "paper").filter(F.lower("paper").isin("gs1", "csat")).select("question_id"), "SELECT question_id FROM eval_set WHERE lower(paper) IN ('gs1', 'csat')")
register("fl12_path_filter", lambda s, d: table(s, d, "documents", "doc_id", "dst_path").filter(F.col("dst_path").rlike(r"\.md$") & ~F.col("dst_path").rlike("(?i)draft|/press_wire/")).select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(dst_path, '\\.md$') AND NOT regexp_matches(dst_path, '(?i)draft|/press_wire/')")
register("fl14_parse_guard", lambda s, d: table(s, d, "ft_corpus", "task", "output").filter(F.try_parse_json("output").isNull()).groupBy("task").agg(F.count(F.lit(1)).alias("bad")), "SELECT task, count(*) AS bad FROM ft_corpus WHERE NOT coalesce(json_valid(output), false) GROUP BY task")
register("fl15_graded_schema", lambda s, d: _answers(s, d).filter("inference_task = 'C'").select(*_KEY, (F.get_json_object("prediction", "$.score").try_cast("double").isNotNull() & F.coalesce(F.get_json_object("prediction", "$.strengths").startswith("["), F.lit(False)) & F.coalesce(F.get_json_object("prediction", "$.improvements").startswith("["), F.lit(False))).alias("valid")).distinct(), f"SELECT DISTINCT {_K}, TRY_CAST(json_extract_string(prediction, '$.score') AS DOUBLE) IS NOT NULL AND coalesce(json_type(prediction, '$.strengths') = 'ARRAY', false) AND coalesce(json_type(prediction, '$.improvements') = 'ARRAY', false) AS valid FROM {_A} WHERE inference_task = 'C'")
register("ag12_token_totals", lambda s, d: table(s, d, "predictions", "condition", "inference_task", "input_tokens", "output_tokens").groupBy("condition", "inference_task").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out")), "SELECT condition, inference_task, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS tokens_in, CAST(sum(output_tokens) AS BIGINT) AS tokens_out FROM predictions GROUP BY ALL")
register("jn17_drill", lambda s, d: _scored(s, d).groupBy("question_id", "tsk").pivot("condition", ["C1a", "C1b", "C2", "C3"]).agg(F.max("is_correct")), _WITH + "SELECT question_id, tsk, max(CASE WHEN condition = 'C1a' THEN is_correct END) AS C1a, max(CASE WHEN condition = 'C1b' THEN is_correct END) AS C1b, max(CASE WHEN condition = 'C2' THEN is_correct END) AS C2, max(CASE WHEN condition = 'C3' THEN is_correct END) AS C3 FROM sc GROUP BY ALL")
register("jn18_attached", lambda s, d: _scored(s, d).select(*_KEY, "n_words").join(_scored(s, d).select(*_KEY, "tps"), _KEY, "left").select(*_KEY, "n_words", F.round("tps", 6).alias("tps")), _WITH + f"SELECT {_K}, n_words, round(tps, 6) AS tps FROM sc")
register("rp01_points", lambda s, d: evaluation.means(_long(s, d)).filter("condition = 'C2' AND task = 'A' AND language = 'all'").select("metric", X.percent(F.when(F.col("metric") == "is_correct", F.col("mean"))).alias("shown")), _WITH + "SELECT metric, CASE WHEN metric = 'is_correct' THEN format('{:.1f}%', avg(value) * 100) ELSE '-' END AS shown FROM lg WHERE condition = 'C2' AND task = 'A' GROUP BY metric")
register("rp02_table", lambda s, d: evaluation.means(_long(s, d)).filter("language = 'all' AND metric IN ('is_correct', 'format_fail')").groupBy("task", "metric").pivot("condition", ["C1a", "C1b", "C2", "C3"]).agg(F.round(F.first("mean"), 6)), _WITH + "SELECT task, metric, round(avg(value) FILTER (condition = 'C1a'), 6) AS C1a, round(avg(value) FILTER (condition = 'C1b'), 6) AS C1b, round(avg(value) FILTER (condition = 'C2'), 6) AS C2, round(avg(value) FILTER (condition = 'C3'), 6) AS C3 FROM lg WHERE metric IN ('is_correct', 'format_fail') GROUP BY ALL")
register("rp09_verdicts", lambda s, d: evaluation.pairs(_long(s, d), ["task"]).groupBy("metric", "condition_a", "condition_b").agg(F.avg("diff").alias("m"), F.count(F.lit(1)).alias("n")).filter("n >= 5").groupBy("metric", F.when(F.col("m") > 1e-9, "WIN").when(F.col("m") < -1e-9, "LOSS").otherwise("TIE").alias("verdict")).agg(F.count(F.lit(1)).alias("n")), _WITH + ", v AS (SELECT task, metric, question_id, condition, avg(value) AS value FROM lg GROUP BY ALL), pr AS (SELECT x.metric, x.condition AS a, y.condition AS b, CASE WHEN x.metric IN ('" + "', '".join(evaluation.LOWER_IS_BETTER) + "') THEN y.value - x.value ELSE x.value - y.value END AS diff FROM v x JOIN v y ON x.task = y.task AND x.metric = y.metric AND x.question_id = y.question_id AND x.condition < y.condition) SELECT metric, CASE WHEN m > 1e-9 THEN 'WIN' WHEN m < -1e-9 THEN 'LOSS' ELSE 'TIE' END AS verdict, count(*) AS n FROM (SELECT metric, avg(diff) AS m FROM pr GROUP BY metric, a, b HAVING count(*) >= 5) GROUP BY ALL")
register("rp11_build_report", lambda s, d: table(s, d, "dedupe_reports", "source", "files_seen", "exact_dups_removed", "near_dup_docs_removed").groupBy("source").agg(F.sum("files_seen").alias("files"), F.sum("exact_dups_removed").alias("exact"), F.sum("near_dup_docs_removed").alias("near")), "SELECT source, CAST(sum(files_seen) AS BIGINT) AS files, CAST(sum(exact_dups_removed) AS BIGINT) AS exact, CAST(sum(near_dup_docs_removed) AS BIGINT) AS near FROM dedupe_reports GROUP BY source")
register("st08_cohen_h", lambda s, d: _scored(s, d).filter("tsk = 'A'").agg(*[F.avg(F.when(F.col("condition") == c, F.col("is_correct"))).alias(c) for c in ("C1a", "C2")]).select(F.round(2 * F.asin(F.sqrt("C2")) - 2 * F.asin(F.sqrt("C1a")), 6).alias("h")), _WITH + "SELECT round(2 * asin(sqrt(avg(is_correct) FILTER (condition = 'C2'))) - 2 * asin(sqrt(avg(is_correct) FILTER (condition = 'C1a'))), 6) AS h FROM sc WHERE tsk = 'A'")
_WL = "list_transform(list_filter(regexp_split_to_array(text, '" + T.SPACE.replace("'", "''") + "+'), lambda x: x <> ''), lambda x: CAST(length(x) AS INT))"
register("fn42_tiled", lambda s, d: table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL AND text <> ''").select("doc_id", F.slice(F.flatten(F.array_repeat(F.transform(T.words(F.col("text")), lambda w: F.length(w)), 40)), 1, 256).alias("ids")).select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0), lambda a, x: a + x).alias("total")), f"SELECT doc_id, CAST(least(256, 40 * len(w)) AS INT) AS n, CAST(coalesce(list_sum(list_transform(range(0, least(256, 40 * len(w))), lambda i: w[i % len(w) + 1])), 0) AS INT) AS total FROM (SELECT doc_id, {_WL} AS w FROM documents WHERE text IS NOT NULL AND text <> '')")
