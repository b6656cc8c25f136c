"""Further queries: task scorers, sinks read back, streams run to their end, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lekha.functions import html as H
from lekha.functions import scores as C
from lekha.functions import shapes as X
from lekha.functions import text as T
from lekha.operators import dedup, evaluation, ordered, sampling
from lekha.plans.corpus import _IDS
from lekha.plans.extract import _PG, _pages
from lekha.plans.registry import register
from lekha.plans.scores import _A, _REC, _DIR, _J, _K, _KEY, _MARK, _NUMS, _YEARS, _adh, _answers, _bands, _count, _f1, _j, _nt, _score, _sent
from lekha.plans.statistics import _CH, _WITH, _champion, _long, _scored
from lekha.plans.text import _EST, _IN, _OUT, _STRIP, _TOKENS, _WORDS, S
from lekha.session import checkpoint_dir
from lekha.sources import sinks, table
from lekha.streaming import stateful

col = F.col


def _folder(s) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(s)}/queries/{uuid.uuid4()}"


# Text.
register("tx17_sft_estimate", lambda s, d: table(s, d, "ft_corpus", "pair_id", "input", "output").distinct().select("pair_id", (F.floor((T.word_count(F.coalesce("input", F.lit(""))) + T.word_count(F.coalesce("output", F.lit("")))) * 1.4).cast("int") + 64).alias("n")).groupBy("pair_id").agg(F.max("n").alias("n")), f"SELECT pair_id, max(CAST(floor((len({_WORDS.replace('{0}', _IN)}) + len({_WORDS.replace('{0}', _OUT)})) * CAST(1.4 AS DOUBLE)) AS INT) + 64) AS n FROM ft_corpus GROUP BY pair_id")


def _framed(s, d):
    ids = T.token_ids(T.tokens(col("text")))
    x = table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", ids.alias("ids")).filter(F.size("ids") > 0)
    framed = F.when(col("ids")[0] == 1, col("ids")).otherwise(F.concat(F.array(F.lit(1)), col("ids")))
    return x.select("doc_id", framed.alias("f")).select("doc_id", F.size("f").alias("n"), F.sha2(F.array_join(F.transform("f", lambda x: x.cast("string")), ","), 256).alias("sha"))


_FR = "CASE WHEN ids[1] = 1 THEN ids ELSE list_concat([1], ids) END"
register("tx23_framed_ids", _framed, f"SELECT doc_id, CAST(len(f) AS INT) AS n, sha256(array_to_string(f, ',')) AS sha FROM (SELECT doc_id, {_FR} AS f FROM (SELECT doc_id, {_IDS} AS ids FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL)) WHERE len(ids) > 0)")
register("ext05_fallback_chain", lambda s, d: _pages(s, d).select("doc_id", F.length(F.coalesce(F.nullif(F.regexp_extract("html", r"(?is)<section[^>]*>(.*?)</section>", 1), F.lit("")), F.nullif(F.regexp_extract("html", r"(?is)<article[^>]*>(.*)</article>", 1), F.lit("")), F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1))).alias("n")), f"SELECT doc_id, CAST(length(coalesce(nullif(regexp_extract(html, '(?is)<section[^>]*>(.*?)</section>', 1), ''), nullif(regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1), ''), regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1))) AS INT) AS n FROM {_PG}")
register("ext06_blank_lines", lambda s, d: table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.length(T.strip_ends(F.regexp_replace("text", r"\n{3,}", "\n\n"))).alias("n")), f"SELECT doc_id, CAST(length({_STRIP.replace('{0}', 'regexp_replace(text, ' + chr(39) + chr(92) + 'n{3,}' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')}) AS INT) AS n FROM documents WHERE text IS NOT NULL")
register("ag18_chunk_counts", lambda s, d: table(s, d, "documents", "source", "text").filter("text IS NOT NULL").select("source", F.size(T.chunks(T.words(col("text")), 1500, 200)).alias("n")).groupBy("source").agg(F.sum("n").alias("chunks"), (F.sum("n") * 600).alias("tokens")), f"SELECT source, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(n) * 600 AS BIGINT) AS tokens FROM (SELECT source, len(w) // 1500 + CASE WHEN len(w) % 1500 >= 200 THEN 1 ELSE 0 END AS n FROM (SELECT source, {_WORDS.replace('{0}', 'text')} AS w FROM documents WHERE text IS NOT NULL)) GROUP BY source")
register("fl18_count_gates", lambda s, d: sampling.split(table(s, d, "ft_corpus", "pair_id", "task").distinct(), "task", "pair_id", 0.05, 7).groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (col("n") >= F.when(col("part") == "train", 100).otherwise(10)).alias("passed")), "SELECT part, n >= CASE WHEN part = 'train' THEN 100 ELSE 10 END AS passed FROM (SELECT part, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY task ORDER BY sha256('7:' || pair_id), pair_id) <= greatest(1, floor(count(*) OVER (PARTITION BY task) * CAST(0.05 AS DOUBLE))) THEN 'valid' ELSE 'train' END AS part FROM (SELECT DISTINCT pair_id, task FROM ft_corpus)) GROUP BY part)")
register("fl20_new_and_shaped", lambda s, d: table(s, d, "documents", "doc_id", "text", "dst_path").filter(F.startswith("text", F.lit("#"))).join(table(s, d, "clean_results", "dst_path").filter("dropped").select("dst_path").distinct(), "dst_path", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '#%' AND NOT EXISTS (SELECT 1 FROM clean_results c WHERE c.dropped AND c.dst_path = documents.dst_path)")
register("or08_buffer_shuffle", lambda s, d: table(s, d, "documents", "doc_id").select("doc_id", F.floor(col("doc_id") / 10000).cast("bigint").alias("buffer"), sampling.order(9, col("doc_id")).alias("o")).orderBy("buffer", "o").select("doc_id", "buffer"), "SELECT doc_id, CAST(floor(doc_id / 10000) AS BIGINT) AS buffer FROM documents ORDER BY buffer, sha256('9:' || CAST(doc_id AS VARCHAR))")
register("wi09_ranked_take", lambda s, d: sampling.first_per_group(table(s, d, "eval_set", "question_id", "task", "language").filter("question_id IS NOT NULL"), ["task", "language"], "question_id", 4, seed=7).select("question_id", "task"), "SELECT question_id, task FROM (SELECT question_id, task, row_number() OVER (PARTITION BY task, language ORDER BY sha256('7:' || question_id), question_id) AS k FROM eval_set WHERE question_id IS NOT NULL) WHERE k <= 4")

# Scores.
register("fn01_safe_json", lambda s, d: table(s, d, "ft_corpus", "pair_id", "output").distinct().select("pair_id", F.coalesce(F.when(F.try_parse_json("output").isNotNull() & F.startswith("output", F.lit("{")), col("output")), F.lit("{}")).alias("j")).groupBy("pair_id").agg(F.min(F.sha2("j", 256)).alias("sha")), "SELECT pair_id, min(sha256(CASE WHEN json_valid(output) AND output LIKE '{%' THEN output ELSE '{}' END)) AS sha FROM ft_corpus GROUP BY pair_id")


def _joined(c: str, f: str):
    v = F.from_json(F.get_json_object(c, f"$.{f}"), "array<string>")
    return F.coalesce(F.array_join(v, "\n"), F.lit(""))


def _jl(c: str, f: str) -> str:
    return f"coalesce(array_to_string(CASE WHEN json_type({c}, '$.{f}') = 'ARRAY' THEN CAST(json_extract({c}, '$.{f}') AS VARCHAR[]) END, chr(10)), '')"


_score("fn02_joined_text", "inference_task = 'C'", {"sha": lambda: F.sha2(_joined("gold_payload", "strengths"), 256)}, {"sha": f"sha256({_jl('gold_payload', 'strengths')})"})
_score("fn39_improvements", "inference_task = 'C'", {"n": lambda: F.size(F.coalesce(F.from_json(F.get_json_object("prediction", "$.improvements"), "array<string>"), F.array().cast("array<string>")))}, {"n": "CAST(coalesce(CASE WHEN json_type(prediction, '$.improvements') = 'ARRAY' THEN json_array_length(prediction, '$.improvements') END, 0) AS INT)"})
_DP = f"(100.0 * {_count('answer', C.CAUSAL)} / greatest(1, {_nt('answer')}))"
_DG = f"(100.0 * {_count('model_answer', C.CAUSAL)} / greatest(1, {_nt('model_answer')}))"


def _density_score():
    p, g = C.markers_per_100(col("answer"), C.CAUSAL), C.markers_per_100(col("model_answer"), C.CAUSAL)
    return F.round(F.when((p > 0) & (g > 0), F.greatest(F.lit(0.0), 1 - F.abs(F.ln(p / g)) / F.ln(F.lit(3.0)))), 6)


_score("fn12_density_score", "inference_task IN ('B', 'G')", {"score": _density_score}, {"score": f"round(CASE WHEN {_DP} > 0 AND {_DG} > 0 THEN greatest(0.0, 1 - abs(ln({_DP} / {_DG})) / ln(3.0)) END, 6)"})
_KNOWN = tuple(range(1, 52))


_ART = "regexp_extract_all(explanation, 'Article[ \\t\\n]+([0-9]+)', 1)"
_score("fn22_citations", "inference_task = 'A'", {"share": lambda: F.round(C.cited_share(col("explanation"), _KNOWN), 6)}, {"share": f"round(CASE WHEN len({_ART}) = 0 THEN 1.0 ELSE CAST(len(list_filter({_ART}, lambda x: CAST(x AS INT) BETWEEN 1 AND {len(_KNOWN)})) AS DOUBLE) / len({_ART}) END, 6)"})
_GS, _MS = (f"TRY_CAST(json_extract_string(gold_payload, '$.{f}') AS DOUBLE)" for f in ("score", "max_score"))
_score("fn23_bands", "inference_task IN ('B', 'C')", {"band": lambda: F.when(col("inference_task") == "C", C.band(F.get_json_object("gold_payload", "$.score").cast("double"), F.get_json_object("gold_payload", "$.max_score").cast("double"))).otherwise(F.when(col("target") <= 175, "150w").when(col("target") <= 400, "250w").otherwise("essay"))}, {"band": f"CASE WHEN inference_task = 'C' THEN {_bands(_GS, _MS)} WHEN target <= 175 THEN '150w' WHEN target <= 400 THEN '250w' ELSE 'essay' END"})


def _letter_of():
    j = C.recovered_json(col("raw"))
    a = F.coalesce(F.get_json_object(j, "$.answer"), F.lit(""))
    number = F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), F.least(F.lit(3), F.greatest(F.lit(0), a.try_cast("int"))) + 1)
    return F.coalesce(F.when(a.rlike("^[0-3]$"), number), F.when(F.upper(F.substring(F.trim(a), 1, 1)).isin(*"ABCD"), F.upper(F.substring(F.trim(a), 1, 1))), C.first_letter(col("raw")))


_PA = f"coalesce(json_extract_string({_REC}, '$.answer'), '')"
_score("fn29_parsed_letter", "inference_task IN ('A', 'F')", {"letter": _letter_of}, {"letter": f"CASE WHEN regexp_matches({_PA}, '^[0-3]$') THEN substr('ABCD', CAST({_PA} AS INT) + 1, 1) WHEN upper(substr(trim({_PA}), 1, 1)) IN ('A', 'B', 'C', 'D') THEN upper(substr(trim({_PA}), 1, 1)) ELSE nullif(regexp_extract(upper(raw), '(^|[^A-Za-z0-9_])([ABCD])([^A-Za-z0-9_]|$)', 2), '') END"})
_EW = "regexp_extract_all(answer, '[A-Za-z]+')"
_SY = f"list_sum(list_transform({_EW}, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+'))) - CASE WHEN lower(w) LIKE '%e' AND length(w) > 2 THEN 1 ELSE 0 END))"
_score("fn33_reading_grade", "inference_task = 'B'", {"grade": lambda: F.round(C.reading_grade(col("answer")), 6)}, {"grade": f"round(CAST(CASE WHEN len({_EW}) = 0 THEN 0.0 ELSE CAST(0.39 AS DOUBLE) * len({_EW}) / greatest(1, len(regexp_extract_all(answer, '[.!?]+(?:[ \\t\\n\\r\\f]|$)'))) + CAST(11.8 AS DOUBLE) * {_SY} / len({_EW}) - CAST(15.59 AS DOUBLE) END AS DOUBLE), 6)"})
_NAMES = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"
_score("fn36_name_overlap", "inference_task = 'E' AND language = 'en'", {"f1": lambda: F.round(C.set_f1(F.array_distinct(F.regexp_extract_all(col("raw"), F.lit(_NAMES), F.lit(0))), F.array_distinct(F.regexp_extract_all(F.coalesce(F.get_json_object("gold_payload", "$.source_text"), F.lit("")), F.lit(_NAMES), F.lit(0))), 0.0), 6)}, {"f1": f"round(CAST({_f1('list_distinct(regexp_extract_all(raw, ' + chr(39) + _NAMES + chr(39) + '))', 'list_distinct(regexp_extract_all(' + _j('gold_payload', 'source_text') + ', ' + chr(39) + _NAMES + chr(39) + '))', '0.0')} AS DOUBLE), 6)"})
register("fn38_steps", lambda s, d: table(s, d, "pack_stats", "model", "docs_tokenized").groupBy("model").agg(F.sum("docs_tokenized").alias("n")).select("model", F.ceil(col("n") / 64).cast("bigint").alias("steps"), (F.ceil(col("n") / 64) * 3).cast("bigint").alias("steps_of_3_epochs")), "SELECT model, CAST(ceil(sum(docs_tokenized) / 64.0) AS BIGINT) AS steps, CAST(ceil(sum(docs_tokenized) / 64.0) * 3 AS BIGINT) AS steps_of_3_epochs FROM pack_stats GROUP BY model")


def _mapped(s, d):
    """Questions of either shape as one: holdout rows as they are, and as a list of
    choices with the number of the right one."""
    h = table(s, d, "holdout", "question_id", "question", "options", "correct_option_letter")
    o = F.transform_keys(F.from_json("options", "map<string,string>"), lambda k, v: F.upper(k))
    x = h.withColumn("o", o).filter(F.size("o") == 4)
    return x.select("question_id", F.upper("correct_option_letter").alias("gold"), F.try_element_at("o", F.upper("correct_option_letter")).alias("right_text")).filter("right_text IS NOT NULL")


_HK = "(SELECT list(upper(k)) FROM (SELECT unnest(json_keys(options)) AS k))"
register("fn40_mapped_questions", _mapped, "SELECT question_id, gold, right_text FROM (SELECT question_id, upper(correct_option_letter) AS gold, coalesce(json_extract_string(options, '$.' || upper(correct_option_letter)), json_extract_string(options, '$.' || lower(correct_option_letter))) AS right_text FROM holdout WHERE len(json_keys(options)) = 4) WHERE right_text IS NOT NULL")
_X4 = "(floor(o_totalprice / 100) / 10000.0 - 2)"
register("fn41_formats", lambda s, d: table(s, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", (F.floor(col("o_totalprice") / 100) / 10000 - 2).alias("x"), F.floor(col("o_totalprice") / 100).alias("k")).select("o_orderkey", X.percent(F.round("x", 4), 2).alias("percent"), X.signed(F.round("x", 4), 4).alias("signed"), X.p_value((col("k") % 1000) / 1000.0).alias("p")), f"SELECT o_orderkey, format('{{:.2f}}%', round({_X4}, 4) * 100) AS percent, format('{{:+.4f}}', round({_X4}, 4)) AS signed, CASE WHEN CAST(floor(o_totalprice / 100) AS BIGINT) % 1000 < 1 THEN '0.0e+00' ELSE format('{{:.3f}}', CAST(floor(o_totalprice / 100) AS BIGINT) % 1000 / 1000.0) END AS p FROM orders")
_score("sc05_explanations", "inference_task = 'F'", {"n_words": lambda: C.n_tokens(col("explanation")), "n_sentences": lambda: C.n_sentences(col("explanation")), "density": lambda: F.round(C.markers_per_100(col("explanation")), 6), "foreign": lambda: F.round(C.foreign_share(col("explanation")), 6)}, {"n_words": f"CAST({_nt('explanation')} AS INT)", "n_sentences": _sent("explanation"), "density": f"round(CAST(100.0 * {_MARK} / greatest(1, {_nt('explanation')}) AS DOUBLE), 6)", "foreign": "round(CAST(CASE WHEN len(regexp_extract_all(explanation, '\\p{L}')) = 0 THEN 0.0 ELSE 1.0 - len(regexp_extract_all(explanation, '[\\x{0904}-\\x{0939}\\x{093D}\\x{0950}\\x{0958}-\\x{0961}\\x{0971}-\\x{097F}]')) / len(regexp_extract_all(explanation, '\\p{L}')) END AS DOUBLE), 6)"})
_score("sc06_directed_answers", "inference_task = 'G'", {"length": lambda: F.round(C.length_adherence(C.n_tokens(col("answer")), col("target")), 6), "years_f1": lambda: F.round(C.set_f1(C.years(col("answer")), C.years(col("model_answer")), 1.0), 6), "numbers_f1": lambda: F.round(C.set_f1(C.numbers(col("answer")), C.numbers(col("model_answer")), 1.0), 6), "depth": lambda: C.directive(col("question"))}, {"length": f"round(CAST({_adh(_nt('answer'), 'target')} AS DOUBLE), 6)", "years_f1": f"round(CAST({_f1(_YEARS.replace('{0}', 'answer'), _YEARS.replace('{0}', 'model_answer'), '1.0')} AS DOUBLE), 6)", "numbers_f1": f"round(CAST({_f1(_NUMS.replace('{0}', 'answer'), _NUMS.replace('{0}', 'model_answer'), '1.0')} AS DOUBLE), 6)", "depth": _DIR})
register("sc07_dispatch", lambda s, d: _scored(s, d).groupBy("tsk").agg(F.count(F.lit(1)).alias("n"), F.count("is_correct").alias("with_letter"), F.count("pred_score").alias("with_score")), _WITH + "SELECT tsk, count(*) AS n, count(is_correct) AS with_letter, count(pred_score) AS with_score FROM sc GROUP BY tsk")
register("ml03_probe_accuracy", lambda s, d: _scored(s, d).filter("tsk = 'A' AND letter IN ('A', 'B', 'C', 'D')").groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("is_correct"), 6).alias("accuracy")), _WITH + "SELECT condition, count(*) AS n, round(avg(is_correct), 6) AS accuracy FROM sc WHERE tsk = 'A' AND letter IN ('A', 'B', 'C', 'D') GROUP BY condition")

# Statistics and reports.
_PR = "v AS (SELECT task, metric, question_id, condition, avg(value) AS value FROM lg GROUP BY ALL), pr AS (SELECT x.task, x.metric, x.question_id, x.condition AS condition_a, y.condition AS condition_b, CASE WHEN x.metric IN ('" + "', '".join(evaluation.LOWER_IS_BETTER) + "') THEN y.value - x.value ELSE x.value - y.value END AS diff FROM v x JOIN v y ON x.task = y.task AND x.metric = y.metric AND x.question_id = y.question_id AND x.condition < y.condition)"


def _pairs(s, d):
    return evaluation.pairs(_long(s, d), ["task"])


register("st07_cohen_d", lambda s, d: _pairs(s, d).groupBy("task", "metric", "condition_a", "condition_b").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("sd")).filter("n >= 5").select("task", "metric", "condition_a", "condition_b", F.round(F.when(col("sd") > 0, col("m") / col("sd")).otherwise(0.0), 6).alias("d")), _WITH + f", {_PR} SELECT task, metric, condition_a, condition_b, round(CASE WHEN stddev_samp(diff) > 0 THEN avg(diff) / stddev_samp(diff) ELSE 0.0 END, 6) AS d FROM pr GROUP BY ALL HAVING count(*) >= 5")
register("st09_labels", lambda s, d: s.range(0, 101).select("id", evaluation.effect_label((col("id") - 50) / 50.0).alias("label")), "SELECT id, CASE WHEN abs((id - 50) / 50.0) < 0.2 THEN 'negligible' WHEN abs((id - 50) / 50.0) < 0.5 THEN 'small' WHEN abs((id - 50) / 50.0) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM range(0, 101) t(id)")
register("st15_orientation", lambda s, d: _pairs(s, d).groupBy("metric").agg(F.sum(F.when(col("diff") > 0, 1).otherwise(0)).alias("better"), F.sum(F.when(col("diff") < 0, 1).otherwise(0)).alias("worse")), _WITH + f", {_PR} SELECT metric, CAST(sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) AS BIGINT) AS better, CAST(sum(CASE WHEN diff < 0 THEN 1 ELSE 0 END) AS BIGINT) AS worse FROM pr GROUP BY metric")
register("st16_interval_verdicts", lambda s, d: evaluation.bootstrap(_pairs(s, d).filter("metric = 'is_correct'").withColumn("value", col("diff")), ["task", "condition_a", "condition_b"]).select("task", "condition_a", "condition_b", F.when(col("ci_lo") > 0, "WIN").when(col("ci_hi") < 0, "LOSS").otherwise("TIE").alias("verdict")))
register("st17_enough_pairs", lambda s, d: _pairs(s, d).groupBy("task", "metric", "condition_a", "condition_b").agg(F.count(F.lit(1)).alias("n")).groupBy((col("n") >= 5).alias("enough")).agg(F.count(F.lit(1)).alias("cells")), _WITH + f", {_PR} SELECT n >= 5 AS enough, count(*) AS cells FROM (SELECT count(*) AS n FROM pr GROUP BY task, metric, condition_a, condition_b) GROUP BY 1")
register("wi11_best_rows", lambda s, d: evaluation.means(_long(s, d)).filter("language = 'all'").groupBy("task", "metric").agg(F.max(F.struct("mean", "condition")).alias("hi"), F.min(F.struct("mean", "condition")).alias("lo")).select("task", "metric", col("hi.condition").alias("best"), col("lo.condition").alias("least")), _WITH + ", m AS (SELECT task, metric, condition, avg(value) AS mean FROM lg GROUP BY ALL) SELECT task, metric, max({'a': mean, 'c': condition}).c AS best, min({'a': mean, 'c': condition}).c AS least FROM m GROUP BY task, metric")
register("rp04_headline_pairs", lambda s, d: _pairs(s, d).filter("metric = 'is_correct'").groupBy("task", "condition_a", "condition_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diff"), 6).alias("diff")).filter("n >= 5"), _WITH + f", {_PR} SELECT task, condition_a, condition_b, count(*) AS n, round(avg(diff), 6) AS diff FROM pr WHERE metric = 'is_correct' GROUP BY ALL HAVING count(*) >= 5")
register("rp05_heatmap", lambda s, d: _scored(s, d).filter("tsk = 'A'").groupBy("paper", "condition").agg(F.count("is_correct").alias("n"), F.round(F.avg("is_correct"), 6).alias("accuracy")).filter("n >= 5"), _WITH + "SELECT paper, condition, count(is_correct) AS n, round(avg(is_correct), 6) AS accuracy FROM sc WHERE tsk = 'A' GROUP BY paper, condition HAVING count(is_correct) >= 5")
register("rp06_headline", lambda s, d: _champion(s, d).select("task", "champion", "verdict"), _WITH + _CH + " SELECT task, champion, CASE WHEN mean - base > 0 THEN 'WIN' WHEN mean - base < 0 THEN 'LOSS' ELSE 'TIE' END AS verdict FROM c WHERE k = 1")
register("rp08_themes", lambda s, d: _long(s, d).select("metric").distinct().select("metric", F.when(col("metric").rlike("correct|fail"), "accuracy").when(col("metric").rlike("latency|tps"), "speed").otherwise("text").alias("theme")), _WITH + "SELECT DISTINCT metric, CASE WHEN regexp_matches(metric, 'correct|fail') THEN 'accuracy' WHEN regexp_matches(metric, 'latency|tps') THEN 'speed' ELSE 'text' END AS theme FROM lg")
register("rp10_side_by_side", lambda s, d: _scored(s, d).groupBy("question_id", "tsk").pivot("condition", ["C1a", "C2"]).agg(F.max("n_words")).filter("C1a IS NOT NULL AND C2 IS NOT NULL"), _WITH + "SELECT * FROM (SELECT question_id, tsk, max(CASE WHEN condition = 'C1a' THEN n_words END) AS C1a, max(CASE WHEN condition = 'C2' THEN n_words END) AS C2 FROM sc GROUP BY ALL) WHERE C1a IS NOT NULL AND C2 IS NOT NULL")
register("fl17_result_filter", lambda s, d: evaluation.means(_long(s, d)).filter("task = 'A' AND language = 'en' AND metric IN ('is_correct', 'tps')").select("condition", "metric", "n"), _WITH + "SELECT condition, metric, count(*) AS n FROM lg WHERE task = 'A' AND language = 'en' AND metric IN ('is_correct', 'tps') GROUP BY ALL")


# Sinks, read back.
def _parquet_back(s, d):
    at = _folder(s)
    sinks.parquet(table(s, d, "eval_set", "question_id", "task", "language"), at, order=["task", "question_id"], codec="snappy")
    return s.read.parquet(at)


register("snk02_sorted_parquet", _parquet_back, "SELECT question_id, task, language FROM eval_set")


def _json_back(s, d):
    at = _folder(s)
    sinks.json_lines(table(s, d, "ft_corpus", "pair_id", "task", "output").distinct(), at)
    return s.read.schema("pair_id string, task string, output string").json(at).select("pair_id", "task", F.sha2("output", 256).alias("sha"))


register("snk05_json_lines", _json_back, "SELECT pair_id, task, sha256(output) AS sha FROM (SELECT DISTINCT pair_id, task, output FROM ft_corpus)")


def _chat_back(s, d):
    at = _folder(s)
    x = table(s, d, "ft_corpus", "pair_id", "instruction", "output").distinct()
    sinks.json_lines(x.select("pair_id", sinks.chat(F.coalesce("instruction", F.lit("")), F.coalesce("output", F.lit(""))).alias("messages")), at)
    back = s.read.schema("pair_id string, messages array<struct<role:string,content:string>>").json(at)
    return back.select("pair_id", F.explode("messages").alias("m")).groupBy("pair_id", col("m.role").alias("role")).agg(F.max(F.length("m.content")).alias("n"))


_CHAT = "(SELECT DISTINCT pair_id, instruction, output FROM ft_corpus)"
register("snk07_chat_lines", _chat_back, f"SELECT pair_id, 'user' AS role, max(CAST(length(coalesce(instruction, '')) AS INT)) AS n FROM {_CHAT} GROUP BY pair_id UNION ALL SELECT pair_id, 'assistant', max(CAST(length(coalesce(output, '')) AS INT)) FROM {_CHAT} GROUP BY pair_id")


def _shards(s, d):
    at = _folder(s)
    p = table(s, d, "predictions", *_KEY, "created_at", "output_tokens").withColumn("at", F.try_to_timestamp("created_at")).drop("created_at")
    for k in range(2):
        sinks.append_log(p.filter(F.pmod(F.xxhash64("run_id"), F.lit(2)) == k), at)
    return sinks.merge_shards(s.read.parquet(at), _KEY, ["at", "output_tokens"]).select(*_KEY, "output_tokens")


register("snk10_merged_shards", _shards, "SELECT run_id, condition, question_id, inference_task, output_tokens FROM (SELECT *, row_number() OVER (PARTITION BY run_id, condition, question_id, inference_task ORDER BY CAST(created_at AS TIMESTAMPTZ) DESC NULLS LAST, output_tokens DESC NULLS LAST) AS k FROM predictions) WHERE k = 1")


# Acquisition status, and streams run to their end.
def _status(s, d):
    have = table(s, d, "clean_results", "dst_path").filter("dst_path IS NOT NULL").distinct().withColumn("have", F.lit(True))
    x = table(s, d, "documents", "doc_id", "dst_path", "text").join(have, "dst_path", "left")
    status = F.when(col("have") & (col("doc_id") % 3 == 0), "cached").when(col("text").isNull(), "skipped-error").when(F.length("text") < 300, "skipped-short").otherwise("downloaded")
    return x.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))


register("src26_status", _status, "SELECT CASE WHEN doc_id % 3 = 0 AND EXISTS (SELECT 1 FROM clean_results c WHERE c.dst_path = documents.dst_path) THEN 'cached' WHEN text IS NULL THEN 'skipped-error' WHEN length(text) < 300 THEN 'skipped-short' ELSE 'downloaded' END AS status, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")


def _stream(s, d, name: str, *columns: str):
    """A stream over a copy of a table, in several files."""
    at = _folder(s)
    src = table(s, d, name, *columns)
    for c, t in src.dtypes:
        src = src.withColumn(c, col(c).cast("timestamp")) if t == "timestamp_ntz" else src
    src.repartition(3).write.parquet(f"{at}/in")
    return at, s.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def _stream_cleaned(s, d):
    at, stream = _stream(s, d, "documents", "doc_id", "text")
    stateful.append_shards(stateful.cleaned(stream.filter("text IS NOT NULL")).select("doc_id", "reason"), f"{at}/out", f"{at}/state").awaitTermination()
    return s.read.parquet(f"{at}/out").select("doc_id", F.regexp_extract("reason", "^[a-z]*", 0).alias("reason"))


register("sr03_stream_cleaned", _stream_cleaned)


def _stream_resumed(s, d):
    """A stream that has taken one file when it stops, and goes on from its checkpoint
    when the others are there. One that began anew would overwrite its first shard
    and count the first file twice."""
    at = _folder(s)
    src = table(s, d, "predictions", "run_id", "question_id", "inference_task")
    part = F.pmod(F.xxhash64("run_id", "question_id"), F.lit(3))
    for more in ([0], [1, 2]):
        for k in more:
            src.filter(part == k).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = s.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        stateful.append_shards(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return s.read.parquet(f"{at}/out").drop("batch").groupBy("inference_task").agg(F.count(F.lit(1)).alias("n"))


register("sr01_resumed_stream", _stream_resumed, "SELECT inference_task, count(*) AS n FROM predictions GROUP BY inference_task")
register("sr02_last_of_shards", lambda s, d: _stream_last(s, d), "SELECT run_id, condition, question_id, inference_task, output_tokens FROM (SELECT *, row_number() OVER (PARTITION BY run_id, condition, question_id, inference_task ORDER BY created_at DESC NULLS LAST, output_tokens DESC NULLS LAST) AS k FROM predictions) WHERE k = 1")


def _stream_last(s, d):
    at, stream = _stream(s, d, "predictions", *_KEY, "created_at", "output_tokens")
    stateful.append_shards(stream, f"{at}/out", f"{at}/state").awaitTermination()
    return stateful.latest(s, f"{at}/out", _KEY, ["created_at", "output_tokens"]).select(*_KEY, "output_tokens")


def _stream_budget(s, d):
    """Documents in the order of their ids, in several files, until each source has
    its budget of characters."""
    at = _folder(s)
    src = table(s, d, "documents", "doc_id", "source", "n_chars").filter("source IS NOT NULL AND n_chars IS NOT NULL")
    cuts = src.select(F.percentile_approx("doc_id", [0.3, 0.6], 10_000).alias("q")).first().q or [0, 0]
    for lo, hi in ((None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)):
        src.filter((F.lit(lo is None) | (col("doc_id") > lo)) & (F.lit(hi is None) | (col("doc_id") <= hi))).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = s.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stateful.budgeted(stream, "source", ["doc_id"], "n_chars", 20_000, f"{at}/out", f"{at}/state").awaitTermination()
    return s.read.parquet(f"{at}/out/rows").select("source", "doc_id")


register("sr04_stream_budget", _stream_budget, "SELECT source, doc_id FROM (SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL) WHERE b < 20000")


def _breaker(s, d):
    x = table(s, d, "predictions", "condition", "run_id", "question_id", "inference_task", "raw_output").withColumn("o", F.concat_ws("|", "run_id", "question_id", "inference_task", F.sha2(F.coalesce("raw_output", F.lit("")), 256))).withColumn("bad", F.coalesce(F.length("raw_output"), F.lit(0)) < 40).dropDuplicates(["condition", "o"])
    runs = ordered.islands(x, "condition", "o", "bad")
    return runs.groupBy("condition").agg(F.max("n").alias("longest"), F.sum(F.when(col("n") >= 3, 1).otherwise(0)).alias("breaks"))


register("sr06_error_runs", _breaker, "SELECT condition, max(n) AS longest, CAST(sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS breaks FROM (SELECT condition, g, count(*) AS n FROM (SELECT condition, bad, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY condition ORDER BY o) AS g FROM (SELECT DISTINCT condition, concat_ws('|', run_id, question_id, inference_task, sha256(coalesce(raw_output, ''))) AS o, coalesce(length(raw_output), 0) < 40 AS bad FROM predictions)) WHERE bad GROUP BY condition, g) GROUP BY condition")
register("src25_seeded_probe", lambda s, d: sampling.uniform(table(s, d, "holdout", "question_id", "question"), "question_id", 100, 3).select("question_id"), "SELECT question_id FROM holdout ORDER BY sha256('3:' || question_id), question_id LIMIT 100")
