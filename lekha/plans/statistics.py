"""Queries that aggregate and test scored answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekha.functions import scores as C
from lekha.operators import dedup, evaluation, ordered
from lekha.plans.registry import register
from lekha.plans.scores import _nt
from lekha.sources import table

_KEY = ["run_id", "condition", "question_id", "inference_task"]


def _scored(s, d):
    """One row per prediction key, the last one: metrics as columns."""
    p = table(s, d, "predictions", *_KEY, "task", "language", "paper", "prediction", "gold_payload", "raw_output", "latency_ms", "output_tokens", "created_at").withColumn("at", F.try_to_timestamp("created_at")).withColumn("sha", F.sha2(F.coalesce("raw_output", F.lit("")), 256))
    p = dedup.keep_last(p.drop("created_at").filter("run_id IS NOT NULL"), _KEY, ["at", "sha"])
    letter = F.upper(F.substring(F.trim(F.coalesce(F.get_json_object("prediction", "$.answer"), F.lit(""))), 1, 1))
    correct = F.upper(F.get_json_object("gold_payload", "$.correct_option"))
    x = p.withColumn("letter", F.when(F.col("inference_task").isin("A", "F"), letter))
    return x.select(
        *_KEY, "language", "paper", F.col("inference_task").alias("tsk"), "letter", (F.col("letter") == correct).cast("int").alias("is_correct"), F.when(F.col("inference_task").isin("A", "F"), (~letter.isin("A", "B", "C", "D")).cast("int")).alias("format_fail"),
        C.n_tokens(F.coalesce("raw_output", F.lit(""))).alias("n_words"), "latency_ms", F.when(F.col("latency_ms") > 0, F.col("output_tokens") / (F.col("latency_ms") / 1000.0)).alias("tps"),
        F.get_json_object("prediction", "$.score").cast("double").alias("pred_score"), F.get_json_object("gold_payload", "$.score").cast("double").alias("gold_score"), F.get_json_object("gold_payload", "$.max_score").cast("double").alias("max_score"),
    )


_L = "upper(substr(trim(coalesce(json_extract_string(prediction, '$.answer'), '')), 1, 1))"
_SC = f"(SELECT run_id, condition, question_id, inference_task, language, paper, inference_task AS tsk, letter, CAST(letter = correct AS INT) AS is_correct, CASE WHEN inference_task IN ('A', 'F') THEN CAST({_L} NOT IN ('A', 'B', 'C', 'D') AS INT) END AS format_fail, CAST({_nt('coalesce(raw_output, ' + chr(39) * 2 + ')')} AS INT) AS n_words, latency_ms, CASE WHEN latency_ms > 0 THEN output_tokens / (latency_ms / CAST(1000.0 AS DOUBLE)) END AS tps, TRY_CAST(json_extract_string(prediction, '$.score') AS DOUBLE) AS pred_score, TRY_CAST(json_extract_string(gold_payload, '$.score') AS DOUBLE) AS gold_score, TRY_CAST(json_extract_string(gold_payload, '$.max_score') AS DOUBLE) AS max_score FROM (SELECT *, CASE WHEN inference_task IN ('A', 'F') THEN {_L} END AS letter, upper(json_extract_string(gold_payload, '$.correct_option')) AS correct, row_number() OVER (PARTITION BY run_id, condition, question_id, inference_task ORDER BY CAST(created_at AS TIMESTAMPTZ) DESC NULLS LAST, sha256(coalesce(raw_output, '')) DESC) AS rn FROM predictions WHERE run_id IS NOT NULL) WHERE rn = 1)"
_METRICS = ("is_correct", "format_fail", "n_words", "latency_ms", "tps")


def _long(s, d):
    x = _scored(s, d).select("condition", F.col("tsk").alias("task"), "language", "question_id", *[F.col(m).cast("double").alias(m) for m in _METRICS])
    return x.unpivot(["condition", "task", "language", "question_id"], list(_METRICS), "metric", "value")


_LONG = "(" + " UNION ALL ".join(f"SELECT condition, tsk AS task, language, question_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM sc" for m in _METRICS) + ")"
_WITH = f"WITH sc AS {_SC}, lg AS (SELECT * FROM {_LONG} WHERE value IS NOT NULL) "


def _r(*cs: str):
    return [F.round(c, 6).alias(c) for c in cs]


register("ag01_counts", lambda s, d: table(s, d, "predictions", "inference_task", "language").groupBy("inference_task", "language").agg(F.count(F.lit(1)).alias("n")), "SELECT inference_task, language, count(*) AS n FROM predictions GROUP BY ALL")
register("ag03_grouping_sets", lambda s, d: evaluation.means(_long(s, d)).select("condition", "task", "language", "metric", "n", *_r("mean")), _WITH + "SELECT condition, task, CASE WHEN grouping(language) = 1 THEN 'all' ELSE language END AS language, metric, count(*) AS n, round(avg(value), 6) AS mean FROM lg GROUP BY GROUPING SETS ((condition, task, language, metric), (condition, task, metric))")
register("ag02_means", lambda s, d: evaluation.means(_long(s, d)).filter("language <> 'all'").select("condition", "task", "language", "metric", "n", *_r("mean")), _WITH + "SELECT condition, task, language, metric, count(*) AS n, round(avg(value), 6) AS mean FROM lg WHERE language IS NOT NULL GROUP BY ALL")
register("ag04_bootstrap", lambda s, d: evaluation.bootstrap(_long(s, d).filter("metric = 'is_correct'"), ["condition", "task", "metric"]))
register("ag05_percentiles", lambda s, d: _scored(s, d).groupBy("condition").agg(F.percentile("latency_ms", F.array(*[F.lit(x) for x in (0.5, 0.95, 0.99)])).alias("p"), F.avg("tps").alias("tps")).select("condition", *[F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("p50", "p95", "p99"))], *_r("tps")), _WITH + "SELECT condition, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, round(avg(tps), 6) AS tps FROM sc GROUP BY condition")
register("ag06_split_means", lambda s, d: _scored(s, d).filter("tsk = 'A'").groupBy("condition").agg(F.avg(F.when(F.col("paper") == "CSAT", F.col("is_correct"))).alias("csat"), F.avg(F.when(F.col("paper") != "CSAT", F.col("is_correct"))).alias("other"), F.count("is_correct").alias("n")).filter("n >= 5").select("condition", *_r("csat", "other"), "n"), _WITH + "SELECT condition, round(avg(CASE WHEN paper = 'CSAT' THEN is_correct END), 6) AS csat, round(avg(CASE WHEN paper <> 'CSAT' THEN is_correct END), 6) AS other, count(is_correct) AS n FROM sc WHERE tsk = 'A' GROUP BY condition HAVING count(is_correct) >= 5")
register("ag07_pivot", lambda s, d: evaluation.means(_long(s, d)).filter("language = 'all'").groupBy("condition", "task").pivot("metric", ["is_correct", "n_words"]).agg(F.round(F.first("mean"), 6)), _WITH + "SELECT condition, task, round(avg(CASE WHEN metric = 'is_correct' THEN value END), 6) AS is_correct, round(avg(CASE WHEN metric = 'n_words' THEN value END), 6) AS n_words FROM lg GROUP BY ALL")
register("ag08_distinct", lambda s, d: table(s, d, "predictions", "condition", "question_id", "run_id").groupBy("condition").agg(F.countDistinct("question_id").alias("questions"), F.countDistinct("run_id").alias("runs")), "SELECT condition, count(DISTINCT question_id) AS questions, count(DISTINCT run_id) AS runs FROM predictions GROUP BY condition")
_B = "CASE WHEN {0} / max_score <= CAST(0.30 AS DOUBLE) THEN 'low' WHEN {0} / max_score <= CAST(0.60 AS DOUBLE) THEN 'mid' ELSE 'high' END"
register("ag15_confusion", lambda s, d: _scored(s, d).filter("tsk = 'C' AND pred_score IS NOT NULL AND gold_score IS NOT NULL").groupBy("condition", C.band(F.col("gold_score"), F.col("max_score")).alias("gold"), C.band(F.col("pred_score"), F.col("max_score")).alias("pred")).agg(F.count(F.lit(1)).alias("n")), _WITH + f"SELECT condition, {_B.replace('{0}', 'gold_score')} AS gold, {_B.replace('{0}', 'pred_score')} AS pred, count(*) AS n FROM sc WHERE tsk = 'C' AND pred_score IS NOT NULL AND gold_score IS NOT NULL GROUP BY ALL")


def _gaps(s, d):
    have = evaluation.means(_long(s, d)).filter("language = 'all'").select("condition", "task", "metric", "n")
    # Every condition and metric belongs to the grid of every task, which needn't be made.
    size = have.agg((F.countDistinct("condition") * F.countDistinct("metric")).alias("n")).first().n
    return have.groupBy("task").agg(F.count("n").alias("filled"), (F.lit(size) - F.count("n")).alias("empty"))


register("ag16_gaps", _gaps, _WITH + ", h AS (SELECT condition, task, metric, count(*) AS n FROM lg GROUP BY ALL) SELECT g.task, count(n) AS filled, CAST(sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM (SELECT * FROM (SELECT DISTINCT condition FROM h), (SELECT DISTINCT task FROM h), (SELECT DISTINCT metric FROM h)) g LEFT JOIN h ON g.condition = h.condition AND g.task = h.task AND g.metric = h.metric GROUP BY g.task")


def _confident(s, d):
    """Answers with a confidence made from the question's hash, as none is stored."""
    u = F.conv(F.substring(F.sha2("question_id", 256), 1, 6), 16, 10).cast("bigint") / F.lit(16777215.0)
    return _scored(s, d).filter("tsk = 'A' AND is_correct IS NOT NULL").withColumn("conf", u).withColumn("brier", (u - F.col("is_correct")) * (u - F.col("is_correct")))


_CF = "SELECT *, CAST('0x' || substr(sha256(question_id), 1, 6) AS BIGINT) / CAST(16777215.0 AS DOUBLE) AS conf FROM sc WHERE tsk = 'A' AND is_correct IS NOT NULL"
register("st01_calibration", lambda s, d: evaluation.calibration_error(_confident(s, d), ["condition"], "conf", "is_correct").select("condition", *_r("ece"), "n"), _WITH + f", cf AS ({_CF}), b AS (SELECT condition, len(list_filter(range(1, 15), lambda i: conf > i / CAST(15 AS DOUBLE))) AS bin, count(*) AS n, avg(conf) AS c, avg(is_correct) AS a FROM cf GROUP BY ALL) SELECT condition, round(sum(n * abs(a - c)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY condition")
register("st02_brier_skill", lambda s, d: evaluation.brier_skill(_confident(s, d), ["condition"], "brier", "is_correct").select("condition", *_r("skill")), _WITH + f", cf AS ({_CF}) SELECT condition, round(CASE WHEN avg(is_correct * is_correct) - avg(is_correct) * avg(is_correct) > 1e-12 THEN 1 - avg((conf - is_correct) * (conf - is_correct)) / (avg(is_correct * is_correct) - avg(is_correct) * avg(is_correct)) END, 6) AS skill FROM cf GROUP BY condition")
register("st03_position_bias", lambda s, d: evaluation.position_bias(_scored(s, d).filter("tsk = 'A'"), ["condition"], "letter").select("condition", "n", *_r("chi2")), _WITH + "SELECT condition, count(*) AS n, round(CASE WHEN count(*) >= 8 THEN (power(count(*) FILTER (letter = 'A') - count(*) / 4, 2) + power(count(*) FILTER (letter = 'B') - count(*) / 4, 2) + power(count(*) FILTER (letter = 'C') - count(*) / 4, 2) + power(count(*) FILTER (letter = 'D') - count(*) / 4, 2)) / (count(*) / 4) END, 6) AS chi2 FROM sc WHERE tsk = 'A' AND letter IN ('A', 'B', 'C', 'D') GROUP BY condition")
_PAIRS = "v AS (SELECT task, metric, question_id, condition, avg(value) AS value FROM lg GROUP BY ALL), pr AS (SELECT x.task, x.metric, x.question_id, x.condition AS condition_a, y.condition AS condition_b, x.value AS a, y.value AS b, CASE WHEN x.metric IN ('" + "', '".join(evaluation.LOWER_IS_BETTER) + "') THEN y.value - x.value ELSE x.value - y.value END AS diff FROM v x JOIN v y ON x.task = y.task AND x.metric = y.metric AND x.question_id = y.question_id AND x.condition < y.condition)"
register("jn13_condition_pairs", lambda s, d: evaluation.pairs(_long(s, d), ["task"]).select("task", "metric", "question_id", "condition_a", "condition_b", *_r("diff")), _WITH + f", {_PAIRS} SELECT task, metric, question_id, condition_a, condition_b, round(diff, 6) AS diff FROM pr")
_G = "task, metric, condition_a, condition_b"
_HOLD = "least(1.0, greatest(0.0, {0}))"
register("st04_paired_tests", lambda s, d: evaluation.paired_tests(evaluation.pairs(_long(s, d), ["task"]), ["task"]).select("task", "metric", "condition_a", "condition_b", "n_paired", *_r("mean_diff", "t", "effect"), "effect_kind", "label"), _WITH + f", {_PAIRS}, g AS (SELECT {_G}, count(*) AS n_paired, avg(a) AS ma, avg(b) AS mb, avg(diff) AS md, stddev_samp(diff) AS sd FROM pr GROUP BY ALL HAVING count(*) >= 5), e AS (SELECT *, CASE WHEN metric IN ('" + "', '".join(evaluation.PROPORTIONS) + f"') THEN 2 * asin(sqrt({_HOLD.replace('{0}', 'ma')})) - 2 * asin(sqrt({_HOLD.replace('{0}', 'mb')})) WHEN sd > 0 THEN md / sd ELSE 0.0 END AS es FROM g) SELECT {_G}, n_paired, round(md, 6) AS mean_diff, round(CASE WHEN sd > 0 THEN md / (sd / sqrt(n_paired)) END, 6) AS t, round(es, 6) AS effect, CASE WHEN metric IN ('" + "', '".join(evaluation.PROPORTIONS) + "') THEN 'cohen_h' ELSE 'cohen_d' END AS effect_kind, CASE WHEN abs(es) < 0.2 THEN 'negligible' WHEN abs(es) < 0.5 THEN 'small' WHEN abs(es) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM e")
register("st06_signed_ranks", lambda s, d: evaluation.paired_tests(evaluation.pairs(_long(s, d), ["task"]), ["task"]).select("task", "metric", "condition_a", "condition_b", *_r("w")), _WITH + f", {_PAIRS}, r AS (SELECT {_G}, diff, rank() OVER (PARTITION BY {_G} ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY {_G}, abs(diff)) - 1) / 2.0 AS rk FROM pr WHERE diff <> 0), w AS (SELECT {_G}, least(sum(CASE WHEN diff > 0 THEN rk ELSE 0 END), sum(CASE WHEN diff < 0 THEN rk ELSE 0 END)) AS w FROM r GROUP BY ALL) SELECT g.task, g.metric, g.condition_a, g.condition_b, round(CAST(w.w AS DOUBLE), 6) AS w FROM (SELECT {_G} FROM pr GROUP BY ALL HAVING count(*) >= 5) g LEFT JOIN w USING (task, metric, condition_a, condition_b)")
register("st13_false_discovery", lambda s, d: evaluation.false_discovery(evaluation.false_discovery(evaluation.paired_tests(evaluation.pairs(_long(s, d), ["task"]), ["task"]), "t_p", "t_q"), "w_p", "w_q").withColumn("significant", (F.coalesce("t_q", F.lit(1.0)) < 0.05) & (F.col("w_q") < 0.05)).select("task", "metric", "condition_a", "condition_b", "t_p", "t_q", "w_p", "w_q", "significant"))


def _bh(s, d):
    """The step-up rule over p-values made from row hashes."""
    x = table(s, d, "eval_set", "question_id").filter("question_id IS NOT NULL").withColumn("p", F.conv(F.substring(F.sha2("question_id", 256), 1, 3), 16, 10).cast("bigint") / F.lit(4095.0))
    return evaluation.false_discovery(x, "p", "q").select("question_id", *_r("q"))


register("wi04_step_up", _bh, "SELECT question_id, round(least(1.0, min(p * m / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM (SELECT question_id, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM (SELECT question_id, CAST('0x' || substr(sha256(question_id), 1, 3) AS BIGINT) / CAST(4095.0 AS DOUBLE) AS p FROM eval_set WHERE question_id IS NOT NULL))")
register("st10_weighted_kappa", lambda s, d: evaluation.weighted_kappa(_scored(s, d).filter("tsk = 'C'"), ["condition"], "pred_score", "gold_score").select("condition", "n", *_r("kappa")), _WITH + ", x AS (SELECT condition, round_even(pred_score, 0) AS x, round_even(gold_score, 0) AS y FROM sc WHERE tsk = 'C' AND pred_score IS NOT NULL AND gold_score IS NOT NULL), o AS (SELECT condition, count(*) AS n, avg((x - y) * (x - y)) AS s FROM x GROUP BY condition), e AS (SELECT a.condition, avg((a.x - b.y) * (a.x - b.y)) AS e FROM x a JOIN x b ON a.condition = b.condition GROUP BY a.condition) SELECT condition, n, round(1 - s / e, 6) AS kappa FROM o JOIN e USING (condition)")
register("st11_correlations", lambda s, d: evaluation.rank_correlation(_scored(s, d).filter("tsk = 'C'"), ["condition"], "pred_score", "gold_score").select("condition", "n", *_r("spearman", "pearson")), _WITH + ", x AS (SELECT condition, pred_score AS x, gold_score AS y FROM sc WHERE tsk = 'C' AND pred_score IS NOT NULL AND gold_score IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY condition ORDER BY x) + (count(*) OVER (PARTITION BY condition, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY condition ORDER BY y) + (count(*) OVER (PARTITION BY condition, y) - 1) / 2 AS ry FROM x) SELECT condition, count(*) AS n, round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson FROM r GROUP BY condition")
register("st12_errors", lambda s, d: _scored(s, d).filter("tsk = 'C' AND pred_score IS NOT NULL AND gold_score IS NOT NULL").groupBy("condition").agg(F.avg(F.abs(F.col("pred_score") - F.col("gold_score"))).alias("mae"), (F.var_samp("pred_score") / F.var_samp("gold_score")).alias("variance_ratio")).select("condition", *_r("mae", "variance_ratio")), _WITH + "SELECT condition, round(avg(abs(pred_score - gold_score)), 6) AS mae, round(var_samp(pred_score) / var_samp(gold_score), 6) AS variance_ratio FROM sc WHERE tsk = 'C' AND pred_score IS NOT NULL AND gold_score IS NOT NULL GROUP BY condition")
register("jn14_bilingual", lambda s, d: evaluation.bilingual(_scored(s, d).filter("tsk = 'A' AND is_correct IS NOT NULL"), ["condition"]).select("condition", "n", *_r("acc_en", "acc_hi"), "b", "c"), _WITH + ", x AS (SELECT condition, regexp_replace(question_id, ':(en|hi)$', '') AS stem, max(CASE WHEN language = 'en' THEN is_correct END) AS en, max(CASE WHEN language = 'hi' THEN is_correct END) AS hi FROM sc WHERE tsk = 'A' AND is_correct IS NOT NULL GROUP BY ALL) SELECT condition, count(*) AS n, round(avg(en), 6) AS acc_en, round(avg(hi), 6) AS acc_hi, CAST(sum(CASE WHEN en = 1 AND hi = 0 THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN en = 0 AND hi = 1 THEN 1 ELSE 0 END) AS BIGINT) AS c FROM x WHERE en IS NOT NULL AND hi IS NOT NULL GROUP BY condition HAVING count(*) >= 5")
register("st05_languages", lambda s, d: evaluation.bilingual(_scored(s, d).filter("tsk = 'A' AND is_correct IS NOT NULL"), ["condition"]))
register("st14_binomial_gate", lambda s, d: evaluation.binomial_gate(_scored(s, d).filter("tsk = 'A' AND is_correct IS NOT NULL"), ["condition"], "is_correct").select("condition", "n", "k"), _WITH + "SELECT condition, count(*) AS n, CAST(sum(is_correct) AS BIGINT) AS k FROM sc WHERE tsk = 'A' AND is_correct IS NOT NULL GROUP BY condition")


def _champion(s, d):
    x = evaluation.means(_long(s, d)).filter("language = 'all' AND metric = 'is_correct'")
    best = x.groupBy("task").agg(F.max(F.struct("mean", "condition")).alias("best"), F.max(F.when(F.col("condition") == "C1a", F.col("mean"))).alias("base"))
    return best.select("task", F.col("best.condition").alias("champion"), F.round("best.mean", 6).alias("mean"), F.round(F.col("best.mean") - F.col("base"), 6).alias("gain"), F.when(F.col("best.mean") - F.col("base") > 0, "WIN").when(F.col("best.mean") - F.col("base") < 0, "LOSS").otherwise("TIE").alias("verdict"))


_CH = ", m AS (SELECT condition, task, avg(value) AS mean FROM lg WHERE metric = 'is_correct' GROUP BY ALL), c AS (SELECT task, condition AS champion, mean, row_number() OVER (PARTITION BY task ORDER BY mean DESC, condition DESC) AS k, max(CASE WHEN condition = 'C1a' THEN mean END) OVER (PARTITION BY task) AS base FROM m)"
register("jn15_champion", _champion, _WITH + _CH + " SELECT task, champion, round(mean, 6) AS mean, round(mean - base, 6) AS gain, CASE WHEN mean - base > 0 THEN 'WIN' WHEN mean - base < 0 THEN 'LOSS' ELSE 'TIE' END AS verdict FROM c WHERE k = 1")
register("rp07_winner_flags", lambda s, d: evaluation.means(_long(s, d)).filter("language = 'all'").withColumn("best", F.max("mean").over(W.partitionBy("task", "metric"))).select("condition", "task", "metric", (F.col("mean") == F.col("best")).alias("winner")), _WITH + "SELECT condition, task, metric, mean = max(mean) OVER (PARTITION BY task, metric) AS winner FROM (SELECT condition, task, metric, avg(value) AS mean FROM lg GROUP BY ALL)")
register("rp03_parent_delta", lambda s, d: evaluation.means(_long(s, d)).filter("language = 'all' AND metric = 'is_correct'").groupBy("condition").pivot("task", ["A", "F"]).agg(F.first("mean")).select("condition", F.round(F.col("F") - F.col("A"), 6).alias("delta")), _WITH + "SELECT condition, round(avg(CASE WHEN task = 'F' THEN value END) - avg(CASE WHEN task = 'A' THEN value END), 6) AS delta FROM lg WHERE metric = 'is_correct' GROUP BY condition")


def _pending(s, d):
    tasks = F.when(F.col("task") == "A", F.array(F.lit("A"), F.lit("F"))).when(F.col("task") == "B", F.array(F.lit("B"), F.lit("G"))).otherwise(F.array("task"))
    todo = table(s, d, "eval_set", "question_id", "task").select("question_id", F.explode(tasks).alias("inference_task"))
    return todo.join(table(s, d, "predictions", "question_id", "inference_task"), ["question_id", "inference_task"], "left_anti").groupBy("inference_task").agg(F.count(F.lit(1)).alias("n"))


register("jn16_pending", _pending, "SELECT inference_task, count(*) AS n FROM (SELECT question_id, unnest(CASE WHEN task = 'A' THEN ['A', 'F'] WHEN task = 'B' THEN ['B', 'G'] ELSE [task] END) AS inference_task FROM eval_set) t WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.question_id = t.question_id AND p.inference_task = t.inference_task) GROUP BY inference_task")


def _miss_runs(s, d):
    x = table(s, d, "file_results", "file_id", "source", "md_text", "n_pages").filter("source IS NOT NULL").withColumn("bad", (F.coalesce("n_pages", F.lit(0)) <= 1) | F.col("md_text").isNull())
    return ordered.islands(x, "source", "file_id", "bad").select("source", "first", "last", "n")


register("wi10_miss_runs", _miss_runs, "SELECT source, min(file_id) AS first, max(file_id) AS last, count(*) AS n FROM (SELECT source, file_id, bad, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY file_id) AS g FROM (SELECT source, file_id, (coalesce(n_pages, 0) <= 1 OR md_text IS NULL) AS bad FROM file_results WHERE source IS NOT NULL)) WHERE bad GROUP BY source, g")
