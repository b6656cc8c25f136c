"""Queries that score answers row by row."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lekha.functions import scores as C
from lekha.functions.text import SPACE, words
from lekha.plans.registry import register
from lekha.plans.text import _WORDS
from lekha.sources import table

_S = SPACE.replace("'", "''")
_KEY = ["run_id", "condition", "question_id", "inference_task"]


def _answers(s, d):
    """Model answers with their references, repeated rows once."""
    p = table(s, d, "predictions", *_KEY, "task", "language", "prediction", "gold_payload", "raw_output", "input_text", "latency_ms", "output_tokens", "created_at")
    g = lambda c, f: F.get_json_object(c, f"$.{f}")
    return p.select(
        *_KEY, "task", "language", "created_at", F.coalesce("raw_output", F.lit("")).alias("raw"), "input_text", "prediction", "gold_payload", "latency_ms", "output_tokens",
        F.coalesce(g("prediction", "answer"), F.lit("")).alias("answer"), F.coalesce(g("prediction", "explanation"), F.lit("")).alias("explanation"),
        F.coalesce(g("gold_payload", "model_answer"), F.lit("")).alias("model_answer"), F.coalesce(g("gold_payload", "explanation"), F.lit("")).alias("gold_explanation"),
        F.coalesce(g("gold_payload", "correct_option"), F.lit("")).alias("correct"), F.coalesce(g("gold_payload", "question"), g("gold_payload", "question_text"), F.lit("")).alias("question"),
        F.coalesce(g("gold_payload", "word_count").cast("int"), F.lit(250)).alias("target"),
    )


_J = "coalesce(json_extract_string({0}, '$.{1}'), '')"


def _j(c: str, f: str) -> str:
    return _J.replace("{0}", c).replace("{1}", f)


_A = f"(SELECT *, coalesce(raw_output, '') AS raw, {_j('prediction', 'answer')} AS answer, {_j('prediction', 'explanation')} AS explanation, {_j('gold_payload', 'model_answer')} AS model_answer, {_j('gold_payload', 'explanation')} AS gold_explanation, {_j('gold_payload', 'correct_option')} AS correct, coalesce(json_extract_string(gold_payload, '$.question'), json_extract_string(gold_payload, '$.question_text'), '') AS question, coalesce(TRY_CAST(json_extract_string(gold_payload, '$.word_count') AS INT), 250) AS target FROM predictions)"
_K = ", ".join(_KEY)
_L = C.LETTERS
_NT = f"len(regexp_extract_all({{0}}, '{_L}'))"


def _nt(c: str) -> str:
    return _NT.replace("{0}", c)


def _score(name: str, where: str, cols: dict, sql: dict) -> None:
    """A query of distinct rows: the key and the scores, in both forms."""
    register(name, lambda s, d: _answers(s, d).filter(where).select(*_KEY, *[v().alias(k) for k, v in cols.items()]).distinct(), f"SELECT DISTINCT {_K}, " + ", ".join(f"{v} AS {k}" for k, v in sql.items()) + f" FROM {_A} WHERE {where}")


col = F.col
_score("fn03_word_counts", "inference_task IN ('A', 'F')", {"n": lambda: C.n_tokens(col("explanation"))}, {"n": f"CAST({_nt('explanation')} AS INT)"})
_SENT = f"CASE WHEN regexp_replace({{0}}, '{_S}+', '', 'g') = '' THEN 0 ELSE CAST(len(regexp_extract_all({{0}}, '[.!?\\x{{0964}}]{_S}+[A-Z0-9\"''(\\[\\x{{0900}}-\\x{{097F}}]')) AS INT) + 1 END"


def _sent(c: str) -> str:
    return _SENT.replace("{0}", c)


_score("fn04_sentences", "inference_task IN ('B', 'G')", {"n": lambda: C.n_sentences(col("answer"))}, {"n": _sent("answer")})
_YEARS = "list_sort(list_distinct(regexp_extract_all({0}, '(?:^|[^0-9A-Za-z_])((?:19|20|21)[0-9]{2})\\b', 1)))"
_NUMS = "list_sort(list_distinct(regexp_extract_all({0}, '[0-9]+(?:\\.[0-9]+)?')))"
_score("fn05_articles", "inference_task = 'A'", {"n": lambda: F.array_join(F.transform(C.articles(col("explanation")), lambda x: x.cast("string")), ",")}, {"n": "array_to_string(list_transform(regexp_extract_all(explanation, 'Article[ \\t\\n]+([0-9]+)', 1), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',')"})
_score("fn06_years", "inference_task IN ('B', 'G')", {"years": lambda: F.array_join(C.years(col("answer")), ",")}, {"years": f"array_to_string({_YEARS.replace('{0}', 'answer')}, ',')"})
_score("fn07_numbers", "inference_task IN ('B', 'G')", {"numbers": lambda: F.array_join(C.numbers(col("answer")), ",")}, {"numbers": f"array_to_string({_NUMS.replace('{0}', 'answer')}, ',')"})


def _f1(a: str, b: str, empty: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {empty} ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


_score("fn24_set_f1", "inference_task IN ('B', 'G')", {"years_f1": lambda: F.round(C.set_f1(C.years(col("answer")), C.years(col("model_answer")), 1.0), 6), "numbers_f1": lambda: F.round(C.set_f1(C.numbers(col("answer")), C.numbers(col("model_answer")), 1.0), 6)}, {"years_f1": f"round(CAST({_f1(_YEARS.replace('{0}', 'answer'), _YEARS.replace('{0}', 'model_answer'), '1.0')} AS DOUBLE), 6)", "numbers_f1": f"round(CAST({_f1(_NUMS.replace('{0}', 'answer'), _NUMS.replace('{0}', 'model_answer'), '1.0')} AS DOUBLE), 6)"})
_score("fn08_repetition", "inference_task IN ('B', 'G')", {"share": lambda: F.round(C.repetition(C.word_tokens(col("answer"))), 6)}, {"share": f"round(CAST(CASE WHEN {_nt('answer')} < 4 THEN 0.0 ELSE (SELECT sum(CASE WHEN k > 1 THEN k ELSE 0 END) / sum(k) FROM (SELECT count(*) AS k FROM (SELECT unnest(list_transform(range(1, len(t) - 2), lambda i: array_to_string(list_slice(t, i, i + 3), ' '))) AS g FROM (SELECT regexp_extract_all(answer, '{_L}') AS t)) GROUP BY g)) END AS DOUBLE), 6)"})
_T = "regexp_extract_all(answer, '" + _L + "')"
_score("wi08_moving_ttr", "inference_task IN ('B', 'G')", {"ttr": lambda: F.round(C.moving_ttr(C.word_tokens(col("answer"))), 6)}, {"ttr": f"round(CAST(CASE WHEN len({_T}) < 100 THEN len(list_distinct({_T})) / greatest(1, len({_T})) ELSE list_avg(list_transform(range(1, len({_T}) - 98), lambda i: len(list_distinct(list_slice({_T}, i, i + 99))))) / 100.0 END AS DOUBLE), 6)"})


def _adh(a: str, t: str) -> str:
    return f"CASE WHEN abs({a} - greatest(1, {t})) <= CAST(0.10 AS DOUBLE) * greatest(1, {t}) THEN 1.0 WHEN {a} < greatest(1, {t}) THEN greatest(0.0, 1.0 + CAST(1.5 AS DOUBLE) * ({a} - greatest(1, {t})) / greatest(1, {t})) ELSE greatest(0.0, 1.0 - ({a} - greatest(1, {t})) / greatest(1, {t})) END"


_score("fn09_length_adherence", "inference_task IN ('B', 'G')", {"score": lambda: F.round(C.length_adherence(C.n_tokens(col("answer")), col("target")), 6)}, {"score": f"round(CAST({_adh(_nt('answer'), 'target')} AS DOUBLE), 6)"})
_PARA = f"len(list_filter(regexp_split_to_array(answer, '\\n[ \\t]*\\n+'), lambda x: regexp_replace(x, '{_S}+', '', 'g') <> ''))"
_LO, _HI = (f"CASE WHEN target <= 175 THEN {a} WHEN target <= 400 THEN {b} ELSE {c} END" for a, b, c in ((1, 3, 8), (2, 5, 12)))
_score("fn10_counts_adherence", "inference_task IN ('B', 'G')", {"sentences": lambda: F.round(C.count_adherence(C.n_sentences(col("answer")), C.n_sentences(col("model_answer"))), 6), "paragraphs": lambda: F.round(C.paragraph_adherence(F.size(F.filter(F.split("answer", r"\n[ \t]*\n+"), lambda x: F.regexp_replace(x, f"{SPACE}+", "") != "")), col("target")), 6)}, {"sentences": f"round(CAST(greatest(0.0, 1.0 - abs({_sent('answer')} - {_sent('model_answer')}) / greatest(1, {_sent('model_answer')})) AS DOUBLE), 6)", "paragraphs": f"round(CAST(greatest(0.0, 1.0 - (CASE WHEN {_PARA} < {_LO} THEN {_LO} - {_PARA} WHEN {_PARA} > {_HI} THEN {_PARA} - {_HI} ELSE 0 END) / ({_HI})) AS DOUBLE), 6)"})
_R = f"({_nt('raw')} / CAST(greatest(1, {_nt('input_text')}) AS DOUBLE))"
_score("fn11_compression", "inference_task = 'E'", {"score": lambda: F.round(C.compression(C.n_tokens(col("raw")) / F.greatest(F.lit(1), C.n_tokens(col("input_text")))), 6)}, {"score": f"round(CAST(CASE WHEN {_R} < CAST(0.2 AS DOUBLE) THEN greatest(0.0, {_R} / CAST(0.2 AS DOUBLE)) WHEN {_R} <= CAST(0.5 AS DOUBLE) THEN 1.0 ELSE greatest(0.0, 1.0 - ({_R} - CAST(0.5 AS DOUBLE)) / CAST(0.5 AS DOUBLE)) END AS DOUBLE), 6)"})
# RE2 has no look-around: what is no word character is doubled, so that neighbouring
# markers both match.
_OFF = "[^\\p{L}\\p{N}_]"


def _twice(c: str) -> str:
    return f"regexp_replace(lower({c}), '({_OFF})', '\\1\\1', 'g')"


def _marks(words: tuple[str, ...]) -> str:
    one = lambda w: re.sub(r"[^\w]", lambda m: re.escape(m[0]) * 2, w) + (f"(?:{_OFF}|$)" if w[-1].isalnum() else C.WORD)
    return f"(?:^|{_OFF})(?:{'|'.join(map(one, words))})"


def _count(c: str, words: tuple[str, ...]) -> str:
    return f"len(regexp_extract_all({_twice(c)}, '{_marks(words)}'))"


_MARK = _count("explanation", C.MARKERS)
_ABSTAIN = "CAST(regexp_matches(lower({0}), '" + f"(?:^|{_OFF})(?:{'|'.join(C.ABSTAINS_EN)})(?:{_OFF}|$)|{'|'.join(C.ABSTAINS_HI)}".replace("'", "''").replace("\\s", _S) + "') AS INT)"
_score("fn13_marker_density", "inference_task IN ('A', 'F')", {"density": lambda: F.round(C.markers_per_100(col("explanation")), 6)}, {"density": f"round(CAST(100.0 * {_MARK} / greatest(1, {_nt('explanation')}) AS DOUBLE), 6)"})
_OWN = "len(regexp_extract_all(answer, '[\\x{0904}-\\x{0939}\\x{093D}\\x{0950}\\x{0958}-\\x{0961}\\x{0971}-\\x{097F}]'))"
_score("fn14_code_mixing", "language = 'hi'", {"share": lambda: F.round(C.foreign_share(col("answer")), 6)}, {"share": f"round(CAST(CASE WHEN len(regexp_extract_all(answer, '\\p{{L}}')) = 0 THEN 0.0 ELSE 1.0 - {_OWN} / len(regexp_extract_all(answer, '\\p{{L}}')) END AS DOUBLE), 6)"})
_score("fn15_abstains", "TRUE", {"abstains": lambda: C.abstains(col("raw")).cast("int")}, {"abstains": _ABSTAIN.replace("{0}", "raw")})
_score("fn19_tokens_per_second", "TRUE", {"tps": lambda: F.round(F.when(col("latency_ms") > 0, col("output_tokens") / (col("latency_ms") / 1000.0)), 6)}, {"tps": "round(CASE WHEN latency_ms > 0 THEN output_tokens / (latency_ms / CAST(1000.0 AS DOUBLE)) END, 6)"})
_score("fn25_lead_words", "inference_task = 'E'", {"sha": lambda: F.sha2(C.lead(col("raw"), 100), 256)}, {"sha": f"sha256(array_to_string(list_slice({_WORDS.replace('{0}', 'raw')}, 1, 100), ' '))"})
_score("fn26_last_integer", "TRUE", {"n": lambda: C.last_integer(col("raw"))}, {"n": "least(100, CAST(regexp_extract_all(raw, '(?:^|[^0-9A-Za-z_])([0-9]{1,3})\\b', 1)[-1] AS INT))"})
_score("fn27_first_letter", "inference_task IN ('A', 'F')", {"letter": lambda: C.first_letter(col("raw"))}, {"letter": "nullif(regexp_extract(upper(raw), '(^|[^A-Za-z0-9_])([ABCD])([^A-Za-z0-9_]|$)', 2), '')"})
_DIR = f"CASE WHEN regexp_matches({_twice('question')}, '{_marks(C.HIGH_VERBS)}') THEN 'high' WHEN regexp_matches({_twice('question')}, '{_marks(C.LOW_VERBS)}') THEN 'low' ELSE 'unknown' END"
_score("fn32_directive", "inference_task IN ('B', 'G', 'C')", {"depth": lambda: C.directive(col("question"))}, {"depth": _DIR})
_GOOD = "CASE WHEN json_valid({0}) AND {0} LIKE '{{%' THEN {0} END"


def _good(c: str) -> str:
    return _GOOD.replace("{{", "{").replace("{0}", c)


_REC = f"coalesce({_good('trim(raw)')}, {_good(chr(39).join(['regexp_extract(raw, ', '(?s)```(?:json)?[ \\t\\n]*(\\{.*\\})[ \\t\\n]*```', ', 1)']))}, {_good(chr(39).join(['regexp_extract(raw, ', '(?s)(\\{.*\\})', ', 1)']))})"
_score("fn28_recovered_json", "TRUE", {"sha": lambda: F.sha2(C.recovered_json(col("raw")), 256)}, {"sha": f"sha256({_REC})"})
_LET = "upper(substr(trim(answer), 1, 1))"
_score("sc01_multiple_choice", "inference_task = 'A'", {"letter": lambda: F.upper(F.substring(F.trim("answer"), 1, 1)), "is_correct": lambda: ((F.upper(F.substring(F.trim("answer"), 1, 1)) == F.upper("correct")) & F.upper(F.substring(F.trim("answer"), 1, 1)).isin("A", "B", "C", "D")).cast("int"), "format_fail": lambda: (~F.upper(F.substring(F.trim("answer"), 1, 1)).isin("A", "B", "C", "D")).cast("int"), "abstains": lambda: C.abstains(col("raw")).cast("int"), "density": lambda: F.round(C.markers_per_100(col("explanation")), 6), "n_sentences": lambda: C.n_sentences(col("explanation"))}, {"letter": _LET, "is_correct": f"CAST({_LET} = upper(correct) AND {_LET} IN ('A', 'B', 'C', 'D') AS INT)", "format_fail": f"CAST({_LET} NOT IN ('A', 'B', 'C', 'D') AS INT)", "abstains": _ABSTAIN.replace("{0}", "raw"), "density": f"round(CAST(100.0 * {_MARK} / greatest(1, {_nt('explanation')}) AS DOUBLE), 6)", "n_sentences": _sent("explanation")})
_score("sc02_long_answer", "inference_task = 'B'", {"schema_valid": lambda: (col("answer") != "").cast("int"), "length": lambda: F.round(C.length_adherence(C.n_tokens(col("answer")), col("target")), 6), "years_f1": lambda: F.round(C.set_f1(C.years(col("answer")), C.years(col("model_answer")), 1.0), 6), "numbers_f1": lambda: F.round(C.set_f1(C.numbers(col("answer")), C.numbers(col("model_answer")), 1.0), 6), "n_words": lambda: C.n_tokens(col("answer"))}, {"schema_valid": "CAST(answer <> '' AS INT)", "length": f"round(CAST({_adh(_nt('answer'), 'target')} AS DOUBLE), 6)", "years_f1": f"round(CAST({_f1(_YEARS.replace('{0}', 'answer'), _YEARS.replace('{0}', 'model_answer'), '1.0')} AS DOUBLE), 6)", "numbers_f1": f"round(CAST({_f1(_NUMS.replace('{0}', 'answer'), _NUMS.replace('{0}', 'model_answer'), '1.0')} AS DOUBLE), 6)", "n_words": f"CAST({_nt('answer')} AS INT)"})
_PS, _GS, _MS = (f"TRY_CAST(json_extract_string({c}, '$.{f}') AS DOUBLE)" for c, f in (("prediction", "score"), ("gold_payload", "score"), ("gold_payload", "max_score")))


def _num(c: str, f: str):
    return F.get_json_object(c, f"$.{f}").cast("double")


def _bands(s: str, m: str) -> str:
    return f"CASE WHEN {s} / {m} <= CAST(0.30 AS DOUBLE) THEN 'low' WHEN {s} / {m} <= CAST(0.60 AS DOUBLE) THEN 'mid' ELSE 'high' END"


_score("sc03_graded", f"inference_task = 'C'", {"pred_score": lambda: _num("prediction", "score"), "gold_score": lambda: _num("gold_payload", "score"), "gap": lambda: F.round(F.abs(_num("prediction", "score") - _num("gold_payload", "score")), 6), "gold_band": lambda: C.band(_num("gold_payload", "score"), _num("gold_payload", "max_score"))}, {"pred_score": _PS, "gold_score": _GS, "gap": f"round(abs({_PS} - {_GS}), 6)", "gold_band": _bands(_GS, _MS)})
_PI, _MI, _SRC = _j("prediction", "prelims_info"), _j("prediction", "mains_info"), _j("gold_payload", "source_text")
_RT = f"({_nt(_PI + ' || ' + chr(39) + ' ' + chr(39) + ' || ' + _MI)} / CAST(greatest(1, {_nt(_SRC)}) AS DOUBLE))"


def _notes():
    return F.concat_ws(" ", *[F.coalesce(F.get_json_object("prediction", f"$.{f}"), F.lit("")) for f in ("prelims_info", "mains_info")])


def _source_words():
    return C.n_tokens(F.coalesce(F.get_json_object("gold_payload", "$.source_text"), F.lit("")))


_score("sc04_condensed", "inference_task = 'E'", {"n_words": lambda: C.n_tokens(_notes()), "compression": lambda: F.round(C.compression(C.n_tokens(_notes()) / F.greatest(F.lit(1), _source_words())), 6)}, {"n_words": f"CAST({_nt(_PI + ' || ' + chr(39) + ' ' + chr(39) + ' || ' + _MI)} AS INT)", "compression": f"round(CAST(CASE WHEN {_RT} < CAST(0.2 AS DOUBLE) THEN greatest(0.0, {_RT} / CAST(0.2 AS DOUBLE)) WHEN {_RT} <= CAST(0.5 AS DOUBLE) THEN 1.0 ELSE greatest(0.0, 1.0 - ({_RT} - CAST(0.5 AS DOUBLE)) / CAST(0.5 AS DOUBLE)) END AS DOUBLE), 6)"})
register("fn34_overlap_scores", lambda s, d: _answers(s, d).filter("inference_task IN ('B', 'G')").select(*_KEY, C.rouge_l("answer", "model_answer").alias("rouge_l"), C.chrf("answer", "model_answer").alias("chrf")).distinct())
register("fn30_flat_payload", lambda s, d: table(s, d, "eval_set", "question_id", "gold_payload").select("question_id", F.length(C.flat_json("gold_payload")).alias("n_chars")))
register("fn37_schedule", lambda s, d: s.range(1000).select(F.col("id").alias("step"), F.round(C.schedule(F.col("id"), 1000), 6).alias("factor")), "SELECT id AS step, round(CASE WHEN id < 10 THEN (id + 1) / 10.0 WHEN id < 810 THEN 1.0 ELSE CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * 0.5 * (1 + cos(pi() * least(1.0, (id - 810) / 190.0))) END, 6) AS factor FROM range(1000) t(id)")


def _options(s, d):
    raw = F.get_json_object("gold_payload", "$.options")
    as_list = F.from_json(raw, "array<struct<id:string,text:string>>")
    as_map = F.from_json(raw, "map<string,string>")
    pairs = F.when(raw.startswith("["), F.transform(as_list, lambda o: F.struct(F.upper(o["id"]).alias("k"), o["text"].alias("v")))).otherwise(F.transform(F.map_entries(as_map), lambda e: F.struct(F.upper(e["key"]).alias("k"), e["value"].alias("v"))))
    x = table(s, d, "eval_set", "question_id", "task", "gold_payload").filter("task = 'A'").select("question_id", F.explode(pairs).alias("o"))
    return x.select("question_id", F.col("o.k").alias("letter"), F.col("o.v").alias("option"))


register("tx21_options", _options, "SELECT question_id, upper(json_extract_string(o, '$.id')) AS letter, json_extract_string(o, '$.text') AS option FROM (SELECT question_id, unnest(CAST(json_extract(gold_payload, '$.options') AS JSON[])) AS o FROM eval_set WHERE task = 'A' AND json_type(gold_payload, '$.options') = 'ARRAY') UNION ALL SELECT question_id, upper(k) AS letter, json_extract_string(gold_payload, '$.options.\"' || k || '\"') AS option FROM (SELECT question_id, gold_payload, unnest(json_keys(gold_payload, '$.options')) AS k FROM eval_set WHERE task = 'A' AND json_type(gold_payload, '$.options') = 'OBJECT')")


def _strict(s, d):
    o = F.from_json("options", "map<string,string>")
    h = table(s, d, "holdout", "question_id", "question", "options", "correct_option_letter").withColumn("o", F.transform_keys(o, lambda k, v: F.upper(k)))
    keys = F.array_sort(F.map_keys("o")) == F.array(*[F.lit(x) for x in "ABCD"])
    full = F.forall(F.map_values("o"), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
    return h.filter(keys & full & F.upper("correct_option_letter").isin(*"ABCD") & (F.trim("question") != "")).select("question_id", F.upper("correct_option_letter").alias("letter"))


register("fl11_valid_questions", _strict, "SELECT question_id, upper(correct_option_letter) AS letter FROM holdout WHERE list_sort(list_transform(json_keys(options), lambda k: upper(k))) = ['A', 'B', 'C', 'D'] AND len(list_filter(json_keys(options), lambda k: trim(coalesce(json_extract_string(options, '$.\"' || k || '\"'), '')) = '')) = 0 AND upper(correct_option_letter) IN ('A', 'B', 'C', 'D') AND trim(question) <> ''")
