"""Queries over the corpus: duplicates, leakage, sets, samples, mixes, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekha.functions import text as T
from lekha.operators import dedup, leakage, ordered, sampling
from lekha.plans.registry import register
from lekha.plans.text import _STRIP, _TOKENS, S
from lekha.session import broadcast_if_small
from lekha.sources import table

#: Sources in the order in which copies are kept.
PRIORITY = ("school_texts", "ref_books", "econ_review", "reform_panel", "policy_cell", "climate_digest", "budget_papers", "bank_bulletin", "census_notes", "qa_bank", "space_desk", "defence_lab", "bill_watch")
_PRIO = "coalesce(list_position([" + ", ".join(f"'{x}'" for x in PRIORITY) + "], source), 14)"


def _prio():
    at = F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), F.coalesce("source", F.lit("")))
    return F.when(at > 0, at).otherwise(F.lit(len(PRIORITY) + 1)).cast("bigint")


def _paras(spark, d):
    docs = table(spark, d, "documents", "doc_id", "source", "dst_path", "text").filter("text IS NOT NULL").withColumn("prio", _prio())
    x = docs.select("doc_id", "prio", "dst_path", F.posexplode(F.split("text", "\n")).alias("para_no", "t")).withColumn("t", T.strip_ends(F.col("t"))).filter("t <> ''")
    return x.withColumn("h", F.sha2(T.one_line(F.col("t")), 256))


_P = f"(SELECT doc_id, prio, dst_path, para_no, t, sha256(lower(trim(regexp_replace(t, '{S}+', ' ', 'g')))) AS h FROM (SELECT doc_id, prio, dst_path, CAST(para_no AS INT) AS para_no, {_STRIP.replace('{0}', 't')} AS t FROM (SELECT doc_id, {_PRIO} AS prio, dst_path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_no FROM documents WHERE text IS NOT NULL)) WHERE t <> '')"

register("or02_source_priority", lambda s, d: table(s, d, "documents", "doc_id", "source").select("doc_id", _prio().alias("prio")), f"SELECT doc_id, CAST({_PRIO} AS BIGINT) AS prio FROM documents")
register("dd01_paragraph_dedup", lambda s, d: dedup.keep_first(_paras(s, d).drop("t"), ["h"], ["prio", "dst_path", "para_no"]).select("doc_id", "para_no"), f"SELECT doc_id, para_no FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY prio, dst_path, para_no) AS k FROM {_P}) WHERE k = 1")
register("wi01_rejoined", lambda s, d: dedup.keep_first(_paras(s, d), ["h"], ["prio", "dst_path", "para_no"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("para_no", "t"))).alias("p")).select("doc_id", F.size("p").alias("paras"), F.sha2(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), 256).alias("sha")), f"SELECT doc_id, CAST(count(*) AS INT) AS paras, sha256(string_agg(t, chr(10) || chr(10) ORDER BY para_no)) AS sha FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY prio, dst_path, para_no) AS k FROM {_P}) WHERE k = 1 GROUP BY doc_id")
register("ag10_dedup_counters", lambda s, d: _paras(s, d).groupBy("prio").agg(F.count(F.lit(1)).alias("paras_in"), F.countDistinct("h").alias("different"), F.countDistinct("doc_id").alias("docs")), f"SELECT CAST(prio AS BIGINT) AS prio, count(*) AS paras_in, count(DISTINCT h) AS different, count(DISTINCT doc_id) AS docs FROM {_P} GROUP BY prio")

_TEXT_H = f"sha256(lower(trim(regexp_replace(text, '{S}+', ' ', 'g'))))"


def _whole(s, d):
    x = table(s, d, "documents", "doc_id", "source", "dst_path", "text").filter("text IS NOT NULL").withColumn("prio", _prio())
    return x.select("doc_id", "prio", "dst_path", F.sha2(T.one_line(F.col("text")), 256).alias("h"))


register("dd02_record_dedup", lambda s, d: dedup.keep_first(_whole(s, d), ["h"], ["prio", "dst_path"]).select("doc_id"), f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_TEXT_H} ORDER BY {_PRIO}, dst_path) AS k FROM documents WHERE text IS NOT NULL) WHERE k = 1")
_SH = f"(SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(list_slice(t, i, i + 4), ' ')))) AS s FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) >= 5)"
register("dd03_near_pairs", lambda s, d: dedup.NearDuplicates(table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL")).pairs().select("doc_a", "doc_b", F.round("jaccard", 6).alias("jaccard")), f"WITH c AS (SELECT min(doc_id) AS doc_id, s FROM {_SH} GROUP BY s), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM c), p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL) SELECT doc_a, doc_b, round(k / (na + nb - k), 6) AS jaccard FROM p WHERE k / (na + nb - k) >= 0.8 - 1e-12")
register("dd03_near_docs", lambda s, d: dedup.near_duplicates(table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL")))

_PK = ["run_id", "condition", "question_id", "inference_task"]
register("dd04_keep_last", lambda s, d: dedup.keep_last(table(s, d, "predictions", *_PK, "created_at", "raw_output").withColumn("at", F.try_to_timestamp("created_at")).select(*_PK, "at", F.sha2(F.coalesce("raw_output", F.lit("")), 256).alias("sha")), _PK, ["at", "sha"]).select(*_PK, "sha"), "SELECT run_id, condition, question_id, inference_task, sha FROM (SELECT *, row_number() OVER (PARTITION BY run_id, condition, question_id, inference_task ORDER BY CAST(created_at AS TIMESTAMPTZ) DESC, sha DESC) AS k FROM (SELECT *, sha256(coalesce(raw_output, '')) AS sha FROM predictions)) WHERE k = 1")
register("dd05_duplicated", lambda s, d: dedup.duplicated(table(s, d, "predictions", *_PK), _PK), "SELECT run_id, condition, question_id, inference_task, count(*) AS n FROM predictions GROUP BY ALL HAVING count(*) > 1")
register("dd06_first_seen", lambda s, d: dedup.keep_first(table(s, d, "file_results", "file_id", "pdf"), ["pdf"], ["file_id"]), "SELECT min(file_id) AS file_id, pdf FROM file_results GROUP BY pdf")
register("dd07_not_in_log", lambda s, d: table(s, d, "documents", "doc_id", "dst_path").join(table(s, d, "clean_results", "dst_path", "cleaned_at").filter("dst_path IS NOT NULL AND cleaned_at < timestamp'2025-01-01'").select("dst_path").distinct(), "dst_path", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM clean_results c WHERE c.dst_path = documents.dst_path AND c.cleaned_at < TIMESTAMPTZ '2025-01-01 00:00:00+00')")
register("wi02_last_clean", lambda s, d: dedup.keep_last(table(s, d, "clean_results", "src_path", "cleaned_at", "out_chars", "dropped"), ["src_path"], ["cleaned_at", "out_chars", "dropped"]).select("src_path", "out_chars", "dropped"), "SELECT src_path, out_chars, dropped FROM (SELECT *, row_number() OVER (PARTITION BY src_path ORDER BY cleaned_at DESC NULLS LAST, out_chars DESC NULLS LAST, dropped DESC NULLS LAST) AS k FROM clean_results) WHERE k = 1")

# Leakage.
_FIELDS = "list_filter([" + ", ".join(f"json_extract_string(gold_payload, '$.{f}')" for f in leakage.FIELDS) + f"], lambda x: x IS NOT NULL AND regexp_replace(x, '{S}+', '', 'g') <> '')"
_EV = f"(SELECT DISTINCT question_id AS qid, unnest({_FIELDS}) AS text FROM eval_set)"


def _grams_sql(key: str, src: str, n: int) -> str:
    return f"(SELECT DISTINCT {key}, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(list_slice(t, i, i + {n} - 1), ' '))) AS g FROM (SELECT {key}, {_TOKENS} AS t FROM {src}) WHERE len(t) >= {n})"


def _eval_index(s, d):
    return leakage.EvalIndex(table(s, d, "eval_set", "question_id", "gold_payload"))


register("tx24_eval_fields", lambda s, d: _eval_index(s, d).texts.select("qid", F.sha2("text", 256).alias("sha")), f"SELECT qid, sha256(text) AS sha FROM {_EV}")
for _n in leakage.WIDTHS:
    register("jn10_ngram_hits" if _n == 25 else f"jn10_ngram_hits_{_n}", lambda s, d, n=_n: _eval_index(s, d).gram_hits(table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL"), "doc_id", n=n), f"SELECT DISTINCT qid, doc_id FROM {_grams_sql('doc_id', '(SELECT * FROM documents WHERE text IS NOT NULL)', _n)} JOIN {_grams_sql('qid', _EV, _n)} USING (g)")
register("ag09_gram_sets", lambda s, d: _eval_index(s, d).grams(8).groupBy("g").agg(F.sort_array(F.collect_set("qid")).alias("q")).filter("size(q) > 1").select(F.array_join("q", ",").alias("qids")).groupBy("qids").agg(F.count(F.lit(1)).alias("n_grams")), f"SELECT qids, count(*) AS n_grams FROM (SELECT string_agg(DISTINCT qid, ',' ORDER BY qid) AS qids FROM {_grams_sql('qid', _EV, 8)} GROUP BY g HAVING count(DISTINCT qid) > 1) GROUP BY qids")
_HASH = f"substr(sha256(lower(trim(regexp_replace(text, '{S}+', ' ', 'g')))), 1, 16)"
_NWORDS = f"len(list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> ''))"
_FT_Q = "coalesce(json_extract_string(input, '$.question'), json_extract_string(input, '$.question_text'), json_extract_string(input, '$.article'))"


def _ft_text(s, d):
    q = F.coalesce(*[F.get_json_object("input", f"$.{c}") for c in ("question", "question_text", "article")])
    return table(s, d, "ft_corpus", "pair_id", "task", "input").distinct().select("pair_id", "task", q.alias("text")).filter("text IS NOT NULL")


_FT = f"(SELECT DISTINCT pair_id, task, {_FT_Q} AS text FROM ft_corpus WHERE {_FT_Q} IS NOT NULL)"
register("jn09_hash_hits", lambda s, d: _eval_index(s, d).hash_hits(_ft_text(s, d)).select("qid", "pair_id").distinct(), f"SELECT DISTINCT qid, pair_id FROM (SELECT pair_id, {_HASH} AS h FROM {_FT}) JOIN (SELECT qid, {_HASH} AS h FROM {_EV} WHERE {_NWORDS} >= 8) USING (h)")
register("jn11_purged", lambda s, d: _eval_index(s, d).purge(_ft_text(s, d), ["pair_id"]).groupBy("task").agg(F.count(F.lit(1)).alias("n")), f"SELECT task, count(*) AS n FROM {_FT} f WHERE pair_id NOT IN (SELECT pair_id FROM {_grams_sql('pair_id', _FT, 25)} JOIN {_grams_sql('qid', _EV, 25)} USING (g)) AND pair_id NOT IN (SELECT pair_id FROM (SELECT pair_id, {_HASH} AS h FROM {_FT}) JOIN (SELECT qid, {_HASH} AS h FROM {_EV} WHERE {_NWORDS} >= 8) USING (h)) GROUP BY task")


def _base(c: str):
    return F.lower(F.trim(F.try_element_at(F.split(c, ":"), F.lit(2))))


_B = "lower(trim(string_split({0}, ':')[2]))"
register("jn03_not_in_eval", lambda s, d: table(s, d, "ft_corpus", "pair_id").distinct().join(table(s, d, "eval_set", F.col("question_id").alias("pair_id")), "pair_id", "left_anti"), "SELECT DISTINCT pair_id FROM ft_corpus WHERE pair_id NOT IN (SELECT question_id FROM eval_set WHERE question_id IS NOT NULL)")
register("jn04_not_same_text", lambda s, d: _ft_text(s, d).withColumn("h", T.digest(T.one_line(F.col("text"), lower=False))).join(table(s, d, "eval_set", "gold_payload").select(T.digest(T.one_line(F.get_json_object("gold_payload", "$.question"), lower=False)).alias("h")).filter("h IS NOT NULL").distinct(), "h", "left_anti").groupBy("task").agg(F.count(F.lit(1)).alias("n")), f"SELECT task, count(*) AS n FROM (SELECT task, substr(sha256(trim(regexp_replace(text, '{S}+', ' ', 'g'))), 1, 16) AS h FROM {_FT}) WHERE h NOT IN (SELECT substr(sha256(trim(regexp_replace(q, '{S}+', ' ', 'g'))), 1, 16) FROM (SELECT json_extract_string(gold_payload, '$.question') AS q FROM eval_set) WHERE q IS NOT NULL) GROUP BY task")
register("jn05_no_sibling", lambda s, d: table(s, d, "ft_corpus", "pair_id").distinct().withColumn("b", _base("pair_id")).join(table(s, d, "eval_set", "question_id").select(_base("question_id").alias("b")).filter("b IS NOT NULL").distinct(), "b", "left_anti").select("pair_id"), f"SELECT DISTINCT pair_id FROM ft_corpus WHERE {_B.replace('{0}', 'pair_id')} NOT IN (SELECT {_B.replace('{0}', 'question_id')} FROM eval_set WHERE contains(question_id, ':'))")
register("jn06_not_in_either", lambda s, d: table(s, d, "holdout", "question_id").join(table(s, d, "eval_set", "question_id").unionByName(table(s, d, "ft_corpus", F.col("pair_id").alias("question_id"))).distinct(), "question_id", "left_anti"), "SELECT question_id FROM holdout WHERE question_id NOT IN (SELECT question_id FROM eval_set UNION SELECT pair_id FROM ft_corpus)")
register("jn08_leaked_ids", lambda s, d: table(s, d, "eval_set", "question_id").join(table(s, d, "ft_corpus", F.col("pair_id").alias("question_id")), "question_id", "left_semi").distinct(), "SELECT DISTINCT question_id FROM eval_set WHERE question_id IN (SELECT pair_id FROM ft_corpus)")
register("se01_id_intersection", lambda s, d: table(s, d, "eval_set", "question_id").intersect(table(s, d, "predictions", "question_id")), "SELECT question_id FROM eval_set INTERSECT SELECT question_id FROM predictions")
register("se02_hash_intersection", lambda s, d: _ft_text(s, d).select(T.digest(T.one_line(F.col("text"))).alias("h")).intersect(table(s, d, "predictions", "input_text").select(T.digest(T.one_line(F.coalesce(*[F.get_json_object("input_text", f"$.{c}") for c in ("question", "question_text", "article")]))).alias("h")).filter("h IS NOT NULL")), f"SELECT {_HASH} AS h FROM {_FT} INTERSECT SELECT {_HASH} AS h FROM (SELECT {_FT_Q.replace('input', 'input_text')} AS text FROM predictions) WHERE text IS NOT NULL")
register("se03_id_union", lambda s, d: table(s, d, "eval_set", "question_id").union(table(s, d, "holdout", "question_id")).distinct(), "SELECT question_id FROM eval_set UNION SELECT question_id FROM holdout")


def _mix_names(s, d):
    have = table(s, d, "documents", "source").filter("source IS NOT NULL").distinct()
    mix = table(s, d, "source_mix", "source", "optional").filter("source IS NOT NULL")
    extra = have.join(mix, "source", "left_anti").select("source", F.lit("not in mix").alias("status"))
    missing = mix.join(have, "source", "left_anti").select("source", F.when(F.coalesce("optional", F.lit(False)), "optional").otherwise("missing").alias("status"))
    return extra.unionByName(missing)


register("se04_mix_against_corpus", _mix_names, "SELECT DISTINCT source, 'not in mix' AS status FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM source_mix WHERE source IS NOT NULL) UNION ALL SELECT source, CASE WHEN coalesce(optional, false) THEN 'optional' ELSE 'missing' END AS status FROM source_mix WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
register("se05_union_by_name", lambda s, d: table(s, d, "eval_set", "question_id", "task").unionByName(table(s, d, "holdout", "question_id", "correct_option_letter"), allowMissingColumns=True).groupBy("task", "correct_option_letter").agg(F.count(F.lit(1)).alias("n")), "SELECT task, correct_option_letter, count(*) AS n FROM (SELECT question_id, task, NULL AS correct_option_letter FROM eval_set UNION ALL SELECT question_id, NULL, correct_option_letter FROM holdout) GROUP BY ALL")
register("se06_replace_by_key", lambda s, d: table(s, d, "pack_stats", "run_id", "model", "source", "docs_tokenized").filter("model <> 'model_g'").unionByName(table(s, d, "pack_stats", "run_id", "model", "source", "docs_tokenized").filter("model = 'model_g' AND run_id >= 'build-005'")).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("docs_tokenized").alias("docs")), "SELECT model, count(*) AS n, CAST(sum(docs_tokenized) AS BIGINT) AS docs FROM pack_stats WHERE model <> 'model_g' OR (model = 'model_g' AND run_id >= 'build-005') GROUP BY model")

# Samples.
_O = "sha256('7:' || CAST({0} AS VARCHAR))"
register("or01_sorted", lambda s, d: table(s, d, "eval_set", "task", "question_id").orderBy("task", "question_id"), "SELECT task, question_id FROM eval_set ORDER BY task, question_id")
register("or03_top_per_task", lambda s, d: sampling.first_per_group(table(s, d, "eval_set", "task", "question_id"), ["task"], "question_id", 5), "SELECT task, question_id FROM (SELECT task, question_id, row_number() OVER (PARTITION BY task ORDER BY question_id) AS k FROM eval_set) WHERE k <= 5")
register("or04_uniform_sample", lambda s, d: sampling.uniform(table(s, d, "documents", "doc_id"), "doc_id", 100, 7), f"SELECT doc_id FROM documents ORDER BY {_O.replace('{0}', 'doc_id')}, doc_id LIMIT 100")
register("or05_stratified_sample", lambda s, d: sampling.stratified(table(s, d, "eval_set", "question_id", "task", "language").filter("question_id IS NOT NULL"), ["task", "language"], "question_id", 50, 7).select("question_id", "stratum_key"), f"SELECT question_id, stratum_key FROM (SELECT question_id, stratum_key, o, row_number() OVER (PARTITION BY stratum_key ORDER BY o, question_id) AS k, (SELECT greatest(1, 50 // count(DISTINCT coalesce(task, '') || '|' || coalesce(language, ''))) FROM eval_set) AS per FROM (SELECT question_id, coalesce(task, '') || '|' || coalesce(language, '') AS stratum_key, {_O.replace('{0}', 'question_id')} AS o FROM eval_set)) ORDER BY k > per, o, question_id LIMIT 50")
register("or06_train_valid_split", lambda s, d: sampling.split(table(s, d, "ft_corpus", "pair_id", "task").distinct(), "task", "pair_id", 0.05, 7).select("pair_id", "task", "part"), f"SELECT pair_id, task, CASE WHEN row_number() OVER (PARTITION BY task ORDER BY {_O.replace('{0}', 'pair_id')}, pair_id) <= greatest(1, floor(count(*) OVER (PARTITION BY task) * CAST(0.05 AS DOUBLE))) THEN 'valid' ELSE 'train' END AS part FROM (SELECT DISTINCT pair_id, task FROM ft_corpus)")
register("or07_shuffled", lambda s, d: table(s, d, "documents", "doc_id").withColumn("o", sampling.order(7, F.col("doc_id"))).orderBy("o", "doc_id").select("doc_id", "o"), f"SELECT doc_id, {_O.replace('{0}', 'doc_id')} AS o FROM documents ORDER BY o, doc_id")
_U = "CAST('0x' || substr(sha256({0}), 1, 8) AS BIGINT) / 4294967295.0"
register("or09_fraction", lambda s, d: sampling.fraction(table(s, d, "documents", "doc_id", "dst_path"), F.concat("dst_path", F.lit("#0")), 0.3).select("doc_id"), f"SELECT doc_id FROM documents WHERE {_U.replace('{0}', chr(100) + 'st_path || ' + chr(39) + '#0' + chr(39))} < 0.3")


def _repeated(s, d):
    mix = table(s, d, "source_mix", "source", "repeat")
    return sampling.repeat(table(s, d, "documents", "doc_id", "source").join(broadcast_if_small(mix), "source"), "doc_id", "repeat").select("doc_id", "rep_no")


register("or10_repeats", _repeated, "SELECT doc_id, CAST(rep_no AS INT) AS rep_no FROM (SELECT doc_id, unnest(range(CAST(floor(t) AS BIGINT) + CASE WHEN CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || '#' || CAST(CAST(floor(t) AS INT) AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 < t - floor(t) THEN 1 ELSE 0 END)) AS rep_no FROM (SELECT doc_id, CASE WHEN isnan(coalesce(repeat, 1)) THEN NULL ELSE coalesce(repeat, 1) END AS t FROM documents JOIN source_mix USING (source)))")
register("or11_exemplars", lambda s, d: sampling.first_per_group(table(s, d, "ft_corpus", "task", "pair_id").distinct(), ["task"], "pair_id", 3).groupBy("task").agg(F.concat_ws(",", F.sort_array(F.collect_list("pair_id"))).alias("pair_ids")), "SELECT task, string_agg(pair_id, ',' ORDER BY pair_id) AS pair_ids FROM (SELECT task, pair_id, row_number() OVER (PARTITION BY task ORDER BY pair_id) AS k FROM (SELECT DISTINCT task, pair_id FROM ft_corpus)) WHERE k <= 3 GROUP BY task")

# Budgets and packing.
_N = f"CAST(len({_TOKENS}) AS BIGINT)"


def _capped(s, d):
    docs = table(s, d, "documents", "doc_id", "source", "text").filter("text IS NOT NULL AND source IS NOT NULL")
    docs = docs.select("doc_id", "source", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n"), sampling.order(7, F.col("doc_id")).alias("o"), F.lit(5000).cast("bigint").alias("cap"))
    return ordered.within_budget(docs, "source", ["o", "doc_id"], "n", "cap").select("doc_id", "source", "n")


register("wi03_budget_cap", _capped, f"SELECT doc_id, source, n FROM (SELECT doc_id, source, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT doc_id, source, {_N} AS n, {_O.replace('{0}', 'doc_id')} AS o FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)) WHERE b < 5000")
register("wi05_byte_offsets", lambda s, d: ordered.running_sum(table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.octet_length("text").cast("bigint").alias("length")), ["doc_id"], "length", "offset").select("doc_id", "length", "offset"), "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS length, CAST(coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM documents WHERE text IS NOT NULL")
register("wi06_stream_budget", lambda s, d: ordered.running_sum(table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("n")), ["doc_id"], "n", "b").filter("b < 50000").select("doc_id", "n"), f"SELECT doc_id, n FROM (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT doc_id, {_N} AS n FROM documents WHERE text IS NOT NULL)) WHERE b < 50000")


#: SQL of text.token_ids, for a list t of words.
_IDS = "list_transform(t, lambda x: CAST(CAST('0x' || substr(md5(x), 1, 7) AS BIGINT) % 49998 + 2 AS INT))"


def _packed(s, d):
    docs = table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", T.token_ids(T.tokens(F.col("text"))).alias("ids"))
    rows = ordered.pack_stream(docs, ["doc_id"], "ids", 512, eos=0, bos=1)
    return rows.select(F.col("seq_no").cast("bigint").alias("seq_no"), F.sha2(F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ","), 256).alias("sha"))


register("wi07_packed", _packed, f"SELECT seq_no, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos)) AS sha FROM (SELECT id, pos, pos // 512 AS seq_no FROM (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS pos FROM (SELECT doc_id, unnest(f) AS id, generate_subscripts(f, 1) AS k FROM (SELECT doc_id, list_concat(list_concat([1], {_IDS}), [0]) AS f FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) > 0)))) GROUP BY seq_no HAVING count(*) = 512")
register("ag11_share", lambda s, d: table(s, d, "documents", "source", "n_chars").agg(F.round(F.sum(F.when(F.col("source").isin("press_wire", "web_crawl"), F.col("n_chars")).otherwise(0)) / F.sum("n_chars"), 6).alias("share")), "SELECT round(sum(CASE WHEN source IN ('press_wire', 'web_crawl') THEN n_chars ELSE 0 END) / sum(n_chars), 6) AS share FROM documents")
register("ag13_log_summary", lambda s, d: table(s, d, "file_results", "source", "in_bytes").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum("in_bytes").alias("bytes")), "SELECT source, count(*) AS items, CAST(sum(in_bytes) AS BIGINT) AS bytes FROM file_results GROUP BY source")
register("ag17_status", lambda s, d: table(s, d, "clean_results", "dropped", "drop_reason", "in_chars").groupBy("dropped", F.regexp_extract(F.coalesce("drop_reason", F.lit("")), "^[a-z]+", 0).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("in_chars").alias("chars")), "SELECT dropped, regexp_extract(coalesce(drop_reason, ''), '^[a-z]+') AS reason, count(*) AS n, CAST(sum(in_chars) AS BIGINT) AS chars FROM clean_results GROUP BY ALL")
register("ag14_hit_report", lambda s, d: table(s, d, "leakage_reports", "ngram_hits").filter("ngram_hits IS NOT NULL").select(F.explode("ngram_hits").alias("h")).groupBy(F.col("h.question_id").alias("question_id")).agg(F.sort_array(F.collect_set("h.src")).alias("s")).select("question_id", F.concat_ws(",", F.slice("s", 1, 3)).alias("first"), F.greatest(F.size("s") - 3, F.lit(0)).alias("more")), "SELECT question_id, array_to_string(list_slice(s, 1, 3), ',') AS first, CAST(greatest(len(s) - 3, 0) AS INT) AS more FROM (SELECT h.question_id AS question_id, list_sort(list_distinct(list(h.src))) AS s FROM (SELECT unnest(ngram_hits) AS h FROM leakage_reports) GROUP BY h.question_id)")
