"""Queries over texts: cleaning, filters, tokens, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekha.functions import text as T
from lekha.plans.registry import register
from lekha.sources import table

S = T.SPACE.replace("'", "''")


def _docs(fn, *columns: str):
    """A query over documents with a text: doc_id and what ``fn`` adds."""

    def query(spark, d):
        docs = table(spark, d, "documents", "doc_id", "text", *columns).filter("text IS NOT NULL")
        return fn(docs)

    return query


def _hash_rows(name: str, column, sql: str) -> None:
    """A text projection, compared by length and digest of its result."""
    register(name, _docs(lambda x: x.select("doc_id", column(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("sha"))), f"SELECT doc_id, CAST(length(t) AS INT) AS n, sha256(t) AS sha FROM (SELECT doc_id, {sql} AS t FROM documents WHERE text IS NOT NULL)")


_REPLACED = "text"
for _a, _b in T.PLAIN:
    _REPLACED = f"replace({_REPLACED}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"
_PUNCT_SQL = f"replace(regexp_replace({_REPLACED}, '([0-9A-Za-z])\\x{{FFFD}}', '\\1.', 'g'), '\ufffd', '')"
_hash_rows("tx01_plain_punctuation", T.plain_punctuation, _PUNCT_SQL)
register("tx01_normalize_unicode", _docs(lambda x: x.select("doc_id", F.sha2(T.normalize_unicode(F.col("text")), 256).alias("sha"))))

_STRUCK = "replace(regexp_replace(regexp_replace({0}, '~~([A-Z])~~" + S + "+', '\\1', 'g'), '~~([^~\\n]+)~~', '\\1', 'g'), '~~', '')"
_hash_rows("tx02_strikethrough", T.strip_strikethrough, _STRUCK.replace("{0}", "text"))

_I = "text"
for _a, _b in T.LOST_I:
    _I = f"regexp_replace({_I}, '\\b{_a}\\b', '{_b}', 'g')"
# RE2 has no look-ahead: the three exceptions are masked first.
_I = f"regexp_replace({_I}, '(?i)\\b(automa|tri|bri)(ton)\\b', '\\1\x01\\2', 'g')"
for _a, _b in T.LOST_ENDINGS:
    _I = f"regexp_replace({_I}, '(^|[^A-Za-z0-9_])([A-Za-z]{{2,}}){_a}\\b', '\\1\\2{_b}', 'g')"
_hash_rows("tx03_lost_i", T.restore_lost_i, f"replace({_I}, '\x01', '')")

_STRIP = "regexp_replace({0}, '^" + S + "+|" + S + "+$', '', 'g')"
_COLLAPSE = _STRIP.replace("{0}", "regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_hash_rows("tx04_collapse_whitespace", T.collapse_whitespace, _COLLAPSE)

_LETTERS = "len(regexp_extract_all(text, '\\p{L}'))"
_RATIO = f"CASE WHEN {_LETTERS} > 0 THEN len(regexp_extract_all(text, '[\\x{{0900}}-\\x{{097F}}]')) / {_LETTERS} ELSE 0.0 END"
register("tx05_devanagari_ratio", _docs(lambda x: x.select("doc_id", F.round(T.devanagari_ratio(F.col("text")), 6).alias("ratio"))), f"SELECT doc_id, round(CAST({_RATIO} AS DOUBLE), 6) AS ratio FROM documents WHERE text IS NOT NULL")
_hash_rows("tx06_strip_devanagari", T.strip_devanagari, "regexp_replace(regexp_replace(text, '[\\x{0900}-\\x{097F}][\\x{0900}-\\x{097F} \\t\\x{0964}\\x{0965}]*', ' ', 'g'), '[ \\t]+', ' ', 'g')")
_LINE = f"regexp_replace(text, '{S}+', ' ', 'g')"
_hash_rows("tx07_dedup_form", lambda c: T.one_line(c, strip=False), f"lower({_LINE})")
_hash_rows("tx08_leakage_form", T.one_line, f"lower(trim({_LINE}))")
_hash_rows("tx09_cased_form", lambda c: T.one_line(c, lower=False), f"trim({_LINE})")
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
register("tx10_loose_tokens", _docs(lambda x: x.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"), F.array_join(T.tokens(F.col("text")), " ").alias("t")).select("doc_id", "n", F.sha2("t", 256).alias("sha"))), f"SELECT doc_id, CAST(len({_TOKENS}) AS INT) AS n, sha256(array_to_string({_TOKENS}, ' ')) AS sha FROM documents WHERE text IS NOT NULL")
_GRAMS = "CASE WHEN len(t) >= {n} THEN list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(list_slice(t, i, i + {n} - 1), ' ')) ELSE [] END"


def _shingles(x):
    g = x.select("doc_id", T.bind(T.ngrams(T.tokens(F.col("text")), 5), lambda g: F.array(F.size(g), F.size(F.array_distinct(g)))).alias("g"))
    return g.select("doc_id", F.col("g")[0].alias("n_grams"), F.col("g")[1].alias("n_shingles"))


register("tx11_shingles", _docs(_shingles), f"SELECT doc_id, CAST(len(g) AS INT) AS n_grams, CAST(len(list_distinct(g)) AS INT) AS n_shingles FROM (SELECT doc_id, {_GRAMS.format(n=5)} AS g FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL))")


def _two_widths(x):
    t = T.tokens(F.col("text"))
    return x.select("doc_id", *[F.greatest(F.size(t) - n + 1, F.lit(0)).alias(f"n{n}") for n in (25, 50)])


register("tx12_gram_counts", _docs(_two_widths), f"SELECT doc_id, CAST(greatest(len(t) - 24, 0) AS INT) AS n25, CAST(greatest(len(t) - 49, 0) AS INT) AS n50 FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL)")
_WORDS = "list_filter(regexp_split_to_array({0}, '" + S + "+'), lambda x: x <> '')"


def _chunks(x):
    c = x.select("doc_id", F.posexplode(T.chunks(T.words(F.col("text")), 1500, 200)).alias("chunk_no", "c"))
    return c.select("doc_id", "chunk_no", F.size("c").alias("n_words"), F.sha2(F.array_join("c", " "), 256).alias("sha"))


register("tx13_chunks", _docs(_chunks), f"SELECT doc_id, CAST(k AS INT) AS chunk_no, CAST(len(c) AS INT) AS n_words, sha256(array_to_string(c, ' ')) AS sha FROM (SELECT doc_id, k, list_slice(w, k * 1500 + 1, k * 1500 + 1500) AS c FROM (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / 1500.0) AS BIGINT))) AS k FROM (SELECT doc_id, {_WORDS.replace('{0}', 'text')} AS w FROM documents WHERE text IS NOT NULL))) WHERE len(c) >= 200")
register("tx16_token_estimate", _docs(lambda x: x.select("doc_id", F.floor((F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))) * 1.3 + 1).cast("bigint").alias("n"))), "SELECT doc_id, CAST(floor((length(text) - length(replace(text, ' ', ''))) * CAST(1.3 AS DOUBLE) + 1) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
register("fl02_word_floor", _docs(lambda x: x.select("doc_id", T.word_count(F.col("text")).alias("n_words")).filter("n_words >= 50")), f"SELECT doc_id, CAST(len(w) AS INT) AS n_words FROM (SELECT doc_id, {_WORDS.replace('{0}', 'text')} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 50")
register("fl03_language_filter", _docs(lambda x: x.filter(T.devanagari_ratio(F.col("text")) <= 0.30).select("doc_id")), f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {_RATIO} <= 0.30")
_REASON = f"CASE WHEN len(w) < 50 THEN 'words=' || len(w) || ' below floor (50)' WHEN {_RATIO} > 0.30 THEN 'devanagari ratio above limit' ELSE '' END"
register("fl04_drop_reason", _docs(lambda x: x.select("doc_id", T.drop_reason(F.col("text")).alias("reason"))), f"SELECT doc_id, {_REASON} AS reason FROM (SELECT doc_id, text, {_WORDS.replace('{0}', 'text')} AS w FROM documents WHERE text IS NOT NULL)")
_TAGGED = "CASE doc_id % 7 WHEN 0 THEN 'Categories: [' || split_part('download,noticeboard,top-10,history', ',', CAST(doc_id // 7 % 4 + 1 AS INT)) || ']' || chr(10) ELSE '' END || text"


def _cruft(x):
    tag = F.split_part(F.lit("download,noticeboard,top-10,history"), F.lit(","), (F.floor(F.col("doc_id") / 7) % 4 + 1).cast("int"))
    marked = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Categories: ["), tag, F.lit("]\n"), "text")).otherwise(F.col("text"))
    return x.filter((F.col("source") == "exam_notes") & T.is_cruft(marked)).select("doc_id")


register("fl01_category_cruft", _docs(_cruft, "source"), f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND source = 'exam_notes' AND regexp_matches({_TAGGED}, '(?i)Categories:[ \\t\\n]*(\\[[^\\]]+\\]\\([^)]+/category/({'|'.join(T.CRUFT)})\\)|\\[({'|'.join(T.CRUFT)})\\])')")
_EST = "CAST(floor((length(text) - length(replace(text, ' ', ''))) * CAST(1.3 AS DOUBLE) + 1) AS BIGINT)"
register("fl09_length_band", _docs(lambda x: x.withColumn("n", F.floor((F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))) * 1.3 + 1).cast("bigint")).filter("n BETWEEN 64 AND 4096").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")), "lang"), f"SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM (SELECT lang, {_EST} AS n FROM documents WHERE text IS NOT NULL) WHERE n BETWEEN 64 AND 4096 GROUP BY lang")


def _records(spark, d):
    """Records of delimited files: the delimiter is put between paragraphs first."""
    docs = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    marked = F.replace("text", F.lit("\n\n"), F.lit("\n\n<<<END-RECORD>>>\n\n"))
    parts = docs.select("doc_id", F.posexplode(F.split(marked, "<<<END-RECORD>>>")).alias("rec_no", "t")).withColumn("t", T.strip_ends(F.col("t"))).filter("t <> ''")
    return parts.select("doc_id", "rec_no", F.sha2("t", 256).alias("sha"))


register("src09_records", _records, f"SELECT doc_id, CAST(rec_no AS INT) AS rec_no, sha256(t) AS sha FROM (SELECT doc_id, rec_no, {_STRIP.replace('{0}', 't')} AS t FROM (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS rec_no FROM (SELECT doc_id, string_split(replace(text, chr(10) || chr(10), chr(10) || chr(10) || '<<<END-RECORD>>>' || chr(10) || chr(10)), '<<<END-RECORD>>>') AS p FROM documents WHERE text IS NOT NULL))) WHERE t <> ''")


def _paragraphs(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"\n[ \t]*\n+")).alias("para_no", "t")).withColumn("t", T.strip_ends(F.col("t"))).filter("t <> ''")
    return parts.select("doc_id", "para_no", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("sha"))


register("src10_paragraphs", _paragraphs, f"SELECT doc_id, CAST(para_no AS INT) AS para_no, CAST(length(t) AS INT) AS n_chars, sha256(t) AS sha FROM (SELECT doc_id, para_no, {_STRIP.replace('{0}', 't')} AS t FROM (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS para_no FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t]*\\n+') AS p FROM documents WHERE text IS NOT NULL))) WHERE t <> ''")


def _source_path(spark, d):
    docs = table(spark, d, "documents", "doc_id", "dst_path")
    parts = F.split("dst_path", "/")
    return docs.select("doc_id", F.try_element_at(parts, F.lit(-2)).alias("folder"), F.try_element_at(parts, F.lit(-1)).alias("file"), F.regexp_extract("dst_path", r"\.([A-Za-z0-9]+)$", 1).alias("format"))


register("src08_source_path", _source_path, "SELECT doc_id, p[-2] AS folder, p[-1] AS file, CASE WHEN dst_path IS NULL THEN NULL ELSE regexp_extract(dst_path, '\\.([A-Za-z0-9]+)$', 1) END AS format FROM (SELECT doc_id, dst_path, string_split(dst_path, '/') AS p FROM documents)")

# Ids.
_BASE = "CASE WHEN len(string_split(pair_id, ':')) > 1 THEN lower(trim(string_split(pair_id, ':')[2])) END"


def _ids(spark, d):
    x = table(spark, d, "ft_corpus", "pair_id").distinct()
    p = F.split("pair_id", ":")
    return x.select("pair_id", F.lower(F.trim(F.try_element_at(p, F.lit(2)))).alias("base"), F.regexp_replace("pair_id", ":(en|hi)$", "").alias("stem"), F.size(p).alias("parts"))


register("tx19_id_parts", _ids, f"SELECT DISTINCT pair_id, {_BASE} AS base, regexp_replace(pair_id, ':(en|hi)$', '') AS stem, CAST(len(string_split(pair_id, ':')) AS INT) AS parts FROM ft_corpus")


def _prompts(spark, d):
    x = table(spark, d, "ft_corpus", "pair_id", "task", "instruction", "input").distinct()
    prompt = F.concat_ws("\n\n", F.nullif(F.trim("instruction"), F.lit("")), F.nullif(F.trim("input"), F.lit("")))
    return x.select("pair_id", "task", prompt.alias("p")).groupBy("pair_id", "task").agg(F.min(F.sha2("p", 256)).alias("sha"), F.max(F.size(T.words(F.col("p")))).alias("n_words"))


register("tx18_prompt", _prompts, f"SELECT pair_id, task, min(sha256(p)) AS sha, max(CAST(len({_WORDS.replace('{0}', 'p')}) AS INT)) AS n_words FROM (SELECT DISTINCT pair_id, task, concat_ws(chr(10) || chr(10), nullif(trim(instruction), ''), nullif(trim(input), '')) AS p FROM ft_corpus) GROUP BY pair_id, task")


_IN, _OUT = "coalesce(input, '')", "coalesce(output, '')"


def _sft_estimate(spark, d):
    x = table(spark, d, "ft_corpus", "pair_id", "task", "instruction", "input", "output").distinct()
    n = F.greatest(T.word_count(F.coalesce("input", F.lit(""))), F.lit(0)) + F.greatest(T.word_count(F.coalesce("output", F.lit(""))), F.lit(0))
    x = x.withColumn("est", F.floor(n * 1.4).cast("int") + 64)
    return x.groupBy("task").agg(F.sum(F.when(F.col("est") > 512, 1).otherwise(0)).alias("dropped"), F.sum(F.when(F.col("est") <= 512, 1).otherwise(0)).alias("kept"), F.sum("est").alias("tokens"))


register("fl10_over_length", _sft_estimate, f"SELECT task, CAST(sum(CASE WHEN est > 512 THEN 1 ELSE 0 END) AS BIGINT) AS dropped, CAST(sum(CASE WHEN est <= 512 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(est) AS BIGINT) AS tokens FROM (SELECT task, CAST(floor((len({_WORDS.replace('{0}', _IN)}) + len({_WORDS.replace('{0}', _OUT)})) * CAST(1.4 AS DOUBLE)) AS INT) + 64 AS est FROM (SELECT DISTINCT pair_id, task, instruction, input, output FROM ft_corpus)) GROUP BY task")
register("tx27_task_tag", lambda spark, d: table(spark, d, "predictions", "question_id", "inference_task").distinct().select("question_id", "inference_task", F.nullif(F.regexp_extract(F.concat(F.lit("[TASK="), "inference_task", F.lit("] "), "question_id"), r"\[TASK=([ABCE])\]", 1), F.lit("")).alias("tag")), "SELECT DISTINCT question_id, inference_task, nullif(regexp_extract('[TASK=' || inference_task || '] ' || question_id, '\\[TASK=([ABCE])\\]', 1), '') AS tag FROM predictions")
