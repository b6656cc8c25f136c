"""Queries over HTML. The pages are made from documents, alike in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekha.functions import html as H
from lekha.plans.registry import register
from lekha.plans.text import S
from lekha.sources import table


def _pages(s, d):
    x = table(s, d, "documents", "doc_id", "source", "text", "fetched_at").filter("text IS NOT NULL AND source IS NOT NULL")
    body = F.replace(F.replace(F.col("text"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(F.col("doc_id") % 3 == 0, "article").otherwise("main")
    page = F.concat(F.lit("<html><head><title> <b>"), "source", F.lit("</b> &amp;\n page "), F.col("doc_id").cast("string"), F.lit('</title><script>if (a) { x = "<!--"; }</script><style>p {}</style></head><body><nav><a href="/files/'), F.col("doc_id").cast("string"), F.lit('.pdf">file</a><a href="/next">next</a></nav><!-- note --><'), tag, F.lit(">short</"), tag, F.lit("><"), tag, F.lit("><p>Begin here. "), body, F.lit("</p>END OF STORY<p>Share this</p></"), tag, F.lit("></body></html>"))
    return x.select("doc_id", "source", "text", "fetched_at", page.alias("html"))


_B = "replace(replace(text, '<', '&lt;'), '>', '&gt;')"
_T = "CASE WHEN doc_id % 3 = 0 THEN 'article' ELSE 'main' END"
_D = "CAST(doc_id AS VARCHAR)"
_PG = f"(SELECT doc_id, source, text, fetched_at, '<html><head><title> <b>' || source || '</b> &amp;' || chr(10) || ' page ' || {_D} || '</title><script>if (a) {{ x = \"<!--\"; }}</script><style>p {{}}</style></head><body><nav><a href=\"/files/' || {_D} || '.pdf\">file</a><a href=\"/next\">next</a></nav><!-- note --><' || {_T} || '>short</' || {_T} || '><' || {_T} || '><p>Begin here. ' || {_B} || '</p>END OF STORY<p>Share this</p></' || {_T} || '></body></html>' AS html FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"


def _hashed(name: str, column, sql: str) -> None:
    register(name, lambda s, d: _pages(s, d).select("doc_id", column().alias("t")).select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("sha")), f"SELECT doc_id, CAST(length(t) AS INT) AS n, sha256(t) AS sha FROM (SELECT doc_id, {sql} AS t FROM {_PG})")


_LONG = "coalesce((SELECT x FROM (SELECT unnest(regexp_extract_all(html, '(?is)<{0}[^>]*>(.*?)</{0}>', 1)) AS x) ORDER BY length(x) DESC LIMIT 1), '')"
_CONT = "coalesce(" + ", ".join(f"nullif({_LONG.replace('{0}', t)}, '')" for t in ("article", "main", "body")) + ", html)"
_hashed("ext01_container", lambda: H.container(F.col("html")), _CONT)
_REST = "substr(html, strpos(lower(html), 'begin here'))"
_ENDS = ("end of story", "share this", "</article>")
_STOP = "list_min(list_filter([" + ", ".join(f"strpos(lower({_REST}), '{e}')" for e in _ENDS) + "], lambda x: x > 0))"
_hashed("ext02_until_marker", lambda: H.until_marker(F.col("html"), "Begin here", _ENDS), f"CASE WHEN strpos(lower(html), 'begin here') > 0 THEN substr({_REST}, 1, CAST(coalesce({_STOP} - 1, length({_REST})) AS BIGINT)) ELSE '' END")
_NS = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
_hashed("ext03_without_scripts", lambda: H.without_scripts(F.col("html")), _NS)


def _unescape(c: str) -> str:
    for a, b in H.REFERENCES:
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return c


_PL = _unescape(f"regexp_replace(regexp_replace({_NS}, '(?i)</(p|div|h[1-6]|li|tr)>|<br[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')")
_hashed("ext04_plain_text", lambda: H.plain_text(F.col("html")), f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PL}, '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{S}+|{S}+$', '', 'g')")
register("ext04_markdown", lambda s, d: _pages(s, d).select("doc_id", F.length(H.markdown("html")).alias("n")))
register("ext07_body_floor", lambda s, d: _pages(s, d).filter(F.length(F.col("text")) >= F.when(F.col("source") == "press_wire", 400).otherwise(300)).select("doc_id"), f"SELECT doc_id FROM {_PG} WHERE length(text) >= CASE WHEN source = 'press_wire' THEN 400 ELSE 300 END")
register("ext08_title", lambda s, d: _pages(s, d).select("doc_id", H.title(F.col("html")).alias("title")), f"SELECT doc_id, trim(regexp_replace({_unescape('regexp_replace(regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1), ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '[ \\t\\n]+', ' ', 'g')) AS title FROM {_PG}")
register("ext09_markers_absent", lambda s, d: _pages(s, d).filter(~F.contains(F.lower("text"), F.lit("read the full text in print")) & ~F.contains(F.lower("text"), F.lit("sign up for"))).select("doc_id"), f"SELECT doc_id FROM {_PG} WHERE NOT contains(lower(text), 'read the full text in print') AND NOT contains(lower(text), 'sign up for')")


def _dated(s, d):
    x = table(s, d, "documents", "doc_id", "fetched_at")
    made = F.when(F.col("doc_id") % 11 != 0, F.date_format("fetched_at", "MMMM d, yyyy"))
    x = x.withColumn("day", F.try_to_timestamp(made, F.lit("MMMM d, yyyy")).cast("date"))
    return x.filter(F.col("day").isNull() | (F.col("day") >= F.lit("2024-06-01").cast("date"))).select("doc_id", "day")


register("ext10_since", _dated, "SELECT doc_id, day FROM (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN CAST(fetched_at AS DATE) END AS day FROM documents) WHERE day IS NULL OR day >= DATE '2024-06-01'")
register("ext11_file_name", lambda s, d: table(s, d, "documents", "doc_id", "dst_path").select("doc_id", H.file_name(F.concat(F.lit("https://site.test/a b/"), F.coalesce("dst_path", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "?q=1").otherwise("/"))).alias("name")), "SELECT doc_id, CASE WHEN safe = '' THEN substr(sha256(url), 1, 16) ELSE safe END AS name FROM (SELECT doc_id, url, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1), '[^\\p{L}\\p{N}._-]', '_', 'g') AS safe FROM (SELECT doc_id, 'https://site.test/a b/' || coalesce(dst_path, '') || CASE WHEN doc_id % 2 = 0 THEN '?q=1' ELSE '/' END AS url FROM documents))")
register("ext12_rescued", lambda s, d: table(s, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.sha2(H.rescued(F.col("text"), F.replace("text", F.lit("�"), F.lit("."))), 256).alias("sha")), "SELECT doc_id, sha256(CASE WHEN (length(text) - length(replace(text, '�', ''))) / greatest(1, length(text)) * 1000 > 1.0 THEN replace(text, '�', '.') ELSE text END) AS sha FROM documents WHERE text IS NOT NULL")
_KEYWORDS = ("treasury", "harvest", "monsoon", "panchayat", "ordinance")
register("ext13_topic", lambda s, d: table(s, d, "documents", "doc_id", "dst_path", "text").filter("text IS NOT NULL").filter(F.exists(F.array(*[F.lit(k) for k in _KEYWORDS]), lambda k: F.contains(F.lower(F.coalesce("dst_path", F.lit(""))), k)) | (F.contains(F.lower(F.substring("text", 1, 1000)), F.lit("treasury")) & F.contains(F.lower(F.substring("text", 1, 1000)), F.lit("council")))).select("doc_id"), "SELECT doc_id FROM documents WHERE text IS NOT NULL AND (len(list_filter(['" + "', '".join(_KEYWORDS) + "'], lambda k: contains(lower(coalesce(dst_path, '')), k))) > 0 OR (contains(lower(substr(text, 1, 1000)), 'treasury') AND contains(lower(substr(text, 1, 1000)), 'council')))")
register("src21_links", lambda s, d: _pages(s, d).select("doc_id", F.explode(H.links(F.col("html"))).alias("url")).filter(~F.col("url").rlike("next$")), f"SELECT doc_id, url FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS url FROM {_PG}) WHERE NOT regexp_matches(url, 'next$')")


def _locations(s, d):
    """Sitemaps of at most a thousand ids each, read back to locations."""
    x = table(s, d, "documents", "doc_id", "source", "dst_path").filter("source IS NOT NULL AND dst_path IS NOT NULL")
    maps = x.groupBy("source", F.floor(F.col("doc_id") / 1000).alias("page")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<url><loc>"), "dst_path", F.lit("</loc></url>")))).alias("xml"))
    return maps.select("source", F.explode(H.locations(F.col("xml"))).alias("url")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n"))


register("src19_locations", _locations, "SELECT source, count(DISTINCT dst_path) AS n FROM documents WHERE source IS NOT NULL AND dst_path IS NOT NULL GROUP BY source")
