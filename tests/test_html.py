"""Extraction from pages with nested, broken and empty tags, by hand."""

import pytest
from pyspark.sql import functions as F

from lekha.functions import html as H


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("page", "want"), [
    ("<body><article>short</article><article>much longer</article></body>", "much longer"),
    ("<BODY class='x'><MAIN>m</MAIN></BODY>", "m"),
    ("<article></article><main>m</main>", "m"),
    # A tag that is never closed gives way to the next of the list, and then to the page.
    ("<article>open<main>inner</main>", "inner"), ("<p>no container", "<p>no container"), ("", ""),
    ("<article><div><article>nested</article> after</div></article>", "<div><article>nested"),
])
def test_containers(spark, page, want):
    assert one(spark, page, H.container) == want


@pytest.mark.parametrize(("page", "want"), [
    ("a<script>if (a<b) { x = '<!--'; }</script>b", "a b"), ("a<SCRIPT type='x'>\n1\n</SCRIPT>b<style>p{}</style>c", "a b c"), ("a<!-- <p>no</p>\n -->b", "a b"), ("a<script>never closed", "a<script>never closed"), ("plain", "plain"),
])
def test_scripts_styles_and_comments(spark, page, want):
    assert one(spark, page, H.without_scripts) == want


@pytest.mark.parametrize(("page", "want"), [
    ("<p>One &lt; two</p><p>three</p>", ["One < two", "three"]), ("<ul><li>a<li>b</li></ul>", ["a b"]), ("<div><p>in<b>ner</b></p></div>", ["in ner"]), ("a<br/>b<BR>c", ["a", "b", "c"]), ("&amp;lt;", ["&lt;"]), ("<p", ["<p"]), ("", []),
])
def test_plain_text(spark, page, want):
    assert [x.strip() for x in one(spark, page, H.plain_text).split("\n") if x.strip()] == want


@pytest.mark.parametrize(("page", "want"), [
    ("<h2>Head</h2><p>a <b>bold</b> word</p>", "## Head\n\na **bold** word"),
    ("<ul><li>one</li><li>two <i>2</i></li></ul>", "- one\n- two 2"),
    ("<nav><ul><li>menu</li></ul></nav><p>x</p><footer>f</footer>", "x"),
    ("<p>a<p>b</div></p>c", "a\n\nbc"), ("<div><div><div>deep</div></div></div>", "deep"), ("&amp; &#39;x&#39;", "& 'x'"), ("<p>unclosed <b>bold", "unclosed **bold"), ("", ""), ("</p></div>", ""),
])
def test_markdown(spark, page, want):
    assert one(spark, page, H.markdown) == want


def test_nulls_stay(spark):
    df = spark.createDataFrame([(None,)], "t string")
    got = df.select(H.container("t").alias("a"), H.plain_text(F.col("t")).alias("b"), H.markdown("t").alias("c"), H.title(F.col("t")).alias("d")).first()
    assert got.b is None and got.c is None and got.d is None


@pytest.mark.parametrize(("page", "want"), [("<title>A &amp;  B</title>", "A & B"), ("<TITLE lang='en'>x <b>y</b>\n z</TITLE>", "x y z"), ("<title>open", ""), ("<title></title>", "")])
def test_titles(spark, page, want):
    assert one(spark, page, H.title) == want
