"""The tiled stream takes words of the whole text."""

from lekha.plans import registry


def test_tiling_takes_the_whole_text(spark, tmp_path):
    texts = {1: " ".join("x" * (1 + i % 9) for i in range(300)), 2: "ab cde", 3: "y" * 500}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.total) for r in registry.queries()["fn42_tiled"](spark, str(tmp_path)).collect()}
    tiled = {k: [len(w) for w in t.split() * 40][:256] for k, t in texts.items()}
    assert got == {k: (len(x), sum(x)) for k, x in tiled.items()}
