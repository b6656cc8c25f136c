"""Encoding, packing and mixing against public libraries and brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lekha.llm import bpe, mixing, packing
from lekha.session import tokenizer_dir

pytestmark = pytest.mark.skipif(not os.path.isdir(tokenizer_dir()), reason="no tokenizer files")
TEXTS = [None, "", " ", "\n\n", "Hello world", "  two  spaces ", "it's we'll I'VE", "नमस्ते दुनिया।", "naïve café 12345 ½ ²", "<|endoftext|>", "​﻿\x00é", "x" * 5000, "ab" * 4000 + "!", "日本語テキスト", "á", "🙂👍🏽", "\r\n\t \x85 end", "def f(x):\n    return x  # y"]


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokenizer_dir()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = list(enumerate(TEXTS)) + [(3, "repeated"), (3, "repeated"), (None, "no key")]
    df = spark.createDataFrame([(k, x, "clash") for k, x in rows], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), r.ids) for r in bpe.encode(df).collect())
    assert got == sorted((str(k), t.encode(x or "", add_special_tokens=False).ids) for k, x in rows)


def test_merge_equals_naive_merging():
    ranks = bpe.load_ranks("byte_bpe_50k")
    r = random.Random(5)
    for _ in range(300):
        piece = "".join(r.choice("abcdeinrst ") for _ in range(r.randint(1, 24))).encode()
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_round_trip_and_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ids = bpe.encode(df)
    assert {r.doc_id: r.text for r in bpe.decode(ids).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in bpe.count(df, keep=("doc_id",)).collect()} == {r.doc_id: len(r.ids) for r in ids.collect()}
    assert bpe.encode(df.limit(0)).count() == 0


def sizes(n, seed=1):
    r = random.Random(seed)
    return [(i, r.choice([0, 1, 7, 100, 300, 511, 512, 513, 2000, r.randint(1, 600)])) for i in range(n)]


@pytest.mark.parametrize("parts", [10_000, 100])
def test_packing_is_whole_and_fits(spark, parts):
    items = sizes(700) + [(5, 40), (5, 40), (None, 3), (801, None)]
    df = spark.createDataFrame(items, "doc_id int, n_tokens int")
    targets = spark.createDataFrame([("a", 512), ("b", 2048), (None, 9), ("c", 0), ("d", None)], "pack_name string, capacity int")
    rows = packing.pack(df, targets, open_bins=32, part_rows=parts).collect()
    for name, capacity in (("a", 512), ("b", 2048)):
        mine = [r for r in rows if r.pack_name == name]
        load, got = {}, {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            got.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        assert max(load.values()) <= capacity
        want = {}
        for k, n in items:
            want.setdefault(k, []).append(n or 0)
        for k, ns in want.items():
            assert sum(n for _, n in got[k]) == sum(ns)
            assert len(got[k]) == sum(max(1, -(-n // capacity)) for n in ns)
        assert sum(load.values()) > 0.9 * capacity * len(load)
    assert {r.pack_name for r in rows} == {"a", "b"}
    assert packing.pack(df.limit(0), targets).count() == 0
    assert packing.pack(df, targets.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert [*p.add(6, ("a",)), *p.add(7, ("b",))] == []
    assert [*p.add(3, ("c",))] == [(1, [("b",), ("c",)])]
    assert [*p.add(5, ("d",))] == []
    assert [x[0] for x in p.add(8, ("e",))] == [0]
    assert sorted(x[0] for x in p.close()) == [2, 3]


def documents(spark):
    r = random.Random(4)
    rows = []
    for i in range(900):
        source = r.choices(["big", "mid", "tiny", "unlisted"], [6, 3, 1, 1])[0]
        rows.append((i, source, f"text {i}", r.randint(1, 50)))
    rows += [(1000 + i, "mid", f"text {i}", rows[i][3]) for i in range(0, 60)]
    rows += [(2000, "big", None, 0), (2001, None, "x", 5), (2002, "big", "text 0", rows[0][3])]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, n_tokens long").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})


def test_mix_reaches_its_shares(spark):
    mix = spark.createDataFrame([("Big ", 0.5, None, 1.0, None), ("mid", 0.3, 2500, 2.0, False), ("tiny", 0.2, None, 3.0, None), ("absent", 0.1, None, None, True), (None, 0.3, None, None, None), ("big", None, None, None, None)], "source string, target_share double, cap_tokens long, max_repeat double, optional boolean")
    docs = documents(spark)
    sel = mixing.select(docs, mix)
    got = {r.source: r for r in mixing.shares(docs, mix, sel).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert got[s].share == pytest.approx(share, abs=0.02)
        assert got[s].most_repeats <= (got[s].max_repeat or 1)
    assert got["mid"].tokens <= 2500
    assert got["unlisted"].tokens == 0 and got["absent"].tokens == 0
    # A text counts for one source once per use, however often it is copied.
    uses = sel.join(docs.select("doc_id", "h1"), "doc_id").groupBy("h1", "source").count().agg(F.max("count")).first()[0]
    assert uses == 1
    again = {(r.doc_id, r.source, r.repeats) for r in mixing.select(docs.repartition(7), mix).collect()}
    assert again == {(r.doc_id, r.source, r.repeats) for r in sel.collect()}


def test_mix_of_nothing(spark):
    docs, mix = documents(spark), spark.createDataFrame([("big", 0.5, None, 1.0, None)], "source string, target_share double, cap_tokens long, max_repeat double, optional boolean")
    assert mixing.select(docs.limit(0), mix).count() == 0
    assert mixing.select(docs, mix.limit(0)).count() == 0


def test_flow_prefers_fresh_tokens():
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 50)]
    total, flow = mixing.route(patterns, {"a": 100, "b": 150}, {"a": 3.0, "b": 3.0})
    assert total == 250
    assert flow[0, "a"] == 100 and flow[1, "b"] == 100 and flow[2, "b"] == 50
    # Brute force: the largest total at equal shares, without repeats.
    quotas, _ = mixing.plan(patterns, {s: {"target_share": 0.5, "cap_tokens": None, "max_repeat": 1.0} for s in "ab"})
    assert quotas["a"] == pytest.approx(125, abs=1) and quotas["b"] == pytest.approx(125, abs=1)
