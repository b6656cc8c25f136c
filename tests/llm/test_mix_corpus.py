"""Mixes as large as the corpus: shortfalls, repeats, and the flow against brute force."""

import itertools
import random

import pytest

from lekha.llm import mixing

MIX = "source string, target_share double, cap_tokens long, max_repeat double, optional boolean"


def best(patterns, quota, most):
    """Most tokens, then least cost of repetition, by trying all integer flows."""
    ways = []
    for sources, tokens in patterns:
        rooms = [range(int(tokens * most[s]) + 1) for s in sources]
        ways.append([(sources, w) for w in itertools.product(*rooms) if sum(w) <= tokens * max(most[s] for s in sources)])
    found = (-1, 0)
    for chosen in itertools.product(*ways):
        got = dict.fromkeys(quota, 0)
        cost = 0
        for (_, tokens), (sources, w) in zip(patterns, chosen, strict=True):
            for s, n in zip(sources, w, strict=True):
                got[s] += n
            rest, use = sum(w), 0
            while rest > 0:
                cost += use * min(rest, tokens)
                rest, use = rest - tokens, use + 1
        if all(got[s] <= quota[s] for s in quota):
            found = max(found, (sum(got.values()), -cost))
    return found


@pytest.mark.parametrize("seed", range(12))
def test_flow_against_brute_force(seed):
    r = random.Random(seed)
    sets = r.sample([("a",), ("b",), ("a", "b"), ("c",), ("b", "c")], 3)
    patterns = sorted((s, r.randint(1, 4)) for s in sets)
    most = {s: float(r.randint(1, 2)) for s in "abc"}
    quota = {s: r.randint(0, 7) for s in "abc"}
    total, flow = mixing.route(patterns, quota, most)
    cost = 0
    for p, (_, tokens) in enumerate(patterns):
        rest, use = sum(n for (q, _), n in flow.items() if q == p), 0
        while rest > 0:
            cost += use * min(rest, tokens)
            rest, use = rest - tokens, use + 1
    assert (total, -cost) == best(patterns, quota, most)


def corpus(spark, times=1):
    rows = []
    for s, n in (("big", 400), ("capped", 200), ("small", 20), ("single", 30), ("unlisted", 50)):
        rows += [(f"{s}{t}-{i}", s, t * 100_000 + i, len(s), 10 + i % 7) for t in range(times) for i in range(n)]
    # Texts in two sources, and sources with no share.
    rows += [(f"both{t}-{i}", s, -1 - t * 100_000 - i, 3, 12) for t in range(times) for i in range(30) for s in ("big", "small", "unlisted")]
    return spark.createDataFrame(rows, "doc_id string, source string, h1 long, h2 long, n_tokens long")


@pytest.mark.parametrize("times", [1, 4])
def test_a_mix_of_the_size_of_the_corpus(spark, times):
    mix = spark.createDataFrame([("big", 0.4, None, 1.0, False), ("capped", 0.2, 500, 1.0, False), ("small", 0.3, None, 3.0, False), ("single", 0.1, None, None, False), ("gone", 0.2, None, None, False), ("perhaps", 0.2, None, None, True)], MIX)
    docs = corpus(spark, times)
    sel = mixing.select(docs, mix, total_tokens="corpus")
    got = {r.source: r for r in mixing.shares(docs, mix, sel).collect()}
    whole = sum(t for t, in {(r.h1, r.h2): (r.n_tokens,) for r in docs.filter("source <> 'unlisted'").collect()}.values())
    assert got["big"].tokens == pytest.approx(0.4 * whole, rel=0.03)
    assert 480 <= got["capped"].tokens <= 500 and got["capped"].shortfall > 0.1
    assert got["small"].most_repeats == 3 and got["small"].tokens <= 3 * got["small"].unique_tokens
    assert got["single"].most_repeats == 1 and got["single"].tokens == got["single"].unique_tokens
    assert got["unlisted"].tokens == 0
    assert got["gone"].missing and not got["perhaps"].missing and not got["big"].missing


def test_many_sets_of_sources_keep_all_their_sources(spark):
    names = [f"s{k:02}" for k in range(12)]
    sets = [c for n in (1, 2, 3) for c in itertools.combinations(names, n)]
    docs = spark.createDataFrame([(f"{k}-{s}", s, k, 0, 5) for k, c in enumerate(sets) for s in c], "doc_id string, source string, h1 long, h2 long, n_tokens long")
    mix = spark.createDataFrame([(s, 1.0, None, 1.0, None) for s in names], MIX)
    got = mixing.shares(docs, mix, mixing.select(docs, mix, total_tokens="corpus")).collect()
    assert sum(r.tokens for r in got) >= 0.98 * 5 * len(sets)
    assert max(r.shortfall for r in got) < 0.01
