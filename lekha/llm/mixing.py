"""Mixing sources to target shares by a minimum-cost flow."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lekha.session import BROADCAST_ROWS, COLLECT_ROWS, broadcast_if_small, cut

#: Texts in a range of the seeded order of one pattern's documents, on average.
RANGE_ROWS = 10_000


class Flow:
    """Maximum flow (Dinic) that can go on after capacities are raised."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = [-1] * len(self.out)
            level[s], todo = 0, deque([s])
            while todo:
                a = todo.popleft()
                for e in self.out[a]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        todo.append(self.to[e])
            if level[t] < 0:
                return total
            step = [0] * len(self.out)
            while True:
                path, a = [], s
                while a != t:
                    while step[a] < len(self.out[a]):
                        e = self.out[a][step[a]]
                        if self.room[e] and level[self.to[e]] == level[a] + 1:
                            path.append(e)
                            a = self.to[e]
                            break
                        step[a] += 1
                    else:
                        if not path:
                            break
                        a = self.to[path.pop() ^ 1]
                        step[a] += 1
                if a != t:
                    break
                sent = min(self.room[e] for e in path)
                total += sent
                for e in path:
                    self.room[e] -= sent
                    self.room[e ^ 1] += sent


def route(patterns: list[tuple[tuple[str, ...], int]], quota: dict[str, int], most: dict[str, float]) -> tuple[int, dict[tuple[int, str], int]]:
    """Tokens from each pattern to each source: as much of the quotas as can be
    met, with the least repetition.

    The k-th use of a pattern's tokens costs k - 1 a token, a convex cost on the
    edge from the flow's start. As only those edges have costs, filling the
    network use by use, each time to its maximum, gives the minimum cost.
    """
    names = sorted(quota)
    at = {s: 1 + len(patterns) + k for k, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    net, uses = Flow(end + 1), []
    inner = {}
    for p, (sources, tokens) in enumerate(patterns):
        known = [s for s in sources if s in at]
        top = max([0.0, *(most[s] for s in known)])
        uses.append((net.edge(0, 1 + p, 0), tokens, top))
        for s in known:
            inner[p, s] = net.edge(1 + p, at[s], int(tokens * most[s]))
    for s in names:
        net.edge(at[s], end, quota[s])
    total, use = 0, 0
    while total < sum(quota.values()) and any(top > use for *_, top in uses):
        for e, tokens, top in uses:
            net.room[e] += int(tokens * min(1.0, max(0.0, top - use)))
        total += net.run(0, end)
        use += 1
    return total, {k: net.room[e ^ 1] for k, e in inner.items() if net.room[e ^ 1]}


def settings(mix: DataFrame) -> DataFrame:
    """Mix settings with clean source names: trimmed, lower case, inner blanks and
    hyphens as underscores. Rows that then share a name become one, each setting
    the largest given."""
    name = F.regexp_replace(F.lower(F.trim("source")), "[ \\-]+", "_")
    return mix.filter(F.col("source").isNotNull()).groupBy(name.alias("source")).agg(*[F.max(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in ("target_share", "cap_tokens", "max_repeat")], F.max(F.col("optional").cast("boolean")).alias("optional"))


def plan(patterns: list[tuple[tuple[str, ...], int]], mix: dict[str, dict], total_tokens: int | None = None) -> tuple[dict[str, int], dict[tuple[int, str], int]]:
    """Quotas of the sources and the flow that fills them.

    Shares are scaled to sum to one over the sources that have a share and
    tokens; one whose cap or repeats allow none counts as without. Without
    ``total_tokens`` the total is the largest at which every source reaches its share
    exactly. With it, a source whose cap or repeats don't allow its share of that total
    gives what they allow, and the others aren't held back by it.
    """
    supply: dict[str, int] = {}
    for sources, tokens in patterns:
        for s in sources:
            supply[s] = supply.get(s, 0) + tokens
    share = {s: m["target_share"] for s, m in mix.items() if (m["target_share"] or 0) > 0 and supply.get(s)}
    most = {s: max(0.0, 1.0 if mix[s]["max_repeat"] is None else mix[s]["max_repeat"]) for s in share}
    cap = {s: int(mix[s]["cap_tokens"]) if mix[s]["cap_tokens"] is not None else int(supply[s] * most[s]) for s in share}
    share = {s: x for s, x in share.items() if min(cap[s], int(supply[s] * most[s])) > 0}
    scale = sum(share.values())
    if not share:
        return {}, {}
    share = {s: x / scale for s, x in share.items()}
    quota = lambda t: {s: min(cap[s], int(t * x)) for s, x in share.items()}
    if total_tokens is not None:
        q = quota(total_tokens)
        return q, route(patterns, q, most)[1]
    low, high = 0, int(min(min(cap[s], supply[s] * most[s]) / share[s] for s in share)) + 1
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        q = {s: int(middle * x) for s, x in share.items()}
        if all(q[s] <= cap[s] for s in q) and route(patterns, q, most)[0] >= sum(q.values()):
            low = middle
        else:
            high = middle
    return quota(low), route(patterns, quota(low), most)[1]


def contents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct texts (h1, h2) with their tokens and the sources they stand in.
    ``docs`` has key, source, h1, h2 and n_tokens. Texts without tokens or source
    can't fill a share and are left out."""
    return docs.filter("n_tokens > 0 AND source IS NOT NULL").groupBy("h1", "h2").agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_set("source")).alias("sources"))


def fitted(used: DataFrame, texts: DataFrame, quotas: dict[str, int], hard: set[str]) -> DataFrame:
    """``used`` with each source's total brought nearer to its quota by one text: one
    that is in no other source and not used is added where tokens are missing, a use
    of one is taken away where there are too many, the best in size each. Sources in
    ``hard`` never pass their quota."""
    got = {r.source: r.t for r in used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()}
    gaps = [(s, int(q - got.get(s, 0)), s in hard) for s, q in sorted(quotas.items()) if q != got.get(s, 0)]
    if not gaps:
        return used
    gap = used.sparkSession.createDataFrame(gaps, "source string, gap bigint, hard boolean")
    gap = F.broadcast(gap) if len(gaps) <= BROADCAST_ROWS else gap
    fresh = texts.filter("size(sources) = 1").select("h1", "h2", F.col("sources")[0].alias("source"), "n_tokens").join(gap.filter("gap > 0"), "source")
    # Added whole, a text may pass the gap by less than half of itself.
    fresh = fresh.filter((F.col("n_tokens") <= F.col("gap")) | ~F.col("hard") & (F.col("n_tokens") < 2 * F.col("gap"))).join(used.select("h1", "h2").distinct(), ["h1", "h2"], "left_anti")
    best = F.struct(F.abs(F.col("gap") - F.col("n_tokens")).alias("d"), "h1", "h2", "n_tokens")
    more = fresh.groupBy("source").agg(F.min(best).alias("x")).select(F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"), "source", F.col("x.n_tokens").alias("n_tokens"), F.lit(1).cast("bigint").alias("repeats"))
    over = used.join(gap.filter("gap < 0"), "source").withColumn("gap", -F.col("gap")).filter(F.col("n_tokens") < 2 * F.col("gap"))
    less = over.groupBy("source").agg(F.min(best).alias("x")).select(F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"), "source", F.col("x.n_tokens").alias("n_tokens"), F.lit(-1).cast("bigint").alias("repeats"))
    changed = used.unionByName(more).unionByName(less)
    return changed.groupBy("h1", "h2", "source", "n_tokens").agg(F.sum("repeats").alias("repeats")).filter("repeats > 0")


def select(docs: DataFrame, mix: DataFrame, seed: int = 1, total_tokens: int | str | None = None, key: str = "doc_id") -> DataFrame:
    """The documents that make up the mix: doc_id, source, n_tokens and repeats.

    ``total_tokens`` is the size of the mix: a number; ``"corpus"``, the tokens of the
    different texts of all sources that have a share, so that the mix grows with the
    corpus, small sources are repeated, and what a source can't reach is its shortfall
    (see ``shares``); or none, the largest size at which no source has a shortfall.

    A text that stands in several sources may count for any of them, and its
    copies within one source count once (the smallest key stands for it). Each
    pattern's texts are put in a seeded order; its flow takes them in that order,
    round and round, so repeats of two texts differ by one at most. A text counts
    for the source in whose span its middle lies; a source with cap_tokens gets
    only texts that lie within its span, so a cap is never passed. What a source then
    lacks or has too much is made up by one text of the best size.

    Null or empty texts, sources without settings or share, and null shares give
    no rows; null max_repeat means no repeats, null cap_tokens no cap. Repeated
    rows count as copies. Empty tables give an empty result.
    """
    docs = docs.select(F.col(key).alias("doc_id"), "source", "h1", "h2", "n_tokens")
    rules = {r.source: r.asDict() for r in settings(mix).limit(100_001).collect()}
    if len(rules) > 100_000:
        raise ValueError("select: more than 100,000 sources in the mix")
    # Only sources that have a share can use a text, so only these make a pattern.
    wanted = sorted(s for s, m in rules.items() if (m["target_share"] or 0) > 0)
    spark = docs.sparkSession
    named = broadcast_if_small(spark.createDataFrame([(s,) for s in wanted], "source string"))
    texts = cut(contents(docs.join(named, "source")))
    # One row for each set of sources that occurs.
    found = texts.groupBy("sources").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(COLLECT_ROWS + 1).collect()
    if len(found) > COLLECT_ROWS:
        raise ValueError("select: too many sets of sources")
    ranges = max(16, -(-sum(r.n for r in found) // RANGE_ROWS))
    patterns = sorted((tuple(r.sources), int(r.tokens)) for r in found)
    quotas, flow = plan(patterns, rules, sum(t for _, t in patterns) if total_tokens == "corpus" else total_tokens)
    spans = []
    start: dict[int, int] = {}
    given = dict.fromkeys(quotas, 0)
    for (p, s), n in sorted(flow.items()):
        spans.append((list(patterns[p][0]), patterns[p][1], s, start.get(p, 0), start.get(p, 0) + n, rules[s]["cap_tokens"] is not None))
        start[p] = start.get(p, 0) + n
        given[s] += n
    spans_df = spark.createDataFrame(spans, "sources array<string>, all_tokens bigint, source string, lo bigint, hi bigint, hard boolean")
    if len(spans) <= BROADCAST_ROWS:
        spans_df = F.broadcast(spans_df)
    order = F.xxhash64("h1", "h2", F.lit(seed))
    placed = texts.withColumn("u", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("u", 24), F.lit(ranges)))
    starts = placed.groupBy("sources", "bucket").agg(F.sum("n_tokens").alias("tokens")).withColumn("before", F.coalesce(F.sum("tokens").over(W.partitionBy("sources").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("tokens")
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("sources", "bucket").orderBy("u", "h1", "h2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = placed.withColumn("inside", inside).join(starts, ["sources", "bucket"]).withColumn("x", F.col("before") + F.col("inside"))
    # Use j counts if its point, moved on by j rounds, lies in the span: the text's
    # middle, or for a capped source both its start and its end.
    first = F.when(F.col("hard"), F.col("x")).otherwise(F.col("x") + F.floor(F.col("n_tokens") / 2)).cast("bigint")
    last = F.when(F.col("hard"), F.col("x") + F.col("n_tokens") - 1).otherwise(F.col("x") + F.floor(F.col("n_tokens") / 2)).cast("bigint")
    below = lambda bound, point: F.greatest(F.lit(0), F.ceil((F.col(bound) - point) / F.col("all_tokens"))).cast("bigint")
    used = x.join(spans_df, "sources").withColumn("repeats", below("hi", last) - below("lo", first)).filter("repeats > 0")
    used = fitted(cut(used.select("h1", "h2", "source", "n_tokens", "repeats")), texts, given, {s for s in quotas if rules[s]["cap_tokens"] is not None})
    named = docs.filter("n_tokens > 0").groupBy("h1", "h2", "source").agg(F.min("doc_id").alias("doc_id"))
    return used.select("h1", "h2", "source", "n_tokens", "repeats").join(named, ["h1", "h2", "source"]).select("doc_id", "source", "n_tokens", "repeats")


def shares(docs: DataFrame, mix: DataFrame, selected: DataFrame) -> DataFrame:
    """Per source of the documents or of the mix: its target share, its tokens (as
    they stand and without copies), the tokens and the share that the selection gives
    it, and its shortfall: by how much its share misses the target, scaled to sum to
    one over the sources that have documents. ``missing`` marks sources that are not
    optional and have no documents."""
    have = docs.filter("source IS NOT NULL").groupBy("source", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("t")).groupBy("source").agg(F.sum(F.col("n") * F.col("t")).alias("source_tokens"), F.sum("t").alias("unique_tokens"))
    got = selected.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    out = settings(mix).join(have, "source", "full").join(got, "source", "left")
    every = W.partitionBy(F.lit(1))  # one row per source: a table of settings
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    missing = F.coalesce(F.col("target_share") > 0, F.lit(False)) & F.col("source_tokens").isNull() & ~F.coalesce("optional", F.lit(False))
    out = out.select("source", "target_share", "max_repeat", F.col("cap_tokens").cast("bigint").alias("cap_tokens"), zero("source_tokens"), zero("unique_tokens"), zero("tokens"), zero("n_docs"), zero("most_repeats"), missing.alias("missing"))
    scaled = F.when((F.col("target_share") > 0) & (F.col("source_tokens") > 0), F.col("target_share"))
    share = F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(every))
    short = F.greatest(F.lit(0.0), F.coalesce(scaled / F.sum(scaled).over(every), F.lit(0.0)) - F.coalesce(share, F.lit(0.0)))
    return out.withColumns({"share": F.round(share, 6), "shortfall": F.round(short, 6)})
