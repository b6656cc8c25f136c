"""Aggregates, calibration and paired tests over scored answers in long form:
condition, task, language, question_id, metric, value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lekha.functions import special
from lekha.operators.ordered import later_min, running_sum
from lekha.session import broadcast_if_small, cut

#: Metrics of which less is better, and metrics that are 0 or 1.
LOWER_IS_BETTER = ("latency_ms", "format_fail", "abstains", "share_repeated")
PROPORTIONS = ("is_correct", "format_fail", "abstains", "schema_valid")


def means(long: DataFrame) -> DataFrame:
    """Mean and number of every (condition, task, language, metric) and, with language
    'all', of every (condition, task, metric), in one pass of grouping sets. Missing
    values don't count; a language that is null stays a group of its own."""
    x = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    g = x.groupingSets([["condition", "task", "language", "metric"], ["condition", "task", "metric"]], "condition", "task", "language", "metric").agg(F.grouping("language").alias("g"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select("condition", "task", F.when(F.col("g") == 1, "all").otherwise(F.col("language")).alias("language"), "metric", "n", "mean")


def bootstrap(long: DataFrame, group: list[str], n: int = 1000, seed: int = 20260514) -> DataFrame:
    """Mean and percentile interval (2.5 to 97.5) of each group's mean over ``n``
    resamples. One weight row a value and resample would not scale, so equal values
    of a group are counted first, and k of them get Poisson weights of mean k inside
    Arrow batches: sums of weights and of weighted values per group and resample are
    all that is shuffled, and any group may be spread over all tasks. Seeds come from
    group and value, so results repeat."""
    x = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*group, "value").agg(F.count(F.lit(1)).alias("k")).select(*group, "value", "k", F.xxhash64(F.lit(seed), "value", *group).alias("s"))

    def sums(batches):
        for pdf in batches:
            rows = []
            for key, part in pdf.groupby(group, dropna=False):
                w, v = np.zeros(n), np.zeros(n)
                for value, k, s in zip(part["value"], part["k"], part["s"], strict=True):
                    drawn = np.random.default_rng(s & 0xFFFFFFFFFFFFFFFF).poisson(k, n)
                    w += drawn
                    v += drawn * value
                rows.append((*(key if isinstance(key, tuple) else (key,)), int(part["k"].sum()), float((part["value"] * part["k"]).sum()), w.tolist(), v.tolist()))
            yield pd.DataFrame(rows, columns=[*group, "n", "total", "w", "v"])

    kinds = ", ".join(f"{g} {long.schema[g].dataType.simpleString()}" for g in group)
    part = x.mapInPandas(sums, f"{kinds}, n bigint, total double, w array<double>, v array<double>")
    each = part.select(*group, "n", "total", F.posexplode(F.arrays_zip("w", "v")).alias("k", "z"))
    per = each.groupBy(*group, "k").agg(F.sum("z.w").alias("w"), F.sum("z.v").alias("v"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    mean = F.when(F.col("w") > 0, F.col("v") / F.col("w"))
    return per.groupBy(*group).agg(F.max("n").alias("n"), (F.max("total") / F.max("n")).alias("mean"), F.percentile(mean, F.lit(0.025)).alias("ci_lo"), F.percentile(mean, F.lit(0.975)).alias("ci_hi"))


def calibration_error(rows: DataFrame, group: list[str], confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins of [0, 1]; the first bin is closed
    at both ends, the others at the upper."""
    x = rows.filter(F.col(confidence).isNotNull() & F.col(correct).isNotNull())
    edge = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    x = x.withColumn("__bin", F.size(F.filter(edge, lambda e: F.col(confidence) > e)))
    b = x.groupBy(*group, "__bin").agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("c"), F.avg(correct).alias("a"))
    return b.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier_skill(rows: DataFrame, group: list[str], brier: str, correct: str) -> DataFrame:
    """1 - mean Brier loss over the loss of always saying the base rate; null where
    all outcomes are alike."""
    base = F.avg(F.col(correct) * F.col(correct)) - F.avg(correct) * F.avg(correct)
    return rows.groupBy(*group).agg(F.avg(brier).alias("b"), base.alias("base")).select(*group, F.when(F.col("base") > 1e-12, 1 - F.col("b") / F.col("base")).alias("skill"))


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else special.chi2_upper(a, b) for a, b in zip(x, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else special.t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([special.mcnemar(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _wilcoxon_p(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else special.wilcoxon(a, int(b), c) for a, b, c in zip(w, n, ties, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([special.binomial_upper(int(a), int(b), c) for a, b, c in zip(k, n, p, strict=True)], dtype=float)


def position_bias(letters: DataFrame, group: list[str], letter: str, least: int = 8) -> DataFrame:
    """Chi-square of chosen letters A to D against equal shares; null under ``least``."""
    x = letters.filter(F.col(letter).isin(*"ABCD"))
    n = x.groupBy(*group).agg(*[F.sum(F.when(F.col(letter) == a, 1).otherwise(0)).cast("double").alias(a) for a in "ABCD"], F.count(F.lit(1)).alias("n"))
    e = F.col("n") / 4
    chi = sum(((F.col(a) - e) * (F.col(a) - e) / e for a in "ABCD"), F.lit(0.0))
    x = n.select(*group, "n", F.when(F.col("n") >= least, chi).alias("chi2"))
    return x.withColumn("p", _chi2_p("chi2", F.lit(3.0)))


def pairs(long: DataFrame, by: list[str]) -> DataFrame:
    """Values of two conditions (a before b) on one question: ``by``, metric,
    question_id, condition_a, condition_b, a, b and diff, oriented so that more is
    better. Conditions are few, so values of a question are gathered and paired in
    place, without a join."""
    x = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by, "metric", "question_id", "condition").agg(F.avg("value").alias("value"))
    c = x.groupBy(*by, "metric", "question_id").agg(F.sort_array(F.collect_list(F.struct("condition", "value"))).alias("v")).filter("size(v) > 1")
    two = c.select(*by, "metric", "question_id", F.explode("v").alias("x"), "v").select(*by, "metric", "question_id", "x", F.explode(F.filter("v", lambda y: y["condition"] > F.col("x.condition"))).alias("y"))
    a, b = F.col("x.value"), F.col("y.value")
    return two.select(*by, "metric", "question_id", F.col("x.condition").alias("condition_a"), F.col("y.condition").alias("condition_b"), a.alias("a"), b.alias("b"), F.when(F.col("metric").isin(*LOWER_IS_BETTER), b - a).otherwise(a - b).alias("diff"))


def effect_label(size: Column) -> Column:
    m = F.abs(size)
    return F.when(m < 0.2, "negligible").when(m < 0.5, "small").when(m < 0.8, "medium").otherwise("large")


def paired_tests(paired: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Per pair of conditions: n, means, mean difference, paired t, signed ranks,
    effect size (Cohen's h for proportions, else d) and its label; p-values.
    Groups under ``least`` pairs are left out."""
    key = [*by, "metric", "condition_a", "condition_b"]
    base = paired.groupBy(*key).agg(F.count(F.lit(1)).alias("n_paired"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd")).filter(F.col("n_paired") >= least)
    # Ranks from counts per size of difference: a rank is the mean over its ties.
    sizes = paired.filter("diff <> 0").groupBy(*key, F.abs("diff").alias("m")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("diff") > 0, 1).otherwise(0)).alias("up"))
    w = W.partitionBy(*key).orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("r", F.coalesce(F.sum("k").over(w), F.lit(0)) + (F.col("k") + 1) / 2)
    ranks = ranked.groupBy(*key).agg(F.sum(F.col("r") * F.col("up")).alias("w_up"), F.sum(F.col("r") * (F.col("k") - F.col("up"))).alias("w_down"), F.sum("k").alias("n_diff"), F.sum((F.col("k") * F.col("k") * F.col("k") - F.col("k")).cast("double")).alias("ties"))
    x = base.join(ranks, key, "left")
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n_paired")))
    hold = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    h = 2 * F.asin(F.sqrt(hold("mean_a"))) - 2 * F.asin(F.sqrt(hold("mean_b")))
    d = F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")).otherwise(0.0)
    is_share = F.col("metric").isin(*PROPORTIONS)
    out = x.select(*key, "n_paired", "mean_a", "mean_b", "mean_diff", t.alias("t"), F.least("w_up", "w_down").alias("w"), F.coalesce("n_diff", F.lit(0)).alias("n_diff"), F.coalesce("ties", F.lit(0.0)).alias("ties"), F.when(is_share, h).otherwise(d).alias("effect"), F.when(is_share, "cohen_h").otherwise("cohen_d").alias("effect_kind"))
    return out.withColumn("label", effect_label(F.col("effect"))).withColumn("t_p", _t_p("t", F.col("n_paired") - 1.0)).withColumn("w_p", F.coalesce(_wilcoxon_p("w", "n_diff", "ties"), F.lit(1.0))).drop("n_diff", "ties")


def false_discovery(tests: DataFrame, p: str, out: str) -> DataFrame:
    """Benjamini-Hochberg q-values over all rows: p m / rank, then the least of all
    later ones, at most 1. Null p counts as 1. Equal p share the last rank, so the
    family is reduced to its different p-values; ranks and least values are carried
    along them in ranges, and none but a checked number is broadcast."""
    x = tests.withColumn("__p", F.coalesce(p, F.lit(1.0)))
    n = cut(x.groupBy("__p").agg(F.count(F.lit(1)).alias("k")))
    m = n.agg(F.sum("k")).first()[0] or 0
    ranked = running_sum(n, ["__p"], "k", "__before").withColumn("__q", F.col("__p") * m / (F.col("__before") + F.col("k")))
    q = later_min(ranked, "__p", "__q", out).select(F.col("__p").alias("__v"), F.least(F.lit(1.0), out).alias(out))
    return x.join(broadcast_if_small(q), F.col("__p") == F.col("__v")).drop("__p", "__v")


@F.pandas_udf(DoubleType())
def _sign_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, 2 * special.binomial_upper(int(max(x, y)), int(x + y), 0.5)) if x + y else 1.0 for x, y in zip(b, c, strict=True)], dtype=float)


def discordant(paired: DataFrame, group: list[str]) -> DataFrame:
    """Per pair of conditions: n questions, b where the first did better, c where the
    second did, and the exact two-sided p of so uneven a split; 1 where none differ."""
    x = paired.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("a") > F.col("b"), 1).otherwise(0)).cast("bigint").alias("__b"), F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0)).cast("bigint").alias("c"))
    return x.select(*group, "n", F.col("__b").alias("b"), "c").withColumn("p", _sign_p("b", "c"))


def interval_verdict(lo: Column, hi: Column) -> Column:
    """WIN above zero, LOSS below, TIE where the interval holds it."""
    return F.when(lo > 0, "WIN").when(hi < 0, "LOSS").otherwise("TIE")


def weighted_kappa(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Quadratic weighted kappa of scores rounded half to even, from sums only:
    1 - mean square difference over that of independent scores."""
    x = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, F.bround(a).alias("x"), F.bround(b).alias("y"))
    seen = F.avg((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    by_chance = F.var_pop("x") + F.var_pop("y") + (F.avg("x") - F.avg("y")) * (F.avg("x") - F.avg("y"))
    return x.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), seen.alias("s"), by_chance.alias("e")).select(*group, "n", F.when(F.col("e") > 0, 1 - F.col("s") / F.col("e")).alias("kappa"))


def rank_correlation(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Spearman and Pearson correlation. Average ranks come from counts per value, so
    a large group is reduced to its different values first."""
    x = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str, out: str) -> DataFrame:
        n = x.groupBy(*group, c).agg(F.count(F.lit(1)).alias("k"))
        w = W.partitionBy(*group).orderBy(c).rowsBetween(W.unboundedPreceding, -1)
        return n.select(*group, c, (F.coalesce(F.sum("k").over(w), F.lit(0)) + (F.col("k") + 1) / 2).alias(out))

    y = x.join(ranks(a, "__ra"), [*group, a]).join(ranks(b, "__rb"), [*group, b])
    return y.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("__ra", "__rb").alias("spearman"), F.corr(a, b).alias("pearson"))


def bilingual(rows: DataFrame, group: list[str], least: int = 5) -> DataFrame:
    """Paired outcomes of one question in English and Hindi: n, accuracies, b (only
    English right), c (only Hindi right) and McNemar's p."""
    stem = F.regexp_replace("question_id", ":(en|hi)$", "")
    x = rows.groupBy(*group, stem.alias("stem")).pivot("language", ["en", "hi"]).agg(F.max("is_correct")).filter("en IS NOT NULL AND hi IS NOT NULL")
    out = x.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("en").alias("acc_en"), F.avg("hi").alias("acc_hi"), F.sum(F.when((F.col("en") == 1) & (F.col("hi") == 0), 1).otherwise(0)).alias("b"), F.sum(F.when((F.col("en") == 0) & (F.col("hi") == 1), 1).otherwise(0)).alias("c")).filter(F.col("n") >= least)
    return out.withColumn("p", _mcnemar_p("b", "c"))


def binomial_gate(rows: DataFrame, group: list[str], correct: str, chance: float = 0.25, alpha: float = 0.05) -> DataFrame:
    """Whether each group is right more often than by chance, one-sided."""
    x = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum(correct).cast("bigint").alias("k"))
    return x.withColumn("p", _binomial_p("k", "n", F.lit(chance))).withColumn("passed", F.col("p") < alpha)
