"""Pass/fail statistics over scored runs: discrimination, rankings, tables and studies.

Scores are first reduced to one row per distinct value with pass and fail counts. Running
counts over values are formed in two levels (inside score bins, then over the few bins),
so no group is ever sorted in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from runloom.functions.text import percent
from runloom.operators.assess import IDEAL_MIN, LUCKY_MAX, revised_tier
from runloom.operators.refgraph import draw_order

BINS_PER_POINT = 100
KS_TERMS = 100
#: Up to so many passes and fails the p-value of KS is exact.
EXACT_KS = 10_000


def unpivot_scores(scores: DataFrame, columns: Sequence[str], keys: Sequence[str],
                   unit_scale: Sequence[str] = ()) -> DataFrame:
    """Long form (keys, score_type, score); columns of ``unit_scale`` are multiplied by 100."""
    cells = [F.struct(F.lit(c).alias("score_type"), (F.col(c) * (100.0 if c in unit_scale else 1.0))
                      .cast("double").alias("score")) for c in columns]
    return scores.select(*keys, F.inline(F.array(*cells)))


def score_counts(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per group and distinct score: passes ``p``, fails ``n``, both counted below the score,
    and the group totals."""
    g = list(groups)
    v = scores.where(F.col("score").isNotNull()).groupBy(*g, "score").agg(
        F.count_if("passed").alias("p"), F.count_if(~F.col("passed")).alias("n")) \
        .withColumn("_bin", F.floor(F.col("score") * BINS_PER_POINT))
    bins = v.groupBy(*g, "_bin").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    over = Window.partitionBy(*g)
    below = over.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*g, "_bin", F.coalesce(F.sum("_p").over(below), F.lit(0)).alias("_cp"),
                       F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_cn"),
                       F.sum("_p").over(over).alias("tot_p"), F.sum("_n").over(over).alias("tot_n"))
    inside = Window.partitionBy(*g, "_bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("_lp", F.coalesce(F.sum("p").over(inside), F.lit(0))) \
        .withColumn("_ln", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return v.join(bins, [*g, "_bin"]).select(
        *g, "score", "p", "n", (F.col("_cp") + F.col("_lp")).alias("p_below"),
        (F.col("_cn") + F.col("_ln")).alias("n_below"), "tot_p", "tot_n")


def kolmogorov_p(d: Column, p: Column, n: Column) -> Column:
    """Two-sided asymptotic p-value of the two-sample statistic."""
    lam = d * F.sqrt(p * n / (p + n))
    terms = F.transform(F.sequence(F.lit(1), F.lit(KS_TERMS)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
                        * F.exp(-2.0 * k * k * lam * lam))
    total = 2.0 * F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(lam < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def paths_outside(k: int, n: int, m: int) -> float:
    """Share of the lattice paths from (0, 0) to (n, m) that touch |i m - j n| >= k: the exact p-value of
    the two-sample statistic k / (n m).

    Row by row, the ways that stayed inside are running sums of the row before. A path is counted
    where it first leaves, with all its ways on from there, so small shares keep their digits.
    Rows are rescaled as they grow; O(n m) steps, O(m) memory.
    """
    if k <= 0:
        return 1.0
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + m + 1)))))

    def onward(i, j):
        """Logarithm of the ways from (i, j) to the end."""
        return logs[n - i + m - j] - logs[n - i] - logs[m - j]

    def bounds(i: int) -> tuple[int, int]:
        return max(0, (i * m - k) // n + 1), min(m, -((-i * m - k) // n) - 1)
    lo, hi = bounds(0)
    ways, scale, outside = np.ones(hi + 1), 0.0, 0.0
    whole = logs[n + m] - logs[n] - logs[m]
    if hi < m:
        outside += np.exp(onward(0, hi + 1) - whole)
    for i in range(1, n + 1):
        low, high = bounds(i)
        if low > lo:  # steps from row i - 1 that land below the band
            j = np.arange(lo, min(low, hi + 1))
            left = ways[:len(j)]
            outside += float((left * np.exp(scale + onward(i, j) - whole)).sum())
        if high < low:  # nothing stays inside
            break
        row = np.zeros(high - low + 1)
        keep = ways[low - lo:high - lo + 1]
        row[:len(keep)] = keep
        ways = np.cumsum(row)
        if high < m:
            outside += float(ways[-1] * np.exp(scale + onward(i, high + 1) - whole))
        lo, hi = low, high
        top = ways.max(initial=0.0)
        if top > 1e200:
            ways, scale = ways / top, scale + np.log(top)
    return float(min(1.0, outside))


@pandas_udf(DoubleType())
def exact_ks_p(d: pd.Series, p: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([paths_outside(round(x * a * b), int(a), int(b)) for x, a, b in zip(d, p, n)])


def ks_p(d: Column, p: Column, n: Column) -> Column:
    """Exact p-value for groups of up to ``EXACT_KS`` passes and fails each, the asymptotic one beyond. A
    group is one row of three numbers here."""
    small = F.greatest(p, n) <= EXACT_KS
    none = F.lit(None).cast("double")
    return F.when(small, exact_ks_p(F.when(small, d).otherwise(0.0), F.when(small, p).otherwise(1), F.when(small, n).otherwise(1))).when(
        d.isNull(), none).otherwise(kolmogorov_p(d, p, n))


def discrimination(scores: DataFrame, groups: Sequence[str], fixed_threshold: float | None = None,
                   lowest: bool = False) -> DataFrame:
    """AUROC, KS, threshold and confusion metrics per group; single-class groups drop out.

    The threshold maximises TPR - FPR (highest on ties, or ``lowest``) unless one is given.
    """
    g = list(groups)
    v = score_counts(scores, g).where((F.col("tot_p") > 0) & (F.col("tot_n") > 0))
    tpr, fpr = (F.col("tot_p") - F.col("p_below")) / F.col("tot_p"), (F.col("tot_n") - F.col("n_below")) / F.col("tot_n")
    gap = F.abs((F.col("p_below") + F.col("p")) / F.col("tot_p") - (F.col("n_below") + F.col("n")) / F.col("tot_n"))
    j = F.round(tpr - fpr, 12)
    order = F.struct(j.alias("j"), (-F.col("score") if lowest else F.col("score")).alias("s"), tpr.alias("tpr"), fpr.alias("fpr"))
    best = v.groupBy(*g).agg(
        F.max("tot_p").alias("num_passed"), F.max("tot_n").alias("num_failed"),
        (F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)) / (F.max("tot_p") * F.max("tot_n"))).alias("auroc"),
        F.max(gap).alias("ks_statistic"), F.max(order).alias("_b"),
        (F.sum(F.col("p") * F.col("score")) / F.max("tot_p")).alias("pass_mean"),
        (F.sum(F.col("n") * F.col("score")) / F.max("tot_n")).alias("fail_mean"))
    picked = F.col("_b.s") * (-1 if lowest else 1)
    auto = F.when(F.col("_b.j") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), picked))).otherwise(100.0)
    best = best.withColumn("threshold", auto if fixed_threshold is None else F.lit(float(fixed_threshold)))
    hit = F.col("score") >= F.col("threshold")
    conf = v.join(best.select(*g, "threshold", "pass_mean", "fail_mean"), g).groupBy(*g).agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("tn"),
        F.sqrt(F.sum(F.col("p") * F.pow(F.col("score") - F.col("pass_mean"), 2)) / F.max("tot_p")).alias("pass_std"),
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("score") - F.col("fail_mean"), 2)) / F.max("tot_n")).alias("fail_std"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return best.join(conf, g).select(
        *g, "num_passed", "num_failed", "auroc", "ks_statistic",
        ks_p(F.col("ks_statistic"), F.col("num_passed"), F.col("num_failed")).alias("ks_pvalue"),
        "threshold", "tp", "fp", "tn", "fn", ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"),
        F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"), (tp / (tp + fn)).alias("recall"),
        "pass_mean", "pass_std", "fail_mean", "fail_std")


def macro_micro(scores: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Mean of per-task metrics beside pooled metrics, per score type."""
    names = ("auroc", "accuracy", "f1")
    per = discrimination(scores, ["score_type", *keys]).groupBy("score_type").agg(
        F.count(F.lit(1)).alias("n_tasks"), *[F.avg(c).alias(f"macro_{c}") for c in names])
    pooled = discrimination(scores, ["score_type"]).select("score_type", *[F.col(c).alias(f"micro_{c}") for c in names])
    return per.join(pooled, "score_type")


def signal_auroc(scores: DataFrame) -> DataFrame:
    """Direction-free AUROC per signal."""
    return discrimination(scores, ["score_type"]).select(
        "score_type", F.greatest("auroc", 1 - F.col("auroc")).alias("auroc"))


def score_histogram(scores: DataFrame, width: int = 5, groups: Sequence[str] = ("score_type",)) -> DataFrame:
    return scores.groupBy(*groups, "passed", (F.floor(F.col("score") / width) * width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def tier_distribution(reports: DataFrame, tier: str = "revised_tier", keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of each tier among passing and failing runs."""
    n = reports.groupBy(*keys, "passed", F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys, "passed").agg(F.sum("n").alias("_t"))
    return n.join(total, [*keys, "passed"]).withColumn("pct", percent(F.col("n"), F.col("_t"))).drop("_t")


def model_ranking(reports: DataFrame) -> DataFrame:
    """Models by pass rate and by mean score of passing runs; ranks on the model totals only."""
    m = reports.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("passed").cast("double")).alias("pass_rate"),
        F.avg(F.when(F.col("passed"), F.col("quality_score"))).alias("mean_score"))
    by_rate = F.rank().over(Window.orderBy(F.desc("pass_rate")))
    by_score = F.rank().over(Window.orderBy(F.desc("mean_score")))
    return m.select("*", by_rate.alias("rate_rank"), by_score.alias("score_rank")) \
        .withColumn("delta", F.col("rate_rank") - F.col("score_rank"))


def curation_table(reports: DataFrame, sizes: Sequence[int] = (50, 25)) -> DataFrame:
    """Tier shares and means of all passing runs and of the top runs by score."""
    passing = reports.where("passed").select("trajectory_id", "task_id", "quality_score", "coherence_score")

    def stats(df, label):
        s = F.col("quality_score")
        pct = lambda c: F.bround(F.count_if(c) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 1)
        return df.agg(F.count(F.lit(1)).alias("k"), pct(s >= IDEAL_MIN).alias("ideal_pct"),
                      pct((s >= LUCKY_MAX) & (s < IDEAL_MIN)).alias("solid_pct"), pct(s < LUCKY_MAX).alias("lucky_pct"),
                      F.bround(F.avg("coherence_score"), 3).alias("mean_coherence"), F.bround(F.avg(s), 1).alias("mean_score"),
                      F.min(s).alias("min_score")).withColumn("strategy", F.lit(label))
    out = stats(passing, "all passing")
    for k in sizes:
        top = passing.orderBy(F.desc("quality_score"), "task_id", "trajectory_id").limit(k)
        out = out.unionByName(stats(top, f"top-{k} by score"))
    return out


def waste_prevalence(waste: DataFrame, kinds: Sequence[tuple[str, str]], groups: Sequence[str] = ("passed",)) -> DataFrame:
    """Share of runs with a waste kind, and its mean size where present.

    ``kinds`` pairs the count column with the wasted-steps column.
    """
    rows = waste.select(*groups, F.inline(F.array(*[F.struct(
        F.lit(c).alias("kind"), F.col(c).cast("double").alias("c"), F.col(w).cast("double").alias("w")) for c, w in kinds])))
    return rows.groupBy(*groups, "kind").agg(
        F.avg((F.col("c") > 0).cast("double")).alias("prevalence"), F.avg(F.when(F.col("c") > 0, F.col("w"))).alias("mean_waste"))


def strongest_discriminator(prevalence: DataFrame) -> DataFrame:
    """Fail/pass prevalence ratio per kind, and the kind with the largest."""
    r = prevalence.groupBy("kind").agg(
        F.max(F.when(F.col("passed"), F.col("prevalence"))).alias("pass_rate"),
        F.max(F.when(~F.col("passed"), F.col("prevalence"))).alias("fail_rate")) \
        .withColumn("ratio", F.col("fail_rate") / F.nullif(F.col("pass_rate"), F.lit(0.0)))
    top = r.agg(F.max_by("kind", F.struct("ratio", "kind")).alias("_top"))
    return r.join(F.broadcast(top), F.lit(True), "left").withColumn("strongest", F.col("kind") == F.col("_top")).drop("_top")


def agreement(pairs: DataFrame, a: str, b: str, tier_a: str, tier_b: str) -> DataFrame:
    """How closely two scorings agree."""
    d = F.col(b) - F.col(a)
    near = lambda k: F.avg((F.abs(d) <= k).cast("double"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mean_abs"), F.median(F.abs(d)).alias("median_abs"),
        near(2).alias("within_2"), near(5).alias("within_5"), F.avg(d).alias("bias"),
        F.avg((F.col(tier_a) == F.col(tier_b)).cast("double")).alias("tier_match"), F.corr(a, b).alias("pearson"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals by task and model with sub-totals."""
    return runs.rollup("task_id", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"),
        F.grouping_id().alias("level"))


def holdout_split(runs: DataFrame, train: int, test_pass: int, test_fail: int, seed: int = 42,
                  keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Assign runs of eligible tasks to train, test_pass or test_fail in draw order."""
    keys = list(keys)
    r = runs.withColumn("_o", draw_order(seed, F.col("trajectory_id")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "trajectory_id"))
    # Two branches with literal limits, so that ranks are cut before the shuffle.
    passing = r.where("passed").withColumn("_r", rank).where(F.col("_r") <= train + test_pass)
    r = passing.unionByName(r.where("NOT passed").withColumn("_r", rank).where(F.col("_r") <= test_fail))
    split = F.when(~F.col("passed"), "test_fail").when(F.col("_r") <= train, "train").otherwise("test_pass")
    r = r.withColumn("split", split)
    ok = r.groupBy(*keys).agg(F.count_if(F.col("split") == "train").alias("_a"), F.count_if(F.col("split") == "test_pass").alias("_b"),
                              F.count_if(F.col("split") == "test_fail").alias("_c")) \
        .where((F.col("_a") == train) & (F.col("_b") >= 1) & (F.col("_c") >= 1))
    return r.join(ok, keys, "left_semi").select(*keys, "trajectory_id", "passed", "split")


def reserved_test(runs: DataFrame, test_pass: int = 2, test_fail: int = 2, seed: int = 42, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """The fixed test runs of every task that has as many: keys, trajectory_id, passed. All other
    passing runs of these tasks form the pool that donors are drawn from."""
    keys = list(keys)
    split = holdout_split(runs, 0, test_pass, test_fail, seed, keys)
    full = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == test_pass + test_fail)
    return split.join(full, keys, "left_semi").select(*keys, "trajectory_id", "passed")


def donor_pool(runs: DataFrame, test: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    keys = list(keys)
    return runs.where("passed").select(*keys, "trajectory_id").join(test.select(*keys).distinct(), keys, "left_semi") \
        .join(test.select(*keys, "trajectory_id"), [*keys, "trajectory_id"], "left_anti")


def draw_grid(pool: DataFrame, most: int, draws: int, seed: int = 42, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Up to ``most`` donors of every draw in draw order: keys, draw_id, trajectory_id, run_order. The
    first k of a draw are its graph of k runs. Ranks are cut before the shuffle completes."""
    keys = list(keys)
    p = pool.select(*keys, "trajectory_id").withColumn("draw_id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    p = p.withColumn("_o", draw_order(F.col("draw_id") + seed, F.col("trajectory_id")))
    rank = F.row_number().over(Window.partitionBy(*keys, "draw_id").orderBy("_o", "trajectory_id"))
    return p.withColumn("run_order", rank).where(F.col("run_order") <= most).select(*keys, "draw_id", "trajectory_id", "run_order")


def order_grid(pool: DataFrame, k: int, combinations: int, orders: int, seed: int = 42, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Distinct combinations of ``k`` donors (one per draw, equal ones once), each in up to ``orders``
    distinct orders: keys, draw_id, perm_id, trajectory_id, run_order. All orders where k! allows."""
    keys = list(keys)
    drawn = draw_grid(pool, k, combinations, seed, keys)
    members = drawn.groupBy(*keys, "draw_id").agg(F.array_sort(F.collect_list("trajectory_id")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    chosen = members.where(F.col("_n") == k).groupBy(*keys, "_m").agg(F.min("draw_id").alias("draw_id"))
    total = factorial(k)
    picked = range(total) if total <= orders else [total * i // orders for i in range(orders)]
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("perm_id"), F.array(*map(F.lit, nth_order(n, k))).alias("_p")) for i, n in enumerate(picked)]))
    return chosen.withColumn("_o", places).select(*keys, "draw_id", "_o.perm_id", F.posexplode("_m").alias("_i", "trajectory_id"), "_o._p") \
        .select(*keys, "draw_id", "perm_id", "trajectory_id", F.get("_p", F.col("_i")).alias("run_order"))


def nth_order(n: int, k: int) -> list[int]:
    """The n-th order of k things: the place, from 1, of each."""
    left, out = list(range(1, k + 1)), []
    for i in range(k, 0, -1):
        at, n = divmod(n, factorial(i - 1))
        out.append(left.pop(at))
    return out


def spread(per_draw: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Mean, population deviation and range of a per-draw value."""
    return per_draw.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("draws"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("low"), F.max(value).alias("high"))


def order_variance(scores: DataFrame, value: str = "score", groups: Sequence[str] = ("k",)) -> DataFrame:
    """Variance of a score between donor combinations and within one (order only)."""
    per = scores.groupBy(*groups, "draw_id").agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    return per.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("combinations"), F.sum("_n").alias("orders"), F.avg("_m").alias("mean"),
        F.var_pop("_m").alias("between_combinations"), F.avg("_v").alias("within_combination"))


def resampled_tiers(scores: DataFrame, tier: str = "tier", groups: Sequence[str] = ("draw_id",)) -> DataFrame:
    """Share of each tier among passing and failing runs over draws: mean, deviation and range. A draw
    without a tier counts as zero."""
    g = list(groups)
    n = scores.groupBy(*g, "passed", F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*g, "passed").agg(F.sum("n").alias("_t"))
    every = total.join(n.select("passed", "tier").distinct(), "passed")
    share = every.join(n, [*g, "passed", "tier"], "left").withColumn("pct", F.coalesce("n", F.lit(0)) / F.col("_t") * 100)
    return spread(share, "pct", ["passed", "tier"])


def in_range(spreads: DataFrame, value: dict[str, float], name: str) -> DataFrame:
    """Whether a published value lies in the range of the draws, for rows whose ``name`` has one."""
    told = F.create_map(*[F.lit(x) for k, v in value.items() for x in (k, float(v))])
    return spreads.withColumn("published", told[F.col(name)]).withColumn(
        "in_range", (F.col("low") <= F.col("published")) & (F.col("published") <= F.col("high")))


def over_draws(scores: DataFrame, waste: DataFrame, kinds: Sequence[tuple[str, str]], cell: Sequence[str],
               keys: Sequence[str] = ("task_id", "trajectory_id")) -> DataFrame:
    """One row per run over its references: score (rounded mean), deviation and range, tier of the mean,
    whether all references agree on it, the tiers seen, and the mean waste of every kind."""
    per = scores.join(waste.select(*cell, keys[-1], *dict.fromkeys(c for pair in kinds for c in pair), "total_wasted_steps"), [*cell, keys[-1]])
    per = per.withColumn("_tier", revised_tier(F.col("quality_score"), F.col("passed")))
    mean = [F.bround(F.avg(c), 1).alias(c) for c in dict.fromkeys([c for pair in kinds for c in pair] + ["total_wasted_steps"])]
    out = per.groupBy(*keys, "passed").agg(
        F.count(F.lit(1)).alias("n_refs"), F.rint(F.avg("quality_score")).cast("int").alias("quality_score"),
        F.bround(F.stddev_pop("quality_score"), 1).alias("score_std"), F.min("quality_score").alias("score_min"), F.max("quality_score").alias("score_max"),
        F.array_join(F.array_sort(F.collect_set("_tier")), ",").alias("tiers_seen"), F.bround(F.avg("coverage_percent"), 1).alias("coverage_percent"),
        F.bround(F.avg("coherence_score"), 3).alias("coherence"), *mean)
    return out.withColumn("tier", revised_tier(F.col("quality_score"), F.col("passed"))).withColumn("tier_stable", ~F.contains("tiers_seen", F.lit(",")))


def own_run_rollup(rows: DataFrame, kinds: Sequence[tuple[str, str]]) -> DataFrame:
    """Totals over runs as (item, n): outcomes, tiers, unstable tiers, and wasted steps per kind."""
    one = F.lit(1.0)
    outcome = F.when(F.col("passed"), "passed").when(~F.col("passed"), "failed").otherwise("unknown")
    pairs = [(F.lit("scored"), one), (outcome, one), (F.concat(F.lit("tier:"), "tier"), one),
             (F.lit("tier varied"), F.when(F.col("tier_stable"), 0.0).otherwise(1.0)),
             *[(F.lit(f"wasted:{w}"), F.col(w).cast("double")) for _, w in kinds]]
    items = [F.struct(name.alias("item"), n.alias("n")) for name, n in pairs]
    return rows.select(F.inline(F.array(*items))).groupBy("item").agg(F.bround(F.sum("n"), 1).alias("n"))
