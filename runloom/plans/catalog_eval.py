"""Registered queries over scored runs: discrimination, rankings, tables and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import assess as A
from runloom.operators import evaluate as E
from runloom.operators import matching as M
from runloom.operators import refgraph as G
from runloom.operators import features as X
from runloom.plans import dataset as D
from runloom.plans.adapter import staged_steps
from runloom.plans.catalog_steps import with_coherence
from runloom.plans.store import staged
from runloom.plans import studies as S

K = ["task_id", "trajectory_id"]
QUERIES = {}
TYPES = ("coherence", "exploration", "implementation")


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


def rounded(df, *plain):
    """Round every double to six places, keep the rest."""
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields])


def run_scores(s, d):
    """Three simple scores per run, on a 0-100 scale, and a whole-number quality score."""
    def build():
        st = staged_steps(s, d)
        n = F.count(F.lit(1))
        mix = st.groupBy(*K).agg(
            F.first("model").alias("model"), F.first("passed").alias("passed"),
            F.round(F.count_if(F.col("intent_stage") == "exploration") * 100.0 / n, 4).alias("exploration"),
            F.round(F.count_if(F.col("intent_stage") == "implementation") * 100.0 / n, 4).alias("implementation"))
        coh = X.coherence(st).select(*K, F.round("coherence_score", 4).alias("coherence_score"))
        return mix.join(coh, K).withColumn("coherence", F.round(F.col("coherence_score") * 100, 2)) \
            .withColumn("quality_score", F.rint("coherence").cast("int"))
    return staged(s, "run_scores", d, build)


def long_scores(s, d):
    return E.unpivot_scores(run_scores(s, d), TYPES, [*K, "model", "passed"])


SCORES = """, sc AS (SELECT task_id, trajectory_id, model, passed, round(e * 100.0::DOUBLE / n, 4) AS exploration, round(i * 100.0::DOUBLE / n, 4) AS implementation,
    round(CAST(coherence AS DOUBLE), 4) AS coherence_score, round(round(CAST(coherence AS DOUBLE), 4) * 100, 2) AS coherence
  FROM (SELECT task_id, trajectory_id, model, passed, count(*) AS n, count_if(intent_stage = 'exploration') AS e, count_if(intent_stage = 'implementation') AS i
        FROM lab GROUP BY 1, 2, 3, 4) JOIN coh USING (task_id, trajectory_id)),
 qs AS (SELECT *, CAST(round_even(coherence, 0) AS INTEGER) AS quality_score FROM sc),
 ls AS (SELECT task_id, trajectory_id, model, passed, 'coherence' AS score_type, coherence AS score FROM sc UNION ALL
        SELECT task_id, trajectory_id, model, passed, 'exploration', exploration FROM sc UNION ALL
        SELECT task_id, trajectory_id, model, passed, 'implementation', implementation FROM sc)"""


def sql(body):
    return with_coherence("").rstrip() + SCORES + "\n" + body


def disc_sql(g, src="ls", low=False):
    """Discrimination by direct pair counting and threshold scanning."""
    t = "min" if low else "max"
    return f""", gg AS (SELECT {g}, count_if(passed) AS pp, count_if(NOT passed) AS nn FROM {src} GROUP BY ALL HAVING count_if(passed) > 0 AND count_if(NOT passed) > 0),
 au AS (SELECT {', '.join('a.' + x for x in g.split(', '))}, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS u
    FROM {src} a JOIN {src} b ON {' AND '.join(f'a.{x} = b.{x}' for x in g.split(', '))} AND a.passed AND NOT b.passed GROUP BY ALL),
 th AS (SELECT DISTINCT {g}, score AS t FROM {src}),
 cf AS (SELECT {', '.join('th.' + x for x in g.split(', '))}, t, count_if(passed AND score >= t) AS tp, count_if(NOT passed AND score >= t) AS fp,
    count_if(passed AND score <= t) AS pl, count_if(NOT passed AND score <= t) AS nl FROM th JOIN {src} USING ({g}) GROUP BY ALL),
 cj AS (SELECT *, round(CAST(tp AS DOUBLE) / pp - CAST(fp AS DOUBLE) / nn, 12) AS j, abs(CAST(pl AS DOUBLE) / pp - CAST(nl AS DOUBLE) / nn) AS gap FROM cf JOIN gg USING ({g})),
 bj AS (SELECT {g}, max(j) AS bj, max(gap) AS ks FROM cj GROUP BY ALL),
 bt AS (SELECT {g}, {t}(t) AS t FROM cj JOIN bj USING ({g}) WHERE j = bj GROUP BY ALL),
 dt AS (SELECT * REPLACE (CASE WHEN j > 0 THEN tp ELSE 0 END AS tp, CASE WHEN j > 0 THEN fp ELSE 0 END AS fp) FROM cj),
 ds AS (SELECT *, pp - tp AS fn, nn - fp AS tn, u / (CAST(pp AS DOUBLE) * nn) AS auroc FROM dt JOIN bt USING ({g}, t) JOIN bj USING ({g}) JOIN au USING ({g}))"""


add("auroc", lambda s, d: rounded(E.discrimination(long_scores(s, d), ["score_type"]).select("score_type", "num_passed", "num_failed", "auroc")),
    sql("").rstrip() + disc_sql("score_type") + " SELECT score_type, pp AS num_passed, nn AS num_failed, round(auroc, 6) AS auroc FROM ds")
add("ks_2samp", lambda s, d: rounded(E.discrimination(long_scores(s, d), ["score_type"]).select("score_type", "ks_statistic", "ks_pvalue")),
    (sql("").rstrip() + disc_sql("score_type")).replace("WITH ", "WITH RECURSIVE ", 1) + """,
 lat AS (SELECT score_type, ks, CAST(pp AS BIGINT) AS pp, CAST(nn AS BIGINT) AS nn, CAST(round(ks * pp * nn) AS BIGINT) AS k0 FROM ds),
 -- row i holds, for each j, the share of the paths to (i, j) that stay inside
 kr AS (SELECT score_type, ks, pp, nn, k0, CAST(0 AS BIGINT) AS i, list_transform(range(0, nn + 1), lambda j: CASE WHEN j * pp < k0 THEN 1.0::DOUBLE ELSE 0 END) AS r FROM lat
   UNION ALL
   SELECT score_type, ks, pp, nn, k0, i + 1, list_reduce(list_prepend([CASE WHEN (i + 1) * nn < k0 THEN r[1] ELSE 0::DOUBLE END],
       list_transform(range(1, nn + 1), lambda j: [j::DOUBLE, r[j + 1]])),
     lambda acc, x: list_append(acc, CASE WHEN abs((i + 1) * nn - x[1] * pp) < k0 THEN ((i + 1) * x[2] + x[1] * acc[-1]) / (i + 1 + x[1]) ELSE 0::DOUBLE END))
   FROM kr WHERE i < pp)
 SELECT score_type, round(ks, 6) AS ks_statistic, round(1 - r[nn + 1], 6) AS ks_pvalue FROM kr WHERE i = pp""")
add("youden_threshold", lambda s, d: rounded(E.discrimination(long_scores(s, d), ["score_type"]).select("score_type", "threshold").join(
    E.discrimination(long_scores(s, d), ["score_type"], lowest=True).select("score_type", F.col("threshold").alias("lowest")), "score_type")),
    sql("").rstrip() + disc_sql("score_type") + " SELECT score_type, max(t) AS threshold, min(t) AS lowest FROM cj JOIN bj USING (score_type) WHERE j = bj GROUP BY 1")
_CONF = ("tp", "fp", "tn", "fn", "accuracy", "f1", "precision", "recall")
add("confusion_metrics", lambda s, d: rounded(E.discrimination(long_scores(s, d), ["score_type"]).select("score_type", *_CONF)),
    sql("").rstrip() + disc_sql("score_type") + """ SELECT score_type, tp, fp, tn, fn, round(CAST(tp + tn AS DOUBLE) / (pp + nn), 6) AS accuracy, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1,
      round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / pp, 6) AS recall FROM ds""")
add("fixed_threshold", lambda s, d: E.discrimination(long_scores(s, d), ["score_type"], fixed_threshold=40.0).select("score_type", "tp", "fp", "tn", "fn"),
    sql("SELECT score_type, count_if(passed AND score >= 40) AS tp, count_if(NOT passed AND score >= 40) AS fp, count_if(NOT passed AND score < 40) AS tn, "
        "count_if(passed AND score < 40) AS fn FROM ls GROUP BY 1"))
add("class_score_stats", lambda s, d: rounded(E.discrimination(long_scores(s, d), ["score_type"]).select("score_type", "pass_mean", "pass_std", "fail_mean", "fail_std")),
    sql("SELECT score_type, round(avg(score) FILTER (WHERE passed), 6) AS pass_mean, round(stddev_pop(score) FILTER (WHERE passed), 6) AS pass_std, "
        "round(avg(score) FILTER (WHERE NOT passed), 6) AS fail_mean, round(stddev_pop(score) FILTER (WHERE NOT passed), 6) AS fail_std FROM ls GROUP BY 1"))
add("macro_micro", lambda s, d: rounded(E.macro_micro(long_scores(s, d)).select("score_type", "n_tasks", "macro_auroc", "micro_auroc")),
    sql("").rstrip() + disc_sql("score_type, task_id") + """, tk AS (SELECT score_type, count(*) AS n_tasks, avg(auroc) AS ma FROM ds GROUP BY 1),
      g1 AS (SELECT a.score_type, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS mi
             FROM ls a JOIN ls b ON a.score_type = b.score_type AND a.passed AND NOT b.passed GROUP BY 1)
      SELECT score_type, n_tasks, round(ma, 6) AS macro_auroc, round(mi, 6) AS micro_auroc FROM tk JOIN g1 USING (score_type)""")
# The nine published score types, their column, and whether it is on a scale to 1.
SCORE_TYPES = {
    "structural": ("coverage_percent", False), "process": ("process_coverage", True), "weighted": ("weighted_score", False),
    "stage_completeness": ("stage_completeness", True), "workflow_similarity": ("workflow_similarity", True),
    "coherence": ("coherence_score", True), "temporal_profile": ("temporal_profile_score", True),
    "bottleneck": ("bottleneck_coverage", False), "combined": ("combined_score", False),
}


def score_types(s, d):
    tools = M.process_coverage(D.candidates(s, d), G.required_tools(D.path_facts(s, d))).select(*K, "process_coverage")
    m = D.metrics(s, d).join(tools, K).join(D.runs(s, d).select(*K, "passed"), K)
    m = m.withColumn("combined_score", A.combined_score(F.col("coverage_percent"), F.col("process_coverage") * 100, F.col("coherence_score"),
                                                        F.col("temporal_profile_score")))
    named = m.select(*K, "passed", *[(F.col(c) * (100.0 if unit else 1.0)).alias(name) for name, (c, unit) in SCORE_TYPES.items()])
    return E.unpivot_scores(named, list(SCORE_TYPES), [*K, "passed"])


add("score_ablation", lambda s, d: rounded(E.discrimination(score_types(s, d), ["score_type"])))
add("score_histogram", lambda s, d: E.score_histogram(long_scores(s, d)),
    sql("SELECT score_type, passed, CAST(floor(score / 5) * 5 AS BIGINT) AS bin, count(*) AS n FROM ls GROUP BY 1, 2, 3"))
_TIER = "CASE WHEN NOT passed THEN CASE WHEN quality_score >= 40 THEN 'partial_fail' ELSE 'off_track' END WHEN quality_score >= 70 THEN 'ideal' WHEN quality_score < 47 THEN 'lucky' ELSE 'solid' END"


def tiered(s, d):
    return run_scores(s, d).withColumn("revised_tier", A.revised_tier(F.col("quality_score"), F.col("passed")))


add("tier_distribution", lambda s, d: E.tier_distribution(tiered(s, d)),
    sql(f"SELECT passed, tier, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY passed), 1) AS pct FROM (SELECT passed, {_TIER} AS tier, count(*) AS n FROM qs GROUP BY 1, 2)"))
add("model_ranking", lambda s, d: rounded(E.model_ranking(run_scores(s, d)).select(
    "model", "n", "pass_rate", "mean_score", F.col("rate_rank").cast("long"), F.col("score_rank").cast("long"), F.col("delta").cast("long"))),
    sql("""SELECT model, n, round(pass_rate, 6) AS pass_rate, round(mean_score, 6) AS mean_score, rank() OVER (ORDER BY pass_rate DESC) AS rate_rank,
      rank() OVER (ORDER BY mean_score DESC) AS score_rank, rank() OVER (ORDER BY pass_rate DESC) - rank() OVER (ORDER BY mean_score DESC) AS delta
    FROM (SELECT model, count(*) AS n, avg(CAST(passed AS DOUBLE)) AS pass_rate, avg(quality_score) FILTER (WHERE passed) AS mean_score FROM qs GROUP BY 1)"""))
_CUR = """SELECT '{0}' AS strategy, count(*) AS k, round_even(count_if(quality_score >= 70) * 100.0::DOUBLE / count(*), 1) AS ideal_pct, round_even(count_if(quality_score >= 47 AND quality_score < 70)
  * 100.0::DOUBLE / count(*), 1) AS solid_pct, round_even(count_if(quality_score < 47) * 100.0::DOUBLE / count(*), 1) AS lucky_pct, round_even(avg(coherence_score), 3) AS mean_coherence,
  round_even(avg(quality_score), 1) AS mean_score, min(quality_score) AS min_score FROM (SELECT * FROM qs WHERE passed ORDER BY quality_score DESC, task_id, trajectory_id {1})"""
add("curation_table", lambda s, d: E.curation_table(run_scores(s, d)),
    sql(" UNION ALL ".join(_CUR.format(n, lim) for n, lim in (("all passing", ""), ("top-50 by score", "LIMIT 50"), ("top-25 by score", "LIMIT 25")))))
_KINDS = [("regression_loop_count", "regression_loop_waste"), ("retry_loop_count", "blind_retry_waste"), ("redundant_step_count", "redundant_step_count"),
          ("unnecessary_exploration_count", "unnecessary_exploration_count"), ("cyclic_pattern_count", "cyclic_pattern_waste")]


def _waste(s, d):
    return D.waste_summary(s, d).join(D.reports(s, d).select(*K, "passed", "revised_tier"), K)


add("waste_prevalence", lambda s, d: rounded(E.waste_prevalence(_waste(s, d), _KINDS)))
add("waste_prevalence_by_tier", lambda s, d: rounded(E.waste_prevalence(_waste(s, d), _KINDS, ("revised_tier",))))
add("strongest_discriminator", lambda s, d: rounded(E.strongest_discriminator(E.waste_prevalence(_waste(s, d), _KINDS))))
add("model_discrimination", lambda s, d: rounded(E.discrimination(long_scores(s, d), ["model", "score_type"]).select("model", "score_type", "auroc", "accuracy", "f1")),
    sql("").rstrip() + disc_sql("model, score_type") + " SELECT model, score_type, round(auroc, 6) AS auroc, round(CAST(tp + tn AS DOUBLE) / (pp + nn), 6) AS accuracy, "
    "round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM ds")


def _agreement(s, d):
    r = run_scores(s, d).withColumn("other", F.rint("exploration").cast("int"))
    r = r.withColumn("ta", A.revised_tier(F.col("quality_score"), F.col("passed"))).withColumn("tb", A.revised_tier(F.col("other"), F.col("passed")))
    return rounded(E.agreement(r, "quality_score", "other", "ta", "tb"))


add("agreement", _agreement, sql(f"""SELECT count(*) AS n, round(avg(abs(b - a)), 6) AS mean_abs, round(CAST(median(abs(b - a)) AS DOUBLE), 6) AS median_abs, round(avg(CAST(abs(b - a) <= 2 AS DOUBLE)), 6) AS within_2,
    round(avg(CAST(abs(b - a) <= 5 AS DOUBLE)), 6) AS within_5, round(avg(b - a), 6) AS bias, round(avg(CAST(ta = tb AS DOUBLE)), 6) AS tier_match, round(corr(a, b), 6) AS pearson
  FROM (SELECT quality_score AS a, CAST(round_even(exploration, 0) AS INTEGER) AS b, {_TIER} AS ta, {_TIER.replace('quality_score', 'CAST(round_even(exploration, 0) AS INTEGER)')} AS tb FROM qs)"""))
add("run_summary", lambda s, d: E.run_summary(D.runs(s, d)).select(
    "task_id", "model", "n", "n_passed", F.col("level").cast("long")), """SELECT task_id, model, count(*) AS n, count_if(p) AS n_passed, CAST(grouping_id(task_id, model) AS BIGINT) AS level
  FROM (SELECT DISTINCT CAST(user_id // 10 AS INTEGER) AS task_id, 'm' || (user_id % 4) AS model, user_id % 10 < 6 AS p, user_id FROM events) GROUP BY ROLLUP (task_id, model)""")
add("score_outcome_leak", lambda s, d: rounded(E.discrimination(E.unpivot_scores(
    D.reports(s, d), ("quality_score", "process_score"), [*K, "passed"]), ["score_type"]).select("score_type", "auroc")))


def outcome_tiers(s, d):
    """Tier shares of the score with the outcome term and of the one without it."""
    out = None
    for column in ("quality_score", "process_score"):
        r = D.reports(s, d).withColumn("tier", A.revised_tier(F.rint(column).cast("int"), F.col("passed")))
        part = E.tier_distribution(r, "tier").withColumn("score_type", F.lit(column))
        out = part if out is None else out.unionByName(part)
    return out


add("outcome_tiers", outcome_tiers)
add("signal_auroc", lambda s, d: rounded(E.signal_auroc(long_scores(s, d))),
    sql("").rstrip() + disc_sql("score_type") + " SELECT score_type, round(greatest(auroc, 1 - auroc), 6) AS auroc FROM ds")
add("holdout_split", lambda s, d: E.holdout_split(D.runs(s, d), 3, 2, 2), """SELECT task_id, trajectory_id, passed, CASE WHEN NOT passed THEN 'test_fail' WHEN r <= 3 THEN 'train' ELSE 'test_pass' END AS split FROM (
    SELECT *, count_if(passed AND r <= 3) OVER w AS a, count_if(passed AND r BETWEEN 4 AND 5) OVER w AS b, count_if(NOT passed AND r <= 2) OVER w AS c FROM (
      SELECT *, row_number() OVER (PARTITION BY task_id, passed ORDER BY md5('42:' || trajectory_id), trajectory_id) AS r FROM (
        SELECT DISTINCT CAST(user_id // 10 AS INTEGER) AS task_id, user_id AS trajectory_id, user_id % 10 < 6 AS passed FROM events)) WINDOW w AS (PARTITION BY task_id))
  WHERE a = 3 AND b >= 1 AND c >= 1 AND r <= CASE WHEN passed THEN 5 ELSE 2 END""")

# --- studies over repeated draws ---------------------------------------------------------
SCORES_OF_STUDY = ("structural", "process", "combined")
# Published shares of tiers in percent, and published areas under the curve.
PUBLISHED_TIERS = {"ideal": 20.2, "lucky": 10.7, "partial_fail": 54.9, "off_track": 45.1}
PUBLISHED_AUROC = {"quality_score": 0.886, "process_score": 0.766}

add("holdout_scores", lambda s, d: rounded(S.holdout(s, d)["scores"].groupBy(*K, "passed").agg(
    F.count(F.lit(1)).alias("draws"), *[F.avg(c).alias(c) for c in (*SCORES_OF_STUDY, "weighted_score", "coherence_score")])))


def _per_task(scores, cell):
    """Discrimination of the test set per task and graph, for each score."""
    return E.discrimination(E.unpivot_scores(scores, SCORES_OF_STUDY, [*cell, "passed"]), [*cell, "score_type"])


def merge_count_study(s, d):
    """The curve: per number of merged runs, means over tasks and draws of areas, accuracies and score gaps, and the pooled area."""
    scores, cell = S.merge_counts(s, d)["scores"], ["k", "draw_id", "task_id"]
    per = _per_task(scores, cell).withColumn("gap", F.col("pass_mean") - F.col("fail_mean"))
    by = ["k", "score_type"]
    out = per.groupBy(*by).agg(F.count(F.lit(1)).alias("graphs"), F.countDistinct("task_id").alias("tasks"), *[f(c).alias(f"{c}_{n}") for c in (
        "auroc", "accuracy", "gap") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    pooled = E.discrimination(E.unpivot_scores(scores, SCORES_OF_STUDY, ["k", "passed"]), by).select(*by, F.col("auroc").alias("micro_auroc"))
    sizes = S.merge_counts(s, d)["states"].groupBy("k", "draw_id", "task_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("k").agg(F.avg("_n").alias("states_mean"))
    return rounded(out.join(pooled, by).join(sizes, "k"))


add("merge_count_study", merge_count_study)
add("merge_order_study", lambda s, d: rounded(E.order_variance(_per_task(S.merge_orders(s, d)["scores"], ["k", "draw_id", "perm_id", "task_id"]),
                                                               "auroc", ["task_id", "score_type"])))
add("merge_order_scores", lambda s, d: rounded(E.order_variance(E.unpivot_scores(S.merge_orders(s, d)["scores"], SCORES_OF_STUDY, [
    *S.CELL, "trajectory_id"]).groupBy(*S.CELL, "score_type").agg(F.avg("score").alias("score")), "score", ["task_id", "score_type"])))
add("resample_study", lambda s, d: rounded(E.in_range(E.spread(E.discrimination(E.unpivot_scores(
    S.resamples(s, d)["scores"], ("quality_score", "process_score"), ["draw_id", "passed"]), ["draw_id", "score_type"]),
    "auroc", ["score_type"]), PUBLISHED_AUROC, "score_type")))
add("resample_tiers", lambda s, d: rounded(E.in_range(E.resampled_tiers(S.resamples(s, d)["scores"].withColumn(
    "tier", A.revised_tier(F.col("quality_score"), F.col("passed")))), PUBLISHED_TIERS, "tier")))


def own_runs(s, d):
    return staged(s, "own_runs", d, lambda: E.over_draws(S.resamples(s, d)["scores"], S.own_run_waste(s, d), _KINDS, S.CELL))


add("evaluate_own_runs", own_runs)
add("own_run_rollup", lambda s, d: E.own_run_rollup(own_runs(s, d), _KINDS))

_RUNS = "SELECT DISTINCT CAST(user_id // 10 AS INTEGER) AS task_id, user_id AS trajectory_id, user_id % 10 < 6 AS passed FROM events"
_TEST = f"""run AS ({_RUNS}), rk AS (SELECT *, row_number() OVER (PARTITION BY task_id, passed ORDER BY md5('42:' || trajectory_id), trajectory_id) AS r FROM run),
test AS (SELECT task_id, trajectory_id, passed FROM (SELECT *, count(*) OVER (PARTITION BY task_id) AS n FROM rk WHERE r <= 2) WHERE n = 4),
pool AS (SELECT task_id, trajectory_id FROM run WHERE passed AND task_id IN (SELECT task_id FROM test) AND trajectory_id NOT IN (SELECT trajectory_id FROM test)),
drawn AS (SELECT task_id, draw_id, trajectory_id, row_number() OVER (PARTITION BY task_id, draw_id ORDER BY md5((42 + draw_id) || ':' || trajectory_id), trajectory_id) AS run_order
          FROM pool, (SELECT unnest(range(5)) AS draw_id))"""
add("study_test_runs", lambda s, d: S.test_runs(s, d), f"WITH {_TEST} SELECT * FROM test")
add("study_draws", lambda s, d: E.draw_grid(S._pool(s, d), max(S.COUNTS), S.DRAWS).select(
    "task_id", F.col("draw_id").cast("long"), "trajectory_id", F.col("run_order").cast("long")),
    f"WITH {_TEST} SELECT task_id, draw_id, trajectory_id, run_order FROM drawn WHERE run_order <= 8")
add("study_orders", lambda s, d: E.order_grid(S._pool(s, d), S.ORDER_K, S.COMBINATIONS, S.ORDERS).select(
    "task_id", F.col("draw_id").cast("long"), "trajectory_id", F.col("run_order").cast("long")).groupBy("task_id", "draw_id", "trajectory_id", "run_order")
    .agg(F.count(F.lit(1)).alias("orders")),
    f"""WITH {_TEST}, three AS (SELECT task_id, draw_id, list(trajectory_id ORDER BY trajectory_id) AS m FROM drawn WHERE run_order <= 3 AND draw_id < 4
      GROUP BY 1, 2 HAVING count(*) = 3), once AS (SELECT task_id, m, min(draw_id) AS draw_id FROM three GROUP BY 1, 2)
    SELECT task_id, draw_id, unnest(m) AS trajectory_id, o AS run_order, CAST(2 AS BIGINT) AS orders FROM once, (SELECT unnest(range(1, 4)) AS o)""")
