"""Verdicts, tiers, scores, reasons and rankings from match metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.features import LETTERS
from runloom.operators.intent import STAGES

IDEAL_MIN, LUCKY_MAX, PARTIAL_MIN = 70, 47, 40


def verdict(weighted: Column, completeness: Column, terminal: Column, bottleneck: Column) -> Column:
    """Five-step verdict, capped when a whole reference stage was missed."""
    likely = F.when(terminal, "LIKELY PASS").otherwise("UNCERTAIN")
    capped = F.when(weighted >= 60, likely).when(weighted >= 40, "LIKELY FAIL").otherwise("FAIL")
    return F.when((bottleneck == 0) & (completeness < 1), capped).otherwise(
        verdict_scored(weighted, completeness, terminal))


def verdict_scored(weighted: Column, completeness: Column, terminal: Column) -> Column:
    likely = F.when(terminal, "LIKELY PASS").otherwise("UNCERTAIN")
    return (F.when((weighted >= 75) & (completeness >= 0.75), "PASS")
            .when((weighted >= 60) & (completeness >= 0.5), likely)
            .when((weighted < 30) | (completeness < 0.25), "FAIL")
            .when(weighted < 50, "LIKELY FAIL").otherwise("UNCERTAIN"))


def verdict_unlabelled(coverage: Column, terminal: Column, process: Column, n_missing: Column) -> Column:
    likely = F.when(terminal, "LIKELY PASS").otherwise("UNCERTAIN")
    return (F.when((coverage < 40) & (n_missing >= 2), "FAIL")
            .when((process < 1) & ((n_missing >= 2) | (coverage < 60)), "LIKELY FAIL")
            .when(process < 1, "UNCERTAIN").when(coverage >= 80, "PASS").when(coverage >= 60, likely)
            .when(coverage >= 40, "UNCERTAIN").otherwise("LIKELY FAIL"))


def verdict_any(weighted, completeness, terminal, coverage, process, n_missing) -> Column:
    """Stage-aware verdict where labels exist, else the coverage ladder."""
    return F.when((weighted > 0) | (completeness > 0), verdict_scored(weighted, completeness, terminal)) \
        .otherwise(verdict_unlabelled(coverage, terminal, process, n_missing))


def verdict_legacy(coverage: Column, terminal: Column, process: Column, n_missing: Column,
                   task_valid: Column, task_score: Column) -> Column:
    """Coverage ladder that also weighs a task-validity check (null = not checked)."""
    valid, invalid = F.coalesce(task_valid, F.lit(False)), F.coalesce(~task_valid, F.lit(False))
    likely = F.when(terminal, "LIKELY PASS").otherwise("UNCERTAIN")
    return (F.when(invalid & (task_score <= 30), "FAIL").when((coverage < 40) & (n_missing >= 2), "FAIL")
            .when((process < 1) & ((n_missing >= 2) | (coverage < 60)), "LIKELY FAIL")
            .when(process < 1, "UNCERTAIN").when(coverage >= 80, "PASS").when(coverage >= 60, likely)
            .when((coverage >= 40) & valid & terminal, "LIKELY PASS")
            .when((coverage >= 40) & invalid, "LIKELY FAIL").when(coverage >= 40, "UNCERTAIN")
            .when(valid & (task_score >= 90), "UNCERTAIN").otherwise("LIKELY FAIL"))


def is_pass(v: Column) -> Column:
    return v.isin("PASS", "LIKELY PASS")


def quality_tier(v: Column, coverage: Column, coherence: Column, completeness: Column) -> Column:
    good = (F.when((coverage >= 70) & (coherence >= 0.6) & (completeness >= 0.75), "ideal")
            .when((coverage >= 50) & (coherence >= 0.4) & (completeness >= 0.5), "solid").otherwise("lucky"))
    bad = F.when((coverage >= 40) & (completeness >= 0.5), "partial_fail").otherwise("off_track")
    return F.when(is_pass(v), good).otherwise(bad)


def revised_tier(score: Column, passed: Column) -> Column:
    good = F.when(score >= IDEAL_MIN, "ideal").when(score < LUCKY_MAX, "lucky").otherwise("solid")
    return F.when(passed, good).when(score >= PARTIAL_MIN, "partial_fail").otherwise("off_track")


def raw_process_score(coverage, coherence, completeness, similarity, f1) -> Column:
    return (0.25 * coverage + 0.25 * (coherence * 100.0) + 0.18 * (completeness * 100.0)
            + 0.12 * (similarity * 100.0) + 0.10 * f1)


def _score(raw: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(raw).cast("int")))


def quality_score(coverage, coherence, completeness, similarity, f1, passed: Column | None = None) -> Column:
    """0-100 score with a tenth from the outcome (100, 0, or 50 when unknown)."""
    outcome = F.lit(50.0) if passed is None else F.when(passed, 100.0).when(~passed, 0.0).otherwise(50.0)
    return _score(raw_process_score(coverage, coherence, completeness, similarity, f1) + 0.10 * outcome)


def process_score(coverage, coherence, completeness, similarity, f1) -> Column:
    """The score without the outcome term, rescaled to 0-100."""
    return raw_process_score(coverage, coherence, completeness, similarity, f1) / 0.90


def combined_score(structural, process, coherence=None, temporal=None, variant: str = "weighted") -> Column:
    """``weighted`` (four parts), ``merged`` (0.7/0.3) or ``mean`` of structural and process."""
    if variant == "weighted":
        return 0.20 * structural + 0.15 * process + 0.30 * (coherence * 100.0) + 0.35 * (temporal * 100.0)
    if variant == "merged":
        return 0.7 * structural + 0.3 * process
    if variant == "mean":
        return (structural + process) / 2.0
    raise ValueError(f"unknown variant: {variant}")


def _pct(c: Column) -> Column:
    return F.concat(F.rint(c).cast("int").cast("string"), F.lit("%"))


def _ratio(x: str) -> Column:
    return F.concat(F.lit("("), F.col(f"matched_{x}").cast("string"), F.lit("/"), F.col(f"total_{x}").cast("string"))


def failure_reasons() -> Column:
    """Array of (rank, reason, detail, severity), worst first."""
    share = F.col("divergence_index") / F.col("total_ref_states")
    v, i = F.col("stage_coverage_V"), F.col("stage_coverage_I")

    def reason(when, order, name, detail, severity):
        rank = F.when(severity == "critical", 0).when(severity == "high", 1).otherwise(2)
        return F.when(when, F.struct(rank.alias("rank"), F.lit(order).alias("order"), F.lit(name).alias("reason"),
                                     detail.alias("detail"), severity.alias("severity")))
    found = F.array_compact(F.array(
        reason(share < 0.4, 1, "early_divergence", F.concat(
            F.lit("Diverged at step "), (F.col("divergence_index") + 1).cast("string"), F.lit(" of "),
            F.col("total_ref_states").cast("string"), F.lit(" reference steps ("), _pct(share * 100), F.lit(" through)")),
            F.lit("critical")),
        reason(v < 25, 2, "missing_verification", F.concat(
            F.lit("Verification coverage is "), _pct(v), F.lit(" "), _ratio("V"), F.lit(" steps).")), F.lit("high")),
        reason(i < 50, 3, "incomplete_implementation", F.concat(
            F.lit("Only "), _pct(i), F.lit(" of implementation steps covered "), _ratio("I"), F.lit(")")),
            F.when(i < 25, "high").otherwise("medium")),
        reason(F.col("coherence_score") < 0.35, 4, "trajectory_thrashing", F.concat(
            F.lit("Coherence score is "), F.format_number("coherence_score", 2)), F.lit("medium"))))
    low = reason(F.col("coverage_percent") < 30, 5, "low_coverage", F.concat(
        F.lit("Only "), _pct(F.col("coverage_percent")), F.lit(" of reference steps matched.")), F.lit("high"))
    return F.when(F.size(found) > 0, F.array_sort(found)).otherwise(F.array_compact(F.array(low)))


def strengths() -> Column:
    parts = [F.when(F.col(f"stage_coverage_{x}") >= 80, F.concat(
        F.lit(f"Strong {s} phase ("), _pct(F.col(f"stage_coverage_{x}")), F.lit(" covered)")))
        for x, s in zip(LETTERS, STAGES)]
    parts += [F.when(F.col("coherence_score") >= 0.7, F.lit("Clean forward progression (high coherence)")),
              F.when(F.col("terminal_match"), F.lit("Reached correct terminal state"))]
    return F.array_compact(F.array(*parts))


def stage_order_match(candidate: Column, reference: Column) -> Column:
    """First occurrences of E, I, V in the candidate form a subsequence of the reference order."""
    def order(letters):
        seen = F.array_sort(F.filter(F.array(*[F.struct(F.instr(letters, x).alias("at"), F.lit(x).alias("x"))
                                               for x in "EIV"]), lambda s: s["at"] > 0))
        return F.transform(seen, lambda s: s["x"])
    c, r = order(candidate), order(reference)
    at = F.transform(c, lambda x: F.array_position(r, x))
    return F.forall(at, lambda p: p > 0) & (F.array_sort(at) == at)


def assess(metrics: DataFrame, passed: str = "passed") -> DataFrame:
    """Add verdict, tiers, scores, reasons, strengths and stage-order agreement."""
    c, coh, comp = F.col("coverage_percent"), F.col("coherence_score"), F.col("stage_completeness")
    sim, f1 = F.col("workflow_similarity"), F.col("f1_score")
    letters = F.regexp_replace(F.coalesce("fingerprint", F.lit("")), "[^EIVO]", "")
    df = metrics.withColumn("verdict", verdict(F.col("weighted_score"), comp, F.col("terminal_match"),
                                               F.col("bottleneck_coverage")))
    score = quality_score(c, coh, comp, sim, f1, F.col(passed))
    none = F.array().cast("array<struct<rank:int,order:int,reason:string,detail:string,severity:string>>")
    return df.select(
        "*", quality_tier(F.col("verdict"), c, coh, comp).alias("quality_tier"), score.alias("quality_score"),
        process_score(c, coh, comp, sim, f1).alias("process_score"),
        revised_tier(score, F.col(passed)).alias("revised_tier"),
        F.when(is_pass(F.col("verdict")), none).otherwise(failure_reasons()).alias("failure_reasons"),
        strengths().alias("strengths"), stage_order_match(letters, F.col("best.stages")).alias("stage_order_match"))


def divergence_point(reports: DataFrame, path_states: DataFrame, cand: DataFrame,
                     keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Expected reference step at the first miss, and the first unaligned candidate step."""
    keys = list(keys)
    first_free = F.array_min(F.array_except(F.sequence(F.lit(0), F.col("n_cand") - 1), F.col("m.al_seq")))
    d = reports.where(F.col("divergence_index").isNotNull()).select(
        *keys, "trajectory_id", F.col("best_path").alias("path_id"), F.col("divergence_index").alias("pos"),
        first_free.cast("long").alias("seq"))

    def told(tool, file, default):
        name = F.coalesce(F.nullif(tool, F.lit("")), F.lit(default))
        return F.when(F.coalesce(file, F.lit("")) != "", F.concat(name, F.lit(" on "), file)).otherwise(name)
    ref = path_states.select(*keys, "path_id", "pos", told(F.col("tool_used"), F.col("file_path"), "unknown").alias("expected"))
    did = cand.select(*keys, "trajectory_id", "seq", told(F.col("tool_used"), F.col("file_path"), "unknown action").alias("actual"))
    return d.join(ref, [*keys, "path_id", "pos"]).join(did, [*keys, "trajectory_id", "seq"], "left").select(
        *keys, "trajectory_id", (F.col("pos") + 1).alias("step"), "expected",
        F.coalesce("actual", F.lit("(no matching candidate step)")).alias("actual"))


def divergence_segments(reports: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Runs of consecutive missed reference positions with their dominant stage and the
    candidate steps at the proportional place. Works on the short missing array of each run."""
    keys = list(keys)
    miss = F.col("missing_steps")
    starts = F.filter(miss, lambda x: ~F.array_contains(miss, x - 1))
    ends = F.filter(miss, lambda x: ~F.array_contains(miss, x + 1))
    s = reports.select(*keys, "trajectory_id", "n_cand", "m", "best", F.explode(F.arrays_zip(
        starts.alias("s"), ends.alias("e"))).alias("_g"))
    a, b, size, n = F.col("_g.s"), F.col("_g.e"), F.col("best.total"), F.col("n_cand")
    piece = F.substr(F.col("best.stages"), a + 1, b - a + 1)
    counts = F.array(*[F.struct((F.length(piece) - F.length(F.replace(piece, F.lit(x), F.lit("")))).alias("n"),
                                (-F.instr(piece, x)).alias("first"), F.lit(st).alias("stage"))
                       for x, st in zip(LETTERS, STAGES)])
    top = F.array_max(counts)
    lo = F.floor(a / size * n).cast("int")
    hi = F.least(F.floor((b + 1) / size * n).cast("int") + 1, n)
    busy = F.when(hi > lo, F.size(F.array_except(F.sequence(lo, hi - 1), F.col("m.al_seq")))).otherwise(0)
    return s.select(*keys, "trajectory_id", (a + 1).alias("start_step"), (b + 1).alias("end_step"),
                    F.when(top["n"] > 0, top["stage"]).otherwise("").alias("stage_context"),
                    busy.alias("candidate_steps"))


def stage_comparison(reports: DataFrame, cand: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Per run and stage: expected, matched, missing and extra steps, the effort ratio, the step
    lists, and whether the aligned steps of the stage keep the reference's order.

    Lists hold 1-based positions: ``matched_steps`` and ``missing_steps`` of the reference path,
    ``extra_steps`` of the run. They are as long as one path and one run.
    """
    keys = list(keys)

    def at_stage(places, letter):
        return F.transform(F.filter(places, lambda p: F.substr("best.stages", p + 1, F.lit(1)) == letter), lambda p: p + 1)

    def in_order(letter):
        pairs = F.filter(F.arrays_zip(F.col("m.set_pos").alias("p"), F.col("m.set_seq").alias("s")),
                         lambda z: F.substr("best.stages", z["p"] + 1, F.lit(1)) == letter)
        seqs = F.transform(pairs, lambda z: z["s"])
        return F.array_sort(seqs) == seqs
    rows = reports.select(*keys, "trajectory_id", F.inline(F.array(*[F.struct(
        F.lit(s).alias("stage"), F.col(f"total_{x}").alias("expected"), F.col(f"matched_{x}").alias("matched"),
        at_stage("m.set_pos", x).alias("matched_steps"), at_stage("missing_steps", x).alias("missing_steps"),
        in_order(x).alias("ordering_preserved")) for x, s in zip(LETTERS, STAGES)])))
    al = reports.select(*keys, "trajectory_id", F.explode("m.al_seq").alias("seq")).select(
        *keys, "trajectory_id", F.col("seq").cast("long").alias("seq"), F.lit(True).alias("_al"))
    done = cand.join(al, [*keys, "trajectory_id", "seq"], "left").groupBy(
        *keys, "trajectory_id", F.col("intent_stage").alias("stage")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_al").isNull()).alias("_x"),
        F.sort_array(F.collect_list(F.when(F.col("_al").isNull(), F.col("seq").cast("int") + 1))).alias("extra_steps"))
    j = rows.join(done, [*keys, "trajectory_id", "stage"], "left").fillna(0, ["_n", "_x"])
    return j.select(*keys, "trajectory_id", "stage", "expected", "matched",
                    (F.col("expected") - F.col("matched")).alias("missing"), F.col("_x").alias("extra"),
                    "ordering_preserved", "matched_steps", "missing_steps",
                    F.coalesce("extra_steps", F.array().cast("array<int>")).alias("extra_steps"),
                    F.when(F.col("expected") > 0, F.col("_n") / F.col("expected")).otherwise(0.0).alias("effort_ratio"))


def quality_signals(exploration_effort: Column) -> Column:
    """Array of (signal, severity) from assessed metrics joined with waste counts."""
    passed = F.coalesce(F.col("passed"), is_pass(F.col("verdict")))
    failed = F.coalesce(~F.col("passed"), F.col("verdict").isin("FAIL", "LIKELY FAIL"))
    v = (F.col("total_V") > 0) & (F.col("stage_coverage_V") < 25)
    wasted, coh, cov = F.col("wasted_steps_distinct"), F.col("coherence_score"), F.col("coverage_percent")

    def sig(when, name, severity):
        sev = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(when, F.struct(F.lit(name).alias("signal"), sev.alias("severity")))
    partial = failed & (cov >= 40) & (F.col("stage_completeness") >= 0.5)
    return F.array_compact(F.array(
        sig(passed & (wasted > 0) & ((wasted / F.greatest(F.col("n_cand"), F.lit(1)) > 0.2) | (coh < 0.5)),
            "inefficient_path_despite_success", "warning"),
        sig(v & failed, "missing_verification", "critical"), sig(v & ~failed, "low_verification", "warning"),
        sig(~F.col("stage_order_match"), "stage_order_differs", F.when(failed, "critical").otherwise("info")),
        sig(exploration_effort > 2.0, "excessive_exploration", "warning"),
        sig((F.col("total_O") > 0) & (F.col("matched_O") == 0), "missing_planning", "info"),
        sig(passed & (coh >= 0.7) & (cov >= 70) & (F.col("stage_completeness") >= 0.75) & (wasted == 0),
            "clean_ideal_pass", "info"),
        sig(partial, "incomplete_coverage", "warning"), sig(~partial & passed & (cov < 70), "low_gt_coverage", "info")))


def rank_in_cohort(reports: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Rank by score inside the passing and failing verdict groups of a cohort.

    Ranks add the number of better scores, counted per score value (at most 101 per
    group), to the place among equal scores ordered by run id, so no cohort is sorted whole.
    """
    keys = list(keys)
    r = reports.select(*keys, "trajectory_id", "quality_score", "quality_tier",
                       is_pass(F.col("verdict")).alias("passing"),
                       F.coalesce(F.get("failure_reasons", F.lit(0))["reason"], F.lit("")).alias("top_reason"))
    g = [*keys, "passing"]
    per_score = r.groupBy(*g, "quality_score").agg(F.count(F.lit(1)).alias("_n"))
    better = Window.partitionBy(*g).orderBy(F.desc("quality_score")).rowsBetween(Window.unboundedPreceding, -1)
    per_score = per_score.withColumn("_better", F.coalesce(F.sum("_n").over(better), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*g, "quality_score").orderBy("trajectory_id"))
    return r.withColumn("_p", place).join(per_score, [*g, "quality_score"]).select(
        *keys, "trajectory_id", "quality_score", "quality_tier", "passing", "top_reason",
        (F.col("_better") + F.col("_p")).alias("rank"))


def cohort_summary(reports: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    keys = list(keys)
    good = is_pass(F.col("verdict"))
    return reports.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("passing_count"),
        F.count_if(~good).alias("failing_count"),
        *[F.count_if(F.col("quality_tier") == t).alias(f"{t}_count")
          for t in ("ideal", "solid", "lucky", "partial_fail", "off_track")])


def reason_counts(reports: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    top = F.get("failure_reasons", F.lit(0))["reason"]
    return reports.where(top.isNotNull()).groupBy(*keys, top.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
