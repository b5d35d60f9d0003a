"""The dataset build: steps -> donors -> reference graph -> matches -> reports -> annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators import assess as A
from runloom.operators import matching as M
from runloom.operators import refgraph as G
from runloom.operators import waste as Wt
from runloom.operators.best_path import best_match_all
from runloom.operators.equivalence import equivalence_pairs, with_signature
from runloom.operators.features import actionable
from runloom.operators.scan import spread
from runloom.plans.adapter import staged_steps
from runloom.plans.store import staged

DONORS = 3
#: Rows of run ids (three numbers each, some MB in all) that are broadcast to wide steps.
FEW_ROWS = 200_000
RUN = ["task_id", "trajectory_id"]
ANNOTATION_COLUMNS = {
    "task_id": "string", "model": "string", "trajectory_id": "string", "passed": "boolean", "n_states": "int",
    "quality_score": "int", "quality_tier": "string", "verdict": "string", "coverage_percent": "double",
    "precision_percent": "double", "f1_score": "double", "coherence_score": "double",
    "temporal_profile_score": "double", "workflow_similarity": "double", "stage_completeness": "double",
    "bottleneck_coverage": "double", "weighted_score": "double", "stage_coverage_E": "double",
    "stage_coverage_I": "double", "stage_coverage_V": "double", "stage_coverage_O": "double",
    "regression_loop_count": "int", "regression_loop_waste": "int", "blind_retry_count": "int",
    "blind_retry_waste": "int", "redundant_step_count": "int", "redundant_step_waste": "int",
    "unnecessary_exploration_count": "int", "unnecessary_exploration_waste": "int", "cyclic_pattern_count": "int",
    "cyclic_pattern_waste": "int", "total_wasted_steps": "int", "waste_severity": "double",
    "wasted_input_tokens": "long", "wasted_output_tokens": "long", "divergence_step": "int",
    "divergence_fraction": "double", "stage_order_match": "boolean", "failure_reasons": "string",
    "strengths": "string",
}


def runs_of(steps: DataFrame) -> DataFrame:
    return steps.groupBy("task_id", "trajectory_id").agg(
        F.first("model").alias("model"), F.first("passed").alias("passed"), F.count(F.lit(1)).alias("n_states"))


def reference_graph(steps: DataFrame, donors: DataFrame, keys: Sequence[str] = ("task_id",),
                    by_stage: bool = True) -> dict[str, DataFrame]:
    """All tables of the merged reference. ``steps`` carry ``c`` and ``sig``."""
    keys = list(keys)
    donor_steps = steps.join(donors, ["task_id", "trajectory_id"])
    mapping = G.merge_runs(donor_steps, keys)
    states = G.graph_states(donor_steps, mapping, keys)
    remap = G.consolidation(states, keys, by_stage)
    final = G.consolidate(states, remap, keys)
    edges = G.clean_edges(G.graph_edges(donor_steps, mapping, keys), remap, states, keys)
    return {"donor_steps": donor_steps, "mapping": mapping, "raw_states": states, "remap": remap,
            "states": final, "edges": edges,
            "terminals": G.remap_ids(G.run_terminals(mapping, keys), remap, "merged_id", keys)}


# --- staged tables over the event runs -----------------------------------------------------
def sig_steps(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "sig_steps", d, lambda: with_signature(staged_steps(s, d)))


def runs(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "runs", d, lambda: runs_of(staged_steps(s, d)))


def donors(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "donors", d, lambda: G.select_donors(runs(s, d), DONORS))


def mapping(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "mapping", d, lambda: G.merge_runs(donor_steps(s, d)))


def few(ids: DataFrame) -> DataFrame:
    """Ids of runs, staged: to be broadcast up to ``FEW_ROWS`` rows, so that wide steps meet them without a shuffle."""
    return F.broadcast(ids) if ids.count() <= FEW_ROWS else ids


def donor_steps(s: SparkSession, d: str) -> DataFrame:
    return sig_steps(s, d).join(few(donors(s, d)), RUN)


def raw_states(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "raw_states", d, lambda: G.graph_states(donor_steps(s, d), mapping(s, d)))


def remap(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "remap", d, lambda: G.consolidation(raw_states(s, d)))


def ref_states(s: SparkSession, d: str) -> DataFrame:
    """Final reference states: relabelled, with their comparison signature refreshed."""
    return staged(s, "ref_states", d, lambda: with_signature(
        G.consolidate(raw_states(s, d), remap(s, d)).drop("c", "sig")))


def ref_edges(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "ref_edges", d, lambda: G.clean_edges(
        G.graph_edges(donor_steps(s, d), mapping(s, d)), remap(s, d), raw_states(s, d)))


def ref_ends(s: SparkSession, d: str) -> DataFrame:
    return G.remap_ids(G.run_terminals(mapping(s, d)), remap(s, d))


def ref_paths(s: SparkSession, d: str) -> DataFrame:
    """The paths that runs are matched with: the first ones in depth-first order."""
    return staged(s, f"ref_paths_{G.MATCHED_PATHS}", d, lambda: G.enumerate_paths(
        ref_states(s, d), ref_edges(s, d), ref_ends(s, d), limit=G.MATCHED_PATHS))


def path_facts(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "path_facts", d, lambda: G.path_facts(ref_states(s, d), ref_edges(s, d), ref_ends(s, d)))


def path_states(s: SparkSession, d: str) -> DataFrame:
    return ref_paths(s, d).join(ref_states(s, d), ["task_id", "merged_id"])


def matched_path_states(s: SparkSession, d: str) -> DataFrame:
    """Path states as the matcher numbers them: without requests, positions closed up."""
    return M.closed_positions(path_states(s, d))


def candidates(s: SparkSession, d: str) -> DataFrame:
    """Runs that are no donors, in tasks that have a reference, without model requests.

    Steps without any request have no gaps to close, and next to few donors the choice is a filter: nothing is
    written then, and a reader takes the columns it needs from the steps."""
    steps, dn = sig_steps(s, d), donors(s, d)
    tasks, own = dn.select("task_id").distinct(), dn.select(*RUN)
    if dn.count() <= FEW_ROWS and steps.where(F.col("kind") == "request").isEmpty():
        return steps.join(F.broadcast(tasks), "task_id", "left_semi").join(F.broadcast(own), RUN, "left_anti")
    return staged(s, "candidates", d, lambda: actionable(
        steps.join(tasks, "task_id", "left_semi").join(own, RUN, "left_anti")))


def reference_rows(s: SparkSession, d: str) -> DataFrame:
    def build():
        ids = M.reference_ids(ref_states(s, d))
        return M.reference_paths(path_states(s, d), ids, ["task_id"])
    return staged(s, "reference_rows", d, build)


def hits(s: SparkSession, d: str) -> DataFrame:
    def build():
        ref, cand = ref_states(s, d), candidates(s, d)
        return M.candidate_hits(cand, equivalence_pairs(ref, cand), M.reference_ids(ref))
    return staged(s, "hits", d, build)


def match_run(s: SparkSession, d: str, strategy: str = "best_match") -> DataFrame:
    best = M.best_match(spread(hits(s, d)), reference_rows(s, d), ["task_id"], strategy)
    return M.match_metrics(best, M.run_features(candidates(s, d)))


def match_all_paths(s: SparkSession, d: str) -> DataFrame:
    """Every run with the best of all paths of its graph, which are not listed."""
    best = best_match_all(spread(hits(s, d)), ref_states(s, d), ref_edges(s, d), ref_ends(s, d), M.reference_ids(ref_states(s, d)))
    return M.match_metrics(best, M.run_features(candidates(s, d)))


def metrics(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "metrics", d, lambda: match_run(s, d))


def reports(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "reports", d, lambda: A.assess(metrics(s, d).join(
        runs(s, d).select(*RUN, "model", "passed"), RUN)))


def first_paths(s: SparkSession, d: str) -> DataFrame:
    return reference_rows(s, d).select("task_id", F.col("paths")[0].alias("first"))


def flags(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "flags", d, lambda: Wt.step_flags(candidates(s, d), reports(s, d)))


def cycles(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "cycles", d, lambda: Wt.cyclic_patterns(
        candidates(s, d), reports(s, d), Wt.reference_cycles(path_states(s, d))))


def wasted(s: SparkSession, d: str) -> DataFrame:
    return Wt.wasted_steps(flags(s, d), cycles(s, d))


def ref_files(s: SparkSession, d: str) -> DataFrame:
    return ref_states(s, d).where("file_path <> ''").select("task_id", "file_path").distinct()


def waste_summary(s: SparkSession, d: str) -> DataFrame:
    c, f = candidates(s, d), first_paths(s, d)
    return Wt.waste_summary(
        reports(s, d).select(*RUN, "n_cand"), Wt.waste_totals(wasted(s, d)), Wt.regression_loops(c, f),
        Wt.redundant_reads(c, f), Wt.unnecessary_exploration(flags(s, d), ref_files(s, d)), cycles(s, d))


def annotate(reports: DataFrame, waste: DataFrame) -> DataFrame:
    """The 40-column annotation row of every assessed run."""
    j = reports.join(waste.drop("n_cand"), RUN).withColumn("n_states", F.col("n_cand"))
    reasons = F.transform("failure_reasons", lambda r: F.struct(r["reason"], r["detail"], r["severity"]))
    derived = {
        "quality_tier": F.col("revised_tier"), "blind_retry_count": F.col("retry_loop_count"),
        "redundant_step_waste": F.col("redundant_step_count"),
        "unnecessary_exploration_waste": F.col("unnecessary_exploration_count"),
        "waste_severity": F.bround(F.col("total_wasted_steps") / F.greatest(F.col("n_states"), F.lit(1)), 4),
        "divergence_step": F.col("divergence_index") + 1,
        "divergence_fraction": F.bround((F.col("divergence_index") + 1) / F.col("n_states"), 4),
        "failure_reasons": F.when(F.size("failure_reasons") > 0, F.to_json(reasons)),
        "strengths": F.when(F.size("strengths") > 0, F.to_json("strengths")),
        **{f"stage_coverage_{x}": F.coalesce(f"stage_coverage_{x}", F.lit(0.0)) for x in "EIVO"},
    }
    return j.select(*[derived.get(c, F.col(c)).cast(t).alias(c) for c, t in ANNOTATION_COLUMNS.items()])


def annotations(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "annotations", d, lambda: annotate(reports(s, d), waste_summary(s, d)))


def task_summary(s: SparkSession, d: str) -> DataFrame:
    by = ["task_id"]
    r = runs(s, d).groupBy(*by).agg(F.count(F.lit(1)).alias("n_trajectories"), F.count_if("passed").alias("n_passing"),
                                    F.count_if(~F.col("passed")).alias("n_failing"))

    def n(df, name):
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    out = r
    for part in (n(donors(s, d), "n_donors"), n(reports(s, d), "n_assessed"), n(ref_states(s, d), "reference_states"),
                 n(ref_edges(s, d), "reference_edges")):
        out = out.join(part, by, "left")
    return out.fillna(0)
