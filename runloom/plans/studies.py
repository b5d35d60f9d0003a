"""Repeated-draw studies: every cell of (k, draw, order) is a key of one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators import assess as A
from runloom.operators import cell_graphs as CG
from runloom.operators import evaluate as E
from runloom.operators import matching as M
from runloom.operators import refgraph as G
from runloom.operators import waste as Wt
from runloom.operators.equivalence import contents, equivalence_pairs
from runloom.operators.scan import spread
from runloom.plans import dataset as D
from runloom.plans.store import staged

CELL = ["k", "draw_id", "perm_id", "task_id"]
RUN = ["task_id", "trajectory_id"]
#: Default grid: merge counts, draws per count, combinations and orders of the order study.
COUNTS, DRAWS, ORDER_K, COMBINATIONS, ORDERS = tuple(range(2, 9)), 5, 3, 4, 6


def graphs(s: SparkSession, d: str, tag: str, steps: DataFrame, grid: DataFrame, counts: Sequence[int]) -> dict[str, DataFrame]:
    """Reference graphs of every cell of ``grid`` (draw_id, perm_id, task_id, trajectory_id, run_order),
    once per merge count. Each cell is folded once; its prefixes are the smaller graphs."""
    cell = CELL[1:]
    chosen = staged(s, f"{tag}_donors", d, lambda: grid.select(*RUN).distinct())
    own = steps.join(D.few(chosen), RUN, "left_semi")
    folded = staged(s, f"{tag}_fold", d, lambda: G.merge_cells(own, grid, ["draw_id", "perm_id"]))
    mapping = G.prefixes(folded, counts, cell)
    narrow = staged(s, f"{tag}_steps", d, lambda: CG.cell_steps(own))
    rows = staged(s, f"{tag}_rows", d, lambda: CG.cell_rows(mapping, narrow, CELL))
    states = staged(s, f"{tag}_states", d, lambda: CG.cell_states(rows, CELL))
    edges = staged(s, f"{tag}_edges", d, lambda: CG.cell_edges(rows, CELL))
    graph = staged(s, f"{tag}_graphs", d, lambda: CG.cell_graphs(states, edges, CELL, limit=G.MATCHED_PATHS))
    refs = staged(s, f"{tag}_refs", d, lambda: CG.cell_references(graph, CELL))
    donors = G.prefixes(grid.select(*cell, "trajectory_id", "run_order"), counts, cell).select(*CELL, "trajectory_id")
    return {"mapping": donors, "states": states, "edges": edges, "paths": CG.cell_path_rows(graph, CELL), "facts": CG.cell_fact_rows(graph, CELL),
            "graphs": graph, "refs": refs, "contents": CG.cell_contents(narrow)}


def assessed(s: SparkSession, d: str, tag: str, g: dict[str, DataFrame], cand: DataFrame, who: DataFrame) -> DataFrame:
    """Match metrics of the runs in ``cand`` with every graph of their task; donors of a graph are left
    out of its rows. ``refs`` and ``contents`` of the graphs are made here if ``g`` has none."""
    states = g["states"]
    if "refs" in g:
        ids, refs = states.select("task_id", "sig", "rid").distinct(), g["refs"]
        book = contents(g["contents"], cand)
    else:
        ids, book = M.reference_ids(states), None
        refs = M.reference_paths(g["paths"].join(states, [*CELL, "merged_id"]), ids, CELL)
    # What a run brings is joined before it meets the graphs. Written first: ``spread`` counts the splits of a
    # table scan, but would run a plan with shuffles.
    hits = staged(s, f"{tag}_hits", d, lambda: M.candidate_hits(cand, equivalence_pairs(states, cand, book=book), ids)
                  .join(M.run_features(cand), RUN).join(who.select(*RUN, "model", "passed"), RUN))
    donors = g["mapping"].select(*CELL, "trajectory_id").groupBy(*CELL).agg(F.collect_set("trajectory_id").alias("donors"))
    best = M.best_match(spread(hits), refs.join(donors, CELL, "left"), CELL)
    return staged(s, f"{tag}_metrics", d, lambda: M.match_metrics(best, keys=CELL))


def scores(g: dict[str, DataFrame], cand: DataFrame, metrics: DataFrame) -> DataFrame:
    """Score columns of matched runs: structural is F1, process the share of the edited files of the
    graph, combined 0.7 and 0.3 of them; beside them the assessment's scores."""
    need = M.required_files(g["states"], CELL).groupBy(*CELL).agg(F.array_sort(F.collect_set("file")).alias("_need"))
    have = M.edited_files(cand).groupBy(*RUN).agg(F.collect_set("file").alias("_have"))
    m = metrics.join(need, CELL, "left").join(have, RUN, "left")
    share = F.coalesce(F.size(F.array_intersect("_need", F.coalesce("_have", F.array().cast("array<string>")))) / F.nullif(F.size("_need"), F.lit(0)), F.lit(1.0))
    structural, process = F.round("f1_score", 2), F.round(share * 100, 2)
    args = [F.col(c) for c in ("coverage_percent", "coherence_score", "stage_completeness", "workflow_similarity", "f1_score")]
    return m.select(*CELL, "trajectory_id", "model", "passed", structural.alias("structural"), process.alias("process"),
                    A.combined_score(structural, process, variant="merged").alias("combined"), "coverage_percent", "coherence_score",
                    "stage_completeness", "workflow_similarity", "temporal_profile_score", "weighted_score", "bottleneck_coverage",
                    A.quality_score(*args, F.col("passed")).alias("quality_score"), A.process_score(*args).alias("process_score"))


def _study(s: SparkSession, d: str, tag: str, grid, counts, chosen) -> dict[str, DataFrame]:
    steps = D.sig_steps(s, d)
    grid = staged(s, f"{tag}_grid", d, lambda: grid().select(*CELL[1:], "trajectory_id", F.col("run_order").cast("int").alias("run_order")))
    g = graphs(s, d, tag, steps, grid, counts)
    cand = steps.join(D.few(chosen.select(*RUN)), RUN, "left_semi")
    metrics = assessed(s, d, tag, g, cand, D.runs(s, d))
    return {**g, "cand": cand, "metrics": metrics, "scores": staged(s, f"{tag}_scores", d, lambda: scores(g, cand, metrics))}


def test_runs(s: SparkSession, d: str) -> DataFrame:
    return staged(s, "study_test", d, lambda: E.reserved_test(D.runs(s, d)))


def _pool(s: SparkSession, d: str) -> DataFrame:
    return E.donor_pool(D.runs(s, d), test_runs(s, d))


def merge_counts(s: SparkSession, d: str, counts: Sequence[int] = COUNTS, draws: int = DRAWS) -> dict[str, DataFrame]:
    """Graphs of 2 to 8 runs, as far as a task's pool goes, against the task's fixed test set."""
    return _study(s, d, f"counts-{min(counts)}-{max(counts)}-{draws}", lambda: E.draw_grid(
        _pool(s, d), max(counts), draws).withColumn("perm_id", F.lit(0)), counts, test_runs(s, d))


def merge_orders(s: SparkSession, d: str, k: int = ORDER_K, combinations: int = COMBINATIONS, orders: int = ORDERS) -> dict[str, DataFrame]:
    """Combinations of ``k`` donors in several orders each, against the fixed test set."""
    return _study(s, d, f"orders-{k}-{combinations}-{orders}", lambda: E.order_grid(_pool(s, d), k, combinations, orders), (k,), test_runs(s, d))


def resamples(s: SparkSession, d: str, k: int = D.DONORS, draws: int = DRAWS) -> dict[str, DataFrame]:
    """Draws of ``k`` donors from all passing runs; every run that is no donor of its graph is scored."""
    def grid():
        drawn = E.draw_grid(D.runs(s, d).where("passed"), k, draws)
        full = drawn.groupBy("task_id", "draw_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
        return drawn.join(full, ["task_id", "draw_id"], "left_semi").withColumn("perm_id", F.lit(0))
    return _study(s, d, f"resample-{k}-{draws}", grid, (k,), D.runs(s, d))


def holdout(s: SparkSession, d: str, train: int = 3, test_pass: int = 2, test_fail: int = 2, draws: int = DRAWS) -> dict[str, DataFrame]:
    """Graphs of donors from the train side of ``holdout_split``: its runs as they are, then samples of
    ``train`` runs from all passing runs outside the test side. Only the test side is scored."""
    split = staged(s, f"holdout-{train}-{test_pass}-{test_fail}_split", d, lambda: E.holdout_split(D.runs(s, d), train, test_pass, test_fail))
    test = split.where("split <> 'train'").select(*RUN, "passed")
    return _study(s, d, f"holdout-{train}-{test_pass}-{test_fail}-{draws}", lambda: E.draw_grid(
        E.donor_pool(D.runs(s, d), test), train, draws).withColumn("perm_id", F.lit(0)), (train,), test)


def own_run_waste(s: SparkSession, d: str) -> DataFrame:
    """Waste of every run against every graph of the resample study: cell, trajectory_id, and the counts
    and wasted steps of the five kinds."""
    r, keys = resamples(s, d), [*CELL, "trajectory_id"]
    metrics, cand = r["metrics"], r["cand"]
    first = r["refs"].select(*CELL, F.col("paths")[0].alias("first"))
    flags = staged(s, "resample_flags", d, lambda: Wt.step_flags(cand, metrics, keys))
    cycles = staged(s, "resample_cycles", d, lambda: Wt.cyclic_patterns(cand, metrics, CG.cell_cycles(r["graphs"], CELL), CELL, keys))
    files = r["states"].where("file_path <> ''").select(*CELL, "file_path").distinct()
    return staged(s, "resample_waste", d, lambda: Wt.waste_summary(
        metrics.select(*keys, "n_cand"), Wt.waste_totals(Wt.wasted_steps(flags, cycles, keys), keys), Wt.regression_loops(cand, first, CELL, keys),
        Wt.redundant_reads(cand, first, CELL, keys), Wt.unnecessary_exploration(flags, files, CELL, keys), cycles, keys))
