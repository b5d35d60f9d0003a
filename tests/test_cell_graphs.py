"""Graphs of many cells are those that ``refgraph`` makes of the same runs, from rows without texts."""

import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import cell_graphs as CG
from runloom.operators import evaluate as E
from runloom.operators import matching as M
from runloom.operators import refgraph as G
from runloom.operators import waste as W
from runloom.operators.equivalence import with_signature
from runloom.plans import dataset as D
from runloom.plans import studies as S
from runloom.plans.store import written

CELL = ["draw_id", "task_id"]


def _rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def both(spark, sf):
    runs, steps = D.runs(spark, sf), D.sig_steps(spark, sf)
    grid = E.draw_grid(runs.where("passed"), 3, 2)
    mapping = written(G.merge_cells(steps.join(grid.select("task_id", "trajectory_id").distinct(), ["task_id", "trajectory_id"], "left_semi"), grid, ["draw_id"]), "mapping")
    donor = mapping.select(*CELL, "trajectory_id", "run_order").distinct().join(steps, ["task_id", "trajectory_id"])
    raw = G.graph_states(donor, mapping.drop("run_order"), CELL)
    remap = written(G.consolidation(raw, CELL), "remap")
    states = written(with_signature(G.consolidate(raw, remap, CELL).drop("c", "sig")), "states")
    edges = written(G.clean_edges(G.graph_edges(donor, mapping.drop("run_order"), CELL), remap, raw, CELL), "edges")
    ends = G.remap_ids(G.run_terminals(mapping, CELL), remap, "merged_id", CELL)
    old = {"states": states, "edges": edges, "paths": written(G.enumerate_paths(states, edges, ends, CELL, limit=50), "paths"),
           "facts": G.path_facts(states, edges, ends, CELL)}
    narrow = written(CG.cell_steps(steps), "narrow")
    rows = written(CG.cell_rows(mapping, narrow, CELL), "rows")
    states, edges = written(CG.cell_states(rows, CELL), "cell_states"), CG.cell_edges(rows, CELL)
    graphs = written(CG.cell_graphs(states, edges, CELL, limit=50), "graphs")
    return old, {"states": states, "edges": edges, "graphs": graphs, "narrow": narrow}


def test_states_and_edges(both):
    old, new = both
    columns = [*CELL, "merged_id", "step", "seq", "n_steps", "intent_stage", "tool_used", "file_path", "sig", "trace_count", "files_touched", "trajectory_id"]
    assert old["states"].count() > 100 and _rows(old["states"], *columns) == _rows(new["states"], *columns)
    columns = [*CELL, "src", "dst", "action_type", F.col("edge_no").cast("int")]
    assert _rows(old["edges"], *columns) == _rows(new["edges"], *columns)


def test_paths_facts_and_references(both):
    old, new = both
    columns = [*CELL, "path_id", "pos", "merged_id"]
    assert _rows(old["paths"], *columns) == _rows(CG.cell_path_rows(new["graphs"], CELL), *columns)
    columns = [*CELL, "fact", "n", "merged_id", "tool", "pos"]
    assert _rows(old["facts"], *columns) == _rows(CG.cell_fact_rows(new["graphs"], CELL), *columns)
    ids = M.reference_ids(old["states"])
    refs = M.reference_paths(old["paths"].join(old["states"], [*CELL, "merged_id"]), ids, CELL)
    got = CG.cell_references(new["graphs"], CELL)
    assert refs.count() and _rows(refs, *CELL, "paths") == _rows(got, *CELL, "paths")
    assert _rows(ids, "task_id", "sig", "rid") == _rows(new["states"].select("task_id", "sig", "rid").distinct(), "task_id", "sig", "rid")


def test_cycles_of_listed_paths(both):
    old, new = both
    want = W.reference_cycles(old["paths"].join(old["states"], [*CELL, "merged_id"]), CELL)
    assert _rows(want, *CELL, "path_id", "pattern") == _rows(CG.cell_cycles(new["graphs"], CELL), *CELL, "path_id", "pattern")


@pytest.mark.parametrize("seed", range(3))
def test_repeats_are_the_cycles_of_windows(spark, seed):
    """Many overlapping cycles: two marks only."""
    rnd = random.Random(seed)
    paths = [[rnd.choice("ab") for _ in range(rnd.randint(2, 40))] for _ in range(30)]
    rows = [(0, r, i, len(p), 0, m, "", "") for r, p in enumerate(paths) for i, m in enumerate(p)]
    steps = spark.createDataFrame(rows, "task_id int, trajectory_id long, seq long, n_steps long, chunk long, tool_used string, file_path string, intent_stage string")
    found = W.with_pattern(W.raw_cycles(steps), steps).select("trajectory_id", "pattern").distinct().collect()
    got = {(r, p) for r, path in enumerate(paths) for n in W.PATTERN_LENGTHS for p in CG.repeats([f"{m}||" for m in path], n)}
    assert got == {(r.trajectory_id, r.pattern) for r in found} and len(got) > 20


def test_contents_are_those_of_the_states(both):
    old, new = both
    book = {r.sig: r.c for r in CG.cell_contents(new["narrow"]).distinct().collect()}
    assert all(book[r.sig] == r.c for r in old["states"].select("sig", "c").distinct().collect())


def test_requests_leave_the_references(spark):
    """A path loses its requests, keeps its number, and goes if nothing is left."""
    rows = [(1, 1, 0, 1, "read_file", False, "", "a", None), (1, 2, 1, 2, "", True, "", "", "request"), (1, 3, 2, 3, "edit", True, "", "b", None)]
    states = spark.createDataFrame(rows, "task_id int, merged_id int, step int, rid int, tool_used string, is_end boolean, intent_stage string, file_path string, kind string")
    edges = spark.createDataFrame([(1, 1, 2, 1), (1, 1, 3, 2)], "task_id int, src int, dst int, edge_no int")
    row = CG.cell_references(CG.cell_graphs(states, edges, ["task_id"]), ["task_id"]).first()
    assert [(p.path_id, p.rids, p.total) for p in row.paths] == [(0, [1], 1), (1, [1, 3], 2)]


def test_a_study_moves_no_texts(spark, sf):
    states = S.resamples(spark, sf)["states"]
    assert not {"observation", "args_json", "command", "content", "old_string", "new_string", "c"} & set(states.columns)
