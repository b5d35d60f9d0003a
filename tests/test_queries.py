"""Every registered query with check SQL equals it on the small tables; the rest return rows."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = ("label_intent", "coherence", "equivalence_join", "set_coverage", "alignment", "auroc", "read_chatlog", "soft_match_f1", "live_profile",
         "fold_pairs", "fold_stats", "ks_2samp", "study_test_runs", "study_draws", "study_orders")
STUDIES = ("holdout_scores", "merge_count_study", "merge_order_study", "merge_order_scores", "resample_study", "resample_tiers", "evaluate_own_runs", "own_run_rollup")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_check_sql(spark, sf, duck, name):
    df = entry_module.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([r[c] for c in cols]) for r in df.collect())
    cur = duck.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr([row[names.index(c)] for c in cols]) for row in cur.fetchall())
    assert sorted(names) == cols and got == want


@pytest.mark.parametrize("name", STUDIES)
def test_study_runs(spark, sf, name):
    rows = entry_module.queries()[name](spark, sf).collect()
    assert rows
    if name == "merge_count_study":  # test runs are fixed: every merge count scores the same tasks' test sets
        assert {r.k for r in rows} >= {2, 3, 4} and all(0 <= r.auroc_mean <= 1 for r in rows)
    if name == "resample_tiers":
        for passed in (True, False):
            assert abs(sum(r["mean"] for r in rows if r.passed == passed) - 100) < 1e-3
    if name == "merge_order_study":
        assert all(r.orders <= 6 * r.combinations for r in rows)


def test_every_check_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_annotations_layout(spark, sf):
    from runloom.plans.dataset import ANNOTATION_COLUMNS
    df = entry_module.queries()["annotations"](spark, sf)
    assert df.columns == list(ANNOTATION_COLUMNS) and len(df.columns) == 40
    for r in df.collect():
        assert 0 <= r.quality_score <= 100 and r.total_wasted_steps >= 0


def test_waste_by_tool_adds_up(spark, sf):
    q = entry_module.queries()
    by_tool = {}
    for r in q["waste_by_tool"](spark, sf).collect():
        assert r.retries + r.cycles + r.redundant + r.unnecessary == r.total_wasted
        by_tool[r.trajectory_id] = by_tool.get(r.trajectory_id, 0) + r.total_wasted
    for r in q["waste_summary"](spark, sf).collect():
        assert by_tool.get(r.trajectory_id, 0) == r.wasted_steps_distinct <= r.n_cand


def test_best_of_all_paths_is_no_worse_than_the_listed(spark, sf):
    rows = entry_module.queries()["match_all_paths"](spark, sf).collect()
    assert rows
    for r in rows:
        every = (r.n_stages, r.matched_count, r.coverage_percent)
        listed = (r.listed_stages, r.listed_matched_count, r.listed_coverage_percent)
        assert every >= listed and (r.n_paths > 50 or every == listed)


def test_indexed_soft_match_compares_fewer_pairs(spark, sf):
    rows = entry_module.queries()["embedding_baseline"](spark, sf).collect()
    assert rows and sum(r.compared for r in rows) < sum(r.pairs for r in rows)
