"""The best path over all paths against full listing, and runs that hold model requests."""

import random

import pandas as pd
from pyspark.sql import functions as F

from runloom.operators import features as X
from runloom.operators import matching as M
from runloom.operators import refgraph as G
from runloom.operators.best_path import Search, best_match_all


def _rank(path, rid, letter, hits, n, place):
    steps = [x for x in path if rid[x] is not None]
    matched = len(M.greedy_set([rid[x] for x in steps], hits, n)[0])
    return len({letter[x] for x in steps} - {"-"}), matched, matched / len(steps) if steps else 0, len(steps), -place


def _case(rng, acyclic, low, high):
    n = rng.randint(low, high)
    step = list(range(n)) if acyclic else sorted(rng.randint(0, n // 2) for _ in range(n))
    states = pd.DataFrame({"merged_id": range(n), "is_end": [rng.random() < 0.25 or i == n - 1 for i in range(n)]})
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b and step[b] >= step[a] and step[b] - step[a] < 4 and rng.random() < 0.7]
    rng.shuffle(pairs)
    edges = pd.DataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], columns=["edge_no", "src", "dst"])
    rid = {i: None if rng.random() < 0.1 else rng.randrange(5) for i in range(n)}
    letter = {i: rng.choice("EIV-") for i in range(n)}
    length = rng.choice([0, 1, 3, 8])
    hits = {r: sorted(rng.sample(range(length), rng.randint(1, length))) for r in range(5) if length and rng.random() < 0.6}
    return states, edges, rid, letter, hits, length


def test_best_path_equals_listing():
    rng, many = random.Random(21), 0
    for i in range(600):
        states, edges, rid, letter, hits, n = _case(rng, i % 3 > 0, 2, 9 if i % 3 == 0 else 15)
        listed = G._depth_first(states, edges, None)
        if len(listed) > 10_000:
            continue
        got = Search(G._Paths(states, edges), rid, letter).best(hits, n)
        want = max(enumerate(listed), key=lambda p: _rank(p[1], rid, letter, hits, n, p[0]), default=(0, []))[1]
        assert got == want, (i, got, want)
        many += len(listed) > 50
    assert many > 40


def test_a_run_on_a_late_path_is_found(spark):
    """Twelve diamonds: the run takes the last arm of each, so the first fifty paths miss most of it."""
    arms = [(3 * k, x) for k in range(12) for x in (3 * k + 1, 3 * k + 2)] + [(x, 3 * k + 3) for k in range(12) for x in (3 * k + 1, 3 * k + 2)]
    states = spark.createDataFrame([(0, i, i, "exploration", "t", "toolCall", f"s{i:02}", "", "") for i in range(37)],
                                   "task_id int, merged_id int, step int, intent_stage string, tool_used string, kind string, sig string, file_path string, path_arg string")
    edges = spark.createDataFrame([(0, n, a, b) for n, (a, b) in enumerate(sorted(arms))], "task_id int, edge_no int, src int, dst int")
    ids = M.reference_ids(states)
    want = [x for k in range(12) for x in (3 * k, 3 * k + 2)] + [36]
    hits = spark.createDataFrame([(0, 7, 25, list(range(25)), [i + 1 for i in want])],
                                 "task_id int, trajectory_id long, n_cand int, hit_seq array<int>, hit_rid array<int>")
    best = best_match_all(hits, states, edges, None, ids).first()
    assert [r - 1 for r in best.best.rids] == want and len(best.m.set_pos) == 25
    listed = G.enumerate_paths(states, edges, limit=50).join(states, ["task_id", "merged_id"])
    some = M.best_match(hits, M.reference_paths(listed, ids, ["task_id"])).first()
    assert len(some.m.set_pos) < 25


def test_requests_of_a_candidate_do_not_count(spark):
    kinds = ["request", "toolCall", "request", "toolCall", None]
    cand = spark.createDataFrame([(0, 7, i, 5, 0, k, f"s{i}") for i, k in enumerate(kinds)],
                                 "task_id int, trajectory_id long, seq long, n_steps long, chunk long, kind string, sig string")
    pairs = spark.createDataFrame([(0, "s3", "s3"), (0, "s4", "s4")], "task_id int, ref_sig string, cand_sig string")
    ids = spark.createDataFrame([(0, "s3", 1), (0, "s4", 2)], "task_id int, sig string, rid int")
    row = M.candidate_hits(X.actionable(cand), pairs, ids).first()
    assert (row.n_cand, row.hit_seq, row.hit_rid) == (3, [1, 2], [1, 2])
    assert X.actionable(cand).orderBy("seq").select(F.collect_list("seq")).first()[0] == [0, 1, 2]
