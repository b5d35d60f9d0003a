import random

import pandas as pd
from pyspark.sql import functions as F

from runloom.operators import assess as A
from runloom.operators import evaluate as E
from runloom.operators import matching as M
from runloom.operators import refgraph as G
from runloom.streaming.incremental import match_buffer


def _set_loop(eq, m, n):
    used, out = set(), []
    for i in range(m):
        for j in range(n):
            if j not in used and (i == 0 or eq[i][j]):
                used.add(j)
                out.append((i, j))
                break
    return out


def _ordered_loop(eq, m, n):
    j, out = 0, []
    for i in range(m):
        while j < n and not (i == 0 or eq[i][j]):
            j += 1
        if j >= n:
            break
        out.append((i, j))
        j += 1
    return out


def test_greedy_matchers_agree_with_loops():
    rnd = random.Random(4)
    for _ in range(200):
        m, n = rnd.randrange(1, 9), rnd.randrange(1, 9)
        eq = [[rnd.random() < 0.3 for _ in range(n)] for _ in range(m)]
        hits = {i: [j for j in range(n) if eq[i][j]] for i in range(m)}
        path = list(range(m))
        assert list(zip(*M.greedy_set(path, hits, n))) == _set_loop(eq, m, n)
        assert list(zip(*M.greedy_ordered(path, hits, n))) == _ordered_loop(eq, m, n)
        assert len(M.greedy_set(path, hits, n)[0]) >= len(M.greedy_ordered(path, hits, n)[0])


def test_incremental_equals_whole_when_buffers_do_not_repeat():
    rnd = random.Random(5)
    for _ in range(100):
        path = [rnd.randrange(100, 104) for _ in range(6)]
        rids = [{rnd.randrange(100, 104)} for _ in range(12)]
        whole = match_buffer(path, rids, 0)[1]
        off, pos = 0, 0
        for size in (3, 4, 5):
            part = rids[pos:pos + size]
            skip = off > 0 and (off == 1 or path[off - 1] in part[0])
            _, off, _, skipped = match_buffer(path, part, off)
            assert bool(skipped) == skip
            pos += size
        assert off <= whole


def test_boundary_duplicate_is_skipped():
    assert match_buffer([1, 2, 3], [{2}, {3}], 2) == (1, 3, True, 1)
    assert match_buffer([1, 2, 3], [{9}, {3}], 2) == (1, 3, True, 0)


def _fold_loop(runs, equal):
    merged, out = [], []
    for r, run in enumerate(runs):
        base, pos = sorted(merged), 0
        for i, sid in enumerate(run):
            if r and pos < len(base) and (i == 0 or (base[pos][2], sid) in equal):
                out.append(base[pos][1])
                pos += 1
                continue
            merged.append((i, len(merged) + 1, sid))
            out.append(len(merged))
    return out


def test_merge_fold_matches_a_loop():
    rnd = random.Random(6)
    equal = {(a, a) for a in range(4)}
    for _ in range(50):
        runs = [[rnd.randrange(4) for _ in range(rnd.randrange(1, 8))] for _ in range(4)]
        rows = [(r, [(i, i, s) for i, s in enumerate(run)]) for r, run in enumerate(runs)]
        got = G._fold(rows, equal)
        assert [x[2] for x in got] == _fold_loop(runs, equal)
        for k in (1, 2, 3):  # the first runs' rows are the fold of these runs
            assert G._fold(rows[:k], equal) == [x for x in got if x[0] < k]


def test_cells_and_prefixes(spark):
    """Many cells of a task in one group give what each gives alone; prefixes are the smaller graphs."""
    from runloom.operators.equivalence import with_signature
    from runloom.plans import dataset as D
    d = "/root/testdata/sf0.001"
    steps = D.sig_steps(spark, d).where("task_id < 2")
    grid = E.draw_grid(D.runs(spark, d).where("task_id < 2 AND passed"), 4, 3)
    whole = G.merge_cells(steps, grid, ["draw_id"]).cache()
    some = G.prefixes(whole, (2, 4), ["draw_id", "task_id"]).where("k = 2").drop("k")
    alone = G.merge_cells(steps, grid.where("run_order <= 2"), ["draw_id"])
    assert sorted(map(tuple, some.select(alone.columns).collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)
    one = G.merge_runs(steps.join(grid.where("draw_id = 1"), ["task_id", "trajectory_id"]))
    assert sorted(map(tuple, whole.where("draw_id = 1").select(one.columns).collect()), key=str) == sorted(map(tuple, one.collect()), key=str)


def test_orders_are_distinct_and_complete():
    from math import factorial
    assert sorted(E.nth_order(n, 4) for n in range(24)) == sorted(map(list, __import__("itertools").permutations([1, 2, 3, 4])))
    assert factorial(4) == 24


def _all_paths(edges, root, ends, cap):
    out = []

    def go(node, path):
        if len(out) >= cap or node in path:
            return
        path = path + [node]
        if node in ends:
            out.append(path)
        for _, b in sorted((str(no), b) for no, a, b in edges if a == node):
            go(b, path)
    go(root, [])
    return out[:cap]


def test_path_listing_matches_recursion():
    rnd = random.Random(7)
    for _ in range(60):
        n = rnd.randrange(2, 8)
        pairs = sorted({(rnd.randrange(1, n + 1), rnd.randrange(1, n + 1)) for _ in range(14)})
        edges = [(i + 1, a, b) for i, (a, b) in enumerate(pairs) if a != b]
        ends = {rnd.randrange(1, n + 1)}
        s = pd.DataFrame({"merged_id": range(1, n + 1), "is_end": [i in ends for i in range(1, n + 1)]})
        e = pd.DataFrame(edges, columns=["edge_no", "src", "dst"])
        for cap in (2, 50):
            assert G._depth_first(s, e, cap) == _all_paths(edges, 1, ends, cap)


def test_scores_and_tiers(spark):
    rows = [(75.0, 0.75, True, 10.0), (60.0, 0.5, True, 0.0), (60.0, 0.5, False, 1.0), (29.0, 1.0, True, 5.0), (45.0, 0.6, True, 5.0), (65.0, 0.9, True, 0.0)]
    df = spark.createDataFrame(rows, "w double, c double, t boolean, b double")
    got = [r.v for r in df.select(A.verdict(F.col("w"), F.col("c"), F.col("t"), F.col("b")).alias("v")).collect()]
    assert got == ["PASS", "LIKELY PASS", "UNCERTAIN", "FAIL", "LIKELY FAIL", "LIKELY PASS"]
    q = spark.range(1).select(A.quality_score(F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(False)).alias("half"),
                              A.revised_tier(F.lit(70), F.lit(True)).alias("a"), A.revised_tier(F.lit(46), F.lit(True)).alias("b"),
                              A.revised_tier(F.lit(40), F.lit(False)).alias("c"), A.revised_tier(F.lit(39), F.lit(False)).alias("d")).first()
    assert (q.half, q.a, q.b, q.c, q.d) == (2, "ideal", "lucky", "partial_fail", "off_track")


def test_auroc_is_mann_whitney_and_single_class_drops(spark):
    rnd = random.Random(8)
    rows = [("g", float(rnd.randrange(20)), rnd.random() < 0.5) for _ in range(80)] + [("one", 1.0, True)]
    df = spark.createDataFrame(rows, "g string, score double, passed boolean")
    out = {r.g: r for r in E.discrimination(df, ["g"]).collect()}
    p = [s for g, s, ok in rows if g == "g" and ok]
    f = [s for g, s, ok in rows if g == "g" and not ok]
    u = sum((a > b) + 0.5 * (a == b) for a in p for b in f)
    assert set(out) == {"g"} and abs(out["g"].auroc - u / (len(p) * len(f))) < 1e-12
    r = out["g"]
    assert r.tp + r.fn == len(p) and r.fp + r.tn == len(f)


def test_counts_of_paths_that_share_their_way_are_those_of_each_path():
    rnd = random.Random(5)
    for _ in range(300):
        hits = {r: sorted(rnd.sample(range(12), rnd.randint(0, 6))) for r in range(6)}
        stem = [rnd.randrange(7) for _ in range(6)]
        paths = [stem[:rnd.randint(0, 6)] + [rnd.randrange(7) for _ in range(rnd.randint(0, 4))] for _ in range(6)]
        n = rnd.choice((0, 12))
        assert M.greedy_set_counts(paths, hits, n) == [len(M.greedy_set(p, hits, n)[0]) for p in paths]
