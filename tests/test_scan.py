"""Chunked scans must not depend on the chunk size."""

import random

from pyspark.sql import functions as F

from runloom.operators.scan import lagged, number_rows, running


def _rows(spark, n=200):
    rnd = random.Random(1)
    rows = [(0, 0 if rnd.random() < 0.5 else rnd.randrange(5), i, rnd.randrange(10)) for i in range(n)]
    return spark.createDataFrame(rows, "task_id int, trajectory_id int, t int, v int"), rows


def test_numbering_lag_and_running_match_a_loop(spark):
    df, rows = _rows(spark)
    for chunk in (3, 7, 4096):
        n = number_rows(df, ["task_id", "trajectory_id"], ["t"], F.floor(F.col("t") / 11), chunk)
        n = lagged(n, {"l1": ("v", 1), "l2": ("v", 2), "n1": ("v", -1)}, chunk_rows=chunk)
        n = running(n, {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, chunk_rows=chunk)
        got = {(r.trajectory_id, r.t): (r.seq, r.n_steps, r.l1, r.l2, r.n1, r.s, r.m) for r in n.collect()}
        want = {}
        for traj in range(5):
            mine = [r for r in rows if r[1] == traj]
            v = [r[3] for r in mine]
            for i, r in enumerate(mine):
                want[(traj, r[2])] = (i, len(v), v[i - 1] if i else None, v[i - 2] if i > 1 else None,
                                      v[i + 1] if i + 1 < len(v) else None, sum(v[:i]), max(v[:i], default=None))
        assert got == want


def test_one_key_holding_most_rows_is_split(spark):
    df = spark.range(5000).select(F.lit(0).alias("task_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1)
                                  .alias("trajectory_id"), F.col("id").alias("t"))
    n = number_rows(df, ["task_id", "trajectory_id"], ["t"], F.floor(F.col("t") / 100), 256)
    hot = n.where("trajectory_id = -1")
    assert hot.select("seq").distinct().count() == hot.count() == 3333
    assert hot.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 256


def test_labels_do_not_depend_on_the_chunk_size(spark, sf):
    from runloom.operators.intent import label_intent
    from runloom.operators.normalize import rechunk
    from runloom.plans.adapter import staged_steps
    whole = staged_steps(spark, sf)
    cut = label_intent(rechunk(whole.drop("intent_stage"), 7), chunk_rows=7)
    keys = ["task_id", "trajectory_id", "seq", "intent_stage"]
    assert cut.select(keys).exceptAll(whole.select(keys)).count() == 0 and cut.count() == whole.count()
    assert cut.select("chunk").distinct().count() > 5
