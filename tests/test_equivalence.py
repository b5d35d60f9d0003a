"""Blocked equivalence join against the cascade on every pair."""

import random

from pyspark.sql import functions as F

from runloom.operators.equivalence import cascade, contents, equivalence_pairs, with_signature, word_keys
from runloom.operators.intent import label_intent
from runloom.operators.normalize import ENTRY_FIELDS, states_from_entries
from runloom.plans.store import written


def _entries(spark, rows):
    cols = ["tool", "path_arg", "command", "query", "old_string", "new_string", "start_line", "end_line", "response", "kind"]
    names = ["task_id", "trajectory_id", "seq", "n_steps", "chunk", *cols]
    data = [("t", r["run"], i, len(rows), 0, *[r.get(c) for c in cols[:-1]], r.get("kind", "toolCall")) for i, r in enumerate(rows)]
    types = {"seq": "long", "n_steps": "long", "chunk": "long"}
    return spark.createDataFrame(data, ", ".join(f"{n} {types.get(n, ENTRY_FIELDS.get(n, 'string'))}" for n in names))


ROWS = [dict(tool="read_file", path_arg="a.py", start_line=1, end_line=10), dict(tool="read_file", path_arg="a.py", start_line=8, end_line=40),
        dict(tool="read_file", path_arg="a.py", start_line=5, end_line=12), dict(tool="read_file", path_arg="b.py"), dict(tool="view", path_arg="a.py"),
        dict(tool="run_in_terminal", command="grep -rn 'foo bar' src"), dict(tool="run_in_terminal", command="rg 'foo' src"),
        dict(tool="run_in_terminal", command="cat src/a.py"), dict(tool="run_in_terminal", command="head src/a.py"),
        dict(tool="run_in_terminal", command="cat"), dict(tool="run_in_terminal", command="python3 run.py"), dict(tool="bash", command="cd /x && python run.py"),
        dict(tool="grep_search", query="alpha beta gamma delta epsilon", response="[]"), dict(tool="grep_search", query="alpha", response="hit"),
        dict(tool="replace_string_in_file", path_arg="a.py", old_string="def f(x):\n  1", new_string="def f(x):\n  2"),
        dict(tool="replace_string_in_file", path_arg="a.py", old_string="def g(x):\n  1", new_string="def g(x):\n  2"),
        dict(tool="create_file", path_arg="a.py"), dict(tool="edit_file", path_arg="a.py", old_string="x", new_string="y"),
        dict(tool="think"), dict(kind="request", response="r"), dict(kind="request")]


def test_blocked_join_finds_every_equivalent_pair(spark):
    rows = [{**r, "run": "r0"} for r in ROWS]
    st = with_signature(label_intent(states_from_entries(_entries(spark, rows), confirm_last=False)))
    sig = st.select("task_id", "sig", "c").dropDuplicates(["sig"])
    a = sig.select(F.col("sig").alias("ref_sig"), F.col("c").alias("a"))
    b = sig.select(F.col("sig").alias("cand_sig"), F.col("c").alias("b"))
    brute = a.crossJoin(b).select("ref_sig", "cand_sig", cascade(F.col("a"), F.col("b")).alias("v")).where("v.equivalent")
    want = {(r.ref_sig, r.cand_sig, r.v.method) for r in brute.collect()}
    got = {(r.ref_sig, r.cand_sig, r.method) for r in equivalence_pairs(st, st).collect()}
    assert got == want and len(got) > len(ROWS) - 3


def test_word_prefixes_find_the_same_pairs_with_fewer_rows(spark):
    """Many searches and queries of overlapping words: all pairs decided, at most half of the rows of a join on every word."""
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(60)]

    def words(k):  # some words are far more frequent than others
        return " ".join(vocab[min(59, int(rng.expovariate(0.06)))] for _ in range(k))
    rows = []
    for _ in range(36):
        base = words(rng.randint(1, 14))
        rows.append(dict(tool="grep_search", query=base, response="[]"))
        if rng.random() < 0.5:
            rows.append(dict(tool="grep_search", query=base + " " + words(rng.randint(1, 2)), response="hit"))
        rows.append(dict(tool="run_in_terminal", command=f"grep -rn '{words(rng.randint(1, 6))}' src"))
    st = with_signature(label_intent(states_from_entries(_entries(spark, [{**r, "run": "r0"} for r in rows]), confirm_last=False)))
    sig = st.select("task_id", "sig", "c").dropDuplicates(["sig"]).cache()
    a, b = (sig.select(F.col("sig").alias(f"{n}_sig"), F.col("c").alias(x)) for n, x in (("ref", "a"), ("cand", "b")))
    want = {(r.ref_sig, r.cand_sig, r.v.method) for r in a.crossJoin(b).select("ref_sig", "cand_sig", cascade(F.col("a"), F.col("b")).alias("v"))
            .where("v.equivalent").collect()}
    assert {(r.ref_sig, r.cand_sig, r.method) for r in equivalence_pairs(st, st).collect()} == want

    def joined(every):
        k = word_keys(sig, sig, ["task_id"], every)
        one = k.where("side = 'ref'").select("task_id", "key")
        return one.join(k.where("side = 'cand'").select("task_id", "key"), ["task_id", "key"]).count()
    slim, full = joined(False), joined(True)
    print(f"rows joined on words: {full} on every word, {slim} on prefixes")
    assert 2 * slim <= full


def test_stage_gate_can_be_switched_off(spark):
    rows = [{**r, "run": "r0"} for r in ROWS]
    st = with_signature(label_intent(states_from_entries(_entries(spark, rows), confirm_last=False)))
    assert equivalence_pairs(st, st, use_stage=False).count() >= equivalence_pairs(st, st).count()


def test_contents_of_many_tasks_are_compared_once(spark):
    """Two tasks of the same contents have the pairs of one task each; no rows are sorted to find distinct contents."""
    rows = [{**r, "run": "r0"} for r in ROWS[:12]]
    st = written(with_signature(label_intent(states_from_entries(_entries(spark, rows), confirm_last=False))), "st")
    both = st.unionByName(st.withColumn("task_id", F.lit("u")))
    one, two = equivalence_pairs(st, st), equivalence_pairs(both, both)
    want = {(t, r.ref_sig, r.cand_sig, r.method) for t in "tu" for r in one.collect()}
    got = two.collect()
    assert len(got) == len(want) and {(r.task_id, r.ref_sig, r.cand_sig, r.method) for r in got} == want
    assert contents(both, both).count() == st.select("sig").distinct().count()
    assert "SortAggregate" not in contents(both, both)._jdf.queryExecution().executedPlan().toString()
