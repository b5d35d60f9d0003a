"""Path facts against full enumeration, and runs, documents and studies that must not get lost."""

import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import matching as M
from runloom.operators import refgraph as G
from runloom.sources import readers as R

STAGES = ["exploration", "implementation", "verification", ""]


def graphs(seed):
    """Random layered graphs, one with far more than fifty paths, one without any end."""
    rng, states, edges = random.Random(seed), [], []
    for g in range(8):
        n = 4 + g
        width = 3 if g == 7 else 2
        for i in range(n):
            states.append((g, i, i, rng.choice(STAGES), rng.choice(["read_file", "edit_file", "bash[x]", "llm", ""])))
        no = 0
        for i in range(n - 1):
            for j in {i + 1, *[rng.randint(i + 1, min(n - 1, i + width)) for _ in range(width)]}:
                edges.append((g, no, i, j))
                no += 1
    return states, edges


@pytest.fixture(scope="module")
def tables(spark):
    st, ed = graphs(3)
    states = spark.createDataFrame(st, "task_id int, merged_id int, step int, intent_stage string, tool_used string")
    edges = spark.createDataFrame(ed, "task_id int, edge_no int, src int, dst int")
    return states, edges, st


def test_facts_equal_the_listed_paths(spark, tables):
    states, edges, st = tables
    ends = states.groupBy("task_id").agg(F.max("merged_id").alias("merged_id")).unionByName(
        states.where("merged_id = 2").select("task_id", "merged_id")).distinct()
    info = {(g, i): (s, t.split("[")[0].strip()) for g, i, _, s, t in st}
    paths = {}
    for r in G.enumerate_paths(states, edges, ends).orderBy("task_id", "path_id", "pos").collect():
        paths.setdefault(r.task_id, {}).setdefault(r.path_id, []).append(r.merged_id)
    facts = {}
    for r in G.path_facts(states, edges, ends).collect():
        facts.setdefault((r.task_id, r.fact), []).append(r)
    for g, listed in paths.items():
        ordered = [listed[k] for k in sorted(listed)]
        assert facts[g, "total"][0].n == len(ordered)
        through = {r.merged_id: r.n for r in facts[g, "state"]}
        assert through == {n: sum(n in p for p in ordered) for n in {x for p in ordered for x in p}}
        for r in facts.get((g, "tool"), []):
            assert r.n == sum(any(info[g, n][1] == r.tool for n in p) for p in ordered)
        stages = lambda p: len({info[g, n][0] for n in p} - {""})
        best = {"canonical": max(ordered, key=lambda p: (stages(p), len(p))), "longest": max(ordered, key=len), "shortest": min(ordered, key=len)}
        for fact, path in best.items():
            got = [r.merged_id for r in sorted(facts[g, fact], key=lambda r: r.pos)]
            assert got in ordered
            assert (stages(got), len(got)) == (stages(path), len(path)) if fact == "canonical" else len(got) == len(path)


def test_more_than_fifty_paths(spark):
    """A ladder of 20 diamonds: a million paths are counted, listed up to a limit, or refused."""
    states = spark.createDataFrame([(0, i, i, STAGES[i % 4], "t") for i in range(61)], "task_id int, merged_id int, step int, intent_stage string, tool_used string")
    arms = [(3 * k, x) for k in range(20) for x in (3 * k + 1, 3 * k + 2)] + [(x, 3 * k + 3) for k in range(20) for x in (3 * k + 1, 3 * k + 2)]
    edges = spark.createDataFrame([(0, n, a, b) for n, (a, b) in enumerate(sorted(arms))], "task_id int, edge_no int, src int, dst int")
    facts = G.path_facts(states, edges)
    assert facts.where("fact = 'total'").first().n == 2 ** 20
    assert {r.merged_id for r in G.essential_states(facts).collect()} == set(range(0, 61, 3))
    assert [r.tool for r in G.required_tools(facts, strict=True).collect()] == ["t"]
    assert G.named_path(facts, "longest").count() == 41
    assert G.enumerate_paths(states, edges, limit=60).select("path_id").distinct().count() == 60
    with pytest.raises(Exception, match="more than 100 paths"):
        G.enumerate_paths(states, edges, budget=100).collect()


def test_run_without_a_reference_path_scores_zero(spark):
    hits = spark.createDataFrame([(1, 11, 3, [0, 1], [1, 2]), (2, 21, 4, [], [])],
                                 "task_id int, trajectory_id long, n_cand int, hit_seq array<int>, hit_rid array<int>")
    refs = spark.createDataFrame([(1, [(0, [1, 2], "EI", 2, 2, [], [])])],
                                 "task_id int, paths array<struct<path_id int, rids array<int>, stages string, n_stages int, total int, "
                                 "retry_sigs array<string>, multi_read array<string>>>")
    features = spark.createDataFrame([(1, 11, "EIV", 1.0), (2, 21, "EEIV", 0.5)], "task_id int, trajectory_id long, fingerprint string, coherence_score double")
    rows = {r.task_id: r for r in M.match_metrics(M.best_match(hits, refs), features).collect()}
    assert rows[1].coverage_percent == 100 and rows[1].n_paths == 1
    r = rows[2]
    assert (r.n_paths, r.coverage_percent, r.precision_percent, r.f1_score, r.weighted_score, r.stage_completeness) == (0, 0, 0, 0, 0, 0)
    assert not r.terminal_match and not r.perfect_match and r.missing_steps == []
    batch = {r.task_id: r for r in M.batch_compare(hits, refs).collect()}
    assert batch[2].coverage_percent == 0 and not batch[2].perfect_match


def test_positions_close_up_over_requests(spark):
    rows = [(1, 0, p, k) for p, k in enumerate(["toolCall", "request", "toolCall", None, "request", "toolCall"])]
    got = M.closed_positions(spark.createDataFrame(rows, "task_id int, path_id int, pos int, kind string")).orderBy("pos").collect()
    assert [(r.pos, r.kind) for r in got] == [(0, "toolCall"), (1, "toolCall"), (2, None), (3, "toolCall")]


TRACE = ('{"initial_state":"s0","states":{"s0":{"step":0},"s2":{"step":2,"log_entry":{"id":"b","kind":"request","model":"m"}},'
         '"s1":{"step":1,"log_entry":{"id":"a","kind":"toolCall","tool":"read_file","args":{"filePath":"a.py"}},"metadata":{"input_tokens":7}}},"transitions":[]}')
CHAT = '{"prompts":[{"logs":[{"id":"x","kind":"toolCall","tool":"read_file","args":{"filePath":"b.py"},"response":"ok"}]}]}'


def test_files_of_all_formats_are_read(spark, tmp_path):
    for name, text in (("t.json", TRACE), ("c.json", CHAT), ("bad.json", CHAT[:40]), ("none.json", '{"prompts": []}')):
        (tmp_path / name).write_text(text)
    raw = R.read_raw(spark, f"{tmp_path}/*.json")
    rows = R.load_any(raw.where("path LIKE '%/t.json' OR path LIKE '%/c.json'")).orderBy("source_format", "seq").collect()
    assert [(r.source_format, r.kind, r.path_arg, r.input_tokens) for r in rows] == [
        ("chatlog", "toolCall", "b.py", None), ("trace", "toolCall", "a.py", 7), ("trace", "request", None, None)]
    bad = {r.trajectory_id.rsplit("/", 1)[1]: r.reason for r in R.unreadable(raw).collect()}
    assert bad == {"bad.json": "no valid JSON", "none.json": "no entries"}


def test_documents_are_made_once_for_all_formats(spark):
    made = spark.sparkContext.accumulator(0)

    def make(text):
        made.add(1)
        return text
    raw = spark.createDataFrame([(f"/{i}.json", (TRACE, CHAT)[i % 2]) for i in range(10)], "path string, raw string")
    got = R.load_any(raw.withColumn("raw", F.udf(make)("raw"))).groupBy("source_format").count().collect()
    assert {r.source_format: r["count"] for r in got} == {"chatlog": 5, "trace": 10} and made.value == 10


def test_cyclic_graphs_against_listing():
    """Random graphs whose equal-step states form cycles: counts, tools and best paths of all simple paths."""
    import pandas as pd
    rng = random.Random(11)
    cyclic = 0
    for _ in range(400):
        step = sorted(rng.randint(0, 4) for _ in range(rng.randint(2, 10)))
        n = len(step)
        states = pd.DataFrame({"merged_id": range(n), "is_end": [rng.random() < 0.3 for _ in range(n)]})
        pairs = sorted({(a, b) for a in range(n) for b in range(n) if a != b and step[b] >= step[a] and rng.random() < 0.45})
        rng.shuffle(pairs)
        edges = pd.DataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], columns=["edge_no", "src", "dst"])
        stage = {i: rng.choice(STAGES) for i in range(n)}
        listed, g = G._depth_first(states, edges, None), G._Paths(states, edges)
        cyclic += any(len(p) > 1 for p in g.parts)
        total, used = g.through()
        assert total == len(listed)
        assert {k: v for k, v in used.items() if v} == {x: sum(x in p for p in listed) for x in {y for p in listed for y in p}}
        some = set(rng.sample(range(n), n // 2))
        assert g.onward(some)[g.root] == sum(not some & set(p) for p in listed)
        if listed:
            count = lambda p: len({stage[x] for x in p} - {""})
            assert g.best(stage, True) == max(listed, key=lambda p: (count(p), len(p)))
            assert g.best({}, True) == max(listed, key=len)
            assert g.best({}, False) == min(listed, key=len)
        else:
            assert g.best(stage, True) == []
    assert cyclic > 150


def test_large_cyclic_component_is_refused(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(G, "SUBSETS", 1000)
    states = pd.DataFrame({"merged_id": range(12), "is_end": [False] * 11 + [True]})
    edges = pd.DataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in range(12) for b in range(12) if a != b)], columns=["edge_no", "src", "dst"])
    with pytest.raises(G.PathBudgetExceeded):
        G._Paths(states, edges).through()
