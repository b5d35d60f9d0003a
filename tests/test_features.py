import itertools
import random

from pyspark.sql import functions as F

from runloom.functions import commands as C
from runloom.functions import text as T
from runloom.operators import features as X
from runloom.operators import waste as W


def _lcs(a, b):
    dp = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, dp[j] = dp[j], prev + 1 if x == y else max(dp[j], dp[j - 1])
    return dp[-1]


def test_workflow_similarity(spark):
    rnd = random.Random(2)
    pairs = [("", ""), ("E", ""), ("", "V")] + [("".join(rnd.choices("EIVO", k=rnd.randrange(1, 90))),
                                                "".join(rnd.choices("EIVO", k=rnd.randrange(1, 90)))) for _ in range(60)]
    df = spark.createDataFrame([("→".join(a), b) for a, b in pairs], "a string, b string")
    got = [r.s for r in df.select(X.workflow_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    want = [1.0 if not a and not b else 0.0 if not a or not b else _lcs(a, b) / max(len(a), len(b)) for a, b in pairs]
    assert all(abs(g - w) < 1e-12 for g, w in zip(got, want))


def _steps(spark, seqs):
    rows = [(0, i, j, len(s), 0, tool, "", "exploration") for i, s in enumerate(seqs) for j, tool in enumerate(s)]
    return spark.createDataFrame(rows, "task_id int, trajectory_id int, seq long, n_steps long, chunk long, "
                                       "tool_used string, file_path string, intent_stage string")


def _cycles(s):
    out = []
    for p in (2, 3, 4):
        i = 0
        while i <= len(s) - 2 * p:
            reps, j = 1, i + p
            while s[j:j + p] == s[i:i + p] and j + p <= len(s):
                reps, j = reps + 1, j + p
            if reps >= 2:
                out.append((p, i, reps))
                i = j
            else:
                i += 1
    return sorted(out)


def test_cycles_match_a_greedy_scan(spark):
    rnd = random.Random(3)
    seqs = ["ABAB", "ABCABC", "AAAA", "ABABA", "A", "AABAABAAB"] + ["".join(rnd.choices("AB", k=rnd.randrange(2, 40))) for _ in range(60)]
    got = {}
    for r in W.raw_cycles(_steps(spark, seqs)).collect():
        got.setdefault(r.trajectory_id, []).append((r.plen, r.start, r.reps))
    for i, s in enumerate(seqs):
        assert sorted(got.get(i, [])) == _cycles(s), s


def test_blind_retries(spark):
    seqs = ["A" * n for n in (1, 2, 3, 4, 7)] + ["AABBBA"]
    got = {r.trajectory_id: r.blind_retries for r in X.blind_retries(_steps(spark, seqs)).collect()}
    assert [got[i] for i in range(6)] == [0, 0, 1, 2, 5, 1]


def test_uniform_runs_are_no_cycles(spark):
    st = _steps(spark, ["AAAA", "ABAB"])
    got = {(r.trajectory_id, r.uniform) for r in W.with_pattern(W.raw_cycles(st), st).collect()}
    assert got == {(0, True), (1, False)}


def test_command_rules(spark):
    cmds = ["cat a.py", "cat > a.py << 'EOF'", "cd /x && grep -r foo", "pytest -q", "git diff", "rm -rf out", "echo hi > /tmp/n",
            "python -c \"open('a','w').write('x')\"", "./run", "npm test", "sed -n 1,5p a", "sed -i s/a/b/ a.py"]
    c = F.col("c")
    df = spark.createDataFrame([(x,) for x in cmds], "c string").select(
        "c", C.is_test_command(c).alias("t"), C.is_exploration_command(c).alias("e"), C.is_orchestration_command(c).alias("o"),
        C.is_code_writing_command(c).alias("w"), C.is_verification_command(c).alias("v"))
    got = {r.c: "".join(k for k in "teowv" if r[k]) for r in df.collect()}
    assert got["cat a.py"] == "e" and got["cat > a.py << 'EOF'"] == "w" and got["cd /x && grep -r foo"] == "e"
    assert got["pytest -q"] == "t" and "o" in got["rm -rf out"] and "o" in got["echo hi > /tmp/n"]
    assert "w" in got["python -c \"open('a','w').write('x')\""] and got["./run"] == "v" and "w" in got["sed -i s/a/b/ a.py"]
    assert got["sed -n 1,5p a"] == "e" and got["npm test"] == "t"


def test_paths_and_symbols(spark):
    one = spark.range(1)
    r = one.select(T.norm_path(F.lit("//Workspace/tmp\\A.py")).alias("a"), T.norm_path_testbed(F.lit("/testbed/x/Y.py")).alias("b"),
                   T.norm_match_path(F.lit("/workspace/home/X.py")).alias("c"), T.norm_run_path(F.lit("C:\\u\\repo\\src\\a.py")).alias("d"),
                   T.norm_run_path(F.lit("/srv/p/a.py"), F.lit("srv/p/")).alias("e"),
                   T.symbols_from_description(F.lit("In 'a.py': renamed function 'x1' to 'y1'; functions: f, g")).alias("s"),
                   T.edit_type(F.lit(""), F.lit("a")).alias("t")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("tmp/a.py", "/x/Y.py", "home/x.py", "/src/a.py", "/a.py")
    assert set(r.s) == {"x1", "y1", "f", "g"} and r.t == "add"


def test_patch_hunks(spark):
    patch = "*** Update File: a.py\n@@\n ctx\n-old\n+new\n*** Update File: b.py\n+only"
    hunks = spark.range(1).select(T.patch_hunks(F.lit(patch)).alias("h")).first().h
    assert [(h.file, h.old_code, h.new_code) for h in hunks] == [("a.py", "ctx\nold", "ctx\nnew"), ("b.py", "", "only")]


def test_segments_of_short_runs(spark):
    st = _steps(spark, ["A", "AB", "ABCDEFG"])
    got = {r.trajectory_id: [r[c] for c in ("c0E", "c1E", "c2E")] for r in X.segment_counts(st).collect()}
    assert got == {0: [1, 0, 0], 1: [1, 1, 0], 2: [2, 2, 3]}
    assert list(itertools.chain(*got.values()))


def test_exact_ks_counts_paths():
    """All lattice paths by brute force for n, m up to 12 at every value that the statistic can take."""
    from fractions import Fraction
    from math import comb

    from runloom.operators.evaluate import paths_outside

    def inside(k, n, m):
        ways = {}
        for i in range(n + 1):
            for j in range(m + 1):
                if abs(i * m - j * n) < k:
                    ways[i, j] = 1 if not i and not j else ways.get((i - 1, j), 0) + ways.get((i, j - 1), 0)
        return ways.get((n, m), 0)
    for n in range(1, 13):
        for m in range(1, 13):
            for k in {abs(i * m - j * n) for i in range(n + 1) for j in range(m + 1)}:
                want = 1 - Fraction(inside(k, n, m), comb(n + m, n)) if k else 1
                assert abs(paths_outside(k, n, m) - float(want)) <= 1e-12 * max(1e-3, float(want)), (k, n, m)
    # Larger groups: near the series, also where counts exceed the range of doubles; tiny values keep digits.
    assert abs(paths_outside(2000 * 100, 2000, 2000) - 0.0134) < 2e-3
    assert 0 < paths_outside(60 * 60, 60, 60) == 2 / comb(120, 60) or abs(paths_outside(3600, 60, 60) * comb(120, 60) / 2 - 1) < 1e-9


def test_languages_of_style_sheets_and_markup():
    from runloom.functions.text import EXTENSION_LANGUAGE
    want = {"css": "css", "scss": "scss", "htm": "html", "xml": "xml", "md": "markdown"}
    assert {k: EXTENSION_LANGUAGE[k] for k in want} == want


def test_many_user_tools_are_joined_without_a_broadcast(spark, monkeypatch):
    from runloom.functions import registry as R
    names = R.tool_registry(spark).columns
    row = dict(zip(names, R.tool_registry(spark).first()))
    extra = spark.createDataFrame([tuple({**row, "tool": f"mine{i}"}.values()) for i in range(3)], R.tool_registry(spark).schema)
    df = spark.createDataFrame([("mine1",), ("other",), (None,)], "tool string")
    plain = sorted(map(str, R.with_descriptor(df, "tool", extra).collect()))
    monkeypatch.setattr(R, "BROADCAST_ROWS", 2)
    slim = R.with_descriptor(df, "tool", extra)
    assert sorted(map(str, slim.collect())) == plain and len(plain) == 3


def test_mix_percent_rounds_halves_up(spark):
    """Shares that end in exactly half a tenth, as the check SQL rounds them."""
    import duckdb

    from runloom.operators import profile as P
    cases = [(23, 80), (1, 16), (7, 80), (29, 80), (57, 80), (11, 16)]
    steps = spark.createDataFrame([(0, i, "exploration" if j < n else "verification") for i, (n, m) in enumerate(cases) for j in range(m)],
                                  "task_id int, trajectory_id int, intent_stage string")
    got = {r.trajectory_id: r.pct for r in P.stage_mix(steps).where("stage = 'exploration'").collect()}
    assert got == {i: duckdb.sql(f"SELECT round({n} * 100.0::DOUBLE / {m}, 1)").fetchall()[0][0] for i, (n, m) in enumerate(cases)}
    assert got[0] == 28.8


def test_flagged_steps_carry_no_texts(spark):
    """Flags of a run's steps come with what the rules read, not with the steps' texts or the reference."""
    steps = spark.createDataFrame(
        [(1, 7, i, 4, 0, tool, "a.py", stage, 5, 2, "long text") for i, (tool, stage) in enumerate(
            [("read_file", "exploration")] * 3 + [("run", "verification")])],
        "task_id int, trajectory_id long, seq long, n_steps long, chunk long, tool_used string, file_path string, intent_stage string, "
        "input_tokens long, output_tokens long, observation string")
    reports = spark.createDataFrame(
        [(1, 7, 4, ("EV", 2, []), ([0],))], "task_id int, trajectory_id long, n_cand int, best struct<stages: string, total: int, retry_sigs: array<string>>, "
        "m struct<al_seq: array<int>>")
    got = W.step_flags(steps, reports)
    assert set(got.columns) == {"task_id", "trajectory_id", "seq", *W.FLAGGED, "aligned", "is_retry", "retry_start", "is_backtrack",
                                "is_redundant", "is_late_exploration", "after_impl"}
    rows = got.orderBy("seq").collect()
    assert [(r.aligned, r.is_retry, r.retry_start, r.is_redundant, r.input_tokens) for r in rows] == [
        (True, False, False, False, 5), (False, False, False, True, 5), (False, True, True, True, 5), (False, False, False, False, 5)]
