"""Reference graphs of very many cells: the merged runs of a study's draws and orders.

The rules are those of ``refgraph``: merge, consolidate, relabel, clean edges, list paths, count paths.
A run is in many cells and a cell's graph is as small as its few runs, so the layout differs:

* What a state takes from its step is worked out once per step (``cell_steps``): the stage it would get
  in each situation and the signature that goes with it. Cells only find the situation. Texts, arguments
  and compared contents stay with the steps.
* Rows are hashed by ``keys`` (the task), not by cell. A task has a fixed number of cells of k runs each,
  whatever its population. Every window and aggregate by cell then works in place, and the copies of a
  step in the cells of a task lie side by side, where a shuffle compresses them.
* A graph is one row of arrays for the walkers, and its paths are places in its array of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from runloom.functions.text import blank
from runloom.operators.intent import NEAR_END, stage_letter, stage_of, written_files
from runloom.operators.refgraph import _depth_first, _Paths, effect_group
from runloom.operators.scan import CHUNK_ROWS, by_group
from runloom.operators.waste import PATTERN_LENGTHS

TASK = ("task_id",)
#: Situations of a state: implemented before, its file written before (so implemented before), near the end.
SITUATIONS = [(done, written, late) for done, written in ((False, False), (True, False), (True, True)) for late in (False, True)]
# What the states of a graph keep of the step that made them.
KEPT = ("step", "kind", "tool_used", "file_path", "path_arg")
INTS = ArrayType(IntegerType())
FACTS = StructType([StructField("total", DoubleType()), StructField("state", INTS), StructField("state_n", ArrayType(DoubleType())),
                    StructField("tool", ArrayType(StringType())), StructField("tool_n", ArrayType(DoubleType()))]
                   + [StructField(n, INTS) for n in ("canonical", "longest", "shortest")])
CYCLES = ArrayType(StructType([StructField("path_id", IntegerType()), StructField("pattern", StringType())]))


def cell_steps(steps: DataFrame, keys: Sequence[str] = TASK) -> DataFrame:
    """Steps (with ``c`` and ``sig``) as graphs of cells need them: keys, trajectory_id, seq, ``KEPT``, files_touched,
    resulting_state, intent_stage, action, and what labelling takes from the step alone: ``stages`` by situation,
    ``signed`` (every such stage with the signature it gives), ``c``, ``written`` files and ``trigger``."""
    files, trigger = written_files()
    stages = F.array(*[stage_of(*map(F.lit, s)) for s in SITUATIONS])
    action = F.when(F.col("kind") == "toolCall", F.coalesce(F.nullif(blank("tool_used"), F.lit("")), F.lit("unknown_tool"))).otherwise("request")
    df = steps.select(*keys, "trajectory_id", "seq", *KEPT, "files_touched", "resulting_state", "intent_stage", "c", "sig",
                      action.alias("action"), stages.alias("stages"), files.alias("written"), trigger.alias("trigger"))

    def signed(stage: Column) -> Column:
        named = F.coalesce(stage, F.lit(""))
        fresh = F.md5(F.to_json(F.col("c").withField("stage", named)).cast("binary"))
        return F.struct(stage.alias("stage"), F.when(named == F.col("c.stage"), F.col("sig")).otherwise(fresh).alias("sig"))
    return df.withColumn("signed", F.transform(F.array_distinct("stages"), signed)).drop("sig")


def cell_contents(steps: DataFrame) -> DataFrame:
    """Contents that states made of ``cell_steps`` may have: sig, c."""
    one = steps.select("c", F.explode("signed").alias("_s"))
    return one.select("_s.sig", F.col("c").withField("stage", F.coalesce("_s.stage", F.lit(""))).alias("c"))


def cell_rows(mapping: DataFrame, steps: DataFrame, cell: Sequence[str], keys: Sequence[str] = TASK) -> DataFrame:
    """Rows of ``mapping`` (cell, trajectory_id, run_order, seq, merged_id, is_new) with the state that each is
    consolidated into (``canonical`` and its step), whether it is the last of its run, and its step."""
    rows = by_group(mapping.join(steps.drop("c"), [*keys, "trajectory_id", "seq"]), keys)

    def over(*columns):
        return Window.partitionBy(*cell, *columns)
    own = F.when(F.col("is_new"), F.struct("step", "merged_id"))
    rows = rows.withColumn("_g", F.when(F.col("is_new"), effect_group()))
    rows = rows.withColumn("_c", F.when(F.col("is_new"), F.min(own).over(over("_g"))))
    rows = rows.withColumn("_c", F.max("_c").over(over("merged_id"))).withColumn(
        "is_last", F.col("seq") == F.max("seq").over(over("trajectory_id")))
    return rows.select("*", F.col("_c.merged_id").alias("canonical"), F.col("_c.step").alias("canonical_step")).drop("_c", "_g", "branch_from")


def cell_states(rows: DataFrame, cell: Sequence[str], keys: Sequence[str] = TASK) -> DataFrame:
    """States of every graph of ``cell_rows``: consolidated, numbered, labelled afresh and signed. ``rid`` is a small
    number per distinct signature of ``keys``, ``is_end`` says whether a run ends there."""
    cell, keys = list(cell), list(keys)
    made = F.col("is_new") & (F.col("merged_id") == F.col("canonical"))
    held = F.struct("trajectory_id", *KEPT, "resulting_state", "stages", "signed", "written", "trigger")
    st = by_group(rows, keys).groupBy(*cell, "canonical").agg(
        F.max(F.when(made, held)).alias("_m"), F.count(F.lit(1)).alias("trace_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("files_touched")))).alias("files_touched"), F.max("is_last").alias("is_end"))
    st = st.select(*cell, F.col("canonical").alias("merged_id"), "_m.*", "trace_count", "files_touched", "is_end")
    graph = Window.partitionBy(*cell)
    order = graph.orderBy("step", "merged_id")
    st = st.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).withColumn("n_steps", F.count(F.lit(1)).over(graph)).withColumn(
        "_done", F.coalesce(F.max("trigger").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    # A row for every file that a state writes meets the states of this file; it is dropped again.
    files = F.filter(F.transform(F.split("written", ","), F.trim), lambda f: f != "")
    place = F.concat(F.array(F.struct(F.col("file_path").alias("f"), F.lit(False).alias("w"))),
                     F.transform(F.coalesce(files, F.array().cast("array<string>")), lambda f: F.struct(f.alias("f"), F.lit(True).alias("w"))))
    st = st.withColumn("_p", F.explode(place)).withColumn("_f", F.col("_p.f"))
    first = F.min(F.when(F.col("_p.w"), F.col("seq"))).over(Window.partitionBy(*cell, "_f"))
    st = st.withColumn("_written", F.col("_f").isNotNull() & F.coalesce(first < F.col("seq"), F.lit(False))).where(~F.col("_p.w"))
    at = F.when(~F.col("_done"), 0).when(F.col("_written"), 4).otherwise(2) + (F.col("seq") >= F.col("n_steps") * NEAR_END).cast("int")
    st = st.withColumn("intent_stage", F.get("stages", at))
    same = F.filter("signed", lambda x: x["stage"].eqNullSafe(F.col("intent_stage")))
    st = st.withColumn("sig", F.get(same, F.lit(0))["sig"]).withColumn("chunk", F.floor(F.col("seq") / CHUNK_ROWS))
    st = st.withColumn("rid", F.dense_rank().over(Window.partitionBy(*keys).orderBy("sig")))
    return st.drop("_p", "_f", "_done", "_written", "stages", "signed", "written", "trigger")


def cell_edges(rows: DataFrame, cell: Sequence[str], keys: Sequence[str] = TASK) -> DataFrame:
    """Cleaned edges of every graph of ``cell_rows``: cell, src, dst, action_type, edge_no."""
    by_run = Window.partitionBy(*cell, "trajectory_id").orderBy("seq")
    onward = F.lead(F.struct("merged_id", "canonical", "canonical_step", "action")).over(by_run)
    step = by_group(rows.select(*cell, "trajectory_id", "run_order", "seq", "merged_id", "canonical", "canonical_step", "action"), keys).select(
        *cell, "run_order", "seq", F.col("merged_id").alias("a"), F.struct("canonical", "canonical_step").alias("s"), onward.alias("n")).where("n IS NOT NULL")
    first = step.groupBy(*cell, "a", F.col("n.merged_id").alias("b"), F.col("n.action").alias("action_type")).agg(
        F.min(F.struct("run_order", "seq")).alias("_o"), F.min("s").alias("s"), F.min(F.struct("n.canonical", "n.canonical_step")).alias("d"))
    first = first.withColumn("edge_no", F.row_number().over(Window.partitionBy(*cell).orderBy("_o")))
    kept = first.where("s.canonical <> d.canonical AND d.canonical_step >= s.canonical_step")
    return kept.groupBy(*cell, F.col("s.canonical").alias("src"), F.col("d.canonical").alias("dst"), "action_type").agg(F.min("edge_no").alias("edge_no"))


def _listed(limit: int | None) -> Callable:
    """Paths as places of their states among the nodes."""
    @pandas_udf(ArrayType(INTS))
    def paths(ids: pd.Series, ends: pd.Series, no: pd.Series, src: pd.Series, dst: pd.Series) -> pd.Series:
        out = []
        for i, e, n, a, b in zip(ids, ends, no, src, dst):
            place = {m: k for k, m in enumerate(i.tolist())}
            found = _depth_first(pd.DataFrame({"merged_id": i, "is_end": e}), pd.DataFrame({"edge_no": n, "src": a, "dst": b}), limit)
            out.append([[place[m] for m in path] for path in found])
        return pd.Series(out)
    return paths


@pandas_udf(FACTS)
def _facts(ids: pd.Series, ends: pd.Series, stages: pd.Series, tools: pd.Series, no: pd.Series, src: pd.Series, dst: pd.Series) -> pd.DataFrame:
    out = []
    for i, e, s, t, n, a, b in zip(ids, ends, stages, tools, no, src, dst):
        g = _Paths(pd.DataFrame({"merged_id": i, "is_end": e}), pd.DataFrame({"edge_no": n, "src": a, "dst": b}))
        i, total, through = i.tolist(), *g.through()
        if not total:
            out.append((0.0, [], [], [], [], [], [], []))
            continue
        of = {tool: {m for m, x in zip(i, t) if x == tool} for tool in sorted(set(t) - {"", "llm"})}
        stage, through = dict(zip(i, s)), {m: c for m, c in through.items() if c}
        out.append((float(total), list(map(int, through)), list(map(float, through.values())), list(of),
                    [float(total - g.onward(x)[g.root]) for x in of.values()], g.best(stage, True), g.best({}, True), g.best({}, False)))
    return pd.DataFrame(out, columns=[f.name for f in FACTS.fields])


def cell_graphs(states: DataFrame, edges: DataFrame, cell: Sequence[str], keys: Sequence[str] = TASK, limit: int | None = None) -> DataFrame:
    """One row per graph: cell, ``nodes`` (by merged_id), ``paths`` (the first ``limit`` in depth-first order, as places in
    ``nodes``) and ``facts`` about all paths."""
    letter = F.when(blank("intent_stage") == "", "-").otherwise(stage_letter(F.col("intent_stage")))
    tool, file = blank("tool_used"), blank("file_path")
    node = F.struct("merged_id", "rid", letter.alias("s"), tool.alias("tool"), file.alias("file"), "is_end", blank("intent_stage").alias("stage"),
                    F.col("kind").eqNullSafe("request").alias("request"))
    edge = F.struct("edge_no", "src", "dst")
    none = F.lit(None)
    both = states.select(*cell, node.alias("node")).withColumn("edge", none.cast(edges.select(edge).schema[0].dataType))
    both = both.unionByName(edges.select(*cell, none.cast(both.schema["node"].dataType).alias("node"), edge.alias("edge")))
    g = by_group(both, keys).groupBy(*cell).agg(F.sort_array(F.collect_list("node")).alias("nodes"), F.collect_list("edge").alias("_e"))
    ids, ends, stage = "nodes.merged_id", "nodes.is_end", "nodes.stage"
    tools = F.transform("nodes", lambda n: F.trim(F.substring_index(n["tool"], "[", 1)))
    e = [f"_e.{c}" for c in ("edge_no", "src", "dst")]
    return g.select(*cell, "nodes", _listed(limit)(ids, ends, *e).alias("paths"), _facts(ids, ends, stage, tools, *e).alias("facts"))


def cell_path_rows(graphs: DataFrame, cell: Sequence[str]) -> DataFrame:
    """The listed paths in long form: cell, path_id, pos, merged_id."""
    one = graphs.select(*cell, F.col("nodes.merged_id").alias("_ids"), F.posexplode("paths").alias("path_id", "_p"))
    return one.select(*cell, "path_id", "_ids", F.posexplode("_p").alias("pos", "_i")).select(*cell, "path_id", "pos", F.get("_ids", F.col("_i")).alias("merged_id"))


def cell_fact_rows(graphs: DataFrame, cell: Sequence[str]) -> DataFrame:
    """The facts in the long form of ``refgraph.path_facts``: cell, fact, n, merged_id, tool, pos."""
    f, empty = F.col("facts"), {"n": "double", "merged_id": "int", "tool": "string", "pos": "int"}

    def row(fact, **given):
        return F.struct(F.lit(fact).alias("fact"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()])

    def counted(fact, ids, name):
        return F.transform(F.arrays_zip(F.col(f"facts.{ids}").alias("i"), F.col(f"facts.{ids}_n").alias("n")), lambda x: row(fact, n=x["n"], **{name: x["i"]}))

    def placed(fact):
        return F.transform(f[fact], lambda m, i: row(fact, merged_id=m, pos=i))
    named = [placed(x) for x in ("canonical", "longest", "shortest")]
    every = F.concat(F.array(row("total", n=f["total"])), counted("state", "state", "merged_id"), counted("tool", "tool", "tool"), *named)
    return graphs.select(*cell, F.inline(every))


def repeats(marks: Sequence[str], length: int) -> list[str]:
    """Patterns of ``length`` marks that repeat at once in a row, left to right, as ``waste.raw_cycles`` finds them."""
    out, free, i, last = [], 0, 0, len(marks) - length
    while i < last:
        if marks[i] != marks[i + length]:
            i += 1
            continue
        end = i
        while end < last and marks[end] == marks[end + length]:
            end += 1
        start = max(i, free)
        if end - i >= length and end - start >= length:
            out.append(";".join(marks[start:start + length]))
            free = start + ((end - start) // length + 1) * length
        i = end
    return out


@pandas_udf(CYCLES)
def _repeated(marks: pd.Series, paths: pd.Series) -> pd.Series:
    def of(mark, path):
        mark = [mark[i] for i in path]
        return {p for n in PATTERN_LENGTHS for p in repeats(mark, n)}
    return pd.Series([[(i, p) for i, path in enumerate(ps) for p in sorted(of(m, path))] for m, ps in zip(marks, paths)])


def cell_cycles(graphs: DataFrame, cell: Sequence[str]) -> DataFrame:
    """``waste.reference_cycles`` of the listed paths: cell, path_id, pattern."""
    marks = F.transform("nodes", lambda n: F.concat_ws("|", n["tool"], n["file"], stage_letter(n["stage"])))
    return graphs.select(*cell, F.inline(_repeated(marks, "paths")))


def cell_references(graphs: DataFrame, cell: Sequence[str]) -> DataFrame:
    """``matching.reference_paths`` of ``cell_graphs``, without leaving the row. A graph without a path has none."""
    # Columns of their own, each read once, as the arguments of functions over arrays are not evaluated twice.
    x = F.transform("paths", lambda p, i: F.struct(i.alias("path_id"), F.filter(F.transform(p, lambda j: F.get("nodes", j)), lambda n: ~n["request"]).alias("x")))
    df = graphs.select(*cell, F.filter(x, lambda q: F.size(q["x"]) > 0).alias("_x")).where(F.size("_x") > 0)
    marks = F.transform("_x", lambda q: F.transform(q["x"], lambda n: F.concat_ws("|", n["tool"], n["file"], n["s"])))
    explored = F.transform("_x", lambda q: F.transform(F.filter(q["x"], lambda n: (n["s"] == "E") & (n["file"] != "")), lambda n: n["file"]))
    df = df.withColumn("_m", marks).withColumn("_f", explored)

    def repeated(m: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(m, lambda s, i: F.when(
            (i >= 2) & (F.get(m, i - 1) == s) & (F.get(m, i - 2) == s) & (s != "||-"), s)), lambda s: s.isNotNull()))

    def twice(f: Column) -> Column:
        return F.array_distinct(F.filter(f, lambda a: F.size(F.filter(f, lambda b: b == a)) >= 2))
    seen = F.zip_with("_m", "_f", lambda m, f: F.struct(repeated(m).alias("retry_sigs"), twice(f).alias("multi_read")))

    def described(q: Column, more: Column) -> Column:
        letters = F.transform(q["x"], lambda n: n["s"])
        return F.struct(q["path_id"].alias("path_id"), F.transform(q["x"], lambda n: n["rid"]).alias("rids"), F.array_join(letters, "").alias("stages"),
                        F.size(F.array_distinct(F.filter(letters, lambda s: s != "-"))).alias("n_stages"), F.size(q["x"]).alias("total"),
                        more["retry_sigs"].alias("retry_sigs"), more["multi_read"].alias("multi_read"))
    return df.select(*cell, F.zip_with("_x", seen, described).alias("paths"))
