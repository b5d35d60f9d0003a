"""Reference graphs: merge k passing runs of a task, clean the graph, list its paths.

Only the two order-dependent parts run per task in Python: the merge fold (k runs of one
task, never its whole population) and the depth-first path listing over the merged graph.
Equality of steps comes from the equivalence join; everything else is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions.text import blank, percent
from runloom.operators.equivalence import equivalence_pairs
from runloom.operators.intent import label_intent
from runloom.operators.scan import by_group, number_rows

#: The matcher's own rule: a run is compared with the first so many paths in depth-first order. The
#: listing queries, ``first_paths`` (waste) and the studies use the same list; ``path_facts`` gives the
#: number of all paths beside it, and rests on all of them.
MATCHED_PATHS = 50
#: Partial paths (visited states, last state) kept for one cyclic component.
SUBSETS = 2_000_000
# Effects grouped across steps, and effects never grouped.
CROSS_STEP = ("file_created:", "file_read:", "file_patched:", "files_modified:", "llm_response:confirmed:")
NEVER_GROUPED = ("llm_response:terminal", "initial", "")


def _fresh(df: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """Select with new column identities, so both sides of a cogroup can share ancestry."""
    return df.select(*[F.col(k).alias(k) for k in keys], *columns)


def draw_order(seed: Column | int, run: Column) -> Column:
    """Deterministic pseudo-random order of runs: digest of seed and run id."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), run.cast("string")).cast("binary"))


def select_donors(runs: DataFrame, k: int = 5, seed: int = 42,
                  keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """First k passing runs per task in draw order; tasks with fewer than k are skipped.

    The rank limit is applied before the shuffle completes, so a huge task sends at most
    k rows per input partition.
    """
    keys = list(keys)
    seed_col = F.col("draw_id") + seed if "draw_id" in keys else F.lit(seed)
    passing = runs.where("passed").withColumn("_o", draw_order(seed_col, F.col("trajectory_id")))
    ranked = passing.withColumn("run_order", F.row_number().over(
        Window.partitionBy(*keys).orderBy("_o", "trajectory_id"))).where(F.col("run_order") <= k)
    full = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
    return ranked.join(full, keys, "left_semi").select(*keys, "trajectory_id", "run_order")


def _fold(runs: list[tuple[int, list[tuple[int, int, int]]]], equal: set[tuple[int, int]]) -> list[tuple]:
    """Fold runs, in order, into a growing list of merged states with one cursor per run.

    ``runs`` are (run id, [(seq, step, signature)]). A run's rows depend on the runs before it only,
    so the rows of the first k runs are the fold of these k: one fold has every shorter one in it.
    """
    merged: list[tuple] = []  # (step, id, signature), kept in (step, id) order
    out = []
    for order, (run, steps) in enumerate(runs):
        base, pos, branch, added = list(merged), 0, None, []
        for i, (seq, step_no, sid) in enumerate(steps):
            if order and pos < len(base):
                _, mid, sig = base[pos]
                if i == 0 or (sig, sid) in equal:
                    out.append((run, seq, mid, False, None))
                    pos += 1
                    continue
                branch = mid
            new = len(merged) + len(added) + 1
            added.append((step_no, new, sid))
            out.append((run, seq, new, True, branch))
        merged = sorted(merged + added)
    return out


def merge_cells(steps: DataFrame, grid: DataFrame, cell: Sequence[str], keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Merge the runs of many cells: every cell is an ordered choice of a task's runs.

    ``steps`` holds the steps of the chosen runs (``seq``, ``step``, ``c``, ``sig``), each run once;
    ``grid`` has keys, ``cell`` columns, trajectory_id and run_order. A task's steps and equal
    contents reach one group once, whatever the number of its cells. Output: keys, cell columns,
    trajectory_id, run_order, seq, merged_id, is_new, branch_from.
    """
    keys, cell = list(keys), list(cell)
    ids = steps.select(*keys, "sig").distinct().select(*keys, "sig", F.row_number().over(Window.partitionBy(*keys).orderBy("sig")).alias("sid"))
    eq = equivalence_pairs(steps, steps, keys)
    pairs = (eq.join(ids.select(*keys, F.col("sig").alias("ref_sig"), F.col("sid").alias("a")), [*keys, "ref_sig"])
             .join(ids.select(*keys, F.col("sig").alias("cand_sig"), F.col("sid").alias("b")), [*keys, "cand_sig"])
             .select(*[F.col(k).alias(k) for k in keys], "a", "b"))
    # The places of a run in the cells travel with its first step.
    run = [*keys, "trajectory_id"]
    places = grid.groupBy(*run).agg(F.collect_list(F.struct("run_order", *cell)).alias("_places"))
    places = places.join(steps.groupBy(*run).agg(F.min("seq").alias("seq")), run)
    rows = steps.join(ids, [*keys, "sig"]).select(*run, "seq", "step", "sid").join(places, [*run, "seq"], "left")
    types = {f.name: f.dataType.simpleString() for f in [*steps.schema.fields, *grid.schema.fields]}
    names = [*keys, *cell, "trajectory_id", "run_order", "seq", "merged_id", "is_new", "branch_from"]
    types.update(run_order="int", merged_id="int", is_new="boolean", branch_from="int")

    def fold(key, left, right):
        equal = set(zip(right["a"], right["b"]))
        runs = {run: list(x[["seq", "step", "sid"]].itertuples(index=False, name=None))
                for run, x in left.sort_values("seq").groupby("trajectory_id")}
        cells: dict[tuple, list] = {}
        for run, places in zip(left["trajectory_id"], left["_places"]):
            for p in places if places is not None else ():
                cells.setdefault(tuple(p[c] for c in cell), []).append((p["run_order"], run))
        out = []
        for values, chosen in cells.items():
            order = {run: k for k, run in chosen}
            for run, *rest in _fold([(run, runs[run]) for _, run in sorted(chosen)], equal):
                out.append((*key, *values, run, order[run], *rest))
        return pd.DataFrame(out, columns=names).astype({"branch_from": "Int32"})
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    return by_group(rows, keys).groupBy(*keys).cogroup(by_group(pairs, keys).groupBy(*keys)).applyInPandas(fold, schema)


def merge_runs(donor_steps: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Map every donor step to a merged state.

    Input: donor steps with ``run_order``, ``seq``, ``step``, ``c`` and ``sig``. Output:
    keys, trajectory_id, seq, merged_id, is_new, branch_from.
    """
    order = donor_steps.select(*keys, "trajectory_id", "run_order").distinct()
    return merge_cells(donor_steps, order, [], keys).drop("run_order")


def prefixes(mapping: DataFrame, sizes: Sequence[int], cell: Sequence[str]) -> DataFrame:
    """``mapping`` once per number of runs ``k``: the rows of the first k runs of every cell that has as many."""
    has = mapping.groupBy(*cell).agg(F.max("run_order").alias("_n"))
    k = F.explode(F.filter(F.array(*[F.lit(k) for k in sizes]), lambda k: (k <= F.col("_n")) & (k >= F.col("run_order"))))
    return mapping.join(has, list(cell)).select(k.alias("k"), *mapping.columns)


def merge_stats(donor_steps: DataFrame, mapping: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    keys = list(keys)
    m = mapping.join(donor_steps.select(*keys, "trajectory_id", "seq", "run_order"), [*keys, "trajectory_id", "seq"])
    return m.groupBy(*keys).agg(
        F.max("run_order").alias("traces_merged"), F.count_if("is_new").alias("states_added"),
        F.count_if(~F.col("is_new")).alias("states_merged"))


def graph_states(donor_steps: DataFrame, mapping: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """One row per merged state: the step that created it, run count and touched files."""
    keys = list(keys)
    full = mapping.join(donor_steps, [*keys, "trajectory_id", "seq"])
    made = full.where("is_new").drop("run_order", "is_new")
    meta = full.groupBy(*keys, "merged_id").agg(
        F.count(F.lit(1)).alias("trace_count"), F.array_sort(F.array_distinct(F.flatten(
            F.collect_set("files_touched")))).alias("files"))
    return made.drop("files_touched").join(meta, [*keys, "merged_id"]) \
        .withColumnRenamed("files", "files_touched")


def graph_edges(donor_steps: DataFrame, mapping: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """First-seen edges between merged states, numbered in order of appearance."""
    keys = list(keys)
    by_run = Window.partitionBy(*keys, "trajectory_id").orderBy("seq")
    action = F.when(F.col("kind") == "toolCall", F.coalesce(F.nullif(blank("tool_used"), F.lit("")),
                                                           F.lit("unknown_tool"))).otherwise("request")
    s = mapping.join(donor_steps.select(*keys, "trajectory_id", "seq", "run_order", action.alias("_a")),
                     [*keys, "trajectory_id", "seq"])
    raw = s.select(*keys, "run_order", "seq", F.col("merged_id").alias("src"),
                   F.lead("merged_id").over(by_run).alias("dst"), F.lead("_a").over(by_run).alias("action_type")) \
        .where(F.col("dst").isNotNull())
    first = raw.groupBy(*keys, "src", "dst", "action_type").agg(F.min(F.struct("run_order", "seq")).alias("_o"))
    return first.withColumn("edge_no", F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))).drop("_o")


def branch_points(mapping: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    return mapping.where("is_new AND branch_from IS NOT NULL").select(
        *keys, F.col("branch_from").alias("branch"), F.col("merged_id").alias("alternative")).distinct()


def run_terminals(mapping: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    return mapping.groupBy(*keys, "trajectory_id").agg(F.max_by("merged_id", "seq").alias("merged_id")) \
        .select(*keys, "merged_id").distinct()


def effect_group(by_stage: bool = True) -> Column:
    """What states of one graph must share to become one: effect and stage, or effect and step."""
    effect = blank("resulting_state")
    cross = F.lit(False)
    for p in CROSS_STEP:
        cross = cross | effect.startswith(p)
    stage = blank("intent_stage") if by_stage else F.lit("")
    return F.when(effect.isin(*NEVER_GROUPED), F.concat(F.lit("own:"), F.col("merged_id").cast("string"))) \
        .when(cross, F.concat_ws("|", F.lit("s"), effect, stage)) \
        .otherwise(F.concat_ws("|", F.lit("t"), effect, F.col("step").cast("string")))


def consolidation(states: DataFrame, keys: Sequence[str] = ("task_id",), by_stage: bool = True) -> DataFrame:
    """merged_id -> canonical id: same effect and stage (or same effect and step).

    ``by_stage=False`` groups cross-step effects regardless of stage.
    """
    keys = list(keys)
    group = effect_group(by_stage)
    g = states.select(*keys, "merged_id", "step", group.alias("_g"))
    canon = g.groupBy(*keys, "_g").agg(F.min(F.struct("step", "merged_id")).alias("_c"))
    return g.join(canon, [*keys, "_g"]).select(*keys, "merged_id", F.col("_c.merged_id").alias("canonical"))


def consolidate(states: DataFrame, remap: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Keep canonical states with summed run counts and united files; relabel stages."""
    keys = list(keys)
    full = states.join(remap, [*keys, "merged_id"])
    meta = full.groupBy(*keys, "canonical").agg(
        F.sum("trace_count").alias("trace_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("files_touched")))).alias("files_touched"))
    kept = full.where(F.col("merged_id") == F.col("canonical")).drop("trace_count", "files_touched", "canonical")
    out = kept.join(meta.withColumnRenamed("canonical", "merged_id"), [*keys, "merged_id"])
    return relabel(out, keys)


def relabel(states: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Number merged states in (step, id) order and label stages afresh."""
    base = states.drop("seq", "n_steps", "chunk", "intent_stage")
    numbered = number_rows(base, list(keys), ["step", "merged_id"], F.floor(F.col("step") / 1024))
    return label_intent(numbered, list(keys))


def clean_edges(edges: DataFrame, remap: DataFrame, states: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Remap, drop loops, backward and dangling edges, keep the first of equal edges."""
    keys = list(keys)
    step = states.select(*keys, "merged_id", "step")
    src = remap.join(step.withColumnRenamed("merged_id", "canonical"), [*keys, "canonical"])
    a = src.select(*keys, F.col("merged_id").alias("src"), F.col("canonical").alias("_s"), F.col("step").alias("_ss"))
    b = src.select(*keys, F.col("merged_id").alias("dst"), F.col("canonical").alias("_d"), F.col("step").alias("_ds"))
    ok = edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).where(
        (F.col("_s") != F.col("_d")) & (F.col("_ds") >= F.col("_ss")))
    return ok.groupBy(*keys, F.col("_s").alias("src"), F.col("_d").alias("dst"), "action_type").agg(
        F.min("edge_no").alias("edge_no"))


def remap_ids(ids: DataFrame, remap: DataFrame, column: str = "merged_id",
              keys: Sequence[str] = ("task_id",)) -> DataFrame:
    keys = list(keys)
    m = remap.select(*keys, F.col("merged_id").alias(column), F.col("canonical").alias("_c"))
    return ids.join(m, [*keys, column]).drop(column).withColumnRenamed("_c", column).distinct()


def terminal_states(states: DataFrame, edges: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    keys = list(keys)
    return states.select(*keys, "merged_id").join(
        edges.select(*keys, F.col("src").alias("merged_id")), [*keys, "merged_id"], "left_anti")


def graph_stats(states: DataFrame, edges: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    keys = list(keys)
    n = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("states"))
    files = states.select(*keys, F.explode("files_touched").alias("f")).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"))
    ends = terminal_states(states, edges, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("terminals"))
    e = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edges"))

    def degree(col, name):
        return edges.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1) \
            .groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = n
    for part in (e, ends, degree("src", "branching"), degree("dst", "merging"), files):
        out = out.join(part, keys, "left")
    return out.fillna(0)


def action_mix(edges: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    keys = list(keys)
    total = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"))
    return edges.groupBy(*keys, "action_type").agg(F.count(F.lit(1)).alias("n")).join(total, keys).withColumn(
        "pct", percent(F.col("n"), F.col("_t"))).drop("_t")


def bfs_layers(states: DataFrame, edges: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Breadth-first layer of every state; unreachable states share the last layer + 1."""
    keys = list(keys)

    def walk(key, s, e):
        nxt: dict = {}
        for a, b in zip(e["src"], e["dst"]):
            nxt.setdefault(a, []).append(b)
        start = s.sort_values(["step", "merged_id"])["merged_id"].iloc[0]
        depth, frontier = {start: 0}, [start]
        while frontier:
            found = []
            for a in frontier:
                for b in nxt.get(a, ()):
                    if b not in depth:
                        depth[b] = depth[a] + 1
                        found.append(b)
            frontier = found
        rest = max(depth.values()) + 1
        out = pd.DataFrame({"merged_id": s["merged_id"], "layer": [depth.get(i, rest) for i in s["merged_id"]]})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "merged_id", "layer"]]
    types = {f.name: f.dataType.simpleString() for f in states.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", merged_id int, layer int"
    return states.select(*keys, "merged_id", "step").groupBy(*keys).cogroup(
        _fresh(edges, keys, "src", "dst").groupBy(*keys)).applyInPandas(walk, schema)


class PathBudgetExceeded(ValueError):
    """A graph has more paths than the caller allowed."""


def _depth_first(states: pd.DataFrame, edges: pd.DataFrame, limit: int | None, budget: int | None = None) -> list[list[int]]:
    """Simple root-to-terminal paths in edge-name order: all, or the first ``limit``.

    States that cannot reach an accepted end are dropped first, which changes no result
    and keeps dead ends from costing time.
    """
    ends = set(states.loc[states["is_end"], "merged_id"])
    out: dict = {}
    back: dict = {}
    for name, a, b in sorted(zip(edges["edge_no"].astype(str), edges["src"], edges["dst"])):
        out.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    live, todo = set(ends), list(ends)
    while todo:
        for a in back.get(todo.pop(), ()):
            if a not in live:
                live.add(a)
                todo.append(a)
    root = states.sort_values("merged_id")["merged_id"].iloc[0]
    if root not in live:
        return []
    paths, path, seen = [], [root], {root}
    if root in ends:
        paths.append([root])
    stack = [iter(out.get(root, ()))]
    while stack and (limit is None or len(paths) < limit):
        if budget is not None and len(paths) > budget:
            raise PathBudgetExceeded(f"more than {budget} paths")
        nxt = next(stack[-1], None)
        if nxt is None:
            stack.pop()
            seen.discard(path.pop())
            continue
        if nxt in seen or nxt not in live:
            continue
        path.append(nxt)
        seen.add(nxt)
        if nxt in ends:
            paths.append(list(path))
        stack.append(iter(out.get(nxt, ())))
    return paths


def enumerate_paths(states: DataFrame, edges: DataFrame, terminals: DataFrame | None = None,
                    keys: Sequence[str] = ("task_id",), limit: int | None = None, budget: int | None = None) -> DataFrame:
    """Simple paths from the initial state: keys, path_id, pos, merged_id.

    ``terminals`` names the accepted ends; without it every state with no outgoing edge is one.
    All paths are listed; ``limit`` keeps the first ones in depth-first order, ``budget`` makes a
    graph with more paths an error. Their number can be exponential: ``path_facts`` needs no list.
    """
    keys = list(keys)
    flagged = _flag_ends(states, edges, terminals, keys)

    def walk(key, s, e):
        rows = [(i, p, m) for i, path in enumerate(_depth_first(s, e, limit, budget)) for p, m in enumerate(path)]
        out = pd.DataFrame(rows, columns=["path_id", "pos", "merged_id"])
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, "path_id", "pos", "merged_id"]]
    types = {f.name: f.dataType.simpleString() for f in states.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", path_id int, pos int, merged_id int"
    return by_group(flagged, keys).groupBy(*keys).cogroup(
        by_group(_fresh(edges, keys, "src", "dst", "edge_no"), keys).groupBy(*keys)).applyInPandas(walk, schema)


def _flag_ends(states: DataFrame, edges: DataFrame, terminals: DataFrame | None, keys: list[str], *columns: str) -> DataFrame:
    ends = terminals if terminals is not None else terminal_states(states, edges, keys)
    return states.select(*keys, "merged_id", *columns).join(
        ends.select(*keys, "merged_id").distinct().withColumn("is_end", F.lit(True)), [*keys, "merged_id"], "left") \
        .fillna(False, ["is_end"])


class _Paths:
    """All simple root-to-end paths of one graph, without listing them.

    Strongly connected components are found first. A simple path leaves a component once and never
    returns, so everything factors over the condensation: what happens inside a component is a
    recursion over its subsets (states visited, last state), and between components it is a dynamic
    program in their order. A component of a merged graph holds states of one step only, so it is
    tiny; ``SUBSETS`` bounds the recursion for other graphs.
    """

    def __init__(self, states: pd.DataFrame, edges: pd.DataFrame) -> None:
        self.ends = set(states.loc[states["is_end"], "merged_id"])
        self.root = states["merged_id"].min()
        self.next: dict[int, list[int]] = {n: [] for n in states["merged_id"]}
        for _, a, b in sorted(zip(edges["edge_no"].astype(str), edges["src"], edges["dst"])):
            if a != b and b not in self.next.setdefault(a, []):
                self.next[a].append(b)
        self.parts = self._components()
        self.part = {n: i for i, part in enumerate(self.parts) for n in part}
        self._inner: dict[tuple, dict[int, int]] = {}

    def _components(self) -> list[list[int]]:
        """Tarjan's components with an explicit stack; a component comes after all that it reaches."""
        index: dict[int, int] = {}
        low: dict[int, int] = {}
        out, open_, is_open = [], [], set()
        for start in self.next:
            if start in index:
                continue
            index[start] = low[start] = len(index)
            open_.append(start)
            is_open.add(start)
            work = [(start, iter(self.next[start]))]
            while work:
                n, onward = work[-1]
                for b in onward:
                    if b not in index:
                        index[b] = low[b] = len(index)
                        open_.append(b)
                        is_open.add(b)
                        work.append((b, iter(self.next.get(b, ()))))
                        break
                    if b in is_open:
                        low[n] = min(low[n], index[b])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[n])
                    if low[n] == index[n]:
                        part = []
                        while not part or part[-1] != n:
                            part.append(open_.pop())
                            is_open.discard(part[-1])
                        out.append(part)
        return out

    def _leaves(self, n: int) -> list[int]:
        """Successors in other components."""
        return [b for b in self.next.get(n, ()) if self.part[b] != self.part[n]]

    def _visits(self, u: int, without: frozenset[int] = frozenset()) -> list[dict[tuple[int, int], int]]:
        """Simple paths from ``u`` inside its component, by length: (set of visited states as bits, last
        state) -> number of paths."""
        part = self.parts[self.part[u]]
        bit = {n: 1 << i for i, n in enumerate(part)}
        layer = {(bit[u], u): 1} if u not in without else {}
        out, size = [], 0
        while layer:
            out.append(layer)
            size += len(layer)
            if size > SUBSETS:
                raise PathBudgetExceeded(f"a cyclic component of {len(part)} states has more than {SUBSETS} partial paths")
            grown: dict[tuple[int, int], int] = {}
            for (seen, n), ways in layer.items():
                for b in self.next.get(n, ()):
                    if b in bit and not seen & bit[b] and b not in without:
                        grown[seen | bit[b], b] = grown.get((seen | bit[b], b), 0) + ways
            layer = grown
        return out

    def inner(self, u: int, without: frozenset[int] = frozenset()) -> dict[int, int]:
        """Simple paths from ``u`` to each state of its component that avoid ``without``."""
        part = self.parts[self.part[u]]
        if len(part) == 1:
            return {} if u in without else {u: 1}
        key = (u, without.intersection(part))
        if key not in self._inner:
            found: dict[int, int] = {}
            for layer in self._visits(*key):
                for (_, n), ways in layer.items():
                    found[n] = found.get(n, 0) + ways
            self._inner[key] = found
        return self._inner[key]

    def onward(self, without: set[int] = frozenset()) -> dict[int, int]:
        """Paths to an end from each state where a path can enter its component, avoiding ``without``."""
        without, out = frozenset(without), {}
        for part in self.parts:
            leave = {n: (n in self.ends) + sum(out[b] for b in self._leaves(n)) for n in part}
            for u in part:
                out[u] = sum(ways * leave[n] for n, ways in self.inner(u, without).items())
        return out

    def through(self) -> tuple[int, dict[int, int]]:
        """Number of all paths, and of those through each state."""
        to_end = self.onward()
        enter = dict.fromkeys(self.part, 0)
        enter[self.root] = 1
        used = {}
        for part in reversed(self.parts):
            leave = {n: (n in self.ends) + sum(to_end[b] for b in self._leaves(n)) for n in part}
            entries = [u for u in part if enter[u]]
            whole = sum(enter[u] * to_end[u] for u in entries)
            for x in part:
                around = sum(enter[u] * ways * leave[n] for u in entries for n, ways in self.inner(u, frozenset([x])).items())
                used[x] = whole - around
            for u in entries:
                for n, ways in self.inner(u).items():
                    for b in self._leaves(n):
                        enter[b] += enter[u] * ways
        return to_end[self.root], used

    def best(self, stage: dict[int, str], longest: bool) -> list[int]:
        """The path with most distinct stages (if ``stage`` is given), then longest or shortest; of
        equals the first in depth-first order."""
        bits = {s: 1 << i for i, s in enumerate(sorted({v for v in stage.values() if v}))}
        own = {n: bits.get(stage.get(n, ""), 0) for n in self.part}
        better = max if longest else min
        # From every entry: set of stages still to come -> length of the best way to an end.
        table: dict[int, dict[int, int]] = {}

        def ways_out(n: int) -> dict[int, int]:
            rows = {0: 0} if n in self.ends else {}
            for b in self._leaves(n):
                for mask, size in table[b].items():
                    rows[mask] = better(rows.get(mask, size), size)
            return rows
        for part in self.parts:
            out = {n: ways_out(n) for n in part}
            bit = {1 << i: n for i, n in enumerate(part)}
            for u in part:
                rows: dict[int, int] = {}
                for length, layer in enumerate(self._visits(u), 1):
                    for seen, n in layer:
                        inside = 0
                        for b, state in bit.items():
                            inside |= own[state] if seen & b else 0
                        for mask, size in out[n].items():
                            m = mask | inside
                            rows[m] = better(rows.get(m, size + length), size + length)
                table[u] = rows
        if not table.get(self.root):
            return []
        stages = max(bin(m).count("1") for m in table[self.root])
        length = better(size for m, size in table[self.root].items() if bin(m).count("1") == stages)

        def reachable(rows: dict[int, int], mask: int, left: int) -> bool:
            return any(size == left and bin(m | mask).count("1") == stages for m, size in rows.items())
        # Depth first along the states from which the best is still within reach.
        path, mask, dead = [self.root], [own[self.root]], set()
        stack = [iter(self.next[self.root])]
        while not (path[-1] in self.ends and len(path) == length and bin(mask[-1]).count("1") == stages):
            n, here = next(stack[-1], None), path[-1]
            if n is None:
                inside = frozenset(x for x in path if self.part[x] == self.part[here])
                dead.add((here, inside, len(path), mask[-1]))
                stack.pop()
                path.pop()
                mask.pop()
                continue
            if self.part[n] != self.part[here]:
                ok = reachable(table[n], mask[-1], length - len(path))
            else:
                inside = frozenset([n, *(x for x in path if self.part[x] == self.part[n])])
                ok = n not in path and len(path) < length and (n, inside, len(path) + 1, mask[-1] | own[n]) not in dead
            if ok:
                path.append(n)
                mask.append(mask[-1] | own[n])
                stack.append(iter(self.next.get(n, ())))
        return path


def path_facts(states: DataFrame, edges: DataFrame, terminals: DataFrame | None = None,
               keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Facts about *all* paths of a graph, without listing any: keys, fact, n, merged_id, tool, pos.

    ``total``: the number of paths in ``n``. ``state``: paths through ``merged_id``. ``tool``: paths
    that use ``tool``. ``canonical``, ``longest``, ``shortest``: the path's states by ``pos``.
    Counts are doubles, as they may exceed a long. A graph without a path gives a total of 0. One
    group is one merged graph, so k runs. ``clean_edges`` keeps edges between states of one step, so
    cycles among these are normal; paths are simple. A cyclic component with more than ``SUBSETS``
    partial paths raises ``PathBudgetExceeded``.
    """
    keys = list(keys)
    flagged = _flag_ends(states.withColumn("stage", blank("intent_stage")).withColumn(
        "tool", F.trim(F.substring_index(blank("tool_used"), "[", 1))), edges, terminals, keys, "stage", "tool")
    names = ["fact", "n", "merged_id", "tool", "pos"]

    def walk(key, s, e):
        g = _Paths(s, e)
        total, through = g.through()
        rows = [("total", float(total), None, None, None)]
        if total:
            rows += [("state", float(c), int(n), None, None) for n, c in through.items() if c]
            for tool in sorted(set(s["tool"]) - {"", "llm"}):
                used = total - g.onward(set(s.loc[s["tool"] == tool, "merged_id"]))[g.root]
                rows.append(("tool", float(used), None, tool, None))
            stage = dict(zip(s["merged_id"], s["stage"]))
            for fact, path in (("canonical", g.best(stage, True)), ("longest", g.best({}, True)), ("shortest", g.best({}, False))):
                rows += [(fact, None, int(n), None, i) for i, n in enumerate(path)]
        out = pd.DataFrame(rows, columns=names).astype({"merged_id": "Int32", "pos": "Int32"})
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, *names]]
    types = {f.name: f.dataType.simpleString() for f in states.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", fact string, n double, merged_id int, tool string, pos int"
    return by_group(flagged, keys).groupBy(*keys).cogroup(
        by_group(_fresh(edges, keys, "src", "dst", "edge_no"), keys).groupBy(*keys)).applyInPandas(walk, schema)


def essential_states(facts: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """States on every path of the graph."""
    keys = list(keys)
    total = facts.where("fact = 'total' AND n > 0").select(*keys, F.col("n").alias("_t"))
    return facts.where("fact = 'state'").join(total, keys).where("n = _t").select(*keys, "merged_id")


def required_tools(facts: DataFrame, keys: Sequence[str] = ("task_id",), strict: bool = False) -> DataFrame:
    """Tools on more than half of all paths (``strict``: on all of them)."""
    keys = list(keys)
    total = facts.where("fact = 'total' AND n > 0").select(*keys, F.col("n").alias("_t"))
    return facts.where("fact = 'tool'").join(total, keys).where("n = _t" if strict else "n > _t / 2").select(*keys, "tool")


def named_path(facts: DataFrame, fact: str, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """States of the canonical, longest or shortest path, by position."""
    return facts.where(F.col("fact") == fact).select(*keys, "pos", "merged_id")


def path_summary(path_states: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    return path_states.groupBy(*keys, "path_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct(F.nullif(blank("intent_stage"), F.lit(""))).alias("n_stages"))
