"""The best path of a run over *all* paths of its reference graph, by best-first search.

``matching.best_match`` compares a run with listed paths, by the matcher's rule the first 50. Here no
list is made. A partial path is matched as far as it goes (the greedy matching of a prefix never
changes later), and what can follow is bounded from above: per set of stages still to come, the most
states with any hit and the length of the shortest way to an end. Partial paths wait in a heap by
that bound; the first complete path that leaves it is the best, and of equals the first in depth-first
order. Partial paths that end in one state with the same steps used, stages and length go on alike,
so only the first is followed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import blank
from runloom.operators.intent import stage_letter
from runloom.operators.matching import best_match, reference_paths
from runloom.operators.refgraph import PathBudgetExceeded, _flag_ends, _Paths

#: Partial paths followed for one run; a search that needs more is an error, never a cut result.
BUDGET = 1_000_000


class Search:
    """One reference graph, prepared for many runs. ``rid`` and ``letter`` are per state; a state without
    ``rid`` (a request) is passed but not counted."""

    def __init__(self, graph: _Paths, rid: dict[int, int | None], letter: dict[int, str]) -> None:
        self.graph, self.rid = graph, rid
        names = {s: 1 << i for i, s in enumerate(sorted({letter[n] for n in rid if rid[n] is not None} - {"-"}))}
        self.stage = {n: names.get(letter[n], 0) if rid[n] is not None else 0 for n in rid}

    def _bounds(self, hits: dict[int, list[int]], longest: bool) -> dict[int, dict[int, tuple[int, int]]]:
        """After each state: stages to come -> (most states with a hit, length of the rest). Inside a cyclic
        component everything counts as reachable at once, which bounds from above too."""
        g, out = self.graph, {}
        better = max if longest else min
        for part in g.parts:
            wide = len(part) > 1
            rows: dict[int, tuple[int, int]] = {}
            near = [(0, 0, 0)] if any(n in g.ends for n in part) else []
            for b in {b for n in part for b in g._leaves(n)}:
                counts = self.rid.get(b) is not None
                near += [(m | self.stage[b], h + (self.rid[b] in hits), size + counts) for m, (h, size) in out[b].items()]
            for m, h, size in near:
                if wide:
                    for n in part:
                        m |= self.stage[n]
                    h += sum(self.rid[n] in hits for n in part)
                    size += sum(self.rid[n] is not None for n in part) if longest else 0
                old = rows.get(m, (h, size))
                rows[m] = (max(old[0], h), better(old[1], size))
            for n in part:
                out[n] = rows
        return out

    def best(self, hits: dict[int, list[int]], n: int, budget: int = BUDGET) -> list[int]:
        """States of the best path: most distinct stages, most matched, highest coverage, longest, first.

        ``hits`` are the run's equivalent steps per reference id, in order; ``n`` is its length. A run
        without steps matches nothing, so its paths differ by stages and length only. No path: empty.
        """
        g, sign = self.graph, -1 if n else 1
        bounds = self._bounds(hits, longest=not n)
        heap: list = []

        def bound(u: int, mask: int, used: int, size: int) -> tuple[int, int, int] | None:
            rows = bounds[u].items()
            used += size == 0 and n > 0  # the first counted state takes step 0, with a hit or without
            return max((((mask | m).bit_count(), used + h, sign * (size + rest)) for m, (h, rest) in rows), default=None)

        def push(u: int, path: tuple, order: tuple, mask: int, used: frozenset, size: int) -> None:
            if self.rid[u] is not None:
                steps = [0] if size == 0 and n else () if size == 0 else hits.get(self.rid[u], ())
                step = next((s for s in steps if s not in used), None)
                used, size, mask = used if step is None else used | {step}, size + 1, mask | self.stage[u]
            path = (*path, u)
            if u in g.ends:
                exact = (mask.bit_count(), len(used), sign * size)
                heappush(heap, (tuple(-x for x in exact), order, 0, path, mask, used, size))
            top = bound(u, mask, len(used), size)
            if top is not None:
                heappush(heap, (tuple(-x for x in top), order, 1, path, mask, used, size))
        if g.root in self.rid:
            push(g.root, (), (), 0, frozenset(), 0)
        seen, followed = set(), 0
        while heap:
            _, order, is_open, path, mask, used, size = heappop(heap)
            if not is_open:
                return list(path)
            u = path[-1]
            inside = frozenset(x for x in path if g.part[x] == g.part[u])
            state = (u, mask, used, size, inside)
            if state in seen:
                continue
            seen.add(state)
            followed += 1
            if followed > budget:
                raise PathBudgetExceeded(f"more than {budget} partial paths for one run")
            for i, b in enumerate(g.next.get(u, ())):
                if b not in inside and b in self.rid:
                    push(b, path, (*order, i), mask, used, size)
        return []


def best_paths(hits: DataFrame, states: DataFrame, edges: DataFrame, terminals: DataFrame | None, ids: DataFrame,
               keys: Sequence[str] = ("task_id",), budget: int = BUDGET) -> DataFrame:
    """Best path of every run: keys, trajectory_id, pos, merged_id. A graph is one small row of its task
    (it is merged from k runs) and meets the runs in a join; runs are dealt freely, not by task."""
    keys = list(keys)
    letter = F.when(blank("intent_stage") == "", "-").otherwise(stage_letter(F.col("intent_stage")))
    named = states.withColumn("letter", letter).join(ids, [*keys, "sig"], "left").withColumn(
        "rid", F.when(~F.col("kind").eqNullSafe("request"), F.col("rid")))
    flagged = _flag_ends(named, edges, terminals, keys, "rid", "letter")
    nodes = flagged.groupBy(*keys).agg(F.collect_list(F.struct("merged_id", "rid", "letter", "is_end")).alias("nodes"))
    links = edges.groupBy(*keys).agg(F.collect_list(F.struct("edge_no", "src", "dst")).alias("links"))
    rows = hits.join(nodes.join(links, keys, "left"), keys)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, Search] = {}
        for x in frames:
            found = []
            for key, nodes, links, n, seqs, rids in zip(
                    zip(*(x[k] for k in keys)), x["nodes"], x["links"], x["n_cand"], x["hit_seq"], x["hit_rid"]):
                if key not in known:
                    known = {key: _prepared(nodes, links)}  # rows of one task mostly follow each other
                by_rid: dict[int, list[int]] = {}
                for s, r in zip(seqs.tolist(), rids.tolist()):
                    by_rid.setdefault(r, []).append(s)
                found.append(known[key].best(by_rid, n, budget))
            yield x[[*keys, "trajectory_id"]].assign(path=found)
    types = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "trajectory_id"]) + ", path array<int>"
    return rows.mapInPandas(walk, schema).select(*keys, "trajectory_id", F.posexplode("path").alias("pos", "merged_id"))


def _prepared(nodes, links) -> Search:
    s = pd.DataFrame([(x["merged_id"], x["is_end"]) for x in nodes], columns=["merged_id", "is_end"])
    e = pd.DataFrame([(x["edge_no"], x["src"], x["dst"]) for x in (links if links is not None else ())], columns=["edge_no", "src", "dst"])
    return Search(_Paths(s, e), {x["merged_id"]: x["rid"] for x in nodes}, {x["merged_id"]: x["letter"] for x in nodes})


def best_match_all(hits: DataFrame, states: DataFrame, edges: DataFrame, terminals: DataFrame | None, ids: DataFrame,
                   keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """``matching.best_match`` with the best of all paths in place of the best of the listed ones."""
    keys = list(keys)
    paths = best_paths(hits, states, edges, terminals, ids, keys).withColumn("path_id", F.lit(0))
    own = [*keys, "trajectory_id"]
    refs = reference_paths(paths.join(states.drop("trajectory_id", "path_id", "pos"), [*keys, "merged_id"]), ids, own, keys)
    return best_match(hits, refs, own, "canonical")
