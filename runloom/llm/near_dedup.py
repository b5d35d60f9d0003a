"""Near duplicates on SetSketch registers: band, estimate by likelihood, verify on full sets.

* **Registers.** ``REGISTERS`` truncated minima per shingle set, spaced exponentially with base
  ``SCALE``: K = floor(-log_b(min of an exponential variable)) + shift. The register-wise maximum of
  two sketches is the sketch of the union.
* **Representatives.** Documents with equal sets (128-bit sum and count) become one node, so copies
  cost one grouping and are never paired.
* **Bands.** ``BANDS`` keys of ``ROWS`` registers each. Every member of a bucket is compared with the
  bucket's smallest member: a star, linear in the bucket, never all of its pairs.
* **Likelihood.** Of the star pairs, the counts of larger, smaller and equal registers and the known
  set sizes give the maximum-likelihood similarity; what lies ``MARGIN`` deviations under the
  threshold is not a link.
* **Verification** on full sets of 64-bit shingle hashes.
* **Rest.** Only buckets of three or more members whose stars left several components can hide a
  further link. They are searched in blocks of ``BLOCK`` members with their full sets: pairs of one
  component are skipped, the rest is estimated, then verified in place, so that only links leave
  the task, and of those no more than connect its members.

At similarity 0.85 a linked pair shares no band with a probability of 2e-7, and fails the estimate
with one of 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.components import components
from runloom.llm.hashing import NOT_BLANK, Powers, Words, as_bytes, blocks, mix
from runloom.plans.store import written

WORDS = 5
BANDS, ROWS = 26, 5
#: Registers; those beyond the bands serve the estimate alone.
REGISTERS = 160
SCALE = 1.02
#: Shift and limit of a register: a 32-bit minimum gives values of -156 to 1,156.
SHIFT, LIMIT = 200, 1400
MARGIN = 5.0
BLOCK = 384

_SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, regs binary"


def _keys() -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit constants per register; the second is odd."""
    v = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (v >> np.uint64(32)).astype(np.uint32)[:, None], (v.astype(np.uint32) | np.uint32(1))[:, None]


def minima(shingles: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest of 32-bit hashes of the shingles, per register."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 1024):
        v = (high[i:i + 1024] ^ keys[0]) * keys[1]
        v ^= low[i:i + 1024]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        np.minimum(best, v.min(axis=1), out=best)
    return best


def registers(best: np.ndarray) -> np.ndarray:
    exponential = -np.log1p(-(best + 0.5) / 4294967296.0)
    return np.clip(np.floor(-np.log(exponential) / np.log(SCALE)) + SHIFT, 0, LIMIT).astype(np.int16)


def shingle_sets(texts: list[bytes | None], powers: Powers) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    for _, held in blocks(texts):
        w = Words(held, NOT_BLANK, powers)
        full = w.windows(WORDS)
        for i in range(len(held)):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= WORDS:
                yield np.unique(full[a:b - WORDS + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in w.hash[a:b]:
                    short = mix(short * np.uint64(31) + h)
                yield np.array([short], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, keys = Powers(), _keys()
    with np.errstate(over="ignore"):
        for batch in batches:
            out: list[tuple] = []
            for s in shingle_sets(as_bytes(batch.column(1)), powers):
                if len(s):
                    sums = mix(s).sum(), mix(s ^ np.uint64(0x5555555555555555)).sum()
                    out.append((len(s), *np.array(sums, np.uint64).view(np.int64).tolist(),
                                registers(minima(s, keys)).tobytes()))
                else:
                    out.append((0, 0, 0, None))
            n, h1, h2, regs = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "regs"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = [pa.array(s.view(np.int64)) for s in shingle_sets(as_bytes(batch.column(1)), powers)]
            for i in range(0, len(sets), 64):  # small batches: one set may be large
                part = sets[i:i + 64]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in part]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), lists], ["node", "s"])


def likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """The joint log-likelihood of a similarity, for pairs of register rows with known set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u, v = na / (na + nb), nb / (na + nb)
    log_b, tiny = np.log(SCALE), 1e-12

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (SCALE - 1) / SCALE) / log_b

    def value(j: np.ndarray | float) -> np.ndarray:
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        return (more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny))
                + same * np.log(np.maximum(1 - up - down, tiny)))
    return value


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The maximum-likelihood similarity, by ternary search."""
    value, low, high = likelihood(a, b, na, nb), np.zeros(len(na)), np.minimum(na / nb, nb / na)
    for _ in range(40):
        third = (high - low) / 3
        right = value(low + third) < value(high - third)
        low, high = np.where(right, low + third, low), np.where(right, high, high - third)
    return (low + high) / 2


def passes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs that may reach ``similarity``: by size (exact) and by estimate (with a wide margin)."""
    least = similarity - MARGIN * np.sqrt(similarity * (1 - similarity) / REGISTERS)
    ok = np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9
    where = np.flatnonzero(ok)
    if len(where):
        # The likelihood is concave: its peak lies above ``least`` where it still rises there.
        value = likelihood(a[where], b[where], na[where].astype(float), nb[where].astype(float))
        ok[where] = value(least + 1e-4) >= value(least)
    return ok


def _stack(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int16).reshape(-1, REGISTERS)


def _estimated(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                ok = passes(_stack(x["ra"]), _stack(x["rb"]), x["na"].to_numpy(), x["nb"].to_numpy(), similarity)
                yield x.loc[ok, ["a", "b"]]
    return run


def _rest_links(similarity: float):
    """Links of one block pair of a bucket: across components and sharing no earlier band (there
    they are found by that band's bucket); none between members that found links already connect."""
    per_mille = round(similarity * 1000)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        i, j, band = (int(x[c].iloc[0]) for c in ("i", "j", "band"))
        x = x.sort_values("node")
        left, right = x[x["block"] == i], x[x["block"] == j]
        rl, rr, sl, sr = _stack(left["regs"]), _stack(right["regs"]), left["s"].tolist(), right["s"].tolist()
        nl, nr = left["n"].to_numpy(), right["n"].to_numpy()
        cl, cr, il, ir = (d[c].to_numpy() for c in ("component", "node") for d in (left, right))
        wanted = cl[:, None] != cr[None]
        wanted &= np.minimum(nl[:, None], nr[None]) >= similarity * np.maximum(nl[:, None], nr[None]) - 1e-9
        if i == j:
            wanted = np.triu(wanted, 1)
        a, b = np.nonzero(wanted)
        above: dict[int, int] = {}

        def top(c: int) -> int:
            while above.get(c, c) != c:
                c = above[c]
            return c

        found = []
        for k in range(0, len(a), 8192):
            pl, pr = a[k:k + 8192], b[k:k + 8192]
            if band:
                same = (rl[pl, :band * ROWS] == rr[pr, :band * ROWS]).reshape(len(pl), band, ROWS).all(axis=2)
                fresh = ~same.any(axis=1)
                pl, pr = pl[fresh], pr[fresh]
            ok = passes(rl[pl], rr[pr], nl[pl], nr[pr], similarity)
            for m, n in zip(pl[ok].tolist(), pr[ok].tolist(), strict=True):
                one, two = top(int(cl[m])), top(int(cr[n]))
                if one == two:
                    continue
                both = len(np.intersect1d(sl[m], sr[n], assume_unique=True))
                if both * 1000 >= (len(sl[m]) + len(sr[n]) - both) * per_mille:
                    above[one] = two
                    found.append((min(il[m], ir[n]), max(il[m], ir[n])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
    return run


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, h1, h2 (set identity) and regs (SetSketch registers) per row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sketches, _SKETCH)


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s): the full set of every node, written once."""
    # Rows that repeat an id may differ in text; a node's set then is that of any one of them.
    texts = docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi")
    return written(texts.select("doc_id", "text").mapInArrow(_sets, "node long, s array<long>").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    sets = _full_sets(docs, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return two.where(same * 1000 >= (F.size("sa") + F.size("sb") - same) * round(similarity * 1000)).select("a", "b")


def near_groups(docs: DataFrame, similarity: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles, link with nothing and stay; a text of under five words
    is one shingle. A row without an id keeps a null component and stays. Rows that repeat an id
    are one document: each is returned, with the smallest component of the id's texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(sketch(rows), "sketches")
    usable = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    # Written, so that the join below has two plain sides, and a class of many copies can be split.
    classes = written(usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    members = written(usable.join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "node").distinct(), "members")
    nodes = written(usable.join(classes.select("h1", "h2", "n_shingles", F.col("node").alias("doc_id")),
                                ["h1", "h2", "n_shingles", "doc_id"], "left_semi")
                    .dropDuplicates(["doc_id"])
                    .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "regs"), "nodes")
    width = ROWS * 2
    # The band's number is the low bits of its key.
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("regs", k * width + 1, width)).bitwiseAND(~31).bitwiseOR(k)
                     for k in range(BANDS)])
    bands = nodes.select("node", F.explode(keys).alias("key"))
    buckets = written(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("center"))
                      .where("size > 1"), "buckets")
    shared = written(bands.join(buckets, "key"), "shared")
    spokes = shared.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    ends = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}")) for c in "ab"]
    likely_pairs = written(spokes.join(ends[0], "a").join(ends[1], "b").mapInPandas(_estimated(similarity), "a long, b long"), "spokes")
    links = written(_verified(likely_pairs, rows, similarity), "links")
    found = components(links)

    # The rest: of buckets with three members or more and several components, one per distinct set of members:
    # that of the lowest band, as the search skips pairs that an earlier band's bucket holds.
    labelled = shared.where("size > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = (labelled.groupBy("key", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                                 F.bit_xor(F.xxhash64("node")).alias("mark"), F.min("node").alias("first"))
             .where("lo <> hi").groupBy("size", "mark", "first")
             .agg(F.min_by("key", F.col("key").bitwiseAND(31)).alias("key")).select("key"))
    inside = written(labelled.join(split, "key").select("node", "component", "key", "size"), "inside")
    full = nodes.join(_full_sets(rows, inside.select("node").distinct()), "node")
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), count.cast("long")).cast("int")
    placed = inside.select("node", "component", "key", own.alias("block"), F.explode(F.sequence(F.lit(0), count - 1)).alias("partner"))
    placed = placed.select("node", "component", "key", "block", F.col("key").bitwiseAND(31).cast("int").alias("band"),
                           F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j"))
    more = written(placed.join(full, "node").groupBy("key", "i", "j").applyInPandas(_rest_links(similarity), "a long, b long")
                   .distinct(), "rest")
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links)
    # Members of one id (repeated rows with different texts) tie their classes together.
    twice = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    ties = members.join(twice.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    ties = written(ties, "ties")
    if not ties.isEmpty():
        found = components(links.unionByName(ties))
    grouped = members.join(found, "node", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "node")).alias("component_id"))
    out = sketches.select("doc_id", "n_shingles").join(grouped, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: the smallest id of each group. Rows without an
    id stay, and all rows of a repeated id stay or go together."""
    gone = near_groups(docs, similarity, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(id_col))
    return docs.join(gone.distinct(), id_col, "left_anti").select(*docs.columns)
