"""Exact Jaccard join on word n-grams by rare-first prefix filtering.

* **Classes.** Texts with equal sets (128-bit sum and count) are one node; copies are never paired.
* **Rare first.** All shingles of the corpus are counted in ``1 << RANK_BITS`` hash buckets. The order
  of shingles is that of their buckets' counts (in quarter octaves), then of the shingle itself. The
  table has one byte a bucket, so what is broadcast has a fixed size; a shingle that shares a bucket
  with a frequent one merely comes later. Any order gives the same links.
* **Prefix.** Of two sets that link, the first n - ceil(t n) + 1 shingles each have one in common.
  Nodes meet in the list of such a shingle.
* **Length and position.** At the first common shingle, both sets need enough shingles from it on. For
  a member of n shingles at place p this bounds the partner's size: t n <= m <= (n - p) (1 + t) / t - n.
  A member whose neighbours by size in the list are both out of reach leaves the list.
* **Suffix.** Counts of both sets by ``PARTS`` partitions of the shingles bound what can be shared.
* **Verification** on full sets of 64-bit shingle hashes, once per pair.

``jaccard_links`` returns every link between nodes. ``jaccard_groups`` wants components only: each
list's members are first compared with one of them (a star, linear in the list), then only
members of different components with each other. That search deals a list into bands of partner
sizes and blocks of ``BLOCK`` members with 32 bytes a row, and returns at most ``few`` pairs of two
components per block. Where it had more, it runs again after these are verified, with eight times
as many, until none is held back: so links are never lost, and two components that one link
connects cost no further pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import isqrt, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.components import components
from runloom.llm.hashing import NOT_BLANK, Powers, Words, as_bytes, blocks, mix
from runloom.plans.store import drop_path, shared_path, written

WORDS = 4
PERCENT = 85
#: Buckets of the frequency table, one byte each when it is broadcast.
RANK_BITS, SLICE_BITS = 23, 16
PARTS = 64
BLOCK = 2048
#: Lists of up to so many members are joined as they are.
SHORT = 64
#: Pairs of two components that a block returns in the first round.
FEW = 8
#: Up to so many ids are broadcast to pick the texts that are verified; beyond, they are joined.
BROADCAST_IDS = 250_000

_IDENTITY = "doc_id long, n int, h1 long, h2 long"
_CODEC = "zstd"


def shingle_sets(texts: list[bytes | None], words: int, powers: Powers) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than ``words`` are one shingle."""
    for _, held in blocks(texts):
        w = Words(held, NOT_BLANK, powers)
        full = w.windows(words)
        for i in range(len(held)):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= words:
                yield np.unique(full[a:b - words + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in w.hash[a:b]:
                    short = mix(short * np.uint64(31) + h)
                yield np.array([short], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def _identity(s: np.ndarray) -> tuple[int, int, int]:
    sums = np.array([mix(s).sum(), mix(s ^ np.uint64(0x5555555555555555)).sum()], np.uint64).view(np.int64)
    return len(s), int(sums[0]), int(sums[1])


def _counted(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, n, h1, h2) per document; at the end the task's bucket counts as rows (slice, counts)."""
    powers, names = Powers(), ["doc_id", "n", "h1", "h2", "slice", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    counts = np.zeros(1 << RANK_BITS, np.uint32)
    with np.errstate(over="ignore"):
        for batch in batches:
            rows = []
            for s in shingle_sets(as_bytes(batch.column(1)), words, powers):
                np.add.at(counts, (s >> np.uint64(64 - RANK_BITS)).astype(np.int64), np.uint32(1))
                rows.append(_identity(s))
            n, h1, h2 = zip(*rows, strict=True) if rows else ((), (), ())
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip((n, h1, h2, none, none), kinds[1:], strict=True)]], names)
    held = [(i, c) for i, c in enumerate(counts.reshape(-1, 1 << SLICE_BITS)) if c.any()]
    none = [None] * len(held)
    blobs = [pa.compress(c.tobytes(), codec=_CODEC, asbytes=True) for _, c in held]
    columns = (none, none, none, none, [i for i, _ in held], blobs)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(1 << SLICE_BITS, np.uint64)
    for blob in rows.column("counts"):
        total += np.frombuffer(pa.decompress(blob.as_py(), total.size * 4, codec=_CODEC), np.uint32)
    total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": [pa.compress(total.tobytes(), codec=_CODEC, asbytes=True)]})


def rank_table(counts: DataFrame) -> np.ndarray:
    """One byte per bucket, rising with the count, from the (slice, counts) rows of all tasks. Added up
    on executors, in two steps where there are many tasks; the driver gets 8 MB whatever the input."""
    tasks = counts.count() >> (RANK_BITS - SLICE_BITS)
    salts = 1 + isqrt(tasks) // 16
    kind = "slice int, counts binary"
    if salts > 1:
        counts = counts.groupBy("slice", F.pmod(F.xxhash64("counts"), F.lit(salts)).alias("salt")).applyInArrow(_added, kind)
    table = np.zeros((1 << (RANK_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in counts.groupBy("slice").applyInArrow(_added, kind).toLocalIterator():
        table[r["slice"]] = np.log2(np.frombuffer(pa.decompress(r["counts"], table.shape[1] * 4, codec=_CODEC), np.uint32) + 1.0) * 4
    return table.reshape(-1)


def need(n: Column | np.ndarray, percent: int):
    """ceil(percent * n / 100)."""
    return (n * percent + 99) // 100 if not isinstance(n, Column) else F.floor((n * percent + 99) / 100)


def _prefixes(words: int, percent: int, ranks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identity, prefix (shingles in their order) and counts by partition of every text that has shingles."""
    powers, rank = Powers(), ranks.value
    with np.errstate(over="ignore"):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, s in zip(ids, shingle_sets(as_bytes(batch.column(1)), words, powers), strict=True):
                if len(s) and doc_id is not None:
                    n = len(s)
                    p = n - need(n, percent) + 1
                    level = rank[(s >> np.uint64(64 - RANK_BITS)).astype(np.int64)]
                    # Stable by level: equal levels stay in the order of the shingles themselves.
                    first = s[np.argsort(level, kind="stable")[:p]].view(np.int64)
                    parts = np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
                    rows.append((doc_id, *_identity(s), first, parts.astype(np.uint8).tobytes() if parts.max() < 256 else None))
            for i in range(0, len(rows), 256):
                doc_id, n, h1, h2, first, parts = zip(*rows[i:i + 256], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id, pa.int64()), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                     pa.array(first, pa.list_(pa.int64())), pa.array(parts, pa.binary())], ["doc_id", "n", "h1", "h2", "prefix", "parts"])


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    with np.errstate(over="ignore"):
        for batch in batches:
            sets = list(shingle_sets(as_bytes(batch.column(0)), words, powers))
            for i in range(0, len(sets), 64):  # small batches: one set may be large
                part = sets[i:i + 64]
                n, h1, h2 = zip(*map(_identity, part), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                     pa.array([s.view(np.int64) for s in part], pa.list_(pa.int64()))], ["n", "h1", "h2", "s"])


def _suffix(percent: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose counts by partition leave enough common shingles."""
    for x in batches:
        if len(x):
            whole = (x["pa"].notna() & x["pb"].notna()).to_numpy()
            ok = ~whole  # texts beyond the counters' range are verified in any case
            if whole.any():
                a, b = (np.frombuffer(b"".join(x.loc[whole, c]), np.uint8).reshape(-1, PARTS) for c in ("pa", "pb"))
                n = x.loc[whole, "na"].to_numpy(np.int64) + x.loc[whole, "nb"].to_numpy(np.int64)
                ok[whole] = np.minimum(a, b).sum(axis=1, dtype=np.int64) * (100 + percent) >= n * percent
            yield x.loc[ok, ["a", "b"]]


def _reach(n: Column, pos: Column, percent: int) -> Column:
    """The largest partner of a set of ``n`` shingles that meets it first at place ``pos``."""
    return F.floor((n - pos) * (100 + percent) / percent) - n


def _block_pairs(x: pd.DataFrame, percent: int, few: int | None) -> pd.DataFrame:
    """Pairs of one block: a smaller (or equal) set with a larger one, by length and position, of
    different components; at most ``few`` of any two components, ``more`` if some were held back."""
    one, two = x[x["small"]], x[~x["small"]].sort_values(["n", "node"])
    size = two["n"].to_numpy()
    node, pos, component = (two[c].to_numpy() for c in ("node", "pos", "component"))
    reach = (size - pos) * (100 + percent) // percent - size
    a: list[int] = []
    b: list[int] = []
    more, taken = False, {}
    for n, i, c, most in zip(*(one[x].tolist() for x in ("n", "node", "component", "reach")), strict=True):
        lo, hi = np.searchsorted(size, n), np.searchsorted(size, most, side="right")
        ok = (reach[lo:hi] >= n) & (component[lo:hi] != c) & ((size[lo:hi] > n) | (node[lo:hi] > i))
        hit = lo + np.flatnonzero(ok)
        for j, other in zip(node[hit].tolist(), component[hit].tolist(), strict=True):
            if few is not None:
                key = (c, other) if c < other else (other, c)
                k = taken.get(key, 0)
                if k >= few:
                    more = True
                    continue
                taken[key] = k + 1
            a.append(min(i, j))
            b.append(max(i, j))
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "more": more})


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder, and its path, to be dropped when all that rests on it is written."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class _Join:
    """The tables of one join: classes, members, parts (node, n, parts) and shared (token, node, n, pos, center)."""

    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> None:
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.words, self.percent = words, percent
        spark = docs.sparkSession
        counted, path = _kept(self.rows.mapInArrow(partial(_counted, words), f"{_IDENTITY}, slice int, counts binary"), "counted")
        self.identity = written(counted.where("slice IS NULL").select("doc_id", "n", "h1", "h2"), "identity")
        ranks = spark.sparkContext.broadcast(rank_table(counted.where("slice IS NOT NULL").select("slice", "counts")))
        drop_path(spark, path)
        usable = self.identity.where("doc_id IS NOT NULL AND n > 0")
        key = ["h1", "h2", "n"]
        # Written, so that node numbers stay, and a class of many copies can be split in the joins below.
        self.classes = written(usable.groupBy(*key).agg(F.min("doc_id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "classes")
        self.members = written(usable.join(self.classes.select(*key, "node"), key).select("doc_id", "node").distinct(), "members")
        prefixes = self.rows.mapInArrow(partial(_prefixes, words, percent, ranks), f"{_IDENTITY}, prefix array<long>, parts binary")
        own = prefixes.join(self.classes.withColumnRenamed("first", "doc_id"), [*key, "doc_id"])
        own, path = _kept(own.select("node", "n", "prefix", "parts"), "own")
        self.parts = written(own.select("node", "n", "parts"), "parts")
        where = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")  # size and place in one number: half the shuffle
        postings = own.select("node", "n", F.posexplode("prefix").alias("pos", "token")).where(
            _reach(F.col("n").cast("long"), F.col("pos"), percent) >= need(F.col("n").cast("long"), percent)).select("token", "node", where.alias("at"))
        # One shuffle and one sort, by shingle and size: a member stays if its neighbour below is large enough
        # or its neighbour above small enough to link with it; otherwise no member of the list is.
        by_size = Window.partitionBy("token").orderBy("at")
        near = postings.select("*", F.lag("at").over(by_size).alias("_less"), F.lead("at").over(by_size).alias("_more"))
        met = near.select("token", "node", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(0x7FFFFFFF).alias("pos"), "_less", "_more")
        fits = (F.shiftright("_less", 32) >= need(F.col("n"), percent)) | (F.shiftright("_more", 32) <= _reach(F.col("n"), F.col("pos"), percent))
        met = met.where(fits).select("token", "node", "n", "pos")
        # The center is the member with the fewest rarer shingles of its own: of edited copies, the original.
        members = Window.partitionBy("token")
        self.shared = written(met.select("*", F.min(F.struct("pos", "node", "n")).over(members).alias("center"), F.count(F.lit(1)).over(members).alias("members")).where("members > 1"), "shared")
        drop_path(spark, path)

    def star_pairs(self) -> DataFrame:
        """(a, b): members that can link with their list's center."""
        n, pos = F.col("center.n"), F.col("center.pos")
        fits = (_reach(n, pos, self.percent) >= F.col("n")) & (_reach(F.col("n"), F.col("pos"), self.percent) >= n)
        return self.shared.where((F.col("node") != F.col("center.node")) & fits).select(
            F.least("center.node", "node").alias("a"), F.greatest("center.node", "node").alias("b")).distinct()

    def list_pairs(self, labels: DataFrame | None, few: int | None) -> DataFrame:
        """(a, b, more): pairs of members that can link, without those of the stars; with ``labels`` only
        across components, without them all pairs, stars included."""
        percent = self.percent
        rows = self.shared.withColumn("reach", _reach(F.col("n"), F.col("pos"), percent))
        if labels is None:
            rows = rows.withColumn("component", F.col("node"))
        else:
            rows = rows.where("members > 2 AND node <> center.node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = written(rows.select("token", "node", "n", "pos", "reach", "component"), "labelled")
        split = rows.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("members")).where("_lo <> _hi")
        rows = written(rows.join(split.select("token", "members"), "token"), "split")
        pairs = self._short_lists(rows.where(F.col("members") <= SHORT)).withColumn("more", F.lit(False))
        long_lists = rows.where(F.col("members") > SHORT)
        if not long_lists.isEmpty():
            pairs = pairs.unionByName(self._long_lists(long_lists, few))
        return written(pairs, "pairs")

    @staticmethod
    def _short_lists(rows: DataFrame) -> DataFrame:
        """A join on the shingle: at most ``SHORT`` members meet."""
        one, two = ([F.col(c).alias(f"{c}{k}") for c in ("node", "n", "reach", "component")] for k in "ab")
        met = rows.where("reach >= n").select("token", *one).join(rows.select("token", *two), "token")
        return met.where("componenta <> componentb AND nb <= reacha AND na <= reachb AND (nb > na OR nb = na AND nodeb > nodea)").select(
            F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b"))

    def _long_lists(self, rows: DataFrame, few: int | None) -> DataFrame:
        """Blocks of members by bands of sizes, two between n and the largest partner n / t."""
        percent = self.percent

        def search(x: pd.DataFrame) -> pd.DataFrame:
            return _block_pairs(x, percent, few)

        def band(n: Column) -> Column:
            return F.floor(F.log(n.cast("double")) * (2 / -log(percent / 100)) + 1e-9).cast("int")
        columns = ["token", "node", "n", "pos", "component", "reach"]
        small = rows.where("reach >= n").select(*columns, F.lit(True).alias("small"), F.explode(F.sequence(band(F.col("n")), band(F.col("reach")))).alias("band"))
        large = rows.select(*columns, F.lit(False).alias("small"), band(F.col("n")).alias("band"))
        both = written(small.unionByName(large), "banded")
        size = both.groupBy("token", "band").agg(F.count_if("small").alias("_s"), F.count_if(~F.col("small")).alias("_l")).where("_s > 0 AND _l > 0")
        grid = size.select("token", "band", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("_s", "_l")])
        placed = both.join(grid, ["token", "band"])
        mine, theirs = (F.when(F.col("small"), F.col(a)).otherwise(F.col(b)) for a, b in (("_s", "_l"), ("_l", "_s")))
        placed = placed.withColumn("_mine", F.pmod(F.xxhash64("node"), mine).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), theirs - 1)))
        i, j = (F.when(F.col("small"), F.col(a)).otherwise(F.col(b)) for a, b in (("_mine", "_other"), ("_other", "_mine")))
        keyed = placed.select("node", "n", "pos", "component", "reach", "small", F.struct("token", "band", i.alias("i"), j.alias("j")).alias("block"))
        return keyed.groupBy("block").applyInPandas(search, "a long, b long, more boolean")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, overlap, size): the pairs, each once, whose full sets link; size is that of their union."""
        for c in "ab":
            pairs = pairs.join(self.parts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parts").alias(f"p{c}")), c)
        likely = written(pairs.mapInPandas(partial(_suffix, self.percent), "a long, b long"), "likely")
        nodes = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct()
        needed = written(self.classes.join(nodes, "node"), "needed")
        ids = needed.select(F.col("first").alias("doc_id")).distinct()
        if needed.count() <= BROADCAST_IDS:
            ids, needed = F.broadcast(ids), F.broadcast(needed)
        sets = self.rows.join(ids, "doc_id", "left_semi").select("text").mapInArrow(partial(_sets, self.words), "n int, h1 long, h2 long, s array<long>")
        # Repeated rows give a set twice; the links are made distinct instead of the sets.
        sets = written(sets.join(needed.select("h1", "h2", "n", "node"), ["h1", "h2", "n"]).select("node", "s"), "sets")
        ends = [sets.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")) for c in "ab"]
        few = likely.count() <= BROADCAST_IDS
        likely = ends[0].join(F.broadcast(likely) if few else likely, "a").join(ends[1], "b")
        both = likely.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("overlap"), (F.size("sa") + F.size("sb")).alias("_sum"))
        linked = both.select("a", "b", "overlap", (F.col("_sum") - F.col("overlap")).alias("size"))
        return written(linked.where(F.col("overlap").cast("long") * 100 >= F.col("size").cast("long") * self.percent).distinct(), "links")


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): every link between different sets as (a, b, overlap, size) of nodes, and the
    (doc_id, node) membership. Copies are not expanded into pairs; the result has as many rows as there
    are links. Texts without words and rows without an id are in neither."""
    join = _Join(docs, words, percent, id_col, text_col)
    return join.verified(join.list_pairs(None, None).select("a", "b").distinct()), join.members


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                   few: int = FEW) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Links are those of 100 * intersection >= ``percent`` * union. Null and empty texts have no shingles
    and link with nothing; a text of fewer than ``words`` words is one shingle. A row without an id
    has a null component. Rows that repeat an id are one document: each is returned with its own
    n_shingles and with the smallest component of the id's texts.
    """
    join = _Join(docs, words, percent, id_col, text_col)
    links = join.verified(join.star_pairs()).select("a", "b")
    # Rows of one id with different texts tie their classes together.
    twice = join.members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_z")).where("a <> _z").select("doc_id", "a")
    ties = written(join.members.join(twice, "doc_id").where("node <> a").select("a", F.col("node").alias("b")), "ties")
    links = links.unionByName(ties)
    found = components(links)
    while True:
        pairs = join.list_pairs(found, few)
        if pairs.isEmpty():
            break
        fresh = join.verified(pairs.select("a", "b").distinct()).select("a", "b")
        links = written(links.unionByName(fresh), "links")
        found = components(links)
        if pairs.where("more").isEmpty():
            break
        few *= 8
    named = written(join.members.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_doc = named.join(smallest, "component").select("doc_id", "component_id").distinct()
    return join.identity.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(of_doc, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
