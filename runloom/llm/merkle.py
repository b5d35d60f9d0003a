"""Merkle manifest of a table whose parents keep SHA-256 midstates, so that a change folds cheaply.

* **Leaves** hash a row: every column as byte count, ``:`` and value, or ``-`` for null.
* **Order.** Rows are dealt by ranges of (group, id) and numbered inside their range; the starts of
  the ranges come from counts per (group, range). A group of any size spreads over many tasks.
* **Tree.** ``FAN`` consecutive nodes of a group become one parent, level by level, until one is
  left: the group's subroot. The subroots, in the order of their groups, form the tree above.
* **Midstates.** A digest in hex is 64 bytes, exactly one block of SHA-256. A parent therefore keeps,
  for each child slot, the eight words of the hash state before that child. They are stored in the
  manifest and can be resumed anywhere: a changed child costs its own block and those to its right.
* **Folding.** Rows are folded in chunks of ``FAN ** 3`` neighbours, which share the path above their
  chunk. Paths are handed down from the root, from each parent to its own children, so that no join
  has a hot key. Of equal values at the chunk's top, one is folded on.

Every step holds ``FAN`` children, one chunk of leaves or one path at a time; only the size of the
largest group reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.plans.store import written

FAN = 16
#: Levels inside a chunk of the fold.
DEPTH = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "key string, pos long, n long, digest binary, children binary, states binary"
_ENTRY = "struct<top: boolean, slot: int, digest: binary, children: binary, states: binary>"


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    """Rounded down, by Newton's method from above."""
    r = 1 << -(-x.bit_length() // 3)
    while (nxt := (2 * r + x // (r * r)) // 3) < r:
        r = nxt
    return r


#: The standard's constants: fractions of the cube and square roots of the first primes.
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)


def _hex_words() -> np.ndarray:
    """The four hex digits of every 16-bit value, as one big-endian word."""
    v, out = np.arange(65536, dtype=np.uint32), np.zeros(65536, np.uint32)
    for k in range(4):
        nibble = (v >> np.uint32(12 - 4 * k)) & np.uint32(15)
        out |= (nibble + np.where(nibble < 10, 48, 87).astype(np.uint32)) << np.uint32(24 - 8 * k)
    return out


_HEX = _hex_words()


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x >> np.uint32(k)) | (x << np.uint32(32 - k))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The hash states (8, n) after one more block (16, n) each: the compression of SHA-256."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
                 + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h))


def as_block(digest: np.ndarray) -> np.ndarray:
    """Digests (8, n) as hex text: one block (16, n)."""
    out = np.empty((16, digest.shape[1]), np.uint32)
    out[0::2], out[1::2] = _HEX[digest >> np.uint32(16)], _HEX[digest & np.uint32(0xFFFF)]
    return out


def finish(state: np.ndarray, n_blocks: np.ndarray) -> np.ndarray:
    """Digests of inputs of ``n_blocks`` whole blocks: the padding block is absorbed."""
    end = np.zeros((16, state.shape[1]), np.uint32)
    end[0], end[15] = 0x80000000, n_blocks * 512
    return absorb(state, end)


def _words(parts: Sequence[bytes]) -> np.ndarray:
    """32-byte values as (8, n) words."""
    return np.ascontiguousarray(np.frombuffer(b"".join(parts), ">u4").reshape(-1, 8).T).astype(np.uint32)


def _bytes(words: np.ndarray) -> list[bytes]:
    flat = np.ascontiguousarray(words.T).astype(">u4").tobytes()
    return [flat[i:i + 32] for i in range(0, len(flat), 32)]


def midstates(children: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests (8, n), states before each slot (FAN, 8, n)) of parents with ``children`` (FAN, 8, n),
    of which the first ``count`` are there; states beyond them are zero."""
    n = len(count)
    state = np.repeat(START[:, None], n, axis=1)
    kept = np.zeros((FAN, 8, n), np.uint32)
    for slot in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > slot)
        kept[slot][:, on] = state[:, on]
        state[:, on] = absorb(state[:, on], as_block(children[slot][:, on]))
    return finish(state, count.astype(np.uint32)), kept


def resume(before: np.ndarray, slot: np.ndarray, value: np.ndarray, children: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Digests of parents (8, n) with ``value`` in ``slot``: the state ``before`` it goes on with the
    value and the siblings to its right."""
    state = absorb(before, as_block(value))
    for k in range(1, int(count.max(initial=0))):
        on = np.flatnonzero((slot < k) & (k < count))
        if len(on):
            state[:, on] = absorb(state[:, on], as_block(children[k][:, on]))
    return finish(state, count.astype(np.uint32))


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents of rows with their children's digests (``kids``, in order)."""
    for batch in batches:
        kids = batch.column("kids").to_pylist()
        count = np.array([len(k) for k in kids], np.int64)
        flat = np.zeros((len(kids), FAN, 8), np.uint32)
        for i, k in enumerate(kids):
            flat[i, :len(k)] = np.frombuffer(b"".join(k), ">u4").reshape(-1, 8)
        digest, states = midstates(np.ascontiguousarray(flat.transpose(1, 2, 0)), count)
        kept = np.ascontiguousarray(states.transpose(2, 0, 1)).astype(">u4")
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("pos"), batch.column("n"), pa.array(_bytes(digest), pa.binary()),
             pa.array([b"".join(k) for k in kids], pa.binary()),
             pa.array([kept[i, :c].tobytes() for i, c in enumerate(count.tolist())], pa.binary())],
            ["key", "pos", "n", "digest", "children", "states"])


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (binary) of a row's values: byte count, ``:`` and value each, ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters unchanged."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def group_key(source: Column) -> Column:
    """A text that is never null and sorts like the group: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with pos (place in their ``key`` by ``order``) and n (rows of the key), written."""
    by = ["key", *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "ordered").withColumn("_part", F.shiftright("_at", 33))
    key = Window.partitionBy("key")
    starts = (dealt.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_lo"))
              .select("key", "_part", "_lo", F.sum("_c").over(key).alias("n"),
                      F.coalesce(F.sum("_c").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")))
    placed = dealt.join(written(starts, "starts"), ["key", "_part"])
    return written(placed.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_lo"))
                   .drop("_at", "_part", "_lo", "_before"), "numbered")


def tree(leaves: DataFrame) -> list[DataFrame]:
    """The levels above ``leaves`` (key, pos, n, digest): key, pos, n (nodes of the key at that
    level), digest, children, states. A key with one node at a level has nothing above it."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, below = [], leaves
    while largest > 1:
        largest = -(-largest // FAN)
        kids = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        grouped = (below.where("n > 1").groupBy("key", F.floor(F.col("pos") / FAN).alias("up"))
                   .agg(F.max("n").alias("n"), kids.alias("kids")))
        rows = grouped.select("key", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"),
                              F.transform("kids", lambda x: x["digest"]).alias("kids"))
        levels.append(written(rows.mapInArrow(_parents, _NODE), f"level{len(levels) + 1}"))
        below = levels[-1]
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, height, digest): the last node of every key."""
    out = leaves.where("n = 1").select("key", F.lit(0).alias("height"), "digest")
    for k, level in enumerate(levels):
        out = out.unionByName(level.where("n = 1").select("key", F.lit(k + 1).alias("height"), "digest"))
    return out


def _children(parents: DataFrame, top: bool) -> DataFrame:
    """(key, pos, path) of the children of nodes that carry their ``path``; nearest entries first."""
    slots = F.sequence(F.lit(0), (F.octet_length("children") / 32).cast("int") - 1)
    down = parents.select("*", F.explode(slots).alias("slot"))
    entry = F.struct(F.lit(top).alias("top"), "slot", "digest", "children", "states")
    return down.select("key", (F.col("pos") * FAN + F.col("slot")).alias("pos"), F.concat(F.array(entry), "path").alias("path"))


def _paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, top_levels: list[DataFrame]) -> DataFrame:
    """(key, chunk, path) of every chunk of leaves: what lies above its own levels, up to the root."""
    none = F.array().cast(f"array<{_ENTRY}>")
    if top_levels:
        at = top_levels[-1].withColumn("path", none)
        for k in range(len(top_levels) - 1, -1, -1):
            below = _children(at, True)
            at = top_levels[k - 1].join(below, ["key", "pos"]) if k else below
        begun = tops.join(at.select("pos", "path"), "pos").select(F.col("group").alias("key"), "height", "path")
    else:
        begun = tops.select(F.col("group").alias("key"), "height", none.alias("path"))
    begun = written(begun, "begun")
    out = begun.where(F.col("height") <= DEPTH).select("key", F.lit(0).cast("long").alias("pos"), "path")
    at = None
    for height in range(len(levels), DEPTH, -1):
        here = begun.where(F.col("height") == height).select("key", F.lit(0).cast("long").alias("pos"), "path")
        at = _children(levels[height - 1].join(here.unionByName(at) if at is not None else here, ["key", "pos"]), False)
    return (out.unionByName(at) if at is not None else out).withColumnRenamed("pos", "chunk")


def _hexes(parts: bytes) -> bytes:
    return parts.hex().encode()


def _fold(left: pa.Table, right: pa.Table) -> pa.Table:
    """All leaves of one chunk: proof digest and the root from the changed or the own digest."""
    with np.errstate(over="ignore"):
        pos = np.array(left.column("pos").to_pylist(), np.int64)
        own = left.column("digest").to_pylist()
        value = _words([c or d for c, d in zip(left.column("changed").to_pylist(), own, strict=True)])
        at, n = pos, len(pos)
        nodes = {(r["level"], r["pos"]): r for r in right.to_pylist() if r["path"] is None}
        path = next((r["path"] for r in right.to_pylist() if r["path"] is not None), [])
        inner: list[dict] = []
        for level in range(1, DEPTH + 1):
            slot, at = at % FAN, at // FAN
            rows = sorted(p for k, p in nodes if k == level)
            if not rows:
                break
            held = [nodes[level, p] for p in rows]
            count = np.array([len(r["children"]) // 32 for r in held], np.int64)
            kids = np.zeros((len(held), FAN, 8), np.uint32)
            states = np.zeros((len(held), FAN, 8), np.uint32)
            for i, r in enumerate(held):
                kids[i, :count[i]] = np.frombuffer(r["children"], ">u4").reshape(-1, 8)
                states[i, :count[i]] = np.frombuffer(r["states"], ">u4").reshape(-1, 8)
            i = np.searchsorted(rows, at)
            value = resume(np.ascontiguousarray(states[i, slot].T), slot, value,
                           kids[i].transpose(1, 2, 0), count[i])
            inner.append({"slot": slot.tolist(), "i": i.tolist(), "hex": [_hexes(r["children"]) for r in held]})
            subroot = held[0]["digest"]
        # Above the chunk there is one path; equal values are folded once.
        distinct, back = np.unique(value.T, axis=0, return_inverse=True)
        value = np.ascontiguousarray(distinct.T)
        above = b""
        subroot = subroot if inner else own[0]
        root = subroot
        for e in path:
            count, slot = len(e["children"]) // 32, e["slot"]
            m = value.shape[1]
            kids = np.frombuffer(e["children"], ">u4").reshape(-1, 8).astype(np.uint32)
            before = np.frombuffer(e["states"], ">u4").reshape(-1, 8)[slot].astype(np.uint32)
            value = resume(np.repeat(before[:, None], m, axis=1), np.full(m, slot), value,
                           np.repeat(kids[:, :, None], m, axis=2), np.full(m, count))
            text = _hexes(e["children"])
            above += text[:64 * slot] + text[64 * (slot + 1):]
            root = e["digest"]
            if not e["top"]:
                subroot = e["digest"]
        folded = [x.hex() for x in _bytes(value)]
        proofs = []
        for j in range(n):
            h = hashlib.sha256()
            for step in inner:
                text, slot = step["hex"][step["i"][j]], step["slot"][j]
                h.update(text[:64 * slot])
                h.update(text[64 * (slot + 1):])
            h.update(above)
            proofs.append(h.hexdigest())
    result = [folded[k] for k in back.reshape(-1).tolist()]
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    columns = [[d.hex() for d in own], [subroot.hex()] * n, [root.hex()] * n, proofs, result, [r == root.hex() for r in result]]
    kinds = [pa.string()] * 5 + [pa.bool_()]
    return pa.Table.from_arrays([left.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", *names])


class Manifest:
    """The tree over (key, doc_id, digest, changed) rows: ``leaves``, ``levels`` of the groups, the
    ``tops`` of the groups numbered in their order, and ``top_levels`` above them."""

    def __init__(self, rows: DataFrame) -> None:
        self.leaves = numbered(rows, ["doc_id", "digest", "changed"])
        self.levels = tree(self.leaves)
        tops = _tops(self.leaves, self.levels).select(F.lit("").alias("key"), F.col("key").alias("group"), "height", "digest")
        self.tops = numbered(tops, ["group"])
        self.top_levels = tree(self.tops)

    def root(self) -> DataFrame:
        """One row (root) with the digest in hex; none for an empty table."""
        return _tops(self.tops, self.top_levels).select(F.lower(F.hex("digest")).alias("root"))

    def nodes(self) -> DataFrame:
        """The manifest as a table: tree ('group' or 'top'), key, level, pos, n, digest, children, states."""
        out = None
        for name, levels in (("group", self.levels), ("top", self.top_levels)):
            for k, level in enumerate(levels):
                rows = level.select(F.lit(name).alias("tree"), F.lit(k + 1).alias("level"), "*")
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.leaves.sparkSession.createDataFrame([], f"tree string, level int, {_NODE}")

    def fold(self) -> DataFrame:
        """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root (with ``changed`` in the
        leaf's place where it is set), verified."""
        size = FAN ** DEPTH
        docs = self.leaves.select("key", F.floor(F.col("pos") / size).alias("chunk"), "pos", "doc_id", "digest", "changed")
        paths = _paths(self.leaves, self.levels, self.tops, self.top_levels)
        right = paths.select("key", "chunk", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("pos"),
                             *[F.lit(None).cast("binary").alias(c) for c in ("digest", "children", "states")], "path")
        for k, level in enumerate(self.levels[:DEPTH]):
            right = right.unionByName(level.select(
                "key", F.floor(F.col("pos") / FAN ** (DEPTH - k - 1)).alias("chunk"), F.lit(k + 1).alias("level"), "pos",
                "digest", "children", "states", F.lit(None).cast(f"array<{_ENTRY}>").alias("path")))
        return docs.groupBy("key", "chunk").cogroup(right.groupBy("key", "chunk")).applyInArrow(
            _fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, changed: Column | None = None,
             id_col: str = "doc_id", group_col: str = "source") -> Manifest:
    """The manifest of ``docs``; ``changed`` is the binary digest of a changed row, null for the others.

    Every row is a leaf: repeated ids are leaves of their own, ordered by digest; rows without an id
    come first in their group, and rows without a group form the first group. Null values count as
    null, empty ones as empty. An empty table gives no root and no rows. Columns beyond ``columns``
    are neither hashed nor needed.
    """
    changed = changed if changed is not None else F.lit(None).cast("binary")
    rows = docs.select(group_key(F.col(group_col)).alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                       row_digest([F.col(c) for c in columns]).alias("digest"), changed.alias("changed"))
    # Written first: dealing by ranges would otherwise hash all texts once more to sample them.
    return Manifest(written(rows, "leaves"))


def verify_tampered(docs: DataFrame, every: int = 5) -> DataFrame:
    """The manifest of ``docs`` checked against rows whose text was lower-cased (A-Z) wherever ``every``
    divides the crc32 of the id. A tampered row without such letters, or without a text, still
    verifies; a row without an id is never tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    other = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
    return manifest(docs, changed=F.when(hit, row_digest(other))).fold()
