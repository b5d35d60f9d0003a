"""Benchmark decontamination by windows of words.

Windows of ``WINDOW`` item words (a shorter item is one window) are hashed, and the sorted hashes
with the items' words are broadcast. Every task scans all word windows of its documents against
them with numpy and compares the words of each hit. The broadcast happens only while the items
hold at most ``BROADCAST_BYTES`` of text; beyond that, document windows are shuffled and joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.hashing import LETTERS_DIGITS, Powers, Words, as_bytes, blocks
from runloom.plans.store import written

WINDOW = 10
BROADCAST_BYTES = 32 << 20
_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class ItemWindows:
    """Sorted distinct windows of the benchmark items: hash, length, words, and items that have it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        powers = Powers()
        rows: dict[bytes, list] = {}
        with np.errstate(over="ignore"):
            for start, held in blocks([t for _, t in items]):
                w = Words(held, LETTERS_DIGITS, powers)
                by_size: dict[int, np.ndarray] = {}
                for i in range(len(held)):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    size = min(window, b - a)
                    if not size:
                        continue
                    if size not in by_size:
                        by_size[size] = w.windows(size)
                    for k in range(a, b - size + 1):
                        text = b" ".join(bytes(w.data[w.start[x]:w.end[x]]) for x in range(k, k + size))
                        row = rows.setdefault(text, [int(by_size[size][k]), size, set()])
                        row[2].add(items[start + i][0])
        ordered = sorted(rows.items(), key=lambda r: r[1][0])
        self.hash = np.array([r[0] for _, r in ordered], np.uint64)
        self.size = np.array([r[1] for _, r in ordered], np.int64)
        self.words = [t for t, _ in ordered]
        self.items = [sorted(r[2]) for _, r in ordered]
        #: 2^22 bits by the top of the hash: most windows end here.
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, w: Words, at: np.ndarray, hashes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(word, window) of windows of ``size`` words that start at ``at`` and occur in an item."""
        at = at[self.bits[(hashes[at] >> np.uint64(42)).astype(np.int64)]]
        if not len(at) or not len(self.hash):
            return
        low, high = np.searchsorted(self.hash, hashes[at], "left"), np.searchsorted(self.hash, hashes[at], "right")
        for k, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            for row in range(a, b):
                if self.size[row] == size and self.words[row] == b" ".join(
                        bytes(w.data[w.start[x]:w.end[x]]) for x in range(k, k + size)):
                    yield k, row


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _scan(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: ItemWindows = shared.value
        sizes, powers = np.unique(table.size).tolist(), Powers()
        for batch in batches:
            out = []
            with np.errstate(over="ignore"):
                for _, held in blocks(as_bytes(batch.column(1))):
                    w = Words(held, LETTERS_DIGITS, powers)
                    total = len(w.hash)
                    mark = np.zeros(total + 1, np.int32)
                    owner = np.repeat(np.arange(len(held)), np.diff(w.first))
                    found: dict[int, set] = {}
                    for size in sizes:
                        if total < size:
                            continue
                        # A window must end in the text it starts in.
                        at = np.flatnonzero(owner[size - 1:] == owner[:total - size + 1])
                        for k, row in table.hits(w, at, w.windows(size), size):
                            mark[k] += 1
                            mark[k + size] -= 1
                            found.setdefault(int(owner[k]), set()).update(table.items[row])
                    covered = np.concatenate(([0], np.cumsum(np.cumsum(mark[:total]) > 0)))
                    for i in range(len(held)):
                        a, b = int(w.first[i]), int(w.first[i + 1])
                        n = int(covered[b] - covered[a])
                        items = found.get(i, set())
                        out.append((b - a, n, len(items), digest(items), n > 0))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    return run


def _windows(sizes: list[int]):
    """Rows (row_id, at, size, words) of every word window of the given sizes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, held in blocks(as_bytes(batch.column(1)), 1 << 16):
                with np.errstate(over="ignore"):
                    w = Words(held, LETTERS_DIGITS, powers)
                for i in range(len(held)):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    words = [bytes(w.data[w.start[x]:w.end[x]]) for x in range(a, b)]
                    for size in sizes:
                        n = max(0, b - a - size + 1)
                        for k in range(0, n, 4096):
                            at = range(k, min(k + 4096, n))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([ids[start + i]] * len(at)), pa.array(at, pa.int64()),
                                 pa.array([size] * len(at), pa.int64()),
                                 pa.array([b" ".join(words[x:x + size]) for x in at], pa.binary())],
                                ["row_id", "at", "size", "words"])
    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        out = []
        for _, held in blocks(as_bytes(batch.column(1))):
            with np.errstate(over="ignore"):
                out.extend(np.diff(Words(held, LETTERS_DIGITS, powers).first).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["row_id", "n_words"])


def _own_windows(window: int):
    """Rows (item_id, size, words) of the items' windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                one = ItemWindows([(name, text or b"")], window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(one.words), pa.string()), pa.array(one.size, pa.int64()), pa.array(one.words, pa.binary())],
                    ["item_id", "size", "words"])
    return run


def _joined(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The same result by shuffling windows, for benchmarks too large to broadcast.

    Windows are grouped by their words on the item side; hot windows of documents are one row per
    place and are dealt by (words), which adaptive execution splits. Hit words are counted from
    window starts in order, so no word list is built.
    """
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    own = written(items.mapInArrow(_own_windows(window), "item_id string, size long, words binary").distinct(), "items")
    sizes = [r["size"] for r in own.select("size").distinct().collect()]  # at most ``window`` of them
    known = own.select("size", "words").distinct()
    places = rows.select("row_id", "text").mapInArrow(_windows(sizes), "row_id long, at long, size long, words binary")
    hits = written(places.join(known, ["size", "words"]), "hits")
    names = (hits.select("row_id", "size", "words").distinct().join(own, ["size", "words"])
             .groupBy("row_id").agg(F.sort_array(F.collect_set("item_id")).alias("names")))
    from pyspark.sql import Window
    order = Window.partitionBy("row_id").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("size")
    reach = F.greatest(F.coalesce(F.max(end).over(order), F.lit(0)), F.col("at"))
    cover = (hits.select("row_id", "at", "size", F.greatest(end - reach, F.lit(0)).alias("fresh"))
             .groupBy("row_id").agg(F.sum("fresh").alias("n_hit")))
    counts = rows.select("row_id", "text").mapInArrow(_counts, "row_id long, n_words long")
    out = rows.select("row_id", "doc_id").join(counts, "row_id").join(cover, "row_id", "left").join(names, "row_id", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.size(F.coalesce("names", none)).cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.coalesce("names", none), ","), 256).alias("items_sha256"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; items without words or without an id never occur. Rows may
    repeat ids. Items with equal windows all count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(rows, items, window)
    table = ItemWindows([(r["item_id"], r["text"].encode()) for r in items.toLocalIterator()], window)
    return rows.mapInArrow(_scan(spark.sparkContext.broadcast(table), window), _RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any hit, all columns; rows without an id are judged by their own text."""
    packed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("doc_id"), F.col("text"))
    packed = written(packed, "packed")
    hit = contamination(packed, benchmark, window).where("contaminated").select("doc_id")
    return packed.join(hit, "doc_id", "left_anti").select("row.*")
