"""Periodic runs of words inside documents: maximal stretches that repeat a period four times or more.

Seed and extend on diagonals. A run of smallest period q holds, on the diagonal of lag q, at least
max(6, 4q) - q equal pairs, so every class of lags has a guaranteed overlap:

* **Classes.** Lags from ``lo`` to ``k`` share the gram length k = overlap(lo); the next class
  starts at k + 1, so a text of n words has about log3(n) classes.
* **Seeds.** k-grams are named by hashes built from the names of the class before. As k is no less
  than the period, the next place of a gram of a run lies exactly one period on (two periods of one
  stretch of both lengths would have a common divisor as period, which is smaller). One pair per
  gram, that with its next place, is therefore enough; no list of all pairs is made.
* **Extension.** Seeds go by lag and place. A table of the furthest place covered per lag skips
  seeds inside a stretch that is known; others are extended both ways by comparing word ids. What
  is reported rests on these comparisons alone. By the same reasoning the lag of a seed is the
  smallest period of its stretch.

Documents are independent rows; a task holds one Arrow batch, in blocks of about a megabyte of text
(one longer text is a block of its own). No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.hashing import as_bytes, blocks, mix

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def overlap(lag: int) -> int:
    """Equal pairs that a run of this period has at least on its diagonal."""
    return max(LEAST_LENGTH, LEAST_EXPONENT * lag) - lag


def _longer(names: np.ndarray, size: int, k: int) -> np.ndarray:
    """Names of k-grams from those of ``size``-grams: a hash of overlapping ones that cover them."""
    n = len(names) - (k - size)
    out = np.full(n, np.uint64(k))
    for j, at in enumerate(sorted({*range(0, k - size + 1, size), k - size})):
        out += mix(names[at:at + n] + _STEP * np.uint64(j + 1))
    return mix(out)


def _forward(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """The first place from ``at`` on, below ``stop``, that differs from the place one lag on; else ``stop``."""
    step = 64
    while at < stop:
        m = min(step, stop - at)
        differ = ids[at:at + m] != ids[at + lag:at + lag + m]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + m, step * 2
    return stop


def _backward(ids: np.ndarray, at: int, lag: int, least: int) -> int:
    """The smallest place from which all places below ``at`` equal the place one lag on."""
    step = 64
    while at > least:
        m = min(step, at - least)
        differ = (ids[at - m:at] != ids[at - m + lag:at + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, step = at - m, step * 2
    return least


def find_runs(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs, sorted, of texts whose word ids are
    ``ids[first[t]:first[t + 1]]``; starts count from the text's first word."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = first[1:][text] - np.arange(len(ids))
    own_size = sizes[text]
    found: list[tuple[int, int, int, int]] = []
    covered: dict[int, int] = {}
    with np.errstate(over="ignore"):
        names, size, lo = mix(ids.astype(np.uint64) + _STEP), 1, 1
        while sizes.max(initial=0) >= max(LEAST_LENGTH, LEAST_EXPONENT * lo):
            k = overlap(lo)
            names, size = _longer(names, size, k), k
            at = np.flatnonzero((left[:len(names)] >= k) & (own_size[:len(names)] >= LEAST_EXPONENT * lo))
            at = at[np.argsort(names[at], kind="stable")]
            lag = np.diff(at)
            seed = np.flatnonzero((names[at[1:]] == names[at[:-1]]) & (lag >= lo) & (lag <= k) & (lag < left[at[:-1]]))
            place, lag = at[seed], lag[seed]
            by = np.lexsort((place, lag))
            place, lag = place[by], lag[by]
            # Seeds that follow each other on a diagonal are one stretch.
            fresh = np.ones(len(place), bool)
            fresh[1:] = (np.diff(lag) != 0) | (np.diff(place) != 1)
            for p, d in zip(place[fresh].tolist(), lag[fresh].tolist(), strict=True):
                if p < covered.get(d, 0):
                    continue
                t = int(text[p])
                start, end = _backward(ids, p, d, int(first[t])), _forward(ids, p, d, int(first[t + 1]) - d)
                covered[d] = end
                if end - start >= overlap(d):
                    found.append((t, start - int(first[t]), end - start + d, d))
            lo = k + 1
    found.sort()
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs: list[list[dict]] = []
        n_words: list[int] = []
        kept: list[bytes | None] = []
        for _, held in blocks(as_bytes(batch.column("text"))):
            split = [t.split() for t in held]  # bytes split at exactly the six ASCII blanks
            sizes = [len(s) for s in split]
            first = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            words = pa.array([w for s in split for w in s], pa.large_binary())
            ids = words.dictionary_encode().indices.to_numpy()
            own: list[list[tuple[int, int, int]]] = [[] for _ in held]
            for t, *run in find_runs(ids, first):
                own[t].append(tuple(run))
            n_words += sizes
            for s, r in zip(split, own, strict=True):
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in r])
                if r:
                    stays = np.ones(len(s) + 1, np.int64)
                    for a, n, q in r:
                        stays[a + q:a + n] = 0
                    s = [w for w, y in zip(s, stays.tolist(), strict=False) if y]
                kept.append(b" ".join(s))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, _RUN_TYPE),
             pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs and collapsed.

    A run is (start, length, period) in words, sorted by start and period: a stretch of consecutive
    words whose words ``period`` apart are identical, with no smaller period, of at least six words
    and four periods, which no neighbouring word extends. ``collapsed`` joins by one space the words
    that no run contains after that run's first period. Null and empty texts have no words, no
    runs and an empty ``collapsed``. Repeated ids and rows without an id are rows like any other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def longest_first(runs: Column) -> Column:
    """The runs by exact length / period, greatest first; of ties the smallest start, then period."""
    def compare(a: Column, b: Column) -> Column:
        more = F.signum((b["length"] * a["period"] - a["length"] * b["period"]).cast("double"))
        return F.when(more != 0, more.cast("int")).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")) \
            .otherwise(F.signum(a["period"] - b["period"]).cast("int"))
    return F.array_sort(runs, compare)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document by the crc32 of its id gets a periodic tail: from a
    word on, as many as one period are repeated to the end. Rows without an id keep their text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, g = F.size("_words").cast("long"), F.floor(F.col("_h") / 10)
    a = g % F.nullif(n, F.lit(0))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    tail = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
        "_words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")
    rows = docs.select("doc_id", "text", h.alias("_h")).withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    return rows.select("doc_id", F.when(n > 0, tail).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Runs of the documents with periodic tails as counts, the run with the most periods, and digests."""
    found = periodic_runs(with_periodic_tails(docs)).withColumn("_first", longest_first(F.col("runs")))
    best = F.get("_first", 0)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("get(_first, 0).length * 1000 div get(_first, 0).period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
