"""Token ids as binary files: a context-mixing range coder over independent blocks.

**Files.** Parquet rows, one per segment of whole documents, in ascending document order over
(shard, seq). A segment holds doc ids, token counts, and its ids in blocks of ``BLOCK`` tokens; a
block has its coded payload and the CRC-32 of its ids, and starts from a reset model, so any block
can be decoded alone. Parquet is only the container, so files lie on any store Spark can reach.

**Model.** Order 2 (the two ids before) and order 1 (the id before) each predict one id. Whether the
better prediction is right is coded with a mixture of three adaptive probabilities: by the
confidence of order 2, by that of order 1, and overall. Their weights move towards whichever
foresaw the outcome. A miss is coded by order 0: adaptive counts of 64 classes of ids (the first 16
ids, then four classes per doubling; ids are roughly in order of frequency), then the place inside
the class. All arithmetic is on integers, so every machine decodes alike.

**Speed.** Blocks are lanes of numpy arrays: one step codes one token of every block. The model of a
lane is kept to a few kilobytes, so that all lanes stay in the processor's caches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.llm.bpe import Splitter, runs, vocabulary_path
from runloom.plans.store import shared_path

BLOCK = 2048
LANES = 2048
END = 0
#: Added to a class's count per use; 64 + 2048 * 24 stays under 2^16, so counts never need halving.
STEP = 24
CLASSES = 64
SLOTS = 512
#: The coder emits digits of 16 bits and keeps a range of at most 48.
_LOW, _FULL = np.uint64((1 << 32) - 1), np.uint64((1 << 48) - 1)


def class_of(ids: np.ndarray) -> np.ndarray:
    """0 to 15 for these ids, then four classes per doubling up to 2^16."""
    top = np.log2(np.maximum(ids, 1) + 0.5).astype(np.int64)
    return np.where(ids < 16, ids, 16 + (top - 4) * 4 + ((ids >> np.maximum(top - 2, 0)) & 3))


_CLASS = class_of(np.arange(1 << 16)).astype(np.int64)
_FIRST = np.searchsorted(_CLASS, np.arange(CLASSES)).astype(np.int64)
_SIZE = np.diff(np.append(_FIRST, 1 << 16)).astype(np.uint64)


class Coder:
    """Range coder of many lanes. Carries are added to digits already written and resolved at the end."""

    def __init__(self, lanes: int, steps: int = 0, payload: list[bytes] | None = None) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _FULL)
        self.row = np.arange(lanes)
        if payload is None:
            self.out = np.zeros((lanes, steps), np.int32)
            self.used = np.zeros(lanes, np.int64)
        else:
            width = max(len(p) for p in payload) // 2 + 8
            data = np.zeros((lanes, width), ">u2")
            for i, p in enumerate(payload):
                data[i, :len(p) // 2] = np.frombuffer(p, ">u2")
            self.out = data.astype(np.uint16)
            self.used = np.full(lanes, 3)
            first = self.out[:, :3].astype(np.uint64)
            self.low = first[:, 0] << np.uint64(32) | first[:, 1] << np.uint64(16) | first[:, 2]

    def encode(self, start: np.ndarray, size: np.ndarray, total: np.uint64, on: np.ndarray | None) -> None:
        """One symbol in every lane, or where ``on`` is true."""
        part = self.range // total
        low, width = part * start, part * size
        if on is not None:
            low, width = np.where(on, low, np.uint64(0)), np.where(on, width, self.range)
        self.low += low
        self.range = width
        self._carry(np.flatnonzero(self.low > _FULL))
        self._shift(np.flatnonzero(width <= _LOW))

    def encode_some(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        part = self.range[lanes] // total
        low, width = self.low[lanes] + part * start, part * size
        self.low[lanes], self.range[lanes] = low, width
        self._carry(lanes[low > _FULL])
        self._shift(lanes[width <= _LOW])

    def _carry(self, lanes: np.ndarray) -> None:
        if len(lanes):
            self.out[lanes, self.used[lanes] - 1] += 1
            self.low[lanes] &= _FULL

    def _shift(self, lanes: np.ndarray) -> None:
        if len(lanes):
            at, used = self.low[lanes], self.used[lanes]
            self.out[lanes, used] = at >> np.uint64(32)
            self.used[lanes] = used + 1
            self.low[lanes] = (at & _LOW) << np.uint64(16)
            self.range[lanes] <<= np.uint64(16)

    def decode(self, part: np.ndarray, start: np.ndarray, size: np.ndarray, on: np.ndarray | None) -> None:
        low, width = part * start, part * size
        if on is not None:
            low, width = np.where(on, low, np.uint64(0)), np.where(on, width, self.range)
        self.low -= low
        self.range = width
        self._fill(np.flatnonzero(width <= _LOW))

    def decode_some(self, lanes: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        width = part * size
        self.low[lanes] -= part * start
        self.range[lanes] = width
        self._fill(lanes[width <= _LOW])

    def _fill(self, lanes: np.ndarray) -> None:
        if len(lanes):
            used = self.used[lanes]
            self.low[lanes] = self.low[lanes] << np.uint64(16) | self.out[lanes, np.minimum(used, self.out.shape[1] - 1)]
            self.range[lanes] <<= np.uint64(16)
            self.used[lanes] = used + 1

    def finish(self) -> list[bytes]:
        for shift in (32, 16, 0):
            self.out[self.row, self.used] = (self.low >> np.uint64(shift)) & np.uint64(0xFFFF)
            self.used += 1
        carry = np.zeros(len(self.row), np.int64)
        for k in range(int(self.used.max()) - 1, -1, -1):
            value = self.out[:, k].astype(np.int64) + carry
            carry = value >> 16
            self.out[:, k] = value & 0xFFFF
        return [self.out[i, :n].astype(">u2").tobytes() for i, n in enumerate(self.used.tolist())]


class Model:
    """The adaptive state of every lane; encoder and decoder take the same steps."""

    def __init__(self, lanes: int) -> None:
        self.row = np.arange(lanes)
        self.one = np.zeros(lanes, np.int64)
        self.two = np.zeros(lanes, np.int64)
        # Per context slot: predicted id times four plus its confidence 0..3, for order 1 and order 2.
        self.guess = [np.zeros(lanes * SLOTS, np.int32) for _ in range(2)]
        self.base = self.row * SLOTS
        # Probabilities (of 4096) that the prediction is right: by both confidences, and overall.
        self.chance = [np.full(lanes * 4, 2048, np.int32) for _ in range(2)]
        self.overall = np.full(lanes, 2048, np.int32)
        self.row4 = self.row * 4
        self.weight = [np.full(lanes, 256, np.int32) for _ in range(3)]
        # Counts of classes as running sums: a class's share is two neighbours.
        self.sums = np.tile(np.arange(CLASSES + 1, dtype=np.uint16), (lanes, 1))

    def predict(self) -> np.ndarray:
        """Sets the prediction; returns the probability (of 4096) that it is right."""
        hashed = self.one * 40503
        self.slots = (self.base + (hashed >> 4) % SLOTS, self.base + ((hashed + self.two * 30011) >> 4) % SLOTS)
        self.held = (self.guess[0][self.slots[0]], self.guess[1][self.slots[1]])
        by_one, by_two = self.held
        sure_two = by_two & 3
        self.pick = np.where(sure_two > 0, by_two, by_one) >> 2
        self.at = (self.row4 + sure_two, self.row4 + (by_one & 3))
        self.p = (self.chance[0][self.at[0]], self.chance[1][self.at[1]], self.overall)
        w, p = self.weight, self.p
        mixed = (w[0] * p[0] + w[1] * p[1] + w[2] * p[2]) // (w[0] + w[1] + w[2])
        return np.minimum(np.maximum(mixed, 16), 4080).astype(np.uint64)

    def learn(self, hit: np.ndarray, ids: np.ndarray) -> None:
        aim = np.where(hit, np.int32(4095), np.int32(0))
        for k in range(3):
            gap = aim - self.p[k]
            new = self.p[k] + (gap >> 4)
            if k < 2:
                self.chance[k][self.at[k]] = new
            else:
                self.overall = new
            # What each part gave to the outcome, as a share of 256, draws its weight.
            self.weight[k] += (271 - (np.abs(gap) >> 4) - self.weight[k]) >> 4
        fresh = (ids * 4 + 1).astype(np.int32)
        for k in range(2):
            old = self.held[k]
            sure = old & 3
            same = (old ^ fresh) < 4
            same &= sure > 0
            # Right: one surer. Wrong: one less sure, and replaced once no confidence is left.
            self.guess[k][self.slots[k]] = np.where(same, old + (sure < 3), np.where(sure > 1, old - 1, fresh))
        self.two, self.one = self.one, ids


#: What a class's use adds to the running sums.
_ADDED = ((np.arange(CLASSES + 1)[None, :] > np.arange(CLASSES)[:, None]) * STEP).astype(np.uint16)
_ONES = np.ones(CLASSES + 1, np.float32)
_U = np.uint64


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded payload of every block of ids below 2^16."""
    # Longer blocks first: lanes that have ended form a tail, which is cut off.
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    size = np.array([len(blocks[i]) for i in order], np.int64)
    ids = np.zeros((int(size[0]) if len(order) else 0, len(order)), np.int64)
    for lane, i in enumerate(order):
        ids[:size[lane], lane] = blocks[i]
    coder, model = Coder(len(order), 3 * len(ids) + 8), Model(len(order))
    total = _U(4096)
    for t in range(len(ids)):
        live, now = size > t, ids[t]
        right = model.predict()
        hit = model.pick == now
        coder.encode(np.where(hit, _U(0), right), np.where(hit, right, total - right), total,
                     None if live[-1] else live)
        miss = np.flatnonzero(~hit & live)
        coded = now[miss]
        cls = _CLASS[coded]
        start, end = model.sums[miss, cls].astype(np.uint64), model.sums[miss, cls + 1].astype(np.uint64)
        coder.encode_some(miss, start, end - start, model.sums[miss, CLASSES].astype(np.uint64))
        model.sums[miss] += _ADDED[cls]
        coder.encode_some(miss, (coded - _FIRST[cls]).astype(np.uint64), _U(1), _SIZE[cls])
        model.learn(hit, now)
    out: list[bytes] = [b""] * len(order)
    for i, payload in zip(order, coder.finish() if len(order) else [], strict=True):
        out[i] = payload
    return out


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Ids of every block."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    size = np.array([sizes[i] for i in order], np.int64)
    ids = np.zeros((int(size[0]) if len(order) else 0, len(order)), np.int64)
    if not len(ids):
        return [np.empty(0, np.int64) for _ in order]
    coder, model = Coder(len(order), payload=[payloads[i] for i in order]), Model(len(order))
    total = _U(4096)
    for t in range(len(ids)):
        live = size > t
        right = model.predict()
        part = coder.range // total
        hit = coder.low // part < right
        coder.decode(part, np.where(hit, _U(0), right), np.where(hit, right, total - right), None if live[-1] else live)
        miss = np.flatnonzero(~hit & live)
        row = model.sums[miss]
        part = coder.range[miss] // row[:, CLASSES]
        goal = (coder.low[miss] // part).astype(np.uint16)
        # The running sums at most the goal, less the leading zero, are the class.
        cls = ((row <= goal[:, None]).astype(np.float32) @ _ONES).astype(np.int64) - 1
        start, end = model.sums[miss, cls].astype(np.uint64), model.sums[miss, cls + 1].astype(np.uint64)
        coder.decode_some(miss, part, start, end - start)
        row += _ADDED[cls]
        model.sums[miss] = row
        part = coder.range[miss] // _SIZE[cls]
        place = coder.low[miss] // part
        coder.decode_some(miss, part, place, _U(1))
        now = np.where(live, model.pick, 0).astype(np.int64)
        now[miss] = _FIRST[cls] + place.astype(np.int64)
        ids[t] = now
        # Lanes that have ended run on with ids of 0, as they do in the encoder.
        if not live[-1]:
            hit = np.where(live, hit, model.pick == 0)
        model.learn(hit, now)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(order)
    for lane, i in enumerate(order):
        out[i] = ids[:size[lane], lane].copy()
    return out


class LibraryEncoder:
    """The tokenizers library, asked once per distinct word of a task; it splits texts at the same
    places, so the ids are those of the whole text. A bounded number of words is remembered."""

    def __init__(self, path: str, known_words: int = 400_000) -> None:
        from tokenizers import Tokenizer
        self.library, self.splitter, self.limit = Tokenizer.from_file(path), Splitter(), known_words
        self.library.no_padding()
        self.library.no_truncation()
        self.known: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.ids = np.empty(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.splitter.words(t) for t in texts]
        if len(self.known) > self.limit:
            self.clear()
        new = list({w for words in cut for w in words}.difference(self.known))
        base = len(self.start) - 1
        self.known.update((w, base + i) for i, w in enumerate(new))
        ids, sizes = [self.ids], []
        for i in range(0, len(new), 2000):  # one call for many words: each keeps its own ids
            part = new[i:i + 2000]
            found = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        self.ids = np.concatenate(ids)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate([np.empty(0, np.int64), *sizes]))])
        look, out = self.known.__getitem__, []
        for words in cut:
            w = np.fromiter(map(look, words), np.int64, len(words))
            size = self.start[w + 1] - self.start[w]
            end = np.cumsum(size)
            total = int(end[-1]) if len(w) else 0
            out.append(self.ids[np.repeat(self.start[w] - (end - size), size) + np.arange(total)])
        return out


_FILE = ("shard int, seq int, doc_ids array<long>, lengths array<long>, n_tokens long, sizes array<int>, "
         "checks array<long>, payloads array<binary>")


def _segments(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq = LibraryEncoder(path), TaskContext.get().partitionId(), 0
        names, docs, size = [], [], 0

        def segment() -> pa.RecordBatch:
            lengths = [len(d) for d in docs]
            ids = np.concatenate(docs)
            blocks = [ids[i:i + BLOCK] for i in range(0, len(ids), BLOCK)]
            payloads = [p for i in range(0, len(blocks), LANES) for p in encode_blocks(blocks[i:i + LANES])]
            checks = [zlib.crc32(b.astype("<u4").tobytes()) for b in blocks]
            row = [shard, seq, names, lengths, len(ids), [len(b) for b in blocks], checks, payloads]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()),
                     pa.list_(pa.int64()), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                                              ["shard", "seq", "doc_ids", "lengths", "n_tokens", "sizes", "checks", "payloads"])

        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for held in runs(batch.column(1).to_pylist()):
                for tokens in encoder.texts(held):
                    names.append(ids[at])
                    docs.append(np.append(tokens, np.int32(END)))
                    size += len(tokens) + 1
                    at += 1
                    if size >= BLOCK * LANES:
                        yield segment()
                        names, docs, size, seq = [], [], 0, seq + 1
        if docs:
            yield segment()
    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append id 0, and write segments in ascending document order.

    Null text counts as empty (its only token is the end). Rows without an id come first; rows that
    repeat an id lie next to each other, ordered by text. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(_segments(path or vocabulary_path()), _FILE).write.parquet(folder)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = []
            for i in range(0, len(row["sizes"]), LANES):
                found = decode_blocks(row["payloads"][i:i + LANES], row["sizes"][i:i + LANES])
                for block, check in zip(found, row["checks"][i:i + LANES], strict=True):
                    if zlib.crc32(block.astype("<u4").tobytes()) != check:
                        raise ValueError(f"checksum of a block in segment {row['shard']}/{row['seq']}")
                parts.extend(found)
            yield row, np.concatenate(parts)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, ids in _decoded(batches):
        ends = np.cumsum(row["lengths"])
        for i in range(0, len(ends), 512):
            part = range(i, min(i + 512, len(ends)))
            lists = [ids[ends[k] - row["lengths"][k]:ends[k]].astype(np.int32) for k in part]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(part), pa.int32()), pa.array([row["seq"]] * len(part), pa.int32()),
                 pa.array(part, pa.int32()), pa.array([row["doc_ids"][k] for k in part], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))],
                ["shard", "seq", "place", "doc_id", "ids"])


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, ids in _decoded(batches):
        ends = np.cumsum(row["lengths"]).tolist()
        starts = [0, *ends[:-1]]
        n = len(ends)
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()),
             pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()),
             pa.array(crc, pa.int64())],
            ["shard", "seq", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id and ids (with the end id) per document, with its place (shard, seq, place)."""
    return files.mapInArrow(_documents, "shard int, seq int, place int, doc_id long, ids array<int>")


def segment_starts(files: DataFrame) -> DataFrame:
    """Number of ids before each segment: sums inside shards, then over the shards' totals."""
    sizes = files.select("shard", "seq", "n_tokens")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.select("shard", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("local"))
    return local.join(shards, "shard").select("shard", "seq", (F.col("base") + F.col("local")).alias("first"))


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the decoded files."""
    rows = files.mapInArrow(_checks, "shard int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(segment_starts(files), ["shard", "seq"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files into the shared folder and report what they hold. An empty table gives no rows."""
    folder = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path)
    return token_digests(docs.sparkSession.read.schema(_FILE).parquet(folder))


