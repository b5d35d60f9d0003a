"""Byte-level BPE with numpy: batched merge rounds over the words of many texts.

Texts are cut into words as the tokenizer's own pattern does. Words not seen before in the task are
encoded together: their symbols lie in one flat array, each round looks every adjacent pair up by
binary search in the sorted pair keys, takes the lowest rank per word, and merges all places of
that pair. Words that have no pair left drop out, so rounds shrink quickly.

Memory per task is bounded by ``KNOWN_WORDS`` remembered words and by one batch of texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KNOWN_WORDS = 400_000
SPECIAL = "<|endoftext|>"
#: Fixed value: the split pattern of the vocabulary, in the form that holds for the plain characters below.
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")
#: Characters on which Python's classes and the Unicode properties of the pattern agree.
NOT_PLAIN = re.compile("[^\t\n\r -~¡-©«-±´¶-¸»¿-ſ‐-‧€]")


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Splitter:
    """Words of a text, with special tokens as items of their own."""

    def __init__(self) -> None:
        from tokenizers import pre_tokenizers
        self.exact = pre_tokenizers.ByteLevel(add_prefix_space=False)

    def words(self, text: str) -> list[str]:
        if SPECIAL in text:
            out: list[str] = []
            for i, part in enumerate(text.split(SPECIAL)):
                if i:
                    out.append(SPECIAL)
                out.extend(self.words(part))
            return out
        if NOT_PLAIN.search(text) is None:
            return PLAIN_PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.exact.pre_tokenize_str(text)]


class Merges:
    """The vocabulary as arrays: byte symbols, sorted pair keys with rank and result, token bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_characters()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        tokens.update({i: t.encode() for t, i in self.special.items()})
        size = max(tokens) + 1
        listed = [tokens.get(i, b"") for i in range(size)]
        self.length = np.array([len(t) for t in listed], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.bytes = np.frombuffer(b"".join(listed), np.uint8)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every word, by merge rounds over all of them at once."""
        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), size)
        done_symbol, done_word = [], []
        none = len(self.keys)
        while len(symbol):
            pair = symbol[:-1] << 17 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            rank = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(word)))
            low = np.repeat(best, counts)
            over = low == none
            done_symbol.append(symbol[over])
            done_word.append(word[over])
            take = (rank == low) & ~over
            places = np.flatnonzero(take)
            if len(places):
                # In a run of overlapping places every second one merges, from the left.
                starts = np.diff(places, prepend=-2) != 1
                run = np.arange(len(places)) - np.maximum.accumulate(np.where(starts, np.arange(len(places)), 0))
                places = places[run % 2 == 0]
                symbol[places] = self.result[at[places]]
                stay = ~over
                stay[places + 1] = False
                symbol, word = symbol[stay], word[stay]
            else:
                break
        symbol, word = np.concatenate(done_symbol or [symbol]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return np.split(symbol[order], np.cumsum(np.bincount(word, minlength=len(raw)))[:-1]) if raw else []

    def decode(self, ids: np.ndarray) -> str:
        size = self.length[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(ids) else 0
        at = np.repeat(self.offset[ids] - (end - size), size) + np.arange(total)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


class Encoder:
    """Texts to ids with a bounded memory of words; each word is kept as its ids in decimal."""

    def __init__(self, path: str, known_words: int = KNOWN_WORDS) -> None:
        self.merges, self.splitter, self.limit = Merges(path), Splitter(), known_words
        self.known: dict[str, str] = {}

    def texts(self, texts: list[str]) -> list[str]:
        """Decimal ids, joined by commas, of every text."""
        cut = [self.splitter.words(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        new = list({w for words in cut for w in words}.difference(self.known))
        plain = [w for w in new if w not in self.merges.special]
        for w, ids in zip(plain, self.merges.encode(plain), strict=True):
            self.known[w] = ",".join(map(str, ids.tolist()))
        self.known.update((w, str(self.merges.special[w])) for w in new if w in self.merges.special)
        look = self.known.__getitem__
        return [",".join(map(look, words)) for words in cut]


def parsed(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int64, sep=",") if ids else np.empty(0, np.int64)


def runs(texts: list[str | None], limit: int = 1 << 21) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters; null is empty."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for held in runs(batch.column(1).to_pylist()):
                for ids in encoder.texts(held):
                    decoded = encoder.merges.decode(parsed(ids))
                    n.append(ids.count(",") + 1 if ids else 0)
                    of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                    of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                                              pa.array(of_text, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            at = 0
            for held in runs(batch.column(1).to_pylist()):
                lists = [parsed(ids).astype(np.int32) for ids in encoder.texts(held)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), values], ["doc_id", "ids"])
                at += len(held)
    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(path)
        for batch in batches:
            out = [merges.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])
    return run


def _columns(df: DataFrame, id_col: str, value: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(value).alias("value"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) per row; null and empty texts give an empty array."""
    return _columns(docs, id_col, text_col).mapInArrow(_ids(path or vocabulary_path()), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text per row; null or empty ids give an empty text."""
    return _columns(ids, id_col, ids_col).mapInArrow(_texts(path or vocabulary_path()), "doc_id long, text string")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row; the decoded text comes from the ids.

    Null text counts as empty; ids may be null or repeated; other columns are ignored.
    """
    return _columns(docs, id_col, text_col).mapInArrow(
        _digests(path or vocabulary_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
