"""Secret scan: fixed patterns, plus long tokens that pass a battery of randomness tests.

Every token of ``LEAST`` or more characters of common encodings is a candidate. Its alphabet is the
smallest that holds all of its characters. Three tests ask whether it could be random over that
alphabet: chi-squared over groups of symbols, runs above and below the middle, and correlation of
neighbours; Fisher's method combines them. Random strings have uniform p-values, words crowd near
zero. Per length class, the histogram of p-values over the whole corpus then gives the number of
random strings and, for each cut-off, the share of false discoveries above it; the lowest cut-off
with a share under ``FALSE_SHARE`` decides. Only these counts reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.plans.store import written

LEAST = 20
FALSE_SHARE = 0.1
BINS = 100
LENGTHS = (20, 24, 32, 48, 64, 128)
#: The patterns of the base scan, and what must be near for the first one to match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from small to large.
ALPHABETS = [_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
             _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER, _DIGITS + _LOWER + _UPPER + "+/", _DIGITS + _LOWER + _UPPER + "-_",
             _DIGITS + _LOWER + _UPPER + "+/-_"]
#: The letters that prose uses most, in either case; they form a group of their own.
FREQUENT = set("etaoinshrETAOINSHR")


def _group(c: str) -> int:
    return (0 if c in _DIGITS else 1 if c in _LOWER else 2 if c in _UPPER else 3) * 2 + (c in FREQUENT)


class Alphabet:
    def __init__(self, symbols: str) -> None:
        self.symbols, self.size = set(symbols), len(symbols)
        self.index = np.full(128, -1)
        self.index[[ord(c) for c in symbols]] = np.arange(self.size)
        # Groups by kind of character; a group that holds all of the alphabet is cut in four.
        groups = [_group(c) for c in symbols]
        if len(set(groups)) == 1 or self.size == 10:
            groups = [i * 4 // self.size for i in range(self.size)]
        names = sorted(set(groups))
        self.group = np.array([names.index(g) for g in groups])
        self.share = np.bincount(self.group) / self.size


_ALPHABETS = [Alphabet(a) for a in ALPHABETS]


def chi_tail(x: float, freedom: int) -> float:
    """Upper tail of chi-squared, by Wilson and Hilferty's normal form."""
    if x <= 0:
        return 1.0
    h = 2 / (9 * freedom)
    return 0.5 * math.erfc(((x / freedom) ** (1 / 3) - (1 - h)) / math.sqrt(2 * h))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str) -> float:
    """Combined p-value of the token being random over its smallest alphabet."""
    body = token.rstrip("=")
    chars = set(body)
    a = next(a for a in _ALPHABETS if chars <= a.symbols)
    v = a.index[np.frombuffer(body.encode(), np.uint8)]
    n = len(v)
    seen = np.bincount(a.group[v], minlength=len(a.share))
    p = [chi_tail(float((((seen - n * a.share) ** 2) / (n * a.share)).sum()), len(a.share) - 1)]
    high = v * 2 >= a.size
    n1 = int(high.sum())
    n0 = n - n1
    if n0 and n1:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n0 * n1 / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p.append(two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    d = v - v.mean()
    power = float((d * d).sum())
    p.append(two_sided(float((d[1:] * d[:-1]).sum()) / power * math.sqrt(n)) if power else 2.0 ** (1 - n))
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    return math.exp(-half) * (1 + half + half * half / 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    token = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("bin", pa.int32()), ("own", pa.bool_())]))
    for batch in batches:
        base, extra, shas = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = base_spans(text)
            tokens = []
            for m in CANDIDATE.finditer(text):
                size = len(m[0].rstrip("="))
                cls = max(i for i, least in enumerate(LENGTHS) if size >= least)
                at = min(int(randomness(m[0]) * BINS), BINS - 1)
                own = all(e <= m.start() or s >= m.end() for s, _, e in spans)
                tokens.append({"start": m.start(), "end": m.end(), "length": cls, "bin": at, "own": own})
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            extra.append(tokens)
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(extra, token), pa.array(shas, pa.string())],
                                         ["doc_id", "base", "tokens", "base_sha256"])


def cut_offs(counts: list[tuple[int, int, int]], false_share: float = FALSE_SHARE) -> dict[int, int]:
    """Per length class the lowest bin from which on few discoveries are false."""
    out = {}
    for cls in {c for c, _, _ in counts}:
        h = np.zeros(BINS)
        for c, b, n in counts:
            if c == cls:
                h[b] += n
        above = np.cumsum(h[::-1])[::-1]
        random = above[BINS // 2] * 2  # words do not reach the upper half
        for b in range(BINS):
            if above[b] and 1 - random * (1 - b / BINS) / above[b] <= false_share:
                out[cls] = b
                break
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and kind. A random token that
    touches a base span is not repeated. Null text is empty; ids may be null or repeated; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(rows.mapInArrow(_scan, (
        "doc_id long, base array<struct<start:int,kind:int,end:int>>, "
        "tokens array<struct<start:int,end:int,length:int,bin:int,own:boolean>>, base_sha256 string")), "spans")
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.length", "t.bin").count()
    limits = cut_offs([(r["length"], r["bin"], r["count"]) for r in counts.collect()], false_share)  # lengths x bins rows at most

    def random_one(t):
        ok = F.lit(False)
        for cls, least in limits.items():
            ok = ok | ((t["length"] == cls) & (t["bin"] >= least))
        return t["own"] & ok

    random = F.transform(F.filter("tokens", random_one), lambda t: F.struct(
        t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform(F.array_sort(F.concat("base", random)), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
                        F.size(random).cast("long").alias("n_random"), "base_sha256", spans.alias("spans"))
