import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from runloom.llm import periodic_runs as P

from .conftest import table


def brute(words):
    """All runs by trying every period on every diagonal; a stretch counts for its smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
                if not any(all(words[x] == words[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                    best[i, j - i + q, q] = q
            i = j + 1
    return sorted(k for k in best if len(k) == 3)


def collapse(words, runs):
    gone = {x for a, n, q in runs for x in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def samples():
    rng = random.Random(5)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, list("ab") * 3, list("ab") * 4, list("abc") * 4, list("abc") * 4 + ["a", "b"]]
    for size in (2, 3, 5):  # many overlapping short periods
        out += [[rng.choice("abcde"[:size]) for _ in range(rng.randint(20, 160))] for _ in range(60)]
    for q in (1, 2, 3, 4, 5, 6, 7, 18, 19, 20, 57, 58, 90):  # every class, its ends, and exact least lengths
        for more in (-1, 0, 1, q):
            unit = [f"u{rng.randrange(3 * q)}" for _ in range(q)]
            body = (unit * (6 + more // q))[:max(6, 4 * q) + more]
            out.append(["x", "y"] + body + ["z"] + body[:q])
    for _ in range(40):  # runs whose period holds runs, next to each other
        inner = [rng.choice("abcd") for _ in range(rng.randint(1, 4))] * rng.randint(2, 6)
        out.append((inner + [rng.choice("wxyz") for _ in range(rng.randint(0, 3))]) * rng.randint(3, 7) + inner)
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 200:
        fib = fib[1], fib[1] + fib[0]
    return out + [fib[1], [str(bin(i).count("1") % 2) for i in range(256)]]


def test_find_runs_against_brute_force():
    texts = samples()
    names = {w: i for i, w in enumerate({w for t in texts for w in t})}
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    ids = np.array([names[w] for t in texts for w in t], np.int32)
    got = [[] for _ in texts]
    for t, *run in P.find_runs(ids, first):
        got[t].append(tuple(run))
    for t, runs in zip(texts, got, strict=True):
        assert runs == brute(t), t


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    words = [w.decode() for w in words]
    runs = brute(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, runs).encode()).hexdigest())


def test_query_on_texts(spark):
    rng = random.Random(8)
    texts = [rng.choice([" ", "\n", "\t\x0b", "  \x0c"]).join(t) for t in samples() if len(t) < 200]
    rows = list(enumerate(texts, 1000)) + [(i, None if i % 3 else "") for i in range(60)] + [(None, "a a a a a a b"), (None, None), (1000, texts[3])]
    got = sorted((tuple(r) for r in P.run_digests(table(spark, rows).repartition(3)).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    assert any(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in got)


def test_hard_tables(spark, hard, empty):
    rows = {(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect() if len(r["text"] or "") < 1000}
    got = {tuple(r) for r in P.run_digests(hard).collect()}
    assert {expected(*r) for r in rows} <= got
    assert P.run_digests(empty).collect() == []


@pytest.mark.parametrize("q", [1, 700, 30_000])
def test_long_text(q):
    ids = np.arange(400_000) % 150_000
    ids[100_000:300_000] = 10**6 + np.arange(200_000) % q
    assert (0, 100_000, 200_000, q) in P.find_runs(ids, np.array([0, len(ids)]))
