import random
import re

import pytest

from runloom.llm import ngram_join as N

from .conftest import table


def shingles(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def links(texts, percent):
    sets = [shingles(t) for t in texts]
    out = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                out.add((j, i))
    return sets, out


def groups(rows, percent=85):
    """Brute force over all pairs of (doc_id, text) rows; rows of one id are tied."""
    sets, found = links([t for _, t in rows], percent)
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i, j in found:
        top[find(i)] = find(j)
    seen = {}
    for i, (d, t) in enumerate(rows):
        if sets[i] and d is not None:
            top[find(i)] = find(seen.setdefault(d, i))
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            best[find(i)] = min(d, best.get(find(i), d))
    of_doc = {d: best[find(i)] for i, (d, _) in enumerate(rows) if d is not None and sets[i]}
    return sorted(((d, len(sets[i]), of_doc.get(d, d)) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("percent", [85, 60])
def test_groups_against_all_pairs(spark, families, percent):
    assert got(N.jaccard_groups(table(spark, families).repartition(5), percent=percent)) == groups(families, percent)


def test_all_links(spark, families):
    found, members = N.jaccard_links(table(spark, families))
    first = {}
    for d, node in sorted((r["doc_id"], r["node"]) for r in members.collect()):
        first.setdefault(node, d)
    sets, brute = links([t for _, t in families], 85)
    nodes = {min(k for k, s in enumerate(sets) if s == sets[i]) for i in range(len(sets)) if sets[i]}
    want = {(i, j, len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i, j in brute if i in nodes and j in nodes and sets[i] != sets[j]}
    assert {(*sorted((first[r["a"]], first[r["b"]])), r["overlap"], r["size"]) for r in found.collect()} == want and len(want) > 20


def test_rounds_and_blocks(spark, monkeypatch):
    """Many near copies in one list whose stars do not connect them; small blocks and one pair a round."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "SHORT", 4)
    monkeypatch.setattr(N, "BROADCAST_IDS", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(90):
        words = list(base)
        for i in rng.sample(range(120), rng.randint(0, 7)):
            words[i] = f"x{rng.randrange(10**6)}"
        rows.append((k + 50 if k else 500, " ".join(words)))
    rows += [(k, " ".join(base[:40] + [f"y{k}_{i}" for i in range(80)])) for k in range(40)]
    assert got(N.jaccard_groups(table(spark, rows), few=1)) == groups(rows)


def test_threshold_is_exact(spark):
    """Sets of 17 / 20 common shingles link, those of one less don't; sizes of both sides vary."""
    rows, k = [], 0
    for extra in range(0, 8):
        for cut in range(0, 8):
            words = [f"t{extra}_{cut}_{i}" for i in range(40)]
            rows += [(k, " ".join(words[cut:])), (k + 1, " ".join(words + [f"e{k}_{i}" for i in range(extra)]))]
            k += 2
    assert got(N.jaccard_groups(table(spark, rows))) == groups(rows)


def test_hard_and_empty(spark, hard, empty):
    rows = [(r["doc_id"], r["text"]) for r in hard.select("doc_id", "text").collect()]
    assert got(N.jaccard_groups(hard)) == groups(rows)
    assert got(N.jaccard_groups(empty)) == []
    assert got(N.jaccard_groups(table(spark, [(1, None), (2, ""), (3, " "), (None, None)]))) == groups([(1, None), (2, ""), (3, " "), (None, None)])
