import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from runloom.llm import merkle

from .conftest import table


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes, at=None, value=None):
    """Root of a list of digests; with ``at``, also the siblings of that place and the root with ``value`` in it."""
    proof = []
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        if at is not None:
            run, slot = runs[at // 16], at % 16
            proof += run[:slot] + run[slot + 1:]
            value = h("".join([*run[:slot], value, *run[slot + 1:]]))
            at //= 16
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], proof, value if at is not None else None


def brute(rows):
    """Expected result rows of (doc_id, source, lang, n_chars, text) rows, sorted."""
    groups = {}
    for r in rows:
        low = r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        own = leaf(r, r[4])
        groups.setdefault("" if r[1] is None else "=" + r[1], []).append((r[0] is not None, r[0] or 0, own, leaf(r, low) if hit else own, r[0]))
    keys = sorted(groups, key=str.encode)
    for k in keys:
        groups[k].sort(key=lambda x: x[:4])
    tops = [climb([x[2] for x in groups[k]])[0] for k in keys]
    out = []
    for g, k in enumerate(keys):
        leaves = [x[2] for x in groups[k]]
        for i, x in enumerate(groups[k]):
            sub, p1, v1 = climb(leaves, i, x[3])
            root, p2, v2 = climb(tops, g, v1)
            out.append((x[4], x[2], sub, root, h("".join(p1 + p2)), v2, v2 == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_states_are_sha256():
    rng = np.random.default_rng(1)
    kids = rng.integers(0, 2**32, (16, 8, 40), dtype=np.uint32)
    count = rng.integers(1, 17, 40)
    digest, states = merkle.midstates(kids, count)
    for i in range(40):
        parts = [merkle._bytes(kids[j][:, i:i + 1])[0].hex() for j in range(count[i])]
        assert merkle._bytes(digest[:, i:i + 1])[0].hex() == h("".join(parts))
    slot = np.array([rng.integers(0, c) for c in count])
    new = rng.integers(0, 2**32, (8, 40), dtype=np.uint32)
    folded = merkle.resume(states[slot, :, np.arange(40)].T.copy(), slot, new, kids, count)
    for i in range(40):
        parts = [merkle._bytes((new if j == slot[i] else kids[j])[:, i:i + 1])[0].hex() for j in range(count[i])]
        assert merkle._bytes(folded[:, i:i + 1])[0].hex() == h("".join(parts))


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(9000):  # one group of three levels and a part, many small ones, lone ones
        source = rng.choice(["hot"] * 8 + [None, "", "é", "z", f"lone{i}"] if i % 40 else ["hot"])
        rows.append((i * 7 - 300, source, rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", f"Text {i} ÄB", f"text {i}"])))
    rows += rows[:5]
    assert got(merkle.verify_tampered(frame(spark, rows).repartition(5))) == brute(rows)


def test_hard_and_small_tables(spark, hard, empty):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in hard.collect()]
    assert got(merkle.verify_tampered(hard)) == brute(rows)
    assert got(merkle.verify_tampered(empty)) == []
    assert merkle.manifest(empty).root().collect() == []
    one = [(3, None, None, None, "A")]
    assert got(merkle.verify_tampered(frame(spark, one))) == brute(one)
    two = [(3, "a", None, None, "A"), (3, "b", None, None, None)]
    assert got(merkle.verify_tampered(frame(spark, two))) == brute(two)


def test_manifest_table_and_other_changes(spark):
    docs = table(spark, [(i, f"text {i}") for i in range(300)])
    built = merkle.manifest(docs, columns=["text"], changed=F.when(F.col("doc_id") == 17, F.unhex(F.lit("ab" * 32))))
    nodes = built.nodes().collect()
    assert sorted((r["tree"], r["level"], r["pos"]) for r in nodes) == (
        [("group", 1, i) for i in range(19)] + [("group", 2, 0), ("group", 2, 1), ("group", 3, 0)])
    assert all(len(r["states"]) == len(r["children"]) for r in nodes)
    leaves = [h(f"{len(f'text {i}')}:text {i}") for i in range(300)]
    root = climb(leaves)[0]
    assert built.root().first()[0] == root
    bad = {r["doc_id"]: r for r in built.fold().collect() if not r["verified"]}
    assert list(bad) == [17] and bad[17]["folded_root"] == climb(leaves, 17, "ab" * 32)[2]
