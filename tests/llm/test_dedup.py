"""Exact, line and near duplicates and decontamination against brute force, SQL and edge cases."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from runloom.llm import decontaminate, exact_dedup, line_dedup, near_dedup
from runloom.llm.components import components
from runloom.llm.queries import QUERIES

from .conftest import HARD, table


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", ["op3_line_dedup", "op7_exact_dedup"])
def test_native_queries_equal_sql(spark, sf, name):
    fn, sql = QUERIES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = fn(spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == sorted(
        repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["op3_line_dedup", "op7_exact_dedup"])
def test_native_queries_run_no_python(spark, sf, name):
    plan = QUERIES[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_exact_edges(hard, empty):
    rows = exact_dedup.exact_groups(hard).collect()
    assert len(rows) == len(HARD)
    sizes = Counter((t or "") for _, t in HARD)
    best = {}
    for i, t in HARD:
        if i is not None:
            best[t or ""] = max(best.get(t or "", -1), i)
    want = Counter((i, best.get(t or ""), sizes[t or ""], i == best.get(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in HARD)
    assert Counter(tuple(r) for r in rows) == want
    assert exact_dedup.exact_groups(empty).collect() == []
    kept = exact_dedup.dedup(hard)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 5, 6, 7, 8, 9, 10]


def test_exact_hot_group_is_resolved_at_the_scan(spark):
    docs = table(spark, [(i, "hot" if i % 2 else f"text {i}") for i in range(6000)])
    heavy = exact_dedup.heavy_values(docs.selectExpr("xxhash64(text) AS x"), "x").orderBy("about", ascending=False).first()
    assert heavy.about > 2900
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert rows[1].group_size == 3000 and rows[1].keep_id == 5999 and rows[5999].kept and rows[2].kept


def test_line_edges(spark, hard, empty):
    out = line_dedup.line_dedup(hard)
    assert out.columns == [*hard.columns, "_line_dedup"]
    rows = out.collect()
    assert len(rows) == len(HARD)
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r.text)
    assert texts[2] == [None] and texts[3] == [""] and texts[5] == ["one two"] * 2
    assert texts[7] and len(texts[7][0]) > 100_000
    assert line_dedup.line_dedup(empty).collect() == []


def test_long_passages_stay_in_one_document(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    block = "\n".join(" ".join(f"b{j}word{i}" for i in range(12)) for j in range(20))
    docs = [(i, f"own line {i} here\n{passage}\nanother own line {i}\n{block}\nend {i}") for i in range(40)] + [(99, "short line\nshort line")]
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(table(spark, docs)).collect()}
    assert [i for i, t in out.items() if passage in t] == [0]
    assert sum("b10word3" in t for t in out.values()) == 1
    assert out[99] == "short line\nshort line" and "own line 7 here" in out[7]


def brute_lines(docs, words=50):
    """The texts left: chunks as the SQL cuts them, and every run of lines that stands at an earlier place."""
    first, texts, gone = {}, {i: t.split("\n") for i, t in docs}, defaultdict(set)
    for i in sorted(texts):
        lines, n = texts[i], [x.count(" ") + 1 for x in texts[i]]
        ends = [k for k, x in enumerate(lines) if k + 1 == len(lines) or n[k] >= 50 or n[k + 1] >= 50 or (
            (int(hashlib.md5(lines[k - 1].encode()).hexdigest()[:8], 16) if k else 0) * 31
            + int(hashlib.md5(x.encode()).hexdigest()[:8], 16)) % 2147483647 % 3 == 0]
        for a, b in zip([0, *[e + 1 for e in ends[:-1]]], ends, strict=True):
            if n[b] >= 50 or b > a and sum(n[a:b + 1]) >= 20:
                if first.setdefault(("chunk", *lines[a:b + 1]), (i, a)) != (i, a):
                    gone[i] |= set(range(a, b + 1))
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(n[a:b + 1]) >= words:
                    j, c = first.setdefault(("run", *lines[a:b + 1]), (i, a))
                    if (j, c) != (i, a):
                        gone[i] |= set(range(max(a, c + b - a + 1) if i == j else a, b + 1))
    return {i: "\n".join(x for k, x in enumerate(texts[i]) if k not in gone[i]) for i in texts}


def test_passages_inside_differing_neighbours(spark):
    """Passages of 2 to 10 lines and 50 words or more between own lines: of two documents only the first keeps any line."""
    rng = random.Random(11)
    say = lambda tag, n: " ".join(f"{tag}w{rng.randrange(10 ** 6)}" for _ in range(n))
    docs, shared = [], {}
    for t in range(120):
        n = 2 + t % 9
        size = rng.randint(-(-50 // n), 45)
        shared[t] = [say(f"s{t}x{k}", size) for k in range(n)]
        for side in (0, 1):
            own = [say(f"o{t}", rng.randint(3, 12)) for _ in range(8)]
            docs.append((2 * t + side, "\n".join([*own[:4], *shared[t], *own[4:]])))
    texts = dict(docs)
    out = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, docs), passage_words=50).collect()}
    for t, lines in shared.items():
        assert out[2 * t].text == texts[2 * t]
        want = [x for x in texts[2 * t + 1].split("\n") if x not in lines]
        assert out[2 * t + 1].text.split("\n") == want and len(want) == 8
        assert out[2 * t + 1]._line_dedup.n_removed_lines == len(lines)


def test_passages_equal_brute_force(spark):
    """Few distinct lines of 1 to 60 words, so that runs overlap, repeat themselves and begin anywhere."""
    rng = random.Random(5)
    pool = [" ".join(f"l{k}w{i}" for i in range(rng.choice([1, 3, 9, 20, 30, 49, 60]))) for k in range(12)] + [""]
    docs = [(i, "\n".join(rng.choice(pool[:rng.randint(1, 13)]) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    docs += [(100, "\n".join(["ten words in a line that comes again and again"] * 30)), (101, "\n" * 120)]
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(table(spark, docs), passage_words=50).collect()}
    assert out == brute_lines(docs)


def test_passage_edges(spark, hard, empty):
    rows = line_dedup.line_dedup(hard, passage_words=50).collect()
    assert len(rows) == len(HARD) and line_dedup.line_dedup(empty, passage_words=50).collect() == []
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in HARD)
    assert {r.text for r in rows if r.doc_id == 2} == {None} and [r.text for r in rows if r.doc_id == 5] == ["one two"] * 2
    # Rows that share an id: equal texts are one place, of differing ones each loses its own lines.
    p = "\n".join(" ".join(f"p{k}w{i}" for i in range(30)) for k in range(3))
    docs = table(spark, [(1, f"a\n{p}\nb"), (1, f"a\n{p}\nb"), (2, f"c\n{p}\nd"), (2, f"c\ne\nf\n{p}"), (None, p)])
    got = Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(docs, passage_words=50).collect())
    assert got == Counter([(1, f"a\n{p}\nb"), (1, f"a\n{p}\nb"), (2, "c\nd"), (2, "c\ne\nf"), (None, p)])


def test_pipeline_cuts_passages(spark):
    import corpus_pipeline
    p = "\n".join(" ".join(f"p{k}w{i}" for i in range(30)) for k in range(2))
    docs = table(spark, [(i, f"own {i}\nline {i}\n{p}\nand {i}\nend {i}") for i in range(20)])
    out = {r.doc_id: r.text for r in corpus_pipeline.cut_lines(spark, docs, "").collect()}
    assert [i for i, t in out.items() if "p0w3" in t or "p1w3" in t] == [0] and out[7] == "own 7\nline 7\nand 7\nend 7"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(docs, percent):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_groups_equal_brute_force(spark, families, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(table(spark, families), percent / 100).collect()}
    want = brute_components(families, percent)
    assert got == want
    assert sum(not k for *_, k in want.values()) > 20


def test_near_search_of_the_rest(spark, families, monkeypatch):
    """With stars switched off, the block search alone finds every link."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(table(spark, families), 0.85).collect()}
    assert got == {i: c for i, (_, c, _) in brute_components(families, 85).items()}


def test_near_links_behind_unlinked_copies(spark):
    """An original and its near copy come after six unlinked copies that each rewrite another section, so
    that most of their buckets have an unlinked star center and only the search of the rest links them."""
    docs = []
    for seed in range(120):
        rng = random.Random(seed)
        base = [f"f{seed}w{rng.randrange(10 ** 6)}" for _ in range(400)]
        for k in range(6):
            docs.append((len(docs), " ".join([*base[:60 * k + 9], *[f"n{seed}k{k}w{i}" for i in range(32)], *base[60 * k + 41:]])))
        docs.append((len(docs), " ".join(base)))
        docs.append((len(docs), " ".join([*base[:372], *[f"n{seed}k9w{i}" for i in range(20)], *base[392:]])))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(table(spark, docs), 0.85).collect()}
    want = {i: c for k in range(0, len(docs), 8) for i, (_, c, _) in brute_components(docs[k:k + 8], 85).items()}
    assert all(want[i] == (i - 1 if i % 8 == 7 else i) for i in want)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_near_edges(hard, empty):
    rows = near_dedup.near_groups(hard).collect()
    assert len(rows) == len(HARD)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by[4] == {(2, 1, False)} and by[2] == {(0, 2, True)} and by[9] == {(0, 9, True)}
    assert by[6] == {(1, 5, False)} and by[5] == {(1, 5, True)} and {x[1:] for x in by[8]} == {(7, False)}
    assert {x[1:] for x in by[None]} == {(None, True)}
    assert near_dedup.near_groups(empty).collect() == []
    assert near_dedup.dedup(hard).columns == hard.columns


def test_likelihood_is_close(families):
    import numpy as np
    from runloom.llm.hashing import Powers
    sets = [s for s in near_dedup.shingle_sets([t.encode() for _, t in families], Powers()) if len(s) > 30]
    regs = [near_dedup.registers(near_dedup.minima(s, near_dedup._keys())) for s in sets]
    gaps = []
    for i in range(len(sets)):
        for j in range(i):
            same = len(np.intersect1d(sets[i], sets[j]))
            if same:
                one = near_dedup.likely(regs[i][None], regs[j][None], np.array([len(sets[i])]), np.array([len(sets[j])]))[0]
                gaps.append(one - same / (len(sets[i]) + len(sets[j]) - same))
    assert len(gaps) > 50 and abs(np.mean(gaps)) < 0.02 and np.max(np.abs(gaps)) < 0.2


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a:a + k])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in windows:
                    hit |= set(range(a, a + k))
                    names |= windows[tuple(w[a:a + k])]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination_equals_brute_force_on_both_paths(spark, families, hard, empty):
    items = [(1, families[3][1]), (2, families[40][1]), (12, families[3][1]), (3, "one two"), (4, None), (5, " .,; "), (6, "Épsilon ünd 7even"), (None, "alpha")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [x for x in items if x[0] is not None]
    docs = families + HARD + [(500, "x one, TWO épsilon ünd 7even"), (501, "one two one two")]
    df = table(spark, docs)
    for limit in (1 << 20, 0):
        got = Counter(tuple(r) for r in decontaminate.contamination(df, bench, broadcast_bytes=limit).collect())
        assert got == brute_hits(docs, known)
        assert decontaminate.contamination(empty, bench, broadcast_bytes=limit).collect() == []
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in brute_hits(docs, known).elements() if not r[5])
    none = bench.limit(0)
    assert decontaminate.contamination(df, none).where("contaminated").count() == 0
    assert decontaminate.contamination(df, none, broadcast_bytes=-1).where("contaminated").count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry
    assert os.path.basename(entry.__file__) == "__spark_entry__.py" and set(QUERIES) <= set(entry.queries())
