"""Tokens, token files, secrets, licenses, pages and the classifier against libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runloom.llm import bpe, html_extract, license_scan, quality, secret_scan, token_files

from .conftest import HARD, table


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


ENCODER = bpe.Encoder(bpe.vocabulary_path())
LIBRARY = Tokenizer.from_file(bpe.vocabulary_path())
ODD = st.lists(st.one_of(st.sampled_from([*"ab '’sltredm\n\t_9²é日😀<|>\x1f K§±÷×ªµº", "<|endoftext|>", "  ", "aaa", "\u200b", "\u0301"]),
                         st.characters(codec="utf-8")), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_bpe_equals_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = bpe.parsed(ENCODER.texts([text])[0])
    assert got.tolist() == want
    assert ENCODER.merges.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


def test_decode_of_any_ids(library):
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert ENCODER.merges.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables(spark, hard, empty, library):
    rows = Counter(tuple(r) for r in bpe.encode_digests(hard).collect())
    want = Counter()
    for i, t in HARD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert rows == want
    assert bpe.encode_digests(empty).collect() == []
    back = bpe.decode(bpe.encode(hard))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in HARD)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 50257, n) for n in (0, 1, 2, 5, 700, 2048)]
    blocks += [np.zeros(900, np.int64), np.full(300, 50256), rng.integers(0, 4, 2048), np.repeat(rng.integers(0, 50257, 40), 30)]
    payloads = token_files.encode_blocks(blocks)
    for a, b in zip(blocks, token_files.decode_blocks(payloads, [len(b) for b in blocks]), strict=True):
        assert a.tolist() == b.tolist()
    # Predictable ids cost little, and a block decodes alone.
    assert len(payloads[6]) < 100 and len(payloads[8]) < 2048
    assert token_files.decode_blocks([payloads[5]], [2048])[0].tolist() == blocks[5].tolist()


def test_library_encoder_by_words(library):
    texts = [*(t or "" for _, t in HARD), "<|endoftext|>a <|endoftext|><|endoftext|> b", "  x\n\n y²½ é́ 日本 ", "it's 12 we'll\x1c\x1d end"]
    once = token_files.LibraryEncoder(bpe.vocabulary_path(), known_words=3)
    for held in (texts, texts[::-1], texts[3:5]):
        assert [x.tolist() for x in once.texts(held)] == [library.encode(t, add_special_tokens=False).ids for t in held]


def test_token_files(spark, hard, empty, library, tmp_path):
    folder = f"{tmp_path}/tokens"
    token_files.write_tokens(hard, folder)
    files = spark.read.parquet(folder)
    rows = token_files.token_digests(files).orderBy("start").collect()
    order = sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [i for i, _ in order]
    at, texts = 0, Counter()
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    for i, t in HARD:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        texts[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == texts
    ids = {r.doc_id: r.ids for r in token_files.read_tokens(files).collect()}
    assert ids[1][-1] == 0 and library.decode(ids[1][:-1]) == HARD[0][1]
    token_files.write_tokens(empty, f"{tmp_path}/none")
    assert token_files.token_digests(spark.read.schema(token_files._FILE).parquet(f"{tmp_path}/none")).collect() == []


def test_a_damaged_block_is_found(spark, hard, tmp_path):
    folder = f"{tmp_path}/tokens"
    token_files.write_tokens(hard, folder)
    bad = spark.read.parquet(folder).selectExpr("shard", "seq", "doc_ids", "lengths", "n_tokens", "sizes", "transform(checks, c -> c + 1) AS checks", "payloads")
    with pytest.raises(Exception, match="checksum"):
        token_files.token_digests(bad).collect()


def brute_base(text):
    found = []
    for k, (pattern, flags, ok) in enumerate((
            (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
            (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24))):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    return sorted(found)


PARTS = st.sampled_from(["password", "TOKEN", "api_key", "apikey", '"', "'", " ", "=", ": ", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "deadbeef", "x", "é", "K",
                         "ſecret", "secret", "short", "\n", "abcdef"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert secret_scan.base_spans(text) == brute_base(text)


def test_randomness_is_calibrated():
    rng = random.Random(3)
    for symbols in ("0123456789abcdef", secret_scan.ALPHABETS[10], "abcdefghijklmnopqrstuvwxyz"):
        p = [secret_scan.randomness("".join(rng.choice(symbols) for _ in range(40))) for _ in range(500)]
        assert 0.35 < sum(x < 0.5 for x in p) / 500 < 0.6 and sum(x < 0.01 for x in p) < 25
    assert max(map(secret_scan.randomness, ("aaaaaaaaaaaaaaaaaaaaaaaa", "internationalizationsettings", "0000000000111111111122", "abababababababababababab"))) < 0.05


def test_secret_tables(spark, hard, empty):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice(secret_scan.ALPHABETS[9]) for _ in range(40))
    docs = HARD + [(100 + i, f"use {key()} and token = '{key()}' then thisisanunusuallylongordinarywordwithoutrandomness") for i in range(60)]
    rows = secret_scan.scan(table(spark, docs)).collect()
    assert len(rows) == len(docs)
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t or "")
    for r in rows:
        base = [",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(t)) for t in texts[r.doc_id]]
        assert r.base_sha256 in [hashlib.sha256(b.encode()).hexdigest() for b in base]
        assert set(base[0].split(",")) - {""} <= set(r.spans.split(",")) or len(base) > 1
    found = sum(r.n_random for r in rows if r.doc_id and r.doc_id >= 100)
    assert 50 <= found <= 60 and sum(r.n_random for r in rows if r.doc_id and r.doc_id < 100) == 0
    assert secret_scan.scan(empty).collect() == []


TEMPLATES = [license_scan.Template(n, t, 0.8, 1.5) for n, t in license_scan.TEMPLATES.items()]


@pytest.mark.parametrize("name", license_scan.TEMPLATES)
def test_every_license_is_found_in_any_text(name):
    rng = random.Random(name)
    noise = [" ".join(rng.choice(["the", "of", "license", "red", "blue", "under", "work"]) for _ in range(80)) for _ in range(2)]
    text = license_scan.TEMPLATES[name]
    found = license_scan.licenses(f"{noise[0]}. {text} {noise[1]}", TEMPLATES)
    assert name in [f[0] for f in found]
    words = license_scan.words_of(text)
    if len(words) > 20:  # small edits stay, shuffled words don't
        for i in range(3, len(words), 9):
            words[i] = "edited"
        assert [f[0] for f in license_scan.licenses(" ".join(words), TEMPLATES)] == [name]
        rng.shuffle(words)
        assert license_scan.licenses(" ".join(words), TEMPLATES) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=20), st.lists(st.sampled_from("abcdefgh"), max_size=20))
def test_patience_pairs_increase_and_match(a, b):
    pairs = license_scan.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_longest_increasing_run():
    rng = random.Random(1)
    for _ in range(100):
        v = rng.sample(range(12), rng.randint(0, 9))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
        run = license_scan.increasing(list(enumerate(v)))
        assert len(run) == max(best, default=0) and all(x[1] < y[1] for x, y in zip(run, run[1:], strict=False))


def test_license_tables(hard, empty):
    rows = license_scan.scan(hard).collect()
    assert len(rows) == len(HARD) and all(r.licenses == [] for r in rows)
    assert license_scan.scan(empty).collect() == []


def page(i, body, extra=""):
    return (i, f"https://h{i % 3}.example.org/p/{i}", f"<html><head><title>x</title><style>p{{}}</style></head><body><nav><ul><li>a{i}</li></ul></nav>{extra}{body}"
            f"<footer>f{i}</footer></body></html>")


def test_wrapper_finds_the_varying_slot(spark, tmp_path):
    """No landmarks at all: only the alignment tells the content from constant parts."""
    rng = random.Random(2)
    said = {i: [" ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(99)) for _ in range(12)) for _ in range(rng.randint(2, 6))] for i in range(90)}
    pages = [page(i, "<div class='a'><p>Same words on every page</p></div><div class='b'><p>Always here</p>" + "".join(f"<p>{x} &amp; <b>b</b>c" for x in said[i])
                  + "<script>no()</script><form>no</form><div class='comments'>no</div></div>") for i in range(90)]
    want = {i: " ".join(f"{x} & bc" for x in said[i]) for i in range(90)}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for limit in (1 << 20, 0):
        assert {r.page_id: r.text for r in html_extract.extract_pages(df, broadcast_bytes=limit).collect()} == want


def test_page_edges(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, "http://a/", "plain text only"), (4, "http://a/", "<p>un<b>closed <p>two<!-- c <p>"), (5, "http://[bad", "<article>x &lt;y&gt; &nbsp; z</article>"),
            (None, "http://a/", "<body><article><h1>T</h1>a<br>b</article></body>"), (6, "http://c/", "<div>" * 5000 + "deep"), (6, "http://c/", "<div>" * 5000 + "deep")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(df).collect())
    text = Counter([(1, ""), (2, ""), (3, "plain text only"), (4, "unclosed two"), (5, "x <y> z"), (None, "T a b"), (6, "deep"), (6, "deep")])
    assert got == Counter({(i, t, len(t)): n for (i, t), n in text.items()})
    assert html_extract.extract_pages(df.limit(0)).collect() == []


def test_pages_of_the_test_tables(spark, sf):
    import html
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(?:/?p|br|/?h1)\b[^>]*>", " ", body))).split())
    assert {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()} == want


def test_matching_keeps_order_and_names():
    a = html_extract.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p><p>3</p></div>")
    b = html_extract.parse("<div><p>1</p><p>2</p><ul><li>y</li><li>z</li></ul></div>")
    m = html_extract.Matcher()
    pairs = m.align(a, b)
    assert all(x.name == y.name for x, y in pairs)
    assert len(pairs) == m.weight(a, b)


def test_classifier_on_held_out_labels(spark):
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4))
    rows = quality.score(docs, labels.where(fold > 0)).join(labels.where(fold == 0), "doc_id").collect()
    bad = [r for r in rows if r.quality == 0 or r.toxic == 1]
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(not r.keep for r in bad) >= 0.93 * len(bad) and sum(r.keep for r in clean) >= 0.99 * len(clean)


def test_classifier_edges(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for given_labels in (labels, labels.limit(0), labels.where("doc_id = 1")):
        rows = quality.score(hard, given_labels).collect()
        assert len(rows) == len(HARD) and all(0 <= r.posterior_bad <= 1 for r in rows)
    assert all(r.keep for r in quality.score(hard, labels.limit(0)).collect())
    assert quality.score(empty, labels).collect() == []
    assert quality.filter_documents(hard, labels).columns == hard.columns


def test_sparse_sites_shrink(spark):
    """A host with many bad documents raises the odds of its documents, a single one hardly does."""
    docs = [(i, ("junk ### $$$ %%% junk " * 8) if i % 2 and i < 400 else f"plain words in a calm text {i} " * 8) for i in range(800)]
    df = spark.createDataFrame([(i, t, "bad.org" if i < 400 and i % 2 else "few.org" if i == 401 else "good.org", "en") for i, t in docs],
                               "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 2 and i < 400 else 1, 0) for i in range(0, 800, 3)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.score(df, labels).collect()}
    assert rows[1].host_rate > 0.8 and rows[2].host_rate < 0.1 and 0.05 < rows[401].host_rate < 0.6
    assert not rows[1].keep and rows[2].keep and rows[401].keep
