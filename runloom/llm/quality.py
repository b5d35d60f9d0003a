"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes.

1. **Evidence.** Two logistic models (low quality, toxic) over hashed words, word beginnings and
   shape features, fitted on a sample of ``SAMPLE`` labelled rows at most, drawn by a hash of the id.
   The weights are two float vectors of fixed length, so their broadcast has a fixed size.
2. **Sites.** Grouped sums of the probabilities over *all* documents give each host's and each
   path's rate. A Beta prior is fitted by moments at each level: between-site variance beyond what
   sampling explains sets how strongly a site counts. A path shrinks to its host, a host to the
   whole corpus, so sparse sites say little. A document is left out of its own sites' rates.
3. **Posterior.** The log-odds of the document plus the log-odds of its path's posterior against the
   corpus rate. Documents with a posterior of badness above one half are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.hashing import LETTERS_DIGITS, Powers, Words, as_bytes, blocks, mix
from runloom.plans.store import written

SAMPLE = 8000
BITS = 18
SHAPES = 12
#: Lengths in bytes of word beginnings that count as features of their own.
BEGINNINGS = (4, 5, 6, 7, 8)
ROUNDS = 150
#: A feature takes part if its smoothed log-odds lie this many deviations from zero.
DEVIATIONS = 3.5
LEAST_DOCUMENTS = 3
PENALTY = 1e-3


def features(texts: list[bytes | None], powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: sorted distinct feature numbers below 2**BITS, and SHAPES shape values."""
    for _, held in blocks(texts):
        w = Words(held, LETTERS_DIGITS, powers)
        total = None
        kinds = [w.hash]
        for n in BEGINNINGS:
            end = np.minimum(w.start + n, w.end)
            if total is None:
                total = w.running(powers)
            part = (total[end] - total[w.start]) * powers.down[w.start]
            kinds.append(mix(part + np.uint64(n << 40)))
        index = np.stack([(k >> np.uint64(64 - BITS)).astype(np.int32) for k in kinds])
        sizes = w.end - w.start
        raw = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        for i, text in enumerate(held):
            a, b = int(w.first[i]), int(w.first[i + 1])
            body = raw[w.text_start[i]:w.text_start[i + 1] - 1]
            yield np.unique(index[:, a:b]), shape(body, sizes[a:b], w.hash[a:b])


def shape(body: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Fixed features of a text's form, each about 0 to 1."""
    n = max(len(body), 1)
    seen = np.bincount(body, minlength=256) / n
    count = len(sizes)
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    return np.array([
        min(np.log1p(count) / 8, 1.5), marks, seen[[33, 63]].sum(), seen[[35, 36, 37, 38, 42]].sum() * 4, seen[124] * 10,
        seen[65:91].sum() * 2, seen[48:58].sum() * 4, seen[10] * 20, (sizes.mean() / 10 if count else 0),
        (len(np.unique(words)) / count if count else 0), seen[32] * 4, float(count < 5)], np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (feature, all, low, toxic): labelled documents of the task that have the feature."""
    powers, sums = Powers(), np.zeros((3, 1 << BITS), np.int64)
    for batch in batches:
        classes = [np.array(batch.column(c).to_pylist(), np.int64) for c in (1, 2)]
        with np.errstate(over="ignore"):
            for i, (found, _) in enumerate(features(as_bytes(batch.column(0)), powers)):
                sums[0, found] += 1
                for k in (0, 1):
                    if classes[k][i]:
                        sums[k + 1, found] += 1
    seen = np.flatnonzero(sums[0])
    for i in range(0, len(seen), 1 << 16):
        part = seen[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *[pa.array(sums[k, part]) for k in range(3)]],
                                         ["feature", "all", "low", "toxic"])


def _feature_rows(telling: np.ndarray):
    """Feature numbers that tell a class apart, shapes and labels of every labelled document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            with np.errstate(over="ignore"):
                found = [(f[telling[f]], s) for f, s in features(as_bytes(batch.column(0)), powers)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f.astype(np.int32).tobytes() for f, _ in found], pa.binary()),
                 pa.array([s.tobytes() for _, s in found], pa.binary()), batch.column(1), batch.column(2)],
                ["features", "shape", "low", "toxic"])
    return run


def telling_features(seen: np.ndarray, bad: np.ndarray, n: int, n_bad: int) -> np.ndarray:
    """Features whose document frequencies separate a class beyond chance: log-odds against their deviation."""
    a, b = bad + 0.5, seen - bad + 0.5
    gap = np.log(a / (n_bad - bad + 1.0)) - np.log(b / (n - n_bad - (seen - bad) + 1.0))
    return (seen >= LEAST_DOCUMENTS) & (np.abs(gap) / np.sqrt(1 / a + 1 / b) >= DEVIATIONS)


def standard(shapes: np.ndarray) -> np.ndarray:
    return np.concatenate([shapes, shapes ** 2, np.ones((len(shapes), 1), np.float32)], axis=1)


class Logistic:
    """Weights of hashed features and of shapes; fitted by Adam on the whole sample at once."""

    def __init__(self) -> None:
        self.word = np.zeros(1 << BITS, np.float32)
        self.form = np.zeros(2 * SHAPES + 1, np.float32)

    def fit(self, columns: np.ndarray, rows: np.ndarray, shapes: np.ndarray, target: np.ndarray) -> Logistic:
        n = len(target)
        if not 0 < target.sum() < n:  # one class only: its smoothed rate
            self.form[-1] = np.log((target.sum() + 1) / (n - target.sum() + 1)) if n else -20.0
            return self
        there = np.bincount(columns, minlength=1 << BITS) > 0
        used = np.flatnonzero(there)
        columns = (np.cumsum(there, dtype=np.int32) - 1)[columns]
        x = standard(shapes)
        w, f = np.zeros(len(used)), np.zeros(x.shape[1])
        f[-1] = np.log(target.mean() / (1 - target.mean()))
        state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(f), np.zeros_like(f)]
        for k in range(1, ROUNDS + 1):
            z = np.bincount(rows, w[columns], n) + x @ f
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
            grads = (np.bincount(columns, error[rows], len(used)) / n + PENALTY * w, x.T @ error / n + 1e-6 * f)
            for i, (value, grad, rate) in enumerate(((w, grads[0], 0.1), (f, grads[1], 0.3))):
                state[2 * i] = 0.9 * state[2 * i] + 0.1 * grad
                state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * grad ** 2
                value -= rate * (state[2 * i] / (1 - 0.9 ** k)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99 ** k)) + 1e-8)
        self.word[used], self.form = w, f.astype(np.float32)
        return self

    def odds(self, found: np.ndarray, form: np.ndarray) -> float:
        return float(np.clip(self.word[found].sum() + form @ self.form, -30, 30))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Logistic]:
    """Models of low quality and of toxicity from ``labels`` (doc_id, quality 0/1, toxic 0/1).

    At most ``sample`` labelled ids reach the fit, as feature numbers, never as texts. Labels with a
    null id are ignored; a null label counts as the good class. Without labels nothing is rejected.
    """
    known = (labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0).cast("int")).alias("low"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(known.select(F.col("doc_id").cast("long"), "low", "toxic")), "doc_id")  # ``sample`` rows at most
    rows = written(joined.select("text", F.col("low").cast("int"), F.col("toxic").cast("int")), "labelled")
    counts = np.zeros((3, 1 << BITS), np.int64)
    sums = rows.mapInArrow(_frequencies, "feature long, all long, low long, toxic long").groupBy("feature").agg(
        *[F.sum(c).cast("int").alias(c) for c in ("all", "low", "toxic")]).where(F.col("all") >= LEAST_DOCUMENTS).toArrow()  # 2**BITS rows at most
    for k, c in enumerate(("all", "low", "toxic")):
        counts[k, sums["feature"].to_numpy()] = sums[c].to_numpy()
    del sums
    n, n_low, n_toxic = rows.agg(F.count(F.lit(1)), F.sum("low"), F.sum("toxic")).first()
    picked = [telling_features(counts[0], counts[k], n, m or 0) for k, m in ((1, n_low), (2, n_toxic))]
    known_rows = rows.mapInArrow(_feature_rows(picked[0] | picked[1]), "features binary, shape binary, low int, toxic int").toArrow()
    found = [np.frombuffer(x, np.int32) for x in known_rows["features"].to_pylist()]
    columns = np.concatenate(found) if found else np.empty(0, np.int32)
    at = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
    del found
    shapes = np.frombuffer(b"".join(known_rows["shape"].to_pylist()), np.float32).reshape(-1, SHAPES)
    return [Logistic().fit(columns[p[columns]], at[p[columns]], shapes, known_rows[c].to_numpy().astype(float))
            for c, p in zip(("low", "toxic"), picked, strict=True)]


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, powers = shared.value, Powers()
        for batch in batches:
            odds = []
            with np.errstate(over="ignore"):
                for found, form in features(as_bytes(batch.column(batch.num_columns - 1)), powers):
                    x = standard(form[None])[0]
                    odds.append([m.odds(found, x) for m in models])
            low, toxic = np.array(odds or np.empty((0, 2))).T
            bad = 1 - 1 / ((1 + np.exp(low)) * (1 + np.exp(toxic)))
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(low), pa.array(toxic), pa.array(np.clip(bad, 1e-6, 1 - 1e-6))],
                                             [*batch.schema.names[:-1], "low_odds", "toxic_odds", "p_bad"])
    return run


def _strength(groups: DataFrame, n: str, s: str, parent: Column) -> float:
    """How many documents a Beta prior is worth: by the variance of site rates beyond sampling."""
    rate, rest = F.col(s) / F.col(n), parent * (1 - parent)
    row = groups.where(F.col(n) >= 2).agg(
        F.sum(F.col(n) * (rate - parent) ** 2).alias("spread"), F.sum(rest).alias("chance"), F.sum(F.col(n) * rest).alias("total"),
        F.sum(F.col(n)).alias("n")).first()
    if not row["n"] or not row["total"]:
        return 1e6
    between = max(row["spread"] - row["chance"], 0.0) / row["n"]
    return min(max((row["total"] / row["n"]) / between - 1, 1.0), 1e6) if between > 0 else 1e6


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, digest, p_bad (document alone), host_rate, path_rate, posterior_bad, keep.

    ``host`` and ``path`` default to the columns source and (source, lang) where they exist. Null
    sites form a site of their own; null text is an empty one. ``digest`` is a 64-bit hash of the
    text, so that rows which share an id stay apart. An empty table gives an empty result.
    """
    def column(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("")

    host = column("source") if host is None else F.coalesce(host.cast("string"), F.lit(""))
    path = column("lang") if path is None else F.coalesce(path.cast("string"), F.lit(""))
    models = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"), host.alias("host"),
                       path.alias("path"), F.col(text_col).alias("text"))
    scored = written(rows.mapInArrow(_scores(models), "doc_id long, digest long, host string, path string, low_odds double, "
                                                      "toxic_odds double, p_bad double"), "scores")
    mean = scored.agg(F.avg("p_bad")).first()[0] or 0.5
    hosts = scored.groupBy("host").agg(F.count(F.lit(1)).alias("hn"), F.sum("p_bad").alias("hs"))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pn"), F.sum("p_bad").alias("ps"))
    host_k = _strength(hosts, "hn", "hs", F.lit(mean))
    shrunk = hosts.withColumn("hr", (F.col("hs") + host_k * mean) / (F.col("hn") + host_k))
    path_k = _strength(paths.join(shrunk, "host"), "pn", "ps", F.col("hr"))
    # Written, so that the join below has two plain sides, and a hot site can be split or its row broadcast.
    sites = written(paths.join(hosts, "host"), "sites")
    joined = scored.join(sites, ["host", "path"])
    p = F.col("p_bad")
    host_rate = (F.col("hs") - p + host_k * mean) / (F.col("hn") - 1 + host_k)
    path_rate = (F.col("ps") - p + path_k * F.col("host_rate")) / (F.col("pn") - 1 + path_k)

    def odds(x: Column) -> Column:
        x = F.greatest(F.least(x, F.lit(1 - 1e-6)), F.lit(1e-6))
        return F.log(x / (1 - x))

    post = odds(p) + odds(F.col("path_rate")) - odds(F.lit(mean))
    out = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate).withColumn("posterior_bad", 1 / (1 + F.exp(-post)))
    return out.select("doc_id", "digest", "p_bad", "host_rate", "path_rate", "posterior_bad", (F.col("posterior_bad") <= 0.5).alias("keep"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns."""
    bad = score(docs, labels).where("NOT keep").select(F.col("doc_id").alias("_bad_id"), "digest").distinct()
    on = docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["digest"])
    return docs.join(bad, on, "left_anti")
