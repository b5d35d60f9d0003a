"""Registered queries: similarity, streaming and user extensions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runloom.functions.registry import REGISTRY_SCHEMA, with_descriptor
from runloom.operators import equivalence as Q
from runloom.operators import evaluate as E
from runloom.operators import matching as M
from runloom.operators import similarity as S
from runloom.operators import top_cosine as TC
from runloom.plans import catalog_match as CM
from runloom.plans import dataset as D
from runloom.plans import store
from runloom.plans.adapter import staged_steps
from runloom.plans.catalog_steps import with_coherence
from runloom.plans.oracle_base import labelled, steps
from runloom.plans.store import staged
from runloom.streaming import incremental as L

K = ["task_id", "trajectory_id"]
QUERIES = {}


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


add("state_text", lambda s, d: staged_steps(s, d).select(*K, "seq", S.state_text().alias("text")),
    steps("SELECT task_id, trajectory_id, seq, concat_ws(' | ', tool_used, nullif(file_path, ''), CASE category WHEN 'edit' THEN 'modify' WHEN 'execute' THEN 'terminal' "
          "WHEN 'general' THEN 'other' ELSE category END, resulting_state, substr(observation, 1, 300)) AS text FROM st"))
STOP = ("the", "and", "der", "die", "la", "le")
add("tfidf_vectors", lambda s, d: S.tfidf(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), ["doc_id"], stop_words=STOP).groupBy("doc_id").agg(
    F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.max("weight"), 4).alias("top")),
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term NOT IN ('the', 'and', 'der', 'die', 'la', 'le') GROUP BY 1, 2),
      vc AS (SELECT term, ln((SELECT count(DISTINCT doc_id) + 1 FROM documents) / CAST(count(*) + 1 AS DOUBLE)) + 1 AS idf FROM tf GROUP BY 1),
      x AS (SELECT doc_id, tf * idf AS w FROM tf JOIN vc USING (term))
      SELECT doc_id, count(*) AS terms, round(sum(w) / sqrt(sum(w * w)), 4) AS total, round(max(w) / sqrt(sum(w * w)), 4) AS top FROM x GROUP BY 1""")


def _soft(s, d):
    e = S.dense_rows(s.read.parquet(f"{d}/embeddings.parquet"), "embedding").select(
        "label", F.col("vec_id").alias("id"), "idx", "val")
    m = S.soft_match(e.where("id % 2 = 0"), e.where("id % 2 = 1"), ["label"])
    return m.select("label", *[F.round(c, 5).alias(c) for c in ("soft_precision", "soft_recall", "soft_f1")])


add("soft_match_f1", _soft, """WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  p AS (SELECT a.label, a.vec_id AS c, b.vec_id AS r, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
  pc AS (SELECT label, avg(m) AS p FROM (SELECT label, c, max(s) AS m FROM p GROUP BY 1, 2) GROUP BY 1),
  rc AS (SELECT label, avg(m) AS r FROM (SELECT label, r, max(s) AS m FROM p GROUP BY 1, 2) GROUP BY 1)
  SELECT label, round(p, 5) AS soft_precision, round(r, 5) AS soft_recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5) AS soft_f1 FROM pc JOIN rc USING (label)""")


def embedding_baseline(s, d):
    """Soft match of step texts with every donor, averaged, beside the graph score."""
    def build():
        t = staged_steps(s, d).select("task_id", "trajectory_id", "seq", S.state_text().alias("text"))
        v = S.sparse_rows(S.tfidf(t, ["task_id", "trajectory_id", "seq"]), ["task_id", "trajectory_id", "seq"]).withColumnRenamed("seq", "id")
        dn = D.donors(s, d).select(*K)
        ref = v.join(dn, K).withColumnRenamed("trajectory_id", "donor_id")
        cand = v.join(dn.select("task_id").distinct(), "task_id", "left_semi").join(dn, K, "left_anti")
        return TC.soft_match_sparse(cand, ref, K, ["donor_id"], on=["task_id"]).groupBy(*K).agg(
            F.count(F.lit(1)).alias("donors"), F.sum("compared").alias("compared"), F.sum("pairs").alias("pairs"), *[F.avg(c).alias(c) for c in ("soft_precision", "soft_recall", "soft_f1")])
    return staged(s, "embedding_baseline", d, build)


add("embedding_baseline", lambda s, d: embedding_baseline(s, d).select(*K, "donors", F.round("soft_f1", 6).alias("soft_f1"), "compared", "pairs"))
add("embedding_vs_graph", lambda s, d: E.discrimination(E.unpivot_scores(
    embedding_baseline(s, d).join(D.reports(s, d).select(*K, "passed", "process_score"), K).withColumn("embedding", F.col("soft_f1")),
    ("embedding", "process_score"), [*K, "passed"], unit_scale=("embedding",)), ["score_type"]).select("score_type", F.round("auroc", 6).alias("auroc")))


# --- streaming -----------------------------------------------------------------------------
# These runs end with their input. A time-out by processing time never lets such a run end, so none is set.
def _stream_of(s, d, name, build):
    table = staged(s, name, d, build)
    path = store._STAGED[(s.sparkContext.applicationId, name, d)]
    return s.readStream.schema(table.schema).parquet(path)


def _drained(s, d, name, build, query, folder, size=20):
    """``query`` of a stream of the table, in buffers of ``size`` steps of every run. Each buffer is added to the
    stream's folder by all tasks, as one micro-batch has all files that are new, and the stream goes on from its checkpoint."""
    table, path = staged(s, name, d, build), _folder(s, f"{name}-buffers")
    for b in range((table.agg(F.max("seq")).first()[0] or 0) // size + 1):
        table.where(F.floor(F.col("seq") / size) == b).write.mode("append").parquet(path)
        out = L.drain(query(s.readStream.schema(table.schema).parquet(path)), folder)
    return out


def _folder(s, name):
    return f"{store.shared_root(s)}/{name}-{uuid.uuid4().hex[:8]}"


def live_match(s, d):
    """All candidate runs in buffers of twenty steps; equivalence is decided inside the stream."""
    keyed, lengths = L.match_reference(CM.lone_ref(s, d), CM.lone_refs(s, d), M.reference_ids(CM.lone_ref(s, d)))
    keyed = staged(s, "match_contents", d, lambda: keyed)
    lengths = staged(s, "match_lengths", d, lambda: lengths)
    return _drained(s, d, "match_steps", lambda: CM.lone_cand(s, d).select(*K, "seq", "c"),
                    lambda steps: L.live_match(steps, keyed, lengths, None, overlap=False), _folder(s, "incremental"))


_STREAM_SQL = CM.MBASE + """ SELECT task_id, trajectory_id, sub AS matched, sub AS new_offset, round(sub * 100.0::DOUBLE / m, 2) AS overall_coverage_percent
    FROM s3 JOIN rc USING (trajectory_id)"""
add("incremental_match", lambda s, d: live_match(s, d).groupBy(*K).agg(
    F.sum("matched").alias("matched"), F.max("new_offset").cast("long").alias("new_offset"), F.max("overall_coverage_percent").alias("overall_coverage_percent")),
    _STREAM_SQL)
add("live_profile", lambda s, d: _drained(s, d, "profile_input", lambda: staged_steps(s, d).select(
    *K, "seq", "tool_used", "file_path", "intent_stage"), lambda steps: L.live_profile(steps, None), _folder(s, "live")).groupBy(*K).agg(F.max_by(F.struct(
    "steps", "pivot", "backtrack", "confirm", "blind_retries", "coherence"), "steps").alias("r")).select(
    *K, "r.steps", "r.pivot", "r.backtrack", "r.confirm", "r.blind_retries", F.round("r.coherence", 6).alias("coherence")),
    with_coherence("SELECT task_id, trajectory_id, transitions + 1 AS steps, \"pivot\", backtrack, confirm, blind_retries, round(CAST(coherence AS DOUBLE), 6) AS coherence FROM coh"))


# --- user extensions -------------------------------------------------------------------------
def _resolver(a, b):
    """Accept searches whose query starts alike: an example of a user-supplied rule."""
    near = (a["category"] == "search") & (F.substring(a["query"], 1, 3) == F.substring(b["query"], 1, 3))
    return F.when(near, F.struct(F.lit(True).alias("equivalent"), F.lit(0.8).alias("confidence"), F.lit("user_rule").alias("method")))


def _query_start(c):
    return F.when(c["category"] == "search", F.array(F.concat(F.lit("start:"), F.substring(c["query"], 1, 3)))) \
        .otherwise(F.array().cast("array<string>"))


def _user_rule(s, d):
    r, c = CM.lone_ref(s, d), CM.lone_cand(s, d)
    p = Q.equivalence_pairs(r, c, resolver=_resolver, extra_keys=_query_start)
    rs = r.groupBy("task_id", F.col("sig").alias("ref_sig")).agg(F.count(F.lit(1)).alias("nr"))
    cs = c.groupBy("task_id", F.col("sig").alias("cand_sig")).agg(F.count(F.lit(1)).alias("nc"))
    return p.where("method = 'user_rule'").join(rs, ["task_id", "ref_sig"]).join(cs, ["task_id", "cand_sig"]).groupBy("task_id").agg(
        F.sum(F.col("nr") * F.col("nc")).alias("pairs"))


add("user_equivalence_rule", _user_rule, CM.BASE.replace("SELECT a.task_id, b.trajectory_id,", "SELECT a.category AS ac, a.task_id, b.trajectory_id,") +
    " SELECT task_id, count(*) AS pairs FROM pr WHERE v = 'n:heuristic' AND ac = 'search' GROUP BY 1")


def _user_tools(s, d):
    extra = s.createDataFrame([("think", "validation", "verification", "diagnostics", "other", "identity", False)], REGISTRY_SCHEMA)
    cols = [c for c in staged_steps(s, d).columns if c in ("tool_used",)]
    return with_descriptor(staged_steps(s, d).select(*cols), extra=extra).groupBy("tool_used", "category").agg(F.count(F.lit(1)).alias("n"))


add("user_registered_tools", _user_tools, steps("SELECT tool_used, CASE WHEN tool_used = 'think' THEN 'validation' ELSE category END AS category, count(*) AS n FROM st GROUP BY ALL"))


def _no_stage(s, d):
    r, c = CM.lone_ref(s, d), CM.lone_cand(s, d)
    h = M.candidate_hits(c, Q.equivalence_pairs(r, c, use_stage=False), M.reference_ids(r))
    return M.best_match(h, CM.lone_refs(s, d), strategy="canonical").select(*K, F.size("m.set_pos").cast("long").alias("matched"))


add("match_options", _no_stage, CM.MBASE.replace("WHEN a.intent_stage <> b.intent_stage THEN 'n:stage_mismatch'", "WHEN FALSE THEN ''") +
    " SELECT task_id, trajectory_id, len(mpos) AS matched FROM s2")
