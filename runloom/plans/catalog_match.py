"""Registered queries over run against reference: equivalence, graphs, matching, reports, waste.

Checked queries use one run of each task as the reference, so every step of the check can
be written in SQL. The merged-reference queries run the same operators on merged graphs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runloom.operators import assess as A
from runloom.operators import equivalence as Q
from runloom.operators import matching as M
from runloom.operators import refgraph as G
from runloom.operators import waste as W
from runloom.operators.scan import spread
from runloom.plans import dataset as D
from runloom.plans.catalog_steps import COHERENCE_CTE
from runloom.plans.oracle_base import labelled, q, rx, ttype
from runloom.plans.store import staged

K = ["task_id", "trajectory_id"]
QUERIES = {}


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


# --- one run per task as the reference ---------------------------------------------------
def lone_ref(s, d):
    return D.sig_steps(s, d).where(F.col("trajectory_id") % 10 == 0)


def lone_cand(s, d):
    return D.sig_steps(s, d).where(F.col("trajectory_id") % 10 != 0)


def lone_pairs(s, d):
    return staged(s, "lone_pairs", d, lambda: Q.equivalence_pairs(lone_ref(s, d), lone_cand(s, d)))


def lone_path_states(s, d):
    return lone_ref(s, d).withColumn("path_id", F.lit(0)).withColumn("pos", F.col("seq").cast("int"))


def lone_refs(s, d):
    return M.reference_paths(lone_path_states(s, d), M.reference_ids(lone_ref(s, d)), ["task_id"])


def lone_hits(s, d):
    return staged(s, "lone_hits", d, lambda: M.candidate_hits(
        lone_cand(s, d), lone_pairs(s, d), M.reference_ids(lone_ref(s, d))))


def lone_metrics(s, d):
    return staged(s, "lone_metrics", d, lambda: M.match_metrics(
        M.best_match(spread(lone_hits(s, d)), lone_refs(s, d)), M.run_features(lone_cand(s, d))))


def lone_reports(s, d):
    return staged(s, "lone_reports", d, lambda: A.assess(
        lone_metrics(s, d).join(D.runs(s, d).select(*K, "model", "passed"), K)))


def lone_flags(s, d):
    return staged(s, "lone_flags", d, lambda: W.step_flags(lone_cand(s, d), lone_reports(s, d)))


def lone_first(s, d):
    return lone_refs(s, d).select("task_id", F.col("paths")[0].alias("first"))


# Check SQL. Compared fields per step, then the rule cascade on every pair of a task.
_CMD = "trim(regexp_replace(regexp_replace(command, '^cd\\s+[^\\s&;]+\\s*[&;]+\\s*', ''), '\\bpython3?\\b', 'python', 'g'))"
EQ = f""", cf AS (SELECT *, {_CMD} AS nc FROM lab),
cg AS (SELECT *, CASE WHEN nc = '' THEN '' WHEN {rx('nc', Q.SEARCH_COMMAND)} THEN 'search' WHEN {rx('nc', Q.VIEW_COMMAND)}
    THEN 'view' WHEN {rx('nc', Q.EXECUTE_COMMAND)} THEN 'execute' ELSE '' END AS cgrp FROM cf),
ch AS (SELECT *, CASE cgrp WHEN 'search' THEN regexp_extract(nc, '"([^"]+)"', 1)
    WHEN 'view' THEN list_filter(string_split(nc, ' '), lambda w: contains(w, '/'))[-1]
    WHEN 'execute' THEN regexp_extract(nc, {q(Q.EXECUTE_TARGET)}, 1) ELSE '' END AS tgt FROM cg),
pr AS (SELECT a.task_id, b.trajectory_id, a.seq AS rs, b.seq AS cs, a.intent_stage AS stage,
   CASE WHEN a.intent_stage <> b.intent_stage THEN 'n:stage_mismatch'
    WHEN a.tool_used <> b.tool_used AND NOT (a.category = 'edit' AND b.category = 'edit') THEN 'n:exact_match'
    WHEN a.tool_used = b.tool_used AND a.content_hash <> '' AND a.content_hash = b.content_hash THEN 'y:content_hash'
    WHEN a.tool_used = b.tool_used AND a.resulting_state = b.resulting_state AND (a.content_hash = '' OR b.content_hash = '') THEN 'y:resulting_state'
    WHEN a.tool_used = b.tool_used AND a.observation = b.observation THEN 'y:exact_match'
    WHEN a.tool_used = b.tool_used AND a.category = 'edit' AND a.file_path = b.file_path AND a.function_name <> '' AND b.function_name <> ''
      THEN CASE WHEN a.function_name = b.function_name THEN 'y:scope_match' ELSE 'n:scope_match' END
    WHEN a.tool_used = b.tool_used AND a.category IN ('edit', 'read') AND a.file_path <> b.file_path THEN 'n:line_overlap'
    WHEN a.tool_used = b.tool_used AND a.category = 'read' AND (a.line_start IS NULL OR b.line_start IS NULL) THEN 'y:line_overlap'
    WHEN a.tool_used = b.tool_used AND a.category IN ('edit', 'read') AND greatest(0, least(a.line_end, b.line_end) - greatest(a.line_start, b.line_start) + 1)
      / CAST(greatest(a.line_end, b.line_end) - least(a.line_start, b.line_start) + 1 AS DOUBLE) >= 0.3 THEN 'y:line_overlap'
    WHEN a.tool_used = b.tool_used AND a.category IN ('edit', 'read') AND least(a.line_end, b.line_end) < greatest(a.line_start, b.line_start) THEN 'n:line_overlap'
    WHEN a.category = 'execute' AND (a.nc = b.nc OR (a.cgrp <> '' AND a.cgrp = b.cgrp AND a.tgt = b.tgt)) THEN 'y:terminal_similarity'
    WHEN a.category = 'execute' AND split_part(a.nc, ' ', 1) = split_part(b.nc, ' ', 1) THEN 'y:terminal_similarity'
    WHEN a.tool_used <> b.tool_used THEN CASE WHEN a.file_path <> b.file_path THEN 'n:heuristic'
      WHEN a.function_name <> '' AND b.function_name <> '' AND a.function_name <> b.function_name THEN 'n:heuristic' ELSE 'y:heuristic' END
    WHEN a.category = 'read' THEN 'n:heuristic' WHEN a.category = 'edit' THEN CASE WHEN a.tool_used = 'apply_patch' OR a.file_path = b.file_path THEN 'y:heuristic' ELSE 'n:heuristic' END
    WHEN a.category = 'search' THEN CASE WHEN a.query = b.query THEN 'y:heuristic' ELSE 'n:heuristic' END
    WHEN a.category = 'execute' THEN 'n:heuristic'
    ELSE CASE WHEN a.args_json = b.args_json THEN 'y:heuristic' ELSE 'n:heuristic' END END AS v
  FROM ch a JOIN ch b ON a.task_id = b.task_id AND a.trajectory_id % 10 = 0 AND b.trajectory_id % 10 <> 0)"""
BASE = labelled("").rstrip() + EQ
RBASE = BASE.replace("WITH ", "WITH RECURSIVE ", 1)
MATCH = """, hl AS (SELECT task_id, trajectory_id, rs, list(cs ORDER BY cs) AS hs FROM pr WHERE v LIKE 'y:%' GROUP BY 1, 2, 3),
rn AS (SELECT task_id, max(n_steps) AS m FROM lab WHERE trajectory_id % 10 = 0 GROUP BY 1),
rc AS (SELECT DISTINCT task_id, trajectory_id, n_steps AS n, passed, m FROM lab JOIN rn USING (task_id) WHERE trajectory_id % 10 <> 0),
f2 AS (SELECT trajectory_id, CAST(0 AS BIGINT) AS pos, [CAST(0 AS BIGINT)] AS mpos, [CAST(0 AS BIGINT)] AS used FROM rc
  UNION ALL
  SELECT trajectory_id, p, CASE WHEN pick IS NULL THEN mpos ELSE list_append(mpos, p) END,
    CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
  FROM (SELECT f2.trajectory_id, f2.pos + 1 AS p, mpos, used, list_filter(hs, lambda x: NOT list_contains(used, x))[1] AS pick
        FROM f2 JOIN rc USING (trajectory_id) LEFT JOIN hl ON hl.trajectory_id = f2.trajectory_id AND hl.rs = f2.pos + 1
        WHERE f2.pos + 1 < m)),
s2 AS (SELECT rc.*, mpos, used FROM f2 JOIN rc USING (trajectory_id) WHERE pos = m - 1),
f3 AS (SELECT trajectory_id, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS cur FROM rc
  UNION ALL
  SELECT trajectory_id, p, pick + 1 FROM (SELECT f3.trajectory_id, f3.pos + 1 AS p, list_filter(hs, lambda x: x >= cur)[1] AS pick
    FROM f3 JOIN hl ON hl.trajectory_id = f3.trajectory_id AND hl.rs = f3.pos + 1) WHERE pick IS NOT NULL),
s3 AS (SELECT trajectory_id, max(pos) + 1 AS sub FROM f3 GROUP BY 1),
f12 AS (SELECT trajectory_id, 1 AS i, [CAST(0 AS BIGINT)] AS al FROM rc
  UNION ALL
  SELECT trajectory_id, i + 1, list_append(al, pick) FROM (SELECT f12.trajectory_id, i, al,
      list_filter(hs, lambda x: x > al[-1])[1] AS pick
    FROM f12 JOIN s2 USING (trajectory_id) JOIN hl ON hl.trajectory_id = f12.trajectory_id AND hl.rs = mpos[i + 1])
  WHERE pick IS NOT NULL),
s12 AS (SELECT trajectory_id, arg_max(al, i) AS al FROM f12 GROUP BY 1),
tm AS (SELECT trajectory_id, max(CAST(v LIKE 'y:%' AS INTEGER)) = 1 AS terminal FROM pr JOIN rc USING (trajectory_id)
       WHERE rs = m - 1 AND cs = n - 1 GROUP BY 1),
rst AS (SELECT task_id, seq, upper(intent_stage[1]) AS x FROM lab WHERE trajectory_id % 10 = 0),
stg AS (SELECT s2.trajectory_id, x, count(*) AS tot, count_if(list_contains(mpos, seq)) AS got FROM s2 JOIN rst USING (task_id) GROUP BY 1, 2),
stm AS (SELECT trajectory_id, min(got * 100.0::DOUBLE / tot) AS bottleneck, CAST(count_if(got > 0) AS DOUBLE) / count(*) AS completeness,
    sum(got * w) / sum(tot * w) * 100 AS weighted, max(CASE WHEN x = 'V' THEN got * 100.0::DOUBLE / tot END) AS cov_v,
    max(CASE WHEN x = 'I' THEN got * 100.0::DOUBLE / tot END) AS cov_i
  FROM stg JOIN (VALUES ('I', 3.0::DOUBLE), ('V', 2.0), ('E', 1.0), ('O', 0.5)) w(x, w) USING (x) GROUP BY 1)"""
MBASE = RBASE + MATCH

add("equivalence_join", lambda s, d: lone_pairs(s, d).join(
    lone_ref(s, d).select("task_id", F.col("sig").alias("ref_sig"), F.col("seq").alias("ref_seq")), ["task_id", "ref_sig"]).join(
    lone_cand(s, d).select(*K, F.col("sig").alias("cand_sig"), "seq"), ["task_id", "cand_sig"]).groupBy(*K, "ref_seq").agg(
    F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")),
    BASE + " SELECT task_id, trajectory_id, rs AS ref_seq, count(*) AS n, min(cs) AS first_seq FROM pr WHERE v LIKE 'y:%' GROUP BY 1, 2, 3")


def _by_method(*methods):
    def fn(s, d):
        r = lone_ref(s, d).groupBy("task_id", F.col("sig").alias("ref_sig")).agg(F.count(F.lit(1)).alias("nr"))
        c = lone_cand(s, d).groupBy("task_id", F.col("sig").alias("cand_sig")).agg(F.count(F.lit(1)).alias("nc"))
        p = lone_pairs(s, d).where(F.col("method").isin(*methods))
        return p.join(r, ["task_id", "ref_sig"]).join(c, ["task_id", "cand_sig"]).groupBy("task_id", "method").agg(
            F.sum(F.col("nr") * F.col("nc")).alias("pairs"))
    names = ", ".join(q("y:" + m) for m in methods)
    return fn, BASE + f" SELECT task_id, substr(v, 3) AS method, count(*) AS pairs FROM pr WHERE v IN ({names}) GROUP BY 1, 2"


for _name, _methods in {"equivalence_exact": ("content_hash", "resulting_state", "exact_match"),
                        "equivalence_scope": ("scope_match", "scope_match_extracted"),
                        "equivalence_lines": ("line_overlap",), "equivalence_terminal": ("terminal_similarity",),
                        "equivalence_heuristic": ("heuristic",)}.items():
    add(_name, *_by_method(*_methods))
add("equivalence_stats", lambda s, d: Q.equivalence_stats(lone_ref(s, d), lone_cand(s, d), lone_pairs(s, d)).select(
    "task_id", "total_checks", "stage_rejections", "equivalent", "exact_matches"),
    BASE + " SELECT task_id, count(*) AS total_checks, count_if(v = 'n:stage_mismatch') AS stage_rejections, count_if(v LIKE 'y:%') AS equivalent, "
    "count_if(v IN ('y:content_hash', 'y:resulting_state', 'y:exact_match')) AS exact_matches FROM pr GROUP BY 1")


def _cmp(name):
    return F.col(f"c.{name}")


add("command_normaliser", lambda s, d: D.sig_steps(s, d).where("command <> ''").groupBy(
    _cmp("norm").alias("norm"), _cmp("cgroup").alias("cgroup"), _cmp("target").alias("target")).agg(F.count(F.lit(1)).alias("n")),
    BASE + " SELECT nc AS norm, cgrp AS cgroup, coalesce(tgt, '') AS target, count(*) AS n FROM ch WHERE command <> '' GROUP BY 1, 2, 3")
add("modified_files", lambda s, d: D.sig_steps(s, d).where("category = 'edit'").select(F.explode("c.files").alias("file")).groupBy(
    "file").agg(F.count(F.lit(1)).alias("n")), BASE + " SELECT file_path AS file, count(*) AS n FROM lab WHERE category = 'edit' GROUP BY 1")
add("signature_memo", lambda s, d: D.sig_steps(s, d).groupBy("task_id").agg(
    F.countDistinct("sig").alias("distinct_contents"), F.count(F.lit(1)).alias("steps")))


def _symbols(s, d):
    from runloom.functions import text as T
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    desc = F.concat(F.lit("In 'a.py': renamed function 'old_"), F.col("lang"), F.lit("' to 'new_"), (F.col("doc_id") % 7).cast("string"),
                    F.lit("'; added class 'C"), (F.col("doc_id") % 3).cast("string"), F.lit("'"))
    return docs.select("doc_id", F.array_join(T.symbols_from_description(desc), ",").alias("symbols"))


add("symbols_from_description", _symbols, """SELECT doc_id, array_to_string(list_sort(['old_' || lang, 'new_' || (doc_id % 7), 'C' || (doc_id % 3)]), ',')
  AS symbols FROM documents""")


def _jaccard(s, d):
    from runloom.functions import text as T
    docs = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    n = docs.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return docs.join(n, ["conv_id", "turn"]).select("conv_id", "turn", r6(T.word_jaccard(F.col("text"), F.col("next")), "jaccard"),
        r6(T.range_jaccard(F.col("turn"), F.col("turn") + 9, F.col("conv_id") % 12, F.col("conv_id") % 12 + 4), "range_jaccard"))


add("jaccard_helpers", _jaccard, """WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS a
    FROM conversations)
  SELECT x.conv_id, x.turn, round(CASE WHEN len(x.a) = 0 OR len(y.a) = 0 THEN 0 ELSE CAST(len(list_intersect(x.a, y.a)) AS DOUBLE)
    / len(list_distinct(list_concat(x.a, y.a))) END, 6) AS jaccard,
    round(greatest(0, least(x.turn + 9, x.conv_id % 12 + 4) - greatest(x.turn, x.conv_id % 12) + 1)
      / CAST(greatest(x.turn + 9, x.conv_id % 12 + 4) - least(x.turn, x.conv_id % 12) + 1 AS DOUBLE), 6) AS range_jaccard
  FROM w x JOIN w y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1""")

# --- matching --------------------------------------------------------------------------
_ints = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
add("set_coverage", lambda s, d: lone_metrics(s, d).select(*K, _ints("m.set_pos").alias("positions"), _ints("m.set_seq").alias("steps")),
    MBASE + " SELECT task_id, trajectory_id, array_to_string(mpos, ',') AS positions, array_to_string(used, ',') AS steps FROM s2")
add("subsequence_coverage", lambda s, d: lone_metrics(s, d).select(*K, F.col("ordered_matched").cast("long").alias("matched")),
    MBASE + " SELECT task_id, trajectory_id, sub AS matched FROM s3 JOIN rc USING (trajectory_id)")
add("alignment", lambda s, d: M.alignment(lone_metrics(s, d)).where("matched").select(*K, F.col("seq").cast("long"), F.col("ref_pos").cast("long")),
    MBASE + " SELECT task_id, trajectory_id, al[i] AS seq, mpos[i] AS ref_pos FROM (SELECT *, unnest(range(1, len(al) + 1)) AS i FROM s12 JOIN s2 USING (trajectory_id))")
add("missing_steps", lambda s, d: lone_metrics(s, d).select(*K, _ints("missing_steps").alias("missing"), F.col("divergence_index").cast("long")),
    MBASE + " SELECT task_id, trajectory_id, array_to_string(x, ',') AS missing, x[1] AS divergence_index FROM (SELECT *, "
    "list_filter(range(0, m), lambda p: NOT list_contains(mpos, p)) AS x FROM s2)")
add("terminal_match", lambda s, d: lone_metrics(s, d).select(*K, "terminal_match", "perfect_match"),
    MBASE + " SELECT task_id, trajectory_id, terminal AS terminal_match, len(mpos) = m AS perfect_match FROM s2 JOIN tm USING (trajectory_id)")
add("stage_coverage", lambda s, d: lone_metrics(s, d).select(*K, F.inline(F.array(*[F.struct(
    F.lit(x).alias("x"), F.col(f"total_{x}").alias("tot"), F.col(f"matched_{x}").alias("got")) for x in "EIVO"]))).where("tot > 0").select(
    *K, "x", F.col("tot").cast("long"), F.col("got").cast("long")),
    MBASE + " SELECT task_id, trajectory_id, x, tot, got FROM stg JOIN rc USING (trajectory_id)")
add("stage_scores", lambda s, d: lone_metrics(s, d).select(*K, *[r6(c, c) for c in ("stage_completeness", "weighted_score", "bottleneck_coverage")]),
    MBASE + " SELECT task_id, trajectory_id, round(completeness, 6) AS stage_completeness, round(weighted, 6) AS weighted_score, "
    "round(bottleneck, 6) AS bottleneck_coverage FROM stm JOIN rc USING (trajectory_id)")
PRF = """(SELECT *, len(mpos) * 100.0::DOUBLE / m AS recall, len(used) * 100.0::DOUBLE / n AS prec FROM s2)"""
add("precision_recall_f1", lambda s, d: lone_metrics(s, d).select(*K, *[r6(c, c) for c in ("coverage_percent", "precision_percent", "f1_score")]),
    MBASE + f" SELECT task_id, trajectory_id, round(recall, 6) AS coverage_percent, round(prec, 6) AS precision_percent, "
    f"round(2 * prec * recall / (prec + recall), 6) AS f1_score FROM {PRF}")
def lone_facts(s, d):
    """Facts of the graph that is one run: a chain, its last step the end."""
    st = lone_ref(s, d).select("task_id", F.col("seq").cast("int").alias("merged_id"), "intent_stage", "tool_used")
    n = F.lead("merged_id").over(Window.partitionBy("task_id").orderBy("merged_id"))
    e = st.select("task_id", F.col("merged_id").alias("src"), n.alias("dst"), F.col("merged_id").alias("edge_no")).where("dst IS NOT NULL")
    return staged(s, "lone_facts", d, lambda: G.path_facts(st, e))


add("required_tools", lambda s, d: G.required_tools(lone_facts(s, d)),
    BASE + " SELECT DISTINCT task_id, tool_used AS tool FROM lab WHERE trajectory_id % 10 = 0")
add("required_files", lambda s, d: M.required_files(lone_ref(s, d)),
    BASE + " SELECT DISTINCT task_id, file_path AS file FROM lab WHERE trajectory_id % 10 = 0 AND category = 'edit'")


def _cover_sql(item, cond, name):
    return BASE + f""", nd AS (SELECT DISTINCT task_id, {item} AS i FROM lab WHERE trajectory_id % 10 = 0 AND {cond}),
      rr AS (SELECT DISTINCT task_id, trajectory_id FROM lab WHERE trajectory_id % 10 <> 0),
      hv AS (SELECT DISTINCT task_id, trajectory_id, {item} AS i FROM lab WHERE {cond})
      SELECT task_id, trajectory_id, round(CAST(count(hv.i) AS DOUBLE) / count(*), 6) AS {name},
        coalesce(string_agg(CASE WHEN hv.i IS NULL THEN nd.i END, ',' ORDER BY nd.i), '') AS missing
      FROM rr JOIN nd USING (task_id) LEFT JOIN hv USING (task_id, trajectory_id, i) GROUP BY 1, 2"""


add("process_coverage", lambda s, d: M.process_coverage(lone_cand(s, d), G.required_tools(lone_facts(s, d))).select(
    *K, r6("process_coverage", "process_coverage"), F.col("missing_tools").alias("missing")), _cover_sql("tool_used", "TRUE", "process_coverage"))
add("file_coverage", lambda s, d: M.file_coverage(lone_cand(s, d), M.required_files(lone_ref(s, d))).select(
    *K, r6("file_coverage", "file_coverage"), F.col("missing_files").alias("missing")), _cover_sql("file_path", "category = 'edit'", "file_coverage"))
add("match_run_merged", lambda s, d: D.metrics(s, d).drop("best", "m", "missing_steps"))
add("match_run_canonical", lambda s, d: M.match_metrics(M.best_match(lone_hits(s, d), lone_refs(s, d), strategy="canonical"), M.run_features(lone_cand(s, d))).select(
    *K, F.col("best_path").cast("long"), r6("coverage_percent", "coverage_percent"), r6("weighted_score", "weighted_score"), "terminal_match"),
    MBASE + f" SELECT task_id, trajectory_id, CAST(0 AS BIGINT) AS best_path, round(recall, 6) AS coverage_percent, round(weighted, 6) AS weighted_score, terminal AS terminal_match "
    f"FROM {PRF} JOIN stm USING (trajectory_id) JOIN tm USING (trajectory_id)")
add("match_run_canonical_merged", lambda s, d: D.match_run(s, d, "canonical").select(
    *K, "best_path", "coverage_percent", "weighted_score", "terminal_match"))


def match_all_paths(s, d):
    """The best of all paths beside the best of the listed ones; ``n_paths`` counts all."""
    names = ("matched_count", "total_ref_states", "coverage_percent", "weighted_score")
    total = D.path_facts(s, d).where("fact = 'total'").select("task_id", F.col("n").alias("n_paths"))
    every = D.match_all_paths(s, d).select(*K, F.col("best.n_stages").alias("n_stages"), *names)
    some = D.metrics(s, d).select(*K, F.col("best.n_stages").alias("listed_stages"), *[F.col(c).alias(f"listed_{c}") for c in names])
    return every.join(some, K).join(total, "task_id")


add("match_all_paths", match_all_paths)
add("rank_paths", lambda s, d: M.path_counts(lone_hits(s, d), lone_refs(s, d), ["task_id"]).select(
    *K, F.posexplode("matched").alias("path", "matched")).select(*K, F.col("path").cast("long"), F.col("matched").cast("long")),
    MBASE + " SELECT task_id, trajectory_id, CAST(0 AS BIGINT) AS path, CAST(len(mpos) AS BIGINT) AS matched FROM s2")
add("rank_paths_merged", lambda s, d: M.path_counts(D.hits(s, d), D.reference_rows(s, d), ["task_id"]).select(
    *K, F.posexplode("matched").alias("path", "matched")))
add("batch_compare", lambda s, d: M.batch_compare(lone_hits(s, d), lone_refs(s, d)).select(
    *K, *[F.col(c).cast("long").alias(c) for c in ("path_id", "matched", "total")], "coverage_percent", "terminal_match", "perfect_match"),
    MBASE + " SELECT s2.task_id, trajectory_id, CAST(0 AS BIGINT) AS path_id, CAST(sub AS BIGINT) AS matched, CAST(s2.m AS BIGINT) AS total, "
    "round(sub * 100.0::DOUBLE / s2.m, 2) AS coverage_percent, terminal AS terminal_match, sub = s2.m AS perfect_match "
    "FROM s3 JOIN s2 USING (trajectory_id) JOIN tm USING (trajectory_id)")
add("batch_compare_merged", lambda s, d: M.batch_compare(D.hits(s, d), D.reference_rows(s, d)))
add("batch_compare_summary", lambda s, d: M.batch_compare(lone_hits(s, d), lone_refs(s, d)).groupBy("task_id").agg(
    r6(F.avg("coverage_percent"), "mean_coverage"), F.min("coverage_percent").alias("min_coverage"), F.max("coverage_percent").alias("max_coverage")),
    MBASE + " SELECT task_id, round(avg(c), 6) AS mean_coverage, min(c) AS min_coverage, max(c) AS max_coverage FROM "
    "(SELECT task_id, round(sub * 100.0::DOUBLE / m, 2) AS c FROM s3 JOIN rc USING (trajectory_id)) GROUP BY 1")


def individual_match(s, d):
    """Every candidate against each donor separately, averaged."""
    def build():
        st, dn = D.donor_steps(s, d), ["task_id", "donor_id"]
        ids = M.reference_ids(st)
        refs = M.reference_paths(st.withColumnRenamed("trajectory_id", "donor_id").withColumn("path_id", F.lit(0))
                                 .withColumn("pos", F.col("seq").cast("int")), ids, dn)
        h = M.candidate_hits(D.candidates(s, d), Q.equivalence_pairs(st, D.candidates(s, d)), ids)
        return M.match_metrics(M.best_match(h, refs, dn), M.run_features(D.candidates(s, d)), dn).drop("best", "m", "missing_steps")
    return staged(s, "individual", d, build)


add("individual_match", lambda s, d: individual_match(s, d).groupBy(*K).agg(
    F.count(F.lit(1)).alias("donors"), *[r6(F.avg(c), c) for c in ("coverage_percent", "weighted_score", "f1_score")],
    r6(F.avg(F.col("terminal_match").cast("double")), "terminal_ratio")))
add("comparison_lanes", lambda s, d: M.alignment(lone_metrics(s, d)).join(lone_path_states(s, d).select(
    "task_id", F.col("pos").alias("ref_pos"), F.col("tool_used").alias("ref_tool")), ["task_id", "ref_pos"], "left").join(
    lone_cand(s, d).select(*K, F.col("seq").cast("int").alias("seq"), F.col("tool_used").alias("cand_tool")), [*K, "seq"]).select(
    *K, F.col("seq").cast("long"), "matched", F.col("ref_pos").cast("long"), "ref_tool", "cand_tool"),
    MBASE + """ , aa AS (SELECT s12.trajectory_id, al[i] AS seq, mpos[i] AS ref_pos FROM (SELECT *, unnest(range(1, len(al) + 1)) AS i FROM s12 JOIN s2 USING (trajectory_id)) s12)
      SELECT c.task_id, c.trajectory_id, CAST(c.seq AS BIGINT) AS seq, ref_pos IS NOT NULL AS matched, CAST(ref_pos AS BIGINT) AS ref_pos, r.tool_used AS ref_tool, c.tool_used AS cand_tool
      FROM lab c LEFT JOIN aa ON aa.trajectory_id = c.trajectory_id AND aa.seq = c.seq
      LEFT JOIN (SELECT task_id, seq, tool_used FROM lab WHERE trajectory_id % 10 = 0) r ON r.task_id = c.task_id AND r.seq = ref_pos WHERE c.trajectory_id % 10 <> 0""")
add("consensus_overlay", lambda s, d: lone_metrics(s, d).select(*K, F.explode("m.set_pos").alias("pos")).join(
    lone_path_states(s, d).select("task_id", "pos"), ["task_id", "pos"]).groupBy("task_id", F.col("pos").cast("long").alias("pos")).agg(F.countDistinct("trajectory_id").alias("matched_by")),
    MBASE + " SELECT task_id, CAST(p AS BIGINT) AS pos, count(DISTINCT trajectory_id) AS matched_by FROM (SELECT task_id, trajectory_id, unnest(mpos) AS p FROM s2) GROUP BY 1, 2")
add("comparison_lanes_merged", lambda s, d: M.alignment(D.metrics(s, d)).join(
    D.metrics(s, d).select(*K, F.col("best_path").alias("path_id")), K).join(
    D.matched_path_states(s, d).select("task_id", "path_id", F.col("pos").alias("ref_pos"), "merged_id", F.col("tool_used").alias("ref_tool")),
    ["task_id", "path_id", "ref_pos"], "left").join(
    D.candidates(s, d).select(*K, F.col("seq").cast("int").alias("seq"), F.col("tool_used").alias("cand_tool")), [*K, "seq"]))
add("consensus_overlay_merged", lambda s, d: D.metrics(s, d).select(*K, F.col("best_path").alias("path_id"), F.explode("m.set_pos").alias("pos")).join(
    D.matched_path_states(s, d).select("task_id", "path_id", "pos", "merged_id"), ["task_id", "path_id", "pos"]).groupBy("task_id", "merged_id").agg(F.countDistinct("trajectory_id").alias("matched_by")))

# --- reference graphs -------------------------------------------------------------------
DONOR_SQL = """dn AS (SELECT task_id, trajectory_id, rk FROM (SELECT task_id, trajectory_id, row_number() OVER (PARTITION BY task_id
    ORDER BY md5('42:' || trajectory_id), trajectory_id) AS rk, count(*) OVER (PARTITION BY task_id) AS c
    FROM (SELECT DISTINCT CAST(user_id // 10 AS INTEGER) AS task_id, user_id AS trajectory_id FROM events WHERE user_id % 10 < 6))
  WHERE rk <= 3 AND c >= 3)"""
add("select_donors", lambda s, d: D.donors(s, d).select(*K, F.col("run_order").cast("long")),
    f"WITH {DONOR_SQL} SELECT task_id, trajectory_id, rk AS run_order FROM dn")
add("merge_runs", lambda s, d: D.mapping(s, d))


def fold_pairs(s, d):
    """The task's first run folded with each other run: one cell per run, every run's steps sent once."""
    lone = lone_cand(s, d).select(*K).distinct().withColumn("cell", F.col("trajectory_id"))
    first = lone_ref(s, d).select("task_id", F.col("trajectory_id").alias("_r")).distinct()
    grid = lone.join(first, "task_id").select("task_id", "cell", F.inline(F.array(
        F.struct(F.col("_r").alias("trajectory_id"), F.lit(1).alias("run_order")), F.struct("trajectory_id", F.lit(2).alias("run_order")))))
    return staged(s, "fold_pairs", d, lambda: G.merge_cells(D.sig_steps(s, d), grid, ["cell"]))


#: The same fold by recursion over the second run's steps; ``w`` is the cursor in the first run.
FOLD_SQL = RBASE + """, rn AS (SELECT task_id, max(n_steps) AS m FROM lab WHERE trajectory_id % 10 = 0 GROUP BY 1),
rc AS (SELECT DISTINCT task_id, trajectory_id, n_steps AS n, m FROM lab JOIN rn USING (task_id) WHERE trajectory_id % 10 <> 0),
yes AS (SELECT trajectory_id, rs, cs FROM pr WHERE v LIKE 'y:%'),
fold AS (SELECT task_id, trajectory_id, n, m, CAST(0 AS BIGINT) AS seq, CAST(1 AS BIGINT) AS w, CAST(0 AS BIGINT) AS added, CAST(1 AS BIGINT) AS merged_id,
    FALSE AS is_new, CAST(NULL AS BIGINT) AS b FROM rc
  UNION ALL
  SELECT task_id, trajectory_id, n, m, seq + 1, CASE WHEN hit THEN w + 1 ELSE w END, CASE WHEN hit THEN added ELSE added + 1 END,
    CASE WHEN hit THEN w + 1 ELSE m + added + 1 END, NOT hit, CASE WHEN NOT hit AND w < m THEN w + 1 ELSE b END
  FROM (SELECT fold.*, yes.rs IS NOT NULL AS hit FROM fold LEFT JOIN yes ON yes.trajectory_id = fold.trajectory_id AND yes.rs = fold.w AND yes.cs = fold.seq + 1
        WHERE fold.seq + 1 < n))"""
add("fold_pairs", lambda s, d: fold_pairs(s, d).where("run_order = 2").select(
    *K, "seq", F.col("merged_id").cast("long"), "is_new", F.col("branch_from").cast("long")),
    FOLD_SQL + " SELECT task_id, trajectory_id, seq, merged_id, is_new, CASE WHEN is_new THEN b END AS branch_from FROM fold")
add("fold_stats", lambda s, d: G.prefixes(fold_pairs(s, d), (1, 2), ["task_id", "cell"]).groupBy("k", "task_id", "cell").agg(
    F.count_if("is_new").alias("states_added"), F.count_if(~F.col("is_new")).alias("states_merged"),
    F.countDistinct(F.when(F.col("is_new"), F.col("branch_from"))).alias("branch_points")).select(
    F.col("k").cast("long"), "task_id", "cell", "states_added", "states_merged", "branch_points"),
    FOLD_SQL + """ SELECT CAST(1 AS BIGINT) AS k, task_id, trajectory_id AS cell, m AS states_added, CAST(0 AS BIGINT) AS states_merged, CAST(0 AS BIGINT) AS branch_points FROM rc
    UNION ALL SELECT 2, task_id, trajectory_id, CAST(max(m) + count_if(is_new) AS BIGINT), CAST(count_if(NOT is_new) AS BIGINT), count(DISTINCT CASE WHEN is_new THEN b END) FROM fold GROUP BY 2, 3""")
add("merge_stats", lambda s, d: G.merge_stats(D.donor_steps(s, d), D.mapping(s, d)).select(
    "task_id", F.col("traces_merged").cast("long"), (F.col("states_added") + F.col("states_merged")).alias("steps")),
    f"WITH {DONOR_SQL} SELECT task_id, CAST(3 AS BIGINT) AS traces_merged, count(*) AS steps FROM dn JOIN events ON user_id = trajectory_id GROUP BY 1")
add("consolidate_states", lambda s, d: D.ref_states(s, d).select("task_id", "merged_id", "step", "tool_used", "intent_stage", "trace_count"))
add("consolidate_legacy", lambda s, d: G.consolidation(D.raw_states(s, d), by_stage=False).groupBy("task_id").agg(
    F.count(F.lit(1)).alias("states"), F.countDistinct("canonical").alias("kept")))
add("clean_edges", lambda s, d: D.ref_edges(s, d))
add("branch_points", lambda s, d: G.remap_ids(G.remap_ids(G.branch_points(D.mapping(s, d)), D.remap(s, d), "branch"), D.remap(s, d), "alternative"))
add("real_terminals", lambda s, d: G.remap_ids(G.run_terminals(D.mapping(s, d)), D.remap(s, d)))
add("relabel", lambda s, d: D.ref_states(s, d).groupBy("task_id", "intent_stage").agg(F.count(F.lit(1)).alias("states")))


# A graph with known answers: the reference run as a chain, with an edge over the next state at every fifth one.
# All of these edges are apart, so a task with k of them has 2^k paths, and only the k states they pass by are optional.
def dag_states(s, d):
    return lone_ref(s, d).withColumn("merged_id", F.col("seq").cast("int")).withColumn("step", F.col("seq").cast("int"))


def dag_edges(s, d):
    n = lone_ref(s, d).select("task_id", F.col("seq").cast("int").alias("src"), F.col("n_steps").cast("int").alias("_n"))
    one = n.where("src + 1 < _n").select("task_id", "src", (F.col("src") + 1).alias("dst"), (F.col("src") * 2).alias("edge_no"))
    two = n.where("src % 5 = 0 AND src + 2 < _n").select("task_id", "src", (F.col("src") + 2).alias("dst"), (F.col("src") * 2 + 1).alias("edge_no"))
    return one.unionByName(two)


def dag_facts(s, d):
    return staged(s, "dag_facts", d, lambda: G.path_facts(dag_states(s, d), dag_edges(s, d)))


DAG = BASE + """, ch0 AS (SELECT task_id, seq, tool_used, intent_stage, n_steps AS m, seq % 5 = 1 AND seq + 1 < n_steps AS opt FROM lab WHERE trajectory_id % 10 = 0),
  kk AS (SELECT task_id, count_if(opt) AS k, max(m) AS m FROM ch0 GROUP BY 1)"""
add("path_totals", lambda s, d: dag_facts(s, d).where("fact = 'total'").select("task_id", F.col("n").cast("long").alias("n")),
    DAG + " SELECT task_id, CAST(2 ** k AS BIGINT) AS n FROM kk")
add("essential_states", lambda s, d: G.essential_states(dag_facts(s, d)), DAG + " SELECT task_id, CAST(seq AS INTEGER) AS merged_id FROM ch0 WHERE NOT opt")
add("required_tools_graph", lambda s, d: G.required_tools(dag_facts(s, d)),
    DAG + " SELECT task_id, tool_used AS tool FROM ch0 GROUP BY 1, 2 HAVING bool_or(NOT opt) OR count_if(opt) >= 2")
for _name, _keep in (("canonical_path", "TRUE"), ("longest_path", "TRUE"), ("shortest_path", "NOT opt")):
    add(_name, lambda s, d, f=_name.split("_")[0]: G.named_path(dag_facts(s, d), f).select("task_id", F.col("pos").cast("long"), F.col("merged_id").cast("long")),
        DAG + f" SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY seq) - 1 AS pos, CAST(seq AS BIGINT) AS merged_id FROM ch0 WHERE {_keep}")
add("terminal_states", lambda s, d: G.terminal_states(dag_states(s, d), dag_edges(s, d)).select("task_id", F.col("merged_id").cast("long")),
    DAG + " SELECT task_id, CAST(m - 1 AS BIGINT) AS merged_id FROM kk")
add("graph_stats", lambda s, d: G.graph_stats(dag_states(s, d), dag_edges(s, d)).select(
    "task_id", "states", "edges", "terminals", "branching", "merging"),
    DAG + " SELECT task_id, CAST(m AS BIGINT) AS states, CAST(m - 1 + k AS BIGINT) AS edges, CAST(1 AS BIGINT) AS terminals, k AS branching, k AS merging FROM kk")
add("bfs_layers", lambda s, d: G.bfs_layers(dag_states(s, d), dag_edges(s, d)).select("task_id", F.col("merged_id").cast("long"), F.col("layer").cast("long")),
    DAG + " SELECT task_id, CAST(seq AS BIGINT) AS merged_id, CAST(count_if(NOT opt) OVER (PARTITION BY task_id ORDER BY seq) - 1 + CAST(opt AS INTEGER) AS BIGINT) AS layer FROM ch0")
add("terminal_states_merged", lambda s, d: G.terminal_states(D.ref_states(s, d), D.ref_edges(s, d)))
add("graph_stats_merged", lambda s, d: G.graph_stats(D.ref_states(s, d), D.ref_edges(s, d)))
add("action_mix", lambda s, d: G.action_mix(D.ref_edges(s, d)))
add("bfs_layers_merged", lambda s, d: G.bfs_layers(D.ref_states(s, d), D.ref_edges(s, d)))
add("enumerate_paths", lambda s, d: D.ref_paths(s, d))
add("path_summary", lambda s, d: G.path_summary(D.path_states(s, d)))
add("path_facts_merged", lambda s, d: D.path_facts(s, d))

# --- reports ----------------------------------------------------------------------------
VERDICT = """CASE WHEN bottleneck = 0 AND completeness < 1 THEN CASE WHEN weighted >= 60 THEN CASE WHEN terminal THEN 'LIKELY PASS' ELSE 'UNCERTAIN' END
    WHEN weighted >= 40 THEN 'LIKELY FAIL' ELSE 'FAIL' END
  WHEN weighted >= 75 AND completeness >= 0.75 THEN 'PASS' WHEN weighted >= 60 AND completeness >= 0.5 THEN CASE WHEN terminal THEN 'LIKELY PASS' ELSE 'UNCERTAIN' END
  WHEN weighted < 30 OR completeness < 0.25 THEN 'FAIL' WHEN weighted < 50 THEN 'LIKELY FAIL' ELSE 'UNCERTAIN' END"""
add("verdict", lambda s, d: lone_reports(s, d).select(*K, "verdict", A.verdict_scored(
    F.col("weighted_score"), F.col("stage_completeness"), F.col("terminal_match")).alias("verdict_scored"), A.verdict_unlabelled(
    F.col("coverage_percent"), F.col("terminal_match"), F.lit(1.0), F.lit(0)).alias("verdict_unlabelled"), A.verdict_legacy(
    F.col("coverage_percent"), F.col("terminal_match"), F.lit(1.0), F.lit(0), F.lit(None).cast("boolean"), F.lit(0.0)).alias("verdict_legacy")),
    MBASE + f""" SELECT task_id, trajectory_id, {VERDICT} AS verdict, {VERDICT.replace('bottleneck = 0', 'FALSE')} AS verdict_scored,
    CASE WHEN recall >= 80 THEN 'PASS' WHEN recall >= 60 THEN CASE WHEN terminal THEN 'LIKELY PASS' ELSE 'UNCERTAIN' END
      WHEN recall >= 40 THEN 'UNCERTAIN' ELSE 'LIKELY FAIL' END AS verdict_unlabelled, verdict_unlabelled AS verdict_legacy
    FROM {PRF} JOIN stm USING (trajectory_id) JOIN tm USING (trajectory_id)""")
add("failure_reasons", lambda s, d: lone_reports(s, d).where("verdict NOT IN ('PASS', 'LIKELY PASS')").select(
    *K, F.array_join(F.transform("failure_reasons", lambda r: F.concat_ws(":", r["reason"], r["severity"])), ",").alias("reasons")),
    MBASE + f""" SELECT task_id, trajectory_id, array_to_string(list_concat(
      CASE WHEN dv < 0.4 THEN ['early_divergence:critical'] ELSE [] END, CASE WHEN cov_v < 25 THEN ['missing_verification:high'] ELSE [] END,
      CASE WHEN cov_i < 25 THEN ['incomplete_implementation:high'] WHEN cov_i < 50 THEN ['incomplete_implementation:medium'] ELSE [] END,
      CASE WHEN coalesce(dv >= 0.4, TRUE) AND coalesce(cov_v >= 25, TRUE) AND coalesce(cov_i >= 50, TRUE) AND recall < 30 THEN ['low_coverage:high'] ELSE [] END), ',') AS reasons
    FROM (SELECT *, list_filter(range(0, m), lambda p: NOT list_contains(mpos, p))[1] / CAST(m AS DOUBLE) AS dv, {VERDICT} AS verdict
      FROM {PRF} JOIN stm USING (trajectory_id) JOIN tm USING (trajectory_id)) WHERE verdict NOT IN ('PASS', 'LIKELY PASS')""")
add("quality_tier", lambda s, d: lone_reports(s, d).select(*K, "quality_tier"),
    MBASE + COHERENCE_CTE.replace("rc AS (SELECT trajectory_id", "rcn AS (SELECT trajectory_id").replace("JOIN rc USING", "JOIN rcn USING") +
    f""" SELECT task_id, trajectory_id, CASE WHEN verdict IN ('PASS', 'LIKELY PASS') THEN CASE WHEN recall >= 70 AND coherence >= 0.6 AND completeness >= 0.75 THEN 'ideal'
      WHEN recall >= 50 AND coherence >= 0.4 AND completeness >= 0.5 THEN 'solid' ELSE 'lucky' END WHEN recall >= 40 AND completeness >= 0.5 THEN 'partial_fail' ELSE 'off_track' END AS quality_tier
    FROM (SELECT *, {VERDICT} AS verdict FROM (SELECT * EXCLUDE (task_id) FROM {PRF}) JOIN stm USING (trajectory_id) JOIN tm USING (trajectory_id) JOIN coh USING (trajectory_id))""")
# One row per run with everything a report needs: coherence, similarity of the stage strings by dynamic
# programming, share of required tools, verdict, tier and scores.
REPORT = MBASE + COHERENCE_CTE.replace("rc AS (SELECT trajectory_id", "rcn AS (SELECT trajectory_id").replace("JOIN rc USING", "JOIN rcn USING") + f""",
  wfp AS (SELECT task_id, trajectory_id, list(upper(intent_stage[1]) ORDER BY seq) AS a FROM lab GROUP BY 1, 2),
  wpr AS (SELECT c.trajectory_id, c.a AS a, r.a AS b FROM wfp c JOIN wfp r ON c.task_id = r.task_id AND r.trajectory_id % 10 = 0 WHERE c.trajectory_id % 10 <> 0),
  wdp AS (SELECT trajectory_id, 0 AS i, list_transform(b, lambda x: 0) AS row FROM wpr
    UNION ALL
    SELECT wdp.trajectory_id, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda m:
      greatest(row[m], CASE WHEN a[i + 1] = b[m] THEN (CASE WHEN m > 1 THEN row[m - 1] ELSE 0 END) + 1 ELSE 0 END))))
    FROM wdp JOIN wpr USING (trajectory_id) WHERE i < len(a)),
  sim AS (SELECT trajectory_id, CAST(row[len(b)] AS DOUBLE) / greatest(len(a), len(b)) AS similarity FROM wdp JOIN wpr USING (trajectory_id) WHERE i = len(a)),
  need AS (SELECT DISTINCT task_id, tool_used AS t FROM lab WHERE trajectory_id % 10 = 0),
  have AS (SELECT DISTINCT task_id, trajectory_id, tool_used AS t FROM lab),
  tools AS (SELECT r.trajectory_id, CAST(count(have.t) AS DOUBLE) / count(*) AS process FROM (SELECT DISTINCT task_id, trajectory_id FROM lab WHERE trajectory_id % 10 <> 0) r
    JOIN need USING (task_id) LEFT JOIN have ON have.trajectory_id = r.trajectory_id AND have.t = need.t GROUP BY 1),
  cov AS (SELECT trajectory_id, max(CASE WHEN x = 'E' THEN got * 100.0::DOUBLE / tot END) AS cov_e, max(CASE WHEN x = 'O' THEN got * 100.0::DOUBLE / tot END) AS cov_o FROM stg GROUP BY 1),
  rp0 AS (SELECT *, CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0 END AS f1, trajectory_id % 10 < 6 AS passed, {VERDICT} AS verdict,
      list_filter(range(0, m), lambda p: NOT list_contains(mpos, p))[1] / CAST(m AS DOUBLE) AS dv
    FROM {PRF} JOIN stm USING (trajectory_id) JOIN tm USING (trajectory_id) JOIN (SELECT trajectory_id, CAST(coherence AS DOUBLE) AS coherence FROM coh) USING (trajectory_id)
    JOIN sim USING (trajectory_id) JOIN tools USING (trajectory_id) JOIN cov USING (trajectory_id)),
  rp1 AS (SELECT *, 0.25::DOUBLE * recall + 0.25::DOUBLE * (coherence * 100) + 0.18::DOUBLE * (completeness * 100) + 0.12::DOUBLE * (similarity * 100) + 0.10::DOUBLE * f1 AS raw,
      verdict IN ('PASS', 'LIKELY PASS') AS passing FROM rp0),
  rep AS (SELECT *, CAST(greatest(0, least(100, round_even(raw + 0.10::DOUBLE * CASE WHEN passed THEN 100 ELSE 0 END, 0))) AS INTEGER) AS score,
      CASE WHEN passing THEN CASE WHEN recall >= 70 AND coherence >= 0.6 AND completeness >= 0.75 THEN 'ideal' WHEN recall >= 50 AND coherence >= 0.4 AND completeness >= 0.5 THEN 'solid'
        ELSE 'lucky' END WHEN recall >= 40 AND completeness >= 0.5 THEN 'partial_fail' ELSE 'off_track' END AS tier,
      CASE WHEN passing THEN NULL WHEN dv < 0.4 THEN 'early_divergence' WHEN cov_v < 25 THEN 'missing_verification' WHEN cov_i < 50 THEN 'incomplete_implementation'
        WHEN coherence < 0.35 THEN 'trajectory_thrashing' WHEN recall < 30 THEN 'low_coverage' END AS reason FROM rp1)"""


def lone_scores(s, d):
    cov = M.process_coverage(lone_cand(s, d), G.required_tools(lone_facts(s, d))).select(*K, (F.col("process_coverage") * 100).alias("process"))
    j = lone_reports(s, d).join(cov, K)
    return j.select(*K, "quality_score", r6("process_score", "process_score"), *[r6(A.combined_score(
        F.col("coverage_percent"), F.col("process"), variant=v), f"combined_{v}") for v in ("merged", "mean")])


add("quality_score", lone_scores, REPORT + """ SELECT task_id, trajectory_id, score AS quality_score, round(raw / 0.90::DOUBLE, 6) AS process_score,
    round(0.7::DOUBLE * recall + 0.3::DOUBLE * (process * 100), 6) AS combined_merged, round((recall + process * 100) / 2, 6) AS combined_mean FROM rep""")
add("quality_score_merged", lambda s, d: D.reports(s, d).join(M.process_coverage(D.candidates(s, d), G.required_tools(D.path_facts(s, d))).select(
    *K, (F.col("process_coverage") * 100).alias("process")), K).select(*K, F.col("quality_score"), r6("process_score", "process_score"), *[r6(A.combined_score(
    F.col("coverage_percent"), F.col("process"), F.col("coherence_score"), F.col("temporal_profile_score"), v), f"combined_{v}") for v in ("weighted", "merged", "mean")]))
_METRICS = {"coverage_percent": "recall", "precision_percent": "prec", "f1_score": "f1", "weighted_score": "weighted", "stage_completeness": "completeness",
            "bottleneck_coverage": "bottleneck", "coherence_score": "coherence", "workflow_similarity": "similarity"}
add("match_run", lambda s, d: lone_metrics(s, d).select(*K, F.col("n_cand").cast("long").alias("n_cand"), F.col("matched_count").cast("long").alias("matched_count"),
    F.col("total_ref_states").cast("long").alias("total_ref_states"), *[r6(c, c) for c in _METRICS], "terminal_match", "perfect_match"),
    REPORT + " SELECT task_id, trajectory_id, CAST(n AS BIGINT) AS n_cand, CAST(len(mpos) AS BIGINT) AS matched_count, CAST(m AS BIGINT) AS total_ref_states, " +
    ", ".join(f"round({e}, 6) AS {c}" for c, e in _METRICS.items()) + ", terminal AS terminal_match, len(mpos) = m AS perfect_match FROM rep")
add("strengths", lambda s, d: lone_reports(s, d).select(*K, F.array_join("strengths", "; ").alias("strengths")),
    REPORT + " SELECT task_id, trajectory_id, array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {c} >= 80 THEN 'Strong {n} phase (' || CAST(round_even({c}, 0) AS INTEGER) || '% covered)' END" for c, n in (
            ("cov_e", "exploration"), ("cov_i", "implementation"), ("cov_v", "verification"), ("cov_o", "orchestration"))) +
    ", CASE WHEN coherence >= 0.7 THEN 'Clean forward progression (high coherence)' END, CASE WHEN terminal THEN 'Reached correct terminal state' END], "
    "lambda x: x IS NOT NULL), '; ') AS strengths FROM rep")
add("divergence_point", lambda s, d: A.divergence_point(lone_reports(s, d), M.closed_positions(lone_path_states(s, d)), lone_cand(s, d)),
    MBASE + """ SELECT task_id, trajectory_id, CAST(dv + 1 AS INTEGER) AS step, r.tool_used || CASE WHEN r.file_path <> '' THEN ' on ' || r.file_path ELSE '' END AS expected,
      coalesce(c.tool_used || CASE WHEN c.file_path <> '' THEN ' on ' || c.file_path ELSE '' END, '(no matching candidate step)') AS actual
    FROM (SELECT s2.*, list_filter(range(0, m), lambda p: NOT list_contains(mpos, p))[1] AS dv, list_filter(range(0, n), lambda p: NOT list_contains(al, p))[1] AS fr
          FROM s2 JOIN s12 USING (trajectory_id)) x JOIN (SELECT task_id, seq AS rseq, tool_used, file_path FROM lab WHERE trajectory_id % 10 = 0) r USING (task_id)
    LEFT JOIN (SELECT trajectory_id AS t, seq AS cseq, tool_used, file_path FROM lab) c ON c.t = x.trajectory_id AND c.cseq = x.fr WHERE r.rseq = dv""")
add("divergence_segments", lambda s, d: A.divergence_segments(lone_reports(s, d)).select(
    *K, F.col("start_step").cast("long"), F.col("end_step").cast("long"), F.col("candidate_steps").cast("long")),
    MBASE + """ , ms AS (SELECT s2.*, al, unnest(list_filter(range(0, m), lambda p: NOT list_contains(mpos, p))) AS p FROM s2 JOIN s12 USING (trajectory_id)),
      sg AS (SELECT task_id, trajectory_id, al, n, m, min(p) AS a, max(p) AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY trajectory_id ORDER BY p) AS g FROM ms)
        GROUP BY task_id, trajectory_id, al, n, m, g)
      SELECT task_id, trajectory_id, a + 1 AS start_step, b + 1 AS end_step, CAST(len(list_filter(range(CAST(floor(CAST(a AS DOUBLE) / m * n) AS BIGINT),
        least(CAST(floor(CAST(b + 1 AS DOUBLE) / m * n) AS BIGINT) + 1, n)), lambda x: NOT list_contains(al, x))) AS BIGINT) AS candidate_steps FROM sg""")
add("stage_comparison", lambda s, d: A.stage_comparison(lone_reports(s, d), lone_cand(s, d)).select(
    *K, "stage", F.col("expected").cast("long"), F.col("matched").cast("long"), F.col("missing").cast("long"), "extra", r6("effort_ratio", "effort_ratio")),
    MBASE + """ SELECT task_id, trajectory_id, stage, coalesce(tot, 0) AS expected, coalesce(got, 0) AS matched, coalesce(tot - got, 0) AS missing,
      coalesce(nn - na, 0) AS extra, round(CASE WHEN tot > 0 THEN CAST(coalesce(nn, 0) AS DOUBLE) / tot ELSE 0 END, 6) AS effort_ratio
    FROM (SELECT task_id, trajectory_id, unnest(['exploration', 'implementation', 'verification', 'orchestration']) AS stage FROM rc)
    LEFT JOIN (SELECT trajectory_id, CASE x WHEN 'E' THEN 'exploration' WHEN 'I' THEN 'implementation' WHEN 'V' THEN 'verification' ELSE 'orchestration' END AS stage, tot, got FROM stg)
      USING (trajectory_id, stage)
    LEFT JOIN (SELECT trajectory_id, intent_stage AS stage, count(*) AS nn, count_if(list_contains(al, seq)) AS na FROM lab JOIN s12 USING (trajectory_id) GROUP BY 1, 2)
      USING (trajectory_id, stage)""")
add("stage_order_match", lambda s, d: lone_reports(s, d).select(*K, "stage_order_match"), BASE + """
  , fo AS (SELECT task_id, trajectory_id, list(st ORDER BY f) AS o FROM (SELECT task_id, trajectory_id, intent_stage AS st, min(seq) AS f FROM lab
      WHERE intent_stage <> 'orchestration' GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT c.task_id, c.trajectory_id, len(list_filter(c.o, lambda x: NOT list_contains(r.o, x))) = 0
    AND list_sort(list_transform(c.o, lambda x: list_position(r.o, x))) = list_transform(c.o, lambda x: list_position(r.o, x)) AS stage_order_match
  FROM fo c JOIN fo r ON c.task_id = r.task_id AND r.trajectory_id % 10 = 0 WHERE c.trajectory_id % 10 <> 0""")


def _signals(s, d):
    effort = A.stage_comparison(D.reports(s, d), D.candidates(s, d)).where("stage = 'exploration'").select(*K, "effort_ratio")
    j = D.reports(s, d).join(D.waste_summary(s, d).select(*K, "wasted_steps_distinct"), K).join(effort, K)
    return j.select(*K, F.explode(A.quality_signals(F.col("effort_ratio"))).alias("q")).select(*K, "q.signal", "q.severity")


add("quality_signals", _signals)
add("quality_report", lambda s, d: lone_reports(s, d).select(*K, "verdict", "quality_tier", "quality_score", "revised_tier"),
    REPORT + """ SELECT task_id, trajectory_id, verdict, tier AS quality_tier, score AS quality_score, CASE WHEN passed THEN CASE WHEN score >= 70 THEN 'ideal'
      WHEN score < 47 THEN 'lucky' ELSE 'solid' END WHEN score >= 40 THEN 'partial_fail' ELSE 'off_track' END AS revised_tier FROM rep""")
add("quality_report_merged", lambda s, d: D.reports(s, d).select(*K, "verdict", "quality_tier", "quality_score", "revised_tier",
    F.to_json("failure_reasons").alias("failure_reasons"), F.to_json("strengths").alias("strengths"), "stage_order_match"))
RANK_SQL = """ SELECT task_id, trajectory_id, score AS quality_score, tier AS quality_tier, passing, coalesce(reason, '') AS top_reason,
    row_number() OVER (PARTITION BY task_id, passing ORDER BY score DESC, trajectory_id) AS rank"""
add("rank_in_cohort", lambda s, d: A.rank_in_cohort(lone_reports(s, d)), REPORT + RANK_SQL + " FROM rep")
add("rank_in_cohort_merged", lambda s, d: A.rank_in_cohort(D.reports(s, d)))
add("cohort_summary", lambda s, d: A.cohort_summary(lone_reports(s, d)), REPORT + " SELECT task_id, count(*) AS total, count_if(passing) AS passing_count, "
    "count_if(NOT passing) AS failing_count, " + ", ".join(f"count_if(tier = '{t}') AS {t}_count" for t in ("ideal", "solid", "lucky", "partial_fail", "off_track")) + " FROM rep GROUP BY 1")
add("failure_reason_counts", lambda s, d: A.reason_counts(lone_reports(s, d)), REPORT + " SELECT task_id, reason, count(*) AS n FROM rep WHERE reason IS NOT NULL GROUP BY 1, 2")
add("assess_batch", lambda s, d: A.rank_in_cohort(lone_reports(s, d)).join(lone_reports(s, d).select(*K, "verdict", r6("coverage_percent", "coverage_percent")), K),
    REPORT + RANK_SQL + ", verdict, round(recall, 6) AS coverage_percent FROM rep")
add("assess_batch_merged", lambda s, d: A.rank_in_cohort(D.reports(s, d)).join(D.reports(s, d).select(*K, "verdict", "coverage_percent"), K))

# --- waste --------------------------------------------------------------------------------
WASTE = MATCH + f""", cl AS (SELECT lab.*, s12.al, m, n, lag(intent_stage) OVER w AS pst FROM lab JOIN s12 USING (trajectory_id) JOIN rc USING (trajectory_id)
    WINDOW w AS (PARTITION BY trajectory_id ORDER BY seq)),
 isl AS (SELECT *, seq - row_number() OVER (PARTITION BY trajectory_id, tool_used, file_path, intent_stage ORDER BY seq) AS g FROM lab),
 lp AS (SELECT task_id, trajectory_id, tool_used, file_path, intent_stage, min(seq) AS a, count(*) AS c FROM isl GROUP BY 1, 2, 3, 4, 5, g HAVING count(*) >= 3),
 lo AS (SELECT * FROM lp c WHERE trajectory_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM lp r WHERE r.task_id = c.task_id AND r.trajectory_id % 10 = 0
     AND r.tool_used = c.tool_used AND r.file_path = c.file_path AND r.intent_stage = c.intent_stage)),
 rp AS (SELECT task_id, intent_stage AS b, lag(intent_stage) OVER (PARTITION BY task_id ORDER BY seq) AS a FROM lab WHERE trajectory_id % 10 = 0)"""
add("retry_loops", lambda s, d: W.retry_loops(lone_cand(s, d), lone_reports(s, d)),
    RBASE + WASTE + " SELECT task_id, trajectory_id, a + 1 AS start_step, a + c AS end_step, tool_used AS tool, file_path, c AS count FROM lo")
add("backtracks", lambda s, d: W.backtracks(lone_flags(s, d)),
    RBASE + WASTE + f" SELECT task_id, trajectory_id, seq + 1 AS step, intent_stage AS to_stage FROM cl WHERE pst IS NOT NULL AND {ttype('pst', 'intent_stage')} = 'backtrack' "
    "AND NOT EXISTS (SELECT 1 FROM rp WHERE rp.task_id = cl.task_id AND rp.a = cl.pst AND rp.b = cl.intent_stage)")
add("redundant_near_match", lambda s, d: lone_flags(s, d).where("is_redundant").select(*K, "seq"),
    RBASE + WASTE + " SELECT DISTINCT x.task_id, x.trajectory_id, x.seq FROM cl x JOIN cl y ON x.trajectory_id = y.trajectory_id AND y.seq BETWEEN x.seq - 3 AND x.seq + 3 "
    "AND x.tool_used = y.tool_used AND x.file_path = y.file_path WHERE NOT list_contains(x.al, x.seq) AND list_contains(y.al, y.seq)")
LATE = """ SELECT task_id, trajectory_id, seq FROM (SELECT cl.*, min(CASE WHEN intent_stage = 'implementation' THEN seq END) OVER (PARTITION BY trajectory_id) AS fi,
    least(CAST(floor(CAST(seq AS DOUBLE) / n * m) AS BIGINT), m - 1) AS pp FROM cl) x
  WHERE intent_stage = 'exploration' AND fi < seq AND NOT EXISTS (SELECT 1 FROM rst r WHERE r.task_id = x.task_id AND r.seq = pp AND r.x = 'E'
    AND EXISTS (SELECT 1 FROM rst i WHERE i.task_id = r.task_id AND i.x = 'I' AND i.seq < r.seq))"""
add("late_exploration", lambda s, d: lone_flags(s, d).where("is_late_exploration").select(*K, "seq"), RBASE + WASTE + LATE)
add("regression_loops", lambda s, d: W.regression_loops(lone_cand(s, d), lone_first(s, d)).groupBy(*K).agg(
    F.count(F.lit(1)).alias("loops"), F.sum("steps").alias("steps")), BASE + """
  , ip AS (SELECT *, max(CASE WHEN intent_stage = 'implementation' THEN seq END) OVER (PARTITION BY trajectory_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM lab),
  gp AS (SELECT task_id, trajectory_id, n_steps, x, min(CASE WHEN intent_stage = 'exploration' THEN seq END) AS e, min(CASE WHEN intent_stage = 'implementation' THEN seq END) AS y
    FROM ip WHERE x IS NOT NULL AND trajectory_id % 10 <> 0 GROUP BY 1, 2, 3, 4),
  rs AS (SELECT task_id, string_agg(upper(intent_stage[1]), '' ORDER BY seq) AS z FROM lab WHERE trajectory_id % 10 = 0 GROUP BY 1)
  SELECT task_id, trajectory_id, count(*) AS loops, CAST(sum(y - e) AS BIGINT) AS steps FROM gp JOIN rs USING (task_id) WHERE y - e >= 2
    AND NOT regexp_matches(substr(z, 1, CAST(floor(CAST(e AS DOUBLE) / n_steps * length(z)) AS BIGINT) + 1), 'EI[VO]*E$') GROUP BY 1, 2""")
add("redundant_reads", lambda s, d: W.redundant_reads(lone_cand(s, d), lone_first(s, d)), BASE + """
  , ep AS (SELECT *, coalesce(sum(CAST(intent_stage = 'implementation' AS BIGINT)) OVER (PARTITION BY trajectory_id ORDER BY seq), 0) AS ep FROM lab),
  mr AS (SELECT task_id, file_path FROM lab WHERE trajectory_id % 10 = 0 AND intent_stage = 'exploration' AND file_path <> '' GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT task_id, trajectory_id, CAST(sum(c - 1) AS BIGINT) AS redundant_step_count FROM (SELECT task_id, trajectory_id, ep, file_path, count(*) AS c FROM ep
      WHERE trajectory_id % 10 <> 0 AND intent_stage = 'exploration' AND file_path <> '' GROUP BY 1, 2, 3, 4) x
  WHERE c > 1 AND NOT EXISTS (SELECT 1 FROM mr WHERE mr.task_id = x.task_id AND mr.file_path = x.file_path) GROUP BY 1, 2""")
add("unnecessary_exploration", lambda s, d: W.unnecessary_exploration(lone_flags(s, d), lone_ref(s, d).where(
    "file_path <> ''").select("task_id", "file_path").distinct()), BASE + """ SELECT task_id, trajectory_id, count(*) AS unnecessary_exploration_count
  FROM (SELECT *, min(CASE WHEN intent_stage = 'implementation' THEN seq END) OVER (PARTITION BY trajectory_id) AS fi FROM lab) x WHERE trajectory_id % 10 <> 0
    AND intent_stage = 'exploration' AND fi < seq AND file_path <> '' AND NOT regexp_matches(lower(file_path), 'test|spec')
    AND NOT EXISTS (SELECT 1 FROM lab r WHERE r.task_id = x.task_id AND r.trajectory_id % 10 = 0 AND r.file_path = x.file_path) GROUP BY 1, 2""")
add("cyclic_patterns", lambda s, d: D.cycles(s, d))
add("wasted_steps", lambda s, d: D.wasted(s, d).where("waste IS NOT NULL").select(*K, "seq", "tool_used", "waste"))
add("token_waste", lambda s, d: W.waste_totals(D.wasted(s, d)).select(*K, "wasted_input_tokens", "wasted_output_tokens", "total_input_tokens", "total_output_tokens"))
add("waste_by_tool", lambda s, d: W.waste_by_tool(D.wasted(s, d)))
add("waste_summary", lambda s, d: D.waste_summary(s, d))
add("annotations", lambda s, d: D.annotations(s, d))
add("task_summary", lambda s, d: D.task_summary(s, d).select("task_id", "n_trajectories", "n_passing", "n_failing", "n_donors", "n_assessed"),
    f"""WITH {DONOR_SQL} SELECT CAST(user_id // 10 AS INTEGER) AS task_id, count(*) AS n_trajectories, count_if(user_id % 10 < 6) AS n_passing,
      count_if(user_id % 10 >= 6) AS n_failing, CASE WHEN count_if(user_id % 10 < 6) >= 3 THEN CAST(3 AS BIGINT) ELSE 0 END AS n_donors,
      CASE WHEN count_if(user_id % 10 < 6) >= 3 THEN count(*) - 3 ELSE 0 END AS n_assessed FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1""")


def compare_runs(s, d):
    """The first five non-reference runs of each task side by side; five is the feature's own limit."""
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("trajectory_id"))
    first = D.reports(s, d).select(*K).withColumn("_p", place).where(F.col("_p") <= 5).drop("_p")
    picked = D.reports(s, d).join(first, K, "left_semi")
    req_t, req_f = G.required_tools(D.path_facts(s, d)), M.required_files(D.ref_states(s, d))
    cand = D.candidates(s, d).join(picked.select(*K), K, "left_semi")
    return (picked.join(M.process_coverage(cand, req_t), K).join(M.file_coverage(cand, req_f), K)
            .join(D.waste_summary(s, d).select(*K, "wasted_steps_distinct", "regression_loop_count"), K)
            .select(*K, "quality_score", "verdict", "coverage_percent", "bottleneck_coverage", "bottleneck_stage", "process_coverage", "file_coverage",
                    F.least("wasted_steps_distinct", "n_cand").alias("wasted_steps"), "regression_loop_count"))


add("compare_runs", compare_runs)
