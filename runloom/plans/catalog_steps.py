"""Registered queries over single runs: normalisation, stages, features, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import commands as C
from runloom.functions import text as T
from runloom.functions.registry import registry_rows, same_group, tool_registry, tools_where, with_descriptor
from runloom.operators import features as X
from runloom.operators import normalize as N
from runloom.operators import profile as P
from runloom.plans.adapter import staged_steps
from runloom.plans.oracle_base import (CODE_CMD, EXPLORE_CMD, MODIFY_CMD, ORCH_CMD, SUMMARY_F, TEST_F,
                                       VERIFY_CMD, labelled, q, rx, steps, ttype)

K = ["task_id", "trajectory_id"]
QUERIES = {}


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


def r6(c, name):
    return F.round(c, 6).alias(name)


# --- normalisation ---------------------------------------------------------------------
add("normalized_steps", lambda s, d: staged_steps(s, d).select(
    *K, "seq", "n_steps", "model", "passed", "tool_used", "category", "file_path", "line_start",
    "line_end", "function_name", "resulting_state", "content_hash"),
    steps("SELECT task_id, trajectory_id, seq, n_steps, model, passed, tool_used, category, file_path, "
          "line_start, line_end, function_name, resulting_state, content_hash FROM st"))
add("resulting_state", lambda s, d: staged_steps(s, d).groupBy("resulting_state").agg(
    F.count(F.lit(1)).alias("n")), steps("SELECT resulting_state, count(*) AS n FROM st GROUP BY 1"))
add("observation_hash", lambda s, d: staged_steps(s, d).select(
    *K, "seq", T.short_hash(F.col("observation"), 16).alias("observation_hash"),
    T.short_hash(F.col("resulting_state"), 16).alias("resulting_state_hash")),
    steps("SELECT task_id, trajectory_id, seq, substr(md5(observation), 1, 16) AS observation_hash, "
          "substr(md5(resulting_state), 1, 16) AS resulting_state_hash FROM st"))
add("observation_text", lambda s, d: staged_steps(s, d).select(*K, "seq", "observation"),
    steps("SELECT task_id, trajectory_id, seq, observation FROM st"))
add("content_description", lambda s, d: staged_steps(s, d).select(
    *K, "seq", "content_description"),
    steps("SELECT task_id, trajectory_id, seq, content_description FROM st"))
add("content_hash", lambda s, d: staged_steps(s, d).where("content_hash <> ''").groupBy(
    "content_hash").agg(F.count(F.lit(1)).alias("n")),
    steps("SELECT content_hash, count(*) AS n FROM st WHERE content_hash <> '' GROUP BY 1"))
add("entry_signature", lambda s, d: staged_steps(s, d).groupBy(
    N.entry_signature().alias("signature")).agg(F.count(F.lit(1)).alias("n")),
    steps("""SELECT 'toolCall:' || tool_used || '({' || CASE
      WHEN tool_used IN ('read_file', 'replace_string_in_file') THEN '"filePath":"/workspace/'
        || CASE WHEN file_path = 'notes.md' THEN 'tmp/' ELSE '' END || file_path || '"'
      WHEN tool_used = 'grep_search' THEN '"query":"' || query || '"'
      WHEN tool_used = 'run_in_terminal' THEN '"command":"' || replace(command, '"', '\\"') || '"'
      ELSE '' END || '})' AS signature, count(*) AS n FROM st GROUP BY 1"""))
add("location_info", lambda s, d: staged_steps(s, d).select(
    *K, "seq", "file_path", "line_start", "line_end", "operation_type", "edit_type", "relative_position"),
    steps("""SELECT task_id, trajectory_id, seq, file_path, line_start, line_end,
      CASE tool_used WHEN 'read_file' THEN 'read' WHEN 'grep_search' THEN 'search' WHEN 'think' THEN 'other'
        WHEN 'run_in_terminal' THEN 'terminal' ELSE 'modify' END AS operation_type,
      CASE WHEN tool_used = 'apply_patch' THEN 'replace' WHEN tool_used <> 'replace_string_in_file' THEN ''
        WHEN length(new_s) > length(old_s) * 1.5 THEN 'expand' ELSE 'replace' END AS edit_type,
      CASE WHEN tool_used <> 'read_file' OR line_start IS NULL THEN ''
        WHEN (line_start + line_end) / 2.0 / (line_end * 1.5) <= 0.33 THEN 'early'
        WHEN (line_start + line_end) / 2.0 / (line_end * 1.5) <= 0.66 THEN 'middle' ELSE 'late' END
        AS relative_position FROM st"""))
add("edit_scope", lambda s, d: staged_steps(s, d).where("category = 'edit'").groupBy(
    "tool_used", "function_name", "class_name", "scope_path").agg(F.count(F.lit(1)).alias("n")),
    steps("SELECT tool_used, function_name, '' AS class_name, function_name AS scope_path, count(*) AS n "
          "FROM st WHERE category = 'edit' GROUP BY ALL"))
add("files_touched", lambda s, d: staged_steps(s, d).select(F.explode("files_touched").alias("file"))
    .groupBy("file").agg(F.count(F.lit(1)).alias("n")),
    steps("SELECT '/workspace/' || CASE WHEN file_path = 'notes.md' THEN 'tmp/' ELSE '' END || file_path AS file, "
          "count(*) AS n FROM st WHERE tool_used IN ('read_file', 'replace_string_in_file') GROUP BY 1"))
add("transitions", lambda s, d: N.transitions(staged_steps(s, d)),
    steps("SELECT task_id, trajectory_id, seq AS src, seq + 1 AS dst, "
          "lead(tool_used) OVER (PARTITION BY trajectory_id ORDER BY seq) AS action_type FROM st "
          "QUALIFY action_type IS NOT NULL"))
add("patch_hunks", lambda s, d: staged_steps(s, d).where("tool_used = 'apply_patch'").select(
    *K, "seq", F.posexplode(T.patch_hunks(F.col("patch_input"))).alias("hunk", "h")).select(
    *K, "seq", F.col("hunk").cast("long"), "h.file", "h.old_code", "h.new_code"),
    steps("SELECT task_id, trajectory_id, seq, CAST(0 AS BIGINT) AS hunk, '/workspace/' || CASE WHEN file_path = "
          "'notes.md' THEN 'tmp/' ELSE '' END || file_path AS file, 'def fn' || (k % 3) || '(x):' AS old_code, "
          "'def fn' || (k % 3) || '(y):' AS new_code FROM st WHERE tool_used = 'apply_patch'"))


def _paths(s, d):
    urls = s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    p = F.concat(F.lit("/workspace/tmp/"), F.regexp_replace("url", "^https?://", ""))
    t = F.concat(F.lit("/testbed/"), F.regexp_replace("url", "^https?://", ""))
    r = F.concat(F.lit("/home/u/repo/"), F.regexp_replace("url", "^https?://", ""))
    return urls.select("page_id", T.norm_path(p).alias("norm"), T.norm_path_testbed(t).alias("testbed"),
                       T.norm_match_path(p).alias("match"), T.norm_run_path(r).alias("run_path"))


_U = "regexp_replace(url, '^https?://', '')"
add("path_normalizers", _paths,
    f"SELECT page_id, lower({_U}) AS norm, '/' || {_U} AS testbed, lower('tmp/' || {_U}) AS match, "
    f"'/' || {_U} AS run_path FROM pages")


def _languages(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    name = F.concat(F.col("source"), F.when(F.col("doc_id") % 3 == 0, ".py")
                    .when(F.col("doc_id") % 3 == 1, ".GO").otherwise(""))
    name = F.when(F.col("doc_id") % 3 == 2, F.lit("noext")).otherwise(name)
    return docs.select("doc_id", T.language_of(name, F.col("text")).alias("language"))


add("code_language", _languages, """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'python' WHEN doc_id % 3 = 1 THEN 'go'
  WHEN contains(text, '#!/usr/bin/env python') OR contains(text, '#!/usr/bin/python') THEN 'python'
  WHEN contains(text, '#!/bin/bash') OR contains(text, '#!/usr/bin/env bash') THEN 'bash'
  WHEN contains(text, 'package main') AND contains(text, 'func ') THEN 'go'
  WHEN contains(text, 'fn main()') OR contains(text, 'impl ') THEN 'rust'
  WHEN contains(text, 'public class ') OR contains(text, 'public static void main') THEN 'java'
  WHEN contains(text, 'def ') AND contains(text, ':') THEN 'python'
  WHEN contains(text, 'function ') OR contains(text, 'const ') OR contains(text, '=>') THEN 'javascript'
  ELSE 'unknown' END AS language FROM documents""")


def _patch_check(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    diff = F.concat(F.lit("+++ a.py\n+"), F.regexp_replace("text", "\n", "\n+"),
                    F.when(F.col("doc_id") % 2 == 0, "\n-old").otherwise(""),
                    F.when(F.col("doc_id") % 3 == 0, "\n+\n+def f():").otherwise(""))
    return docs.select("doc_id", T.patch_check(diff).alias("p")).select(
        "doc_id", F.size("p.issues").cast("long").alias("n_issues"), r6(F.col("p.score"), "score"), "p.is_valid",
        F.col("p.additions").cast("long").alias("additions"), F.col("p.deletions").cast("long").alias("deletions"))


add("patch_heuristic_check", _patch_check, """WITH p AS (SELECT doc_id, '+++ a.py' || chr(10) || '+'
    || replace(text, chr(10), chr(10) || '+') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '-old' ELSE '' END
    || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '+' || chr(10) || '+def f():' ELSE '' END AS x FROM documents),
  l AS (SELECT *, string_split(x, chr(10)) AS ls, contains(x, chr(10) || '+' || chr(10) || '+def ') AS dup FROM p),
  c AS (SELECT doc_id, dup, len(list_filter(ls, lambda a: a LIKE '+%' AND a NOT LIKE '+++%')) AS adds,
        len(list_filter(ls, lambda a: a LIKE '-%' AND a NOT LIKE '---%')) AS dels FROM l),
  f AS (SELECT *, CAST(dup AS BIGINT) + CAST(adds > 0 AND dels = 0 AS BIGINT) AS n_issues FROM c)
  SELECT doc_id, n_issues, CAST(round(1.0 - CASE WHEN dup THEN 0.3 ELSE 0 END
    - CASE WHEN adds > 0 AND dels = 0 THEN 0.2 ELSE 0 END, 6) AS DOUBLE) AS score, n_issues = 0 AS is_valid,
    CAST(adds AS BIGINT) AS additions, CAST(dels AS BIGINT) AS deletions FROM f""")

_REG = "(VALUES " + ", ".join(
    "(" + ", ".join(("TRUE" if v else "FALSE") if isinstance(v, bool) else q(v) for v in row) + ")"
    for row in registry_rows()) + ") AS r(tool, category, stage_hint, equivalence_group, operation_type, " \
    "comparison_strategy, context_sensitive)"


def _lookup(s, d):
    ev = s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    name = F.when(F.col("event_type") == "view", "read_file").when(F.col("event_type") == "click", "mcp_pylance_x") \
        .when(F.col("event_type") == "error", "azure-monitor").when(F.col("event_type") == "signup", "azure-zzz") \
        .otherwise("unheard_of")
    return with_descriptor(ev.withColumn("tool_used", name)).groupBy(
        "tool_used", "category", "stage_hint", "equivalence_group", "comparison_strategy").agg(
        F.count(F.lit(1)).alias("n"))


add("tool_registry_lookup", _lookup, """SELECT tool_used, category, stage_hint, equivalence_group, comparison_strategy,
  count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'mcp_pylance_x'
    WHEN 'error' THEN 'azure-monitor' WHEN 'signup' THEN 'azure-zzz' ELSE 'unheard_of' END AS tool_used FROM events)
  JOIN (VALUES ('read_file', 'read', '', 'file_read', 'file_path'),
    ('mcp_pylance_x', 'search', 'exploration', '', 'identity'),
    ('azure-monitor', 'validation', 'verification', 'azure_mcp', 'identity'),
    ('azure-zzz', 'general', 'orchestration', '', 'identity'),
    ('unheard_of', 'general', 'orchestration', '', 'identity'))
    AS t(tool_used, category, stage_hint, equivalence_group, comparison_strategy) USING (tool_used) GROUP BY ALL""")


def _registry_queries(s, d):
    """Usage of registry selections by the steps: category, fixed stage, group, context."""
    reg, st = tool_registry(s), staged_steps(s, d).groupBy("tool_used").agg(F.count(F.lit(1)).alias("n"))
    picks = {"edit": tools_where(reg, category="edit"), "fixed_exploration": tools_where(reg, stage="exploration"),
             "group_file_edit": tools_where(reg, group="file_edit"),
             "context": tools_where(reg, context_sensitive=True)}
    out = None
    for name, tools in picks.items():
        part = st.join(tools, st.tool_used == tools.tool, "left_semi").agg(
            F.sum("n").alias("n")).withColumn("selection", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


add("tool_registry_queries", _registry_queries, steps("""SELECT selection, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT unnest(CASE WHEN category = 'edit' THEN ['edit', 'group_file_edit', 'context']
    WHEN category IN ('read', 'execute') THEN ['context'] WHEN category = 'search' THEN ['fixed_exploration'] ELSE [] END)
    AS selection, 1 AS n FROM st) GROUP BY 1"""))
add("same_group_test", lambda s, d: staged_steps(s, d).groupBy("tool_used", "equivalence_group").agg(
    F.count(F.lit(1)).alias("n")).alias("a").withColumn(
    "edits_like_patch", same_group(F.col("equivalence_group"), F.lit("file_edit"))),
    steps("""SELECT tool_used, CASE tool_used WHEN 'read_file' THEN 'file_read' WHEN 'grep_search' THEN 'search'
      WHEN 'think' THEN '' WHEN 'run_in_terminal' THEN 'terminal' ELSE 'file_edit' END AS equivalence_group,
      count(*) AS n, category = 'edit' AS edits_like_patch FROM st GROUP BY ALL"""))

# --- stages ----------------------------------------------------------------------------
add("file_kind", lambda s, d: staged_steps(s, d).where("file_path <> ''").groupBy("file_path").agg(
    F.count(F.lit(1)).alias("n")).select("file_path", "n", C.is_test_file(F.col("file_path")).alias("is_test"),
                                         C.is_summary_file(F.col("file_path")).alias("is_summary")),
    steps(f"SELECT file_path, count(*) AS n, {TEST_F} AS is_test, {SUMMARY_F} AS is_summary "
          "FROM st WHERE file_path <> '' GROUP BY file_path"))


def _commands(s, d):
    c = F.col("command")
    return staged_steps(s, d).where("command <> ''").groupBy("command").agg(F.count(F.lit(1)).alias("n")).select(
        "command", "n", C.is_test_command(c).alias("is_test"), C.is_orchestration_command(c).alias("is_orch"),
        C.is_verification_command(c).alias("is_verify"), C.is_modifying_command(c).alias("is_modify"),
        C.is_code_writing_command(c).alias("is_code"), C.is_exploration_command(c).alias("is_explore"),
        C.is_git_review_command(c).alias("is_review"))


add("command_kind", _commands, steps(
    f"SELECT command, count(*) AS n, {rx('command', C.TEST_COMMAND)} AS is_test, {ORCH_CMD} AS is_orch, "
    f"{VERIFY_CMD} AS is_verify, {MODIFY_CMD} AS is_modify, {CODE_CMD} AS is_code, {EXPLORE_CMD} AS is_explore, "
    f"{rx('command', C.GIT_REVIEW_COMMAND)} AS is_review FROM st WHERE command <> '' GROUP BY command"))
add("label_intent", lambda s, d: staged_steps(s, d).select(*K, "seq", "intent_stage"),
    labelled("SELECT task_id, trajectory_id, seq, intent_stage FROM lab"))
add("stage_summary", lambda s, d: X.stage_summary(staged_steps(s, d)), labelled("""
  SELECT task_id, trajectory_id, concat_ws(' ', CASE WHEN e > 0 THEN 'E:' || e END, CASE WHEN i > 0 THEN 'I:' || i END,
    CASE WHEN v > 0 THEN 'V:' || v END, CASE WHEN o > 0 THEN 'O:' || o END) AS summary FROM (
  SELECT task_id, trajectory_id, count_if(intent_stage = 'exploration') AS e, count_if(intent_stage = 'implementation') AS i,
    count_if(intent_stage = 'verification') AS v, count_if(intent_stage = 'orchestration') AS o FROM lab GROUP BY 1, 2)"""))
_TR = f""", tr AS (SELECT *, lag(intent_stage) OVER (PARTITION BY trajectory_id ORDER BY seq) AS prev FROM lab),
  tt AS (SELECT *, {ttype('prev', 'intent_stage')} AS tt FROM tr WHERE prev IS NOT NULL)"""


def with_transitions(body):
    return labelled("SELECT 1").replace("SELECT 1", "") .rstrip() + _TR + "\n" + body


add("stage_transitions", lambda s, d: X.stage_transitions(staged_steps(s, d)), with_transitions(
    "SELECT task_id, trajectory_id, seq, prev AS from_stage, intent_stage AS to_stage, tt AS transition FROM tt"))
add("fingerprint", lambda s, d: X.fingerprint(staged_steps(s, d)), labelled(
    "SELECT task_id, trajectory_id, string_agg(upper(intent_stage[1]), '→' ORDER BY seq) AS fingerprint "
    "FROM lab GROUP BY 1, 2"))
add("transition_counts", lambda s, d: X.transition_counts(staged_steps(s, d)), with_transitions(
    "SELECT task_id, trajectory_id, count_if(tt = 'deepen') AS deepen, count_if(tt = 'pivot') AS pivot, "
    "count_if(tt = 'backtrack') AS backtrack, count_if(tt = 'confirm') AS confirm FROM tt GROUP BY 1, 2"))
_RETRY = """, rg AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY seq) - row_number() OVER (
    PARTITION BY trajectory_id, tool_used, file_path, intent_stage ORDER BY seq) AS g FROM lab),
  rt AS (SELECT task_id, trajectory_id, tool_used, file_path, intent_stage, g, min(seq) AS s0, count(*) AS len
         FROM rg GROUP BY ALL),
  rc AS (SELECT trajectory_id, CAST(sum(greatest(len - 2, 0)) AS BIGINT) AS retries FROM rt GROUP BY 1)"""
add("blind_retries", lambda s, d: X.blind_retries(staged_steps(s, d)),
    labelled("SELECT 1").replace("SELECT 1", "").rstrip() + _RETRY +
    " SELECT task_id, trajectory_id, retries AS blind_retries FROM rc JOIN (SELECT DISTINCT task_id, trajectory_id FROM lab) USING (trajectory_id)")
COHERENCE_CTE = _TR + _RETRY + """, tcn AS (SELECT task_id, trajectory_id, count_if(tt = 'pivot') AS p,
    count_if(tt = 'confirm') AS c, count_if(tt = 'backtrack') AS b, count(tt) AS t FROM tt GROUP BY 1, 2),
  coh AS (SELECT r.task_id, r.trajectory_id, coalesce(p, 0) AS pivot, coalesce(c, 0) AS confirm,
    coalesce(b, 0) AS backtrack, coalesce(t, 0) AS transitions, retries AS blind_retries,
    CASE WHEN coalesce(t, 0) = 0 THEN 1.0 ELSE (CASE WHEN p + c + b = 0 THEN 1.0 ELSE CAST(p + c AS DOUBLE) / (p + c + b) END)
      * (1.0 - least(CAST(retries AS DOUBLE) / t, 1.0)) END AS coherence
    FROM (SELECT DISTINCT task_id, trajectory_id FROM lab) r JOIN rc USING (trajectory_id)
    LEFT JOIN tcn USING (trajectory_id))"""


def with_coherence(body):
    return labelled("SELECT 1").replace("SELECT 1", "").rstrip() + COHERENCE_CTE + "\n" + body


add("coherence", lambda s, d: X.coherence(staged_steps(s, d)).select(
    *K, "pivot", "confirm", "backtrack", "transitions", "blind_retries", r6(F.col("coherence_score"), "coherence")),
    with_coherence("SELECT task_id, trajectory_id, \"pivot\", confirm, backtrack, transitions, blind_retries, "
                   "round(CAST(coherence AS DOUBLE), 6) AS coherence FROM coh"))
_DIST = """SELECT task_id, trajectory_id, """ + ", ".join(
    f"count_if(intent_stage = '{st}') + 0.01::DOUBLE AS {x}" for st, x in
    (("exploration", "e"), ("implementation", "i"), ("verification", "v"), ("orchestration", "o"))) + \
    " FROM lab GROUP BY 1, 2"
add("stage_distribution", lambda s, d: X.stage_distribution(staged_steps(s, d)).select(
    *K, *[r6(F.col(f"p_{x}"), f"p_{x}") for x in X.LETTERS]),
    labelled("SELECT task_id, trajectory_id, " + ", ".join(
        f"round({x} / (e + i + v + o), 6) AS p_{x.upper()}" for x in "eivo") + f" FROM ({_DIST})"))


def _neighbours(table):
    """Pair each run with the first run of its task (its donor), one row per run."""
    first = table.where(F.col("trajectory_id") % 10 == 0)
    cols = [c for c in table.columns if c not in K]
    ref = first.select("task_id", *[F.col(c).alias(f"r_{c}") for c in cols])
    return table.select(*K, *[F.col(c).alias(f"c_{c}") for c in cols]).join(ref, "task_id")


def _jsd(s, d):
    pair = _neighbours(X.stage_distribution(staged_steps(s, d)))
    return pair.select(*K, r6(X.jsd([F.col(f"c_p_{x}") for x in X.LETTERS], [F.col(f"r_p_{x}") for x in X.LETTERS]), "jsd"))


def _kl(a, b):
    return "0.5 * (" + " + ".join(f"a.{x} / a.t * log2((a.{x} / a.t) / (0.5 * (a.{x} / a.t + b.{x} / b.t)))".replace("a.", f"{a}.").replace("b.", f"{b}.")
                                  for x in "eivo") + ")"


add("jsd", _jsd, labelled(f"SELECT c.task_id, c.trajectory_id, round({_kl('c', 'r')} + {_kl('r', 'c')}, 6) AS jsd FROM "
    f"(SELECT *, e + i + v + o AS t FROM ({_DIST})) c JOIN (SELECT *, e + i + v + o AS t FROM ({_DIST})) r "
    "ON c.task_id = r.task_id AND r.trajectory_id % 10 = 0"))


def _temporal(s, d):
    pair = _neighbours(X.segment_counts(staged_steps(s, d)))
    return pair.select(*K, r6(X.profile_score("c_", "r_"), "temporal_profile"))


_SEG = """SELECT task_id, trajectory_id, seg, """ + ", ".join(
    f"count_if(intent_stage = '{st}') + 0.01::DOUBLE AS {x}" for st, x in
    (("exploration", "e"), ("implementation", "i"), ("verification", "v"), ("orchestration", "o"))) + \
    """ FROM (SELECT *, least(seq // greatest(1, n_steps // 3), 2) AS seg FROM lab) GROUP BY 1, 2, 3"""
add("temporal_profile", _temporal, labelled(f""", sg AS (SELECT *, e + i + v + o AS t FROM (
      SELECT g.task_id, g.trajectory_id, g.seg, coalesce(e, 0.01) AS e, coalesce(i, 0.01) AS i, coalesce(v, 0.01) AS v,
        coalesce(o, 0.01) AS o FROM (SELECT DISTINCT task_id, trajectory_id, unnest([0, 1, 2]) AS seg FROM lab) g
      LEFT JOIN ({_SEG}) USING (task_id, trajectory_id, seg)))
  SELECT c.task_id, c.trajectory_id, round(greatest(0, 1 - sum({_kl('c', 'r')} + {_kl('r', 'c')}) / 3), 6) AS temporal_profile
  FROM sg c JOIN sg r ON c.task_id = r.task_id AND c.seg = r.seg AND r.trajectory_id % 10 = 0 GROUP BY 1, 2"""))


def _similarity(s, d):
    pair = _neighbours(X.fingerprint(staged_steps(s, d)))
    return pair.select(*K, r6(X.workflow_similarity(F.col("c_fingerprint"), F.col("r_fingerprint")), "similarity"))


# The check computes the common subsequence with the row-by-row recurrence.
add("workflow_similarity", _similarity, labelled("SELECT 1").replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT 1", "").rstrip() + """,
  fp AS (SELECT task_id, trajectory_id, list(upper(intent_stage[1]) ORDER BY seq) AS a FROM lab GROUP BY 1, 2),
  pr AS (SELECT c.task_id, c.trajectory_id, c.a AS a, r.a AS b FROM fp c JOIN fp r ON c.task_id = r.task_id AND r.trajectory_id % 10 = 0),
  dp AS (SELECT trajectory_id, 0 AS i, list_transform(b, lambda x: 0) AS row FROM pr
    UNION ALL
    SELECT dp.trajectory_id, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda m:
      greatest(row[m], CASE WHEN a[i + 1] = b[m] THEN (CASE WHEN m > 1 THEN row[m - 1] ELSE 0 END) + 1 ELSE 0 END))))
    FROM dp JOIN pr USING (trajectory_id) WHERE i < len(a))
  SELECT task_id, trajectory_id, round(CAST(row[len(b)] AS DOUBLE) / greatest(len(a), len(b)), 6) AS similarity
  FROM dp JOIN pr USING (trajectory_id) WHERE i = len(a)""")

# --- profiles --------------------------------------------------------------------------
add("stage_mix", lambda s, d: P.stage_mix(staged_steps(s, d)), labelled(
    "SELECT task_id, trajectory_id, intent_stage AS stage, count(*) AS n, round(count(*) * 100.0::DOUBLE / n_steps, 1) AS pct "
    "FROM lab GROUP BY 1, 2, 3, n_steps"))
add("tool_mix", lambda s, d: P.tool_mix(staged_steps(s, d)), steps(
    "SELECT task_id, trajectory_id, tool_used, count(*) AS n FROM st GROUP BY ALL"))
add("operation_mix", lambda s, d: P.operation_mix(staged_steps(s, d)), steps(
    "SELECT task_id, trajectory_id, CASE category WHEN 'read' THEN 'read' WHEN 'search' THEN 'search' WHEN 'edit' THEN "
    "'modify' WHEN 'execute' THEN 'terminal' ELSE 'other' END AS operation, count(*) AS n FROM st GROUP BY ALL"))
_FOOT = """SELECT task_id, trajectory_id, count(*) FILTER (WHERE t) AS files_touched, count(*) FILTER (WHERE m) AS files_modified,
  count(*) FILTER (WHERE r AND NOT m) AS files_read_only FROM (SELECT task_id, trajectory_id, file_path,
    bool_or(tool_used IN ('read_file', 'replace_string_in_file')) AS t, bool_or(category = 'edit') AS m,
    bool_or(category = 'read') AS r FROM st WHERE file_path <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2"""
add("file_footprint", lambda s, d: P.file_footprint(staged_steps(s, d)), steps(_FOOT))
add("exploration_ratio", lambda s, d: staged_steps(s, d).groupBy(*K).agg(P.exploration_ratio(
    F.count_if(F.col("intent_stage") == "exploration"), F.count_if(F.col("intent_stage") == "implementation"))
    .alias("exploration_ratio")), labelled(
    "SELECT task_id, trajectory_id, CASE WHEN i > 0 THEN round(CAST(e AS DOUBLE) / i, 2) ELSE CAST(e AS DOUBLE) END AS exploration_ratio "
    "FROM (SELECT task_id, trajectory_id, count_if(intent_stage = 'exploration') AS e, "
    "count_if(intent_stage = 'implementation') AS i FROM lab GROUP BY 1, 2)"))
_BAND = "CASE WHEN coherence >= 0.7 THEN 'Clean forward progression' WHEN coherence >= 0.4 THEN 'Some backtracking detected' ELSE 'Heavy thrashing' END"
add("coherence_band", lambda s, d: X.coherence(staged_steps(s, d)).groupBy(
    P.coherence_band(F.col("coherence_score")).alias("band")).agg(F.count(F.lit(1)).alias("n")),
    with_coherence(f"SELECT {_BAND} AS band, count(*) AS n FROM coh GROUP BY 1"))
add("completed", lambda s, d: P.completed(staged_steps(s, d)), steps(
    "SELECT DISTINCT task_id, trajectory_id, TRUE AS completed FROM st"))
add("cumulative_tokens", lambda s, d: P.cumulative_tokens(staged_steps(s, d)), steps(
    "SELECT task_id, trajectory_id, seq, CAST(sum(input_tokens) OVER (PARTITION BY trajectory_id ORDER BY seq) AS BIGINT) "
    "AS cumulative_tokens FROM st"))
add("step_latencies", lambda s, d: P.step_latencies(staged_steps(s, d)), steps(
    "SELECT task_id, trajectory_id, seq, latency_ms FROM st QUALIFY max(latency_ms) OVER (PARTITION BY trajectory_id) > 0"))


def event_counters(s, d):
    """Run counters of the event runs: waits, human inputs and compactions by rule."""
    st = staged_steps(s, d)
    lat = F.coalesce("latency_ms", F.lit(0))
    return st.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n_states"), (F.sum(lat) * 2).alias("wall_time_ms"), F.sum(lat).alias("thinking_ms"),
        F.sum(F.when(F.col("tool_used") == "run_in_terminal", lat).otherwise(0)).alias("wait_ms"),
        F.count_if(F.col("args_json") == '{"thought":"t0"}').alias("human_inputs"),
        F.count_if(F.col("args_json") == '{"thought":"t1"}').alias("compactions"),
        F.avg(F.when(lat > 0, lat)).alias("mean_latency"))


_CNT = """SELECT task_id, trajectory_id, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) * 2 AS wall, CAST(sum(latency_ms) AS BIGINT) AS think,
  CAST(coalesce(sum(latency_ms) FILTER (WHERE tool_used = 'run_in_terminal'), 0) AS BIGINT) AS wait,
  count_if(args_json = '{"thought":"t0"}') AS hi, count_if(args_json = '{"thought":"t1"}') AS comp,
  avg(latency_ms) FILTER (WHERE latency_ms > 0) AS ml FROM st GROUP BY 1, 2"""
add("time_decomposition", lambda s, d: event_counters(s, d).select(*K, *[c.alias(n) for n, c in P.time_decomposition(
    F.col("wall_time_ms"), F.col("thinking_ms"), F.col("wait_ms")).items()]), steps(
    f"SELECT task_id, trajectory_id, greatest(0, wall - think - wait) AS agent_work_ms, think AS thinking_ms, wait AS human_wait_ms FROM ({_CNT})"))
_HX = {"autonomy": "greatest(0.0, 1.0 - CAST(hi AS DOUBLE) / n)", "low_friction": "greatest(0.0, 1.0 - CAST(wait AS DOUBLE) / wall)",
       "responsiveness": "1.0 / (1.0 + exp((ml - 15000) / 5000))", "stability": "greatest(0.0, 1.0 - CAST(comp AS DOUBLE) * 0.2)"}
add("experience_score", lambda s, d: event_counters(s, d).select(*K, *[c.alias(n) for n, c in P.experience_score(
    F.col("human_inputs"), F.col("n_states"), F.col("wall_time_ms"), F.col("wait_ms"), F.col("mean_latency"),
    F.col("compactions")).items()]), steps(
    "SELECT task_id, trajectory_id, round(CAST(({autonomy}) * 0.30 + ({low_friction}) * 0.30 + ({responsiveness}) * 0.25 + ({stability}) * 0.15 AS DOUBLE) * 100, 1) "
    "AS experience_score, ".format(**_HX) + ", ".join(f"round(CAST({e} AS DOUBLE) * 100, 1) AS {n}" for n, e in _HX.items()) + f" FROM ({_CNT})"))
add("sequences", lambda s, d: X.tool_sequence(staged_steps(s, d)).join(X.fingerprint(staged_steps(s, d)), K), labelled(
    "SELECT task_id, trajectory_id, string_agg(tool_used, ',' ORDER BY seq) AS tool_sequence, "
    "string_agg(upper(intent_stage[1]), '→' ORDER BY seq) AS fingerprint FROM lab GROUP BY 1, 2"))
add("profile", lambda s, d: P.profile(staged_steps(s, d)), with_coherence(f"""
  SELECT b.*, f.* EXCLUDE (task_id, trajectory_id), round(CAST(coherence AS DOUBLE), 4) AS coherence, {_BAND} AS coherence_label
  FROM (SELECT task_id, trajectory_id, count(*) AS state_count, count(DISTINCT tool_used) AS tool_count,
      CASE WHEN count_if(intent_stage = 'implementation') > 0 THEN round(CAST(count_if(intent_stage = 'exploration') AS DOUBLE)
        / count_if(intent_stage = 'implementation'), 2) ELSE CAST(count_if(intent_stage = 'exploration') AS DOUBLE) END AS exploration_ratio,
      TRUE AS completed, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
      string_agg(upper(intent_stage[1]), '→' ORDER BY seq) AS fingerprint FROM lab GROUP BY 1, 2) b
  JOIN ({_FOOT}) f USING (trajectory_id) JOIN coh USING (trajectory_id)"""))
