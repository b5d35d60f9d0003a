"""Registered queries over log formats. Raw documents are derived row by row from the events
table, so parsing grows with it; the checks state the expected entries directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators.intent import label_intent
from runloom.operators.normalize import states_from_entries, with_initial_state
from runloom.operators.scan import spread
from runloom.plans import dataset as D
from runloom.plans.store import shared_root, staged
from runloom.sources import readers as R
from runloom.sources import sinks

K = ["task_id", "trajectory_id"]
QUERIES = {}


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


def _events(s, d):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return spread(s.read.parquet(f"{d}/events.parquet")).select(
        F.floor(F.col("user_id") / 10).cast("int").alias("task_id"), F.col("event_id").alias("trajectory_id"), k.alias("k"))


def _docs(s, d, template, *cols):
    """Fill @1, @2 ... of a JSON template with columns."""
    raw = F.lit(template)
    for i, c in enumerate(cols, 1):
        raw = F.replace(raw, F.lit(f"@{i}"), c.cast("string"))
    return _events(s, d).withColumn("raw", raw).withColumn("path", F.concat(F.lit("/runs/"), F.col("trajectory_id").cast("string"), F.lit("/main.json")))


CHAT = ('{"prompts":[{"logs":[{"id":"a","kind":"request","metadata":{"model":"m@1"},"response":{"message":"plan"}},'
        '{"id":"b","kind":"toolCall","tool":"read_file","args":{"filePath":"/workspace/src/f@1.py","startLine":@1,"endLine":99},"response":"text"},'
        '{"id":"c","kind":"request","metadata":{"model":"m@1"},"response":{"message":"go on"}}]},'
        '{"logs":[{"id":"d","kind":"toolCall","tool":"grep_search","args":"{\\"query\\":\\"q@1\\"}","response":"[]"},'
        '{"id":"e","kind":"toolCall","tool":"run_in_terminal","args":"not json","response":"x"},'
        '{"id":"f","kind":"request","metadata":{"model":"m@1"},"response":{"message":["all","done"]}}]}]}')
EV = "WITH ev AS (SELECT CAST(user_id // 10 AS INTEGER) AS task_id, event_id AS trajectory_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events) "


def chat_docs(s, d):
    return _docs(s, d, CHAT, F.col("k"))


add("read_chatlog", lambda s, d: R.parse_chatlog(chat_docs(s, d)).select(
    *K, "seq", "entry_index", "entry_id", "kind", "tool", "path_arg", "query", "start_line", "model", "response_message"),
    EV + """SELECT task_id, trajectory_id, CAST(seq AS BIGINT) AS seq, entry_index, entry_id, kind, tool, CASE WHEN entry_id = 'b' THEN '/workspace/src/f' || k || '.py' END AS path_arg,
      CASE WHEN entry_id = 'd' THEN 'q' || k END AS query, CASE WHEN entry_id = 'b' THEN k END AS start_line, CASE WHEN kind = 'request' THEN 'm' || k END AS model, response_message
    FROM ev, (VALUES (0, 0, 'a', 'request', NULL, 'plan'), (1, 1, 'b', 'toolCall', 'read_file', NULL), (2, 3, 'd', 'toolCall', 'grep_search', NULL),
      (3, 4, 'e', 'toolCall', 'run_in_terminal', NULL), (4, 5, 'f', 'request', NULL, 'all done')) v(seq, entry_index, entry_id, kind, tool, response_message)""")
add("read_chatlog_with_requests", lambda s, d: R.parse_chatlog(chat_docs(s, d), include_requests=True).groupBy("task_id", "kind").agg(F.count(F.lit(1)).alias("n")),
    EV + "SELECT task_id, kind, count(*) AS n FROM ev, (SELECT unnest(['request', 'request', 'request', 'toolCall', 'toolCall', 'toolCall']) AS kind) GROUP BY 1, 2")


def _chat_states(s, d):
    st = label_intent(states_from_entries(R.parse_chatlog(chat_docs(s, d))))
    return with_initial_state(st)


add("chatlog_states", lambda s, d: _chat_states(s, d).select(*K, "seq", "n_steps", "resulting_state", "intent_stage"),
    EV + """SELECT task_id, trajectory_id, CAST(seq AS BIGINT) AS seq, CAST(6 AS BIGINT) AS n_steps, replace(r, '@', CAST(k AS VARCHAR)) AS resulting_state, x AS intent_stage FROM ev,
      (VALUES (0, 'initial', ''), (1, 'llm_response:planning', 'orchestration'), (2, 'file_read:src/f@.py', 'exploration'), (3, 'grep_search:no_matches', 'exploration'),
       (4, 'terminal:unknown', 'exploration'), (5, 'llm_response:confirmed:terminal:unknown', 'orchestration')) v(seq, r, x)""")

ACTIONS = ('[{"id":0,"action":"message","args":{"content":"fix bug @1"}},'
           '{"id":1,"action":"read","args":{"path":"/testbed/src/f@1.py","start":0,"end":-1,"view_range":[3,@2]}},'
           '{"id":2,"cause":1,"observation":"read","content":"old"},{"id":3,"cause":1,"observation":"read","content":"text @1"},'
           '{"id":4,"action":"edit","args":{"command":"str_replace","path":"/testbed/src/f@1.py","old_str":"a","new_str":"b","thought":null},'
           '"tool_call_metadata":{"model_response":{"model":"m1","usage":{"prompt_tokens":@1,"completion_tokens":7,"prompt_tokens_details":{"cached_tokens":3}},'
           '"choices":[{"message":{"content":"why"}}]}}},'
           '{"id":5,"cause":4,"observation":"edit","content":"diff","message":"done"},'
           '{"id":6,"action":"read","args":{"path":"/testbed"}},{"id":7,"cause":6,"observation":"read","content":"Here\'s the files and directories up to"},'
           '{"id":8,"action":"condensation","args":{}},{"id":9,"action":"dance","args":{}},{"id":10,"action":"run","args":{"command":"ls @1"}},{"id":11,"action":"finish","args":{}}]')


def action_docs(s, d):
    return _docs(s, d, ACTIONS, F.col("k"), F.col("k") + 5)


add("read_openhands", lambda s, d: R.parse_actionlog(action_docs(s, d)).select(
    *K, "seq", "entry_id", "tool", "path_arg", "command", "start_line", "end_line", "response"),
    EV + """SELECT task_id, trajectory_id, CAST(seq AS BIGINT) AS seq, entry_id, tool, replace(p, '@', CAST(k AS VARCHAR)) AS path_arg, replace(c, '@', CAST(k AS VARCHAR)) AS command,
      CASE WHEN seq = 0 THEN 3 END AS start_line, CASE WHEN seq = 0 THEN k + 5 END AS end_line, replace(r, '@', CAST(k AS VARCHAR)) AS response FROM ev,
      (VALUES (0, '1', 'read_file', '/src/f@.py', NULL, 'text @'), (1, '4', 'replace_string_in_file', '/src/f@.py', NULL, 'The file was edited successfully. diff'),
       (2, '6', 'list_dir', '/', NULL, 'Here''s the files and directories up to'), (3, '10', 'run_in_terminal', NULL, 'ls @', NULL)) v(seq, entry_id, tool, p, c, r)""")
add("usage_metadata", lambda s, d: R.parse_actionlog(action_docs(s, d)).where("tool = 'replace_string_in_file'").select(
    *K, "model", "thought", "input_tokens", "output_tokens", "cached_input_tokens"),
    EV + "SELECT task_id, trajectory_id, 'm1' AS model, 'why' AS thought, CAST(k AS BIGINT) AS input_tokens, CAST(7 AS BIGINT) AS output_tokens, CAST(3 AS BIGINT) AS cached_input_tokens FROM ev")
add("actionlog_counters", lambda s, d: R.actionlog_counters(action_docs(s, d)),
    EV + "SELECT task_id, trajectory_id, CAST(1 AS BIGINT) AS compactions, CAST(1 AS BIGINT) AS skipped, 'fix bug ' || k AS task_description FROM ev")


def _tools(s, d):
    ev = _events(s, d)
    act = F.when(F.col("k") % 4 == 0, "read").when(F.col("k") % 4 == 1, "edit").when(F.col("k") % 4 == 2, "finish").otherwise("dance")
    sub = F.when(F.col("k") % 3 == 0, "create").otherwise("str_replace")
    text = F.when(F.col("k") % 8 == 0, "Here's the files and directories").otherwise("x")
    return ev.select(F.coalesce(R.action_tool(act, sub, text), F.lit("unknown")).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


add("canonical_tool", _tools, EV + """SELECT CASE WHEN k % 8 = 0 THEN 'list_dir' WHEN k % 4 = 0 THEN 'read_file' WHEN k % 4 = 1 THEN CASE WHEN k % 3 = 0 THEN 'create_file' ELSE 'replace_string_in_file' END
  WHEN k % 4 = 2 THEN '' ELSE 'unknown' END AS tool, count(*) AS n FROM ev GROUP BY 1""")

STEPS = ('{"schema_version":"ATIF-v1.6","agent":{"name":"cli","version":"1","model_name":"m2"},"extra":{"scenario":"s@1"},'
         '"final_metrics":{"total_prompt_tokens":@1,"total_completion_tokens":5,"total_cost_usd":0.5,"extra":{"wall_time_ms":1000,"active_time_ms":600,"permission_wait_ms":100}},'
         '"steps":[{"step_id":1,"source":"user","message":"hi"},{"step_id":2,"source":"agent","message":"thinking"},'
         '{"step_id":3,"source":"agent","tool_calls":[{"tool_call_id":"t1","function_name":"Read","arguments":{"file_path":"/srv/app/proj/src/f@1.py","offset":10,"limit":5}},'
         '{"tool_call_id":"t2","function_name":"Bash","arguments":{"command":"ls","cwd":"/srv/app/proj"}},{"tool_call_id":"t3","function_name":"web_search","arguments":{"query":"z"}}],'
         '"observation":{"results":[{"source_call_id":"t1","content":"{\\"detailedContent\\":\\"inner @1\\"}"},{"source_call_id":"t2","content":"plain"}]},'
         '"metrics":{"prompt_tokens":@1,"completion_tokens":2,"extra":{"latency_ms":40}}},'
         '{"step_id":4,"source":"agent","extra":{"compaction_event":{"a":1}}},'
         '{"step_id":5,"source":"agent","tool_calls":[{"tool_call_id":"t4","function_name":"Task","arguments":{"prompt":"p"}}],'
         '"observation":{"results":[{"source_call_id":"t4","content":"ok","subagent_trajectory_ref":[{"trajectory_path":"child.json"}]}]}},'
         '{"step_id":6,"source":"agent","tool_calls":[{"tool_call_id":"t5","function_name":"Edit","arguments":{"file_path":"/srv/app/proj/src/f@1.py","old_string":"a","new_string":"b"}}],'
         '"observation":{"results":[{"source_call_id":"t5","content":"File has been changed"}]}}]}')
CHILD = ('{"schema_version":"ATIF-v1.6","agent":{"name":"sub","model_name":"m3"},"extra":{"failed":@2},"steps":[{"step_id":1,"source":"agent","message":"skip me"},'
         '{"step_id":2,"source":"agent","tool_calls":[{"tool_call_id":"c1","function_name":"Grep","arguments":{"pattern":"w@1"}},'
         '{"tool_call_id":"c2","function_name":"Task","arguments":{"prompt":"p"}}],"observation":{"results":[{"source_call_id":"c1","content":"hit"}]}}]}')


def step_docs(s, d):
    return _docs(s, d, STEPS, F.col("k"))


def child_docs(s, d):
    docs = _docs(s, d, CHILD, F.col("k"), F.when(F.col("k") % 5 == 0, "true").otherwise("false"))
    return docs.select(F.replace("path", F.lit("main.json"), F.lit("child.json")).alias("path"), "raw")


_ATIF = """(VALUES (0, 'request', NULL, NULL, NULL, NULL, NULL, 'm2', 0, 0), (1, 'toolCall', 'read_file', '/src/f@.py', NULL, NULL, 'inner @', 'm2', 1, 40),
  (2, 'toolCall', 'run_in_terminal', NULL, 'ls', NULL, 'plain', 'm2', 1, 40), (3, 'child', 'grep_search', NULL, NULL, 'w@', 'hit', 'm3', 0, 0),
  (4, 'toolCall', 'replace_string_in_file', '/src/f@.py', NULL, NULL, 'The file was edited successfully. File has been changed', 'm2', 0, 0))
  v(o, kind, tool, p, c, q, r, model, tk, lat)"""
_ATIF_COLS = """tool, replace(p, '@', CAST(k AS VARCHAR)) AS path_arg, c AS command, replace(q, '@', CAST(k AS VARCHAR)) AS query, replace(r, '@', CAST(k AS VARCHAR)) AS response,
  model, CAST(tk * k AS BIGINT) AS input_tokens, CAST(lat AS BIGINT) AS latency_ms"""
_SEL = [*K, "seq", "kind", "tool", "path_arg", "command", "query", "response", "model", "input_tokens", "latency_ms"]
add("read_atif", lambda s, d: R.parse_steplog(step_docs(s, d)).select(*_SEL),
    EV + f"SELECT task_id, trajectory_id, CAST(CASE WHEN o = 4 THEN 3 ELSE o END AS BIGINT) AS seq, kind, {_ATIF_COLS} FROM ev, {_ATIF} WHERE kind <> 'child'")
add("inline_subagents", lambda s, d: R.parse_steplog(step_docs(s, d), child_docs(s, d)).select(*_SEL),
    EV + f"SELECT task_id, trajectory_id, CAST(CASE WHEN o = 4 AND k % 5 = 0 THEN 3 ELSE o END AS BIGINT) AS seq, CASE WHEN kind = 'child' THEN 'toolCall' ELSE kind END AS kind, {_ATIF_COLS} "
    f"FROM ev, {_ATIF} WHERE kind <> 'child' OR k % 5 <> 0")
add("canonical_args", lambda s, d: R.parse_steplog(step_docs(s, d)).where("tool = 'read_file'").select(*K, "start_line", "end_line"),
    EV + "SELECT task_id, trajectory_id, 10 AS start_line, 14 AS end_line FROM ev")
add("run_counters", lambda s, d: R.steplog_counters(step_docs(s, d)).select(
    *K, "scenario", "human_inputs", "delegations", "compactions", "skipped_tools", "wall_time_ms", "total_prompt_tokens", "total_cost_usd"),
    EV + "SELECT task_id, trajectory_id, 's' || k AS scenario, CAST(1 AS BIGINT) AS human_inputs, CAST(1 AS BIGINT) AS delegations, CAST(1 AS BIGINT) AS compactions, CAST(1 AS BIGINT) AS skipped_tools, "
    "CAST(1000 AS BIGINT) AS wall_time_ms, CAST(k AS BIGINT) AS total_prompt_tokens, CAST(0.5 AS DOUBLE) AS total_cost_usd FROM ev")
ROOTS = ('{"schema_version":"ATIF-v1.6","agent":{},"steps":[{"source":"agent","tool_calls":[{"tool_call_id":"a","function_name":"Read","arguments":{"path":"@1/Data/Work/p@2/src/x.py"}},'
         '{"tool_call_id":"b","function_name":"Read","arguments":{"path":"/data/work/p@2/lib/y.py"}},{"tool_call_id":"c","function_name":"Read","arguments":{"path":"/.cache/z.py"}}]}]}')
add("workspace_root", lambda s, d: R.workspace_root(R._calls(_docs(s, d, ROOTS, F.when(F.col("k") % 3 == 0, "/repo").otherwise(""), F.col("k")))),
    EV + "SELECT task_id, trajectory_id, CASE WHEN k % 3 <> 0 THEN 'data/work/p' || k || '/' END AS root FROM ev")
TRACE = ('{"initial_state":"s0","states":{"s0":{"step":0,"resulting_state":"initial","files_touched":[]},"s1":{"step":@1,"tool_used":"read_file","file_path":"f@1.py","line_range":[1,@1],'
         '"phase":"exploration","log_entry":{"kind":"toolCall","args":{"command":"ls"}},"metadata":{"input_tokens":@1}}},'
         '"transitions":[{"transition_id":"t0","from_state":"s0","to_state":"s1","action_type":"read_file","step":1}]}')
add("read_saved_trace", lambda s, d: R.parse_saved_trace(_docs(s, d, TRACE, F.col("k")))["states"].select(
    *K, "state_id", "is_initial", "step", "tool_used", "file_path", "line_end", "intent_stage", "command", "input_tokens"),
    EV + """SELECT task_id, trajectory_id, sid AS state_id, sid = 's0' AS is_initial, CASE WHEN sid = 's0' THEN 0 ELSE k END AS step, CASE WHEN sid = 's1' THEN 'read_file' END AS tool_used,
      CASE WHEN sid = 's1' THEN 'f' || k || '.py' END AS file_path, CASE WHEN sid = 's1' THEN k END AS line_end, CASE WHEN sid = 's1' THEN 'exploration' ELSE '' END AS intent_stage,
      CASE WHEN sid = 's1' THEN 'ls' END AS command, CASE WHEN sid = 's1' THEN CAST(k AS BIGINT) END AS input_tokens FROM ev, (SELECT unnest(['s0', 's1']) AS sid)""")


def mixed_docs(s, d):
    out = None
    for i, (t, cols) in enumerate(((CHAT, [F.col("k")]), (ACTIONS, [F.col("k"), F.col("k") + 5]), (STEPS, [F.col("k")]), (TRACE, [F.col("k")]))):
        part = _docs(s, d, t, *cols).where(F.col("trajectory_id") % 4 == i)
        out = part if out is None else out.unionByName(part)
    return out


add("detect_format", lambda s, d: mixed_docs(s, d).groupBy(R.detect_format(F.col("raw")).alias("format")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE event_id % 4 WHEN 0 THEN 'chatlog' WHEN 1 THEN 'openhands' WHEN 2 THEN 'atif' ELSE 'trace' END AS format, count(*) AS n FROM events GROUP BY 1")
add("load_any", lambda s, d: R.load_any(mixed_docs(s, d)).groupBy("source_format", "tool").agg(F.count(F.lit(1)).alias("n")),
    """SELECT source_format, tool, count(*) AS n FROM events JOIN (VALUES (0, 'chatlog', NULL), (0, 'chatlog', NULL), (0, 'chatlog', 'read_file'), (0, 'chatlog', 'grep_search'), (0, 'chatlog', 'run_in_terminal'),
      (1, 'openhands', 'read_file'), (1, 'openhands', 'replace_string_in_file'), (1, 'openhands', 'list_dir'), (1, 'openhands', 'run_in_terminal'),
      (2, 'atif', NULL), (2, 'atif', 'read_file'), (2, 'atif', 'run_in_terminal'), (2, 'atif', 'replace_string_in_file'),
      (3, 'trace', 'read_file')) v(m, source_format, tool) ON event_id % 4 = m GROUP BY 1, 2""")


def broken_docs(s, d):
    """The mixed documents with every seventh one cut short and every eleventh one emptied."""
    k = F.col("trajectory_id")
    return mixed_docs(s, d).withColumn("raw", F.when(k % 7 == 0, F.expr("left(raw, 20)")).when(k % 11 == 0, F.lit("{}")).otherwise(F.col("raw")))


add("unreadable", lambda s, d: R.unreadable(broken_docs(s, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CASE WHEN event_id % 7 = 0 THEN 'no valid JSON' ELSE 'unknown format' END AS reason, count(*) AS n FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0 GROUP BY 1")


def _named(s, d):
    ev = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    mark = F.when(F.col("event_id") % 3 == 0, "-pass-1_pta.json").when(F.col("event_id") % 3 == 1, "-fail-2_pta.json").otherwise("_merged_pta.json")
    return ev.select("event_id", F.concat(F.lit("/data/lib__tool-"), F.col("user_id").cast("string"), F.lit("-logs-mod.x"), mark).alias("path"))


add("discover", lambda s, d: R.discover(_named(s, d)).select("event_id", "task_id", "model", "passed", "run"),
    "SELECT event_id, 'lib__tool-' || user_id AS task_id, 'mod.x' AS model, event_id % 3 = 0 AS passed, CAST(event_id % 3 + 1 AS VARCHAR) AS run FROM events WHERE event_id % 3 < 2")


def _outcome(s, d):
    ev = _named(s, d)
    ej = F.when(F.col("event_id") % 4 == 0, '{"resolved": false}').when(F.col("event_id") % 4 == 1, '{"passed": true}')
    rj = F.when(F.col("event_id") % 5 == 0, '{"verifier_result":{"rewards":{"reward":1.0}}}')
    return ev.select("event_id", R.resolve_outcome(ej, F.col("path"), rj).alias("passed"))


add("resolve_outcome", _outcome, """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN FALSE WHEN event_id % 4 = 1 THEN TRUE WHEN event_id % 3 = 0 THEN TRUE WHEN event_id % 3 = 1 THEN FALSE
  WHEN event_id % 5 = 0 THEN TRUE END AS passed FROM events""")
add("trajectory_dims", lambda s, d: R.trajectory_dims(R.parse_chatlog(chat_docs(s, d))).join(_named(s, d).select(
    F.col("event_id").alias("trajectory_id"), R.task_of(F.regexp_replace("path", "/lib__", "/acme-lib__")).alias("task_label")), "trajectory_id"),
    EV + "SELECT task_id, trajectory_id, 'm' || k AS model, 'acme-lib__tool-' || user_id AS task_label FROM ev JOIN events ON event_id = trajectory_id")


def _own(s, d):
    calls = ('[{"tool_call_id":"1","function_name":"file_editor","arguments":{"command":"str_replace","path":"f@1"}},{"tool_call_id":"2","function_name":"terminal","arguments":{"command":"ls"}},'
             '{"tool_call_id":"3","function_name":"finish","arguments":{}},{"tool_call_id":"4","function_name":"other","arguments":{}}]')
    docs = _docs(s, d, calls, F.col("k")).withColumnRenamed("raw", "calls")
    return R.adapt_own_runs(docs).select(*K, F.array_join(F.transform("calls", lambda c: c["function_name"]), ",").alias("tools"))


add("adapt_own_runs", _own, EV + "SELECT task_id, trajectory_id, 'edit,bash,other' AS tools FROM ev")


def _written(name, write, read):
    """Write through a sink into the shared folder, then read the files back."""
    def fn(s, d):
        key = f"{shared_root(s)}/sink-{name}-{d.rstrip('/').split('/')[-1]}"
        write(s, d, key)
        return read(s, key)
    return fn


add("write_annotations", _written("annotations", lambda s, d, p: sinks.write_annotations(D.annotations(s, d), p),
    lambda s, p: s.read.parquet(f"{p}/parquet").select("task_id", "trajectory_id", "quality_score", "quality_tier", "waste_severity")))
add("write_tasks", _written("tasks", lambda s, d, p: sinks.write_table(D.task_summary(s, d), p),
    lambda s, p: s.read.option("header", True).schema("task_id int, n_trajectories long, n_passing long, n_failing long").csv(f"{p}/csv", enforceSchema=True)),
    """SELECT CAST(user_id // 10 AS INTEGER) AS task_id, count(*) AS n_trajectories, count_if(user_id % 10 < 6) AS n_passing, count_if(user_id % 10 >= 6) AS n_failing
    FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1""")
add("write_reports", _written("reports", lambda s, d, p: sinks.write_reports(sinks.report_json(
    D.reports(s, d), D.waste_summary(s, d)), p), lambda s, p: s.read.text(p).select(
    "task_id", F.get_json_object("value", "$.verdict").alias("verdict"), F.get_json_object("value", "$.quality_score").cast("int").alias("quality_score"))))
add("write_trace", lambda s, d: R.parse_saved_trace(sinks.graph_json(
    D.ref_states(s, d), D.ref_edges(s, d), D.G.remap_ids(D.G.run_terminals(D.mapping(s, d)), D.remap(s, d))).withColumn(
    "trajectory_id", F.lit("reference")))["states"].groupBy("task_id").agg(F.count(F.lit(1)).alias("states"), F.count_if("is_initial").alias("initial")))
add("match_to_json", lambda s, d: sinks.match_json(D.metrics(s, d)).select(
    *K, F.get_json_object("match", "$.matched_count").cast("int").alias("matched_count")))
