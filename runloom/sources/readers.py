"""Readers of run logs. A raw document is one row (path, raw); parsing is column work.

Heterogeneous fields are read as JSON text and narrowed where needed, so one bad argument
never loses a document. Every reader returns entries in the shared schema with ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.functions.text import blank
from runloom.operators.normalize import ENTRY_FIELDS, conform_entries
from runloom.operators.scan import number_rows, spread
from runloom.plans.store import written

# Action names of the action log and their tools (blank = leave out).
ACTION_TOOLS = {
    "read:file": "read_file",
    "read:dir": "list_dir",
    "edit:create": "create_file",
    "edit:str_replace": "replace_string_in_file",
    "edit:insert": "replace_string_in_file",
    "edit:view": "read_file",
    "edit:undo_edit": "replace_string_in_file",
    "run:": "run_in_terminal",
    "run_ipython:": "run_in_terminal",
    "think:": "think",
}
SKIPPED_ACTIONS = ("finish", "system", "message", "recall", "condensation", "task_tracking", "browse_interactive")
DIR_MARKERS = ("Here's the files and directories", "Here's the result of running `find`",
               "Here's the result of running `ls`")
# Function names of the step log and their tools.
FUNCTION_TOOLS = {
    "view": "read_file",
    "create": "create_file",
    "edit": "replace_string_in_file",
    "glob": "file_search",
    "grep": "grep_search",
    "bash": "run_in_terminal",
    "write_bash": "run_in_terminal",
    "read_bash": "run_in_terminal",
    "web_fetch": "fetch_webpage",
    "show_file": "read_file",
    "Read": "read_file",
    "Write": "create_file",
    "Edit": "replace_string_in_file",
    "Glob": "file_search",
    "Grep": "grep_search",
    "Bash": "run_in_terminal",
    "WebFetch": "fetch_webpage",
    "NotebookEdit": "edit_notebook_file",
    "Shell": "run_in_terminal",
    "StrReplace": "replace_string_in_file",
    "ReadLints": "get_errors",
    "read_file": "read_file",
    "create_file": "create_file",
    "replace_string_in_file": "replace_string_in_file",
    "multi_replace_string_in_file": "multi_replace_string_in_file",
    "file_search": "file_search",
    "grep_search": "grep_search",
    "run_in_terminal": "run_in_terminal",
    "get_errors": "get_errors",
}
DELEGATING = ("task", "Task", "Agent")
SHELL_FUNCTIONS = ("Shell", "Bash", "bash", "write_bash")
# Argument names renamed per source.
ACTION_ARGS = {"path": "filePath", "file_text": "content", "old_str": "oldString", "new_str": "newString"}
STEP_ARGS = {"path": "filePath", "old_str": "oldString", "new_str": "newString", "file_path": "filePath",
             "old_string": "oldString", "new_string": "newString", "glob_pattern": "query", "contents": "content",
             "paths": "filePaths", "pattern": "query"}
EDITED = "The file was edited successfully. "

LOGS = ("array<struct<id string, kind string, tool string, args string, response string, "
        "metadata struct<model string>>>")
CHATLOG = f"prompts array<struct<logs {LOGS}>>"
ACTIONLOG = ("array<struct<id long, cause long, action string, observation string, content string, message string, "
             "args string, timestamp string, tool_call_metadata string>>")
CALLS = ("tool_calls array<struct<tool_call_id string, function_name string, arguments string>>, "
         "observation struct<results array<struct<source_call_id string, content string, "
         "subagent_trajectory_ref array<struct<trajectory_path string>>>>>, metrics struct<prompt_tokens long, "
         "completion_tokens long, extra struct<latency_ms long>>")
STEPLOG = ("schema_version string, agent struct<name string, version string, model_name string>, "
           "extra struct<scenario string, repository string, commit string, failed boolean>, "
           "final_metrics struct<total_prompt_tokens long, total_completion_tokens long, total_cost_usd double, "
           "extra struct<wall_time_ms long, active_time_ms long, permission_wait_ms long>>, "
           "steps array<struct<step_id string, source string, timestamp string, model_name string, message string, "
           + CALLS + ", extra struct<compaction_event string>>>")
REPLACEMENTS = "array<struct<filePath string, path string, oldString string, newString string>>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents with their path."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def detect_format(raw: Column) -> Column:
    """atif, trace, chatlog or openhands, from the shape of a document."""
    head = F.substring(F.ltrim(raw), 1, 1)
    first_kind = F.get_json_object(raw, "$[0].kind")
    return (F.when(F.get_json_object(raw, "$.schema_version").like("ATIF%"), "atif")
            .when(F.get_json_object(raw, "$.initial_state").isNotNull(), "trace")
            .when(F.get_json_object(raw, "$.prompts").isNotNull(), "chatlog")
            .when((head == "[") & first_kind.isin("toolCall", "request"), "chatlog").otherwise("openhands"))


def arg_map(args: Column) -> Column:
    """Arguments as text by name; text that is no JSON object is kept under ``raw``."""
    parsed = F.from_json(args, "map<string,string>")
    whole = F.create_map(F.lit("raw"), args)
    got = F.when(F.ltrim(args).startswith("{"), parsed).otherwise(F.when(args.isNotNull(), whole))
    return F.map_filter(F.coalesce(got, F.when(args.isNotNull(), whole)), lambda _, v: v.isNotNull())


def rename_args(args: Column, names: dict[str, str]) -> Column:
    """Rename keys; where two keys land on one name, a key already carrying it is kept."""
    def new(k):
        return F.coalesce(_lookup(names, k), k)
    kept = F.map_filter(args, lambda k, v: (new(k) == k) | ~F.map_contains_key(args, new(k)))
    return F.map_from_entries(F.array_distinct(F.transform(F.map_entries(kept), lambda e: F.struct(
        new(e["key"]).alias("key"), e["value"].alias("value")))))


def entry_fields(args: Column) -> dict[str, Column]:
    """Entry columns from canonical argument names."""
    def get(name):
        return F.try_element_at(args, F.lit(name))
    repl = F.from_json(get("replacements"), REPLACEMENTS)
    return {
        "path_arg": F.coalesce(F.nullif(get("filePath"), F.lit("")), get("path")), "query": get("query"),
        "command": get("command"), "content": get("content"), "old_string": get("oldString"), "new_string": get("newString"),
        "patch_input": F.coalesce(F.nullif(get("input"), F.lit("")), get("patch")),
        "start_line": get("startLine").try_cast("int"),
        "end_line": get("endLine").try_cast("int"),
        "replacements": F.transform(repl, lambda r: F.struct(
            F.coalesce(r["filePath"], r["path"]).alias("file_path"), r["oldString"].alias("old_string"),
            r["newString"].alias("new_string"))),
        "args_json": F.to_json(args)}


def _finish(df: DataFrame, order: list[str]) -> DataFrame:
    """Number the entries of each document and keep the shared columns."""
    numbered = number_rows(df, ["task_id", "trajectory_id"], order, F.floor(F.col(order[0]) / 1024))
    keep = [c for c in numbered.columns if c not in order]
    out = numbered.select(*keep, F.col("seq").cast("int").alias("entry_index")) \
        if "entry_index" not in keep else numbered.select(*keep)
    return conform_entries(out)


def _identify(raw: DataFrame) -> DataFrame:
    """Default identity: the path is the run; callers may bring task_id and trajectory_id."""
    if "trajectory_id" in raw.columns:
        return raw
    return raw.withColumn("trajectory_id", F.col("path")).withColumn("task_id", F.lit(""))


def parse_chatlog(raw: DataFrame, include_requests: bool = False) -> DataFrame:
    """Flatten prompts[].logs[]; keep the first and last log, tool calls, and requests on demand."""
    doc = _identify(raw).select("task_id", "trajectory_id", F.flatten(F.transform(
        F.from_json("raw", CHATLOG)["prompts"], lambda p: F.coalesce(p["logs"], F.array().cast(LOGS)))).alias("logs"))
    one = doc.select("task_id", "trajectory_id", F.size("logs").alias("_n"), F.posexplode("logs").alias("pos", "l"))
    keep = (F.col("pos") == 0) | (F.col("pos") == F.col("_n") - 1) | (F.col("l.kind") == "toolCall")
    if include_requests:
        keep = keep | (F.col("l.kind") == "request")
    call = F.col("l.kind") == "toolCall"
    msg = F.get_json_object("l.response", "$.message")
    many = F.from_json(msg, "array<string>")
    e = one.where(keep).withColumn("_a", F.when(call, arg_map(F.col("l.args"))))
    return _finish(e.select(
        "task_id", "trajectory_id", "pos", F.coalesce("l.id", F.concat(F.lit("log_"), F.col("pos").cast("string"))).alias("entry_id"),
        F.coalesce("l.kind", F.lit("unknown")).alias("kind"), F.col("pos").alias("entry_index"),
        F.when(call, blank("l.tool")).alias("tool"), *[c.alias(n) for n, c in entry_fields(F.col("_a")).items()],
        F.when(call, F.col("l.response")).alias("response"),
        F.when(~call, F.coalesce("l.metadata.model", F.lit("unknown"))).alias("model"),
        F.when(~call, F.when(msg.startswith("["), F.array_join(many, " ")).otherwise(msg)).alias("response_message")), ["pos"])


def action_tool(action: Column, sub: Column, content: Column) -> Column:
    """Canonical tool of an action; blank for actions left out, null for unknown ones."""
    listing = F.lit(False)
    for m in DIR_MARKERS:
        listing = listing | F.contains(content, F.lit(m))
    part = F.when(action == "read", F.when(listing, "dir").otherwise("file")) \
        .when(action == "edit", blank(sub)).otherwise("")
    return F.when(action.isin(*SKIPPED_ACTIONS), "").otherwise(
        _lookup(ACTION_TOOLS, F.concat(action, F.lit(":"), part)))


def parse_actionlog(raw: DataFrame) -> DataFrame:
    """Pair every action with the last observation that names it as its cause."""
    ids = ["task_id", "trajectory_id"]
    one = _identify(raw).select(*ids, F.posexplode(F.from_json("raw", ACTIONLOG)).alias("pos", "x"))
    obs = one.where("x.observation IS NOT NULL AND x.action IS NULL AND x.cause IS NOT NULL").groupBy(
        *ids, F.col("x.cause").alias("_id")).agg(F.max_by("x", "pos").alias("o"))
    act = one.where("x.action IS NOT NULL").withColumn("_id", F.col("x.id")).join(obs, [*ids, "_id"], "left")
    args = arg_map(F.col("x.args"))
    act = act.withColumn("_a0", args).withColumn("_content", blank("o.content"))
    act = act.withColumn("tool", action_tool(F.col("x.action"), F.try_element_at("_a0", F.lit("command")), F.col("_content")))
    act = act.where(blank("tool") != "")
    a = rename_args(F.col("_a0"), ACTION_ARGS)
    act = act.withColumn("_a", a)

    def get(n):
        return F.try_element_at("_a", F.lit(n))
    view = F.from_json(get("view_range"), "array<int>")
    read = F.col("tool") == "read_file"
    pair = F.size(view) == 2
    start = F.when(pair, view[0]).otherwise(F.nullif(get("start").try_cast("int"), F.lit(0)))
    end = F.when(pair, view[1]).otherwise(F.nullif(get("end").try_cast("int"), F.lit(-1)))
    f = entry_fields(F.col("_a"))
    f["path_arg"] = F.when(F.map_contains_key("_a", "filePath"), T.norm_path_testbed(get("filePath")))
    f["command"] = F.when(F.col("tool") == "run_in_terminal", get("command"))
    f["start_line"], f["end_line"] = F.when(read, start), F.when(read, end)
    edited = F.col("tool").isin("create_file", "replace_string_in_file") & (F.col("o.observation") == "edit") \
        & ~F.contains(F.lower(blank("o.message")), F.lit("error"))
    meta = "x.tool_call_metadata"

    def g(path):
        return F.get_json_object(meta, f"$.model_response.{path}")
    response = F.nullif(F.col("_content"), F.lit(""))
    response = F.when(response.isNotNull() & edited, F.concat(F.lit(EDITED), F.substring("_content", 1, 200))).otherwise(response)
    response = F.when((F.col("tool") == "think") & (blank(get("thought")) != ""), get("thought")).otherwise(response)
    out = act.select(
        *ids, "pos", F.col("x.id").cast("string").alias("entry_id"), F.lit("toolCall").alias("kind"), "tool",
        *[c.alias(n) for n, c in f.items()], response.alias("response"), F.coalesce(g("model"), F.lit("unknown")).alias("model"),
        F.coalesce(F.nullif(get("thought"), F.lit("")), g("choices[0].message.content"), F.lit("")).alias("thought"),
        F.coalesce(g("usage.prompt_tokens").cast("long"), F.lit(0)).alias("input_tokens"),
        F.coalesce(g("usage.completion_tokens").cast("long"), F.lit(0)).alias("output_tokens"),
        F.coalesce(g("usage.prompt_tokens_details.cached_tokens").cast("long"), F.lit(0)).alias("cached_input_tokens"),
        F.col("x.timestamp").alias("ts_text"))
    return _finish(out, ["pos"])


def actionlog_counters(raw: DataFrame) -> DataFrame:
    """Per document: compactions, unknown actions and the task text of the first message."""
    ids = ["task_id", "trajectory_id"]
    one = _identify(raw).select(*ids, F.posexplode(F.from_json("raw", ACTIONLOG)).alias("pos", "x")).where("x.action IS NOT NULL")
    tool = action_tool(F.col("x.action"), F.get_json_object("x.args", "$.command"), F.lit(""))
    return one.groupBy(*ids).agg(
        F.count_if(F.col("x.action") == "condensation").alias("compactions"), F.count_if(tool.isNull()).alias("skipped"),
        F.substring(F.min_by(F.get_json_object("x.args", "$.content"), F.when(F.col("x.action") == "message", F.col("pos"))), 1, 2000)
        .alias("task_description"))


def _calls(raw: DataFrame) -> DataFrame:
    """Step log exploded to (step, call) rows; steps with no call keep one row."""
    ids = ["task_id", "trajectory_id"]
    doc = _identify(raw).withColumn("d", F.from_json("raw", STEPLOG))
    one = doc.select(*ids, *[c for c in ("path",) if c in doc.columns], "d.agent", F.posexplode("d.steps").alias("pos", "s"))
    return one.select("*", F.posexplode_outer("s.tool_calls").alias("cpos", "c"))


def workspace_root(calls: DataFrame) -> DataFrame:
    """Per run: none if a repository marker occurs; else the shortest shell working folder with
    enough parts; else the longest common folder of the paths. The common prefix of a set of
    sorted arrays is that of its smallest and largest, so two values per run suffice."""
    ids = ["task_id", "trajectory_id"]
    a = arg_map(F.col("c.arguments"))
    p = calls.where("c IS NOT NULL").withColumn("_a", a)

    def get(n):
        return F.replace(F.try_element_at("_a", F.lit(n)), F.lit("\\"), F.lit("/"))
    paths = F.array_compact(F.array(get("path"), get("file_path"), get("filePath")))
    cwd = F.when(F.col("c.function_name").isin(*SHELL_FUNCTIONS), F.concat(F.regexp_replace(get("cwd"), "/+$", ""), F.lit("/")))
    marked = F.exists(paths, lambda x: x.rlike("|".join(T.REPO_MARKERS)))

    def folder(x):
        parts = F.split(F.regexp_replace(x, "^/+", ""), "/")
        hidden = F.exists(parts, lambda q: q.startswith("."))
        last = F.element_at(parts, -1)
        return F.when((F.size(parts) > 1) & ~hidden, F.when(F.contains(last, F.lit(".")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
    folders = F.filter(F.transform(paths, lambda x: F.transform(folder(x), lambda w: F.lower(w))), lambda f: f.isNotNull())
    agg = p.select(*ids, cwd.alias("cwd"), marked.alias("m"), folders.alias("f"), F.size(paths).alias("np")).groupBy(*ids).agg(
        F.min_by(F.regexp_replace("cwd", "^/+", ""), F.when(F.col("cwd").isNotNull(), F.struct(F.length("cwd"), "cwd"))).alias("cwd"),
        F.bool_or("m").alias("m"), F.sum("np").alias("np"), F.sum(F.size("f")).alias("nf"),
        F.min(F.when(F.size("f") > 0, F.array_min("f"))).alias("lo"), F.max(F.when(F.size("f") > 0, F.array_max("f"))).alias("hi"))
    same = F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False)))
    cut = F.array_position(same, False)
    n = F.when(cut == 0, F.size(same)).otherwise(cut - 1).cast("int")
    common = F.when((F.col("nf") >= 2) & (n >= 2), F.concat(F.array_join(F.slice("lo", 1, n), "/"), F.lit("/")))
    return agg.select(*ids, F.when((F.col("np") == 0) | F.col("m"), None)
                      .when(F.size(F.split("cwd", "/")) >= 3, F.col("cwd")).otherwise(common).alias("root"))


def _step_entries(calls: DataFrame, roots: DataFrame, keep_text: bool = True) -> DataFrame:
    ids = ["task_id", "trajectory_id"]
    work = calls.where("s.source = 'agent' AND s.extra.compaction_event IS NULL").join(roots, ids, "left")
    work = work.withColumn("tool", _lookup(FUNCTION_TOOLS, F.col("c.function_name")))
    text = F.col("c").isNull() & (blank("s.message") != "")
    work = work.where(F.col("tool").isNotNull() | (text if keep_text else F.lit(False)))
    work = work.withColumn("_a", rename_args(arg_map(F.col("c.arguments")), STEP_ARGS))

    def get(n):
        return F.try_element_at("_a", F.lit(n))
    res = F.get(F.filter("s.observation.results", lambda r: r["source_call_id"] == F.col("c.tool_call_id")), F.lit(0))
    raw = res["content"]
    inner = F.coalesce(F.get_json_object(raw, "$.detailedContent"), F.get_json_object(raw, "$.content"))
    content = F.when(F.ltrim(raw).startswith("{"), F.coalesce(inner, raw)).otherwise(raw)
    low = F.lower(content)
    ok = F.col("tool").isin("create_file", "replace_string_in_file") & low.rlike("successfully|has been|updated")
    view = F.from_json(get("view_range"), "array<int>")
    off, lim = get("offset").try_cast("int"), get("limit").try_cast("int")
    read = F.col("tool") == "read_file"
    f = entry_fields(F.col("_a"))
    start = F.when(off > 0, off).when(F.size(view) == 2, view[0]).otherwise(f["start_line"])
    end = F.when((off > 0) & (lim > 0), off + lim - 1).when(F.size(view) == 2, view[1]).otherwise(f["end_line"])
    f["start_line"] = F.when(read, start).otherwise(f["start_line"])
    f["end_line"] = F.when(read, end).otherwise(f["end_line"])
    f["path_arg"] = F.when(F.map_contains_key("_a", "filePath"), T.norm_run_path(get("filePath"), F.col("root")))
    return work.select(
        *[c for c in work.columns if c not in ("s", "c", "_a", "tool", "root", "agent")],
        F.concat_ws("_", F.lit("step"), F.coalesce("s.step_id", F.col("pos").cast("string")), F.substring("c.tool_call_id", 1, 12)).alias("entry_id"),
        F.when(F.col("c").isNull(), "request").otherwise("toolCall").alias("kind"), "tool",
        *[c.alias(n) for n, c in f.items()], F.when(ok, F.concat(F.lit(EDITED), F.substring(content, 1, 200))).otherwise(content).alias("response"),
        F.coalesce("s.model_name", "agent.model_name", F.lit("")).alias("model"), F.when(F.col("c").isNull(), F.col("s.message")).alias("response_message"),
        F.coalesce("s.metrics.prompt_tokens", F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce("s.metrics.completion_tokens", F.lit(0)).cast("long").alias("output_tokens"),
        F.coalesce("s.metrics.extra.latency_ms", F.lit(0)).cast("long").alias("latency_ms"), F.col("s.timestamp").alias("ts_text"))


def parse_steplog(raw: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Step log to entries. ``children`` (path, raw) are delegated runs of the same folder,
    spliced in where the parent refers to them; failed children are left out."""
    ids = ["task_id", "trajectory_id"]
    calls = _calls(raw)
    roots = workspace_root(calls)
    own = _step_entries(calls, roots).withColumn("cpos", F.coalesce("cpos", F.lit(0))) \
        .withColumn("rpos", F.lit(0)).withColumn("kpos", F.lit(0)).withColumn("kcpos", F.lit(0))
    parts = own.drop("path")
    if children is not None:
        refs = calls.where(F.col("c.function_name").isin(*DELEGATING)).withColumn("_r", F.get(F.filter(
            "s.observation.results", lambda r: r["source_call_id"] == F.col("c.tool_call_id")), F.lit(0)))
        refs = refs.select(*ids, "pos", "cpos", F.regexp_replace("path", "[^/]*$", "").alias("_dir"),
                           F.posexplode("_r.subagent_trajectory_ref").alias("rpos", "_t"))
        refs = refs.select(*ids, F.col("pos").alias("ppos"), F.col("cpos").alias("pcpos"), "rpos",
                           F.concat("_dir", "_t.trajectory_path").alias("path"))
        kids = children.select("path", "raw").where(~F.coalesce(F.get_json_object("raw", "$.extra.failed"), F.lit("false")).eqNullSafe("true"))
        kid = _calls(refs.join(kids, "path").withColumn("_k", F.struct("ppos", "pcpos", "rpos"))
                     .select(*ids, F.concat_ws("#", "path", F.to_json("_k")).alias("path"), "raw"))
        k = F.from_json(F.substring_index("path", "#", -1), "ppos int, pcpos int, rpos int")
        spliced = _step_entries(kid.where(~blank("c.function_name").isin(*DELEGATING)), roots, keep_text=False) \
            .withColumn("_k", k).withColumn("kpos", F.col("pos")).withColumn("kcpos", F.col("cpos"))
        spliced = spliced.withColumn("pos", F.col("_k.ppos")).withColumn("cpos", F.col("_k.pcpos")) \
            .withColumn("rpos", F.col("_k.rpos")).drop("_k", "path")
        parts = parts.unionByName(spliced)
    return _finish(parts, ["pos", "cpos", "rpos", "kpos", "kcpos"])


def steplog_counters(raw: DataFrame) -> DataFrame:
    """Per run: human inputs, delegations, compactions, skipped tools, times, tokens and cost."""
    ids = ["task_id", "trajectory_id"]
    calls = _calls(raw)
    agent = (F.col("s.source") == "agent") & F.col("s.extra.compaction_event").isNull()
    first = F.coalesce("cpos", F.lit(0)) == 0
    fn = F.col("c.function_name")
    skipped = agent & fn.isNotNull() & ~fn.isin(*DELEGATING) & _lookup(FUNCTION_TOOLS, fn).isNull()
    agg = calls.groupBy(*ids).agg(
        F.count_if((F.col("s.source") == "user") & first).alias("human_inputs"),
        F.count_if(agent & fn.isin(*DELEGATING)).alias("delegations"),
        F.count_if((F.col("s.source") == "agent") & F.col("s.extra.compaction_event").isNotNull() & first).alias("compactions"),
        F.count_if(skipped).alias("skipped_tools"))
    d = F.from_json("raw", STEPLOG)
    meta = _identify(raw).withColumn("d", d).select(
        *ids, F.col("d.agent.name").alias("agent_name"), blank("d.agent.model_name").alias("model"), blank("d.extra.scenario").alias("scenario"),
        *[F.coalesce(f"d.final_metrics.extra.{c}", F.lit(0)).alias(c) for c in ("wall_time_ms", "active_time_ms", "permission_wait_ms")],
        *[F.coalesce(f"d.final_metrics.{c}", F.lit(0)).alias(c) for c in ("total_prompt_tokens", "total_completion_tokens", "total_cost_usd")])
    return meta.join(agg, ids, "left").fillna(0, ["human_inputs", "delegations", "compactions", "skipped_tools"])


STATE = ("state_id string, step int, observation string, resulting_state string, content_hash string, content_description string, "
         "files_touched array<string>, tool_used string, file_path string, line_range array<int>, relative_position string, "
         "operation_type string, edit_type string, function_name string, class_name string, scope_path string, intent_stage string, "
         "phase string, log_entry struct<id string, kind string, tool string, args string>, metadata string")


def parse_saved_trace(raw: DataFrame) -> dict[str, DataFrame]:
    """Saved graph: states by id and transitions. The old field ``phase`` counts as the stage."""
    ids = ["task_id", "trajectory_id"]
    doc = _identify(raw).select(*ids, F.from_json(
        "raw", f"initial_state string, states map<string, struct<{STATE}>>, transitions array<struct<transition_id string, "
        "from_state string, to_state string, action_type string, step int>>").alias("d"))
    s = doc.select(*ids, "d.initial_state", F.explode("d.states").alias("state_id", "s"))
    states = s.select(
        *ids, "state_id", (F.col("state_id") == F.col("initial_state")).alias("is_initial"),
        *[F.col(f"s.{c}") for c in ("step", "observation", "resulting_state", "content_hash", "content_description", "files_touched",
                                    "tool_used", "file_path", "relative_position", "operation_type", "edit_type", "function_name",
                                    "class_name", "scope_path")],
        F.get("s.line_range", F.lit(0)).alias("line_start"), F.get("s.line_range", F.lit(1)).alias("line_end"),
        F.coalesce(F.nullif("s.intent_stage", F.lit("")), F.col("s.phase"), F.lit("")).alias("intent_stage"),
        blank("s.log_entry.kind").alias("kind"), F.get_json_object("s.log_entry.args", "$.command").alias("command"),
        F.get_json_object("s.metadata", "$.input_tokens").cast("long").alias("input_tokens"))
    t = doc.select(*ids, F.explode("d.transitions").alias("t")).select(*ids, "t.*")
    return {"states": states, "transitions": t}


def trace_entries(raw: DataFrame) -> DataFrame:
    """Entries behind the states of saved graphs, in step order; the initial state has none."""
    ids = ["task_id", "trajectory_id"]
    log = "struct<id string, kind string, tool string, args string, response_preview string, model string>"
    s = _identify(raw).select(*ids, F.from_json(
        "raw", f"initial_state string, states map<string, struct<step int, tool_used string, log_entry {log}, metadata string>>").alias("d")).select(
        *ids, F.col("d.initial_state").alias("first"), F.explode("d.states").alias("state_id", "s")).where(
        F.col("s.log_entry").isNotNull() & ~F.col("state_id").eqNullSafe(F.col("first")))
    kind = F.coalesce("s.log_entry.kind", F.lit("unknown"))
    args = F.when(kind == "toolCall", arg_map(F.col("s.log_entry.args")))

    def number(name):
        return F.get_json_object("s.metadata", f"$.{name}").cast("long")
    return _finish(s.select(
        *ids, F.coalesce("s.step", F.lit(0)).alias("pos"), "state_id", F.coalesce("s.log_entry.id", "state_id").alias("entry_id"),
        kind.alias("kind"), F.coalesce("s.step", F.lit(0)).alias("entry_index"),
        F.when(kind == "toolCall", F.coalesce("s.log_entry.tool", F.col("s.tool_used"), F.lit(""))).alias("tool"),
        *[c.alias(n) for n, c in entry_fields(args).items()], F.col("s.log_entry.response_preview").alias("response"),
        F.col("s.log_entry.model").alias("model"), *[number(c).alias(c) for c in ("input_tokens", "output_tokens", "latency_ms")]),
        ["pos", "state_id"])


PARSERS = {"chatlog": parse_chatlog, "openhands": parse_actionlog, "atif": parse_steplog, "trace": trace_entries}


def load_any(raw: DataFrame, fmt: str | None = None) -> DataFrame:
    """Entries of documents in any log format, saved graphs included; ``fmt`` overrides detection.

    The documents are written once to the shared folder, a folder per format, so that they are made and
    their format is detected once and every parser reads its own. Documents that yield no entry are listed
    by ``unreadable``.
    """
    if fmt is not None:
        if fmt not in PARSERS:
            raise ValueError(f"unsupported format: {fmt}")
        return PARSERS[fmt](raw).withColumn("source_format", F.lit(fmt))
    tagged = written(raw.withColumn("_f", detect_format(F.col("raw"))), "documents", "_f")
    out = None
    for name, parse in PARSERS.items():
        part = parse(spread(tagged.where(F.col("_f") == name).drop("_f"))).select(
            "task_id", "trajectory_id", "seq", "n_steps", "chunk", *[c for c in ENTRY_FIELDS if c not in ("task_id", "trajectory_id")]) \
            .withColumn("source_format", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def unreadable(raw: DataFrame) -> DataFrame:
    """Documents that cannot be read, with the reason: no JSON, or nothing of the detected format in it."""
    form, head = detect_format(F.col("raw")), F.substring(F.ltrim("raw"), 1, 1)
    parsed = F.try_parse_json(F.col("raw"))
    parts = {"chatlog": F.from_json("raw", CHATLOG)["prompts"], "atif": F.from_json("raw", STEPLOG)["steps"],
             "trace": F.from_json("raw", "states map<string, struct<step int>>")["states"]}
    empty = F.lit(False)
    for name, part in parts.items():
        wrapped = F.coalesce(F.size(part), F.lit(0)) <= 0
        empty = empty | ((form == name) & wrapped & (head == "{"))
    reason = F.when(F.col("raw").isNull() | parsed.isNull(), "no valid JSON").when(empty, "no entries") \
        .when((form == "openhands") & (head != "["), "unknown format")
    return _identify(raw).select("task_id", "trajectory_id", form.alias("source_format"), reason.alias("reason")).where("reason IS NOT NULL")


def discover(paths: DataFrame, column: str = "path") -> DataFrame:
    """Task, model, outcome and run number from ``<task>-logs-<model>-(pass|fail)[-<run>]``."""
    name = F.regexp_replace(F.regexp_extract(column, r"([^/]+)$", 1), r"(?:_pta)?\.(?:json|zip)$", "")
    pattern = r"^(.+?)-logs-(.+)-(pass|fail)(?:-(\d+))?$"
    return paths.where(~F.col(column).rlike("_merged_pta")).withColumn("_n", name).where(F.col("_n").rlike(pattern)).select(
        "*", F.regexp_extract("_n", pattern, 1).alias("task_id"), F.regexp_extract("_n", pattern, 2).alias("model"),
        (F.regexp_extract("_n", pattern, 3) == "pass").alias("passed"), F.regexp_extract("_n", pattern, 4).alias("run")).drop("_n")


def resolve_outcome(eval_json: Column, path: Column, result_json: Column | None = None) -> Column:
    """Outcome file, then the name marker, then the reward of an own-run result file."""
    flag = F.coalesce(F.get_json_object(eval_json, "$.resolved"), F.get_json_object(eval_json, "$.passed"))
    from_file = F.when(flag == "true", True).when(flag == "false", False)
    low = F.lower(path)
    by_name = F.when(F.contains(low, F.lit("-pass-")) | low.rlike(r"-pass\.zip$"), True) \
        .when(F.contains(low, F.lit("-fail-")) | low.rlike(r"-fail\.zip$"), False)
    out = F.coalesce(from_file, by_name)
    if result_json is not None:
        out = F.coalesce(out, F.get_json_object(result_json, "$.verifier_result.rewards.reward").cast("double") >= 1.0)
    return out


def task_of(label: Column, scenario: Column | None = None) -> Column:
    """``owner__repo-N`` from a label, or the scenario name of a step log."""
    right = r"__([a-zA-Z][a-zA-Z0-9_.-]*?)-(\d+)"
    repo, issue = F.regexp_extract(label, right, 1), F.regexp_extract(label, right, 2)
    seg = F.regexp_extract(F.substring_index(label, "__", 1), r"([^/\\\s]*)$", 1)
    at = F.length(seg) - F.locate("-", F.reverse(seg)) + 1
    owner = F.when(F.endswith(seg, repo), repo).when(F.contains(seg, F.concat(F.lit("-"), repo)), F.substr(seg, at + 1)).otherwise(seg)
    task = F.when((repo != "") & (seg != ""), F.concat(owner, F.lit("__"), repo, F.lit("-"), issue)).otherwise("")
    return task if scenario is None else F.coalesce(F.nullif(scenario, F.lit("")), task)


def trajectory_dims(entries: DataFrame) -> DataFrame:
    """Per run: the first known model name."""
    known = F.when(~blank("model").isin("", "unknown"), F.col("model"))
    return entries.groupBy("task_id", "trajectory_id").agg(
        F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.col("seq"))), F.lit("")).alias("model"))


# Sub-commands of the file editor of own runs.
OWN_EDITOR = {"view": "view", "create": "create", "str_replace": "edit", "insert": "edit", "undo_edit": "edit"}


def adapt_own_runs(raw: DataFrame) -> DataFrame:
    """Rename editor sub-commands and terminal calls of own runs, drop ``finish``."""
    call = "struct<tool_call_id:string,function_name:string,arguments:string>"

    def adapt(c):
        sub = F.get_json_object(c["arguments"], "$.command")
        name = F.when(c["function_name"] == "file_editor", F.coalesce(_lookup(OWN_EDITOR, sub), sub)) \
            .when(c["function_name"] == "terminal", "bash").otherwise(c["function_name"])
        return F.struct(c["tool_call_id"].alias("tool_call_id"), name.alias("function_name"), c["arguments"].alias("arguments"))
    return raw.withColumn("calls", F.transform(F.filter(F.from_json("calls", f"array<{call}>"),
                                                       lambda c: c["function_name"] != "finish"), adapt))
