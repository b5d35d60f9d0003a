"""Log entries to states: effect, text, hashes, location and scope of every step.

Everything here is a projection, except the last step of a run, whose effect may
quote its predecessor (one ``lag``), and the edges (one ``lead``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.functions.registry import with_descriptor
from runloom.operators.scan import RUN_KEYS, lagged

# One schema for entries from every source.
ENTRY_FIELDS = {
    "task_id": "string", "trajectory_id": "string", "entry_id": "string", "kind": "string",
    "entry_index": "int", "tool": "string", "path_arg": "string", "query": "string",
    "command": "string", "content": "string", "old_string": "string", "new_string": "string",
    "patch_input": "string", "start_line": "int", "end_line": "int",
    "replacements": "array<struct<file_path:string,old_string:string,new_string:string>>",
    "args_json": "string", "response": "string", "model": "string", "response_message": "string",
    "thought": "string", "input_tokens": "long", "output_tokens": "long",
    "cached_input_tokens": "long", "latency_ms": "long", "ts_text": "string",
}


def conform_entries(df: DataFrame) -> DataFrame:
    """Add the entry columns a source does not produce, typed and null; keep the rest."""
    have = set(df.columns)
    missing = [F.lit(None).cast(t).alias(c) for c, t in ENTRY_FIELDS.items() if c not in have]
    return df.select("*", *missing) if missing else df


def _ok(response: Column) -> Column:
    return F.contains(F.lower(T.blank(response)), F.lit("successfully"))


def _repl_paths(repl: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(repl, lambda r: T.norm_path(r["file_path"]))))


def patch_file(patch: Column) -> Column:
    """Path named by the first file header of a patch."""
    head = F.regexp_extract(T.blank(patch), r"(?m)^((?:\*\*\* Update File:|\+\+\+ ).*)$", 1)
    return F.when(F.contains(head, F.lit(":")), F.trim(F.regexp_extract(head, ":(.*)$", 1))) \
        .otherwise(F.trim(F.substring(head, 5, 100000)))


def resulting_state(previous: Column | None = None, is_last: Column | None = None) -> Column:
    """Effect of one entry as a short string."""
    tool, resp = T.blank("tool"), T.blank("response")
    path = F.col("_path")
    low = F.lower(resp)
    patched = T.norm_path(patch_file(F.col("patch_input")))
    many = F.array_join(_repl_paths(F.col("replacements")), ",")
    bad = "error|failed|invalid|exception|not found|denied|timeout|refused"

    def tag(name, rest):
        return F.concat(F.lit(name), rest)
    call = (
        F.when(tool == "create_file", F.when(_ok(resp), tag("file_created:", path))
               .otherwise(tag("file_create_failed:", path)))
        .when(tool == "read_file", tag("file_read:", path))
        .when(tool == "replace_string_in_file", F.when(_ok(resp), tag("file_modified:", path))
              .otherwise(tag("file_modify_failed:", path)))
        .when(tool == "file_search", F.when(
            (resp == "") | F.contains(resp, F.lit("No files found")), tag("file_search:not_found:", F.lower(T.blank("query"))))
            .otherwise(tag("file_search:found:", F.lower(T.blank("query")))))
        .when(tool == "grep_search", F.when(
            (resp == "") | (resp == "[]") | F.contains(low, F.lit("no matches")), "grep_search:no_matches")
            .otherwise("grep_search:found_matches"))
        .when(tool == "semantic_search", F.when(resp == "", "semantic_search:no_results")
              .otherwise("semantic_search:results"))
        .when(tool == "run_in_terminal", tag("terminal:", F.coalesce(F.nullif(F.lower(
            F.regexp_extract(T.blank("command"), r"^\s*(\S+)", 1)), F.lit("")), F.lit("unknown"))))
        .when(tool == "list_dir", tag("dir_listed:", path))
        .when(tool == "apply_patch", tag("file_patched:", F.coalesce(
            F.nullif(patched, F.lit("")), F.lit("unknown"))))
        .when(tool == "multi_replace_string_in_file", tag("files_modified:", F.coalesce(
            F.nullif(many, F.lit("")), F.lit("unknown"))))
        .otherwise(F.concat(F.lit("tool_result:"), F.coalesce(F.nullif(tool, F.lit("")), F.lit("unknown")),
                            F.when(low.rlike(bad), ":error").otherwise(":success"))))
    request = F.lit("llm_response:planning")
    if previous is not None and is_last is not None:
        quotes = ((T.blank(previous) != "") & (previous != "initial")
                  & (previous != "llm_response") & ~previous.startswith("llm_response:"))
        request = F.when(is_last & quotes, tag("llm_response:confirmed:", previous)) \
            .when(is_last, "llm_response:terminal").otherwise("llm_response:planning")
    return F.when(F.col("kind") == "toolCall", call).when(F.col("kind") == "request", request) \
        .otherwise("unknown")


def observation_text() -> Column:
    def arg(name, col):
        return F.when(T.blank(col) != "", F.concat(F.lit(f"{name}: "), T.cut(F.col(col), 200)))
    call = F.concat_ws("\n", F.concat(F.lit("Tool: "), T.blank("tool")),
                       arg("filePath", "path_arg"), arg("query", "query"),
                       arg("command", "command"), arg("content", "content"),
                       F.when(T.blank("response") != "", F.concat(
                           F.lit("Response: "), T.cut(F.col("response"), 500))))
    req = F.concat_ws("\n", F.concat(F.lit("LLM Request: "), T.blank("model")),
                      F.when(T.blank("response_message") != "", F.concat(
                          F.lit("Response: "), T.cut(F.col("response_message"), 500))))
    return F.when(F.col("kind") == "toolCall", call).when(F.col("kind") == "request", req) \
        .otherwise("")


def content_hash() -> Column:
    tool = T.blank("tool")
    pair = F.concat(T.blank("old_string"), F.lit("||"), T.blank("new_string"))
    ordered = F.array_sort(F.col("replacements"), lambda a, b: F.when(
        a["file_path"] < b["file_path"], -1).when(a["file_path"] > b["file_path"], 1).otherwise(0))
    many = F.array_join(F.transform(ordered, lambda r: F.concat(
        T.blank(r["file_path"]), F.lit(":"), T.blank(r["old_string"]), F.lit("||"),
        T.blank(r["new_string"]))), "|||")

    def of(col, when=None):
        c = T.blank(col) if isinstance(col, str) else F.coalesce(col, F.lit(""))
        return F.when(c != "", T.short_hash(c, 12)).otherwise("")
    return F.when(F.col("kind") != "toolCall", "").when(tool == "create_file", of("content")) \
        .when(tool == "replace_string_in_file", T.short_hash(pair, 12)) \
        .when(tool == "multi_replace_string_in_file", of(many)) \
        .when(tool == "apply_patch", of("patch_input")) \
        .when(tool == "run_in_terminal", of("command")).otherwise("")


def entry_signature() -> Column:
    args = F.to_json(F.struct(
        F.when(T.blank("command") != "", T.cut(F.col("command"), 100)).alias("command"),
        F.when(T.blank("path_arg") != "", T.cut(F.col("path_arg"), 100)).alias("filePath"),
        F.when(T.blank("query") != "", T.cut(F.col("query"), 100)).alias("query")))
    return F.when(F.col("kind") == "toolCall", F.concat(
        F.lit("toolCall:"), T.blank("tool"), F.lit("("), args, F.lit(")"))) \
        .otherwise(F.concat(F.lit("request:"), T.blank("model")))


# One edit is a list of (file, old code, new code) changes, whatever tool made it.
NO_CHANGE = "array<struct<file:string,old_code:string,new_code:string>>"


def edit_changes() -> Column:
    tool = F.when(F.col("kind") == "toolCall", T.blank("tool")).otherwise("")
    one = F.array(F.struct(T.blank("path_arg").alias("file"), T.blank("old_string").alias("old_code"),
                           T.blank("new_string").alias("new_code")))
    made = F.array(F.struct(T.blank("path_arg").alias("file"), T.blank("content").alias("old_code"),
                            F.lit("").alias("new_code")))
    many = F.transform("replacements", lambda r: F.struct(
        T.blank(r["file_path"]).alias("file"), T.blank(r["old_string"]).alias("old_code"),
        T.blank(r["new_string"]).alias("new_code")))
    none = F.array().cast(NO_CHANGE)
    return F.coalesce(F.when(tool == "replace_string_in_file", one).when(tool == "create_file", made)
                      .when(tool == "multi_replace_string_in_file", many)
                      .when(tool == "apply_patch", T.patch_hunks(F.col("patch_input"))), none)


def change_symbols(changes: Column) -> Column:
    """Symbols, imports and sizes of both sides of every change."""
    def side(code, tag):
        return [T.function_names(code).alias(f"f{tag}"), T.class_names(code).alias(f"c{tag}"),
                T.import_lines(code).alias(f"i{tag}"), F.length(code).alias(f"n{tag}"),
                T.line_count(code).alias(f"l{tag}")]
    return F.transform(changes, lambda c: F.struct(
        c["file"].alias("file"), *side(c["old_code"], "o"), *side(c["new_code"], "n")))


def _joined(names: Column) -> Column:
    """Distinct non-empty names, sorted and comma separated."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: n != ""))), ",")


def location() -> dict[str, Column]:
    """file_path, line range, edit type, symbols and position, from ``_sym``."""
    tool = F.when(F.col("kind") == "toolCall", T.blank("tool")).otherwise("")
    old, new = T.blank("old_string"), T.blank("new_string")
    read, edit = tool == "read_file", tool == "replace_string_in_file"
    make, multi, patch = tool == "create_file", tool == "multi_replace_string_in_file", tool == "apply_patch"
    sym, has_patch = F.col("_sym"), patch & (T.blank("patch_input") != "")
    lines = F.aggregate(sym, F.lit(0), lambda a, c: a + F.when(
        multi, F.when(c["no"] > 0, c["lo"]).otherwise(0)).otherwise(F.greatest(c["lo"], c["ln"])))
    first_new = F.when(new != "", F.lit(1)).otherwise(F.lit(0))
    end = (F.when(read, F.coalesce(F.col("end_line"), F.col("start_line")))
           .when(edit & (old != ""), F.greatest(sym[0]["lo"], sym[0]["ln"] * first_new))
           .when(make & (T.blank("content") != ""), sym[0]["lo"])
           .when(multi & (lines > 0), lines)
           .when(has_patch, F.when(F.size(sym) > 0, lines).otherwise(T.line_count(T.blank("patch_input")))))
    start = F.when(read, F.col("start_line")).when(end.isNotNull(), F.lit(1))

    def names(tag):
        firsts = F.transform(sym, lambda c: T.first_or_blank(c[tag + "o"]))
        other = F.when(patch, F.transform(sym, lambda c: T.first_or_blank(c[tag + "n"]))) \
            .otherwise(F.array().cast("array<string>"))
        return _joined(F.concat(firsts, other))
    func, cls = names("f"), names("c")
    return {
        "file_path": F.when(multi, _joined(F.transform(sym, lambda c: T.norm_path(c["file"]))))
        .when(has_patch, T.norm_path(patch_file(F.col("patch_input"))))
        .when(tool == "", "").otherwise(F.col("_path")),
        "line_start": start.cast("int"), "line_end": F.when(start.isNotNull(), end).cast("int"),
        "edit_type": F.when(edit, T.edit_type(old, new)).when(make & (T.blank("content") != ""), "add")
        .when((multi & (F.size(sym) > 0)) | has_patch, "replace").otherwise(""),
        "relative_position": F.when(read, T.relative_position(
            F.col("start_line"), end, F.coalesce(F.col("end_line"), F.lit(100)) * 1.5)).otherwise(""),
        "function_name": func, "class_name": cls,
        "scope_path": F.when(edit | make, T.scope_path(func, cls)).otherwise(
            F.when(func != "", func).otherwise(cls))}


def content_description() -> Column:
    tool = F.when(F.col("kind") == "toolCall", T.blank("tool")).otherwise("")
    sym = F.col("_sym")
    told = F.transform(F.slice(sym, 1, 5), lambda c: F.concat(
        F.lit("In '"), T.file_name(c["file"]), F.lit("': "), T.change_words(c)))
    noun = F.when(tool == "apply_patch", " more files").otherwise(" more changes")
    more = F.when(F.size(sym) > 5, F.concat(F.lit("... and "), (F.size(sym) - 5).cast("string"), noun))
    edits = F.concat_ws("; ", F.array_join(told, "; "), more)
    return F.when(tool == "create_file", T.creation_description(
        F.col("path_arg"), F.col("content"), sym[0]["fo"], sym[0]["co"])) \
        .when(tool.isin("replace_string_in_file", "multi_replace_string_in_file") & (F.size(sym) > 0), edits) \
        .when(tool == "apply_patch", F.when(T.blank("patch_input") == "", "")
              .when(F.size(sym) == 0, "Applied patch").otherwise(edits)) \
        .when(tool == "run_in_terminal", T.command_description(F.col("command"))).otherwise("")


STATE_FIELDS = ("line_start", "line_end", "file_path", "edit_type", "relative_position",
                "function_name", "class_name", "scope_path", "tool_used", "observation",
                "content_hash", "content_description", "files_touched", "resulting_state")


def states_from_entries(entries: DataFrame, extra_tools: DataFrame | None = None,
                        confirm_last: bool = True) -> DataFrame:
    """Entries carrying ``seq``, ``n_steps`` and ``chunk`` become states.

    ``confirm_last`` lets a final request quote the effect of the step before it.
    """
    df = conform_entries(entries).select("*", T.norm_path("path_arg").alias("_path"),
                                         edit_changes().alias("_changes"))
    df = df.withColumn("_sym", change_symbols(F.col("_changes"))).drop("_changes")
    loc = location()
    call = F.col("kind") == "toolCall"
    df = df.select(
        "*", *[c.alias(n) for n, c in loc.items()],
        F.when(call, F.col("tool")).alias("tool_used"),
        observation_text().alias("observation"), content_hash().alias("content_hash"),
        content_description().alias("content_description"),
        F.when(call & (T.blank("path_arg") != ""), F.array("path_arg"))
        .otherwise(F.array().cast("array<string>")).alias("files_touched"),
        resulting_state().alias("resulting_state")).drop("_sym")
    if confirm_last:
        df = lagged(df, {"_prev": ("resulting_state", 1)})
        last = F.col("seq") == F.col("n_steps") - 1
        prev = F.coalesce(F.col("_prev"), F.lit("initial"))
        quoted = resulting_state(prev, last)
        df = df.withColumn("resulting_state", F.when(last & (F.col("kind") == "request"), quoted)
                           .otherwise(F.col("resulting_state"))).drop("_prev")
    df = df.drop("_path").select("*", F.lit(False).alias("is_initial"),
                                 (F.col("seq") == F.col("n_steps") - 1).alias("is_terminal"))
    return with_descriptor(df, "tool_used", extra_tools)


def with_initial_state(states: DataFrame) -> DataFrame:
    """Prepend the unlabelled initial state to every run and shift positions by one."""
    shifted = states.withColumn("seq", F.col("seq") + 1).withColumn("n_steps", F.col("n_steps") + 1)
    heads = states.where(F.col("seq") == 0)
    keep = {"task_id", "trajectory_id", "n_steps", "chunk", "model", "passed"}
    blank = {"resulting_state": F.lit("initial"), "observation": F.lit("<initial>"),
             "seq": F.lit(0).cast("long"), "is_initial": F.lit(True), "is_terminal": F.lit(False),
             "n_steps": F.col("n_steps") + 1, "kind": F.lit("")}
    texts = {"file_path", "edit_type", "relative_position", "function_name", "class_name",
             "scope_path", "content_hash", "content_description", "stage_hint",
             "equivalence_group", "intent_stage"}
    cols = []
    for f in states.schema.fields:
        if f.name in blank:
            cols.append(blank[f.name].cast(f.dataType).alias(f.name))
        elif f.name in keep:
            cols.append(F.col(f.name))
        else:
            cols.append(F.lit("" if f.name in texts else None).cast(f.dataType).alias(f.name))
    return rechunk(shifted.unionByName(heads.select(*cols)))


def rechunk(df: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    from runloom.operators.scan import CHUNK_ROWS
    return df.withColumn("chunk", F.floor(F.col("seq") / (chunk_rows or CHUNK_ROWS)))


def transitions(states: DataFrame) -> DataFrame:
    """Edges between consecutive states; the action is the tool of the later one."""
    nxt = F.struct("seq", "kind", "tool_used")
    w = lagged(states, {"_n": (nxt, -1)}).where(F.col("_n").isNotNull())
    action = F.when(F.col("_n.kind") == "toolCall", F.coalesce(F.nullif(F.col("_n.tool_used"), F.lit("")),
                                                              F.lit("unknown_tool"))).otherwise("request")
    return w.select(*RUN_KEYS, F.col("seq").alias("src"), F.col("_n.seq").alias("dst"),
                    action.alias("action_type"))
