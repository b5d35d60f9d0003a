"""Shared SQL fragments for the check queries: the event adapter and the stage labels,
written independently in portable SQL."""

from __future__ import annotations

from runloom.functions import commands as C


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def stripped(column: str, prefix: str = C.CD_PREFIX_ALL) -> str:
    return f"trim(regexp_replace({column}, {q(prefix)}, ''))"


def rint(x: str) -> str:
    """Half-even rounding of a non-negative double."""
    return f"round_even({x}, 0)"


ENTRIES = """
e0 AS (
  SELECT CAST(user_id // 10 AS INTEGER) AS task_id, user_id AS trajectory_id, event_id, ts,
         event_type AS et, value AS v, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
         CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n_steps
  FROM events),
e1 AS (
  SELECT *, CASE WHEN k % 10 = 0 THEN 'tests/test_mod' || (k % 4) || '.py'
                 WHEN k % 10 = 1 THEN 'tmp/notes.md' ELSE 'src/mod' || (k % 6) || '.py' END AS f,
    CASE WHEN et <> 'error' THEN ''
       WHEN k % 8 = 0 THEN 'python -m pytest tests/test_mod' || (k % 4) || '.py'
       WHEN k % 8 = 1 THEN 'grep -rn "mod' || (k % 6) || '" src/'
       WHEN k % 8 = 2 THEN 'cat src/mod' || (k % 6) || '.py'
       WHEN k % 8 = 3 THEN 'sed -i s/a/b/ src/mod' || (k % 6) || '.py'
       WHEN k % 8 = 4 THEN 'git diff' WHEN k % 8 = 5 THEN 'python run.py'
       WHEN k % 8 = 6 THEN 'rm -f out.txt' ELSE 'cd /w && make' END AS command,
    CASE WHEN et = 'view' THEN 'read_file' WHEN et = 'click' THEN 'grep_search'
         WHEN et = 'purchase' AND k % 7 = 3 THEN 'apply_patch'
         WHEN et = 'purchase' THEN 'replace_string_in_file'
         WHEN et = 'signup' THEN 'think' ELSE 'run_in_terminal' END AS tool
  FROM e0),
e2 AS (
  SELECT *, CASE WHEN et IN ('view', 'purchase') THEN
              CASE WHEN f = 'tmp/notes.md' THEN 'tmp/notes.md' ELSE f END ELSE '' END AS file_raw,
    CASE WHEN tool <> 'replace_string_in_file' THEN ''
         WHEN k % 2 = 0 THEN 'def fn' || (k % 3) || '(x):' || chr(10) || '    return ' || k
         ELSE 'x = ' || k END AS old_s,
    CASE WHEN tool <> 'replace_string_in_file' THEN ''
         WHEN k % 2 = 0 THEN 'def fn' || (k % 3) || '(x):' || chr(10) || '    return ' || k || ' + 1' || chr(10)
         ELSE 'x = ' || k || chr(10) || 'y = 1' END AS new_s,
    '*** Update File: /workspace/' || f || chr(10) || '@@' || chr(10) || '-def fn' || (k % 3) || '(x):'
      || chr(10) || '+def fn' || (k % 3) || '(y):' AS patch
  FROM e1),
st0 AS (
  SELECT task_id, trajectory_id, seq, n_steps, 'm' || (trajectory_id % 4) AS model,
    (trajectory_id % 10) < 6 AS passed, k, tool AS tool_used, command, old_s, new_s, patch,
    -- the prefix pass strips workspace/ first and tmp/ after it
    CASE WHEN file_raw = 'tmp/notes.md' THEN 'notes.md' ELSE file_raw END AS file_path,
    CASE WHEN et = 'click' THEN 'mod' || (k % 6) || ' fn' || (k % 3) ELSE '' END AS query,
    CASE WHEN et = 'view' AND k % 11 <> 0 THEN k WHEN tool = 'replace_string_in_file' THEN 1
         WHEN tool = 'apply_patch' THEN 1 END AS line_start,
    CASE WHEN et = 'view' AND k % 11 <> 0 THEN k + 40
         WHEN tool = 'replace_string_in_file' THEN CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END
         WHEN tool = 'apply_patch' THEN 1 END AS line_end,
    CASE WHEN tool = 'replace_string_in_file' AND k % 2 = 0 OR tool = 'apply_patch'
         THEN 'fn' || (k % 3) ELSE '' END AS function_name,
    CASE WHEN tool = 'run_in_terminal' THEN substr(md5(command), 1, 12)
         WHEN tool = 'replace_string_in_file' THEN substr(md5(old_s || '||' || new_s), 1, 12)
         WHEN tool = 'apply_patch' THEN substr(md5(patch), 1, 12) ELSE '' END AS content_hash,
    CASE WHEN tool = 'think' THEN '{"thought":"t' || (k % 5) || '"}' ELSE '' END AS args_json,
    CASE WHEN tool = 'read_file' THEN 'text ' || k
         WHEN tool = 'grep_search' THEN CASE WHEN k % 3 = 0 THEN '[]' ELSE 'hit ' || k END
         WHEN tool = 'replace_string_in_file' THEN
           CASE WHEN k % 9 = 0 THEN 'no match' ELSE 'The file was edited successfully' END
         WHEN tool = 'apply_patch' THEN 'Done' WHEN tool = 'think' THEN 'ok ' || (k % 5)
         ELSE 'exit ' || k END AS response,
    CAST(floor(v * 10) AS BIGINT) AS input_tokens, CAST(floor(v) AS BIGINT) AS output_tokens,
    CAST(floor(v * 100) AS BIGINT) AS latency_ms
  FROM e2),
st AS (
  SELECT *, CASE tool_used WHEN 'read_file' THEN 'read' WHEN 'grep_search' THEN 'search'
              WHEN 'think' THEN 'general' WHEN 'run_in_terminal' THEN 'execute' ELSE 'edit' END AS category,
    CASE tool_used WHEN 'read_file' THEN 'file_read:' || file_path
      WHEN 'grep_search' THEN CASE WHEN k % 3 = 0 THEN 'grep_search:no_matches' ELSE 'grep_search:found_matches' END
      WHEN 'replace_string_in_file' THEN
        CASE WHEN k % 9 = 0 THEN 'file_modify_failed:' ELSE 'file_modified:' END || file_path
      WHEN 'apply_patch' THEN 'file_patched:' || file_path WHEN 'think' THEN 'tool_result:think:success'
      ELSE 'terminal:' || split_part(command, ' ', 1) END AS resulting_state,
    'Tool: ' || tool_used
      || CASE WHEN tool_used IN ('read_file', 'replace_string_in_file') THEN chr(10) || 'filePath: /workspace/'
           || CASE WHEN file_path = 'notes.md' THEN 'tmp/notes.md' ELSE file_path END ELSE '' END
      || CASE WHEN query <> '' THEN chr(10) || 'query: ' || query ELSE '' END
      || CASE WHEN command <> '' THEN chr(10) || 'command: ' || command ELSE '' END
      || chr(10) || 'Response: ' || response AS observation,
    CASE WHEN tool_used = 'replace_string_in_file' THEN 'In ''' || regexp_extract(file_path, '[^/]*$', 0) || ''': '
           || CASE WHEN length(new_s) > length(old_s) * 1.2 THEN 'added content' ELSE 'modified content' END
         WHEN tool_used = 'apply_patch' THEN 'In ''' || regexp_extract(file_path, '[^/]*$', 0) || ''': modified content'
         WHEN tool_used = 'run_in_terminal' THEN CASE WHEN command LIKE 'python%' THEN 'Ran Python command: '
           WHEN command LIKE 'git%' THEN 'Ran Git command: ' ELSE 'Ran terminal command: ' END || command
         ELSE '' END AS content_description
  FROM st0)"""

TEST_F = rx("file_path", C.TEST_FILE)
SUMMARY_F = f"(file_path LIKE 'tmp/%' OR {rx('file_path', C.SUMMARY_FILE)})"
EXPLORE_CMD = (f"({rx('command', C.EXPLORATION_COMMAND)} OR ({rx('command', C.CAT_COMMAND)} "
               f"AND NOT {rx('command', C.CAT_REDIRECT)}))")
ORCH_CMD = (f"({stripped('command')} <> '' AND ({rx(stripped('command'), C.TMP_WRITE)} "
            f"OR {rx('command', C.ORCHESTRATION_COMMAND)}))")
VERIFY_CMD = (f"({stripped('command', C.CD_PREFIX_ONE)} <> '' AND NOT {rx('command', C.EXPLORATION_COMMAND)} "
              f"AND {rx(stripped('command', C.CD_PREFIX_ONE), C.VERIFICATION_COMMAND)})")
CODE_CMD = rx(stripped("command"), C.CODE_WRITING_COMMAND)
MODIFY_CMD = rx("command", C.MODIFYING_COMMAND)

LABELS = f""",
lb0 AS (
  SELECT *, (category = 'edit' AND NOT {TEST_F} AND NOT {SUMMARY_F}) AS src_edit,
         (category = 'execute' AND {CODE_CMD}) AS code_cmd,
         (category = 'execute' AND {MODIFY_CMD}) AS mod_cmd FROM st),
lb1 AS (
  SELECT *, coalesce(max(CAST(src_edit OR code_cmd OR mod_cmd AS INTEGER)) OVER w, 0) = 1 AS done,
    coalesce(list(CASE WHEN src_edit THEN file_path
             WHEN code_cmd THEN regexp_extract(command, {q(C.WRITTEN_FILE)}, 1) END) OVER w, []) AS wrote
  FROM lb0 WINDOW w AS (PARTITION BY trajectory_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lab AS (
  SELECT * EXCLUDE (src_edit, code_cmd, mod_cmd, done, wrote), CASE
    WHEN category = 'search' THEN 'exploration' WHEN category = 'general' THEN 'orchestration'
    WHEN category = 'edit' THEN CASE WHEN {TEST_F} THEN CASE WHEN done THEN 'verification' ELSE 'exploration' END
                                WHEN {SUMMARY_F} THEN 'orchestration' ELSE 'implementation' END
    WHEN category = 'read' THEN CASE WHEN {TEST_F} THEN CASE WHEN done THEN 'verification' ELSE 'exploration' END
                                WHEN done AND list_contains(wrote, file_path) THEN 'verification' ELSE 'exploration' END
    WHEN {rx('command', C.TEST_COMMAND)} THEN 'verification'
    WHEN {ORCH_CMD} THEN 'orchestration' WHEN {CODE_CMD} THEN 'implementation'
    WHEN done AND ({VERIFY_CMD} OR {rx('command', C.GIT_REVIEW_COMMAND)}) THEN 'verification'
    WHEN {EXPLORE_CMD} THEN 'exploration' WHEN seq >= n_steps * 0.8 THEN 'verification'
    ELSE 'exploration' END AS intent_stage
  FROM lb1)"""


def steps(body: str) -> str:
    return f"WITH {ENTRIES}\n{body}"


def labelled(body: str) -> str:
    return f"WITH {ENTRIES}{LABELS}\n{body}"


# Transition type between two stages held in columns a and b.
def ttype(a: str, b: str) -> str:
    rank = "list_position(['exploration','implementation','verification','orchestration'], {})"
    return (f"CASE WHEN {b} = 'orchestration' AND {a} <> 'orchestration' THEN 'confirm' WHEN {a} = {b} THEN 'deepen' "
            f"WHEN {rank.format(b)} > {rank.format(a)} THEN 'pivot' ELSE 'backtrack' END")
