"""Intent stage of every step, without a sequential loop.

Whether an implementation came earlier depends only on context-free triggers, so
it is a running maximum; whether a file was implemented before is a comparison
with the first step that wrote it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import commands as C
from runloom.functions.text import blank
from runloom.operators.scan import CHUNK_ROWS, RUN_KEYS, running

EXPLORATION, IMPLEMENTATION = "exploration", "implementation"
VERIFICATION, ORCHESTRATION = "verification", "orchestration"
STAGES = (EXPLORATION, IMPLEMENTATION, VERIFICATION, ORCHESTRATION)
#: Share of a run after which its steps count as near the end.
NEAR_END = 0.8
LETTER = {EXPLORATION: "E", IMPLEMENTATION: "I", VERIFICATION: "V", ORCHESTRATION: "O"}


def stage_letter(c: Column) -> Column:
    return F.upper(F.substring(c, 1, 1))


def _effect() -> tuple[Column, Column]:
    """The effect of a state, and whether its tool's fixed hint says orchestration."""
    return blank("resulting_state"), (F.col("stage_hint") == ORCHESTRATION) & ~F.col("context_sensitive")


def written_files() -> tuple[Column, Column]:
    """Of one state alone: the source files it writes (comma separated), and 1 if it is an implementation."""
    path, cmd = blank("file_path"), blank("command")
    edits, terminal = (F.col("category") == c for c in ("edit", "execute"))
    effect, fixed_other = _effect()
    idle = effect.isin("", "initial") | effect.startswith("llm_response:")
    edit_call = edits & ~idle & ~fixed_other
    writes_source = edit_call & ~C.is_test_file(path) & ~C.is_summary_file(path)
    writes_code = terminal & C.is_code_writing_command(cmd)
    trigger = writes_source | writes_code | (terminal & C.is_modifying_command(cmd))
    return F.when(writes_source, path).when(writes_code, C.written_file(cmd)).otherwise(""), trigger.cast("int")


def stage_of(done: Column, written: Column, near_end: Column) -> Column:
    """Stage of one state: ``done`` if an implementation came earlier, ``written`` if an earlier step wrote its
    file, ``near_end`` in the last fifth of the run."""
    path, cmd = blank("file_path"), blank("command")
    edits, reads, terminal = (F.col("category") == c for c in ("edit", "read", "execute"))
    effect, fixed_other = _effect()
    seen = done & (path != "") & written
    by_outcome = F.when(done, VERIFICATION)
    explores = C.is_exploration_command(cmd)
    in_terminal = (
        F.when(C.is_test_command(cmd), VERIFICATION)
        .when(C.is_orchestration_command(cmd), ORCHESTRATION)
        .when(C.is_code_writing_command(cmd), IMPLEMENTATION)
        .when(done & (C.is_verification_command(cmd) | C.is_git_review_command(cmd)), VERIFICATION)
        .when(explores, EXPLORATION).when(near_end, VERIFICATION).otherwise(EXPLORATION))
    return (
        F.when(effect.isin("", "initial"), "")
        .when(effect.startswith("llm_response:"), ORCHESTRATION)
        .when(F.col("category") == "search", EXPLORATION)
        .when(F.col("category") == "validation", VERIFICATION)
        .when(fixed_other, ORCHESTRATION)
        .when(edits, F.when(C.is_test_file(path), by_outcome.otherwise(EXPLORATION))
              .when(C.is_summary_file(path), ORCHESTRATION).otherwise(IMPLEMENTATION))
        .when(reads, F.when(C.is_test_file(path), by_outcome.otherwise(EXPLORATION))
              .when(seen, VERIFICATION).otherwise(EXPLORATION))
        .when(terminal, in_terminal)
        .when((F.col("stage_hint") != "") & ~F.col("context_sensitive"), F.col("stage_hint"))
        .when(F.lower(effect).rlike("error|fail"), by_outcome.otherwise(ORCHESTRATION))
        .otherwise(ORCHESTRATION))


def label_intent(states: DataFrame, keys: Sequence[str] = RUN_KEYS,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``intent_stage``; needs seq, n_steps, chunk and the tool attributes."""
    keys = list(keys)
    files, trigger = written_files()
    df = states.withColumn("_written", files).withColumn("_trigger", trigger)
    df = running(df, {"_done": ("max", F.col("_trigger"))}, keys, chunk_rows=chunk_rows)
    firsts = (df.where(F.col("_written") != "")
              .select(*keys, "seq", F.explode(F.split("_written", ",")).alias("_f"))
              .select(*keys, "seq", F.trim("_f").alias("_f")).where(F.col("_f") != "")
              .groupBy(*keys, F.col("_f").alias("file_path")).agg(F.min("seq").alias("_first")))
    df = df.join(firsts, [*keys, "file_path"], "left")
    done = F.coalesce(F.col("_done"), F.lit(0)) == 1
    stage = stage_of(done, F.coalesce(F.col("_first") < F.col("seq"), F.lit(False)), F.col("seq") >= F.col("n_steps") * NEAR_END)
    return df.withColumn("intent_stage", stage).drop("_written", "_trigger", "_done", "_first")


def transition_type(before: Column, after: Column) -> Column:
    """confirm, deepen, pivot or backtrack between two labelled stages."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)])
    a, b = F.try_element_at(rank, before), F.try_element_at(rank, after)
    return F.when((after == ORCHESTRATION) & (before != ORCHESTRATION), "confirm") \
        .when(a == b, "deepen").when(b > a, "pivot").otherwise("backtrack")
