"""Driver tables seen as run logs.

``events``: one user is one run, ten users are one task. Event types stand for
tools, and ``props.k`` chooses files, commands and edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.intent import label_intent
from runloom.operators.normalize import states_from_entries
from runloom.operators.scan import CHUNK_ROWS, number_rows, spread
from runloom.plans.store import staged

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _s(c: Column) -> Column:
    return c.cast("string")


def event_entries(spark: SparkSession, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    ev = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT_COLUMNS))
    k, et = F.col("k"), F.col("event_type")

    def sel(pairs, default, n):
        out = F.lit(default) if isinstance(default, str) else default
        for r, v in reversed(pairs):
            out = F.when(F.pmod(k, F.lit(n)) == r, F.lit(v) if isinstance(v, str) else v).otherwise(out)
        return out
    mod = F.concat(F.lit("src/mod"), _s(k % 6), F.lit(".py"))
    test = F.concat(F.lit("tests/test_mod"), _s(k % 4), F.lit(".py"))
    file = sel([(0, test), (1, "tmp/notes.md")], mod, 10)
    command = sel([(0, F.concat(F.lit("python -m pytest "), test)),
                   (1, F.concat(F.lit('grep -rn "mod'), _s(k % 6), F.lit('" src/'))),
                   (2, F.concat(F.lit("cat "), mod)),
                   (3, F.concat(F.lit("sed -i s/a/b/ "), mod)), (4, "git diff"),
                   (5, "python run.py"), (6, "rm -f out.txt")], "cd /w && make", 8)
    rooted = F.concat(F.lit("/workspace/"), file)
    read, grep, edit, think = (et == t for t in ("view", "click", "purchase", "signup"))
    term = et == "error"
    patch = edit & (k % 7 == 3)
    plain = edit & ~patch
    fn = F.concat(F.lit("fn"), _s(k % 3))
    old = F.when(k % 2 == 0, F.concat(F.lit("def "), fn, F.lit("(x):\n    return "), _s(k))) \
        .otherwise(F.concat(F.lit("x = "), _s(k)))
    new = F.when(k % 2 == 0, F.concat(F.lit("def "), fn, F.lit("(x):\n    return "), _s(k), F.lit(" + 1\n"))) \
        .otherwise(F.concat(F.lit("x = "), _s(k), F.lit("\ny = 1")))
    patch_text = F.concat(F.lit("*** Update File: "), rooted, F.lit("\n@@\n-def "), fn,
                          F.lit("(x):\n+def "), fn, F.lit("(y):"))
    base = ev.select(
        F.floor(F.col("user_id") / 10).cast("int").alias("task_id"),
        F.col("user_id").alias("trajectory_id"), "event_id", "ts", "event_type", "value",
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))
    entries = base.select(
        "task_id", "trajectory_id", "ts", "event_id",
        F.concat(F.lit("m"), _s(F.col("trajectory_id") % 4)).alias("model"),
        (F.col("trajectory_id") % 10 < 6).alias("passed"),
        _s(F.col("event_id")).alias("entry_id"), F.lit("toolCall").alias("kind"),
        F.when(read, "read_file").when(grep, "grep_search").when(patch, "apply_patch")
        .when(plain, "replace_string_in_file").when(think, "think")
        .otherwise("run_in_terminal").alias("tool"),
        F.when(read | plain, rooted).alias("path_arg"),
        F.when(grep, F.concat(F.lit("mod"), _s(k % 6), F.lit(" fn"), _s(k % 3))).alias("query"),
        F.when(term, command).alias("command"),
        F.when(plain, old).alias("old_string"), F.when(plain, new).alias("new_string"),
        F.when(patch, patch_text).alias("patch_input"),
        F.when(read & (k % 11 != 0), k).alias("start_line"),
        F.when(read & (k % 11 != 0), k + 40).alias("end_line"),
        F.when(think, F.concat(F.lit('{"thought":"t'), _s(k % 5), F.lit('"}'))).alias("args_json"),
        F.when(read, F.concat(F.lit("text "), _s(k)))
        .when(grep, F.when(k % 3 == 0, "[]").otherwise(F.concat(F.lit("hit "), _s(k))))
        .when(plain, F.when(k % 9 == 0, "no match").otherwise("The file was edited successfully"))
        .when(patch, "Done").when(think, F.concat(F.lit("ok "), _s(k % 5)))
        .otherwise(F.concat(F.lit("exit "), _s(k))).alias("response"),
        F.floor(F.col("value") * 10).cast("long").alias("input_tokens"),
        F.floor(F.col("value")).cast("long").alias("output_tokens"),
        (F.floor(F.col("value") * 100)).cast("long").alias("latency_ms"),
        _s(F.col("ts")).alias("ts_text"))
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    return number_rows(entries, ["task_id", "trajectory_id"], ["ts", "event_id"], hour, chunk_rows) \
        .withColumn("step", (F.col("seq") + 1).cast("int")) \
        .withColumn("entry_index", F.col("seq").cast("int")).drop("event_id", "ts")


def event_states(spark: SparkSession, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    # Event runs hold tool calls only, so no final request can quote its predecessor.
    return states_from_entries(event_entries(spark, sf_dir, chunk_rows), confirm_last=False)


def labelled_events(spark: SparkSession, sf_dir: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return label_intent(event_states(spark, sf_dir, chunk_rows), chunk_rows=chunk_rows)


def staged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled event steps. Normalised states are written first: labelling reads them three
    times (steps, first writes, chunk totals), and they cost far more than the labels."""
    def build():
        states = staged(spark, "states", sf_dir, lambda: event_states(spark, sf_dir))
        return label_intent(states)
    return staged(spark, "steps", sf_dir, build)
