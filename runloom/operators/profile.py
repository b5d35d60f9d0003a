"""Behaviour profile of single runs: mixes, footprints, tokens, time and experience."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import blank, percent
from runloom.operators import features as X
from runloom.operators.scan import RUN_KEYS, running

# Tools that modify or read files in the footprint.
FOOTPRINT_EDITS = ("create_file", "replace_string_in_file", "multi_replace_string_in_file", "apply_patch")
FOOTPRINT_READS = ("read_file", "list_dir")


def _mix(states: DataFrame, value: Column, name: str, keys: Sequence[str]) -> DataFrame:
    """Counts and percentages of ``value`` per run; pre-aggregated before any window."""
    counts = states.groupBy(*keys, value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    totals = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    return counts.join(totals, [*keys]).withColumn("pct", percent(F.col("n"), F.col("_total"))).drop("_total")


def stage_mix(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    stage = F.coalesce(F.nullif(blank("intent_stage"), F.lit("")), F.lit("unknown"))
    return _mix(states, stage, "stage", keys)


def tool_mix(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return states.where(blank("tool_used") != "").groupBy(*keys, "tool_used").agg(
        F.count(F.lit(1)).alias("n"))


def operation_mix(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    op = F.coalesce(F.nullif(blank("operation_type"), F.lit("")), F.lit("other"))
    return states.groupBy(*keys, op.alias("operation")).agg(F.count(F.lit(1)).alias("n"))


def file_footprint(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Distinct files touched, modified and only read, counted over one row per file."""
    touched = states.select(*keys, F.explode("files_touched").alias("f")).distinct() \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("files_touched"))
    tool = blank("tool_used")
    used = states.where(blank("file_path") != "").groupBy(*keys, "file_path").agg(
        F.bool_or(tool.isin(*FOOTPRINT_EDITS)).alias("m"), F.bool_or(tool.isin(*FOOTPRINT_READS)).alias("r"))
    kinds = used.groupBy(*keys).agg(F.count_if("m").alias("files_modified"),
                                    F.count_if(F.col("r") & ~F.col("m")).alias("files_read_only"))
    runs = states.select(*keys).distinct()
    return (runs.join(touched, [*keys], "left").join(kinds, [*keys], "left")
            .fillna(0, ["files_touched", "files_modified", "files_read_only"]))


def exploration_ratio(expl: Column, impl: Column) -> Column:
    return F.when(impl > 0, F.round(expl / impl, 2)).otherwise(expl.cast("double"))


def coherence_band(score: Column) -> Column:
    return F.when(score >= 0.7, "Clean forward progression") \
        .when(score >= 0.4, "Some backtracking detected").otherwise("Heavy thrashing")


def completed(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Terminal flag of the last state; unknown for the format that always sets it."""
    fmt = F.col("source_format") if "source_format" in states.columns else F.lit("")
    flag = F.when(blank(fmt) == "atif", F.lit(None).cast("boolean")).otherwise(F.col("is_terminal"))
    return states.groupBy(*keys).agg(F.max_by(flag, "seq").alias("completed"))


def cumulative_tokens(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    out = running(states, {"cumulative_tokens": ("sum", F.coalesce("input_tokens", F.lit(0)))},
                  keys, inclusive=True)
    return out.select(*keys, "seq", "cumulative_tokens")


def step_latencies(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Latency series of runs that have any; one row per step."""
    live = states.groupBy(*keys).agg(F.max(F.coalesce("latency_ms", F.lit(0))).alias("_m")) \
        .where(F.col("_m") > 0).select(*keys)
    return states.join(live, [*keys], "left_semi").select(
        *keys, "seq", F.coalesce("latency_ms", F.lit(0)).alias("latency_ms"))


def time_decomposition(wall: Column, thinking: Column, wait: Column) -> dict[str, Column]:
    wait = F.coalesce(wait, F.lit(0))
    work = F.greatest(F.lit(0), wall - thinking - wait)
    known = F.coalesce(wall, F.lit(0)) > 0
    return {"agent_work_ms": F.when(known, work), "thinking_ms": F.when(known, thinking),
            "human_wait_ms": F.when(known, wait)}


def experience_score(human_inputs: Column, n_states: Column, wall: Column, wait: Column,
                     mean_latency: Column, compactions: Column) -> dict[str, Column]:
    """Autonomy, friction, responsiveness and stability, with their weighted score."""
    autonomy = F.greatest(F.lit(0.0), 1.0 - human_inputs / n_states)
    friction = F.when((F.coalesce(wall, F.lit(0)) > 0) & wait.isNotNull(),
                      F.greatest(F.lit(0.0), 1.0 - wait / wall)).otherwise(1.0)
    quick = F.when(mean_latency.isNull(), 0.5).otherwise(
        1.0 / (1.0 + F.exp((mean_latency - 15000) / 5000)))
    stable = F.greatest(F.lit(0.0), 1.0 - F.coalesce(compactions, F.lit(0)) * 0.2)
    score = autonomy * 0.30 + friction * 0.30 + quick * 0.25 + stable * 0.15
    known = human_inputs.isNotNull() & (n_states > 0)
    return {n: F.when(known, F.round(c * 100, 1)) for n, c in (
        ("experience_score", score), ("autonomy", autonomy), ("low_friction", friction),
        ("responsiveness", quick), ("stability", stable))}


def profile(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """One row per run: counts, coherence, ratios, footprint and fingerprint."""
    base = states.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("state_count"),
        F.count_if(F.col("intent_stage") == "exploration").alias("_e"),
        F.count_if(F.col("intent_stage") == "implementation").alias("_i"),
        F.max_by("is_terminal", "seq").alias("completed"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("total_input_tokens"))
    tools = tool_mix(states, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("tool_count"))
    coh = X.coherence(states, keys).select(*keys, "coherence_score")
    out = (base.join(tools, [*keys], "left").join(coh, [*keys])
           .join(file_footprint(states, keys), [*keys]).join(X.fingerprint(states, keys), [*keys], "left"))
    return out.select(
        *keys, "state_count", F.coalesce("tool_count", F.lit(0)).alias("tool_count"), "files_touched",
        "files_modified", "files_read_only", F.round("coherence_score", 4).alias("coherence"),
        coherence_band(F.col("coherence_score")).alias("coherence_label"),
        exploration_ratio(F.col("_e"), F.col("_i")).alias("exploration_ratio"), "completed",
        "total_input_tokens", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
