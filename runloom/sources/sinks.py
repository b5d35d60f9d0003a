"""Writers: annotation and task tables, nested reports, saved graphs, match results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.plans.dataset import ANNOTATION_COLUMNS


def write_table(df: DataFrame, path: str, csv: bool = True) -> None:
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_annotations(df: DataFrame, path: str) -> None:
    """Refuses a table whose columns differ from the published layout."""
    if list(df.columns) != list(ANNOTATION_COLUMNS):
        raise ValueError("annotation columns differ from the fixed layout")
    write_table(df, path)


def report_json(reports: DataFrame, waste: DataFrame) -> DataFrame:
    """One nested report per run as JSON text."""
    j = reports.join(waste.drop("n_cand"), ["task_id", "trajectory_id"])
    body = F.struct(
        "trajectory_id", "model", "passed", "quality_score", "quality_tier", "verdict", "stage_order_match",
        F.struct("coverage_percent", F.col("coherence_score").alias("coherence"), "stage_completeness", "workflow_similarity").alias("key_metrics"),
        "failure_reasons", "strengths", F.col("m.al_seq").alias("aligned_steps"), F.col("m.al_pos").alias("aligned_reference"),
        F.struct(*[F.struct(F.col(f"total_{x}").alias("expected"), F.col(f"matched_{x}").alias("matched")).alias(x) for x in "EIVO"]).alias("stage_comparison"),
        F.struct("wasted_steps_distinct", "severity", "wasted_input_tokens", "wasted_output_tokens").alias("inefficiency"))
    return j.select("task_id", "trajectory_id", F.to_json(body).alias("report"))


def write_reports(df: DataFrame, path: str) -> None:
    """Partitioned by task. A task's reports are written by one Spark task, so the files that the driver
    commits and lists are as many as the tasks and not that times the partitions of ``df``; only a hot
    task is written by many."""
    df.select("task_id", "report").hint("rebalance", "task_id").write.mode("overwrite").partitionBy("task_id").text(path)


def graph_json(states: DataFrame, edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """One saved graph per task. A graph is bounded by the k donor runs it was merged from."""
    sid = lambda c: F.concat(F.lit("merged_state_"), F.col(c).cast("string"))
    s = states.groupBy("task_id").agg(
        F.map_from_entries(F.collect_list(F.struct(sid("merged_id"), F.struct(
            "step", "tool_used", "file_path", "resulting_state", "intent_stage", "trace_count", "files_touched")))).alias("states"),
        F.concat(F.lit("merged_state_"), F.min("merged_id").cast("string")).alias("initial_state"))
    t = edges.groupBy("task_id").agg(F.collect_list(F.struct(
        F.concat(F.lit("merged_trans_"), F.col("edge_no").cast("string")).alias("transition_id"), sid("src").alias("from_state"),
        sid("dst").alias("to_state"), "action_type")).alias("transitions"))
    r = terminals.groupBy("task_id").agg(F.array_sort(F.collect_list(sid("merged_id"))).alias("real_terminal_ids"))
    j = s.join(t, "task_id", "left").join(r, "task_id", "left")
    return j.select("task_id", F.to_json(F.struct("initial_state", "states", "transitions", F.struct("real_terminal_ids").alias("metadata"))).alias("raw"))


def match_json(metrics: DataFrame) -> DataFrame:
    flat = [c for c in metrics.columns if c not in ("best", "m")]
    return metrics.select("task_id", "trajectory_id", F.to_json(F.struct(*flat)).alias("match"))
