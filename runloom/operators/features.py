"""Per-run sequence features over labelled steps."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from runloom.functions.text import blank
from runloom.operators.intent import STAGES, stage_letter, transition_type
from runloom.operators.scan import RUN_KEYS, lagged, renumber, running

LETTERS = ("E", "I", "V", "O")
ALPHA = 0.01  # smoothing of stage distributions
SEGMENTS = 3


def labelled_only(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return renumber(states.where(F.col("intent_stage") != ""), keys)


def actionable(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Drop model requests and close the gaps in ``seq``."""
    return renumber(states.where(~F.col("kind").eqNullSafe("request")), keys)


def signature() -> Column:
    return F.struct(blank("tool_used").alias("t"), blank("file_path").alias("f"),
                    blank("intent_stage").alias("s"))


def has_signature() -> Column:
    return (blank("tool_used") != "") | (blank("file_path") != "") | (blank("intent_stage") != "")


def stage_summary(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    counts = states.groupBy(*keys).agg(*[
        F.count_if(F.col("intent_stage") == s).alias(f"n_{x}") for s, x in zip(STAGES, LETTERS)])
    parts = [F.when(F.col(f"n_{x}") > 0, F.concat(F.lit(f"{x}:"), F.col(f"n_{x}").cast("string")))
             for x in LETTERS]
    text = F.concat_ws(" ", *parts)
    return counts.select(*keys, F.when(text == "", "(none)").otherwise(text).alias("summary"))


def with_previous_stage(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Add ``prev_stage``: the stage of the last labelled step before this one."""
    mark = F.when(blank("intent_stage") != "", F.struct("seq", "intent_stage"))
    out = running(states, {"_last": ("max", mark)}, keys)
    return out.withColumn("prev_stage", F.col("_last.intent_stage")).drop("_last")


def stage_transitions(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return (with_previous_stage(states, keys)
            .where((F.col("intent_stage") != "") & F.col("prev_stage").isNotNull())
            .select(*keys, "seq", F.col("prev_stage").alias("from_stage"),
                    F.col("intent_stage").alias("to_stage"),
                    transition_type(F.col("prev_stage"), F.col("intent_stage")).alias("transition")))


def _joined(states: DataFrame, value: Column, sep: str, keys: Sequence[str]) -> DataFrame:
    """One string per run: short strings per chunk first, then the chunks in order."""
    parts = states.groupBy(*keys, "chunk").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("seq", value.alias("v")))), lambda x: x["v"]), sep).alias("part"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), sep).alias("text"))


def fingerprint(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    lab = states.where(F.col("intent_stage") != "")
    return _joined(lab, stage_letter(F.col("intent_stage")), "→", keys) \
        .withColumnRenamed("text", "fingerprint")


def tool_sequence(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    used = states.where(~blank("tool_used").isin("", "request"))
    return _joined(used, F.col("tool_used"), ",", keys).withColumnRenamed("text", "tool_sequence")


def transition_counts(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return stage_transitions(states, keys).groupBy(*keys).agg(*[
        F.count_if(F.col("transition") == t).alias(t) for t in ("deepen", "pivot", "backtrack", "confirm")])


@pandas_udf(IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, one bit per symbol of ``b``."""
    def length(x: str, y: str) -> int:
        full, masks = (1 << len(y)) - 1, {}
        for i, ch in enumerate(y):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        row = full
        for ch in x:
            hit = row & masks.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(y) - row.bit_count()
    return pd.Series([length(x, y) for x, y in zip(a, b)], dtype="int32")


def workflow_similarity(a: Column, b: Column) -> Column:
    """Common subsequence of stage letters over the longer of the two."""
    a, b = (F.regexp_replace(blank(c), "[^EIVO]", "") for c in (a, b))
    la, lb = F.length(a), F.length(b)
    return F.when((la == 0) & (lb == 0), 1.0).when((la == 0) | (lb == 0), 0.0) \
        .otherwise(_lcs(a, b) / F.greatest(la, lb))


def with_retry_flag(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """``is_retry``: third or later step of a run with equal tool, file and stage."""
    out = lagged(states, {"_s1": (signature(), 1), "_s2": (signature(), 2)}, keys)
    same = has_signature() & (F.col("_s1") == signature()) & (F.col("_s2") == signature())
    return out.withColumn("is_retry", F.coalesce(same, F.lit(False))).drop("_s1", "_s2")


def blind_retries(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return with_retry_flag(states, keys).groupBy(*keys).agg(
        F.count_if("is_retry").alias("blind_retries"))


def coherence_score(pivots: Column, confirms: Column, backtracks: Column, transitions: Column,
                    retries: Column) -> Column:
    directed = pivots + confirms + backtracks
    ratio = F.when(directed == 0, 1.0).otherwise((pivots + confirms) / directed)
    return F.when(transitions == 0, 1.0).otherwise(
        ratio * (1.0 - F.least(retries / transitions, F.lit(1.0))))


def coherence(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    df = with_previous_stage(with_retry_flag(states, keys), keys)
    kind = F.when((blank("intent_stage") != "") & F.col("prev_stage").isNotNull(),
                  transition_type(F.col("prev_stage"), F.col("intent_stage")))
    agg = df.withColumn("_k", kind).groupBy(*keys).agg(
        *[F.count_if(F.col("_k") == t).alias(t) for t in ("deepen", "pivot", "backtrack", "confirm")],
        F.count("_k").alias("transitions"), F.count_if("is_retry").alias("blind_retries"))
    return agg.withColumn("coherence_score", coherence_score(
        F.col("pivot"), F.col("confirm"), F.col("backtrack"), F.col("transitions"),
        F.col("blind_retries")))


def stage_distribution(states: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    agg = states.groupBy(*keys).agg(*[
        (F.count_if(F.col("intent_stage") == s) + ALPHA).alias(x) for s, x in zip(STAGES, LETTERS)])
    total = sum(F.col(x) for x in LETTERS)
    return agg.select(*keys, *[(F.col(x) / total).alias(f"p_{x}") for x in LETTERS])


def jsd(p: Sequence[Column], q: Sequence[Column]) -> Column:
    """Jensen-Shannon divergence (base 2) of two positive distributions."""
    out = F.lit(0.0)
    for a, b in zip(p, q):
        m = (a + b) * 0.5
        out = out + 0.5 * a * F.log2(a / m) + 0.5 * b * F.log2(b / m)
    return out


def segment_counts(states: DataFrame, keys: Sequence[str] = RUN_KEYS, n: int = SEGMENTS) -> DataFrame:
    """Stage counts in ``n`` equal segments of the labelled steps; the last takes the rest.

    Columns ``c<segment><letter>``.
    """
    size = F.greatest(F.lit(1), F.floor(F.col("n_steps") / n))
    seg = F.least(F.floor(F.col("seq") / size), F.lit(n - 1))
    return labelled_only(states, keys).withColumn("_seg", seg).groupBy(*keys).agg(*[
        F.count_if((F.col("_seg") == k) & (F.col("intent_stage") == s)).alias(f"c{k}{x}")
        for k in range(n) for s, x in zip(STAGES, LETTERS)])


def segment_columns(n: int = SEGMENTS) -> list[str]:
    return [f"c{k}{x}" for k in range(n) for x in LETTERS]


def profile_score(left: str, right: str, n: int = SEGMENTS) -> Column:
    """1 - mean divergence of corresponding segments; counts prefixed left/right."""
    def dist(prefix, k):
        cells = [F.col(f"{prefix}c{k}{x}") + ALPHA for x in LETTERS]
        total = cells[0] + cells[1] + cells[2] + cells[3]
        return [c / total for c in cells]
    mean = sum((jsd(dist(left, k), dist(right, k)) for k in range(n)), F.lit(0.0)) / n

    def some(prefix):
        return sum((F.col(f"{prefix}{c}") for c in segment_columns(n)), F.lit(0)) > 0
    return F.when(some(left) & some(right), F.greatest(F.lit(0.0), 1.0 - mean)).otherwise(0.0)
