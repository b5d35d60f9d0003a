"""Wasted steps of candidate runs, judged against the reference.

Input ``steps`` are labelled candidate steps with contiguous ``seq``; ``reports`` carry the
chosen path (``best``) and the alignment (``m``) per run, and ``first`` (path 0) where the
dataset rules need it. All rules are flags per step or aggregates over islands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.text import blank
from runloom.operators.features import has_signature, signature, stage_letter
from runloom.operators.intent import transition_type
from runloom.operators.scan import RUN_KEYS, lagged, running

PATTERN_LENGTHS = (2, 3, 4)
NEAR = 3
CATEGORIES = ("retries", "cycles", "redundant", "unnecessary")
# What the rules on flagged steps read; texts and arguments of the steps stay where they are.
FLAGGED = ("n_steps", "chunk", "tool_used", "file_path", "intent_stage", "input_tokens", "output_tokens")


def step_signature() -> Column:
    return F.concat_ws("|", blank("tool_used"), blank("file_path"), stage_letter(blank("intent_stage")))


def with_reference(steps: DataFrame, reports: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Attach to every step what its run's reference allows."""
    ref = reports.select(
        *keys, "n_cand", F.col("best.stages").alias("ref_stages"), F.col("best.total").alias("ref_len"),
        F.col("best.retry_sigs").alias("ref_retries"))
    at = reports.select(*keys, F.explode("m.al_seq").alias("seq")).select(*keys, F.col("seq").cast(steps.schema["seq"].dataType), F.lit(True).alias("aligned"))
    return steps.join(ref, list(keys)).join(at, [*keys, "seq"], "left").withColumn("aligned", F.coalesce("aligned", F.lit(False)))


def run_keys(steps: DataFrame, keys: Sequence[str]) -> list[str]:
    """Those of ``keys`` that name a run of ``steps``; the others name references, of which a run may have many."""
    return [k for k in keys if k in steps.columns]


def step_flags(steps: DataFrame, reports: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Per step and report of its run: keys, seq, ``FLAGGED``, aligned and is_retry, retry_start, is_backtrack,
    is_redundant, is_late_exploration, after_impl. Other columns of ``steps`` can be joined by keys and seq.

    What a step's neighbours say is worked out once per run; ``reports`` may hold the run several times
    (``keys`` that ``steps`` does not have), and each adds what its reference allows."""
    run = run_keys(steps, keys)
    df = steps.select(*run, "seq", *[c for c in FLAGGED if c in steps.columns])
    df = lagged(df, {f"_n{i}": (signature(), i) for i in range(-NEAR, NEAR + 1) if i}, run)
    df = running(df, {"_impl": ("max", F.when(F.col("intent_stage") == "implementation", 1))}, run)
    same = [F.coalesce(F.col(f"_n{i}") == signature(), F.lit(False)) for i in (1, 2, 3)]
    twin = [F.when((F.col(f"_n{i}.t") == blank("tool_used")) & (F.col(f"_n{i}.f") == blank("file_path")), F.col("seq") - i)
            for i in range(-NEAR, NEAR + 1) if i]
    plain = (blank("tool_used") != "") | (blank("file_path") != "")
    before = F.coalesce(F.col("_n1.s"), F.lit(""))
    df = df.select(
        *run, "seq", *[c for c in FLAGGED if c in steps.columns], (has_signature() & same[0] & same[1]).alias("_retry"), (~same[2]).alias("_fresh"),
        ((before != "") & (transition_type(before, F.col("intent_stage")) == "backtrack")).alias("_back"),
        F.concat(stage_letter(before), stage_letter(F.col("intent_stage"))).alias("_pair"), step_signature().alias("_sig"),
        F.when(plain, F.array_compact(F.array(*twin))).alias("_twins"), (F.coalesce("_impl", F.lit(0)) == 1).alias("after_impl"))
    ref = reports.select(*keys, F.col("best.stages").alias("ref_stages"), F.col("best.total").alias("ref_len"), F.col("best.retry_sigs").alias("ref_retries"),
                         F.col("m.al_seq").cast("array<bigint>").alias("_al"))
    df = df.join(ref, run)
    at = F.least(F.floor(F.col("seq") / F.greatest(F.col("n_steps"), F.lit(1)) * F.col("ref_len")),
                 F.col("ref_len") - 1).cast("int")
    first_i = F.instr("ref_stages", "I")
    expected = (F.substr("ref_stages", at + 1, F.lit(1)) == "E") & (first_i > 0) & (at + 1 > first_i)
    retry = F.col("_retry") & ~F.array_contains("ref_retries", F.col("_sig"))
    aligned = F.coalesce(F.array_contains("_al", F.col("seq").cast("long")), F.lit(False))
    near = F.coalesce(F.arrays_overlap("_twins", "_al"), F.lit(False))
    return df.select(
        *keys, "seq", *[c for c in FLAGGED if c in steps.columns], aligned.alias("aligned"), retry.alias("is_retry"), (retry & F.col("_fresh")).alias("retry_start"),
        F.coalesce(F.col("_back") & ~F.contains(F.col("ref_stages"), F.col("_pair")), F.lit(False)).alias("is_backtrack"),
        (~aligned & near).alias("is_redundant"), ((F.col("intent_stage") == "exploration") & F.col("after_impl") & ~expected).alias("is_late_exploration"), "after_impl")


def retry_loops(steps: DataFrame, reports: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Runs of three or more equal steps that are not also a run in the reference."""
    df = with_reference(steps, reports, keys)
    df = lagged(df, {"_s": (signature(), 1)}, keys)
    fresh = F.when(has_signature() & F.coalesce(F.col("_s") == signature(), F.lit(False)), 0).otherwise(1)
    df = running(df.withColumn("_new", fresh), {"_island": ("sum", F.col("_new"))}, keys, inclusive=True)
    loops = df.groupBy(*keys, "_island").agg(
        F.min("seq").alias("_a"), F.count(F.lit(1)).alias("count"), F.first("tool_used").alias("tool"),
        F.first("file_path").alias("file_path"), F.first(step_signature()).alias("_sig"),
        F.first("ref_retries").alias("_ok"))
    return loops.where((F.col("count") >= 3) & ~F.array_contains("_ok", F.col("_sig"))).select(
        *keys, (F.col("_a") + 1).alias("start_step"), (F.col("_a") + F.col("count")).alias("end_step"),
        "tool", "file_path", "count")


def backtracks(flags: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    return flags.where("is_backtrack").select(*keys, (F.col("seq") + 1).alias("step"),
                                              F.col("intent_stage").alias("to_stage"))


def raw_cycles(steps: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Repeating patterns of 2-4 steps: keys, plen, start, reps.

    A pattern of length p repeats where every step equals the one p later, so maximal runs
    of that equality (islands) are the raw material. Overlaps inside one length are settled
    left to right over the few islands a run has.
    """
    keys = list(keys)
    df = lagged(steps.withColumn("_sig", step_signature()), {f"_a{p}": ("_sig", -p) for p in PATTERN_LENGTHS}, keys)
    eq = [F.coalesce(F.col("_sig") == F.col(f"_a{p}"), F.lit(False)) for p in PATTERN_LENGTHS]
    df = df.select(*keys, "seq", "chunk", "n_steps", *[e.alias(f"_e{p}") for e, p in zip(eq, PATTERN_LENGTHS)])
    df = running(df, {f"_b{p}": ("sum", F.when(F.col(f"_e{p}"), 0).otherwise(1)) for p in PATTERN_LENGTHS}, keys)
    long = df.select(*keys, "seq", F.inline(F.array(*[F.struct(
        F.lit(p).alias("plen"), F.col(f"_e{p}").alias("e"), F.col(f"_b{p}").alias("b")) for p in PATTERN_LENGTHS]))) \
        .where("e")
    islands = long.groupBy(*keys, "plen", "b").agg(F.min("seq").alias("a"), F.count(F.lit(1)).alias("r")) \
        .where(F.col("r") >= F.col("plen"))
    # Greedy: an island starts no earlier than the end of the previous cycle.
    per = islands.groupBy(*keys, "plen").agg(F.array_sort(F.collect_list(F.struct("a", "r"))).alias("_i"))
    start = F.struct(F.lit(0).cast("long").alias("next"),
                     F.array().cast("array<struct<start:bigint,reps:bigint>>").alias("got"))

    def step(acc, x):
        a = F.greatest(x["a"], acc["next"])
        left = x["a"] + x["r"] - a
        reps = F.floor(left / F.col("plen")) + 1
        ok = left >= F.col("plen")
        return F.struct(F.when(ok, a + reps * F.col("plen")).otherwise(acc["next"]).alias("next"),
                        F.when(ok, F.concat(acc["got"], F.array(F.struct(a.alias("start"), reps.alias("reps")))))
                        .otherwise(acc["got"]).alias("got"))
    return per.select(*keys, "plen", F.explode(F.aggregate("_i", start, step)["got"]).alias("_c")).select(
        *keys, "plen", "_c.start", "_c.reps")


def with_pattern(cycles: DataFrame, steps: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Add the signature of a cycle's pattern and whether all its steps are equal."""
    keys = list(keys)
    at = cycles.withColumn("seq", F.explode(F.sequence("start", F.col("start") + F.col("plen") - 1)))
    sig = steps.select(*keys, "seq", step_signature().alias("_sig"))
    return at.join(sig, [*keys, "seq"]).groupBy(*keys, "plen", "start", "reps").agg(
        F.array_sort(F.collect_list(F.struct("seq", "_sig"))).alias("_x")).select(
        *keys, "plen", "start", "reps", F.array_join(F.transform("_x", lambda x: x["_sig"]), ";").alias("pattern"),
        (F.size(F.array_distinct(F.transform("_x", lambda x: x["_sig"]))) <= 1).alias("uniform"))


def reference_cycles(path_states: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Patterns that repeat on a reference path: keys, path_id, pattern."""
    from runloom.operators.scan import renumber
    k = [*keys, "path_id"]
    seq = renumber(path_states.drop("seq", "chunk", "n_steps").withColumnRenamed("pos", "seq"), k)
    return with_pattern(raw_cycles(seq, k), seq, k).select(*k, "pattern").distinct()


def cyclic_patterns(steps: DataFrame, reports: DataFrame, ref_cycles: DataFrame, ref_keys: Sequence[str] = ("task_id",),
                    keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Cycles of a run that its reference path does not show; found once per run, however many reports it has."""
    run = run_keys(steps, keys)
    found = with_pattern(raw_cycles(steps, run), steps, run).where(~F.col("uniform"))
    chosen = found.join(reports.select(*keys, F.col("best_path").alias("path_id")), run)
    return chosen.join(ref_cycles, [*ref_keys, "path_id", "pattern"], "left_anti").select(
        *keys, (F.col("start") + 1).alias("start_step"),
        (F.col("start") + F.col("plen") * F.col("reps")).alias("end_step"),
        F.col("plen").alias("pattern_length"), F.col("reps").alias("repetitions"))


def wasted_steps(flags: DataFrame, cycles: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """One row per wasted step with its first category: retry, cycle, redundant, unnecessary."""
    keys = list(keys)
    first = F.col("start_step") - 1 + F.col("pattern_length")
    extra = cycles.select(*keys, F.explode(F.sequence(first, F.col("end_step") - 1)).alias("seq")).distinct() \
        .withColumn("in_cycle", F.lit(True))
    j = flags.join(extra, [*keys, "seq"], "left")
    cat = F.when(F.col("is_retry"), "retries").when(F.col("in_cycle"), "cycles") \
        .when(F.col("is_redundant"), "redundant").when(F.col("is_late_exploration"), "unnecessary")
    return j.withColumn("waste", cat)


def waste_by_tool(wasted: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    tool = F.coalesce(F.nullif(blank("tool_used"), F.lit("")), F.lit("(unknown)"))
    return wasted.where("waste IS NOT NULL OR is_backtrack").groupBy(*keys, tool.alias("tool")).agg(
        *[F.count_if(F.col("waste") == c).alias(c) for c in CATEGORIES],
        F.count_if("is_backtrack").alias("backtracks"), F.count("waste").alias("total_wasted"))


def waste_totals(wasted: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Per run: distinct wasted steps, severity, and tokens spent on them."""
    in_tok = F.coalesce(F.col("input_tokens"), F.lit(0))
    out_tok = F.coalesce(F.col("output_tokens"), F.lit(0))
    bad = F.col("waste").isNotNull()
    return wasted.groupBy(*keys).agg(
        F.count("waste").alias("wasted_steps_distinct"), (F.count("waste") / F.count(F.lit(1))).alias("severity"),
        F.count_if("retry_start").alias("retry_loop_count"), F.count_if("is_retry").alias("blind_retry_waste"),
        F.count_if("is_backtrack").alias("backtrack_count"), F.count_if("is_redundant").alias("redundant_near_count"),
        F.count_if("is_late_exploration").alias("late_exploration_count"),
        F.sum(F.when(bad, in_tok).otherwise(0)).alias("wasted_input_tokens"),
        F.sum(F.when(bad, out_tok).otherwise(0)).alias("wasted_output_tokens"),
        F.sum(in_tok).alias("total_input_tokens"), F.sum(out_tok).alias("total_output_tokens"))


# --- dataset rules (against path 0) ------------------------------------------------------
def regression_loops(steps: DataFrame, first_paths: DataFrame, ref_keys: Sequence[str] = ("task_id",),
                     keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Spans from the first exploration after an implementation to the next implementation,
    at least two steps long and not at a place where the reference regresses too."""
    keys, run = list(keys), run_keys(steps, keys)
    impl = F.col("intent_stage") == "implementation"
    df = running(steps, {"_from": ("max", F.when(impl, F.col("seq")))}, run)
    gaps = df.where(F.col("_from").isNotNull()).groupBy(*run, "_from", "n_steps").agg(
        F.min(F.when(F.col("intent_stage") == "exploration", F.col("seq"))).alias("e"),
        F.min(F.when(impl, F.col("seq"))).alias("to"))
    spans = gaps.where((F.col("to") - F.col("e")) >= 2).join(
        first_paths.select(*ref_keys, F.col("first.stages").alias("_ref")), run_keys(steps, ref_keys))
    # The place counts every reference state; states without a stage only drop out of the pattern.
    at = F.floor(F.col("e") / F.greatest(F.col("n_steps"), F.lit(1)) * F.length("_ref")).cast("int")
    upto = F.replace(F.substr("_ref", F.lit(1), at + 1), F.lit("-"), F.lit(""))
    return spans.where(~upto.rlike("EI[VO]*E$")).select(
        *keys, F.col("e").alias("start_seq"), (F.col("to") - F.col("e")).alias("steps"))


def redundant_reads(steps: DataFrame, first_paths: DataFrame, ref_keys: Sequence[str] = ("task_id",),
                    keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Per run: repeated exploration of a file with no implementation between; files the
    reference explores twice or more are exempt. A run is read once, and meets every reference of ``ref_keys``."""
    keys, run = list(keys), run_keys(steps, keys)
    df = running(steps, {"_epoch": ("sum", F.when(F.col("intent_stage") == "implementation", 1).otherwise(0))}, run)
    reads = df.where((F.col("intent_stage") == "exploration") & (blank("file_path") != "")).groupBy(
        *run, "_epoch", "file_path").agg((F.count(F.lit(1)) - 1).alias("_n")).where("_n > 0")
    ok = first_paths.select(*ref_keys, F.col("first.multi_read").alias("_ok"))
    kept = reads.join(ok, run_keys(steps, ref_keys), "left").where(~F.coalesce(F.array_contains("_ok", F.col("file_path")), F.lit(False)))
    return kept.groupBy(*keys).agg(F.sum("_n").alias("redundant_step_count"))


def unnecessary_exploration(flags: DataFrame, ref_files: DataFrame, ref_keys: Sequence[str] = ("task_id",),
                            keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Per run: exploration after implementation of non-test files unknown to the reference."""
    file = blank("file_path")
    far = flags.where((F.col("intent_stage") == "exploration") & F.col("after_impl") & (file != "")
                      & ~F.lower(file).rlike("test|spec"))
    return far.join(ref_files, [*ref_keys, "file_path"], "left_anti").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unnecessary_exploration_count"))


def waste_summary(runs: DataFrame, totals: DataFrame, regressions: DataFrame, redundant: DataFrame,
                  unnecessary: DataFrame, cycles: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Five waste kinds per run. ``total_wasted_steps`` adds them up and may count a step
    twice; ``wasted_steps_distinct`` does not."""
    keys = list(keys)
    reg = regressions.groupBy(*keys).agg(F.count(F.lit(1)).alias("regression_loop_count"),
                                         F.sum("steps").alias("regression_loop_waste"))
    cyc = cycles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cyclic_pattern_count"),
        F.sum(F.col("pattern_length") * (F.col("repetitions") - 1)).alias("cyclic_pattern_waste"))
    out = runs
    for part in (totals, reg, redundant, unnecessary, cyc):
        out = out.join(part, keys, "left")
    counts = ["regression_loop_count", "regression_loop_waste", "redundant_step_count", "unnecessary_exploration_count",
              "cyclic_pattern_count", "cyclic_pattern_waste", "retry_loop_count", "blind_retry_waste",
              "wasted_steps_distinct", "wasted_input_tokens", "wasted_output_tokens"]
    out = out.fillna(0, counts)
    total = (F.col("regression_loop_waste") + F.col("blind_retry_waste") + F.col("redundant_step_count")
             + F.col("unnecessary_exploration_count") + F.col("cyclic_pattern_waste"))
    return out.withColumn("total_wasted_steps", total)
