"""Match candidate runs against reference paths.

Data layout: the paths of one reference travel as one small row (at most the path cap
times the path length), and every run is one row holding, per step, the ids of equivalent
reference contents. The greedy one-to-one and ordered scans are sequential by definition,
so they run on those rows in Arrow batches; ranking and all scores are column expressions
on the result, with no further shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from runloom.functions import text as T
from runloom.functions.text import blank
from runloom.operators import features as X
from runloom.operators.features import ALPHA, LETTERS, SEGMENTS
from runloom.operators.intent import STAGES, stage_letter
from runloom.plans.store import written

INTS = ArrayType(IntegerType())
MATCH = StructType([StructField(n, INTS) for n in ("set_pos", "set_seq", "sub_pos", "sub_seq", "al_pos", "al_seq")]
                   + [StructField("terminal", BooleanType())])

# Stage weights of the weighted score, by letter.
WEIGHTS = {"I": 3.0, "V": 2.0, "E": 1.0, "O": 0.5}
# Edit tools for required files; creation counts for candidates only.
REQUIRED_EDITS = ("replace_string_in_file", "multi_replace_string_in_file", "apply_patch", "edit_file")
CANDIDATE_EDITS = REQUIRED_EDITS + ("create_file",)


# --- reference side ----------------------------------------------------------------------
def reference_ids(ref_states: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Small integer per distinct reference content of a task."""
    keys = list(keys)
    return ref_states.select(*keys, "sig").distinct().withColumn(
        "rid", F.row_number().over(Window.partitionBy(*keys).orderBy("sig")))


def closed_positions(path_states: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Path states without requests, ``pos`` renumbered as the matcher counts. One path is one group."""
    steps = path_states.where(~F.col("kind").eqNullSafe("request"))
    place = F.row_number().over(Window.partitionBy(*keys, "path_id").orderBy("pos")) - 1
    return steps.withColumn("pos", place.cast("int"))


def reference_paths(path_states: DataFrame, ids: DataFrame, keys: Sequence[str],
                    id_keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """One row per reference: ``paths`` = array of (path_id, rids, stages, n_stages, total).

    ``path_states`` holds keys, path_id, pos and the state columns with ``sig``; requests
    are dropped and positions closed up. ``stages`` is one letter per position.
    """
    keys = list(keys)
    letter = F.when(blank("intent_stage") == "", "-").otherwise(stage_letter(F.col("intent_stage")))
    one = (path_states.where(~F.col("kind").eqNullSafe("request")).join(ids, [*id_keys, "sig"])
           .groupBy(*keys, "path_id").agg(F.array_sort(F.collect_list(F.struct(
               "pos", "rid", letter.alias("s"), blank("tool_used").alias("tool"),
               blank("file_path").alias("file")))).alias("_x")))
    x = F.col("_x")
    stages = F.array_join(F.transform(x, lambda p: p["s"]), "")
    sigs = F.transform(x, lambda p: F.concat_ws("|", p["tool"], p["file"], p["s"]))
    retries = F.array_distinct(F.filter(F.transform(sigs, lambda s, i: F.when(
        (i >= 2) & (F.get(sigs, i - 1) == s) & (F.get(sigs, i - 2) == s) & (s != "||-"), s)),
        lambda s: s.isNotNull()))
    explored = F.transform(F.filter(x, lambda p: (p["s"] == "E") & (p["file"] != "")), lambda p: p["file"])
    multi = F.array_distinct(F.filter(explored, lambda f: F.size(F.filter(explored, lambda g: g == f)) >= 2))
    row = one.select(*keys, F.struct(
        "path_id", F.transform(x, lambda p: p["rid"]).alias("rids"), stages.alias("stages"),
        F.size(F.array_distinct(F.filter(F.transform(x, lambda p: p["s"]), lambda s: s != "-"))).alias("n_stages"),
        F.size(x).alias("total"), retries.alias("retry_sigs"), multi.alias("multi_read")).alias("p"))
    return row.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("paths"))


# --- candidate side ------------------------------------------------------------------------
def candidate_hits(cand: DataFrame, pairs: DataFrame, ids: DataFrame,
                   keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """One row per run: ``n_cand`` and, aligned, step positions and the reference ids they match."""
    keys = list(keys)
    link = (pairs.join(ids.withColumnRenamed("sig", "ref_sig"), [*keys, "ref_sig"])
            .groupBy(*keys, F.col("cand_sig").alias("sig")).agg(F.collect_set("rid").alias("rids")))
    rows = cand.select(*keys, "trajectory_id", "seq", "sig").join(link, [*keys, "sig"], "left")
    hit = F.when(F.size("rids") > 0, F.struct(F.col("seq").cast("int").alias("seq"), "rids"))
    per_run = rows.groupBy(*keys, "trajectory_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_cand"), F.array_sort(F.collect_list(hit)).alias("_h"))
    return per_run.select(*keys, "trajectory_id", "n_cand", F.flatten(F.transform(
        "_h", lambda h: F.array_repeat(h["seq"], F.size(h["rids"])))).alias("hit_seq"),
        F.flatten(F.transform("_h", lambda h: h["rids"])).alias("hit_rid"))


def _by_rid(seqs, rids) -> dict[int, list[int]]:
    hits: dict[int, list[int]] = {}
    for s, r in zip(seqs.tolist(), rids.tolist()):
        hits.setdefault(r, []).append(s)
    return hits


def greedy_set(path, hits, n) -> tuple[list[int], list[int]]:
    """Each reference position takes the first unused equivalent step; position 0 takes step 0."""
    pos, seqs, used = [], [], set()
    for i, rid in enumerate(path):
        if i == 0:
            choice = 0 if n else None
        else:
            choice = next((s for s in hits.get(rid, ()) if s not in used), None)
        if choice is not None:
            pos.append(i)
            seqs.append(choice)
            used.add(choice)
    return pos, seqs


def greedy_set_counts(paths, hits, n) -> list[int]:
    """Positions that ``greedy_set`` matches in each path. A choice depends on the path before it only, so a path
    goes on from where it leaves the one listed before; depth-first neighbours share most of their way."""
    out, before, chosen = [], [], []
    for path in paths:
        same = 0
        for a, b in zip(path, before):
            if a != b:
                break
            same += 1
        del chosen[same:]
        used = {c for c in chosen if c is not None}
        for i in range(same, len(path)):
            choice = (0 if n else None) if i == 0 else next((s for s in hits.get(path[i], ()) if s not in used), None)
            chosen.append(choice)
            if choice is not None:
                used.add(choice)
        out.append(len(used))
        before = path
    return out


def greedy_ordered(path, hits, n, positions=None) -> tuple[list[int], list[int]]:
    """Each position takes the first equivalent step after the previous one; stops at a miss."""
    pos, seqs, cursor = [], [], 0
    for i in (range(len(path)) if positions is None else positions):
        if i == 0:
            choice = cursor if cursor < n else None
        else:
            have = hits.get(path[i], ())
            at = bisect_left(have, cursor)
            choice = have[at] if at < len(have) else None
        if choice is None:
            break
        pos.append(i)
        seqs.append(choice)
        cursor = choice + 1
    return pos, seqs


@pandas_udf(INTS)
def set_counts(seqs: pd.Series, rids: pd.Series, n: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([greedy_set_counts([p.tolist() for p in ps], _by_rid(s, r), m) for s, r, m, ps in zip(seqs, rids, n, paths)])


@pandas_udf(INTS)
def ordered_counts(seqs: pd.Series, rids: pd.Series, n: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([[len(greedy_ordered(p.tolist(), h, m)[0]) for p in ps] for h, m, ps in
                      ((_by_rid(s, r), m, ps) for s, r, m, ps in zip(seqs, rids, n, paths))])


@pandas_udf(MATCH)
def match_one(seqs: pd.Series, rids: pd.Series, n: pd.Series, path: pd.Series) -> pd.DataFrame:
    """Set match, ordered match and alignment of one run with one path."""
    out = []
    for s, r, m, p in zip(seqs, rids, n, path):
        hits, p = _by_rid(s, r), p.tolist()
        pos, seq = greedy_set(p, hits, m)
        sub = greedy_ordered(p, hits, m)
        al = greedy_ordered(p, hits, m, pos)
        last = bool(p) and m > 0 and (len(p) == 1 or (m - 1) in hits.get(p[-1], ()))
        out.append((pos, seq, *sub, *al, last))
    return pd.DataFrame(out, columns=["set_pos", "set_seq", "sub_pos", "sub_seq", "al_pos", "al_seq", "terminal"])


def with_paths(hits: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the reference paths; a run whose task has none gets one empty path, so it stays and
    scores zero. ``n_paths`` counts the real ones. Where ``refs`` name the runs that a graph was made of
    (``donors``), these are not matched with it."""
    on = [k for k in keys if k in hits.columns]
    kind = refs.schema["paths"].dataType.elementType
    given = {"path_id": F.lit(-1), "stages": F.lit(""), "n_stages": F.lit(0), "total": F.lit(0)}
    none = F.struct(*[given.get(f.name, F.array()).cast(f.dataType).alias(f.name) for f in kind.fields])
    met = hits.join(refs, on, "left")
    if "donors" in refs.columns:
        met = met.where(~F.coalesce(F.array_contains("donors", F.col("trajectory_id")), F.lit(False))).drop("donors")
    return met.withColumn("n_paths", F.coalesce(F.size("paths"), F.lit(0))).withColumn(
        "n_paths", F.greatest("n_paths", F.lit(0))).withColumn("paths", F.coalesce("paths", F.array(none)))


def path_counts(hits: DataFrame, refs: DataFrame, keys: Sequence[str], ordered: bool = False) -> DataFrame:
    """Matched count of every (run, reference path)."""
    fn = ordered_counts if ordered else set_counts
    j = with_paths(hits, refs, keys)
    j = j.withColumn("matched", fn("hit_seq", "hit_rid", "n_cand", F.transform("paths", lambda p: p["rids"])))
    return j


def _ratio(part, whole):
    """``part / whole``, zero for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def best_match(hits: DataFrame, refs: DataFrame, keys: Sequence[str] = ("task_id",),
               strategy: str = "best_match") -> DataFrame:
    """Pick the reference path of every run and match it.

    Order of preference: distinct stages, matched, coverage, length, first listed. With
    ``canonical`` the choice ignores the candidate. ``ordered`` matching is reported beside
    the set matching on the chosen path.
    """
    j = with_paths(hits, refs, keys)
    if strategy == "canonical":
        rank = F.transform("paths", lambda p, i: F.struct(
            p["n_stages"], p["total"], (-i).alias("first"), p.alias("p")))
    elif strategy == "best_match":
        j = j.withColumn("_m", set_counts("hit_seq", "hit_rid", "n_cand",
                                          F.transform("paths", lambda p: p["rids"])))
        rank = F.transform("paths", lambda p, i: F.struct(
            p["n_stages"], F.get("_m", i).alias("m"), _ratio(F.get("_m", i), p["total"]).alias("c"),
            p["total"], (-i).alias("first"), p.alias("p")))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    j = j.withColumn("best", F.array_max(rank)["p"]).drop("paths", "_m")
    # Written: else each score that reads a field of the chosen path would choose it again among all paths.
    return written(j.withColumn("m", match_one("hit_seq", "hit_rid", "n_cand", "best.rids")).drop("hit_seq", "hit_rid"), "best")


# --- scores ------------------------------------------------------------------------------
def letter_count(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def letter_segments(s: Column, n: int = SEGMENTS) -> list[Column]:
    """``s`` cut into n pieces of equal length; the last takes the rest."""
    size = F.greatest(F.lit(1), F.floor(F.length(s) / n)).cast("int")
    return [F.substr(s, size * k + 1, size if k < n - 1 else F.length(s)) for k in range(n)]


def letter_profile_score(a: Column, b: Column, n: int = SEGMENTS) -> Column:
    """Temporal profile similarity of two letter strings; the arrays hold the smoothed
    stage shares of all segments in a row."""
    def shares(s):
        return F.flatten(F.transform(F.array(*letter_segments(s, n)), lambda piece: F.array(*[
            (letter_count(piece, x) + ALPHA) / (F.length(piece) + 4 * ALPHA) for x in LETTERS])))
    terms = F.zip_with(shares(a), shares(b), lambda p, q: 0.5 * p * F.log2(2 * p / (p + q))
                       + 0.5 * q * F.log2(2 * q / (p + q)))
    mean = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / n
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.greatest(F.lit(0.0), 1.0 - mean)).otherwise(0.0)


def match_metrics(best: DataFrame, run_features: DataFrame | None = None, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Scores of every run against its chosen path.

    ``run_features`` carries task_id, trajectory_id, fingerprint and coherence_score; without it ``best`` has
    them already, as where a run meets many references. The nested ``best`` and ``m`` columns stay, so later steps can use stages and alignment.
    """
    j = best if run_features is None else best.join(run_features, ["task_id", "trajectory_id"])
    stages = F.col("best.stages")
    hit = F.array_join(F.transform("m.set_pos", lambda p: F.substr(stages, p + 1, F.lit(1))), "")
    j = j.withColumn("_hit", hit)
    total = {x: letter_count(stages, x) for x in LETTERS}
    got = {x: letter_count(F.col("_hit"), x) for x in LETTERS}
    cov = {x: F.when(total[x] > 0, got[x] / total[x] * 100.0) for x in LETTERS}
    j = j.select("*", *[total[x].alias(f"total_{x}") for x in LETTERS], *[got[x].alias(f"matched_{x}") for x in LETTERS],
                 *[cov[x].alias(f"stage_coverage_{x}") for x in LETTERS])
    present = sum(F.when(F.col(f"total_{x}") > 0, 1).otherwise(0) for x in LETTERS)
    covered = sum(F.when(F.col(f"matched_{x}") > 0, 1).otherwise(0) for x in LETTERS)
    den = sum(F.col(f"total_{x}") * WEIGHTS[x] for x in LETTERS)
    num = sum(F.col(f"matched_{x}") * WEIGHTS[x] for x in LETTERS)
    matched, size, n = F.size("m.set_pos"), F.col("best.total"), F.col("n_cand")
    recall, precision = _ratio(matched, size) * 100.0, _ratio(matched, n) * 100.0
    low = F.least(*[F.col(f"stage_coverage_{x}") for x in LETTERS])
    at = F.lit(None).cast("string")
    for x, s in reversed(list(zip(LETTERS, STAGES))):
        at = F.when(F.col(f"stage_coverage_{x}") == low, s).otherwise(at)
    keep = [c for c in j.columns if c != "_hit"]
    j = j.select("*", F.replace(stages, F.lit("-"), F.lit("")).alias("_ref"),
                 F.regexp_replace(blank("fingerprint"), "[^EIVO]", "").alias("_run"),
                 F.when(size > 0, F.array_except(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), F.col("m.set_pos"))).otherwise(
                     F.array().cast("array<int>")).alias("missing_steps"))
    labelled, letters, missing = F.col("_ref"), F.col("_run"), F.col("missing_steps")
    return j.select(
        *keep, "missing_steps",
        matched.alias("matched_count"), size.alias("total_ref_states"), F.col("best.path_id").alias("best_path"),
        recall.alias("coverage_percent"), precision.alias("precision_percent"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1_score"),
        F.col("m.terminal").alias("terminal_match"), ((matched == size) & (size > 0)).alias("perfect_match"),
        F.when(present > 0, covered / present).when(size > 0, 1.0).otherwise(0.0).alias("stage_completeness"),
        F.when(den > 0, num / den * 100.0).otherwise(0.0).alias("weighted_score"),
        F.coalesce(low, F.lit(0.0)).alias("bottleneck_coverage"), F.coalesce(at, F.lit("")).alias("bottleneck_stage"),
        X.workflow_similarity(letters, labelled).alias("workflow_similarity"),
        letter_profile_score(letters, labelled).alias("temporal_profile_score"),
        F.size("m.sub_pos").alias("ordered_matched"), F.size("m.al_pos").alias("aligned_count"),
        F.get(missing, F.lit(0)).alias("divergence_index"))


def run_features(cand: DataFrame) -> DataFrame:
    """Features of candidate runs the match scores need."""
    coh = X.coherence(cand).select("task_id", "trajectory_id", "coherence_score", "transitions", "blind_retries")
    return coh.join(X.fingerprint(cand), ["task_id", "trajectory_id"], "left")


def alignment(best: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """One row per candidate step: the reference position it is aligned with, if any."""
    steps = best.where("n_cand > 0").select(*keys, "trajectory_id", F.explode(F.sequence(F.lit(0), F.col("n_cand") - 1)).alias("seq"))
    at = best.select(*keys, "trajectory_id", F.explode(F.arrays_zip(F.col("m.al_seq").alias("seq"), F.col("m.al_pos").alias("ref_pos"))).alias("z")) \
        .select(*keys, "trajectory_id", "z.seq", "z.ref_pos")
    return steps.join(at, [*keys, "trajectory_id", "seq"], "left").select(
        *keys, "trajectory_id", "seq", F.col("ref_pos").isNotNull().alias("matched"), "ref_pos")


def required_files(ref_states: DataFrame, keys: Sequence[str] = ("task_id",), tools=REQUIRED_EDITS) -> DataFrame:
    """Files edited in the reference, normalised, one row each."""
    raw = F.coalesce(F.nullif(F.trim(blank("file_path")), F.lit("")), blank("path_arg"))
    return (ref_states.where(F.col("tool_used").isin(*tools))
            .select(*keys, F.explode(F.split(raw, ",")).alias("_f"))
            .select(*keys, T.norm_match_path(F.trim("_f")).alias("file")).where("file <> ''").distinct())


def _share(required: DataFrame, used: DataFrame, runs: DataFrame, item: str, name: str,
           keys: Sequence[str]) -> DataFrame:
    """Share of required items a run uses, and the missing ones."""
    keys = list(keys)
    need = required.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("_need"))
    have = used.join(required, [*keys, item], "left_semi").groupBy(*keys, "trajectory_id").agg(
        F.collect_set(item).alias("_have"))
    j = runs.join(need, keys, "left").join(have, [*keys, "trajectory_id"], "left")
    empty = F.array().cast("array<string>")
    missing = F.array_except(F.coalesce("_need", empty), F.coalesce("_have", empty))
    size = F.size(F.coalesce("_need", empty))
    return j.select(*keys, "trajectory_id", F.when(size == 0, 1.0).otherwise((size - F.size(missing)) / size)
                    .alias(name), F.array_join(F.array_sort(missing), ",").alias(f"missing_{item}s"))


def process_coverage(cand: DataFrame, required: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    keys = list(keys)
    tool = F.trim(F.substring_index(blank("tool_used"), "[", 1))
    used = cand.where(~blank("tool_used").isin("", "llm")).select(*keys, "trajectory_id", tool.alias("tool")).distinct()
    return _share(required, used, cand.select(*keys, "trajectory_id").distinct(), "tool", "process_coverage", keys)


def edited_files(cand: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Files that runs edit, normalised: keys, trajectory_id, file."""
    raw = F.coalesce(F.nullif(F.trim(blank("file_path")), F.lit("")), blank("path_arg"))
    return (cand.where(F.col("tool_used").isin(*CANDIDATE_EDITS))
            .select(*keys, "trajectory_id", F.explode(F.split(raw, ",")).alias("_f"))
            .select(*keys, "trajectory_id", T.norm_match_path(F.trim("_f")).alias("file")).where("file <> ''").distinct())


def file_coverage(cand: DataFrame, required: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    keys = list(keys)
    return _share(required, edited_files(cand, keys), cand.select(*keys, "trajectory_id").distinct(), "file", "file_coverage", keys)


def batch_compare(hits: DataFrame, refs: DataFrame, keys: Sequence[str] = ("task_id",), min_length: int = 3) -> DataFrame:
    """Ordered matching against every path of at least ``min_length`` states (all, if none is).

    The first path with the highest coverage wins.
    """
    j = with_paths(hits, refs, keys)
    long = F.filter("paths", lambda p: p["total"] >= min_length)
    j = j.withColumn("paths", F.when(F.size(long) > 0, long).otherwise(F.col("paths")))
    j = j.withColumn("_m", ordered_counts("hit_seq", "hit_rid", "n_cand", F.transform("paths", lambda p: p["rids"])))
    rank = F.transform("paths", lambda p, i: F.struct(
        _ratio(F.get("_m", i), p["total"]).alias("c"), (-i).alias("first"), F.get("_m", i).alias("m"), p.alias("p")))
    j = j.withColumn("_b", F.array_max(rank))
    j = j.withColumn("m", match_one("hit_seq", "hit_rid", "n_cand", "_b.p.rids"))
    return j.select(*keys, "trajectory_id", F.col("_b.p.path_id").alias("path_id"), F.col("_b.m").alias("matched"),
                    F.col("_b.p.total").alias("total"), F.round(F.col("_b.c") * 100, 2).alias("coverage_percent"),
                    F.col("m.terminal").alias("terminal_match"), ((F.col("_b.m") == F.col("_b.p.total")) & (F.col("n_paths") > 0)).alias("perfect_match"))
