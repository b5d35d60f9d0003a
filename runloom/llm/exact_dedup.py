"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

1. A frequent-items sketch (the mergeable Misra-Gries family) over a 64-bit text hash names every
   value that fills more than 1/HEAVY_SHARE of the rows. Sketches of tasks are merged per slice of
   the input, ``SLICES`` in all, and the slices' short lists are added up.
2. Candidates are counted exactly on the full key. Those above the share win: at most
   ``HEAVY_SHARE`` rows, so their table can always be broadcast, and copies of a hot text are
   resolved where they are read, without a shuffle.
3. All other rows meet in an ordinary shuffle on their digest; no group there is hot.

The key is SHA-256, a second independent 64-bit hash and the byte length; texts count as equal
when all three agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.plans.store import written

HEAVY_SHARE = 2048
#: Items per sketch. Its error is 3.5 / COUNTERS of the rows and it reports what lies two errors
#: above zero, 1/2340 of the rows, which is below 1 / HEAVY_SHARE: no heavy value is missed.
COUNTERS = 16384
#: Least share of a heavy value after these errors: 1/2048 - 1/2340.
CANDIDATE_SHARE = 20_000
SLICES = 64
KEY = ["x", "d", "n"]


def heavy_values(hashes: DataFrame, column: str, counters: int = COUNTERS, slices: int = SLICES) -> DataFrame:
    """Distinct frequent values of a long column, with a count that is low by 1/2340 of all rows at most.

    Each slice has one sketch. A value above 1/HEAVY_SHARE of all rows is above it in some slice, so
    the slices' lists together hold every such value; their counts add up.
    """
    per_slice = (hashes.select(F.pmod(F.spark_partition_id(), F.lit(slices)).alias("s"), F.col(column).alias("v"))
                 .groupBy("s").agg(F.expr(f"approx_top_k_accumulate(v, {counters})").alias("k")))
    top = per_slice.select(F.explode(F.expr(f"approx_top_k_estimate(k, {2 * HEAVY_SHARE})")).alias("e"))
    return top.groupBy(F.col("e.item").alias(column)).agg(F.sum("e.count").alias("about"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The largest id of a group stays. Rows that repeat an id with the
    same text are all marked as the id is; a group without any id has a null keep_id and keeps its
    rows. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    keyed = rows.select("doc_id", F.xxhash64("t").alias("x"), F.unhex(F.sha2("t", 256)).alias("d"),
                        F.octet_length("t").alias("n"))
    hashes = rows.select(F.xxhash64("t").alias("x"))
    total = docs.count()
    # At most CANDIDATE_SHARE longs, as their counts add up to no more than the rows; hence the broadcast.
    names = heavy_values(hashes, "x").where(F.col("about") * CANDIDATE_SHARE > total).select("x")
    counted = (keyed.join(F.broadcast(names), "x").groupBy(*KEY)
               .agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
               .where((F.col("group_size") * HEAVY_SHARE > total) & (F.col("group_size") > 1)))
    winners = written(counted, "heavy")
    heavy = keyed.join(F.broadcast(winners), KEY)
    rest = keyed.join(F.broadcast(winners.select(*KEY)), KEY, "left_anti")
    groups = (rest.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
              .where("group_size > 1"))
    light = rest.join(groups, KEY, "left")
    single = F.col("group_size").isNull()

    def shaped(df: DataFrame, keep, size) -> DataFrame:
        return df.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("d")).alias("text_sha256"))

    return shaped(heavy, F.col("keep_id"), F.col("group_size")).unionByName(
        shaped(light, F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")),
               F.coalesce("group_size", F.lit(1))))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows that repeat id and text, each stays."""
    keep = exact_groups(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("_keep_id"), "text_sha256").distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_keep_id"),
                         F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    on = packed["_keep_id"].eqNullSafe(keep["_keep_id"]) & (packed["text_sha256"] == keep["text_sha256"])
    return packed.join(keep, on, "left_semi").select("row.*")
