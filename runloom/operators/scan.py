"""Ordered scans over long sequences, split into chunks.

A run may be far longer than one task should sort, so ordered features are
computed inside fixed-size chunks ``(keys, chunk)`` and stitched together:

* ``number_rows``  assigns the position of every row without sorting a whole key
  in one place: rows are numbered inside small order buckets, and bucket offsets
  come from a running sum over per-bucket counts.
* ``lagged``  copies the last rows of a chunk to the next one (a halo), so
  ``lag`` sees its neighbour.
* ``running`` keeps a running sum/min/max per chunk and adds the carry of the
  chunks before it, taken from one summary row per chunk.

Keys with a single chunk contribute nothing to the carry side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_KEYS = ("task_id", "trajectory_id")
CHUNK_ROWS = 4096


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``seq`` (0-based position), ``n_steps`` and ``chunk`` per key.

    ``bucket`` must never decrease along ``order``; it bounds the size of a sort.
    """
    keys = list(keys)
    b = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (b.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .withColumn("n_steps", F.sum("_n").over(by_key)).drop("_n"))
    return (b.withColumn("_rn", F.row_number().over(local).cast("long"))
            .join(offsets, [*keys, "_bucket"])
            .withColumn("seq", F.col("_off") + F.col("_rn") - 1)
            .withColumn("chunk", F.floor(F.col("seq") / chunk_rows))
            .drop("_bucket", "_off", "_rn"))


def renumber(df: DataFrame, keys: Sequence[str] = RUN_KEYS, chunk_rows: int = CHUNK_ROWS,
             seq: str = "seq") -> DataFrame:
    """Close the gaps in ``seq`` after a filter; refreshes ``n_steps`` and ``chunk``."""
    base = df.drop("n_steps", "chunk")
    return number_rows(base.withColumnRenamed(seq, "_old"), keys, ["_old"],
                       F.floor(F.col("_old") / chunk_rows), chunk_rows).drop("_old")


def chunk_window(keys: Sequence[str] = RUN_KEYS):
    return Window.partitionBy(*keys, "chunk").orderBy("seq")


def lagged(df: DataFrame, columns: dict[str, tuple[str | Column, int]],
           keys: Sequence[str] = RUN_KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``out: (column, offset)``; offset > 0 looks back, < 0 looks ahead."""
    back = max([o for _, o in columns.values() if o > 0], default=0)
    ahead = -min([o for _, o in columns.values() if o < 0], default=0)
    pos = F.pmod(F.col("seq"), F.lit(chunk_rows))
    places = [F.struct(F.col("chunk").alias("c"), F.lit(False).alias("h"))]
    if back:
        places.append(F.when(pos >= chunk_rows - back,
                             F.struct((F.col("chunk") + 1).alias("c"), F.lit(True).alias("h"))))
    if ahead:
        places.append(F.when((pos < ahead) & (F.col("chunk") > 0),
                             F.struct((F.col("chunk") - 1).alias("c"), F.lit(True).alias("h"))))
    spread = (df.withColumn("__place", F.explode(F.array_compact(F.array(*places))))
              .withColumn("chunk", F.col("__place.c")))
    w = chunk_window(keys)
    for out, (value, offset) in columns.items():
        value = F.col(value) if isinstance(value, str) else value
        spread = spread.withColumn(out, F.lag(value, offset).over(w) if offset > 0
                                   else F.lead(value, -offset).over(w))
    return spread.where(~F.col("__place.h")).drop("__place")


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, columns: dict[str, tuple[str, Column]],
            keys: Sequence[str] = RUN_KEYS, inclusive: bool = False,
            chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add running aggregates ``out: (sum|min|max, value)`` over earlier rows.

    ``inclusive`` counts the row itself. Sums start at 0, min/max at null.
    """
    keys = list(keys)
    w = chunk_window(keys).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = df
    for out, (kind, value) in columns.items():
        local = local.withColumn(out, _AGG[kind](value).over(w))
    totals = (df.where(F.col("n_steps") > chunk_rows).groupBy(*keys, "chunk")
              .agg(*[_AGG[k](v).alias(f"_t_{o}") for o, (k, v) in columns.items()]))
    earlier = (Window.partitionBy(*keys).orderBy("chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*keys, "chunk", *[_AGG[k](f"_t_{o}").over(earlier).alias(f"_c_{o}")
                                            for o, (k, _) in columns.items()])
    joined = local.join(carry, [*keys, "chunk"], "left")
    for out, (kind, _) in columns.items():
        here, past = F.col(out), F.col(f"_c_{out}")
        if kind == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        else:
            value = (F.greatest if kind == "max" else F.least)(here, past)
        joined = joined.withColumn(out, value)
    return joined.drop(*[f"_c_{o}" for o in columns])


def task_count(df: DataFrame) -> int:
    """Tasks to use where work per row is heavy but bytes are few: what the session asks of
    a shuffle, and at least every core once."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Rebalance rows that arrive in fewer splits than there are cores.

    For table scans only: counting the splits of a plan with shuffles would run them. Large
    inputs come in many splits and pass through unchanged. The explicit count also keeps
    adaptive execution from merging small but costly partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def by_group(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash rows by group for per-group Python work, one shuffle, not merged afterwards."""
    return df.repartition(task_count(df), *keys)
