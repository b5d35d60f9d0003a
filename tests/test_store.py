from pyspark.sql import functions as F

from runloom.plans import store


def _final_plan(left, right):
    """The plan that ran, after adaptive execution."""
    out = left.join(right, "id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.array_append("texts", F.col("text")))))
    rows = out.collect()
    return rows[0].n, out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_broadcasts_go_by_rows_not_by_files(spark):
    """A staged table of 100,000 long rows that parquet keeps in about a MB is not broadcast; a small one is."""
    def rows(n):
        return spark.range(n).withColumn("texts", F.array_repeat(F.lit("x" * 40), 10))
    long, short = (store.staged(spark, name, "test_store", lambda n=n: rows(n)) for name, n in (("long", 100_000), ("short", 50)))
    probe = spark.range(2_000_000).withColumn("text", F.lit("y"))
    n, plan = _final_plan(probe, long)
    assert n == 100_000 and "BroadcastHashJoin" not in plan
    n, plan = _final_plan(probe, short)
    assert n == 50 and "BroadcastHashJoin" in plan


def test_each_broadcast_is_small(spark):
    """Rows of some MB, below Spark's own limit of 10 MB, are not broadcast; a lower limit of the session holds."""
    mid = store.staged(spark, "mid", "test_store", lambda: spark.range(10_000).withColumn("texts", F.array_repeat(F.lit("x" * 40), 10)))
    n, plan = _final_plan(spark.range(2_000_000).withColumn("text", F.lit("y")), mid)
    assert n == 10_000 and "BroadcastHashJoin" not in plan
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for limit, want in (("10m", str(store.BROADCAST_BYTES)), ("256k", str(256 << 10))):
        other = spark.newSession()
        other.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        store.joins_by_size(other)
        store.joins_by_size(other)
        assert other.conf.get(adaptive) == want and other.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
