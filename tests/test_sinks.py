from pyspark.sql import functions as F

from runloom.sources import sinks


def test_reports_have_one_file_a_task(spark, tmp_path):
    """Rows of every task in every partition: files as many as tasks, and all reports back."""
    df = spark.range(0, 400, 1, 8).select((F.col("id") % 20).cast("int").alias("task_id"), F.concat(F.lit('{"n":'), F.col("id"), F.lit("}")).alias("report"))
    path = str(tmp_path / "reports")
    sinks.write_reports(df, path)
    assert len(list((tmp_path / "reports").rglob("part-*"))) == 20
    assert sorted(spark.read.text(path).select("task_id", F.col("value").alias("report")).collect()) == sorted(df.collect())
