from pyspark.sql import functions as F

from panelwright.operators.cleaning import clean
from panelwright.streaming.append import append_panel, stream_rows


def test_files_are_appended_once(spark, tmp_path):
    made = spark.range(20).select(F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, cast(id % 4 as int))").alias("ts"), (F.col("id") % 5).alias("entity"), F.when(F.col("id") != 3, F.col("id").cast("double")).alias("x"))
    made.write.parquet(str(tmp_path / "in/a"))
    made.filter("x < 8").write.parquet(str(tmp_path / "in/b"))  # repeats
    run = lambda: append_panel(stream_rows(spark, str(tmp_path / "in/*"), made.schema), ["ts", "entity"], "ts", "10 days", str(tmp_path / "out"), str(tmp_path / "check"), lambda p: clean(p, [("constant_fill", {"columns": ["x"], "value": -1.0})]))
    run().awaitTermination()
    run().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20 and out.filter("x is null").isEmpty() and out.select("day").distinct().count() == 4
