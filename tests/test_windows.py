"""Window frames in the form that larger tables need."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.operators import windows
from sluice.plans.registry import load


def test_remaining_counts_like_the_frame_it_stands_for(spark):
    df = spark.createDataFrame([(p, o, i) for i, (p, o) in enumerate([(1, "b"), (1, "a"), (1, None), (1, "b"), (1, None), (2, None), (None, "x"), (None, "w")])], "p int, o string, i int")
    plain = Window.partitionBy("p").orderBy("o").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = df.select("i", *[F.struct(F.count(F.lit(1)).over(w), F.sum("i").over(w), F.max("o").over(w)).alias(n) for n, w in (("a", plain), ("b", windows.remaining(["p"], ["o"])))])
    assert both.where("NOT a <=> b").count() == 0


def test_range_to_the_end_reads_a_partition_once(spark, sf):
    plan = load()["win_16_range"].query(spark, sf)._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding$(), currentrow$()" in plan and "unboundedfollowing" not in plan
