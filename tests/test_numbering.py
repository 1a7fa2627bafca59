"""Numbers of clustered ordinals: even tasks, and nothing that runs while the plan is made."""

from statistics import median

from pyspark.sql import functions as F

from tallyloom.operators import numbering


def test_clustered_ordinals_are_dealt_evenly(spark):
    cluster = F.when(F.col("id") % 10 == 0, F.col("id") * 1_000_003).when(F.col("id") % 10 < 9, F.col("id") + (1 << 40)).otherwise(F.lit(10**15) * 900 + F.col("id"))
    rows = spark.range(0, 10_000_000, 1, 8).select(cluster.alias("ord"))
    dealt = numbering.with_slots(rows, "ord").repartition(4, "_slot")
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * median(sizes)
    made = numbering.numbered(rows, "ord")
    told = made.agg(F.count("*").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_distinct("n").alias("k")).first()
    assert tuple(told) == (10_000_000, 1, 10_000_000, 10_000_000)


def test_slots_are_in_order(spark):
    rows = spark.createDataFrame([(x,) for x in [5, 1, 1 << 40, -(1 << 62), 1 << 62, (1 << 62) + 1, 7, 7]], "ord long")
    found = [r["s"] for r in numbering.with_slots(rows, "ord", "s").orderBy("ord").collect()]
    assert found == sorted(found) and len(set(found)) > 3


def test_making_the_plan_runs_nothing(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("ord"), F.lit("x" * 50).alias("wide")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "none may run")
    made = numbering.numbered(rows, "ord")
    assert list(tracker.getJobIdsForGroup("planning")) == []
    spark.sparkContext.setJobGroup("running", "")
    assert made.count() == 1000
    # the sketch reads the ordinals alone
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<ord:bigint>") >= 1
