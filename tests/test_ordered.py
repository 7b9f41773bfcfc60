import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basinframe.operators import ordered as o


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one key."""
    k = F.col("id")
    key = F.when(k % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), k % 7))
    return spark.range(3000).select(key.alias("g"), (k * 7919 % 3001).alias("t"), (k % 13).alias("v"))


def test_prefix_equals_plain_window(spark, skewed):
    w = Window.partitionBy("g").orderBy("t")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select(
        "g",
        "t",
        F.row_number().over(w).cast("long").alias("i"),
        F.coalesce(F.sum("v").over(before), F.lit(0)).alias("s"),
        F.max("v").over(before).alias("m"),
        F.lag("v").over(w).alias("l"),
    )
    got = o.prefix(skewed, ["g"], ["t"], sums={"s": "v"}, maxes={"m": "v"}, lags={"l": "v"}, ordinal="i")
    got = got.select("g", "t", "i", "s", "m", "l")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_prefix_without_key_and_descending(spark, skewed):
    got = o.prefix(skewed, [], ["-t"], ordinal="i").orderBy("i").select("t", "i").collect()
    assert [r["i"] for r in got] == list(range(1, 3001))
    assert [r["t"] for r in got] == sorted((r["t"] for r in got), reverse=True)


def test_hot_key_spans_partitions(spark, skewed):
    """The half of the rows in one key is not computed by one task."""
    parts = skewed.repartitionByRange(4, "g", "t").withColumn("p", F.spark_partition_id())
    assert parts.where("g = 'hot'").select("p").distinct().count() > 1


def test_only_partition_summaries_are_gathered(spark, skewed):
    """The pooled plan never brings the rows together: the one gathering exchange
    sits on an aggregate with one row per range partition."""
    plan = o.prefix(skewed, [], ["t"], sums={"s": "v"})._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    gathers = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(gathers) == 1
    below = next(line for line in lines[gathers[0] + 1 :] if "Aggregate" in line or "Scan" in line)
    assert "keys=[__part" in below


def test_top_n_limits_before_the_shuffle(spark, skewed):
    top = o.top_n(skewed, ["g"], ["-t"], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    want = (
        skewed.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("t")))).where("r <= 3").drop("r")
    )
    assert top.exceptAll(want).count() == 0 and top.count() == want.count()


def test_first_row(spark, skewed):
    got = {r["g"]: r["t"] for r in o.first_row(skewed, ["g"], ["t"]).collect()}
    want = {r["g"]: r["t"] for r in skewed.groupBy("g").agg(F.min("t").alias("t")).collect()}
    assert got == want


def test_same_result_at_other_partition_counts(spark, skewed):
    a = o.prefix(skewed.coalesce(1), ["g"], ["t"], sums={"s": "v"})
    b = o.prefix(skewed.repartition(9), ["g"], ["t"], sums={"s": "v"})
    assert a.exceptAll(b).count() == 0
