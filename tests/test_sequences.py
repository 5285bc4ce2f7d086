"""The skew-split neighbour windows equal plain per-key windows, including a hot key."""

import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from atoflow.operators.sequences import day_and_id_block, instant_and_id_block, neighbours, ordered_neighbours


def test_matches_plain_window_with_hot_key(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 60)}"
        rows.append((i, key, rnd.randint(0, 40), rnd.choice("ABCDE"), rnd.choice([None, 1, 5, 9])))
    df = spark.createDataFrame(rows, "id long, k string, d int, v string, x int")
    got = ordered_neighbours(df, ["k"], ["d", "id"], F.col("d"),
                             leads={"nxt": "v"}, lags={"prv": "v"}, prior_max={"mx": "x"})
    w = Window.partitionBy("k").orderBy("d", "id")
    exp = df.select("id", F.lead("v").over(w).alias("nxt"), F.lag("v").over(w).alias("prv"),
                    F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mx"))
    a = {r["id"]: (r["nxt"], r["prv"], r["mx"]) for r in got.collect()}
    b = {r["id"]: (r["nxt"], r["prv"], r["mx"]) for r in exp.collect()}
    assert a == b


def test_hot_key_is_spread_over_tasks(spark):
    """A key holding a third of the rows lands in one task with a plain window, but in many
    tasks with the (key, day) split."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 97}", i % 50, "ABC"[i % 3]) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, k string, d int, v string")
    prev = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = ordered_neighbours(df, ["k"], ["d", "id"], F.col("d"), leads={"nxt": "v"})
        plain = df.withColumn("nxt", F.lead("v").over(Window.partitionBy("k").orderBy("d", "id")))
        def tasks(out):  # the window output must be consumed, or Catalyst prunes the window away
            hot = out.filter(F.col("k") == "hot").select(F.spark_partition_id().alias("p"), "nxt")
            return len(hot.groupBy("p").agg(F.count("nxt")).collect())
        assert tasks(plain) == 1
        assert tasks(split) >= 6
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", prev)


def test_multilevel_split_matches_plain_window(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 2 == 0 else f"k{rnd.randint(0, 20)}", rnd.randint(0, 30), rnd.choice("ABCD"),
             rnd.choice([None, 2, 4, 8])) for i in range(2500)]
    df = spark.createDataFrame(rows, "id long, k string, d int, v string, x int")
    w = Window.partitionBy("k").orderBy("d", "id")
    exp = {r["id"]: tuple(r[1:]) for r in df.select(
        "id", F.lead("v").over(w), F.lag("v").over(w),
        F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1))).collect()}
    fine = F.struct(F.col("d").alias("d"), F.floor(F.col("id") / 64).alias("blk"))
    for coarser in ([lambda b: b["d"]], [lambda b: b["d"], lambda b: F.floor(b / 10)]):
        got = ordered_neighbours(df, ["k"], ["d", "id"], fine, leads={"nxt": "v"}, lags={"prv": "v"},
                                 prior_max={"mx": "x"}, coarser=coarser)
        assert {r["id"]: (r["nxt"], r["prv"], r["mx"]) for r in got.collect()} == exp


@pytest.mark.parametrize("one_second", [False, True])
def test_hot_user_is_bounded_in_rows_and_carry(spark, one_second):
    """A user with a third of the events, at distinct seconds or all in one second: no window task,
    of rows or of bucket summaries, sees more than a small part of them, and the answer is a plain window's."""
    n = 30_000
    ts = "timestamp_seconds(1600000000)" if one_second else "timestamp_seconds(1600000000 + id * 7)"
    df = spark.range(n).select(
        F.expr("if(id % 3 = 0, -1, id % 997)").alias("k"), F.expr(ts).alias("t"), (F.col("id") * 300_007).alias("id"),
        F.expr("element_at(array('A','B','C','D'), cast(id % 4 + 1 as int))").alias("v"))
    bucket, coarser = instant_and_id_block("t", "id")
    got = neighbours(df, ["k"], ["t", "id"], bucket, coarser, leads={"nxt": "v"}, hot_rows=1000)
    w = Window.partitionBy("k").orderBy("t", "id")
    exp = {r["id"]: r["nxt"] for r in df.select("id", F.lead("v").over(w).alias("nxt")).collect()}
    assert {r["id"]: r["nxt"] for r in got.collect()} == exp
    level = df.filter("k = -1").select(bucket.alias("b"))
    assert level.groupBy("b").count().agg(F.max("count")).first()[0] <= 1024
    for coarse in coarser:  # each carry window holds the distinct finer buckets of a coarser one
        level = level.distinct().select(coarse(F.col("b")).alias("b"))
        assert level.groupBy("b").count().agg(F.max("count")).first()[0] <= 1024
    assert level.distinct().count() < 100


def test_no_hot_key_needs_one_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), (F.col("id") % 9).alias("d"), "id", F.col("id").cast("string").alias("v"))
    bucket, coarser = day_and_id_block(F.col("d"), "id")
    out = neighbours(df, ["k"], ["d", "id"], bucket, coarser, leads={"n": "v"}, lags={"p": "v"}, prior_max={"m": "id"})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    few = neighbours(df, ["k"], ["d", "id"], bucket, coarser, leads={"n": "v"}, lags={"p": "v"}, prior_max={"m": "id"}, hot_rows=0)
    cols = ["id", "n", "p", "m"]
    assert sorted(map(repr, out.select(cols).collect())) == sorted(map(repr, few.select(cols).collect()))
