"""Ranking over a whole table, CUBE and ROLLUP."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlelens.operators.ranking import RANKS, global_ranks
from settlelens.operators.rollups import stepwise_cube, stepwise_rollup


def plain_ranks(df, value, ties, tiles):
    by, full = W.orderBy(value), W.orderBy(value, *ties)
    return df.select(
        *df.columns, F.row_number().over(full).alias("row_number"), F.rank().over(by).alias("rank"), F.dense_rank().over(by).alias("dense_rank"),
        F.percent_rank().over(by).alias("percent_rank"), F.cume_dist().over(by).alias("cume_dist"), F.ntile(tiles).over(full).alias("tile"))


@pytest.mark.parametrize("n,tiles", [(0, 4), (1, 4), (3, 4), (503, 4), (503, 100)])
def test_ranks_against_one_window(spark, n, tiles):
    rng = random.Random(n)
    # A third of the rows has one value; some have none; one is not a number.
    rows = [(i, 7.0 if i % 3 == 0 else rng.choice([None, float("nan"), *map(float, range(20))])) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(5)
    got = global_ranks(df, "v", ["id"], tiles)
    assert got.columns == ["id", "v", *RANKS]
    key = lambda r: r["id"]
    assert str(sorted(got.collect(), key=key)) == str(sorted(plain_ranks(df, "v", ["id"], tiles).collect(), key=key))


def test_ranks_of_equal_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, "x")] * 4 + [(1, 6, "y")], "id int, v int, rank string")
    got = global_ranks(df, "v", ["id"], 2).collect()
    assert sorted(r["row_number"] for r in got) == [1, 2, 3, 4, 5]
    assert sorted((r["rank"], r["dense_rank"], r["cume_dist"]) for r in got) == [(1, 1, 0.8)] * 4 + [(5, 2, 1.0)]
    with pytest.raises(ValueError):
        global_ranks(df, "v", ["id"], 0)


def test_no_task_of_the_ranking_holds_a_hot_value(spark):
    """All rows have one value: the window that numbers them does not gather them by it."""
    df = spark.range(20_000).withColumn("v", F.lit(1))
    plan = global_ranks(df, "v", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan and "rangepartitioning(id" not in plan
    assert global_ranks(df, "v", ["id"]).agg(F.countDistinct("row_number")).first()[0] == 20_000


DIMS = ["a", "b", "c"]
KINDS = {"n": "count", "total": "sum", "low": "min", "high": "max"}


def measures():
    return {name: (kind, F.col("x")) for name, kind in KINDS.items()}


def facts(spark, n):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 4 + ["p", None]), rng.randrange(3), rng.choice([None, 1.5, 2.5]), rng.choice([None, 1, 10**20])) for _ in range(n)]
    return spark.createDataFrame([(a, b, c, x if x is None else str(x)) for a, b, c, x in rows], "a string, b int, c double, x string").withColumn(
        "x", F.col("x").cast("decimal(38,0)"))


@pytest.mark.parametrize("kind", ["cube", "rollup"])
def test_steps_agree_with_the_builtin_form(spark, kind):
    df = facts(spark, 400)
    got = (stepwise_cube if kind == "cube" else stepwise_rollup)(df, DIMS, measures())
    grouped = df.cube(*DIMS) if kind == "cube" else df.rollup(*DIMS)
    want = grouped.agg(F.grouping_id().alias("g"), F.count("x").alias("n"), F.sum("x").alias("total"), F.min("x").alias("low"), F.max("x").alias("high"))
    order = ["grouping_id", *DIMS, *KINDS]
    want = want.withColumnRenamed("g", "grouping_id")
    assert sorted(map(str, got.select(order).collect())) == sorted(
        str(r) for r in want.select(F.col("grouping_id").cast("int"), *order[1:]).collect())


def test_rolled_edges(spark):
    assert stepwise_cube(facts(spark, 1).limit(0), DIMS, measures()).count() == 0
    assert stepwise_cube(facts(spark, 5), [], measures()).count() == 1
    with pytest.raises(ValueError):
        stepwise_rollup(facts(spark, 1).withColumnRenamed("a", "grouping_id"), ["grouping_id"], measures())
    with pytest.raises(ValueError):
        stepwise_rollup(facts(spark, 1), ["a"], {"a": ("count", F.lit(1))})
