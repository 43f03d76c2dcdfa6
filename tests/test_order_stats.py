"""Running medians against sorting, and the forest against plain walks and planted rows."""

import datetime as dt
import random
import statistics
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import forest
from ledgerline.operators.order_stats import RunningMedian, with_expanding_median


@given(st.lists(st.one_of(st.integers(-3, 3), st.integers(-10**8, 10**8).map(lambda x: x / 100)), max_size=80))
def test_running_median(values):
    m, seen = RunningMedian(), []
    for v in map(float, values):
        assert m.median() == (0.5 * statistics.median_low(seen) + 0.5 * statistics.median_high(seen) if seen else None)
        m.add(v)
        seen.append(v)


def test_same_as_the_percentile_of_a_growing_frame(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "b", None]), r.randint(0, 30), r.choice([None, float(r.randint(0, 5)), r.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key string, at int, v double").repartition(3)
    w = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {x.id: x.m for x in df.withColumn("m", F.percentile("v", F.lit(0.5)).over(w)).collect()}
    got = with_expanding_median(df, ["key"], ["at", "id"], F.col("v"), "m")
    assert {x.id: x.m for x in got.collect()} == pytest.approx(want) and got.columns == ["id", "key", "at", "v", "m"]
    assert with_expanding_median(df.limit(0), ["key"], ["at", "id"], F.col("v"), "m").count() == 0
    nan = spark.createDataFrame([(1, "a", 1, float("nan")), (2, "a", 2, 3.0), (3, "a", 3, 5.0)], df.schema)
    assert [x.m for x in with_expanding_median(nan, ["key"], ["at"], F.col("v"), "m").orderBy("id").collect()] == [None, None, 3.0]


def test_one_group_of_many_rows_takes_its_logarithm(spark):
    """Twice the rows of one group, all values different, take about twice the time; a growing frame would take four times."""
    took = {}
    for n in (1000, 100_000, 200_000):
        values = random.Random(n).sample(range(10 * n), n)
        m, began = RunningMedian(), time.process_time()
        for v in values:
            m.add(v)
        took[n] = time.process_time() - began
        assert m.median() == statistics.median(values)
    assert took[200_000] < 3 * took[100_000]
    n = 100_000
    rows = spark.range(n).select("id", F.lit("one").alias("key"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    last = with_expanding_median(rows, ["key"], ["id"], F.col("v"), "m").where(f"id >= {n - 2}").orderBy("id").collect()
    values = [(i * 7919) % n for i in range(n)]
    assert [x.m for x in last] == [statistics.median(values[: n - 2]), statistics.median(values[: n - 1])]


def walk(f, tree, x):
    size, i = 2 << f.depth, 1
    while (k := f.feature[tree * size + i]) >= 0:
        i = 2 * i + int(x[k] >= f.cut[tree * size + i])
    return f.path[tree * size + i]


def test_trees_are_walked_as_they_grew():
    x = np.random.default_rng(4).normal(size=(700, 3))
    x[:, 2] = np.round(x[:, 2])
    f = forest.grow(x, 9, trees=7, sample=64)
    got = forest.isolation(f, x)
    want = [2 ** (-np.mean([walk(f, t, row) for t in range(7)]) / float(forest._expected(64))) for row in x]
    assert got == pytest.approx(want)
    size = 2 << f.depth
    for t in range(7):  # a leaf's path is its depth and what its rows would take beyond it
        depth = [int(np.log2(i)) for i in range(1, size) if f.path[t * size + i] and f.feature[t * size + i] < 0]
        assert max(depth) <= f.depth == 6
    assert forest.isolation_scores(np.zeros((1, 2)), 1).tolist() == [0.0] and forest.isolation_scores(np.zeros((0, 2)), 1).tolist() == []


def average_precision(scores, odd):
    order = np.argsort(-scores)
    hits = np.isin(order, odd)
    return float((np.cumsum(hits) / np.arange(1, len(order) + 1))[hits].mean())


def planted(spark, n, account):
    """Groceries on weekdays, and every 200th row a large purchase in a category that is hardly used."""
    odd = [i for i in range(n) if i % 200 == 57]
    rows = [(i, account, dt.date(2020, 1, 1) + dt.timedelta(days=i // 4), -900.0 - i % 7 if i in set(odd) else -20.0 - i % 11, f"O{i}" if i % 200 == 57 else f"M{i % 5}", "rare" if i % 200 == 57 else "food", "x") for i in range(n)]
    return rows, odd


COLUMNS = "txn_id long, account_id string, posted_date date, amount double, merchant_norm string, category string, raw_description string"


def test_forest_finds_planted_rows_in_chunks(spark):
    rows, odd = planted(spark, 5000, "big")
    small, odd_small = planted(spark, 400, "small")
    small = [(10_000 + r[0], *r[1:]) for r in small]
    df = spark.createDataFrame(rows + small, COLUMNS)
    got = {r.txn_id: r.forest_score for r in forest.forest_scores(df, pool=512, chunk=900).collect()}
    assert len(got) == 5400 and min(got.values()) == 0 and max(got.values()) == 1
    assert average_precision(np.array([got[i] for i in range(5000)]), odd) > 0.9
    assert average_precision(np.array([got[10_000 + i] for i in range(400)]), odd_small) > 0.9
    again = {r.txn_id: r.forest_score for r in forest.forest_scores(df.repartition(5), pool=512, chunk=900).collect()}
    assert again == pytest.approx(got)
    assert forest.forest_scores(df.limit(0)).count() == 0
