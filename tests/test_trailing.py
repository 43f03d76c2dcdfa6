"""Trailing counts and bursts: batches against plain loops, streams against batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.trailing import HOUR, bursts, trailing_counts
from ledgerline.streaming.trailing import bursts_stream, trailing_stream

T0 = dt.datetime(2025, 3, 1)
SCHEMA = "txn_id long, account_id string, ts timestamp, amount double"
hours = lambda h: T0 + dt.timedelta(hours=h)


def some(n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice("aab"), hours(r.choice([r.randint(0, 700), r.uniform(0, 700)])), -r.randint(1, 9000) / 100) for i in range(n)]
    edge = [(1000, "c", hours(0), -1.0), (1001, "c", hours(24), -2.0), (1002, "c", hours(24) + dt.timedelta(microseconds=1), -4.0), (1003, "c", hours(168), -8.0), (1004, "c", hours(168), -16.0), (1005, "c", hours(200), None)]
    return rows + edge


def plain(rows):
    out = {}
    for i, a, t, _ in rows:
        of = lambda h: [x for _, b, u, x in rows if b == a and t - dt.timedelta(hours=h) <= u <= t]  # noqa: B023, E731
        out[i] = tuple(y for h in (24, 168) for y in (len(of(h)), sum(round((x or 0) * 100) for x in of(h))))
    return out


def got(df):
    return {r.txn_id: (r.n_24h, r.cents_24h, r.n_7d, r.cents_7d) for r in df.collect()}


def test_trailing_counts(spark):
    rows = some()
    df = spark.createDataFrame([*rows, (5000, "a", None, -1.0)], SCHEMA).repartition(3)
    assert got(trailing_counts(df)) == plain(rows)
    one = trailing_counts(df, {"1h": HOUR})
    assert one.columns == ["txn_id", "account_id", "ts", "n_1h", "cents_1h"] and one.count() == len(rows)
    assert trailing_counts(df.limit(0)).count() == 0


def test_a_hot_account_is_many_groups(spark):
    rows = spark.range(60_000).select(F.col("id").alias("txn_id"), F.lit("hot").alias("account_id"), F.timestamp_micros(F.col("id") * 60_000_000).alias("ts"), F.lit(-1.0).alias("amount"))
    out = trailing_counts(rows).where("n_7d <> least(txn_id + 1, 10081) OR n_24h <> least(txn_id + 1, 1441)")
    assert out.count() == 0
    assert trailing_counts(rows)._jdf.queryExecution().executedPlan().toString().count("_piece") > 0


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def drain(spark, df, name, check):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(check)).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_equals_batch_and_drops_what_is_late(spark, tmp_path):
    rows = sorted((r for r in some(120, 4)), key=lambda r: r[2])
    parts = [rows[i : i + 32] for i in range(0, len(rows), 32)]
    for a, b in zip(parts, parts[1:], strict=False):  # some rows come a batch later, though not later than two days
        if a[-1][2] - a[-3][2] < dt.timedelta(hours=47):
            b.append(a.pop(-3))
    late = (7777, "a", hours(-500), -9.0)
    for x in [*parts, [(9998, "z", hours(2000), 0.0)], [late, (9999, "z", hours(2001), 0.0)], [(10000, "z", hours(4000), 0.0)]]:
        put(spark, tmp_path / "in", x)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = got(drain(spark, trailing_stream(stream, "48 hours"), "trail", tmp_path / "check"))
    want = plain([*rows, (9998, "z", hours(2000), 0.0), (9999, "z", hours(2001), 0.0)])
    assert late[0] not in out and out == want


CARD = [(i, "card", T0 + dt.timedelta(minutes=3 * i), -1.0 - i) for i in range(4)] + [(4, "card", T0 + dt.timedelta(minutes=14), -800.0)]
CALM = [(10 + i, "calm", T0 + dt.timedelta(minutes=20 * i), -2.0) for i in range(5)] + [(20, "first", T0, -900.0)] + [(21 + i, "first", T0 + dt.timedelta(minutes=1 + i), -1.0) for i in range(4)]
EDGE = [(30, "edge", T0, -1.0), (31, "edge", T0 + dt.timedelta(minutes=10, seconds=1), -1.0), (32, "edge", T0 + dt.timedelta(minutes=11), -1.0), (33, "edge", T0 + dt.timedelta(minutes=12), -70.0)]


def test_bursts(spark):
    df = spark.createDataFrame(CARD + CALM + EDGE, SCHEMA)
    rows = bursts(df).collect()
    assert [(r.account_id, r.began, r.ended, r.n, r.n_small, r.total_cents) for r in rows] == [("card", T0, T0 + dt.timedelta(minutes=24), 5, 4, 81000)]
    assert bursts(df, least=2).count() == 2  # a row more than a gap later begins a session


def test_bursts_of_a_stream(spark, tmp_path):
    for x in (CARD[:3] + CALM[:2], CARD[3:] + CALM[2:] + EDGE, [(99, "z", hours(5), 0.0)], [(100, "card", T0 + dt.timedelta(minutes=5), -1.0), (101, "z", hours(6), 0.0)]):
        put(spark, tmp_path / "in", x)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(spark, bursts_stream(stream), "bursting", tmp_path / "check").collect()
    assert sorted(map(str, out)) == sorted(map(str, bursts(spark.createDataFrame(CARD + CALM + EDGE, SCHEMA)).collect()))


@pytest.fixture(autouse=True)
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)
