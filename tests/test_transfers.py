"""Greedy pairs against a plain loop, in pieces of few days, and where one amount is everywhere."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import transfers

DAY = dt.date(2025, 1, 1)
COLUMNS = "txn_id string, account_id string, posted_date date, amount double, raw_description string"


def plain_pairs(data, within=3):
    data, taken, out = sorted(data, key=lambda r: (r[2], r[0])), set(), []
    for i, a in enumerate(data):
        for b in data[i + 1 :]:
            if a[0] not in taken and b[0] not in taken and (b[2] - a[2]).days <= within and a[1] != b[1] and a[3] + b[3] == 0:
                taken |= {a[0], b[0]}
                out.append((a[0], b[0]))
    return sorted(out)


@pytest.mark.parametrize("seed, span", [(1, 60), (2, 4), (3, 5), (4, 1)])
def test_pairs_do_not_depend_on_the_pieces(spark, seed, span):
    r = random.Random(seed)
    data = [(f"{i:04d}", r.choice("abc" if seed % 2 else "aab"), DAY + dt.timedelta(days=r.randint(0, 40)), r.choice([-1, 1]) * r.choice([5.0, 5.0, 7.25, 0.0, 100.0 + i]), "TRANSFER") for i in range(260)]
    odd = [("x1", None, DAY, 5.0, "TRANSFER"), ("x2", "a", None, 5.0, "TRANSFER"), ("x3", "a", DAY, None, "TRANSFER"), ("x4", "a", DAY, 5.0, None)]
    df = spark.createDataFrame(data + odd, COLUMNS).repartition(3)
    got = sorted(tuple(x) for x in transfers.transfer_pairs(df, span=span).collect())
    assert got == plain_pairs(data) and len(got) > 40


def test_no_rows(spark):
    assert transfers.transfer_pairs(spark.createDataFrame([], COLUMNS)).count() == 0


def queue_pairs(rows, within=3):
    """Two accounts, one amount: what waits is one queue."""
    waiting, out = {-1: deque(), 1: deque()}, {}
    for i, account, day, side in rows:
        q = waiting[-side]
        while q and q[0][2] < day - within:
            q.popleft()
        if q and q[0][1] != account:
            out[q.popleft()[0]] = i
        else:
            waiting[side].append((i, account, day))
    return out


def test_one_amount_on_every_day(spark, monkeypatch):
    """60 000 rows of one amount between two accounts: pieces go to many tasks, each row is written a few times at most."""
    n = 60_000
    df = spark.range(n).select(
        F.col("id").alias("txn_id"), F.col("id").alias("h"), F.expr("DATE'2020-01-01' + CAST(id DIV 100 AS INT)").alias("posted_date"), F.when(F.pmod(F.xxhash64("id"), F.lit(100)) < 45, 1).otherwise(-1).alias("side"), F.lit("PAYMENT").alias("raw_description")
    )
    df = df.withColumn("account_id", F.when(F.col("side") == 1, "a").otherwise("b")).withColumn("amount", F.col("side") * 12.5)
    rounds, settled_rows = [], transfers.settled
    monkeypatch.setattr(transfers, "settled", lambda rows, *a: (rounds.append(rows.count()), settled_rows(rows, *a))[1])
    got = {r.a_id: r.b_id for r in transfers.transfer_pairs(df).collect()}
    rows = [(r.txn_id, r.account_id, (r.posted_date - dt.date(2020, 1, 1)).days, r.side) for r in df.orderBy("txn_id").collect()]
    assert got == queue_pairs(rows) and len(got) > 20_000
    assert len(rounds) <= 4 and sum(rounds) < 3 * n, rounds
