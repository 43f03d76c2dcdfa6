"""The store's files and commits, writers at the same time, and enriching what is new against enriching all."""

import datetime as dt
import os
import random
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline import service
from ledgerline.operators import store as S
from ledgerline.operators.store import Store, WriteConflict

COLUMNS = "txn_id string, account_id string, posted_date date, amount decimal(12,2), raw_description string, category string, category_source string"
DAY = dt.date(2025, 1, 1)


def rows(spark, ids, account="a"):
    return spark.createDataFrame([(f"{i:05d}", account, DAY, None, "x", None, None) for i in ids], COLUMNS)


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names}


def ids(store):
    return sorted(int(r.txn_id) for r in store.read().collect())


def test_an_upsert_of_few_rows_changes_no_file(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read() is None and store.version() == 0
    assert store.upsert(rows(spark, range(1000))) == 1000
    before = files(tmp_path)
    assert store.upsert(rows(spark, range(995, 1010))) == 10 and store.upsert(rows(spark, range(990, 1010))) == 0
    after = files(tmp_path)
    assert {k: after[k] for k in before} == before and ids(store) == list(range(1010)) and store.version() == 2
    assert store.upsert(rows(spark, [7, 7, 2000, 2000])) == 1


def test_folders_out_of_range_are_not_read(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    for i in range(4):
        store.upsert(rows(spark, range(100 * i, 100 * i + 50)))
    compared = []
    monkeypatch.setattr(S, "absent_from_much", lambda new, stored, n, key="txn_id": (compared.append(len(stored.inputFiles())), S.absent(new, stored, key))[1])
    assert store.upsert(rows(spark, range(210, 260))) == 10 and compared and len(store.state().folders) == 5
    assert {f.split("/")[-2] for f in spark.read.parquet(store.state().folders[2].path).inputFiles()} == {store.state().folders[2].path.split("/")[-1]}
    assert compared == [len(spark.read.parquet(store.state().folders[2].path).inputFiles())]
    assert store.upsert(rows(spark, range(900, 910))) == 10 and len(compared) == 1


@pytest.mark.parametrize("many", [False, True])
def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(S, "BROADCAST_KEYS", 0 if many else 10**6)
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.upsert(rows(spark, range(10)))
    put, done = one._put, []

    def late(df):  # the other one commits between this one's reading and its commit
        if not done:
            done.append(two.upsert(rows(spark, range(5, 20))))
        return put(df)

    monkeypatch.setattr(one, "_put", late)
    assert one.upsert(rows(spark, range(15, 30))) == 10 and done == [10] and ids(one) == list(range(30))
    done.clear()
    with pytest.raises(WriteConflict):
        one.write(rows(spark, range(3)), one.version() - 1)
    assert ids(one) == list(range(30))


def test_a_version_is_taken_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert(rows(spark, range(3)))
    folder = store._put(rows(spark, range(5, 8)))
    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(lambda _: store._commit(2, "add", folder), range(8))) == [False] * 7 + [True]
    assert ids(store) == [0, 1, 2, 5, 6, 7] and os.listdir(tmp_path / "drafts") == []


def test_many_writers_at_once(spark, tmp_path):
    with ThreadPoolExecutor(4) as pool:
        added = list(pool.map(lambda i: Store(spark, str(tmp_path)).upsert(rows(spark, range(10 * i, 10 * i + 25))), range(4)))
    store = Store(spark, str(tmp_path))
    assert sum(added) == 55 and ids(store) == list(range(55)) and 3 <= store.version() <= 4  # what the others have added together, the fourth need not


def test_accounts_are_replaced(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert(rows(spark, range(5), "a").unionByName(rows(spark, range(5, 9), "b")).unionByName(rows(spark, [9], None)))
    before = files(tmp_path)
    store.replace_accounts(rows(spark, [1, 2], "a").withColumn("extra", F.lit(1)), rows(spark, [0], "a").unionByName(rows(spark, [0], None)))
    assert ids(store) == [1, 2, 5, 6, 7, 8] and {k: files(tmp_path)[k] for k in before} == before
    assert {r.extra for r in store.read().where("account_id = 'b'").collect()} == {None}
    assert store.upsert(rows(spark, [3, 40], "a")) == 1  # a key that was stored stays known
    store.replace_accounts(rows(spark, [8], "b"), rows(spark, [0], "b"))
    assert ids(store) == [1, 2, 8, 40]
    store.write(store.read().where("account_id = 'a'"))
    assert ids(store) == [1, 2, 40] and len(store.state().folders) == 1


def bank(seed, n, start):
    r = random.Random(seed)
    texts = ["KROGER #422 ATLANTA GA", "NETFLIX.COM 8667160003 CA", "LOCAL DINER", "SHELL OIL 57442 ATLANTA GA", "UBER *TRIP HELP.UBER.COM CA"]
    out = []
    for i in range(n):
        account, day = r.choice("pqrs"), DAY + dt.timedelta(days=r.randint(0, 200))
        out.append((f"{start + i:05d}", account, day, f"{-r.randint(100, 9000) / 100:.2f}", r.choice(texts), None, None))
    for i in range(n // 20):  # transfers, some of which only a later batch completes
        size, day = f"{r.randint(1, 6) * 50}.00", DAY + dt.timedelta(days=r.randint(0, 200))
        out.append((f"{start + n + i:05d}", r.choice("pqrst"), day, ("-" if r.random() < 0.5 else "") + size, "ONLINE TRANSFER", None, None))
    return out


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    tidy = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*columns).collect())
    assert tidy(a) == tidy(b)


def test_enriching_what_is_new_gives_what_enriching_all_gives(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    put = lambda data: store.upsert(spark.createDataFrame([(*x[:3], Decimal(x[3]), *x[4:]) for x in data], COLUMNS))
    free = "333.25"
    put([*bank(1, 120, 0), ("70001", "q", DAY, free, "ZELLE FROM X", None, None)])
    assert service.enrich_new(store) == 5 and store.version() == 2
    # one account's new row, and the other leg of a transfer, which changes the partner's account too
    put([("70000", "p", DAY + dt.timedelta(days=3), "-77.00", "LOCAL DINER", None, None), ("70002", "r", DAY + dt.timedelta(days=1), "-" + free, "PMT TO Y", None, None)])
    old = files(f"{tmp_path}/data")
    assert service.enrich_new(store) == 3
    now = files(f"{tmp_path}/data")
    assert {k: now[k] for k in old} == old
    same(store.read(), service.enriched(store.read()))
    # a correction reaches every account of the merchant, once
    store.correct("Kroger", "Mine>Own")
    put(bank(2, 20, 80_000))
    assert service.enrich_new(store) >= 4 and service.enrich_new(store) == 0
    same(store.read(), service.enriched(store.read(), store.corrections()))
    assert store.read().where("category = 'Mine>Own' AND category_source = 'user'").count() > 10
