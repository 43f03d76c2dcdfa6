import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import categorize, detect, forest, recurring, transfers
from ledgerline.operators.store import acknowledged, latest, top_anomalies, updated
from ledgerline.plans import views

COLUMNS = "txn_id long, account_id string, posted_date date, amount double, merchant_norm string, category string, raw_description string"
DAY = dt.date(2025, 1, 15)


def ledger(spark, rows):
    """rows: (day offset, amount, merchant) with optional description and account."""
    full = [(i, r[4] if len(r) > 4 else "a", DAY + dt.timedelta(days=r[0]), float(r[1]), r[2], "c", r[3] if len(r) > 3 else "x") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def fired(df, column):
    return sorted(r.txn_id for r in df.where(f"{column} IS NOT NULL").collect())


def test_outlier(spark):
    assert fired(detect.amount_outlier(ledger(spark, [(i, -50, "m") for i in range(10)] + [(11, -900, "m")])), "s_outlier") == [10]


def test_new_merchant(spark):
    rows = ledger(spark, [(0, -600, "m"), (1, -50, "m"), (2, -3, "n")])
    assert fired(detect.new_merchant(rows), "s_new") == [0]
    known = spark.createDataFrame([("a", "m")], "account_id string, merchant_norm string")
    assert fired(detect.new_merchant(rows, known), "s_new") == []


def test_velocity(spark):
    assert fired(detect.velocity(ledger(spark, [(i, -5, f"m{i}") for i in range(29)] + [(40, -5, f"n{i}") for i in range(6)])), "s_velocity") == list(range(29, 35))


def test_duplicates(spark):
    assert fired(detect.duplicate_charge(ledger(spark, [(0, -5, "m"), (0, -5, "m"), (40, -5, "m")])), "s_duplicate") == [0, 1]


def test_geo_and_weekday_and_extreme(spark):
    assert fired(detect.geo_mismatch(ledger(spark, [(i, -5, "m", "SHOP GA") for i in range(5)] + [(6, -5, "m", "SHOP WA"), (7, -5, "m", "none")])), "s_geo") == [5]
    assert fired(detect.unusual_weekday(ledger(spark, [(0, -5, "m")])), "s_weekday") == []
    assert fired(detect.extreme_amount(ledger(spark, [(i, -20, "m") for i in range(9)] + [(10, -500, "m")])), "s_extreme") == [9]


@pytest.mark.parametrize("n, cold", [(25, True), (60, False)])
def test_anomaly_scores(spark, n, cold):
    rows = forest.anomalies(ledger(spark, [(i, -20, "m") for i in range(n)])).collect()
    assert len(rows) == n and {r.cold_start for r in rows} == {cold} and all(0 <= r.anomaly_score <= 1 for r in rows)


def test_forest_is_flat_on_equal_rows_and_finds_the_odd_one():
    assert not forest.isolation_scores(np.ones((50, 3)), 1).any()
    x = np.random.default_rng(0).normal(size=(200, 2))
    x[17] = 9
    assert forest.isolation_scores(x, 1).argmax() == 17


def test_recurring_and_alerts(spark):
    rows = ledger(spark, [(30 * i, -15.49 if i < 7 else -17.99, "Netflix") for i in range(8)] + [(5, -3, "y"), (9, -3, "y")])
    groups = recurring.recurring_groups(rows)
    got = groups.collect()
    assert [(g.merchant_norm, g.period) for g in got] == [("Netflix", "monthly")] and got[0].confidence > 0.8
    assert [r.new_amount for r in recurring.price_hikes(rows, groups).collect()] == [17.99]



    assert recurring.missed_charges(groups, F.lit("2025-09-30").cast("date")).count() == 1
    twice = ledger(spark, [(30 * i, -15.49, "Netflix") for i in range(8)] + [(31, -15.49, "Netflix")])
    assert recurring.duplicate_billing(twice, groups).count() == 1
    assert recurring.subscription_audit(rows, groups).first().annualized == pytest.approx(12 * (7 * 15.49 + 17.99) / 8, abs=0.01)


def test_transfers(spark):
    text = "ONLINE TRANSFER"
    rows = ledger(spark, [(0, -500, "m", text, "a"), (1, 500, "m", text, "b"), (2, 500, "m", text, "b"), (0, -70, "m", text, "a"), (9, 70, "m", text, "b"), (0, -9, "m", text, "a"), (0, 9, "m", text, "a"), (0, -8, "m", "FOOD", "a"), (0, 8, "m", "FOOD", "b")])
    assert [tuple(r) for r in transfers.transfer_pairs(rows).collect()] == [(0, 1)]
    assert transfers.without_transfers(rows, transfers.transfer_pairs(rows)).count() == 7


@pytest.mark.parametrize("raw, merchant", [("SQ *BLUE BOTTLE COF 4155551234 CA", "Blue Bottle Coffee"), ("NETFLIX.COM 8667160003 CA", "Netflix"), ("AMZN MKTP US*2K3L AMZN.COM/BILL WA", "Amazon"), ("KROGER #422 ATLANTA GA", "Kroger")])
def test_merchants(spark, raw, merchant):
    assert categorize.normalized(ledger(spark, [(0, -1, "x", raw)]).drop("merchant_norm")).first().merchant_norm == merchant


def test_cascade(spark):
    rows = ledger(spark, [(0, -1, "Kroger"), (0, -1, "Netflix"), (0, -1, "?"), (0, -1, "!")])
    fix = spark.createDataFrame([("Kroger", "Mine>Own")], "merchant_norm string, user_category string")
    said = spark.createDataFrame([(2, "A>B", 0.9), (3, "A>B", 0.2)], "txn_id long, model_category string, model_confidence double")
    got = {r.txn_id: (r.category, r.category_source) for r in categorize.categorized(rows, fix, said).collect()}
    assert got == {0: ("Mine>Own", "user"), 1: ("Entertainment>Streaming", "rule"), 2: ("A>B", "model"), 3: ("Other>Uncategorized", "model")}


def test_store_operators(spark):
    rows = spark.createDataFrame([(1, "x", "user", 0.95), (2, "x", "rule", 0.99)], "txn_id long, category string, category_source string, anomaly_score double")
    new = spark.createDataFrame([(1, "y"), (2, "y"), (3, "y")], "txn_id long, category string")
    assert {r.txn_id: r.category for r in updated(rows, new, ["category"]).collect()} == {1: "x", 2: "y"}
    assert [r.txn_id for r in top_anomalies(acknowledged(rows, new.where("txn_id = 2"))).collect()] == [1]
    log = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, at int, v string")
    assert latest(log, ["key"], ["at"]).first().v == "b"


def test_registered_classifier_fits_in_full(spark, monkeypatch):
    from ledgerline.operators import classify
    from ledgerline.plans import catalog

    class Stop(Exception):
        pass

    def stop(stages):
        iterations, vocabulary = stages[-1].getMaxIter(), stages[0].getVocabSize()
        raise Stop(iterations, vocabulary)

    folds = []
    fit = classify.fit
    monkeypatch.setattr(classify, "fit", lambda *a, **k: (folds.append(k.get("folds", fit.__defaults__[1])), fit(*a, **k))[1])
    monkeypatch.setattr(classify, "Pipeline", stop)
    with pytest.raises(Stop) as stopped:
        catalog.queries()["m3_classifier"](spark, "/root/testdata/sf0.001")
    assert folds == [3] and stopped.value.args == (2000, 2**31 - 1)


def test_groups_and_their_rows_meet_without_a_broadcast_in_tasks_of_bounded_size(spark, monkeypatch, tmp_path):
    """Spark guesses ledgers that are made from few bytes to be small; d12_price_hike and n7_dup_billing broadcast theirs."""
    monkeypatch.setattr(detect, "TASK_ROWS", 100)
    spark.range(400).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    rows = views.planted(spark, str(tmp_path))
    groups = recurring.recurring_groups(rows)
    for made in (recurring.members(rows, groups), recurring.price_hikes(rows, groups), recurring.duplicate_billing(rows, groups), recurring.subscription_audit(rows, groups), detect.new_merchant(rows, groups)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    dealt = recurring.members(rows, groups).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 40 and max(r["count"] for r in dealt) < 400 and sum(r["count"] for r in dealt) == rows.count()
    odd = spark.createDataFrame([(i, i % 4, dt.date(2025, 1, 1 + i), float(i * i % 7)) for i in range(10)], "txn_id int, account_id int, posted_date date, amount double").withColumn("merchant_norm", F.lit("m"))
    last = {a: sorted(i * i % 7 for i in range(10) if i % 4 == a)[-3:] for a in range(4)}
    assert {r.account_id: r.band_mid for r in recurring.group_stats(odd).collect()} == {a: (v[1] if len(v) == 3 else sum(v) / 2) for a, v in last.items()}
