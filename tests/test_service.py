"""The steps together: exports to a store, corrections, acknowledgements, rules from a file, a saved model, streams, writers."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline import cli, service
from ledgerline.ingest import transactions, with_accounts
from ledgerline.operators import categorize, classify, detect, transfers
from ledgerline.operators.store import Store
from ledgerline.sources.exports import read_exports
from ledgerline.sources.writers import write_export
from ledgerline.streaming import live

COLUMNS = "txn_id string, account_id string, posted_date date, amount double, raw_description string"
DAY = dt.date(2025, 1, 15)


def rows(spark, n=40):
    out = [(f"k{i}", "one", DAY + dt.timedelta(days=i), -10.0 - i % 3, "KROGER #422 ATLANTA GA") for i in range(n)]
    out += [(f"n{i}", "one", DAY + dt.timedelta(days=30 * i), -15.49, "NETFLIX.COM 8667160003 CA") for i in range(8)]
    out += [("t0", "one", DAY, -500.0, "ONLINE TRANSFER TO CHK 1234"), ("t1", "two", DAY + dt.timedelta(days=1), 500.0, "ZELLE FROM J DOE"), ("odd", "one", DAY + dt.timedelta(days=3), -900.0, "LOCAL \"DINER\", THE")]
    return spark.createDataFrame(out, COLUMNS)


def chase(folder, lines):
    folder.mkdir(exist_ok=True)
    (folder / "one.csv").write_text("Details,Posting Date,Description,Amount,Type\n" + "\n".join(lines) + "\n")
    return str(folder / "one.csv")


def test_command_line_corrects_and_acknowledges(spark, tmp_path, capsys):
    lines = [f"DEBIT,01/{d:02d}/2025,KROGER #422 ATLANTA GA,-{10 + d % 3}.00,ACH" for d in range(1, 29)] + ["DEBIT,02/09/2025,LOCAL DINER,-900.00,ACH", "DEBIT,02/20/2025,NETFLIX.COM,-15.49,ACH"]
    store = str(tmp_path / "ledger")
    run = lambda *a: cli.main([a[0], *a[1:], "--store", store], spark)
    assert cli.main(["version"], spark) == 0 and run("report") == 1
    assert run("ingest", chase(tmp_path / "in", lines)) == 0
    said = capsys.readouterr().out
    assert "30 parsed, 0 skipped, 0 already there, 0 failed" in said and "30 parsed, 0 skipped, 0 failed, 30 added" in said
    assert run("correct", "Kroger", "Mine>Own") == 0
    ledger = Store(spark, store).read()
    assert {r.category for r in ledger.where("merchant_norm = 'Kroger'").collect()} == {"Mine>Own"}
    assert {r.category_source for r in ledger.where("merchant_norm = 'Kroger'").collect()} == {"user"}
    run("anomalies")
    shown = capsys.readouterr().out
    assert "LOCAL DINER" in shown and "amount $900.00" in shown
    odd = ledger.where("amount < -800").first().txn_id
    assert run("ack", odd) == 0 and run("ack", "nothing") == 1
    capsys.readouterr()
    run("anomalies")
    assert "LOCAL DINER" not in capsys.readouterr().out
    assert run("ingest", chase(tmp_path / "in", lines)) == 0
    assert "30 already there" in capsys.readouterr().out and Store(spark, store).read().count() == 30
    assert run("report") == 0 and "Mine>Own" in capsys.readouterr().out
    assert run("subscriptions") == 0


def test_enriched_and_its_views(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(service.enriched(rows(spark)))
    out = store.read()
    got = {r.txn_id: r for r in out.collect()}
    assert len(got) == 51 and got["t0"].category == got["t1"].category == "Transfers>Internal Transfer" and not got["t0"].is_recurring
    assert got["n3"].is_recurring and got["n3"].recurring_group_id == "one:Netflix" and got["k1"].category == "Food & Drink>Groceries"
    assert any("$900.00" in r for r in got["odd"].anomaly_reasons) and got["odd"].anomaly_score > 0.9
    again = {r.txn_id: r.asDict() for r in service.enriched(out).collect()}
    assert again == {k: r.asDict() for k, r in got.items()}
    alerts = service.recurring_alerts(out, F.lit("2026-01-01").cast("date"))
    assert alerts["missed_charges"].where("merchant_norm = 'Netflix'").count() == 1 and alerts["price_hikes"].where("merchant_norm = 'Netflix'").count() == 0
    assert service.monthly_summary(out).where("category LIKE 'Transfers>%'").count() == 0
    assert [r.txn_id for r in service.page(out, category="Food & Drink>Groceries", limit=2, offset=1).collect()] == ["k1", "k2"]


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"merchants": {"Kroger": "Home>Food"}, "keywords": {"diner": "Home>Out"}}))
    rules = categorize.Rules.load(spark, str(tmp_path / "rules.json"))
    got = {r.txn_id: r.category for r in categorize.categorized(categorize.normalized(rows(spark)), rules=rules).collect()}
    assert (got["k0"], got["odd"], got["n0"]) == ("Home>Food", "Home>Out", "Other>Uncategorized")


def test_model_is_saved_and_used(spark, tmp_path):
    data = [(str(i), "a", DAY, -float(5 + i), f"{'COFFEE BAR' if i % 2 else 'GAS PUMP'} {'ABCDEFGH'[i % 8]}", "Food>Coffee" if i % 2 else "Car>Gas", "CAFE" if i % 2 else "FUEL") for i in range(24)]
    ledger = spark.createDataFrame(data, COLUMNS + ", category string, merchant_norm string")
    model = classify.fit(ledger, folds=2, max_iter=30)
    model.save(str(tmp_path / "model"))
    model.save(str(tmp_path / "model"))
    told = lambda m: {r.txn_id: (r.model_category, round(r.model_confidence, 9)) for r in m.predict(ledger).collect()}
    assert told(classify.CategoryModel.load(str(tmp_path / "model"))) == told(model)
    assert {k: v[0] for k, v in told(model).items()} == {r[0]: r[5] for r in data}
    assert len(model.folds) == 2 and classify.calibration_error(model.predict(ledger)).first().ece < 0.5
    sure = spark.createDataFrame([("a", "a", 0.95), ("a", "b", 0.95), ("a", "a", 0.1), (None, "a", 1.0), ("a", "a", None)], "category string, model_category string, model_confidence double")
    assert tuple(classify.calibration_error(sure).first()) == (4, pytest.approx((abs(1 - 2.9) + abs(1 - 0.1)) / 4)) and classify.calibration_error(sure.limit(0)).first().n == 0
    split = classify.row_split(ledger)
    assert not classify.disjoint(split) and classify.disjoint(ledger.withColumn("is_test", F.col("merchant_norm") == "CAFE"))
    assert classify.macro_f1(classify.word_model(split), "category", "model_category") == 1.0
    assert {r.model_category for r in classify.majority(split).collect()} <= {"Food>Coffee", "Car>Gas"}
    curve = spark.createDataFrame([(0.5, 0.4, 0.8), (0.7, 0.3, 0.95), (0.9, 0.1, 1.0)], "threshold double, coverage double, precision double")
    assert classify.pick_threshold(curve) == 0.7 and classify.pick_threshold(curve, 2.0) == 0.7


@pytest.mark.parametrize("layout", ["chase", "boa", "capital_one", "generic_credit", "ofx"])
def test_written_exports_are_read_again(spark, tmp_path, layout):
    ledger = rows(spark, 5).where("account_id = 'one'")
    write_export(ledger, str(tmp_path / "out"), layout, "one")
    back = with_accounts(read_exports(spark, str(tmp_path / "out" / "part*")), "one")
    assert back.where("status <> 'ok'").count() == 0
    key = lambda df: sorted((r.posted_date, float(r.amount), r.raw_description) for r in df.collect())
    assert key(transactions(back)) == key(ledger)


def test_written_category_hints(spark, tmp_path):
    from ledgerline.schema import BANK_HINTS

    ledger = rows(spark, 400).where("account_id = 'one'").withColumn("category", F.when(F.col("txn_id") > "k3", "Food & Drink>Own, \"x\""))
    write_export(ledger, str(tmp_path / "out"), "capital_one", "one")
    back = read_exports(spark, str(tmp_path / "out" / "part*")).where("status = 'ok'").groupBy("category_hint").count().collect()
    got = {r.category_hint: r["count"] for r in back}
    assert set(got) == {*BANK_HINTS, 'Own, "x"', ""} and 0.15 < sum(got[h] for h in BANK_HINTS) / sum(got.values()) < 0.35


def test_a_stray_quote_does_not_fail_a_file(spark, tmp_path):
    path = chase(tmp_path / "in", ['DEBIT,01/02/2025,THE "OLD" INN,-5.00,ACH', 'DEBIT,01/03/2025,"A"B,-6.00,ACH'])
    assert [r.status for r in read_exports(spark, path).collect()] == ["ok", "ok"]


def test_streams(spark, tmp_path):
    schema = "txn_id string, account_id string, ts timestamp, amount double"
    for i, day in enumerate(("2025-01-01 10:00:00", "2025-01-01 10:30:00")):
        spark.createDataFrame([(f"x{k}", "a", day, -1.0) for k in range(3 + i)], "txn_id string, account_id string, ts string, amount double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # the second run finds nothing new
        q = live.into_store(live.first_arrivals(stream()), store, str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    assert sorted(r.txn_id for r in store.read().collect()) == ["x0", "x1", "x2", "x3"]
    q = live.velocity(stream(), "1 hour", "30 minutes").writeStream.format("memory").queryName("speed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("speed").agg(F.max("n")).first()[0] == 7


def plain_pairs(data, within=3):
    data, taken, out = sorted(data, key=lambda r: (r[2], r[0])), set(), []
    for i, a in enumerate(data):
        for b in data[i + 1 :]:
            if a[0] not in taken and b[0] not in taken and (b[2] - a[2]).days <= within and a[1] != b[1] and a[3] + b[3] == 0:
                taken |= {a[0], b[0]}
                out.append((a[0], b[0]))
    return sorted(out)


def test_greedy_pairs_where_many_fit(spark):
    r = random.Random(3)
    data = [(f"{i:03d}", r.choice("abc"), DAY + dt.timedelta(days=r.randint(0, 25)), r.choice([-1, 1]) * r.choice([5.0, 7.0, 100.0 + i]), "TRANSFER") for i in range(90)]
    got = sorted(tuple(x) for x in transfers.transfer_pairs(spark.createDataFrame(data, COLUMNS)).collect())
    assert got == plain_pairs(data) and len(got) > 10


def test_poisson_tail(spark):
    import math

    for count, mean in ((1, 0.5), (3, 1.2), (40, 20.0), (400, 380.0)):
        got = spark.range(1).select(detect.poisson_tail(F.lit(count), F.lit(mean)).alias("p")).first().p
        assert got == pytest.approx(1 - sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(count)), abs=1e-9)


def test_kinds_with_weights_give_the_features_of_all_rows(spark):
    """m3_classifier: a regression over all rows takes long where few of them differ."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StandardScaler, VectorAssembler

    data = [(str(i), "a", DAY + dt.timedelta(days=i % 5), -float(5 + i % 3 * 40), f"SHOP {'ABC'[i % 3]} {'XY'[i % 2]}", "c", "M") for i in range(120)] + [("last", "a", DAY, 2.0, "ONCE ONLY", "c", None)]
    rows = classify.grams_of(classify.numbers(spark.createDataFrame(data, COLUMNS + ", category string, merchant_norm string")))
    kinds = rows.groupBy(*classify.KIND, "grams").agg(F.count("*").cast("double").alias("n"))
    assert kinds.count() < 40
    got = Pipeline(stages=classify.features(kinds)).fit(kinds).transform(kinds)
    stages = [
        CountVectorizer(inputCol="grams", outputCol="tf", minDF=2), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="text"), VectorAssembler(inputCols=classify.NUMBERS, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="numbers", withMean=True), VectorAssembler(inputCols=["text", "numbers"], outputCol="features"),
    ]
    all_rows = Pipeline(stages=stages).fit(rows)
    order, place = all_rows.stages[0].vocabulary, {g: i for i, g in enumerate(Pipeline(stages=classify.features(kinds)).fit(kinds).stages[0].vocabulary)}
    want = {tuple(r[c] for c in classify.KIND): r.features.toArray() for r in all_rows.transform(rows).collect()}
    assert set(order) == set(place)
    for r in got.collect():
        mine, theirs = r.features.toArray(), want[tuple(r[c] for c in classify.KIND)]
        assert [mine[place[g]] for g in order] == pytest.approx(theirs[: len(order)].tolist()) and mine[-4:].tolist() == pytest.approx(theirs[-4:].tolist())
