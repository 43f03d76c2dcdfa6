"""Command line: version, ingest, enrich, correct, ack, train, report, anomalies, subscriptions."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import scratch, service
from .ingest import load
from .operators import classify
from .operators.categorize import Rules
from .operators.store import Store, acknowledged, top_anomalies

VERSION = "0.1.0"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerline")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("ingest", "enrich", "correct", "ack", "train", "report", "anomalies", "subscriptions"):
        s = sub.add_parser(name)
        s.add_argument("--store", default="ledger")
        s.add_argument("--account-id")
        if name == "ingest":
            s.add_argument("paths", nargs="+")
            s.add_argument("--show", type=int, default=100, help="files that are listed")
        if name in ("ingest", "enrich"):
            s.add_argument("--model", help="folder of a saved category model")
            s.add_argument("--rules", help="JSON file of category rules")
        if name == "correct":
            s.add_argument("merchant")
            s.add_argument("category")
        if name == "ack":
            s.add_argument("txn_id")
        if name == "train":
            s.add_argument("model")
        if name == "anomalies":
            s.add_argument("--min-score", type=float, default=0.9)
            s.add_argument("--limit", type=int, default=20)
    a = p.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    spark = spark or SparkSession.builder.appName("ledgerline").getOrCreate()
    try:
        return run(spark, a)
    finally:
        scratch.clear(spark)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """One command on its store; what it prints is all that is left of its intermediate tables."""
    store = Store(spark, a.store)
    if a.command == "ingest":
        summary, totals = load(spark, a.paths, store, a.account_id)
        for r in summary.orderBy("file").limit(a.show).collect():
            print(f"{r['file']}: {r['parsed']} parsed, {r['skipped']} skipped, {r['deduped']} already there, {r['failed']} failed")
            for reason in r["failures"]:
                print(f"  {reason}")
        print(", ".join(f"{n} {k}" for k, n in totals.items()))
    if a.command == "correct":
        store.correct(a.merchant, a.category)
    ledger = store.read()
    if ledger is None:
        print("nothing ingested yet")
        return 1
    if a.command == "ack":
        if not store.acknowledge(a.txn_id):
            print(f"no transaction {a.txn_id}")
            return 1
        return 0
    if a.command == "train":
        classify.fit(ledger.where("category_source in ('user', 'rule')")).save(a.model)
        return 0
    if a.command in ("ingest", "enrich", "correct"):
        model = classify.CategoryModel.load(a.model) if getattr(a, "model", None) else None
        rules = Rules.load(spark, a.rules) if getattr(a, "rules", None) else None
        if a.command == "enrich" or model or rules:
            version = store.version()
            store.write(service.enriched(store.read(), store.corrections(), model, rules), version)
        else:
            service.enrich_new(store)
        return 0
    if a.account_id:
        ledger = ledger.where(F.col("account_id") == a.account_id)
    if a.command == "report":
        for r in service.monthly_summary(ledger).orderBy("month", F.desc("total")).collect():
            print(f"{r['month']}  {r['category']:<40} {r['total']:>12.2f}")
    elif a.command == "anomalies":
        for r in top_anomalies(acknowledged(ledger, store.acks()), a.min_score, a.limit).collect():
            print(f"{r['posted_date']}  {r['amount']:>10.2f}  {r['anomaly_score']:.3f}  {r['raw_description']}  {', '.join(r['anomaly_reasons'] or [])}")
    else:
        alerts = service.recurring_alerts(ledger)
        for r in service.in_audit_order(alerts["audit"]).orderBy(F.desc("annualized"), "account_id", "place").collect():
            print(f"{r['merchant_norm']:<30} {r['period']:<10} {r['monthly']:>10.2f} a month")
        for name in ("price_hikes", "missed_charges", "duplicate_billing"):
            print(f"{name}: {alerts[name].count()}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
