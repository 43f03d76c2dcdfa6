"""The steps of enriching a ledger together, and the views that the command line shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import categorize, forest, recurring, transfers
from .schema import FALLBACK, INTERNAL_TRANSFER
from .scratch import written

#: What enriching adds; it is computed anew each time, so that no flag outlives its reason.
DERIVED = ["merchant_norm", "category", "category_source", "category_confidence", "is_recurring", "recurring_group_id", "anomaly_score", "anomaly_reasons", "cold_start"]


def enriched(ledger: DataFrame, corrections: DataFrame | None = None, model=None, rules: categorize.Rules | None = None, moved: DataFrame | None = None) -> DataFrame:
    """Transfers, categories, recurring groups and anomalies for every row, in this order. moved: (txn_id) of transfers, if
    they are known; pairs are looked for among the given rows otherwise."""
    base = ledger.drop(*DERIVED)
    named = categorize.normalized(base)
    moved = transfers.transfer_ids(transfers.transfer_pairs(ledger)) if moved is None else moved
    said = None
    if model is not None:  # only rows that no cheaper step settles
        left = categorize.rule_category(named, rules).where("rule_category IS NULL").drop("rule_category")
        said = model.predict(left).select("txn_id", "model_category", "model_confidence")
    rows = categorize.categorized(named, corrections, said, moved, rules=rules)
    rows = written(rows.withColumn("amount", F.col("amount").cast("double")), "categorized")  # the steps below read it ten times
    own = rows.where(F.coalesce(F.col("category"), F.lit(FALLBACK)) != INTERNAL_TRANSFER)
    groups = recurring.recurring_groups(own)
    flags = groups.select("account_id", "merchant_norm", F.lit(True).alias("is_recurring"), F.concat_ws(":", "account_id", "merchant_norm").alias("recurring_group_id"))
    found = forest.anomalies(own, groups).select("txn_id", "anomaly_score", "anomaly_reasons", "cold_start")
    out = rows.join(flags, ["account_id", "merchant_norm"], "left").join(found, "txn_id", "left")
    moved_row = F.col("category") == INTERNAL_TRANSFER
    return out.withColumns({"amount": F.col("amount").cast("decimal(12,2)"), "is_recurring": ~moved_row & F.coalesce("is_recurring", F.lit(False)), "recurring_group_id": F.when(~moved_row, F.col("recurring_group_id"))})


def affected_accounts(ledger: DataFrame, moved: DataFrame, corrections: DataFrame) -> DataFrame:
    """(account_id) whose derived columns can differ from what is stored: accounts with rows that were never enriched, with
    rows of a merchant that a user has since corrected, and with rows that became or ceased to be transfers. All else
    about a row follows from its own account."""
    said = ledger.join(moved.withColumn("_moved", F.lit(True)), "txn_id", "left").join(corrections.withColumnRenamed("user_category", "_said"), "merchant_norm", "left")
    was, now = F.coalesce(F.col("category") == INTERNAL_TRANSFER, F.lit(False)), F.coalesce("_moved", F.lit(False))
    corrected = ~now & F.col("_said").isNotNull() & ~(F.col("category").eqNullSafe(F.col("_said")) & F.col("category_source").eqNullSafe(F.lit("user")))
    return said.where(F.col("category").isNull() | (was != now) | corrected).select("account_id").distinct()


def enrich_new(store, model=None, rules: categorize.Rules | None = None) -> int:
    """Bring a store up to date: only accounts that new rows, corrections or transfers touch are computed and written
    anew; how many. The result is that of enriching all. With another model or other rules than before, enrich all."""
    version, ledger, corrections = store.version(), store.read(), store.corrections()
    if ledger is None:
        return 0
    if "merchant_norm" not in ledger.columns:
        store.write(enriched(ledger, corrections, model, rules), version)
        return store.read().select("account_id").distinct().count()
    moved = written(touched_transfers(ledger), "moved")
    accounts = written(affected_accounts(ledger, moved, corrections), "affected")
    n = accounts.count()
    if n:
        mine = ledger.join(accounts.withColumnRenamed("account_id", "_mine"), F.col("account_id").eqNullSafe(F.col("_mine")), "left_semi")
        store.replace_accounts(enriched(mine, corrections, model, rules, moved), accounts, version)
    return n


def touched_transfers(ledger: DataFrame) -> DataFrame:
    """(txn_id) of all transfers: rows pair within one amount, so only amounts with new rows are matched again, and the
    stored answer stands for the others."""
    sizes = transfers.eligible(ledger).where("category IS NULL").select(F.abs("amount").alias("_size")).distinct()
    again = ledger.join(sizes, F.abs("amount") == F.col("_size"), "left_semi")
    rest = ledger.where(F.col("category") == INTERNAL_TRANSFER).join(sizes, F.abs("amount") == F.col("_size"), "left_anti")
    return transfers.transfer_ids(transfers.transfer_pairs(again)).union(rest.select("txn_id"))


def monthly_summary(ledger: DataFrame) -> DataFrame:
    rows = ledger.where(F.col("category").isNotNull() & ~F.col("category").startswith("Transfers>"))
    return rows.groupBy(F.date_format("posted_date", "yyyy-MM").alias("month"), "category").agg(F.sum(F.abs("amount")).alias("total"))


def recurring_alerts(ledger: DataFrame, as_of: Column | None = None) -> dict[str, DataFrame]:
    rows = ledger.where(F.col("category").isNull() | (F.col("category") != INTERNAL_TRANSFER))
    groups = recurring.recurring_groups(rows)
    if as_of is None:
        last = rows.groupBy("account_id").agg(F.max("posted_date").alias("as_of"))
        missed = recurring.missed_charges(groups.join(last, "account_id"), F.col("as_of"))
    else:
        missed = recurring.missed_charges(groups, as_of)
    return {
        "groups": groups, "price_hikes": recurring.price_hikes(rows, groups), "missed_charges": missed, "duplicate_billing": recurring.duplicate_billing(rows, groups),
        "audit": recurring.subscription_audit(rows, groups),
    }


def in_audit_order(audit: DataFrame) -> DataFrame:
    """audit with `place`: an account's subscriptions from the dearest on, by what they cost a year."""
    dearest = Window.partitionBy("account_id").orderBy(F.desc("annualized"), "merchant_norm", "period")
    return audit.withColumn("place", F.row_number().over(dearest).cast("long"))


def page(ledger: DataFrame, account: str | None = None, category: str | None = None, least: float | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = ledger
    for column, value in (("account_id", account), ("category", category)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if least is None else rows.where(F.col("anomaly_score") >= least)
    return rows.orderBy("posted_date", "txn_id").offset(offset).limit(limit)
