"""Recurring charges and the alerts that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PERIODS
from .detect import by_merchant, dealt, in_order
from .order_stats import with_expanding_median

KEY = ["account_id", "merchant_norm"]


def gaps(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("gap", F.datediff("posted_date", F.lag("posted_date").over(in_order())).cast("long"))


def middle_of_three(values: Column) -> Column:
    """The median of at most three sorted values."""
    return F.when(F.size(values) == 2, 0.5 * F.get(values, F.lit(0)) + 0.5 * F.get(values, F.lit(1))).otherwise(F.get(values, F.floor(F.size(values) / 2).cast("int")))


def group_stats(ledger: DataFrame) -> DataFrame:
    """Per account and merchant: n, share of gaps near each period, mean and deviation of |amount|, last date."""
    near = [F.avg((F.abs(F.col("gap") - days) <= tolerance).cast("int")).alias(f"p_{name}") for name, days, tolerance, _ in PERIODS]
    rows = gaps(dealt(ledger)).withColumn("at", F.row_number().over(in_order()))
    rows = rows.withColumn("age", F.count("*").over(by_merchant()) - F.col("at") + 1)  # no second sorting
    recent = F.when(F.col("age") <= 3, F.col("amount"))
    last = F.array_sort(F.array_compact(F.array(*[F.max(F.when(F.col("age") == i, F.col("amount").cast("double"))) for i in (1, 2, 3)])))
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("n"), *near, F.avg(F.abs("amount")).alias("mean_amount"), F.stddev_pop(F.abs("amount")).alias("sd_amount"), F.max("posted_date").alias("last_date"),
        middle_of_three(last).alias("band_mid"), F.coalesce(F.stddev_pop(recent), F.lit(0.0)).alias("band_sd"),
    )


def scored_groups(ledger: DataFrame) -> DataFrame:
    """Best period, amount score and confidence for every group of three rows or more."""
    best = F.greatest(*[F.col(f"p_{name}") for name, *_ in PERIODS])
    pick = lambda value: F.coalesce(*[F.when(F.col(f"p_{p[0]}") == F.col("period_score"), F.lit(value(p))) for p in PERIODS])
    g = group_stats(ledger).where("n >= 3").withColumn("period_score", best)
    g = g.withColumn("period", F.when(F.col("period_score") > 0, pick(lambda p: p[0]))).withColumn("period_days", F.when(F.col("period_score") > 0, pick(lambda p: p[1])).cast("long"))
    cv = F.col("sd_amount") / F.col("mean_amount")
    g = g.withColumn("amount_score", F.when(F.col("mean_amount") == 0, 0.0).when(cv <= 0.15, 1.0).when(cv <= 0.5, 0.6).otherwise(0.2))
    p, a = F.col("period_score"), F.col("amount_score")
    strong = F.when((p < 0.85) & (a < 0.6), p * a).otherwise(F.greatest(p * a, 0.9 * F.least(p, a)))
    return g.withColumn("confidence", F.round(strong * F.least(F.lit(1.0), F.col("n") / 6), 3))


def recurring_groups(ledger: DataFrame, least: float = 0.5) -> DataFrame:
    g = scored_groups(ledger).where((F.col("confidence") >= least) & F.col("period").isNotNull())
    return g.withColumn("predicted_next", F.date_add("last_date", F.col("period_days").cast("int")))


def members(ledger: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the groups. Both sides grow with the ledger, whatever Spark guesses from its files: neither is broadcast."""
    return dealt(ledger).join(groups.select(*KEY, "period", "period_days", "confidence").hint("merge"), KEY)


def price_hikes(ledger: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows over 10 % and 2.0 above the median of the group's earlier amounts."""
    rows = with_expanding_median(members(ledger, groups).select(*KEY, "txn_id", "posted_date", "amount"), KEY, ["posted_date", "txn_id"], F.abs("amount"), "old")
    rows = rows.withColumn("new", F.abs("amount"))
    change = F.col("new") - F.col("old")
    rows = rows.where((F.col("old") > 0) & (change > 2.0) & (change / F.col("old") > 0.10))
    return rows.select(*KEY, "txn_id", "posted_date", F.round("old", 2).alias("old_amount"), F.round("new", 2).alias("new_amount"), F.round(change / F.col("old"), 3).alias("pct_change"))


def missed_charges(groups: DataFrame, as_of: Column, grace: int = 5) -> DataFrame:
    late = F.datediff(as_of, "predicted_next").cast("long")
    return groups.withColumn("days_late", late).where(F.col("days_late") > grace)


def duplicate_billing(ledger: DataFrame, groups: DataFrame, within: int = 3) -> DataFrame:
    rows = members(ledger, groups).withColumn("prev_date", F.lag("posted_date").over(in_order()))
    return rows.where(F.datediff("posted_date", "prev_date") <= within).select(*KEY, "txn_id", "prev_date", "posted_date", F.abs("amount").alias("charged"))


def subscription_audit(ledger: DataFrame, groups: DataFrame) -> DataFrame:
    a_year = F.coalesce(*[F.when(F.col("period") == name, F.lit(n)) for name, _, _, n in PERIODS], F.lit(12))
    g = members(ledger, groups).groupBy(*KEY, "period").agg(F.avg(F.abs("amount")).alias("mean"))
    return g.select(*KEY, "period", F.round(F.col("mean") * a_year, 2).alias("annualized"), F.round(F.col("mean") * a_year / 12, 2).alias("monthly"))
