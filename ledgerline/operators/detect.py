"""Anomaly signals: each adds a score and a reason column to a ledger (txn_id, account_id, posted_date, amount,
merchant_norm, category, raw_description). All windows are partitioned by account, most by account and merchant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import state


def by_account():
    return Window.partitionBy("account_id")


def by_merchant():
    return Window.partitionBy("account_id", "merchant_norm")


def in_order():
    return by_merchant().orderBy("posted_date", "txn_id")


#: Rows that one task sorts, about.
TASK_ROWS = 250_000


def dealt(ledger: DataFrame) -> DataFrame:
    """ledger by account and merchant, in as many partitions as its rows ask for. Spark would choose by compressed bytes,
    of which a ledger's rows take so few that one task would sort millions of them."""
    n = max(ledger.sparkSession.sparkContext.defaultParallelism, -(-ledger.count() // TASK_ROWS))
    return ledger.repartition(n, "account_id", "merchant_norm")


def account_order():
    return by_account().orderBy("posted_date", "txn_id")


def mad_scores(ledger: DataFrame) -> DataFrame:
    """med, mad (1 at least) and z of |amount| by account and category."""
    w = Window.partitionBy("account_id", "category")
    out = ledger.withColumn("med", F.median(F.abs("amount")).over(w))
    out = out.withColumn("mad", F.greatest(F.median(F.abs(F.abs("amount") - F.col("med"))).over(w), F.lit(1.0)))
    return out.withColumn("z", 0.6745 * (F.abs("amount") - F.col("med")) / F.col("mad"))


# The texts of reasons. Each signal s_x has its text in why_x.
OUTLIER_TEXT = "amount $%.2f is far outside the usual range for %s (robust z-score %.1f)"
NEW_TEXT = "first-ever transaction with %s, amount $%.2f"
VELOCITY_TEXT = "%d transactions on %s vs a typical %.1f/day for this account (p=%.4f)"
DUPLICATE_TEXT = "duplicate charge: same merchant and amount ($%.2f) %d day(s) apart"
GEO_TEXT = "descriptor geo %s doesn't match this account's usual %s"
WEEKDAY_TEXT = "%s usually seen on different days of the week"
EXTREME_TEXT = "$%.2f is more than %.0fx anything seen on this account so far"
MULTIPLE = 5


def quoted(text: Column) -> Column:
    """A text in single quotes, or in double ones if it holds a single one."""
    mark = F.when(text.contains("'") & ~text.contains('"'), '"').otherwise("'")
    return F.concat(mark, text, mark)


def with_signal(rows: DataFrame, name: str, score: Column, text: str, *values: Column) -> DataFrame:
    """rows with the score s_name and, where there is one, its reason why_name."""
    rows = rows.withColumn(f"s_{name}", score)
    return rows.withColumn(f"why_{name}", F.when(F.col(f"s_{name}").isNotNull(), F.format_string(text, *values)))


def amount_outlier(ledger: DataFrame) -> DataFrame:
    score = F.when(F.col("z") > 3.5, F.least(F.lit(1.0), F.col("z") / 10))
    return with_signal(mad_scores(ledger), "outlier", score, OUTLIER_TEXT, F.abs("amount").cast("double"), F.col("category"), F.col("z").cast("double"))


def new_merchant(ledger: DataFrame, recurring: DataFrame | None = None) -> DataFrame:
    """First row of a merchant that isn't recurring, by size. recurring: (account_id, merchant_norm)."""
    out = ledger.withColumn("first_seen", F.row_number().over(in_order()) == 1)
    if recurring is not None:
        out = out.join(recurring.select("account_id", "merchant_norm").distinct().withColumn("known", F.lit(True)).hint("merge"), ["account_id", "merchant_norm"], "left")
        out = out.withColumn("first_seen", F.col("first_seen") & F.col("known").isNull()).drop("known")
    weight = F.least(F.lit(1.0), F.abs("amount") / 500)
    return with_signal(out, "new", F.when(F.col("first_seen") & (weight > 0.1), weight), NEW_TEXT, quoted(F.col("merchant_norm")), F.abs("amount").cast("double"))


def poisson_tail(count: Column, mean: Column) -> Column:
    """P(X >= count), each term from the one before; in logarithms, so that counts of any size do."""
    term = lambda a, k: F.when(k == 0, -mean).otherwise(a["log"] + F.log(mean) - F.log(k.cast("double")))
    step = lambda a, k: F.struct(term(a, k).alias("log"), (a["sum"] + F.exp(term(a, k))).alias("sum"))
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    return 1 - F.aggregate(F.sequence(F.lit(0), (count - 1).cast("int")), start, step, lambda a: a["sum"])


def velocity(ledger: DataFrame) -> DataFrame:
    """Days with more rows than an account's usual day explains. The days are counted before they meet by account."""
    days = ledger.groupBy("account_id", "posted_date").agg(F.count("*").alias("day_count")).withColumn("day_rate", F.avg("day_count").over(by_account()))
    days = days.withColumn("p_day", F.when(F.col("day_count") >= 3, poisson_tail(F.col("day_count"), F.col("day_rate"))))
    out = ledger.join(days, ["account_id", "posted_date"], "left")
    score = F.when(F.col("p_day") < 0.01, F.least(F.lit(1.0), 1 - F.col("p_day")))
    return with_signal(out, "velocity", score, VELOCITY_TEXT, F.col("day_count"), F.col("posted_date").cast("string"), F.col("day_rate"), F.col("p_day"))


def duplicate_charge(ledger: DataFrame) -> DataFrame:
    """Both rows of neighbours of one merchant and amount at most a day apart."""
    w = Window.partitionBy("account_id", "merchant_norm", "amount").orderBy("posted_date", "txn_id")
    before, after = F.datediff("posted_date", F.lag("posted_date").over(w)), F.datediff(F.lead("posted_date").over(w), "posted_date")
    out = ledger.withColumn("dup_gap", F.when(after <= 1, after).when(before <= 1, before).cast("long"))
    return with_signal(out, "duplicate", F.when(F.col("dup_gap").isNotNull(), F.lit(1.0)), DUPLICATE_TEXT, F.abs("amount").cast("double"), F.col("dup_gap"))


def geo_mismatch(ledger: DataFrame) -> DataFrame:
    out = ledger.withColumn("state", state(F.col("raw_description")))
    out = out.withColumn("home", F.mode("state", True).over(by_account()))
    return with_signal(out, "geo", F.when(F.col("state") != F.col("home"), F.lit(0.15)), GEO_TEXT, quoted(F.col("state")), quoted(F.col("home")))


def unusual_weekday(ledger: DataFrame) -> DataFrame:
    day = F.weekday("posted_date")
    out = ledger.withColumn("on_day", F.count("*").over(Window.partitionBy("account_id", "merchant_norm", F.weekday("posted_date")))).withColumn("n_merchant", F.count("*").over(by_merchant()))
    common = F.max(F.col("on_day")).over(by_merchant()) >= 2
    out = out.withColumn("weekday", day.cast("long")).withColumn("common_day", common)
    score = F.when((F.col("n_merchant") >= 5) & (F.col("on_day") < 2) & F.col("common_day"), F.lit(0.2))
    return with_signal(out, "weekday", score, WEEKDAY_TEXT, F.col("merchant_norm"))


def extreme_amount(ledger: DataFrame) -> DataFrame:
    """More than MULTIPLE times any earlier amount: for accounts with little history."""
    before = F.max(F.abs("amount")).over(account_order().rowsBetween(Window.unboundedPreceding, -1))
    score = F.when((F.col("top_before") > 0) & (F.abs("amount") > MULTIPLE * F.col("top_before")), F.lit(1.0))
    return with_signal(ledger.withColumn("top_before", before), "extreme", score, EXTREME_TEXT, F.abs("amount").cast("double"), F.lit(float(MULTIPLE)))


def cold_start(ledger: DataFrame) -> DataFrame:
    n, days = F.count("*").over(by_account()), F.datediff(F.max("posted_date").over(by_account()), F.min("posted_date").over(by_account()))
    return ledger.withColumn("cold_start", (n < 30) | (days < 30))


#: Signals that count for accounts with a history, and for those with little.
WARM = ["outlier", "new", "velocity", "duplicate", "geo", "weekday"]
COLD = ["duplicate", "extreme"]


def percentile_of_history(score: str) -> Column:
    """rank with ties averaged, over the account's count."""
    ranked = Window.partitionBy("account_id").orderBy(score)
    ties = F.count("*").over(Window.partitionBy("account_id", score))
    return (F.rank().over(ranked) + (ties - 1) / 2.0) / F.count("*").over(by_account())


def rule_scores(ledger: DataFrame, recurring: DataFrame | None = None) -> DataFrame:
    """rule_score, anomaly_reasons with their figures, anomaly_score (the percentile of rule_score in the account) and
    cold_start for every row."""
    out = ledger
    for signal in (amount_outlier, velocity, duplicate_charge, geo_mismatch, unusual_weekday, extreme_amount, cold_start):
        out = signal(out)
    out = new_merchant(out, recurring)
    top = lambda names: F.greatest(F.lit(0.0), *[F.coalesce(f"s_{n}", F.lit(0.0)) for n in names])
    why = lambda names: F.array_compact(F.array(*[F.col(f"why_{n}") for n in names]))
    out = out.withColumn("rule_score", F.when(F.col("cold_start"), top(COLD)).otherwise(top(WARM)))
    out = out.withColumn("anomaly_reasons", F.when(F.col("cold_start"), why(COLD)).otherwise(why(WARM)))
    return out.withColumn("anomaly_score", percentile_of_history("rule_score"))
