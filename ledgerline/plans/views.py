"""Ledgers over the test tables, once for Spark and once as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Descriptions as banks print them, by the order's number.
TEMPLATES = [
    "SQ *BLUE BOTTLE COF 4155551234 CA", "AMZN MKTP US*2K3L AMZN.COM/BILL WA", "NETFLIX.COM 8667160003 CA", "SHELL OIL 57442 ATLANTA GA", "PAYPAL *SPOTIFY", "UBER *TRIP HELP.UBER.COM CA",
    "KROGER #422 ATLANTA GA", "ACME CORP PAYROLL", "ONLINE TRANSFER TO CHK 1234", "PAYMENT THANK YOU", "MONTHLY SERVICE FEE", "WHOLEFDS MKT 10234 AUSTIN TX", "ZELLE FROM J DOE", "LOCAL DINER #77 DENVER CO",
]
CATEGORIES = ["Food & Drink>Groceries", "Transport>Gas", "Housing>Rent", "Income>Salary", "Transfers>Internal Transfer", "Health>Fitness", "Entertainment>Streaming"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty accounts with years of history."""
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        key.alias("txn_id"), (F.col("o_custkey") % 50).alias("account_id"), F.to_date("o_orderdate").alias("posted_date"), (-F.col("o_totalprice")).alias("amount"),
        F.concat(F.lit("M"), (key % 40).cast("string")).alias("merchant_norm"), _pick(CATEGORIES, key).alias("category"), _pick(TEMPLATES, key).alias("raw_description"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of less than a month: cold starts."""
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"), F.to_date("ts").alias("posted_date"), (-F.col("value")).alias("amount"), F.col("event_type").alias("merchant_norm"),
        F.col("event_type").alias("category"), _pick(TEMPLATES, F.col("event_id")).alias("raw_description"),
    )


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subscription for each customer: twelve cycles of one of five periods, some with a skipped or doubled cycle or
    a higher price from the tenth on."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, (7, 14, 30, 91, 365))), (F.col("c_custkey") % 5 + 1).cast("int")).alias("days"))
    c = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).where(~((F.col("k") == 5) & (F.col("c_custkey") % 11 == 3)))
    c = c.withColumn("extra", F.explode(F.when((F.col("k") == 7) & (F.col("c_custkey") % 6 == 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    posted = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int") + F.col("k") * F.col("days") + F.col("extra"))
    amount = -(10.0 + F.col("c_custkey") % 90) * F.when((F.col("k") >= 9) & (F.col("c_custkey") % 4 == 0), F.lit(1.25)).otherwise(F.lit(1.0))
    return c.select(
        (F.col("c_custkey") * 100 + F.col("k") * 2 + F.col("extra")).alias("txn_id"), F.col("c_custkey").alias("account_id"), posted.alias("posted_date"), amount.alias("amount"),
        F.concat(F.lit("Plan "), F.col("days").cast("string")).alias("merchant_norm"), F.lit("Entertainment>Streaming").alias("category"), F.lit("NETFLIX.COM").alias("raw_description"),
    )


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two legs for each customer, up to five days apart; every fifth isn't described as a transfer."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("leg"))
    k = F.col("c_custkey")
    posted = F.date_add(F.lit("2024-01-01").cast("date"), (k % 300 + F.col("leg") * (k % 6)).cast("int"))
    text = F.when(k % 5 == 0, "GROCERY").when(F.col("leg") == 0, "ONLINE TRANSFER TO CHK").otherwise("ZELLE FROM SAVINGS")
    amount = (100.0 + k) * F.when(F.col("leg") == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return c.select((k * 2 + F.col("leg")).alias("txn_id"), (k + F.col("leg")).alias("account_id"), posted.alias("posted_date"), amount.alias("amount"), F.lit("X").alias("merchant_norm"), F.lit("Transfers>Other").alias("category"), text.alias("raw_description"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL = f"""
ord AS (SELECT o_orderkey AS txn_id, o_custkey % 50 AS account_id, CAST(o_orderdate AS DATE) AS posted_date, -o_totalprice AS amount, 'M' || (o_orderkey % 40) AS merchant_norm,
  {_list(CATEGORIES)}[CAST(o_orderkey % {len(CATEGORIES)} + 1 AS INT)] AS category, {_list(TEMPLATES)}[CAST(o_orderkey % {len(TEMPLATES)} + 1 AS INT)] AS raw_description FROM orders),
ev AS (SELECT event_id AS txn_id, user_id AS account_id, CAST(ts AS DATE) AS posted_date, -value AS amount, event_type AS merchant_norm, event_type AS category,
  {_list(TEMPLATES)}[CAST(event_id % {len(TEMPLATES)} + 1 AS INT)] AS raw_description FROM events),
plant AS (SELECT c_custkey * 100 + k * 2 + extra AS txn_id, c_custkey AS account_id, CAST(DATE '2015-01-01' + CAST(c_custkey % 28 + k * days + extra AS INT) AS DATE) AS posted_date,
  -(10.0::DOUBLE + c_custkey % 90) * CASE WHEN k >= 9 AND c_custkey % 4 = 0 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS amount, 'Plan ' || days AS merchant_norm,
  'Entertainment>Streaming' AS category, 'NETFLIX.COM' AS raw_description
  FROM (SELECT *, unnest(CASE WHEN k = 7 AND c_custkey % 6 = 1 THEN [0, 1] ELSE [0] END) AS extra FROM (SELECT c_custkey, [7, 14, 30, 91, 365][CAST(c_custkey % 5 + 1 AS INT)] AS days, unnest(range(12)) AS k FROM customer))
  WHERE NOT (k = 5 AND c_custkey % 11 = 3)),
mv AS (SELECT c_custkey * 2 + leg AS txn_id, c_custkey + leg AS account_id, CAST(DATE '2024-01-01' + CAST(c_custkey % 300 + leg * (c_custkey % 6) AS INT) AS DATE) AS posted_date,
  (100.0::DOUBLE + c_custkey) * CASE WHEN leg = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS amount, 'X' AS merchant_norm, 'Transfers>Other' AS category,
  CASE WHEN c_custkey % 5 = 0 THEN 'GROCERY' WHEN leg = 0 THEN 'ONLINE TRANSFER TO CHK' ELSE 'ZELLE FROM SAVINGS' END AS raw_description FROM (SELECT c_custkey, unnest([0, 1]) AS leg FROM customer))
"""
