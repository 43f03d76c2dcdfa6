"""Exports into the ledger: account, occurrence, identity, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import txn_id
from .scratch import written
from .sources.exports import read_exports


def with_accounts(rows: DataFrame, account: str | None = None) -> DataFrame:
    """account_id: the record's own, the caller's, or the file's name; without any, the row fails."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return rows.withColumn("account_id", F.coalesce("own_account", F.lit(account) if account else F.nullif(stem, F.lit(""))))


def identified(rows: DataFrame) -> DataFrame:
    """txn_id by content and occurrence within the file, or by the bank's own id."""
    same = Window.partitionBy("file", "account_id", "posted_date", "amount_text", "raw_description").orderBy("row_no")
    rows = rows.withColumn("occurrence", F.row_number().over(same) - 1)
    key = txn_id(F.col("account_id"), F.col("posted_date"), F.col("amount_text"), F.col("raw_description"), F.col("occurrence"), F.col("fitid"))
    return rows.withColumn("txn_id", key)


def transactions(rows: DataFrame) -> DataFrame:
    ok = identified(rows.where((F.col("status") == "ok") & F.col("account_id").isNotNull()))
    return ok.select(
        "txn_id", "account_id", "posted_date", "amount", "amount_text", F.lit("USD").alias("currency"), "raw_description", F.col("format").alias("source_format"), F.col("file").alias("source_file"), "row_no",
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("category_source"),
    )


#: Failures that a report shows for a file; it counts all.
SHOWN = 5


def report(rows: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A row for each file: rows parsed, skipped, already stored and failed, and the first reasons of failures."""
    counts = rows.groupBy("file").agg(
        F.first("format", ignorenulls=True).alias("format"), F.count_if(F.col("status") == "ok").alias("parsed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    first = F.row_number().over(Window.partitionBy("file").orderBy(F.asc_nulls_first("row_no"), "reason"))
    failed = rows.where("status = 'failed'").select("file", "row_no", "reason").withColumn("at", first).where(F.col("at") <= SHOWN)
    failed = failed.groupBy(F.col("file").alias("_file")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda x: x["reason"]).alias("failures"))
    out = counts.join(failed, F.col("file") == F.col("_file"), "left").drop("_file").withColumn("failures", F.coalesce("failures", F.array().cast("array<string>")))
    if stored is None:
        return out.withColumn("deduped", F.lit(0).cast("long"))
    again = transactions(rows).join(stored.select("txn_id"), "txn_id", "left_semi").groupBy(F.col("source_file").alias("_file")).agg(F.count("*").alias("deduped"))
    return out.join(again, F.col("file") == F.col("_file"), "left").drop("_file").withColumn("deduped", F.coalesce("deduped", F.lit(0).cast("long")))


def load(spark: SparkSession, paths: str | list[str], store, account: str | None = None, layout: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Read exports once, add what is new to the store; the report, and the totals (parsed, skipped, failed, added).

    Files are parsed in one pass, which writes their rows; report, totals and the store read the columns they need of these.
    """
    rows = written(with_accounts(read_exports(spark, paths, layout), account), "exports")
    summary = written(report(rows, store.read()), "report")
    sums = summary.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("parsed", "skipped", "failed")]).first()
    return summary, sums.asDict() | {"added": store.upsert(transactions(rows))}


def ingest(spark: SparkSession, paths: str | list[str], store, account: str | None = None, layout: str | None = None) -> DataFrame:
    """Read exports, add what is new to the store, return the report."""
    return load(spark, paths, store, account, layout)[0]
