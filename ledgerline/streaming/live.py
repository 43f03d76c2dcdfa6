"""Streams of transactions: idempotent arrival, and velocity over sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ingest import transactions, with_accounts
from ..operators.store import Store
from ..sources.datasource import register


def first_arrivals(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Each txn_id once, as long as its copies arrive within `late` of each other. stream: txn_id, ts, ..."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["txn_id"])


def velocity(stream: DataFrame, width: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and sums of each account in sliding windows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def into_store(stream: DataFrame, store: Store, checkpoint: str):
    """Add arrivals to the store batch by batch; a batch that is run again adds nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: store.upsert(batch)).option("checkpointLocation", checkpoint).start()


def exports_into_store(spark: SparkSession, path: str, store: Store, checkpoint: str, account: str | None = None):
    """Add the transactions of export files to the store as the files arrive. A file is whole in one batch, so its equal
    rows are told apart as in a single ingest."""
    rows = register(spark).readStream.format("bank_exports").load(path)
    add = lambda batch, _: store.upsert(transactions(with_accounts(batch, account)))
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
