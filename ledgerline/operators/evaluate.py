"""How well anomaly scores and recurring groups match labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_at_k(rows: DataFrame, k: int = 10) -> DataFrame:
    """(account_id, precision) of the k highest anomaly_score rows; rows has is_anomaly."""
    top = Window.partitionBy("account_id").orderBy(F.desc("anomaly_score"), "txn_id")
    return rows.withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= k).groupBy("account_id").agg(F.avg(F.col("is_anomaly").cast("int")).alias("precision"))


def pr_auc(rows: DataFrame) -> DataFrame:
    """(account_id, pr_auc): precision summed over steps of recall, ties of score as one step."""
    w = Window.partitionBy("account_id").orderBy(F.desc("anomaly_score"))
    step = rows.groupBy("account_id", "anomaly_score").agg(F.sum(F.col("is_anomaly").cast("int")).alias("hits"), F.count("*").alias("n"))
    step = step.withColumns({"found": F.sum("hits").over(w), "seen": F.sum("n").over(w), "all": F.sum("hits").over(Window.partitionBy("account_id"))})
    return step.groupBy("account_id").agg(F.try_divide(F.sum(F.col("found") / F.col("seen") * F.col("hits")), F.max("all")).alias("pr_auc"))


def recall_by_type(rows: DataFrame, percentile: float = 0.9) -> DataFrame:
    bar = F.percentile("anomaly_score", F.lit(percentile)).over(Window.partitionBy("account_id"))
    hit = rows.withColumn("hit", F.col("anomaly_score") >= bar)
    return hit.where("is_anomaly").groupBy("anomaly_type").agg(F.avg(F.col("hit").cast("int")).alias("recall"), F.count("*").alias("n"))


def series_quality(found: DataFrame, expected: DataFrame, key: list[str]) -> tuple[float, float]:
    """Precision and recall of found series, as sets of keys."""
    f, e = found.select(*key).distinct(), expected.select(*key).distinct()
    both = f.intersect(e).count()
    return both / max(1, f.count()), both / max(1, e.count())
