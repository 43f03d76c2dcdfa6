"""The first of many keywords that a text holds, by an index of the keywords' ends instead of one test after another."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters at both ends of a keyword by which texts are searched for where it may stand.
GRAM = 3
#: Keywords that are broadcast, at most; a larger table is joined as any table.
BROADCAST_KEYWORDS = 100_000


def _runs(text: Column, n: int) -> Column:
    """Each run of n letters with its place from 1; the empty run stands once."""
    run = lambda i: F.struct(i.alias("at"), F.substring(text, i, F.lit(n)).alias("head"))
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))) if n else F.array(F.lit(1))
    return F.when(F.length(text) >= n, F.transform(at, run)).otherwise(F.array().cast("array<struct<at:int,head:string>>"))


def rule_table(spark: SparkSession, keywords: Mapping[str, str]) -> DataFrame:
    """(at, keyword, value) of rules in their order."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(keywords.items())], "at long, keyword string, value string")


def first_keywords(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text, value) for distinct texts: the value of the first rule (at, keyword, value), by `at`, whose keyword the text
    holds in any case. Texts without one, and nulls, have no row.

    Where a text has the first letters of keywords, the pieces of these keywords' lengths are cut from it, and of them
    those stay that end as a keyword of their length does. Both are small tables, however many keywords there are. A piece
    then meets the keyword that it equals, so no text meets keywords that it doesn't hold.
    """
    given = texts.where("text IS NOT NULL").select("text").distinct().withColumn("upper", F.upper("text"))
    table = rules.groupBy(F.upper("keyword").alias("keyword")).agg(F.min("at").alias("at"), F.min_by("value", "at").alias("value")).where("keyword IS NOT NULL")
    size, none = F.length("keyword"), F.array().cast("array<struct<at:int,head:string>>")
    seen = table.agg(F.count("*").alias("n"), F.collect_set(F.least(size, F.lit(GRAM))).alias("sizes")).first()
    heads = table.groupBy(F.substring("keyword", 1, GRAM).alias("head")).agg(F.collect_set(size).alias("sizes"))
    tails = table.select(size.alias("size"), F.right("keyword", F.lit(GRAM)).alias("tail")).distinct()
    runs = given.select("text", "upper", F.explode(F.concat(none, *[_runs(F.col("upper"), n) for n in sorted(seen["sizes"])])).alias("run"))
    cut = runs.select("text", "upper", "run.*").join(F.broadcast(heads), "head").select("text", "upper", "at", F.explode("sizes").alias("size"))
    cut = cut.where(F.col("at") + F.col("size") - 1 <= F.length("upper")).withColumn("piece", F.substring("upper", F.col("at"), F.col("size")))
    cut = cut.withColumn("tail", F.right("piece", F.lit(GRAM))).join(F.broadcast(tails), ["size", "tail"], "left_semi").select("text", "piece")
    table = F.broadcast(table) if seen["n"] <= BROADCAST_KEYWORDS else table.hint("merge")
    return cut.join(table, F.col("piece") == F.col("keyword")).groupBy("text").agg(F.min_by("value", "at").alias("value"))
