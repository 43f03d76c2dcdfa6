"""An isolation forest for each account, over features that windows compute."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .detect import account_order, by_account, in_order, percentile_of_history, rule_scores

TREES, SAMPLE = 100, 256
#: Rows of an account that its trees draw from, and rows that are scored together.
POOL, CHUNK = 1024, 20_000
FEATURES = ["x_size", "x_category", "x_new", "x_weekday", "x_gap"]


def features(ledger: DataFrame) -> DataFrame:
    share = F.count("*").over(Window.partitionBy("account_id", "category")) / F.count("*").over(by_account())
    gap = F.coalesce(F.datediff("posted_date", F.lag("posted_date").over(account_order())), F.lit(0))
    new = (F.row_number().over(in_order()) == 1).cast("double")
    return ledger.withColumns({"x_size": F.log1p(F.abs("amount")), "x_category": share, "x_new": new, "x_weekday": F.weekday("posted_date").cast("double"), "x_gap": gap.cast("double")})


def _expected(n):
    """Mean path of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class Forest:
    """Trees as arrays: node i of a tree has the children 2i and 2i + 1. feature is -1 at leaves, path their length."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    depth: int
    sample: int


def grow(pool: np.ndarray, seed: int, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """All trees together, level by level, each over `sample` rows drawn from the pool without repeats."""
    rng, m = np.random.default_rng(seed), min(sample, len(pool))
    depth = int(np.ceil(np.log2(max(m, 2))))
    size = 2 << depth
    feature, cut, path = np.full(trees * size, -1), np.zeros(trees * size), np.zeros(trees * size)
    picks = np.argsort(rng.random((trees, len(pool))), axis=1)[:, :m]
    x, at = pool[picks.ravel()], np.repeat(np.arange(trees) * size + 1, m)  # each row's node, all trees in one numbering
    for d in range(depth + 1):
        order = np.argsort(at, kind="stable")
        x, at = x[order], at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        if not len(first):
            break
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        count = np.diff(np.concatenate((first, [len(at)])))
        node, wide = at[first], low < high
        split = wide.any(1) & (d < depth)
        path[node[~split]] = d + _expected(count[~split])
        by = (rng.random(wide.shape) * wide).argmax(1)
        value = rng.uniform(low[np.arange(len(by)), by], high[np.arange(len(by)), by])
        feature[node[split]], cut[node[split]] = by[split], value[split]
        base, own = node // size * size, node % size
        for child in (0, 1):  # one that gets no row is a leaf of none
            path[(base + 2 * own + child)[split]] = d + 1
        stays = np.repeat(split, count)
        x, at = x[stays], at[stays]
        right = x[np.arange(len(at)), feature[at]] >= cut[at]
        at = at // size * size + 2 * (at % size) + right
    return Forest(feature, cut, path, depth, m)


def isolation(forest: Forest, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path) of each row."""
    size = 2 << forest.depth
    trees = len(forest.path) // size
    out = np.empty(len(x))
    for begin in range(0, len(x), 2048):
        part = x[begin : begin + 2048]
        base = np.arange(trees) * size
        at, rows = np.tile(base + 1, (len(part), 1)), np.arange(len(part))[:, None]
        for _ in range(forest.depth):
            f = forest.feature[at]
            down = base + 2 * (at - base) + (part[rows, f] >= forest.cut[at])
            at = np.where(f >= 0, down, at)
        out[begin : begin + 2048] = forest.path[at].mean(1)
    return 2 ** (-out / max(1e-9, float(_expected(forest.sample))))


def scaled(score: np.ndarray) -> np.ndarray:
    """0 to 1 over the rows; zeros where all rows look alike."""
    span = score.max(initial=0) - score.min(initial=1)
    return (score - score.min()) / span if span > 1e-9 else np.zeros(len(score))


def isolation_scores(x: np.ndarray, seed: int, trees: int = TREES, sample: int = SAMPLE) -> np.ndarray:
    return scaled(isolation(grow(x, seed, trees, sample), x))


def forest_scores(ledger: DataFrame, pool: int = POOL, chunk: int = CHUNK) -> DataFrame:
    """(txn_id, forest_score): isolation within the account, scaled to 0..1 over the account's rows.

    Trees draw their samples from a pool: the account's `pool` rows with the smallest hashes, all of them in most accounts.
    Rows are scored in chunks of about `chunk` rows, each beside a copy of its account's pool from which the same trees
    grow again, which costs a fraction of the scoring. So no group holds more than a chunk and a pool, however large an
    account is, and no trees, which are larger than most accounts, are stored or sent. Hashes are of txn_id, so a row's
    place doesn't matter; rows of equal txn_id may both be in the pool.
    """
    kind = dict(ledger.dtypes)
    rows = features(ledger).select("txn_id", "account_id", *[F.col(c).cast("double").alias(c) for c in FEATURES], F.count("*").over(by_account()).alias("n"), F.xxhash64("txn_id").alias("h"))
    chunks = F.ceil(F.col("n") / chunk)
    rows = written(rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.col("h"), F.col("chunks"))), "features")
    # half again as many rows as the pool needs pass by their hashes alone; the smallest of these are the pool
    odds = F.shiftrightunsigned("h", 11) / float(1 << 53)
    likely = rows.where((F.col("n") <= 2 * pool) | (odds < 1.5 * pool / F.col("n"))).withColumn("odds", odds)
    drawn = likely.withColumn("k", F.row_number().over(Window.partitionBy("account_id").orderBy("odds", "txn_id"))).where(F.col("k") <= pool)
    drawn = drawn.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))

    def score(own: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("k")
        if not len(own):  # a chunk that no row's hash falls into
            return pd.DataFrame({"txn_id": [], "account_id": [], "raw": []})
        account = own["account_id"].iat[0]
        forest = grow(sample[[f"of_{c}" for c in FEATURES]].to_numpy(float), zlib.crc32(str(account).encode()))
        return own[["txn_id", "account_id"]].assign(raw=isolation(forest, own[FEATURES].to_numpy(float)))

    by = ["account_id", "chunk"]
    beside = drawn.select(*[F.col(c).alias(f"of_{c}") for c in (*by, *FEATURES)], "k").groupBy(*[f"of_{c}" for c in by])
    raw = rows.select(*by, "txn_id", *FEATURES).groupBy(*by).cogroup(beside).applyInPandas(score, f"txn_id {kind['txn_id']}, account_id {kind['account_id']}, raw double")
    # extremes by account are minima of partial minima, not a window over all of its rows
    ends = raw.groupBy("account_id").agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    span = F.col("high") - F.col("low")
    return raw.join(ends, "account_id").select("txn_id", F.when(span > 1e-9, (F.col("raw") - F.col("low")) / span).otherwise(0.0).alias("forest_score"))


def anomalies(ledger: DataFrame, recurring: DataFrame | None = None) -> DataFrame:
    """Rules and forest together: anomaly_score is the percentile of the larger one in the account's history."""
    rows = rule_scores(ledger, recurring).drop("anomaly_score").join(forest_scores(ledger), "txn_id")
    rows = rows.withColumn("forest_score", F.when(F.col("cold_start"), 0.0).otherwise(F.col("forest_score")))
    rows = rows.withColumn("raw_score", F.greatest("rule_score", "forest_score"))
    other = (F.col("forest_score") > F.col("rule_score")) & (F.size("anomaly_reasons") == 0)
    rows = rows.withColumn("anomaly_reasons", F.when(other, F.array(F.lit("unusual combination of factors"))).otherwise(F.col("anomaly_reasons")))
    return rows.withColumn("anomaly_score", percentile_of_history("raw_score"))
