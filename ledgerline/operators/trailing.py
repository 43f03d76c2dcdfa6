"""What an account did in the 24 hours and the 7 days up to each of its transactions, and bursts that test a card.

Rows have txn_id, account_id, ts and amount. Sums are in cents, so that they are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Windows by name, in microseconds. The longest also cuts time into the pieces that are dealt out.
SPANS = {"24h": 24 * HOUR, "7d": 7 * 24 * HOUR}


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def trailing_counts(rows: DataFrame, spans: dict[str, int] | None = None) -> DataFrame:
    """txn_id, account_id, ts and, for each span, n_* and cents_*: rows of the account from ts - span up to ts, both
    included, rows of the same instant too.

    Every row enters at its time and leaves each window just after the span, and a running sum over these changes gives
    the counts: a frame isn't summed anew for each row. Time is cut into pieces of the longest span, and a piece gets the
    rows of the one before it too, so an account with much of the data is many groups. Rows without a time are left out;
    a null amount counts as a row of nothing.
    """
    spans = spans or SPANS
    longest = max(spans.values())
    own = F.floor(F.col("_at") / longest)
    base = rows.where(F.col("ts").isNotNull()).select("txn_id", "account_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), F.coalesce(cents(F.col("amount")), F.lit(0)).alias("_cents"))
    base = base.withColumn("_own", own).withColumn("_piece", F.explode(F.array(own, own + 1)))

    def change(name: str | None, at: Column, sign: int) -> Column:
        fields = [F.lit(sign if name in (None, k) else 0).alias(f"_n_{k}") for k in spans]
        fields += [(F.lit(sign if name in (None, k) else 0) * F.col("_cents")).alias(f"_c_{k}") for k in spans]
        return F.struct(at.alias("_when"), F.lit(name is None).alias("_enters"), *fields)

    changes = F.array(change(None, F.col("_at"), 1), *[change(k, F.col("_at") + v + 1, -1) for k, v in spans.items()])
    moves = base.withColumn("_change", F.explode(changes)).select("txn_id", "account_id", "ts", "_own", "_piece", "_change.*").where(F.col("_when") < (F.col("_piece") + 1) * longest)
    so_far = Window.partitionBy("account_id", "_piece").orderBy("_when").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for k in spans:
        moves = moves.withColumn(f"n_{k}", F.sum(f"_n_{k}").over(so_far)).withColumn(f"cents_{k}", F.sum(f"_c_{k}").over(so_far))
    return moves.where(F.col("_enters") & (F.col("_own") == F.col("_piece"))).select("txn_id", "account_id", "ts", *[f"{x}_{k}" for k in spans for x in ("n", "cents")])


def bursts(rows: DataFrame, gap: str = "10 minutes", small: float = 5.0, least: int = 3, large: float = 50.0) -> DataFrame:
    """Sessions of an account, each row at most `gap` after the one before it, in which at least `least` charges of up
    to `small` are followed by one of `large` or more: how a stolen card is tried out before it is used.

    account_id, began, ended (the last row's time plus the gap), n, n_small, total_cents. Rows without a time belong to no
    session. Works on batches, and on streams with a watermark on ts, where a session comes out when it can't grow.
    """
    size = F.abs("amount")
    is_small, is_large = size <= small, size >= large
    session = rows.groupBy("account_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("n"), F.count_if(is_small).alias("n_small"), F.sum(cents(size)).alias("total_cents"), F.min(F.when(is_small, F.col("ts"))).alias("_first_small"), F.max(F.when(is_large, F.col("ts"))).alias("_last_large")
    )
    found = session.where((F.col("n_small") >= least) & (F.col("_last_large") > F.col("_first_small")))
    return found.select("account_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n", "n_small", "total_cents")
