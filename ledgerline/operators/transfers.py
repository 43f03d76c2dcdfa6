"""Transfers between own accounts."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_transfer
from ..scratch import written

WITHIN_DAYS = 3
#: Days of one amount that are settled together.
SPAN_DAYS = 60


def eligible(ledger: DataFrame) -> DataFrame:
    return ledger.where(looks_like_transfer(F.col("raw_description"))).withColumn("cents", F.round(F.abs("amount") * 100).cast("long"))


def candidate_pairs(ledger: DataFrame, within: int = WITHIN_DAYS) -> DataFrame:
    """(a_id, b_id, gap) of opposite amounts in different accounts, a before b: an equi-join on the amount."""
    e = eligible(ledger).select("txn_id", "account_id", "posted_date", "amount", "cents")
    a, b = e.select(*[F.col(c).alias(f"a_{c}") for c in e.columns]), e.select(*[F.col(c).alias(f"b_{c}") for c in e.columns])
    gap = F.datediff("b_posted_date", "a_posted_date")
    later = (gap > 0) | ((gap == 0) & (F.col("a_txn_id") < F.col("b_txn_id")))
    pairs = a.join(b, (F.col("a_cents") == F.col("b_cents")) & (F.col("a_amount") == -F.col("b_amount")) & (F.col("a_account_id") != F.col("b_account_id")) & later & (gap <= within))
    return pairs.select(F.col("a_txn_id").alias("a_id"), F.col("b_txn_id").alias("b_id"), gap.cast("long").alias("gap"))


class Waiting:
    """Rows of one side that wait for a partner, by account: the first one that another account may take is found
    without passing the others."""

    def __init__(self, within: int):
        self.within, self.by_account, self.first = within, {}, []

    def add(self, order: int, account, day: int, row: tuple) -> None:
        own = self.by_account.setdefault(account, deque())
        own.append((order, day, row))
        if len(own) == 1:
            heapq.heappush(self.first, (order, account))

    def _drop_first(self, account) -> tuple:
        heapq.heappop(self.first)
        own = self.by_account[account]
        gone = own.popleft()
        if own:
            heapq.heappush(self.first, (own[0][0], account))
        else:
            del self.by_account[account]
        return gone

    def take(self, account, day: int) -> tuple | None:
        """The earliest row of another account that isn't more than `within` days old."""
        aside = None
        while self.first:
            _, whose = self.first[0]
            if self.by_account[whose][0][1] < day - self.within:
                self._drop_first(whose)
            elif whose == account:
                aside = heapq.heappop(self.first)
            else:
                break
        found = self._drop_first(self.first[0][1]) if self.first else None
        if aside is not None:
            heapq.heappush(self.first, aside)
        return found and found[2]

    def rows(self) -> Iterator[tuple]:
        return (row for own in self.by_account.values() for _, _, row in own)


def settled(rows: DataFrame, within: int, span: int) -> DataFrame:
    """What each piece (size, piece) of rows comes to by itself: pairs (txn_id, partner), and rows that still wait for one
    of the next piece (partner is null). Rows are dealt by piece and sorted by Spark; Python keeps what waits."""
    kind = dict(rows.dtypes)
    names = ["size", "piece", "txn_id", "account_id", "day", "side", "partner"]
    schema = rows.select("size", "piece", "txn_id", "account_id", "day", "side", F.col("txn_id").alias("partner")).schema
    for f in schema:
        f.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, sides, order, out = None, {}, 0, []
        types = None

        def close() -> None:
            if piece is None:
                return
            last = (piece[1] + 1) * span - within  # later rows may meet the next piece; those of the piece before can't
            out.extend((*piece, *row, None) for side in sides.values() for row in side.rows() if row[2] >= last)

        for b in batches:
            types = [b.schema.field(c).type for c in names[:-1]]
            for size, at, *row in zip(*(b.column(c).to_pylist() for c in names[:-1]), strict=True):
                if (size, at) != piece:
                    close()
                    piece, sides = (size, at), {s: Waiting(within) for s in (-1, 0, 1)}
                txn, account, day, side = row
                other = sides[-side].take(account, day)
                if other is None:
                    order += 1
                    sides[side].add(order, account, day, tuple(row))
                else:
                    out.append((*piece, *other, txn))
            if len(out) >= 10_000:
                yield _rows(out, types, names)
                out = []
        close()
        if out:
            yield _rows(out, types, names)

    assert kind["side"] == "int" and kind["day"] == "int"
    return rows.repartition("size", "piece").sortWithinPartitions("size", "piece", "day", "txn_id").select(*names[:-1]).mapInArrow(run, schema)


def _rows(out: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*types, types[2]], strict=True)], names=names)


def transfer_pairs(ledger: DataFrame, within: int = WITHIN_DAYS, span: int = SPAN_DAYS) -> DataFrame:
    """(a_id, b_id): each row, by date, takes the first later row that fits and isn't taken.

    All rows rank partners alike, by date, so that is also what comes out if each row, as it arrives, takes the earliest
    one that waits. An amount's days are cut into pieces, which are settled side by side, as if nothing waited from before;
    then pieces to which rows are left over from the piece before are settled again with them, until no piece gets others
    than it was settled with. Leftovers are three days of an amount, and a queue of an amount forgets how it began as soon
    as it is empty or its oldest rows expire, so a few rounds do; there are never more than an amount has pieces. Rows
    without an amount, a date or an account take no part.
    """
    whole = eligible(ledger).where("amount IS NOT NULL AND posted_date IS NOT NULL AND account_id IS NOT NULL")
    day = F.unix_date("posted_date")
    rows = whole.select("txn_id", "account_id", day.alias("day"), F.abs("amount").alias("size"), F.signum(F.col("amount").cast("double")).cast("int").alias("side"), F.floor(day / max(span, within + 1)).cast("int").alias("piece"))
    span = max(span, within + 1)
    rows = written(rows, "transfers")
    key = ["size", "piece"]
    out = written(settled(rows, within, span), "settled")
    used = None
    while True:
        left = out.where("partner IS NULL").select("txn_id", "account_id", "day", "size", "side", (F.col("piece") + 1).alias("piece"))
        left = left.join(rows.select(*key).distinct(), key, "left_semi")
        now = written(left.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.xxhash64("txn_id", "account_id").cast("decimal(38,0)")).alias("h")), "leftovers")
        if used is None:
            again = now.select(*key)
        else:
            before = used.withColumnsRenamed({"n": "n_before", "h": "h_before"})
            again = now.join(before, key, "full").where("NOT (n <=> n_before AND h <=> h_before)").select(*key)
        if again.isEmpty():
            return out.where("partner IS NOT NULL").select(F.col("txn_id").alias("a_id"), F.col("partner").alias("b_id"))
        redone = settled(rows.unionByName(left).join(again, key, "left_semi"), within, span)
        out, used = written(out.join(again, key, "left_anti").unionByName(redone), "settled"), now


def transfer_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a_id").alias("txn_id")).union(pairs.select(F.col("b_id").alias("txn_id"))).distinct()


def without_transfers(ledger: DataFrame, pairs: DataFrame) -> DataFrame:
    return ledger.join(transfer_ids(pairs), "txn_id", "left_anti")
