"""Positions of regular-expression matches with built-in SQL functions alone. Positions are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner sum of running() covers.
_BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def running(numbers: Column, whole=total, both=lambda a, b: a + b) -> Column:
    """Sums of the first 1, 2, ... numbers, or what else whole() makes of several and both() of two; by blocks, so that the
    work isn't the square of the length."""
    blocks = F.transform(
        F.when(F.size(numbers) > 0, F.sequence(F.lit(0), ((F.size(numbers) - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda b: F.slice(numbers, b * _BLOCK + 1, F.lit(_BLOCK)),
    )

    def inner(bs: Column) -> Column:
        sums = F.transform(bs, whole)
        return let(
            sums,
            lambda s: F.flatten(
                F.transform(
                    bs,
                    lambda x, i: let(
                        whole(F.slice(s, F.lit(1), i)),
                        lambda before: F.transform(x, lambda _, j: both(before, whole(F.slice(x, F.lit(1), j + 1)))),
                    ),
                )
            ),
        )

    return let(blocks, inner)


EMPTY = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def matches(text: Column, pattern: str, around: int = 24) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches an empty text, in order:
    start, end, value and up to `around` characters before and after (no further than the neighbouring matches)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(gaps: Column, values: Column) -> Column:
        ends = running(F.transform(values, lambda v, i: (F.length(gaps[i]) + F.length(v)).cast("long")))
        return let(
            ends,
            lambda e: F.transform(
                values,
                lambda v, i: F.struct(
                    (e[i] - F.length(v)).alias("start"),
                    e[i].alias("end"),
                    v.alias("value"),
                    F.right(gaps[i], F.lit(around)).alias("before"),
                    F.left(gaps[i + 1], F.lit(around)).alias("after"),
                ),
            ),
        )

    none = F.array().cast(EMPTY)
    return let(
        found,
        lambda values: F.when(F.size(values) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: placed(gaps, values))),
    )


def joined(spans: Column) -> Column:
    """kind:start:end of spans (start, rank, end, kind), by start, then rank, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def tagged(found: Column, kind: str, rank: int) -> Column:
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    )
