"""Bank exports in five layouts as tagged rows: every row of every file is ok, skipped or failed, with a reason.

Python on the executors only decodes bytes, splits CSV text into cells and recognizes the layout of a file, because a
file is one unit there; dates, amounts, signs and skipped rows are column expressions.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_amount, parse_date
from ..operators.categorize import indel
from ..schema import HEADERS

SCAN_ROWS = 15
LEAST_CONFIDENCE = 0.75
CELLS = "file string, format string, confidence double, header_at int, row_no int, cells array<string>, problem string, body string"


def decoded(data: bytes) -> str:
    """UTF-8, or Windows-1252 where that fails."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252")


def header_score(cells: list[str], names: list[str]) -> float:
    """1 for the exact header; else how well its best-fitting cells match, less for another number of columns."""
    cells = [c.strip() for c in cells]
    if cells == names or not cells:
        return float(cells == names)
    like = lambda a, b: 1 - indel(a, b) / max(1, len(a) + len(b))
    fit = sum(max(like(n.lower(), c.lower()) for c in cells) for n in names) / len(names)
    return fit * min(len(cells), len(names)) / max(len(cells), len(names))


def detect(text: str, rows: list[list[str]]) -> tuple[str | None, float]:
    """Layout and confidence; None below LEAST_CONFIDENCE."""
    if "<OFX>" in text or text.lstrip().startswith("OFXHEADER"):
        return "ofx", 1.0
    best: tuple[str | None, float] = (None, 0.0)
    for row in rows[:SCAN_ROWS]:
        if any(c.strip() for c in row):
            for name, header in HEADERS.items():
                if (score := header_score(row, header)) > best[1]:
                    best = (name, score)
    return best if best[1] >= LEAST_CONFIDENCE else (None, best[1])


FIELDS = ("format", "confidence", "header_at", "row_no", "cells", "problem", "body")


def file_cells(path: str, content: bytes, layout: str | None = None) -> Iterator[dict]:
    """The CSV rows of one file as cells, its text as a body if it is OFX, or the problem that it has as a whole."""
    blank = dict.fromkeys(FIELDS) | {"file": path}
    try:
        text = decoded(content)
    except UnicodeDecodeError:
        yield blank | {"problem": "unreadable bytes"}
        return
    if layout == "ofx" or layout is None and detect(text, [])[0] == "ofx":
        yield blank | {"format": "ofx", "confidence": 1.0, "body": text}
        return
    try:
        rows = list(csv.reader(io.StringIO(text)))
    except csv.Error as e:
        yield blank | {"format": layout, "problem": f"malformed CSV: {e}"}
        return
    name, confidence = (layout, 1.0) if layout else detect(text, rows)
    if name is None:
        yield blank | {"confidence": confidence, "problem": f"unrecognized format; first row: {rows[0] if rows else []}"}
        return
    near = rows[:SCAN_ROWS] if name == "boa" else rows[:1]
    at = next((i for i, r in enumerate(near) if [c.strip() for c in r] == HEADERS[name]), None)
    if at is None:
        yield blank | {"format": name, "confidence": confidence, "problem": f"no header {HEADERS[name]}"}
        return
    for i, row in enumerate(rows):
        if i != at:
            yield blank | {"format": name, "confidence": confidence, "header_at": at, "row_no": i + 1, "cells": row}


def cells(files: DataFrame, layout: str | None = None) -> DataFrame:
    """One row for each CSV row of each file (path, content); OFX files are one row with their text in body."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = (x for path, content in zip(frame["path"], frame["content"], strict=True) for x in file_cells(path, bytes(content), layout))
            yield pd.DataFrame(rows, columns=["file", *FIELDS])

    return files.select("path", "content").mapInPandas(run, CELLS)


def _by_format(values: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("format") == k, v) for k, v in values.items()])


def _cell(i: int) -> Column:
    return F.get("cells", F.lit(i))


def csv_rows(tagged: DataFrame) -> DataFrame:
    """The cells of CSV layouts as records with a status."""
    width = _by_format({k: F.lit(len(h)) for k, h in HEADERS.items()})
    blank = F.forall("cells", lambda c: F.trim(c) == "")
    total = (F.col("format") == "generic_credit") & (F.upper(F.trim(_cell(0))) == "TOTAL")
    two_sided = lambda d, c: F.when(F.trim(_cell(d)) != "", -parse_amount(_cell(d))).otherwise(parse_amount(_cell(c)))
    unsigned = parse_amount(_cell(2))
    posted = _by_format({
        "chase": parse_date(_cell(1), "M/d/yyyy"), "boa": parse_date(_cell(0), "M/d/yyyy"), "capital_one": parse_date(_cell(0), "yyyy-M-d"), "generic_credit": parse_date(_cell(0), "d/M/yyyy"),
    })
    amount = _by_format({
        "chase": parse_amount(_cell(3)), "boa": two_sided(2, 3), "capital_one": two_sided(4, 5), "generic_credit": F.when(F.upper(F.trim(_cell(3))) == "DEBIT", -unsigned).otherwise(unsigned),
    })
    description = _by_format({"chase": _cell(2), "boa": _cell(1), "capital_one": _cell(2), "generic_credit": _cell(1)})
    side = F.when((F.col("format") == "boa") & (F.trim(_cell(2)) != ""), F.lit("-")).when((F.col("format") == "capital_one") & (F.trim(_cell(4)) != ""), F.lit("-"))
    side = F.coalesce(side, F.when((F.col("format") == "generic_credit") & (F.upper(F.trim(_cell(3))) == "DEBIT"), F.lit("-")), F.lit(""))
    written = _by_format({
        "chase": _cell(3), "boa": F.when(F.trim(_cell(2)) != "", _cell(2)).otherwise(_cell(3)), "capital_one": F.when(F.trim(_cell(4)) != "", _cell(4)).otherwise(_cell(5)), "generic_credit": _cell(2),
    })
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.size("cells") != width, F.concat(F.lit("row "), F.col("row_no"), F.lit(": expected "), width, F.lit(" columns, got "), F.size("cells")))
        .when(posted.isNull(), F.concat(F.lit("row "), F.col("row_no"), F.lit(": bad date")))
        .when(amount.isNull(), F.concat(F.lit("row "), F.col("row_no"), F.lit(": bad amount")))
    )
    skipped = F.col("problem").isNull() & ((F.col("row_no") - 1 < F.col("header_at")) | blank | total)
    rows = tagged.where("body IS NULL").withColumn("reason", F.when(~F.coalesce(skipped, F.lit(False)), reason))
    status = F.when(F.coalesce(skipped, F.lit(False)), "skipped").when(F.col("reason").isNotNull(), "failed").otherwise("ok")
    return rows.select(
        "file", "format", "row_no", status.alias("status"), "reason", posted.alias("posted_date"), amount.alias("amount"), F.concat(side, F.regexp_replace(F.trim(written), "[,$]", "")).alias("amount_text"),
        description.alias("raw_description"), F.lit(None).cast("string").alias("own_account"), F.lit(None).cast("string").alias("fitid"), F.when(F.col("format") == "capital_one", _cell(3)).alias("category_hint"),
    )


def ofx_rows(tagged: DataFrame) -> DataFrame:
    """The statement transactions of OFX texts; of a repeated tag the last counts."""
    text = tagged.where("body IS NOT NULL")
    account = F.nullif(F.trim(F.regexp_extract("body", r"<ACCTID>([^<\r\n]*)", 1)), F.lit(""))
    blocks = F.regexp_extract_all("body", F.lit(r"(?s)<STMTTRN>(.*?)</STMTTRN>"), F.lit(1))
    rows = text.select("file", "format", account.alias("own_account"), F.posexplode_outer(blocks).alias("at", "block"))
    tag = lambda name: F.trim(F.element_at(F.regexp_extract_all("block", F.lit(rf"<{name}>([^<\r\n]*)"), F.lit(1)), -1))
    tags = {name: F.when(F.col("block").rlike(f"<{name}>"), tag(name)) for name in ("DTPOSTED", "TRNAMT", "NAME", "FITID")}
    rows = rows.withColumns({f"t_{k}": v for k, v in tags.items()})
    posted = F.try_to_timestamp(F.substring(F.split_part("t_DTPOSTED", F.lit("["), F.lit(1)), 1, 8), F.lit("yyyyMMdd")).cast("date")
    amount = parse_amount(F.col("t_TRNAMT"))
    reason = F.when(F.col("block").isNull(), "no transactions").when(F.col("t_NAME").isNull(), "missing NAME").when(posted.isNull(), "bad date").when(amount.isNull(), "bad amount")
    return rows.select(
        "file", "format", (F.coalesce("at", F.lit(0)) + 1).alias("row_no"), F.when(reason.isNull(), "ok").otherwise("failed").alias("status"), reason.alias("reason"), posted.alias("posted_date"), amount.alias("amount"),
        F.regexp_replace(F.trim("t_TRNAMT"), "[,$]", "").alias("amount_text"), F.col("t_NAME").alias("raw_description"), "own_account", F.col("t_FITID").alias("fitid"), F.lit(None).cast("string").alias("category_hint"),
    )


def read_exports(spark: SparkSession, paths: str | list[str], layout: str | None = None) -> DataFrame:
    tagged = cells(spark.read.format("binaryFile").load(paths), layout)
    return csv_rows(tagged).unionByName(ofx_rows(tagged))
