"""The same ledger written in each of the five layouts, as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BANK_HINTS, HEADERS


def _quoted(c: Column) -> Column:
    return F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def category_hint(category: Column, txn_id: Column) -> Column:
    """What a bank prints as the category: the last part of the row's own, or for a quarter of all rows, by a hash of the
    id, any of the bank's."""
    sha = F.md5(txn_id.cast("string").cast("binary"))
    number = lambda at: F.conv(F.substring(sha, at, 4), 16, 10).cast("int")
    own = F.coalesce(F.element_at(F.split(category, ">"), -1), F.lit(""))
    return F.when(number(1) % 4 == 0, F.element_at(F.array(*map(F.lit, BANK_HINTS)), number(5) % len(BANK_HINTS) + 1)).otherwise(own)


def _lines(ledger: DataFrame) -> dict[str, Column]:
    amount, size, text = F.col("amount").cast("decimal(12,2)"), F.abs("amount").cast("decimal(12,2)").cast("string"), _quoted(F.col("raw_description"))
    us, iso, eu = F.date_format("posted_date", "MM/dd/yyyy"), F.date_format("posted_date", "yyyy-MM-dd"), F.date_format("posted_date", "dd/MM/yyyy")
    out = amount < 0
    debit, credit = F.when(out, size).otherwise(""), F.when(out, "").otherwise(size)
    join = lambda *c: F.concat_ws(",", *c)
    kind = F.when(out, "DEBIT").otherwise("CREDIT")
    hint = _quoted(category_hint(F.col("category"), F.col("txn_id"))) if "category" in ledger.columns else F.lit("")
    ofx = F.concat(F.lit("<STMTTRN><TRNTYPE>"), kind, F.lit("<DTPOSTED>"), F.date_format("posted_date", "yyyyMMdd"), F.lit("120000[0:GMT]<TRNAMT>"), amount.cast("string"), F.lit("<FITID>"), F.col("txn_id").cast("string"), F.lit("<NAME>"), F.col("raw_description"), F.lit("</STMTTRN>"))
    return {
        "chase": join(kind, us, text, amount.cast("string"), F.lit("ACH")), "boa": join(us, text, debit, credit), "capital_one": join(iso, iso, text, hint, debit, credit),
        "generic_credit": join(eu, text, _quoted(F.format_number(F.abs(amount), 2)), kind), "ofx": ofx,
    }


def rendered(ledger: DataFrame, layout: str, account: str = "account") -> DataFrame:
    """(at, value): the lines of one export in order."""
    body = ledger.select(F.row_number().over(Window.partitionBy("account_id").orderBy("posted_date", "txn_id")).alias("at"), _lines(ledger)[layout].alias("value"))
    head = f"OFXHEADER:100 <OFX><ACCTID>{account}" if layout == "ofx" else ",".join(HEADERS[layout])
    ends = [(0, head)] + ([(2**31 - 1, "</OFX>")] if layout == "ofx" else [])
    return body.unionByName(ledger.sparkSession.createDataFrame(ends, "at int, value string"))


def write_export(ledger: DataFrame, path: str, layout: str, account: str = "account") -> None:
    """One account's export as one text file: its rows are one account's, never the whole ledger."""
    rendered(ledger, layout, account).orderBy("at").select("value").coalesce(1).write.mode("overwrite").text(path)
