"""The data source against the reader that it stands beside, in batches and in streams."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions.text import parse_amount, parse_date
from ledgerline.operators.store import Store
from ledgerline.sources import datasource
from ledgerline.sources.exports import read_exports
from ledgerline.streaming import live

# Texts of the formats.
FILES = {
    "chase.csv": "Details,Posting Date,Description,Amount,Type\nDEBIT,01/15/2026,SQ *BLUE BOTTLE,-4.75,ACH\nx,13/45/2026,a,1,b\nx,01/02/2026,a,(4.75),b\nx,01/02/2026,a,1\n\nx,1/2/2026,\"a, b\",\"$1,000.505\",b\n",
    "boa.csv": "Account,x\n,\nDate,Description,Debit,Credit\n01/15/2026,COFFEE,4.75,\n01/16/2026,PAYROLL,,2600.00\n01/16/2026,BOTH,-1,2\n ,,,\n",
    "capital.csv": "Transaction Date,Posted Date,Description,Category,Debit,Credit\n2026-01-15,2026-01-17,COFFEE,Dining,4.75,\n2026-1-6,2026-01-17,PAY,Other,,2600.00\n2026-02-30,,x,,,\n",
    "generic.csv": 'Date,Description,Amount,Type\n15/01/2026,COFFEE,4.75,debit\n16/01/2026,PAY,"2,600.00",CREDIT\nTOTAL,,"2,595.25",\n17/01/2026,ZERO,0,DEBIT\n',
    "bank.ofx": "OFXHEADER:100\n<OFX><ACCTID>checking\n<STMTTRN><DTPOSTED>20260115120000[0:GMT]<TRNAMT>-4.75<FITID>f1<NAME>COFFEE</STMTTRN>\n<STMTTRN><DTPOSTED>2026<TRNAMT>x<NAME>A<NAME>B</STMTTRN><STMTTRN><TRNAMT>1</STMTTRN></OFX>",
    "none.ofx": "<OFX><ACCTID> \n</OFX>", "odd.csv": "Foo,Bar\n1,2\n", "bytes.csv": b"\x81\x8d", "empty.csv": "", "_hidden.csv": "x",
}


def put(folder, names):
    for name in names:
        data = FILES[name] if isinstance(FILES[name], bytes) else FILES[name].encode()
        (folder / f".{name}").write_bytes(data)
        os.replace(folder / f".{name}", folder / name)


def as_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("layout", [None, "chase", "ofx"])
def test_same_rows_as_the_reader(spark, tmp_path, layout):
    put(tmp_path, FILES)
    read = datasource.register(spark).read.format("bank_exports")
    got, want = (read.option("layout", layout) if layout else read).load(str(tmp_path)), read_exports(spark, str(tmp_path), layout)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    assert as_rows(got) == as_rows(want) and got.count() >= 9
    assert got.where("status = 'ok' AND amount < 0").select("file").distinct().count() == want.where("status = 'ok' AND amount < 0").select("file").distinct().count()


def test_files_are_packed_by_bytes(spark, tmp_path):
    put(tmp_path, FILES)
    reader = datasource.ExportReader({"path": str(tmp_path), "partitionbytes": "300"})
    parts = reader.partitions()
    assert 2 < len(parts) < 9 and sum(len(p.paths) for p in parts) == len(FILES) - 2
    assert datasource.register(spark).read.format("bank_exports").load(str(tmp_path / "chase.csv")).count() == 6
    assert spark.read.format("bank_exports").load(str(tmp_path / "nothing")).count() == 0
    with pytest.raises(Exception, match="unknown layout"):
        spark.read.format("bank_exports").option("layout", "other").load(str(tmp_path)).collect()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    datasource.register(spark)

    def run():
        stream = spark.readStream.format("bank_exports").load(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return as_rows(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")))

    put(folder, ["chase.csv", "boa.csv"])
    assert run() == as_rows(read_exports(spark, str(folder)))
    put(folder, ["bank.ofx", "odd.csv"])
    assert run() == as_rows(read_exports(spark, str(folder)))
    assert run() == as_rows(read_exports(spark, str(folder)))  # nothing new, nothing twice


def test_stream_of_exports_into_a_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "store"))
    for names in (["chase.csv", "boa.csv"], ["bank.ofx", "boa.csv"]):
        put(tmp_path / "in", names)
        q = live.exports_into_store(spark, str(tmp_path / "in"), store, str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    assert sorted((r.account_id, r.raw_description) for r in store.read().collect()) == [("boa", "BOTH"), ("boa", "COFFEE"), ("boa", "PAYROLL"), ("chase", "SQ *BLUE BOTTLE"), ("chase", "a, b"), ("checking", "COFFEE")]


@given(st.lists(st.text(alphabet="0123456789.,$+-eE /[", max_size=14), min_size=1, max_size=40))
@settings(max_examples=12, deadline=None)
def test_python_and_column_parsers_agree(spark, texts):
    texts = [*texts, "12/31/2025", "2025-12-31", "1e3", "-.5", "5.", "9999999999.995", "9999999999.994", "0.005", "-0.005", "1e-50", "+7", " 1 ", "02/29/2024", "2/29/2023", "1e400"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", parse_amount(F.col("t")).alias("a"), *[parse_date(F.col("t"), f).alias(n) for n, f in (("mdy", "M/d/yyyy"), ("dmy", "d/M/yyyy"), ("ymd", "yyyy-M-d"))]).collect()
    for r in got:
        assert (r.a, r.mdy, r.dmy, r.ymd) == (datasource.amount_of(texts[r.i]), *[datasource.date_of(texts[r.i], o) for o in ("mdy", "dmy", "ymd")]), texts[r.i]
