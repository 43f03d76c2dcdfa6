import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.ingest import ingest, load, report, with_accounts
from ledgerline.operators.categorize import indel, token_set_score
from ledgerline.operators.store import Store
from ledgerline.sources.exports import decoded, detect, read_exports

# Texts of the formats.
FILES = {
    "chase.csv": "Details,Posting Date,Description,Amount,Type\nDEBIT,01/15/2026,SQ *BLUE BOTTLE COF 4155551234 CA,-4.75,ACH\nCREDIT,1/16/2026,ACME CORP PAYROLL,2600.00,ACH\n",
    "boa.csv": "Account,x\nFrom,y\n,\n,\n,\nDate,Description,Debit,Credit\n01/15/2026,SQ *BLUE BOTTLE COF 4155551234 CA,4.75,\n01/16/2026,ACME CORP PAYROLL,,2600.00\n",
    "capital.csv": "Transaction Date,Posted Date,Description,Category,Debit,Credit\n2026-01-15,2026-01-17,SQ *BLUE BOTTLE COF 4155551234 CA,Dining,4.75,\n2026-01-16,2026-01-17,ACME CORP PAYROLL,Other,,2600.00\n",
    "generic.csv": 'Date,Description,Amount,Type\n15/01/2026,SQ *BLUE BOTTLE COF 4155551234 CA,4.75,DEBIT\n16/01/2026,ACME CORP PAYROLL,"2,600.00",CREDIT\nTOTAL,,"2,595.25",\n',
    "bank.ofx": "OFXHEADER:100\n<OFX><ACCTID>checking\n<STMTTRN><DTPOSTED>20260115120000[0:GMT]<TRNAMT>-4.75<FITID>f1<NAME>SQ *BLUE BOTTLE COF 4155551234 CA</STMTTRN>\n<STMTTRN><DTPOSTED>20260116<TRNAMT>2600.00<FITID>f2<NAME>ACME CORP PAYROLL</STMTTRN></OFX>",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    return tmp_path


def test_five_layouts_hold_the_same_two_rows(spark, folder):
    rows = [r for r in read_exports(spark, str(folder)).where("status = 'ok'").orderBy("file", "row_no").collect()]
    assert len(rows) == 10
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        assert (a.posted_date, float(a.amount), a.raw_description) == (dt.date(2026, 1, 15), -4.75, "SQ *BLUE BOTTLE COF 4155551234 CA")
        assert (b.posted_date, float(b.amount), b.raw_description) == (dt.date(2026, 1, 16), 2600.0, "ACME CORP PAYROLL")


def test_report_counts(spark, folder):
    got = {r.file.rsplit("/", 1)[-1]: (r.parsed, r.skipped, r.failed) for r in report(with_accounts(read_exports(spark, str(folder)))).collect()}
    assert got == {"chase.csv": (2, 0, 0), "boa.csv": (2, 5, 0), "capital.csv": (2, 0, 0), "generic.csv": (2, 1, 0), "bank.ofx": (2, 0, 0)}


def test_bad_rows_fail_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Details,Posting Date,Description,Amount,Type\nx,13/45/2026,a,1,b\nx,01/02/2026,a,(4.75),b\nx,01/02/2026,a,1\n\nx,01/02/2026,a,1.50,b\n")
    (tmp_path / "b.csv").write_text("Foo,Bar,Baz\n1,2,3\n")
    (tmp_path / "c.csv").write_bytes(b"\x81\x8d")
    rows = read_exports(spark, str(tmp_path))
    got = {r.file.rsplit("/", 1)[-1]: (r.parsed, r.skipped, r.failed) for r in report(rows).collect()}
    assert got == {"a.csv": (1, 1, 3), "b.csv": (0, 0, 1), "c.csv": (0, 0, 1)}


def test_reports_show_the_first_failures_and_count_all(spark, tmp_path, tmp_path_factory):
    (tmp_path / "a.csv").write_text("Details,Posting Date,Description,Amount,Type\n" + "x,1/2/2026,a,?,b\n" * 40 + "x,1/2/2026,a,1,b\n\n")
    summary, totals = load(spark, str(tmp_path), Store(spark, str(tmp_path_factory.mktemp("store"))))
    r = summary.first()
    assert totals == {"parsed": 1, "skipped": 1, "failed": 40, "added": 1} and (r.parsed, r.failed) == (1, 40)
    assert r.failures == [f"row {i}: bad amount" for i in range(2, 7)]


def test_ingest_twice_adds_nothing(spark, folder, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    ingest(spark, str(folder), store)
    n = store.read().count()
    again = ingest(spark, str(folder), store)
    assert store.read().count() == n == 10
    assert all(r.deduped == r.parsed for r in again.collect())


def test_equal_rows_of_one_day_are_kept(spark, tmp_path, tmp_path_factory):
    line = "x,01/02/2026,COFFEE,-3.00,b\n"
    (tmp_path / "a.csv").write_text("Details,Posting Date,Description,Amount,Type\n" + line * 2)
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    ingest(spark, str(tmp_path), store)
    assert store.read().count() == 2


@given(st.binary(max_size=200))
@settings(max_examples=50, deadline=None)
def test_detection_takes_any_bytes(data):
    try:
        text = decoded(data)
    except UnicodeDecodeError:
        return
    assert 0 <= detect(text, [text.split(",")])[1] <= 1


@given(st.text(alphabet="ABC ", max_size=12), st.text(alphabet="ABC ", max_size=12))
@settings(max_examples=100, deadline=None)
def test_scores_are_symmetric(a, b):
    assert indel(a, b) == indel(b, a)
    assert token_set_score(a, b) == pytest.approx(token_set_score(b, a))


def test_known_scores():
    assert token_set_score("BLUE BOTTLE COF", "BLUE BOTTLE COFFEE") == pytest.approx(90.909, abs=0.01)
    assert token_set_score("KROGER", "KROGER STORE") == 100
