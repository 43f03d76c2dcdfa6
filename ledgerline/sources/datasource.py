"""Bank exports as a data source of their own: spark.read.format("bank_exports") and spark.readStream.format("bank_exports").

Both give the rows of exports.read_exports. Files are listed where the query is planned and read by the tasks, through
any file system that Arrow knows (local folders, HDFS, object stores). A batch packs files into partitions by bytes. A
stream orders files by the time they were written, then by path; its offset names the last one that was read, so a
restart goes on after it. Files are written once and moved into the folder whole; one that is written again later is a
new file. Options: `layout` (one of the five; found by the header without it), `partitionBytes`.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import HEADERS
from .exports import file_cells

NAME = "bank_exports"
SCHEMA = (
    "file string, format string, row_no int, status string, reason string, posted_date date, amount decimal(12,2), amount_text string, "
    "raw_description string, own_account string, fitid string, category_hint string"
)
ARROW = pa.schema([
    ("file", pa.string()), ("format", pa.string()), ("row_no", pa.int32()), ("status", pa.string()), ("reason", pa.string()), ("posted_date", pa.date32()), ("amount", pa.decimal128(12, 2)), ("amount_text", pa.string()),
    ("raw_description", pa.string()), ("own_account", pa.string()), ("fitid", pa.string()), ("category_hint", pa.string()),
])
PARTITION_BYTES = 32 << 20
#: Rows of one Arrow batch.
BATCH = 8192


@dataclass(frozen=True)
class Layout:
    """Where the cells of a CSV layout stand. Amounts are in one cell, in one cell with their side in another, or in a
    cell for debits and one for credits."""

    date: int
    order: str
    text: int
    amount: int | None = None
    side: int | None = None
    debit: int | None = None
    credit: int | None = None
    hint: int | None = None


LAYOUTS = {
    "chase": Layout(1, "mdy", 2, amount=3), "boa": Layout(0, "mdy", 1, debit=2, credit=3), "capital_one": Layout(0, "ymd", 2, debit=4, credit=5, hint=3), "generic_credit": Layout(0, "dmy", 1, amount=2, side=3),
}
_DATE = {"mdy": re.compile(r"(?P<m>[0-9]{1,19})/(?P<d>[0-9]{1,19})/(?P<y>[0-9]{4})"), "dmy": re.compile(r"(?P<d>[0-9]{1,19})/(?P<m>[0-9]{1,19})/(?P<y>[0-9]{4})"), "ymd": re.compile(r"(?P<y>[0-9]{4})-(?P<m>[0-9]{1,19})-(?P<d>[0-9]{1,19})"), "packed": re.compile(r"(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})")}
_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,9})?")
_CONTROL = "".join(map(chr, range(33)))


def date_of(text: str | None, order: str) -> dt.date | None:
    """A date as text.parse_date reads it."""
    m = _DATE[order].fullmatch((text or "").strip(" "))
    try:
        return m and dt.date(int(m["y"]), int(m["m"]), int(m["d"]))
    except (ValueError, OverflowError):
        return None


def amount_of(text: str | None) -> Decimal | None:
    """An amount as text.parse_amount reads it: rounded half up to cents, null beyond twelve digits."""
    said = plain(text)
    if said is None or not _NUMBER.fullmatch(said := said.strip(_CONTROL)):
        return None
    number = Decimal(said)
    if number.adjusted() > 12:
        return None
    cents = number.quantize(Decimal("0.01"), ROUND_HALF_UP) if number.adjusted() > -40 else Decimal("0.00")
    return abs(cents) if not cents else cents if abs(cents) < 10**10 else None


def plain(text: str | None) -> str | None:
    return None if text is None else re.sub("[,$]", "", text.strip(" "))


def _negative(x: Decimal | None) -> Decimal | None:
    return None if x is None else Decimal("0.00") - x


def csv_record(x: dict) -> tuple:
    """One CSV row of exports.file_cells as a record with a status."""
    cells, form, problem = x["cells"], x["format"], x["problem"]
    at = LAYOUTS.get(form)
    cell = lambda i: cells[i] if i is not None and cells is not None and i < len(cells) else None
    posted = amount = written = text = hint = None
    side = ""
    if at is not None:
        posted, text, hint = date_of(cell(at.date), at.order), cell(at.text), cell(at.hint)
        if at.debit is not None:
            is_debit = (cell(at.debit) or "").strip(" ") != ""
            written = cell(at.debit) if is_debit else cell(at.credit)
        else:
            is_debit = at.side is not None and (cell(at.side) or "").strip(" ").upper() == "DEBIT"
            written = cell(at.amount)
        amount = _negative(amount_of(written)) if is_debit else amount_of(written)
        side = "-" if is_debit else ""
    skipped = problem is None and (x["row_no"] - 1 < x["header_at"] or all(c.strip(" ") == "" for c in cells) or (form == "generic_credit" and (cell(0) or "").strip(" ").upper() == "TOTAL"))
    reason = problem
    if problem is None and not skipped:
        width = len(HEADERS[form])
        if len(cells) != width:
            reason = f"row {x['row_no']}: expected {width} columns, got {len(cells)}"
        elif posted is None:
            reason = f"row {x['row_no']}: bad date"
        elif amount is None:
            reason = f"row {x['row_no']}: bad amount"
    status = "skipped" if skipped else "failed" if reason else "ok"
    return (x["file"], form, x["row_no"], status, reason, posted, amount, None if written is None else side + plain(written), text, None, None, hint)


def ofx_records(x: dict) -> Iterator[tuple]:
    """The statement transactions of an OFX text; of a repeated tag the last counts."""
    account = re.search(r"<ACCTID>([^<\r\n]*)", x["body"])
    account = (account[1].strip(" ") or None) if account else None
    blocks = re.findall(r"(?s)<STMTTRN>(.*?)</STMTTRN>", x["body"])
    if not blocks:
        yield (x["file"], "ofx", 1, "failed", "no transactions", None, None, None, None, account, None, None)
    for i, block in enumerate(blocks, 1):
        tag = lambda name: (re.findall(rf"<{name}>([^<\r\n]*)", block) or [None])[-1]  # noqa: B023, E731
        said = {name: None if (v := tag(name)) is None else v.strip(" ") for name in ("DTPOSTED", "TRNAMT", "NAME", "FITID")}
        posted = date_of((said["DTPOSTED"] or "").split("[")[0][:8], "packed")
        amount = amount_of(said["TRNAMT"])
        reason = "missing NAME" if said["NAME"] is None else "bad date" if posted is None else "bad amount" if amount is None else None
        yield (x["file"], "ofx", i, "failed" if reason else "ok", reason, posted, amount, plain(said["TRNAMT"]), said["NAME"], account, said["FITID"], None)


def records(path: str, content: bytes, layout: str | None = None) -> Iterator[tuple]:
    for x in file_cells(path, content, layout):
        yield from ofx_records(x) if x["body"] is not None else [csv_record(x)]


@dataclass
class Files(InputPartition):
    """Paths that one task reads, of one file system."""

    root: str
    paths: list[str]


class _Exports:
    """Listing and reading, shared by batches and streams."""

    def __init__(self, options: dict):
        self.root, self.layout = options.get("path"), options.get("layout")
        if not self.root:
            raise ValueError("a path is needed: load(path)")
        if self.layout is not None and self.layout not in [*LAYOUTS, "ofx"]:
            raise ValueError(f"unknown layout {self.layout}")
        self.partition_bytes = int(options.get("partitionbytes") or PARTITION_BYTES)

    def files(self) -> list[tuple[int, str, int]]:
        """(time, path, bytes) of every file, in the order of a stream. As in Spark's readers, files without bytes and names
        that begin with _ or . are left out."""
        system, path = _system(self.root)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(path) :].split("/"))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not hidden(f.path))

    def packed(self, files: list[tuple[int, str, int]]) -> list[Files]:
        out: list[Files] = []
        room = 0
        for _, path, size in files:
            if not out or size > room:
                out.append(Files(self.root, []))
                room = self.partition_bytes
            out[-1].paths.append(path)
            room -= size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(partition.root)
        rows: list[tuple] = []
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                content = f.read()
            for row in records(_shown(partition.root, path), content, self.layout):
                rows.append(row)
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def _system(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:").rstrip("/")


def _shown(root: str, path: str) -> str:
    """The path as Spark's own readers print it."""
    scheme, _, rest = root.partition("://")
    if not rest or scheme == "file":
        return f"file:{path}"
    return f"hdfs://{rest.split('/')[0]}{path}" if scheme == "hdfs" else f"{scheme}://{path}"


class ExportReader(_Exports, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.packed(self.files()) or [Files(self.root, [])]


class ExportStreamReader(_Exports, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = self.files()[-1:]
        return {"time": last[0][0], "path": last[0][1]} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return self.packed([f for f in self.files() if after < f[:2] <= upto])

    def commit(self, end: dict) -> None:
        """Nothing is kept here: the offset says it all."""


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExportReader:
        return ExportReader(self.options)

    def streamReader(self, schema) -> ExportStreamReader:
        return ExportStreamReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ExportSource)
    return spark
