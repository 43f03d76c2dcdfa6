"""The stored ledger: insert-if-absent, guarded updates, corrections and acknowledgements, and a store of append-only files
with a log of commits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: New rows whose keys are broadcast to the stored ones, at most.
BROADCAST_KEYS = 1_000_000


def absent(new: DataFrame, stored: DataFrame, key: str = "txn_id") -> DataFrame:
    """Rows of new, one a key, whose key isn't stored."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def absent_from_much(new: DataFrame, stored: DataFrame, n_new: int, key: str = "txn_id") -> DataFrame:
    """absent() where much is stored: if few rows are new, their keys go to the stored ones, of which nothing is shuffled
    but the keys that are met."""
    if n_new > BROADCAST_KEYS:
        return absent(new, stored, key)
    keys = new.select(F.col(key).alias("_new")).distinct()
    met = stored.select(key).join(F.broadcast(keys), F.col(key) == F.col("_new"), "left_semi").distinct()
    return new.dropDuplicates([key]).join(F.broadcast(met), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert log read as a table."""
    last = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def updated(stored: DataFrame, updates: DataFrame, columns: list[str], key: str = "txn_id") -> DataFrame:
    """stored with `columns` taken from updates where there is one; rows that a user has categorized don't change."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = stored.join(new, key, "left")
    change = F.coalesce("_hit", F.lit(False)) & F.coalesce(F.col("category_source") != "user", F.lit(True))
    out = joined.withColumns({c: F.when(change, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns})
    return out.select(*stored.columns)


def acknowledged(anomalies: DataFrame, acks: DataFrame) -> DataFrame:
    return anomalies.join(acks.select("txn_id"), "txn_id", "left_anti")


def top_anomalies(ledger: DataFrame, least: float = 0.9, limit: int = 20, account: str | None = None) -> DataFrame:
    rows = ledger.where(F.col("anomaly_score") >= least)
    if account is not None:
        rows = rows.where(F.col("account_id") == account)
    return rows.orderBy(F.desc("anomaly_score"), "txn_id").limit(limit)


class WriteConflict(RuntimeError):
    """Another writer changed what this one had read."""


@dataclass
class Folder:
    """Files that one commit added: their rows, and the least and the greatest key, by which an upsert leaves folders out."""

    path: str
    at: int
    rows: int
    low: str | int | None
    high: str | int | None


@dataclass
class State:
    """What readers see at a version: folders since the last whole rewrite, and accounts whose earlier rows are replaced."""

    version: int = 0
    folders: list[Folder] = field(default_factory=list)
    replaced: list[tuple[int, str]] = field(default_factory=list)


class Store:
    """A ledger in one folder: files are added and never changed, and a commit is one small file in the log.

    A commit adds a folder of files, adds one in place of all before (a rewrite), or adds one in place of the rows that some
    accounts had before. Commits are numbered, and a number can be taken once: a writer that finds its number taken looks
    at what the others did. An upsert then leaves out what they have added and takes the next number; a rewrite or a
    replacement, which rests on what it read, raises WriteConflict. Files of a writer that fails are seen by no one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- the log

    def _entries(self) -> list[dict]:
        try:
            rows = self.spark.read.text(f"{self.path}/log").collect()  # one line a commit
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((json.loads(r.value) for r in rows), key=lambda x: x["version"])

    def state(self) -> State:
        s = State()
        for x in self._entries():
            s.version = x["version"]
            if x["kind"] == "rewrite":
                s.folders, s.replaced = [], []
            if x["kind"] == "replace":
                s.replaced.append((x["version"], x["accounts"]))
            s.folders.append(Folder(x["folder"], x["version"], x["rows"], x["low"], x["high"]))
        return s

    def _commit(self, version: int, kind: str, folder: Folder, accounts: str | None = None) -> bool:
        """Take a version number; False if another writer has it. The entry is written whole beside the log and then gets
        its name there, which can be given once: a writer that fails on the way leaves the log as it was."""
        entry = {"version": version, "kind": kind, "folder": folder.path, "rows": folder.rows, "low": folder.low, "high": folder.high, "accounts": accounts}
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path
        draft, name = at(f"{self.path}/drafts/{uuid.uuid4().hex}.json"), at(f"{self.path}/log/{version:012d}.json")
        system = draft.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = system.create(draft, False)
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()
        system.mkdirs(name.getParent())
        if system.getScheme() != "file":
            return system.rename(draft, name)  # fails where the name is taken
        local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:  # a local rename would take the name over; a link doesn't
            jvm.java.nio.file.Files.createLink(local(name), local(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            system.delete(draft, False)
        return True

    # -- rows

    def _put(self, rows: DataFrame) -> Folder:
        """Write rows into a folder of their own; count and key range come from the one column of what was written."""
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        got = self.spark.read.parquet(path).agg(F.count("*").alias("n"), F.min("txn_id").alias("low"), F.max("txn_id").alias("high")).first()
        return Folder(path, 0, got.n, got.low, got.high)

    def _rows(self, s: State) -> DataFrame | None:
        if not s.folders:
            return None
        out = None
        # rows that no later replacement touches need no look at their accounts
        for f in s.folders:
            part = self.spark.read.parquet(f.path)
            for _, accounts in [x for x in s.replaced if x[0] > f.at]:
                gone = self.spark.read.parquet(accounts).select(F.col("account_id").alias("_gone"))
                part = part.join(gone, F.col("account_id").eqNullSafe(F.col("_gone")), "left_anti")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        return self._rows(self.state())

    def version(self) -> int:
        return self.state().version

    def write(self, rows: DataFrame, expected: int | None = None) -> None:
        """Put rows in place of all. expected: the version that they were made from; if others have written since,
        WriteConflict is raised and nothing changes. Without it, the version at the call counts."""
        version = self.version() if expected is None else expected
        if not self._commit(version + 1, "rewrite", self._put(rows)):
            raise WriteConflict(f"version {version + 1} was written by another")

    def replace_accounts(self, rows: DataFrame, accounts: DataFrame, expected: int | None = None) -> None:
        """Put rows in place of all rows of these accounts; files of others stay as they are."""
        version = self.version() if expected is None else expected
        path = f"{self.path}/accounts/{uuid.uuid4().hex}"
        accounts.select("account_id").distinct().write.parquet(path)
        if not self._commit(version + 1, "replace", self._put(rows), path):
            raise WriteConflict(f"version {version + 1} was written by another")

    def upsert(self, new: DataFrame) -> int:
        """Add the rows whose key isn't stored, one a key; how many. Only new files are written. If other writers commit
        meanwhile, what they added is left out too, so that nothing is lost and nothing is twice."""
        s = self.state()
        rows = new.dropDuplicates(["txn_id"])
        folder = self._put(self._unknown(rows, s, lambda f: True))
        while folder.rows:
            if self._commit(s.version + 1, "add", folder):
                return folder.rows
            before, s = s.version, self.state()
            mine = self.spark.read.parquet(folder.path)
            rewritten = not any(f.at <= before for f in s.folders)
            left = self._unknown(mine, s, lambda f: rewritten or f.at > before)
            folder = self._put(left)
        return 0

    def _unknown(self, rows: DataFrame, s: State, which: Callable[[Folder], bool]) -> DataFrame:
        """rows whose keys stand in none of the folders that `which` takes. A folder whose keys are all less or all greater
        isn't read. A replaced row's key still counts: its account has it in a later folder."""
        folders = [f for f in s.folders if which(f) and f.rows]
        if not folders:
            return rows
        r = rows.agg(F.count("*").alias("n"), F.min("txn_id").alias("low"), F.max("txn_id").alias("high")).first()
        near = [f.path for f in folders if r.n and f.low <= r.high and r.low <= f.high]
        return absent_from_much(rows, self.spark.read.parquet(*near).select("txn_id"), r.n) if near else rows

    # -- what users say

    def _log(self, name: str, schema: str) -> DataFrame:
        """All entries of an append-only log beside the ledger; none before the first."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def correct(self, merchant: str, category: str) -> None:
        """A user's category for a merchant; the last one said counts."""
        row = self.spark.createDataFrame([(merchant, category)], "merchant_norm string, user_category string").withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/corrections")

    def corrections(self) -> DataFrame:
        """(merchant_norm, user_category), one a merchant."""
        return latest(self._log("corrections", "merchant_norm string, user_category string, at timestamp"), ["merchant_norm"], ["at", "user_category"]).drop("at")

    def acknowledge(self, txn_id: str) -> bool:
        """Mark a transaction's anomaly as seen; False if there is no such transaction."""
        ledger = self.read()
        if ledger is None or ledger.where(F.col("txn_id") == txn_id).isEmpty():
            return False
        self.spark.createDataFrame([(txn_id,)], "txn_id string").coalesce(1).write.mode("append").parquet(f"{self.path}/acks")
        return True

    def acks(self) -> DataFrame:
        return self._log("acks", "txn_id string").distinct()
