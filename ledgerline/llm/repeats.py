"""Removal of repeated byte strings: every byte under a string of LENGTH bytes that also starts elsewhere.

The dealt method, external induced sorting of all suffixes, can't meet the limits here (figures in the README). This
does not sort suffixes and carries no common-prefix values; it groups hashed names of strings in Spark's shuffle, which
spills to disk:

1. In each string of LENGTH bytes the smallest hashed GRAM marks its anchor. Equal strings have equal anchors at equal
   offsets, so only strings with the same anchor name can be equal; about one byte in 170 is an anchor.
2. Anchors of equal name whose whole contexts are equal settle all strings around them at once.
3. What differs is settled in two levels: chunks of CHUNK neighbouring strings (equal as a whole: all repeat; nothing
   that all share repeated: none does), then the single strings of chunks that are neither.

Names are 64-bit hashes of the bytes. Every step groups by name with counts combined before the shuffle, so a passage
of a third of all documents is a count, not a list.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _INVERSE, Bytes, byte_steps, join_versions, materialize, mix, powers, release, table, versions

LENGTH = 400
#: Strings of so many bytes (40 to 50 words) that stand elsewhere are reported, but not removed.
PASSAGE = 256
GRAM = 64
CHUNK = 16
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Names:
    """Hashes of any substrings of a buffer."""

    def __init__(self, b: Bytes):
        self.h, self.inverse = b.prefix_hash(), powers(len(b.data) + 1, _INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.h[end] - self.h[start]) * self.inverse[start])


def anchor_arrays(b: Bytes, length: int, gram: int):
    """Row, name, anchor, first and last start (all in the buffer), context name: one entry for each run of strings
    with the same anchor. None if no text is long enough."""
    n, span = len(b.data), length - gram + 1
    if n < length:
        return None
    names = Names(b)
    g = names.of(np.arange(n - gram + 1), np.arange(gram, n + 1))
    key = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)  # the leftmost of equal ones
    blocks = np.concatenate((key, np.full(-len(key) % span, ~np.uint64(0)))).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(len(g) - span + 1)
    row = np.searchsorted(b.offsets, start, side="right") - 1
    inside = start + length <= b.offsets[row + 1]
    start, row = start[inside], row[inside]
    if not len(start):
        return None
    anchor = (np.minimum(behind[start], ahead[start + span - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    run = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    low, high = start[run], start[np.concatenate((run[1:] - 1, [len(start) - 1]))]
    row, anchor = row[run], anchor[run]
    context = mix(names.of(low, high + length) + (anchor - low).astype(np.uint64) * _C1 + (high - low).astype(np.uint64) * _C2)
    return row, g[anchor], anchor, low, high, context


def _batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    as_arrow = lambda v: v if isinstance(v, pa.Array) else pa.array(v.view(np.int64) if v.dtype == np.uint64 else v)
    return pa.RecordBatch.from_arrays([as_arrow(v) for v in columns.values()], names=list(columns))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, version, name, anchor, low, high, context); positions are bytes of the text."""

    def run(batches):
        for batch in batches:
            at, version = 0, batch.column(2).to_numpy()
            for b in byte_steps([batch]):
                if (found := anchor_arrays(b, length, gram)) is not None:
                    row, name, anchor, low, high, context = found
                    zero = b.offsets[row]
                    yield _batch({"doc_id": b.ids.take(pa.array(row)), "version": version[at + row], "name": name, "anchor": anchor - zero, "low": low - zero, "high": high - zero, "context": context})
                at += len(b.ids)

    return docs.mapInArrow(run, "doc_id long, version long, name long, anchor long, low long, high long, context long")


def _described(held: DataFrame, wanted: DataFrame, columns: list[str], describe, schema: str) -> DataFrame:
    """describe(names, zero, wanted row) over the texts of held, for wanted rows (doc_id, version, columns...)."""
    lists = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct(*columns)).alias("wanted"))

    def run(batches):
        for batch in batches:
            at = 0
            wanted_rows = batch.column(3)
            for b in byte_steps([batch]):
                mine = wanted_rows.slice(at, len(b.ids))
                flat = mine.flatten()
                row = np.repeat(np.arange(len(b.ids)), mine.value_lengths().to_numpy())
                fields = {c: flat.field(c).to_numpy() for c in columns}
                if len(row):
                    out = describe(Names(b), b.offsets[row], fields)
                    which = out.pop("which")
                    yield _batch({"doc_id": b.ids.take(pa.array(row[which])), "version": batch.column(2).to_numpy()[at + row[which]], **out})
                at += len(b.ids)

    rows = join_versions(held, lists).select("doc_id", "text", "version", "wanted")
    return rows.mapInArrow(run, "doc_id long, version long, " + schema)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Ranges of repeated bytes by document (doc_id, version, ranges), overlapping ones too, and a table of (doc_id, text,
    version) that holds at least the documents of the ranges. docs: as versions() gives them."""
    found = materialize(anchors(docs, length, gram), "anchors")
    contexts = found.groupBy("name", "context").agg(F.count("*").alias("n"))
    by_name = contexts.groupBy("name").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    contexts = contexts.join(by_name, "name").where("n > 1 or kinds > 1")
    some = materialize(found.join(contexts, ["name", "context"]), "repeated-anchors")
    held = materialize(join_versions(docs.select("doc_id", "text", "version"), some.select("doc_id", "version").distinct(), "left_semi"), "held-texts")
    release(docs.sparkSession, found)

    ranges = [some.where("n > 1").select("doc_id", "version", F.col("low").alias("start"), (F.col("high") + length).alias("end"))]

    # contexts that are alone under a repeated name, and one of each kind that they could share strings with
    open_ = some.where("kinds > 1 and least = 1")
    wanted = open_.where("n = 1").unionByName(open_.where("n > 1").dropDuplicates(["name", "context"])).select("doc_id", "version", "name", "anchor", "low", "high", F.col("n").cast("long").alias("n"))

    def chunks(names: Names, zero, f):
        first, last = (f["anchor"] - f["high"]) // chunk, (f["anchor"] - f["low"]) // chunk
        count = last - first + 1
        which = np.repeat(np.arange(len(first)), count)
        part = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        anchor = (zero + f["anchor"])[which]
        low = np.maximum(zero[which] + f["low"][which], anchor - part * chunk - chunk + 1)
        high = np.minimum(zero[which] + f["high"][which], anchor - part * chunk)
        salt = f["name"][which].view(np.uint64) + part.astype(np.uint64) * _C1
        whole = mix(names.of(low, high + length) + salt + (anchor - low).astype(np.uint64) * _C2 + (high - low).astype(np.uint64))
        core = mix(names.of(anchor - part * chunk, anchor - part * chunk - chunk + 1 + length) + salt)
        base = zero[which]
        return {"which": which, "name": f["name"][which], "anchor": f["anchor"][which], "low": low - base, "high": high - base, "whole": whole, "core": core, "alone": (f["n"][which] == 1).astype(np.int64)}

    cut = materialize(_described(held, wanted, ["name", "anchor", "low", "high", "n"], chunks, "name long, anchor long, low long, high long, whole long, core long, alone long"), "chunks")
    wholes = cut.groupBy("core", "whole").agg(F.count("*").alias("wholes"), F.max("alone").alias("any_alone"))
    cores = wholes.groupBy("core").agg(F.count("*").alias("kinds"), F.max(((F.col("wholes") == 1) & (F.col("any_alone") == 1)).cast("int")).alias("open"))
    wholes = wholes.join(cores, "core").where("wholes > 1 or (kinds > 1 and open = 1)")
    cut = materialize(cut.join(wholes, ["core", "whole"]), "repeated-chunks")
    ranges.append(cut.where("wholes > 1 and alone = 1").select("doc_id", "version", F.col("low").alias("start"), (F.col("high") + length).alias("end")))

    open_ = cut.where("kinds > 1 and open = 1")
    wanted = open_.where("wholes = 1").unionByName(open_.where("wholes > 1").dropDuplicates(["core", "whole"]))
    wanted = wanted.select("doc_id", "version", "name", "anchor", "low", "high", F.when((F.col("wholes") == 1) & (F.col("alone") == 1), 1).otherwise(0).cast("long").alias("ask"))

    def singles(names: Names, zero, f):
        count = f["high"] - f["low"] + 1
        which = np.repeat(np.arange(len(count)), count)
        start = (zero + f["low"])[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        offset = (zero + f["anchor"])[which] - start
        return {"which": which, "start": start - zero[which], "text_name": mix(names.of(start, start + length) + f["name"][which].view(np.uint64) + offset.astype(np.uint64) * _C1), "ask": f["ask"][which]}

    single = materialize(_described(held, wanted, ["name", "anchor", "low", "high", "ask"], singles, "start long, text_name long, ask long"), "strings")
    twice = single.groupBy("text_name").agg(F.count("*").alias("n")).where("n > 1").select("text_name")
    ranges.append(single.where("ask = 1").join(twice, "text_name", "left_semi").select("doc_id", "version", "start", (F.col("start") + length).alias("end")))
    every = ranges[0].unionByName(ranges[1]).unionByName(ranges[2])
    listed = materialize(every.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges")), "ranges")
    release(docs.sparkSession, some, cut, single)
    return listed, held


def kept_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Which bytes stay when the ranges go, and the number of longest removed runs."""
    depth = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    gone = np.cumsum(depth[:-1]) > 0
    return ~gone, int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def covered(ranges: Column) -> Column:
    """Bytes under sorted ranges (start, end) that may overlap."""
    zero = F.lit(0).cast("long")
    new = lambda a, r: F.greatest(zero, r["end"] - F.greatest(a["to"], r["start"]))
    step = lambda a, r: F.struct((a["sum"] + new(a, r)).alias("sum"), F.greatest(a["to"], r["end"]).alias("to"))
    return F.aggregate(ranges, F.struct(zero.alias("sum"), zero.alias("to")), step, lambda a: a["sum"])


_RESULT = "doc_id long, version long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, passage: int = PASSAGE) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_passage: bytes under strings of `passage`
    bytes that also start elsewhere, removed or not.

    Null texts count as empty; texts shorter than `length` keep all. Rows are kept one for one, and rows with equal
    texts repeat each other, those of one doc_id or of none too. Other columns are dropped. Bytes are those of UTF-8, and
    what stays need not be valid UTF-8.
    """
    docs = versions(docs)
    passages, held = repeated_ranges(docs, passage, gram, chunk)
    passages = materialize(passages.select("doc_id", "version", covered(F.col("ranges")).alias("n_passage")), "passages")
    release(docs.sparkSession, held)
    ranges, held = repeated_ranges(docs, length, gram, chunk)

    def run(batches):
        for batch in batches:
            rows, at = [], 0
            for b in byte_steps([batch]):
                for i in range(len(b.ids)):
                    data, spans = b.data[b.offsets[i] : b.offsets[i + 1]], batch.column(3)[at + i].values
                    stay, runs = kept_bytes(data, spans.field("start").to_numpy(), spans.field("end").to_numpy())
                    rows.append((batch.column(0)[at + i].as_py(), batch.column(2)[at + i].as_py(), len(data), int(len(data) - stay.sum()), runs, hashlib.sha256(data[stay].tobytes()).hexdigest()))
                at += len(b.ids)
            if rows:
                names = ["doc_id", "version", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    changed = join_versions(held, ranges).select("doc_id", "text", "version", "ranges").mapInArrow(run, _RESULT)
    zero = F.lit(0).cast("long")
    whole = docs.select("doc_id", "version", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    every = changed.unionByName(join_versions(whole, ranges.select("doc_id", "version"), "left_anti"))
    return join_versions(every, passages, "left").withColumn("n_passage", F.coalesce("n_passage", zero)).drop("version")


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
