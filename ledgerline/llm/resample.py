"""Importance resampling: draw the documents whose word distribution is nearest to that of a target.

Features are runs of up to `longest` words, hashed into buckets. Each text is written once as a packed stream of 16-bit
bucket numbers, several documents a block, with the documents' offsets in it. Blocks are sorted and run-length encoded
for the counts, and the gains of the buckets are later gathered from the same streams and summed by document, so texts
are read once. A perturbed score (Gumbel noise from a hash of the id) makes the highest scores a draw without repeats.

Null texts have no words. Documents without features weigh 0 and are never drawn. Repeated rows are rows of their own;
rows of one id have one noise. A null id is hashed as an empty one and comes last in ties. Texts of any length are
encoded whole: a block holds at least one document. No rows give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bytes, byte_steps, documents, materialize, numbered, release, table

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 10
SEED = "2024"
#: Spans longer than this many bytes are hashed by one call each; shorter ones all together.
LONG_SPAN = 48

BLOCK = "doc_ids array<long>, words array<int>, offsets array<int>, stream binary"


def _crc_steps() -> np.ndarray:
    """What each byte does to a CRC-32 (the reversed polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_steps()
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end], all spans byte by byte together."""
    out = np.empty(len(start), dtype=np.uint32)
    length = end - start
    for i in np.flatnonzero(length > LONG_SPAN):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    short = np.flatnonzero(length <= LONG_SPAN)
    order = short[np.argsort(-length[short], kind="stable")]
    at, falling = start[order], -length[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(int(-falling[0]) if len(order) else 0):
        alive = np.searchsorted(falling, -j, side="left")  # spans of more than j bytes
        c = crc[:alive]
        crc[:alive] = _CRC[(c ^ data[at[:alive] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def word_spans(b: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of lower-cased texts: a longest run of digits, letters and bytes from 0x80 on."""
    inside = np.concatenate(([False], _INSIDE[b.data], [False]))
    edge = np.zeros(len(b.data) + 1, dtype=bool)
    edge[b.offsets] = True  # a word ends where its text does
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(b.offsets, starts, side="right") - 1


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words alone with one space between: the buffer, and each word's start and end in it."""
    size = ends - starts
    to = np.cumsum(size + 1) - 1
    out = np.full(int(to[-1]) if len(to) else 0, 32, dtype=np.uint8)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to - size, size) + step] = data[np.repeat(starts, size) + step]
    return out, to - size, to


def bucket_stream(b: Bytes, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text by text; the offsets of texts in it; words of each text."""
    start, end, row = word_spans(b)
    data = b.data
    if longest > 1:
        data, start, end = joined(data, start, end)
    words = np.bincount(row, minlength=len(b.ids))
    parts, owners = [], []
    for n in range(1, longest + 1):
        head = np.flatnonzero(row[n - 1 :] == row[: max(0, len(row) - n + 1)])
        parts.append(crc32_spans(data, start[head], end[head + n - 1]) % np.uint32(buckets))
        owners.append(row[head])
    owner = np.concatenate(owners)
    stream = np.concatenate(parts).astype("<u2")
    if longest > 1:
        stream = stream[np.argsort(owner, kind="stable")]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(b.ids)))))
    return stream, offsets, words


def encode(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of documents as packed bucket streams: doc_ids, words and offsets of each, and the stream they share."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_steps(batches, lower=True):
            stream, offsets, words = bucket_stream(b, longest, buckets)
            ids = pa.ListArray.from_arrays(pa.array([0, len(b.ids)], pa.int32()), b.ids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([words.astype(np.int32)], pa.list_(pa.int32())), pa.array([offsets.astype(np.int32)], pa.list_(pa.int32())), pa.array([stream.tobytes()], pa.binary())], names=["doc_ids", "words", "offsets", "stream"]
            )

    return documents(docs).mapInArrow(run, BLOCK)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each stands in the stream: sorted, then run-length encoded."""
    s = np.sort(stream, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.concatenate((first, [len(s)])))


def bucket_counts(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all blocks: runs are added up in each task, then across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for stream in batch.column("stream"):
                value, n = run_lengths(np.frombuffer(stream.as_buffer(), "<u2"))
                total[value] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return blocks.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), with one added to every count."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = lambda b: (target.get(b, 0) + 1) * s_all / ((source.get(b, 0) + 1) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def weigh(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, offsets, stream in zip(*(batch.column(c) for c in ("doc_ids", "words", "offsets", "stream")), strict=True):
                at = offsets.values.to_numpy(zero_copy_only=False)
                n = np.diff(at).astype(np.int64)
                weight = np.zeros(len(n), dtype=np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    weight[full] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), "<u2")], at[full]) // n[full]
                yield pa.RecordBatch.from_arrays([ids.values, words.values.cast(pa.int64()), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null where it isn't drawn.

    Drawn is the given share (in hundredths, rounded down) of the documents with least_words words or more. docs has doc_id
    and text, target text. What the driver holds is two counts for each bucket. Documents are ranked by ranges of scores.
    """
    blocks = materialize(encode(docs, longest, buckets), "streams")
    counts = lambda b: {r.bucket: r.n for r in bucket_counts(b, buckets).collect()}  # noqa: E731  a row for each bucket at most
    gain = gains(counts(blocks), counts(encode(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296)))
    scored = weigh(blocks, gain).withColumn("score", F.col("weight") + gumbel).withColumn("may", F.col("n_words") >= least_words)
    scored = materialize(scored.drop("n_words"), "scores")
    release(docs.sparkSession, blocks)
    n = scored.where("may").count() * share // 100
    ranked = numbered(scored, [F.desc("may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")], "ranks", "rank")
    release(docs.sparkSession, scored)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("may") & (F.col("rank") <= n), F.col("rank")).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs that resample() draws, with all their columns; of an id that stands more than once, all rows."""
    ids = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct("*").alias("_row"))
    return rows.join(ids, F.col("_id").eqNullSafe(F.col("_drawn")), "left_semi").select("_row.*")


def op11_resample(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sql() -> str:
    """The same rows for DuckDB; the CRC of a word goes bit by bit."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    bits = "flatten(list_transform(range(length(h) // 2), lambda i: [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295)"
    return f"""WITH feats AS (SELECT doc_id, 0 AS kind, {words} AS ws, row_number() OVER () AS k FROM documents UNION ALL SELECT NULL, 1, {words}, 0 FROM benchmark),
each AS (SELECT k, kind, unnest(ws) AS w FROM feats), coded AS (SELECT w, {crc} % {BUCKETS} AS b FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM each))),
counts AS (SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM each JOIN coded USING (w) GROUP BY 1),
alls AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gain AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS})))) AS BIGINT) AS g FROM counts, alls),
weights AS (SELECT k, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM each JOIN coded USING (w) JOIN gain USING (b) WHERE kind = 0 GROUP BY 1),
scored AS (SELECT k, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM feats LEFT JOIN weights USING (k) WHERE kind = 0),
ranks AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {SHARE} // 100 THEN rank END AS rank FROM scored LEFT JOIN ranks USING (k)"""
