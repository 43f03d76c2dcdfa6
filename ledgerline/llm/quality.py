"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's score comes from its own and its neighbours' features, and each pair of
adjacent labels has a weight; forward-backward gives each line's marginal probability of being good, and the mean of
the marginals, weighted by length, is the document's quality. A document's own label stands for its lines in fitting,
softened: lines of a rejected document that look like those of accepted ones pull less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bytes, byte_steps, crc_mod, documents, giving_back, table, words, word_hashes

#: Labelled documents that are collected to fit the weights, at most.
FIT_DOCS = 1500
#: Lines longer than this many bytes are cut at it, so that one endless line is a sequence too.
LINE_BYTES = 400
#: Hashed word features of a line.
HASHED = 512
EPOCHS = 40

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 common punctuation, 6 high byte
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[[44, 46, 39, 45, 59, 58, 63]], _CLASS[128:] = 1, 2, 3, 4, 5, 6
_CLASSES = 7


class Lines:
    """The lines of some texts: byte spans, the row each belongs to, and their features."""

    def __init__(self, b: Bytes):
        breaks = np.flatnonzero(b.data == 10) + 1
        edges = np.unique(np.concatenate((b.offsets, breaks)))
        edges = edges[edges <= len(b.data)]
        gaps = np.diff(edges)
        extra = np.maximum(0, (gaps - 1) // LINE_BYTES)  # cuts inside long lines
        more = np.repeat(edges[:-1], extra) + (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1) * LINE_BYTES
        edges = np.union1d(edges, more)
        start, end = edges[:-1], edges[1:]
        self.row = np.searchsorted(b.offsets, start, side="right") - 1
        self.start, self.end, self.rows = start, end, len(b.ids)
        self.length = (end - start).astype(np.float64)
        self.dense, self.hashed, self.hashed_line = self._features(b)

    def _features(self, b: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.start)
        if not n:
            return np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        line_of = np.repeat(np.arange(n), (self.end - self.start))
        counts = np.bincount(line_of * _CLASSES + _CLASS[b.data], minlength=n * _CLASSES).reshape(n, _CLASSES)
        share = counts / self.length[:, None]
        ws, we, _ = words(b)
        hashes = word_hashes(b, ws, we)
        line = np.searchsorted(self.start, ws, side="right") - 1
        per = np.bincount(line, minlength=n).astype(np.float64)
        size = np.bincount(line, weights=we - ws, minlength=n) / np.maximum(per, 1)
        same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])))[: len(hashes)]
        repeated = np.bincount(line, weights=same, minlength=n) / np.maximum(per, 1)
        order = np.lexsort((hashes, line))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order], weights=first, minlength=n) / np.maximum(per, 1)
        lone = np.bincount(line, weights=(we - ws) == 1, minlength=n) / np.maximum(per, 1)
        symbol = _CLASS[b.data[np.maximum(we - 1, 0)]] == 0 if len(we) else np.zeros(0, bool)
        ends_odd = np.bincount(line, weights=symbol, minlength=n) / np.maximum(per, 1)
        text_hash = np.zeros(n, dtype=np.uint64)
        np.add.at(text_hash, line, hashes)
        twin = np.zeros(n)
        twin[1:] = (text_hash[1:] == text_hash[:-1]) & (self.row[1:] == self.row[:-1])
        base = np.column_stack([share, np.log1p(self.length) / 6, np.log1p(per) / 5, size / 10, repeated, distinct, lone, ends_odd, twin, per == 0])
        base = np.column_stack([base, base[:, :_CLASSES] ** 2, (repeated > 0.2), (distinct < 0.5), (share[:, 0] > 0.03), (share[:, 0] > 0.1), (share[:, 2] > 0.3)])
        before, after = np.zeros_like(base), np.zeros_like(base)
        joined = self.row[1:] == self.row[:-1]
        before[1:][joined], after[:-1][joined] = base[:-1][joined], base[1:][joined]
        edge = np.ones(n)
        edge[1:] -= joined
        return np.column_stack([base, before, after, edge, np.ones(n)]), (hashes % np.uint64(HASHED)).astype(np.int64), line


class LineField:
    """Weights of a two-label chain. Label 1 is good."""

    def __init__(self, dense: np.ndarray, hashed: np.ndarray, pairs: np.ndarray, scale: tuple[float, float] = (1.0, 0.0)):
        self.dense, self.hashed, self.pairs, self.scale = dense, hashed, pairs, scale

    def scores(self, x: Lines) -> np.ndarray:
        """The good label's score of each line over the bad one's."""
        n = len(x.start)
        per = np.maximum(np.bincount(x.hashed_line, minlength=n), 1)
        return x.dense @ self.dense + np.bincount(x.hashed_line, weights=self.hashed[x.hashed], minlength=n) / per

    def marginals(self, x: Lines, score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and P(label, next label) of each line but the last of its text: forward-backward, all
        texts step by step together."""
        s = self.scores(x) if score is None else score
        n = len(s)
        first = np.flatnonzero(np.concatenate(([True], x.row[1:] != x.row[:-1]))) if n else np.zeros(0, np.int64)
        count = np.diff(np.concatenate((first, [n])))
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        unary = np.zeros((n, 2))
        unary[:, 1] = s
        alpha, beta = unary.copy(), np.zeros((n, 2))
        longest = int(count[0]) if n else 0
        alive = np.searchsorted(-count, -np.arange(longest), side="left") if n else []
        for t in range(1, longest):
            i = first[: alive[t]] + t
            alpha[i] += np.logaddexp(alpha[i - 1, :1] + self.pairs[0], alpha[i - 1, 1:] + self.pairs[1])
        for t in range(longest - 1, 0, -1):
            i = first[: alive[t]] + t
            on = unary[i] + beta[i]
            beta[i - 1] = np.logaddexp(self.pairs[:, 0] + on[:, :1], self.pairs[:, 1] + on[:, 1:])
        log = alpha + beta
        z = np.logaddexp(log[:, 0], log[:, 1])
        good = np.exp(log[:, 1] - z)
        inner = np.flatnonzero(x.row[1:] == x.row[:-1]) if n else np.zeros(0, np.int64)
        both = alpha[inner][:, :, None] + self.pairs[None] + (unary[inner + 1] + beta[inner + 1])[:, None, :]
        return good, np.exp(both - z[inner][:, None, None])

    def quality(self, x: Lines, score: np.ndarray | None = None) -> np.ndarray:
        """A number from 0 to 1 for each text: its lines' marginals weighted by length, on a calibrated scale."""
        good, _ = self.marginals(x, score)
        weight = np.bincount(x.row, weights=x.length, minlength=x.rows)
        mean = np.bincount(x.row, weights=good * x.length, minlength=x.rows) / np.maximum(weight, 1)
        mean = np.where(weight > 0, mean, 0.0)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * mean + self.scale[1], -40, 40)))


def fit_field(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> LineField:
    """Weights by gradient ascent (Adam) on the likelihood of the lines' labels, classes weighted alike."""
    data = [t.encode() for t in texts]
    b = Bytes(np.arange(len(data)), np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in data]))).astype(np.int64))
    x = Lines(b)
    y = labels[x.row].astype(np.float64)
    field = LineField(np.zeros(x.dense.shape[1]), np.zeros(HASHED), np.zeros((2, 2)))
    if not len(y) or len(set(labels.tolist())) < 2:
        return field
    # each text counts as one, its lines by length; both labels weigh the same in all
    weight = x.length / np.bincount(x.row, weights=x.length, minlength=x.rows)[x.row]
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = weight * (0.5 / share[labels])[x.row]
    per = np.maximum(np.bincount(x.hashed_line, minlength=len(y)), 1)
    inner = np.flatnonzero(x.row[1:] == x.row[:-1])
    size = x.dense.shape[1]
    theta = np.zeros(size + HASHED + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        field.dense, field.hashed, field.pairs = theta[:size], theta[size : size + HASHED], theta[size + HASHED :].reshape(2, 2)
        good, both = field.marginals(x)
        off = (y - good) * weight
        pair = np.zeros((2, 2))
        seen = y[inner].astype(np.int64)
        pair[[0, 1], [0, 1]] = np.bincount(seen, weights=weight[inner], minlength=2)
        pair -= (both * weight[inner][:, None, None]).sum(axis=0)
        hashed = np.bincount(x.hashed, weights=(off / per)[x.hashed_line], minlength=HASHED)
        gradient = np.concatenate((x.dense.T @ off, hashed, pair.ravel())) / len(data) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.dense, field.hashed, field.pairs = theta[:size], theta[size : size + HASHED], theta[size + HASHED :].reshape(2, 2)
    # the scale on which 0.5 is the best cut for the labels as they are dealt
    good, _ = field.marginals(x)
    mean = np.bincount(x.row, weights=good * x.length, minlength=x.rows) / np.maximum(np.bincount(x.row, weights=x.length, minlength=x.rows), 1)
    a, c = 8.0, -4.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * mean + c)))
        g, h = np.array([((labels - p) * mean).mean(), (labels - p).mean()]), p * (1 - p)
        hess = np.array([[(h * mean * mean).mean(), (h * mean).mean()], [(h * mean).mean(), h.mean()]]) + 1e-3 * np.eye(2)
        da, dc = np.linalg.solve(hess, g - 1e-3 * np.array([0.1 * a, 0]))
        a, c = a + 0.5 * da, c + 0.5 * dc
    field.scale = (float(a), float(c))
    return field


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, held_out: int = 1) -> LineField:
    """A field fitted on at most fit_docs labelled documents, chosen by a hash of the id; only rows whose
    crc32(doc_id) mod 3 is not held_out are learned from. Labels that are null are left out."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(crc_mod("doc_id", 3) != held_out)
    picked = known.orderBy(F.xxhash64("doc_id"), "quality").limit(fit_docs)
    rows = documents(docs).join(F.broadcast(picked), "doc_id").select("text", "quality").limit(2 * fit_docs).toPandas()
    return fit_field(list(rows["text"]), rows["quality"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, field: LineField) -> DataFrame:
    """Per document: doc_id, score (0 to 1, higher: better quality).

    Null texts count as empty; an empty text has no lines and gets the lowest mean. Rows are kept one for one, repeated
    doc_ids and texts too; lines of any length and number are used. A narrow map: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_steps(giving_back(batches)):
            yield pa.RecordBatch.from_arrays([b.ids, pa.array(field.quality(Lines(b)), pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, field: LineField, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least `least`; all columns stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in giving_back(batches):
            quality = [field.quality(Lines(b)) for b in byte_steps([batch])]
            yield batch.filter(pa.array(np.concatenate(quality) >= least)) if quality else batch

    return docs.select(*names).mapInArrow(run, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
