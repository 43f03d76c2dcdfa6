"""Centroid clustering of integer vectors: Lloyd's rounds that handle only what changed.

Each vector's owner and distance are kept in a written table, and the sums and counts of clusters beside it. In a round,
a vector whose owner stands where it stood is compared with the centroids that moved and with no other, since those were
no nearer before; a vector whose owner moved is compared with all. What changed owner is taken from one cluster's sums
and put to the other's as signed integers, added up in each task before they meet, so no round sums all vectors again.

Kept are vectors of exactly `size` components, none of them null or non-finite; a null vector isn't kept. Repeated rows
are vectors of their own, and of one id the lesser vector comes first where centroids are chosen; a null id is hashed as
an empty one. Ties of distance go to the smaller number. With fewer vectors than clusters there are as many clusters as
vectors; no vectors give no rows. Components must stay below 2**27 after scaling, so that distances are exact: larger
ones raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, table

SIZE = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = "2"
#: Vectors of one numpy step.
STEP = 4096
#: Components below this give exact sums of products in doubles; above it integers are used.
EXACT = 1 << 22


def kept(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): vectors of `size` finite components as integers floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    good = (F.size("embedding") == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    limit = F.forall("q", lambda v: v.between(1 - (1 << 27), (1 << 27) - 1))
    rows = embeddings.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v)).alias("q"))
    return rows.withColumn("q", F.when(limit, F.col("q").cast("array<int>")).otherwise(F.raise_error(F.lit("a component of 2**27 or more"))))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, as rows; a top-k, `clusters` of them reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "q").orderBy("key", "q").limit(clusters).collect()
    return np.array([r.q for r in sorted(rows, key=lambda r: (r.key, r.q))], dtype=np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exactly."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT and x.shape[1] < 1 << 8:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def nearest(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owner and distance of each row. owner is -1 where there is none yet; changed marks centroids that moved."""
    owner, distance = owner.copy(), distance.copy()
    full = (owner < 0) | changed[owner]
    if full.any():
        d = distances(x[full], centroids)
        owner[full], distance[full] = d.argmin(1), d.min(1)  # argmin takes the first of equals
    some = np.flatnonzero(changed)
    rest = np.flatnonzero(~full)
    if len(some) and len(rest):
        d = distances(x[rest], centroids[some])
        near, best = some[d.argmin(1)], d.min(1)
        better = (best < distance[rest]) | ((best == distance[rest]) & (near < owner[rest]))
        owner[rest[better]], distance[rest[better]] = near[better], best[better]
    return owner, distance


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def assign(vectors: DataFrame, centroids: np.ndarray, changed: np.ndarray, first: bool) -> DataFrame:
    """vectors with `owner` and `distance` against new centroids, `was` (the owner before, -1 at first) and `moved`."""
    size = centroids.shape[1]
    schema = "vec_id long, q array<int>, was int, owner int, distance long, moved boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                b = whole.slice(at, STEP)
                n = b.num_rows
                was = np.full(n, -1, np.int64) if first else b.column("owner").to_numpy(zero_copy_only=False).astype(np.int64)
                old = np.zeros(n, np.int64) if first else b.column("distance").to_numpy(zero_copy_only=False)
                owner, distance = nearest(_matrix(b.column("q"), size), was, old, centroids, changed)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("q"), pa.array(was, pa.int32()), pa.array(owner, pa.int32()), pa.array(distance), pa.array(owner != was)], names=["vec_id", "q", "was", "owner", "distance", "moved"]
                )

    return vectors.mapInArrow(run, schema)


def transfers(assigned: DataFrame, clusters: int, size: int) -> DataFrame:
    """(cluster, dim, delta): what the vectors that changed owner take from and bring to the sums; dim -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        delta = np.zeros((clusters, size + 1), dtype=np.int64)
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows, np.int64), _matrix(b.column("q"), size)])
            was, owner = (b.column(c).to_numpy(zero_copy_only=False) for c in ("was", "owner"))
            for c in np.union1d(was[was >= 0], owner):
                delta[c] += x[owner == c].sum(0) - x[was == c].sum(0)
        c, dim = np.nonzero(delta)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(dim - 1, pa.int32()), pa.array(delta[c, dim])], names=["cluster", "dim", "delta"])

    moved = assigned.where("moved").select("q", "was", "owner").mapInArrow(run, "cluster int, dim int, delta long")
    return moved.groupBy("cluster", "dim").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta"))


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector after the given rounds, and the final centroids.

    The driver holds the centroids and sums, clusters times size numbers. Every round writes the assignments anew.
    """
    spark = embeddings.sparkSession
    rows = kept(embeddings, size, scale)
    centroids = first_centroids(rows, clusters, seed)
    k = len(centroids)
    if not k:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, size), np.int64)
    sums = [[0] * (size + 1) for _ in range(k)]  # whole numbers of any size; the first is the count
    changed, done = np.ones(k, dtype=bool), None
    for i in range(rounds + 1):
        assigned = materialize(assign(rows if done is None else done, centroids, changed, done is None), "assigned")
        if done is not None:
            release(spark, done)
        done = assigned
        if i == rounds:
            break
        for r in transfers(done, k, size).collect():  # a row for each cluster and component at most
            sums[r.cluster][r.dim + 1] += int(r.delta)
        now = np.array([[s // n[0] for s in n[1:]] if n[0] else old for n, old in zip(sums, centroids.tolist(), strict=True)], dtype=np.int64)
        changed = (now != centroids).any(1)
        centroids = now
    return done.select("vec_id", F.col("owner").alias("cluster"), "distance"), centroids


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    out, centroids = cluster(table(spark, sf_dir, "embeddings"))
    own = {r.cluster: int(r.own) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    said = [(c, n, sum(own.values()), sha[c]) for c, n in own.items()]  # a row for each cluster
    clusters = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sql() -> str:
    """The same rounds for DuckDB, every vector compared with every centroid."""
    out = f"""WITH kept AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
c0 AS MATERIALIZED (SELECT c, q FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q FROM kept) WHERE c < {CLUSTERS})"""
    near = "SELECT k, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT k, c, list_sum(list_transform(list_zip(kept.q, cc.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{i} cc) GROUP BY 1"
    for i in range(ROUNDS + 1):
        out += f", a{i} AS MATERIALIZED ({near.replace('{i}', str(i))})"
        if i < ROUNDS:
            out += f""", s{i} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS v, unnest(range({SIZE})) AS i FROM kept JOIN a{i} USING (k)) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{i} GROUP BY 1) m USING (c))"""
    return out + f""" SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(cc.q, ',')) AS centroid_sha256 FROM kept JOIN a{ROUNDS} USING (k) JOIN c{ROUNDS} cc USING (c)"""
