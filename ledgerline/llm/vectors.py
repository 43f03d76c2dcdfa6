"""Embedding near-duplicates by sorted projection passes.

In each pass vectors are ordered by their label and the concatenated signs of random projections, and every vector is
compared with a bounded window of followers in that order. Verified pairs of all passes are united into components.
Equal vectors are one node from the start. An exact completion follows: blocks of a label are compared with every block
that a bound on distances leaves in reach, links are counted, and those between components join them. So neither windows
nor large groups cap anything, and the passes decide nothing: they only leave less to join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .components import components

#: Least cosine of a link.
COSINE = 0.98
PASSES = 10
#: Sign bits of a sort key, and followers each vector is compared with.
BITS, WINDOW = 48, 24
#: Nodes in a block when links are counted, and rows of a block that are compared at once.
BLOCK, SLICE = 2048, 256
#: Partitions of the sorted rows of all passes.
PARTITIONS = 48


def noded(vectors: DataFrame) -> DataFrame:
    """vec_id, node, label, v: equal vectors of a label share a node; it is null for vectors that link with nothing."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)  # -0.0 becomes 0.0
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    node = F.when(F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)), F.xxhash64("label", v))
    return vectors.select("vec_id", node.alias("node"), F.col("label").cast("string").alias("label"), v.alias("v"))


def unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keyed(nodes: DataFrame, passes: int, bits: int, seed: int = 29) -> DataFrame:
    """A row for each node and pass, with the pass's sort key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, part in f.groupby(f["v"].map(len)):
                x = unit(part["v"])
                for p in range(passes):
                    plane = np.random.default_rng([seed, p, size]).standard_normal((size, bits))
                    yield part.assign(sort_pass=p, key=((x @ plane) > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)))

    return nodes.select("node", "label", "v").mapInPandas(run, "node long, label string, v array<double>, sort_pass int, key long")


def _near(f: pd.DataFrame, count: int, window: int, least: float) -> pd.DataFrame:
    """Pairs of a row before `count` and one of the `window` rows after it, of one pass and label, near enough."""
    out = []
    size = f["v"].map(len).to_numpy()
    group = f["sort_pass"].astype(str).str.cat([f["label"], pd.Series(size, index=f.index).astype(str)], sep="/").to_numpy()
    node, x = f["node"].to_numpy(), np.zeros((len(f), size.max(initial=1)))
    for s in np.unique(size):
        x[size == s, :s] = unit(f["v"][size == s])
    for d in range(1, window + 1):
        i = np.arange(max(0, min(count, len(f) - d)))
        i = i[group[i] == group[i + d]]
        i = i[np.einsum("ij,ij->i", x[i], x[i + d]) >= least]
        out.append(np.stack([node[i], node[i + d]], axis=1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def window_pairs(nodes: DataFrame, passes: int = PASSES, bits: int = BITS, window: int = WINDOW, least: float = COSINE, partitions: int = PARTITIONS) -> DataFrame:
    """Verified pairs (a, b) of nodes that stand within a window of each other in some pass, maybe more than once."""
    order = ["sort_pass", "label", F.size("v"), "key", "node"]
    rows = keyed(nodes, passes, bits).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    edge = "edge int, place int, node long, label string, v array<double>, sort_pass int"
    columns = ["node", "label", "v", "sort_pass"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, start = TaskContext.get().partitionId(), None, []
        for f in frames:
            if len(start) < window:
                start = pd.concat([start, f[columns]]).head(window) if len(start) else f[columns].head(window)
            held = f[columns] if held is None else pd.concat([held, f[columns]], ignore_index=True)
            done = len(held) - window
            if done > 0:
                yield _near(held, done, window, least).assign(**dict.fromkeys(_PAIRED[2:]))
                held = held.iloc[done:].reset_index(drop=True)
        if held is not None:
            yield _near(held, len(held), window, least).assign(**dict.fromkeys(_PAIRED[2:]))
            # windows that go on in the next partition: the last rows of this one meet the first rows of that one
            yield held.tail(window).assign(edge=part, place=0, a=None, b=None)[[*_PAIRED]]
            yield start.assign(edge=part - 1, place=1, a=None, b=None)[[*_PAIRED]]

    found = materialize(rows.select(*columns).mapInPandas(run, f"a long, b long, {edge}"), "sorted-pass")

    def across(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place", kind="stable")
        last = int((f["place"] == 0).sum())
        x = _near(f, last, window, least)
        mine = set(f["node"][:last])
        return x[x["a"].isin(mine) | x["b"].isin(mine)]

    edges = found.where(F.col("edge").isNotNull()).drop("a", "b").groupBy("edge").applyInPandas(across, "a long, b long")
    return found.where(F.col("a").isNotNull()).select("a", "b").union(edges)


_PAIRED = ("a", "b", "edge", "place", "node", "label", "v", "sort_pass")


def celled(nodes: DataFrame, least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """nodes with area, cell and reach. Only nodes of one area can link, and those of one label and length share one: large
    ones have an area each, with about one pivot a block; small ones are dealt to areas together. A node's cell is its
    nearest pivot, and reach holds every cell in which a node may be near enough to it. That is exact: whatever lies in
    another cell is on the other side of the plane between both pivots, so the distance to that plane is a lower bound."""
    spark = nodes.sparkSession
    kinds = nodes.groupBy("label", F.size("v").alias("dims")).agg(F.count("*").alias("size"))
    large = {(r["label"], r["dims"]): i for i, r in enumerate(kinds.where(F.col("size") > block).collect())}
    areas = -(-(kinds.where(F.col("size") <= block).agg(F.sum("size")).first()[0] or 0) // block)
    picked = nodes.select("node", "label", "v").where(F.pmod(F.xxhash64("node", F.lit(17)), F.lit(block)) == 0).join(F.broadcast(kinds.where(F.col("size") > block)), "label")
    held: dict[tuple, list] = {}
    for r in picked.where(F.size("v") == F.col("dims")).orderBy("node").select("label", "dims", "v").collect():
        held.setdefault((r["label"], r["dims"]), []).append(r["v"])
    spread = spark.sparkContext.broadcast((large, {k: unit(pd.Series(v)) for k, v in held.items()}))
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        large, pivots = spread.value
        for f in frames:
            for key, part in f.groupby(["label", f["v"].map(len)]):
                cell, reach = np.zeros(len(part), np.int64), [[0]] * len(part)
                if key in pivots:
                    dots = unit(part["v"]) @ pivots[key].T
                    cell = dots.argmax(axis=1)
                    gap = np.sqrt(np.maximum(0, 2 - 2 * pivots[key][cell] @ pivots[key].T))
                    near = dots.max(axis=1, keepdims=True) - dots <= radius * gap + 1e-7
                    reach = [np.flatnonzero(x).tolist() for x in near]
                yield part.assign(area=large.get(key, -1), cell=cell, reach=reach)

    fields = ", ".join(f"{c} {t}" for c, t in nodes.dtypes)
    found = nodes.mapInPandas(run, f"{fields}, area long, cell long, reach array<long>")
    return found.withColumn("area", F.when(F.col("area") < 0, -1 - F.pmod(F.xxhash64("label", F.size("v")), F.lit(max(1, areas)))).otherwise(F.col("area")))


def _merged(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """low, the smallest member of each one's component, after a and b are linked one by one."""
    while len(a):
        x, y = low[a], low[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    return low


def _linked(f: pd.DataFrame, least: float) -> pd.DataFrame:
    """The links between two blocks, or inside one: node, links, root and the smallest root that links of these lead to."""
    roots, root = np.unique(f["root"].to_numpy(), return_inverse=True)
    many, mine, low = f["many"].to_numpy(), f["mine"].to_numpy(), np.arange(len(roots))
    size = f["v"].map(len)
    kind = pd.factorize(f["label"].str.cat(size.astype(str), sep="/"))[0]
    x = np.zeros((len(f), size.max()))
    for s in size.unique():
        x[size == s, :s] = unit(f["v"][size == s])
    inside = f["i"].iat[0] == f["j"].iat[0]
    left, right = np.flatnonzero(mine == f["i"].iat[0]), np.flatnonzero(mine == f["j"].iat[0])
    links = np.zeros(len(f), np.int64)
    for at in range(0, len(left), SLICE) if len(right) else ():
        rows = left[at : at + SLICE]
        near = (x[rows] @ x[right].T >= least) & (kind[rows][:, None] == kind[right][None])
        if inside:
            near[np.arange(len(rows)), at + np.arange(len(rows))] = False
        else:
            links[right] += many[rows] @ near
        links[rows] += near @ many[right]
        a, b = np.nonzero(near & (low[root[rows]][:, None] != low[root[right]][None]))
        low = _merged(low, root[rows[a]], root[right[b]])
    out = pd.DataFrame({"node": f["node"], "links": links, "root": f["root"], "joined": roots[low][root]})
    return out[links > 0]


def exact_links(members: DataFrame, least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(node, links, root, joined), in parts that add up: for nodes (node, root, many, label, v and those of celled), of
    which `many` equal vectors each, the vectors of other nodes with a cosine of at least `least`, and another root that
    links lead to from this one. Cells are dealt in blocks, and every pair of blocks in reach is a task of its own."""
    cells = members.groupBy("area", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    mine = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts"))
    rows = members.join(cells, ["area", "cell"]).withColumn("mine", mine).drop("cell", "parts").withColumn("cell", F.explode("reach"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.col("cell") * (1 << 32) + p))
    rows = rows.join(cells, ["area", "cell"]).withColumn("other", other)
    rows = rows.select("node", "root", "many", "label", "v", "area", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return rows.groupBy("area", "i", "j").applyInPandas(lambda f: _linked(f, least), "node long, links long, root long, joined long")


def near_duplicates(vectors: DataFrame, passes: int = PASSES, bits: int = BITS, window: int = WINDOW, least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept.

    Vectors that are null, zero, without a label, or hold null or non-finite components link with nothing, and so do
    those of different lengths. Rows are kept one for one: rows with a repeated vec_id are vectors of their own.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    vectors = noded(vectors)
    nodes = materialize(vectors.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("vec_id").alias("low"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors")
    links = materialize(window_pairs(nodes, passes, bits, window, least).distinct(), "vector-links")
    found = components(links).withColumnRenamed("node", "u")
    members = celled(nodes, least, block).join(found, F.col("node") == F.col("u"), "left").withColumn("root", F.coalesce("root", "node")).drop("u")
    members = materialize(members, "members")
    counted = materialize(exact_links(members, least, block), "exact-links")
    joined = components(counted.where("root <> joined").select(F.col("root").alias("a"), F.col("joined").alias("b")).distinct())
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    members = members.select("node", "root", "low").join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"), "low")
    counted = counted.groupBy("node").agg(F.sum("links").alias("links"))
    smallest = members.groupBy("root").agg(F.min("low").alias("component"))
    linked = members.select("node", "root").join(smallest, "root").join(counted, "node", "left").select("node", "component", "links")
    by_node = nodes.select("node", "many", "low").join(linked, "node", "left").select("node", "many", F.coalesce("component", "low").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = vectors.select("vec_id", "node").join(by_node, "node", "left")  # a null node joins with nothing
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("many") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op5_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
