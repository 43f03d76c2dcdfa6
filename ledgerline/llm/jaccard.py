"""N-gram Jaccard join by token-combination prefixes.

A text's tokens are its distinct word shingles. Two similar sets of n and m tokens share at least 3/7 (n + m) of them and
differ in at most 1/7 (n + m); everything here follows from these two numbers, and nothing that they allow is left out.

1. Extended prefixes select: of the first slack(n) + reach(n) tokens by hash, a set must share some with other sets, more
   than one the further the prefix is extended. Most texts share too few and are alone; only the others go on.
2. Among those, tokens are ordered by how many sets hold them. A set with more tokens of its own than slack(n) is alone.
3. Rare tokens are indexed singly: those of the prefix. Where the prefix reaches frequent tokens, these are indexed as
   combinations of two neighbours in the order of hashes: each token that two sets don't share breaks one combination at
   most, so that at least 3/2 n - 1 - f of the f - 1 combinations of a set with f frequent tokens are shared, and a prefix
   of the combinations suffices.
4. Each list of the index names a hub, the set with the fewest rare tokens for its size. All members of a hub's lists
   are compared with the hub; only members that this leaves in different groups are compared with each other, where
   parities of hashed tokens (bits that differ are tokens that differ) don't exclude it. So a group of m copies costs m
   comparisons, and no link between groups is lost.

Texts with equal sets are one node from the start. Verification compares whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_steps, giving_back, join_versions, materialize, mix, release, rows_of, shingles, table, versions
from .components import components
from .spans import let

#: Two sets are similar if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Tokens of more sets than this are frequent.
FREQUENT = 8
#: A set's prefix is extended by one token in so many.
EXTEND = 12
#: 64-bit words of parities that a node carries.
WORDS = 8
#: Texts that go on after the first step are broadcast as (doc_id, version) if they are no more than this, 16 MB.
BROADCAST_ROWS = 500_000
#: Members of a hub that one slice of a comparison holds.
SLICE = 2000


def token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Row number in the batch and the sorted distinct shingles of each text."""
    for batch in batches:
        at = 0
        for b in byte_steps([batch], lower=True):
            tokens, to = shingles(b)
            tokens = tokens.view(np.int64)
            for i in range(len(b.ids)):
                yield at + i, np.unique(tokens[to[i] : to[i + 1]])
            at += len(b.ids)


def node_of(tokens: np.ndarray) -> int:
    """One 64-bit number for a set of tokens."""
    total = mix(tokens.view(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def least_overlap(n: int) -> int:
    """Tokens of a set of n that any similar set holds."""
    return -(-PERCENT * n // 100)


def slack(n: int) -> int:
    """Tokens of a set of n that a similar set may lack."""
    return n - least_overlap(n)


def reach(n: int) -> int:
    """Tokens by which the prefix of a set of n is extended."""
    return -(-n // EXTEND)


def shared_at_least(n: int) -> int:
    """Tokens of the extended prefix that a set of n shares with any similar one: both prefixes hold the first shared
    tokens, as many as the shorter extension, and a similar set has least_overlap(n) tokens or more."""
    return reach(least_overlap(n))


def parities(tokens: np.ndarray) -> np.ndarray:
    """WORDS words: a bit tells whether an odd number of tokens falls on it. Bits that differ between two sets are at most
    the tokens that differ."""
    odd = np.bincount((tokens.view(np.uint64) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, version, node, n, prefix): texts with equal sets share a node; n is the size of the set; prefix has its
    first tokens by hash, once a task for each node, and for none that is too small to be like another set."""

    def run(batches):
        seen: set[int] = set()
        for batch in giving_back(batches):
            node, size, prefix = [], [], []
            for _, t in token_sets([batch]):
                k, n = node_of(t), len(t)
                node.append(k)
                size.append(n)
                prefix.append(t[: slack(n) + reach(n)] if n > 2 and k not in seen else t[:0])
                seen.add(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(size, pa.int64()), _lists(prefix)], names=["doc_id", "version", "node", "n", "prefix"])

    return docs.select("doc_id", "text", "version").mapInArrow(run, "doc_id long, version long, node long, n long, prefix array<long>")


def sociable(found: DataFrame) -> DataFrame:
    """Nodes that share enough tokens of their extended prefixes with other nodes: (doc_id, version) of a text of each."""
    entries = found.select("node", F.explode("prefix").alias("token"))
    shared = entries.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token")
    hits = entries.join(shared, "token", "left_semi").distinct().groupBy("node").agg(F.count("*").alias("hits"))
    reps = found.groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "version")).alias("row"))
    least = F.ceil((F.col("n") - F.floor(F.col("n") * (100 - PERCENT) / 100)) / EXTEND)  # shared_at_least(n)
    return hits.join(reps, "node").where(F.col("hits") >= least).select("row.doc_id", "row.version")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, tokens, p0, p1, ...) of the wanted (doc_id, version); repeated rows give repeated ones."""
    words = [f"p{i}" for i in range(WORDS)]

    def run(batches):
        for batch in giving_back(batches):
            sets = [t for _, t in token_sets([batch])]
            parts = np.array([parities(t) for t in sets], dtype=np.int64).reshape(len(sets), WORDS)
            columns = [pa.array([node_of(t) for t in sets], pa.int64()), pa.array([len(t) for t in sets], pa.int64()), _lists(sets), *(pa.array(parts[:, i]) for i in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "tokens", *words])

    rows = join_versions(docs, wanted).select("doc_id", "text")
    return rows.mapInArrow(run, "node long, n long, tokens array<long>, " + ", ".join(f"{w} long" for w in words))


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(node, n, shared): the tokens of each set that others hold too, as (times, token), sorted. Nodes that share too few
    of their tokens to be like any other are left out."""
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    times = tokens.groupBy("token").agg(F.count("*").alias("times"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token", "times")
    by_node = tokens.join(times, "token").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_set(F.struct("times", "token"))).alias("shared"))
    return by_node.where(100 * F.size("shared") >= PERCENT * F.col("n"))


def combinations(frequent: Column) -> Column:
    """Hashes of the pairs of neighbours in the order of hashes, sorted."""
    ordered = lambda f: F.transform(F.sequence(F.lit(0), F.size(f) - 2), lambda i: F.xxhash64(f[i], f[i + 1]))
    return let(F.array_sort(frequent), lambda f: F.when(F.size(f) > 1, F.array_sort(ordered(f))).otherwise(F.array().cast("array<bigint>")))


def index(sharing: DataFrame) -> DataFrame:
    """(key, node, rank): rare tokens of the prefix singly, and combinations of frequent ones where the prefix reaches
    them; rank is smallest for sets with few rare tokens for their size."""
    n, none = F.col("n").cast("int"), F.array().cast("array<bigint>")
    tokens = lambda c: F.transform(c, lambda x: x["token"])
    rare = tokens(F.filter("shared", lambda x: x["times"] <= FREQUENT))
    split = sharing.select("node", n.alias("n"), F.size("shared").alias("m"), rare.alias("rare"), tokens(F.filter("shared", lambda x: x["times"] > FREQUENT)).alias("often"))
    prefix = F.floor(F.col("n") * (100 - PERCENT) / 100).cast("int") + 1  # slack(n) + 1
    alone = F.col("n") - F.col("m")
    rest = F.col("n") - F.size("often")  # rare ones, and those that no other set holds
    singles = F.slice("rare", F.lit(1), F.greatest(F.lit(0), prefix - alone))
    pairs = F.when(rest >= prefix, none).otherwise(combinations(F.col("often")))
    most = 2 * F.size("often") - F.ceil(1.5 * F.col("n")).cast("int") + 1  # (f - 1) - (3/2 n - 1 - f) + 1
    keys = split.select("node", (7 * rest - F.col("n")).alias("rank"), F.concat(singles, let(pairs, lambda c: F.slice(c, F.lit(1), F.greatest(F.lit(0), most)))).alias("keys"))
    return keys.select(F.explode("keys").alias("key"), "node", "rank")


def similar(a: Column, b: Column, na: Column, nb: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= PERCENT * (na + nb - both)


def possible(a: str, b: str) -> Column:
    """What two similar sets meet: tokens that differ are at most 1/7 of both together, and so are parities that do."""
    size = lambda x: F.col(f"{x}.n")
    differ = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{a}.p0").bitwiseXOR(F.col(f"{b}.p0"))))
    return ((100 + PERCENT) * differ <= (100 - PERCENT) * (size(a) + size(b))) & (100 * size(a) >= PERCENT * size(b)) & (100 * size(b) >= PERCENT * size(a))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough."""
    side = sets.select("node", "n", "tokens")
    both = pairs.join(side.toDF("a", "na", "ta"), "a").join(side.toDF("b", "nb", "tb"), "b")
    return both.where(similar(F.col("ta"), F.col("tb"), F.col("na"), F.col("nb"))).select("a", "b").distinct()


def _unordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that connect all that similar pairs connect."""
    wanted = materialize(sociable(found), "sociable")
    if wanted.count() <= BROADCAST_ROWS:  # else the texts are shuffled to meet them
        wanted = F.broadcast(wanted)
    sets = materialize(_sets(docs, wanted), "sets")
    entries = materialize(index(shared_tokens(sets)), "index")
    release(docs.sparkSession)

    hubs = entries.groupBy("key").agg(F.min(F.struct("rank", "node")).alias("hub"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    stars = materialize(entries.join(hubs, "key").select(F.col("hub.node").alias("hub"), "node").distinct(), "stars")
    marks = sets.drop("tokens")
    pairs = stars.where("hub <> node").join(marks.alias("x"), F.col("hub") == F.col("x.node")).join(marks.alias("y"), stars["node"] == F.col("y.node"))
    pairs = pairs.where(possible("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    near = materialize(verified(pairs.select(*_unordered("a", "b")).distinct(), sets), "hub-links")
    roots = materialize(components(near), "roots")

    placed = stars.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("hub", "root").agg(F.count("*").alias("m")).groupBy("hub").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("members"), F.count("*").alias("roots")).where("roots > 1")
    placed = materialize(placed.join(sizes, "hub").join(marks, "node").withColumn("slices", F.ceil(F.col("members") / SLICE).cast("int")), "split-hubs")
    slice_ = F.when(F.col("slices") > 1, F.pmod(F.xxhash64("node"), F.col("slices"))).otherwise(0).cast("int")
    one = placed.where("root <> main").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("x")
    two = placed.withColumn("slice", slice_).alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    rest = one.join(two, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.slice") == F.col("y.slice")) & apart & possible("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    rest = rest.select(*_unordered("a", "b")).distinct()
    far = materialize(verified(rest, sets), "rest-links")
    release(docs.sparkSession, sets, entries, stars, roots, placed)
    return near.union(far)


def grouped(docs: DataFrame) -> DataFrame:
    """Per row of docs, as versions() gives them: doc_id, version, n, and the least (doc_id, version) of its group."""
    found = materialize(nodes(docs), "nodes")
    reps = found.groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")).alias("row"))
    labelled = reps.where("n > 0").join(components(links(docs, found)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("row").alias("least"))
    by_node = labelled.join(smallest, "root").select("node", "least")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")
    return found.join(by_node, "node", "left").select("doc_id", "version", "n", F.coalesce("least", own).alias("least"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, itself included).

    Null and empty texts and those without words have no shingles and link with nothing; texts of fewer than five words
    have one, all of their words. Rows are kept one for one; rows of one doc_id with different texts are texts of their
    own that share an id. A null doc_id links like any other; component_id is null where a group has no other ids. Extra
    columns are dropped.
    """
    return grouped(versions(docs)).select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of docs for each group, one of the smallest doc_id (null only if the group has no other); each text without
    words is a group of its own, repeated rows of one doc_id are not. Columns stay, whatever their names."""
    kept = grouped(versions(docs)).select("least.doc_id", "least.version").distinct()
    return rows_of(docs, kept, "left_semi").dropDuplicates(["doc_id", "version"]).select("row.*")


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))
