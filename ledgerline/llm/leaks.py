"""Benchmark decontamination by SimHash over item-sized windows, in SQL functions alone.

For each item of T shingles, windows of T shingles slide over every text. Windows and items get 64-bit SimHash
fingerprints; a multi-index over RADIUS + 1 blocks of bits finds every pair within RADIUS bits (two fingerprints that
differ in at most RADIUS bits agree on a whole block), and exact weighted similarity of the shingles - shared
occurrences over all - verifies it. A window that holds too few shingles of items of its size to be similar to any can't
be a result, so only the others are fingerprinted: that loses nothing and spares a fingerprint for every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows_of, table, versions
from .spans import let

SHINGLE = 5
#: Least similarity in percent.
PERCENT = 75
#: Bits in which fingerprints of a pair may differ. At a similarity of 0.75 the mean is 11 and the deviation 3.
RADIUS = 23
#: Distinct item shingles that are broadcast, at most; more are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles of a text in order; of a shorter text, one of all its words; none without words."""

    def made(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(SHINGLE))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) <= SHINGLE, F.array(F.xxhash64(w))).otherwise(each)

    return let(F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != ""), made)


def _need(window: Column, size: Column) -> Column:
    """Shared shingles without which a window isn't similar to an item: s / (window + size - s) >= PERCENT / 100."""
    return F.ceil((window + size) * PERCENT / (100.0 + PERCENT) - 1e-9).cast("int")


def fingerprint() -> Column:
    """The SimHash of the shingles `h` of a group."""
    bits = [F.when(F.sum(F.shiftright(F.col("h"), b).bitwiseAND(F.lit(1)) * 2 - 1) > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    out = bits[0].cast("bigint")
    for b in bits[1:]:
        out = out.bitwiseOR(b.cast("bigint"))
    return out


def blocks(print_: Column, radius: int) -> Column:
    """(block, value) of a fingerprint: radius + 1 blocks that cover its 64 bits."""
    edges = [i * 64 // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    )


def weighted_similarity(a: Column, b: Column) -> Column:
    """Shared occurrences over all occurrences of two arrays of shingles."""
    times = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.array_intersect(a, b)
    shared = F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h))))
    return shared / (F.size(a) + F.size(b) - shared)


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, version, item_id, similarity, first_shingle): the most similar window of each document and item that
    have one of at least PERCENT; version is xxhash64 of the text, which tells rows of one doc_id apart.

    Null and empty texts and items match nothing; of fewer than five words all are one shingle, so such an item matches
    only a text of exactly its words. A text shorter than an item is one window. Repeated rows give one result, repeated
    items one each; a null doc_id or item_id is one like any other; other columns are dropped.
    """
    row = ["id", "no_id", "version"]  # ids without nulls, which joins would lose
    docs = versions(docs).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "version", "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), shingles(F.coalesce(F.col("text"), F.lit(""))).alias("item")).where(F.size("item") > 0)
    items = items.groupBy("item").agg(F.collect_set(F.struct("item_id")).alias("item_ids")).select(F.xxhash64("item").alias("item_key"), "item", "item_ids", F.size("item").alias("size"))
    items = materialize(items, "items")
    wanted = items.select("size", F.explode("item").alias("h")).groupBy("h").agg(F.collect_set("size").alias("sizes"))
    if wanted.count() <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)

    hits = docs.select(*row, shingles(F.col("text")).alias("all")).select(*row, F.size("all").alias("n"), F.posexplode("all").alias("at", "h"))
    hits = hits.join(wanted, "h").select(*row, "n", "at", F.explode("sizes").alias("size"))
    places = hits.groupBy(*row, "n", "size").agg(F.array_sort(F.collect_set("at")).alias("at"))  # a text's own
    need = _need(F.least("n", "size"), F.col("size"))
    dense = F.filter(F.transform("at", lambda p, i: F.when(F.get("at", i + need - 1) < p + F.col("size"), F.least(p, F.greatest(F.col("n") - F.col("size"), F.lit(0))))), lambda s: s.isNotNull())
    dense = places.select(*row, "size", F.array_distinct(dense).alias("starts")).where(F.size("starts") > 0)
    dense = materialize(dense.groupBy(*row).agg(F.collect_list(F.struct("size", "starts")).alias("wanted")), "windows")

    held = docs.join(dense, row).dropDuplicates(row)
    held = held.select(*row, shingles(F.col("text")).alias("all"), F.explode("wanted").alias("w")).select(*row, "all", "w.size", F.explode("w.starts").alias("start"))
    windows = materialize(held.select(*row, "size", "start", F.slice("all", F.col("start") + 1, F.col("size")).alias("window")), "window-shingles")

    key = [*row, "size", "start"]
    of_window = windows.select(*key, F.explode("window").alias("h")).groupBy(*key).agg(fingerprint().alias("print")).select(*key, "print", F.explode(blocks(F.col("print"), radius)).alias("b"))
    of_item = items.select("item_key", "size", F.explode("item").alias("h")).groupBy("item_key", "size").agg(fingerprint().alias("item_print"))
    of_item = of_item.select("item_key", "size", "item_print", F.explode(blocks(F.col("item_print"), radius)).alias("b")).select("item_key", "size", "item_print", "b.block", "b.value")
    pairs = of_window.select(*key, "print", "b.block", "b.value").join(of_item, ["size", "block", "value"])
    pairs = pairs.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).select(*key, "item_key").distinct()
    pairs = materialize(pairs, "leak-pairs")  # fingerprints make large plans, which Spark plans anew after each of their stages

    checked = pairs.join(windows, key).join(items.drop("size"), "item_key").select(*key, "item_key", "item_ids", weighted_similarity(F.col("window"), F.col("item")).alias("similarity"))
    best = F.max_by(F.struct("similarity", "start"), F.struct("similarity", -F.col("start")))
    found = checked.where(F.col("similarity") * 100 >= PERCENT - 1e-9).groupBy(*row, "item_key").agg(best.alias("best"), F.first("item_ids").alias("item_ids"))
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "version", F.explode("item_ids.item_id").alias("item_id"), "best.similarity", F.col("best.start").alias("first_shingle"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a passage of the benchmark; all columns stay, whatever their names."""
    bad = materialize(leaks(docs, benchmark).select("doc_id", "version").distinct(), "leaking")
    return rows_of(docs, bad, "left_anti").select("row.*")


def op2_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")
