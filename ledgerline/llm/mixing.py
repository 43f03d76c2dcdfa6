"""Mixing sources to target weights by thresholds of a hash.

A document's size is its number of words. Budgets in words are split among the sources by weight, none getting more than
`cap` times what it has; what exceeds that is shared again by weight. A source whose target is n times its size gives
each document n times, and one more time those whose hash is below a threshold. The threshold is found from histograms:
words by source and hash bucket, then, inside the one bucket where the budget ends, words by the next bits of the hash,
until one row is left, which is taken if that comes nearer. Larger budgets have higher thresholds, so a mix holds every
smaller one. Nothing is sorted by document.

The hash is one of the id and the size; rows that agree in both differ by a number of their row, which only decides
which of several equal rows is taken, so reruns give the same rows. Null texts and texts without words have size 0, and
nothing of them is taken. A null source is a source, the last one; a null id is hashed as an empty one. Repeated rows
are documents of their own. Sources that are empty have target 0; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, release, table

WEIGHTS = (5, 2, 1)
CAP = 3
SHARE = 100
#: Bits of the hash that one histogram tells apart, and levels of each of the two hashes (60 bits, 60 bits and a rest).
BITS = 10
LEVELS = 6
#: Sources (times shares) that are broadcast, at most; more are joined as any table.
BROADCAST_ROWS = 10_000


def words(text: Column) -> Column:
    """The number of runs of anything but space and 0x09 to 0x0D: each becomes one letter, and the gaps nothing."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, row) of every document, written once: the text is read here and nowhere else."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    h = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")
    return materialize(rows.withColumns({"h": h, "row": F.monotonically_increasing_id()}), "sizes")


def targets(sized: DataFrame, shares: tuple[float, ...] = (SHARE,), weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(share, no, source, source_size, target): each source's words in a mix of `share` hundredths of all words."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = numbered(by, [F.asc_nulls_last("source")], "sources", "no")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("no") - 1) % len(weights) + 1).cast("int")).cast("double")
    rows = by.withColumns({"weight": weight, "share": F.explode(F.array(*[F.lit(float(s)) for s in shares])), "full": F.lit(False)})
    written = []
    while True:  # each round at least one more source of a mix is full; with weights alike a few rounds do
        left = rows.groupBy("share").agg(
            (F.sum("source_size") * F.col("share") / 100 - F.sum(F.when(F.col("full"), cap * F.col("source_size")).otherwise(0))).alias("rest"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open")
        )
        rows = materialize(rows.join(F.broadcast(left), "share").withColumn("fair", F.col("rest") * F.col("weight") / F.col("open")), "targets")  # a row for each share
        written.append(rows)
        over = ~F.col("full") & (F.col("fair") > cap * F.col("source_size"))
        if rows.where(over).isEmpty():
            break
        rows = rows.withColumn("full", F.col("full") | over).drop("rest", "open", "fair")
    target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(F.greatest(F.coalesce("fair", F.lit(0.0)), F.lit(0.0)))
    out = materialize(rows.select("share", "no", "source", "source_size", target.alias("target")), "targets")
    release(sized.sparkSession, *written)
    return out


def _bucket(level: int) -> Column:
    """The bits of the hash, then of the row's number, that the given level tells apart."""
    column, at = ("h", level) if level < LEVELS else ("row", level - LEVELS)
    higher = F.shiftright(F.col(column), BITS * (LEVELS - 1 - at))
    return higher if at == 0 else higher.bitwiseAND(F.lit((1 << BITS) - 1))  # no number is negative


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (share, source, source_size, target, ...) with `times`, and `h`, `row` and `take`: rows below (h, row) are
    taken once more, the row at it if `take`. Where nothing more is taken, h is -1."""
    key, edges = ["share", "no"], []
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("times", whole.cast("long")).withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    names = goals.where("need > 0").select(*key, "source", "need")
    names = F.broadcast(names) if goals.count() <= BROADCAST_ROWS else names
    found, open_ = None, None
    first = sized.groupBy("source", _bucket(0).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    hist = first.withColumnRenamed("source", "_source").join(names, F.col("_source").eqNullSafe(F.col("source"))).drop("_source").withColumn("below", F.lit(0).cast("long"))
    for level in range(2 * LEVELS):
        run = Window.partitionBy(*key).orderBy("bucket")
        hist = hist.withColumn("to", F.col("below") + F.sum("n").over(run)).withColumn("from", F.col("to") - F.col("n"))
        edge = hist.where((F.col("from") <= F.col("need")) & (F.col("to") > F.col("need"))).select(*key, "source", "need", F.col("bucket").alias("_bucket"), F.col("from").alias("below"), "rows")
        edge = materialize(edge, "edges")
        edges.append(edge)
        at = [F.col("_source").eqNullSafe(F.col("source")), _bucket(level) == F.col("_bucket")]
        if open_ is None:
            rows = sized.select(F.col("source").alias("_source"), "size", "h", "row").join(edge, at).drop("_source", "_bucket")
        else:
            rows = open_.join(edge.withColumnsRenamed({"share": "_share", "no": "_no"}).drop("source", "need"), (F.col("share") == F.col("_share")) & (F.col("no") == F.col("_no")) & at[1]).drop("_share", "_no", "_bucket")
        rows = materialize(rows, "edge_rows")
        edges.append(rows)
        lone = rows.where("rows = 1").select(*key, "h", "row", (F.col("below") + F.col("size") - F.col("need") < F.col("need") - F.col("below")).alias("take"))
        found = lone if found is None else found.unionByName(lone)
        open_ = rows.where("rows > 1").drop("rows")
        if open_.isEmpty():
            break
        hist = open_.groupBy(*key, "source", "need", "below", _bucket(level + 1).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        open_ = open_.drop("below")
    out = goals.join(found, key, "left")
    out = materialize(out.withColumns({"h": F.coalesce("h", F.lit(-1)), "row": F.coalesce("row", F.lit(-1)), "take": F.coalesce("take", F.lit(False))}), "thresholds")
    release(sized.sparkSession, *edges)
    return out


def mix(docs: DataFrame, shares: tuple[float, ...] = (SHARE,), weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each document and share: doc_id, share, size, source, source_size, target (its source's) and taken (its
    words in the mix, repeats counted, at most `cap` times its size). docs has doc_id, text and source."""
    sized = sizes(docs)
    limits = thresholds(sized, targets(sized, shares, weights, cap))
    limits = limits.select("share", F.col("source").alias("_source"), "source_size", "target", "times", F.col("h").alias("_h"), F.col("row").alias("_row"), "take")
    same = (F.col("h") == F.col("_h")) & (F.col("row") == F.col("_row"))
    below = (F.col("h") < F.col("_h")) | ((F.col("h") == F.col("_h")) & (F.col("row") < F.col("_row")))
    out = sized.join(limits, F.col("source").eqNullSafe(F.col("_source")))
    once_more = (below | (same & F.col("take"))).cast("long")
    return out.select("doc_id", "share", "size", "source", "source_size", "target", (F.col("size") * (F.col("times") + once_more)).alias("taken"))


def op13_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_sql(rounds: int = 8) -> str:
    """The same rows for DuckDB, which orders all documents of a source; sources are filled in at most `rounds` rounds."""
    pattern = "[^\\x20\\x09-\\x0D]+"
    out = f"""WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{pattern}')) AS BIGINT) AS size FROM documents),
hashed AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 15) AS BIGINT) AS h FROM sized),
r0 AS (SELECT source, source_size, CAST([{', '.join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS DOUBLE) AS weight, false AS at_cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1))"""
    fair = f"(sum(source_size) OVER () * {float(SHARE)}::DOUBLE / 100 - sum(CASE WHEN at_cap THEN {CAP} * source_size ELSE 0 END) OVER ()) * weight / sum(CASE WHEN NOT at_cap THEN weight END) OVER ()"
    for i in range(rounds):
        out += f", r{i + 1} AS (SELECT source, source_size, weight, at_cap OR coalesce(fair > {CAP} * source_size, false) AS at_cap FROM (SELECT *, {fair} AS fair FROM r{i}))"
    return out + f""", goals AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM
  (SELECT source, source_size, CASE WHEN at_cap THEN CAST({CAP} * source_size AS DOUBLE) ELSE greatest(coalesce(fair, 0), 0.0::DOUBLE) END AS target FROM (SELECT *, {fair} AS fair FROM r{rounds}))),
run AS (SELECT doc_id, size, source_size, target, times, target - times * source_size AS need, sum(size) OVER (PARTITION BY hashed.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM hashed JOIN goals ON hashed.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN need <= 0 THEN 0 WHEN upto <= need THEN 1 WHEN upto - size <= need AND upto - need < need - (upto - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM run"""
