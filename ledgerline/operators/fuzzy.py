"""Names that resemble texts by their sets of words: candidates from an index of words and letter pairs, scores by built-in
functions.

The score of a text and a name is from 0 to 100: the best similarity among the words that both have, and these with
either side's other words beside them, where similarity is one less the insertions and deletions over both lengths.
Words are sorted, and repeated words count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written

#: Letters of a name at most: a name is one 64-bit number in longest_common.
NAME_LETTERS = 60
#: Rows of the index that are broadcast, at most; a larger one is joined as any table.
BROADCAST_ROWS = 200_000


def word_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda w: w != "")))


def longest_common(text: Column, name: Column) -> Column:
    """The length of the longest common subsequence. A bit of the state stands for a letter of the name and is cleared
    where one more letter is matched; each letter of the text moves all of them by one addition."""
    size = F.length(name)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    all_bits = bit(size) - 1
    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))

    def where(letter: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, i: a + F.when(F.substring(name, i, F.lit(1)) == letter, bit(i - 1)).otherwise(F.lit(0).cast("long")))

    def step(v: Column, letter: Column) -> Column:
        hit = v.bitwiseAND(where(letter))
        return (v + hit).bitwiseOR(v - hit).bitwiseAND(all_bits)

    left = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), all_bits, step)
    return F.when((size == 0) | (F.length(text) == 0), 0).otherwise(size - F.bit_count(left))


def score(x: Column, y: Column) -> Column:
    """The score of two sorted sets of words; the second is a name's, whose letters are few."""
    join = lambda w: F.array_join(w, " ")
    given = F.struct(
        F.length(join(F.array_intersect(x, y))).alias("shared"), join(F.array_sort(F.array_except(x, y))).alias("left"), join(F.array_sort(F.array_except(y, x))).alias("right")
    )

    def of(g: Column) -> Column:
        shared, left, right = g["shared"], F.length(g["left"]), F.length(g["right"])
        glue = (shared > 0).cast("int")
        full_a, full_b = shared + glue + left, shared + glue + right
        best = 1 - (left + right - 2 * longest_common(g["left"], g["right"])) / (full_a + full_b)
        with_shared = F.greatest(best, 1 - (glue + left) / (shared + full_a), 1 - (glue + right) / (shared + full_b))
        return F.when((shared > 0) & ((left == 0) | (right == 0)), 100.0).otherwise(100 * F.when(shared > 0, with_shared).otherwise(best))

    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.element_at(F.transform(F.array(given), of), 1)).otherwise(0.0)


def _pairs(key: Column) -> Column:
    """The letter pairs of a text, each with how often it came before, so that a set of them counts repeats."""
    at = F.sequence(F.lit(1), F.greatest(F.length(key) - 1, F.lit(1)))
    pairs = F.when(F.length(key) > 1, F.transform(at, lambda i: F.substring(key, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    count = lambda i, p: F.size(F.filter(F.slice(pairs, 1, i + 1), lambda o: o == p))
    return F.transform(pairs, lambda p, i: F.concat(p, count(i, p).cast("string")))


def name_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(no, name, own): names in their order, which breaks ties, and their words."""
    long = [n for n in names if len(n) > NAME_LETTERS]
    if long:
        raise ValueError(f"names have {NAME_LETTERS} letters at most: {long[:3]}")
    table = spark.createDataFrame(list(enumerate(names)), "no int, name string")
    return table.withColumn("own", word_set(F.upper("name")))


def _indexed(rows: DataFrame, words: str, short: float) -> DataFrame:
    """rows exploded into what a text and a name that resemble each other must share: a word, letter pairs, or where both
    are short, a letter."""
    key = F.array_join(words, " ")
    letters = F.when(F.length(key) <= short, F.array_distinct(F.split(key, ""))).otherwise(F.array().cast("array<string>"))
    kinds = {"w": F.col(words), "p": _pairs(key), "l": F.filter(letters, lambda c: c != "")}
    terms = F.concat(*[F.transform(x, lambda t: F.concat(F.lit(k), t)) for k, x in kinds.items()])  # noqa: B023
    return rows.withColumn("letters", F.length(key)).withColumn("term", F.explode(terms))


def candidates(texts: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(text, no) of all pairs that can score `least`. texts: (text, words).

    Texts and names that share a word are candidates. Others are compared as wholes: with s letters together, d <= (1 -
    least) s insertions and deletions leave (s - d) / 2 letters in common, and each of the d breaks one letter pair at
    most beyond that, so (s - d) / 2 - 1 - d pairs are shared at least. Where s is so small that this says nothing, they
    share a letter.
    """
    off = 1 - least / 100
    share = (1 - off) / 2 - off
    short = 1 / share if share > 0 else float("inf")
    index = _indexed(names, "own", short).select("no", F.col("letters").alias("own_letters"), "term")
    index = F.broadcast(index) if names.count() * (3 * NAME_LETTERS) <= BROADCAST_ROWS else index
    of = lambda kind: F.col("term").startswith(kind)
    met = _indexed(texts, "words", short).join(index, "term").groupBy("text", "no").agg(F.bool_or(of("w")).alias("word"), F.count_if(of("p")).alias("pairs"), F.bool_or(of("l")).alias("letter"), F.first(F.col("letters") + F.col("own_letters")).alias("s"))
    enough = (F.col("s") > short) & (F.col("pairs") >= F.col("s") * share - 1 - 1e-9)
    return met.where(F.col("word") | enough | (F.col("letter") & (F.col("s") <= short))).select("text", "no")


def best_names(texts: DataFrame, names: Sequence[str], least: float) -> DataFrame:
    """(text, name) for distinct texts that some name resembles by `least` or more: the best one, the first on ties.

    Empty texts and nulls have none. Texts meet names through shared words and letter pairs, never all with all.
    """
    table = name_table(texts.sparkSession, names)
    given = written(texts.where("text IS NOT NULL").select("text").distinct().withColumn("words", word_set(F.col("text"))), "texts")
    pairs = candidates(given, table, least).join(given, "text").join(F.broadcast(table) if len(names) <= BROADCAST_ROWS else table, "no")
    scored = pairs.withColumn("score", score(F.col("words"), F.col("own"))).where(F.col("score") >= least)
    return scored.groupBy("text").agg(F.max_by("name", F.struct("score", -F.col("no"))).alias("name"))
