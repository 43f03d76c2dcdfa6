"""Secret scans by a trigram inverted index, in SQL functions alone.

Each rule's regular expression gives a Boolean query: trigrams that every match must hold. Postings (trigram, document)
are kept for the trigrams that the rules ask for; where all postings of one of a rule's sets of trigrams meet, a document
could match, and only such documents are verified with the expression itself. Rules without mandatory trigrams scan every
text.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_versions, table, versions
from .spans import EMPTY, joined, matches, sha256, tagged


@dataclass(frozen=True)
class Rule:
    """A regular expression; `least` is the shortest value (or group, where one is given) that counts."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False


# The base rules of the contract. Quantifiers are possessive where what follows can't begin with what
# they consume. Runs shorter than the least length of `access` and `hex` can't hold a longer match, so the length is
# part of the expression there.
BASE = (
    Rule("assign", r"(?:password|passwd|secret|token|api_?key)[\"']?+ *+[:=] *+[\"']?+([A-Za-z0-9+/_.=-]++)", 12, 1, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}+", 18),
    Rule("hex", r"[0-9a-f]{16,}+", 16),
)
#: Further rules, by public documentation of the formats.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("url_login", r"://[A-Za-z0-9._-]++:[^ \t\r\n/@:]{8,}+@"),
    Rule("upper_hex", r"[0-9A-F]{32,}+"),
)
RULES = BASE + ADDED

Query = tuple[frozenset[str], ...]  # any of these sets, all trigrams of one


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(parsed, limit: int = 16) -> list[tuple[str, ...]]:
    """For each longest stretch of a parsed expression with few possible texts, those texts."""
    import re._constants as c

    stretches: list[tuple[str, ...]] = []
    now: tuple[str, ...] = ("",)

    def close() -> None:
        nonlocal now
        stretches.append(now)
        now = ("",)

    for op, arg in parsed:
        if op is c.LITERAL:
            more: tuple[str, ...] | None = (chr(arg),)
        elif op is c.IN and all(x[0] is c.LITERAL for x in arg):
            more = tuple(chr(x[1]) for x in arg)
        elif op is c.SUBPATTERN and len(inner := _strings(arg[-1], limit)) == 1:
            more = inner[0]
        elif op is c.BRANCH and all(len(_strings(x, limit)) == 1 for x in arg[1]):
            more = tuple(t for x in arg[1] for t in _strings(x, limit)[0])
        elif op in (c.MAX_REPEAT, c.POSSESSIVE_REPEAT, c.MIN_REPEAT) and arg[:2] == (0, 1) and len(inner := _strings(arg[2], limit)) == 1:
            more = ("", *inner[0])
        else:
            more = None
        if more is None or len(now) * len(more) > limit:
            close()
            now = ("",) if more is None else more if len(more) <= limit else ("",)
            if more is None:
                close()
        else:
            now = tuple(a + b for a in now for b in more)
    close()
    return [s for s in stretches if s != ("",)] or [("",)]


@functools.cache
def trigram_query(rule: Rule) -> Query | None:
    """The trigrams (in lower case) of the stretch that asks for most; None if a match needs none."""
    import re._parser

    best: Query | None = None
    for texts in _strings(re._parser.parse(rule.pattern)):
        sets = tuple(trigrams(t.lower()) for t in texts)
        if all(sets) and (best is None or min(map(len, sets)) > min(map(len, best))):
            best = sets
    return best


def asked(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """All trigrams that the rules' queries name."""
    return sorted({t for r in rules for s in trigram_query(r) or () for t in s})


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id, version): which texts hold which of the trigrams that rules ask for, in any case."""
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in asked(rules)]))
    return docs.select("doc_id", "version", F.lower("text").alias("low")).select("doc_id", "version", F.explode(held).alias("trigram"))


def terms(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, kind, choice, need): the sets of the rules' queries; each is a choice of `need` trigrams."""
    rows = [(t, r.kind, i, len(s)) for r in rules for i, s in enumerate(trigram_query(r) or ()) for t in sorted(s)]
    made = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("trigram", "kind", "choice", "need"), row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, version, kinds): the rules of which a text's postings hold one set whole.

    Postings of a set meet by text: they are combined before the shuffle, so that neither a trigram of all documents nor
    a document of all trigrams weighs on one task.
    """
    key = ["doc_id", "version", "kind", "choice", "need"]
    met = postings.join(F.broadcast(terms(postings.sparkSession, rules)), "trigram").groupBy(*key).agg(F.collect_set("trigram").alias("trigrams"))
    return met.where(F.size("trigrams") == F.col("need")).groupBy("doc_id", "version").agg(F.collect_set("kind").alias("kinds"))


def verified(text: Column, rule: Rule) -> Column:
    pattern = f"(?i){rule.pattern}" if rule.any_case else rule.pattern
    size = (lambda m: F.length(F.regexp_extract(m["value"], pattern, rule.group))) if rule.group else (lambda m: F.length(m["value"]))
    return F.filter(matches(text, pattern), lambda m: size(m) >= rule.least)


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, text and one array of (start, rank, end, kind) a rule, named by its kind.

    Null texts count as empty and have no spans. Rows are kept one for one, repeated and null doc_ids too; rows of equal
    ids and texts share their postings. Other columns are dropped.
    """
    docs = versions(docs)
    found = join_versions(docs, candidates(index(docs, rules), rules), "left") if asked(rules) else docs.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast(EMPTY)
    spans = []
    for rank, rule in enumerate(rules):
        hits = verified(F.col("text"), rule)
        if trigram_query(rule):
            hits = F.when(F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)), hits).otherwise(none)
        spans.append(tagged(hits, rule.kind, rank).alias(rule.kind))
    return found.select("doc_id", "text", *spans)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    base, everything = F.concat(*[r.kind for r in BASE]), F.concat(*[r.kind for r in RULES])
    return out.select(
        "doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE], sha256(joined(base)).alias("base_sha256"), joined(everything).alias("spans")
    )
