"""Personal data by candidate gradient boosting, in SQL functions alone.

Base spans that pass their checks always stay. High-recall generators propose overlapping spans beside them: anything
around an @, addresses with "at" and "dot" in words or brackets, runs of digits with few or with many kinds of separators,
full-width digits, four numbers with bracketed dots. Boosted trees score proposals by format and context. They learn
from disguise: each base span of all documents is rewritten as people do to hide it, and of the proposals around it
only the one with its very edges counts; proposals of plain texts that touch no base span count against, and so do dates, prices and other look-alikes. For each kind a
threshold calibrated on held-out documents selects; of proposals that overlap the best one stays. The fitted trees
become one SQL expression, so scoring is a narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, table
from .spans import EMPTY, joined, let, matches, running, sha256, tagged

# The base patterns of the contract. Possessive quantifiers and the guards at the start only avoid
# backtracking: what follows each can't begin with what it consumes, and a match can begin inside a run of its first
# class only where the one before has ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": "@", "phone": "+"}
WIDE_EMAIL = r"(?:(?<![^\x00-\x20,;:<>()\"|@])|\G)[^\x00-\x20,;:<>()\"|@]++@[^\x00-\x20,;:<>()\"|@]++"
SPOKEN_EMAIL = r"[A-Za-z0-9._%+-]++(?: ?[\[({] ?(?i:at|@) ?[\])}] ?| (?i:at) )[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?i:dot|\.) ?[\])}] ?| (?i:dot) |\.)[A-Za-z0-9-]++)++"
WIDE_NUMBER = r"[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}+"
SPREAD_NUMBER = r"[+(\x{FF0B}\[]{0,2}[0-9\x{FF10}-\x{FF19}](?:[ ()\[\].,_/*\x{2010}-\x{2015}-]{0,3}[0-9\x{FF10}-\x{FF19}]){6,}+"
BRACKETED_IP = r"(?<![0-9])[0-9]{1,3}(?: ?[\[({] ?(?:\.|(?i:dot)) ?[\])}] ?[0-9]{1,3}){3}(?![0-9])"
#: Full-width characters and their plain ones.
WIDE, PLAIN = "".join(chr(0xFF10 + i) for i in range(10)) + "\uff0b", "0123456789+"
#: How people disguise a value: (kind, what becomes of it).
DISGUISES = [
    ("email", lambda v: F.concat(F.substring_index(v, "@", 1), F.lit(" at "), F.replace(F.substring_index(v, "@", -1), F.lit("."), F.lit(" dot ")))),
    ("email", lambda v: F.concat(F.substring_index(v, "@", 1), F.lit("[at]"), F.replace(F.substring_index(v, "@", -1), F.lit("."), F.lit("[dot]")))),
    ("email", lambda v: F.replace(v, F.lit("@"), F.lit(" (at) "))),
    ("ip", lambda v: F.replace(v, F.lit("."), F.lit("[.]"))),
    ("ip", lambda v: F.replace(v, F.lit("."), F.lit(" (dot) "))),
    ("card", lambda v: F.regexp_replace(digits(v), r"(.{4})(?=.)", "$1.")),
    ("card", lambda v: F.regexp_replace(digits(v), r"(.{4})(?=.)", "$1 _ ")),
    ("card", lambda v: F.translate(v, PLAIN, WIDE)),
    ("phone", lambda v: F.replace(v, F.lit("+"), F.lit(""))),
    ("phone", lambda v: F.translate(v, " -", "//")),
    ("phone", lambda v: F.translate(v, PLAIN, WIDE)),
]
#: What merely looks like personal data, from a number: dates, prices, ranges, versions, part numbers.
DECOYS = [
    ("20%02d-%02d-%02d %02d:%02d:%02d", (30, 12, 28, 24, 60, 60)), ("%02d/%02d/20%02d, %02d.%02d", (28, 12, 30, 24, 60)), ("%d,%03d,%03d.%02d", (9, 1000, 1000, 100)), ("%d-%d, %d-%d, %d-%d", (200, 300, 400, 500, 600, 700)),
    ("%d.%d.%d.%d.%d", (20, 20, 20, 20, 20)), ("%d.%d.%d", (20, 20, 2000)), ("%03d-%05d-%d", (1000, 100000, 10)), ("(%d) %d, (%d) %d", (9, 3000, 9, 3000)), ("%d %d %d %d", (1000, 1000, 1000, 1000)), ("%s at %s. ", ("house", "home")),
]
#: Words near a span that speak for a kind.
HINTS = {
    "email": "mail|contact|write|reach",
    "ip": "host|server|addr|client|from|ip",
    "card": "card|visa|credit|pay|account",
    "phone": "tel|phone|call|fax|mobile",
}
KINDS = list(BASE)
FEATURES = [
    "kind", "length", "digits", "letters", "separators", "dots", "plus", "at", "groups", "luhn", "octets", "tail", "left_alnum", "right_alnum", "hint", "other_script", "brackets", "words", "odd_marks",
    "open_end", "wide_digits", "least_group", "most_group",
]

#: The share of the documents that calibrates the thresholds; the trees are fitted from all others.
CALIBRATE = 0.3
#: The least precision, on held-out documents, above a threshold.
PRECISION = 0.99
TREES, DEPTH = 8, 3
#: Rows that one task holds while trees are fitted, about.
FIT_ROWS = 100_000


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""

    def check(d: Column) -> Column:
        n = F.length(d)
        doubled = lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2))
        numbers = F.transform(F.split(F.reverse(d), ""), lambda c, i: doubled(c.cast("int"), i))
        return (n > 0) & (F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0)

    return let(digits(value), check)


def octets(value: Column) -> Column:
    """Whether a value is four numbers of at most 255 between dots."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return value.rlike(rf"^(?:{part}\.){{3}}{part}$")


def bare_ip(value: Column) -> Column:
    """A value with plain dots for bracketed or spoken ones."""
    return F.regexp_replace(value, r" ?[\[({] ?(?:\.|(?i:dot)) ?[\])}] ?", ".")


def passes(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    return {"email": F.lit(True), "ip": octets(value), "card": n.between(14, 19) & luhn(value), "phone": n.between(10, 15)}[kind]


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda m: passes(kind, m["value"]))
    there = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]")
    return tagged(F.when(there, found).otherwise(F.array().cast(EMPTY)), kind, KINDS.index(kind))


def proposals(text: Column) -> Column:
    """Wide spans with what the trees look at: start, rank, end, kind and the FEATURES."""
    none = F.array().cast(EMPTY)
    numbers = text.rlike("[0-9\\x{FF10}-\\x{FF19}]")
    found = F.array_distinct(F.concat(
        F.when(text.contains("@"), matches(text, WIDE_EMAIL)).otherwise(none),
        F.when(text.rlike(r"(?i)[ \[({](?:at|@)[ \])}]"), matches(text, SPOKEN_EMAIL)).otherwise(none),
        F.when(numbers, matches(text, WIDE_NUMBER)).otherwise(none),
        F.when(numbers, matches(text, SPREAD_NUMBER)).otherwise(none),
        F.when(numbers & text.rlike(r"[\[({] ?(?:\.|(?i:dot)) ?[\])}]"), matches(text, BRACKETED_IP)).otherwise(none),
    ))

    def described(m: Column) -> Column:
        said, number = m["value"], lambda c: c.cast("double")
        v = F.translate(said, WIDE, PLAIN)
        count = lambda p: number(F.length(v) - F.length(F.regexp_replace(v, p, "")))
        n = F.length(digits(v))
        kind = F.when(v.rlike("[A-Za-z]{2}|@") & ~v.rlike(r"^[0-9 ().\[\]{}dotDOT]+$"), 0).when(bare_ip(v).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), 1).when(n >= 13, 2).otherwise(3)
        groups = F.transform(F.filter(F.split(v, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
        near = F.lower(F.concat_ws(" ", m["before"], m["after"]))
        hint = F.when(kind == 0, near.rlike(HINTS["email"])).when(kind == 1, near.rlike(HINTS["ip"])).when(kind == 2, near.rlike(HINTS["card"])).otherwise(near.rlike(HINTS["phone"]))
        values = {
            "kind": number(kind), "length": number(F.length(v)), "digits": number(n), "letters": count("[A-Za-z]"), "separators": count("[ ().-]"), "dots": count(r"\."),
            "plus": number(v.startswith("+")), "at": count("@"), "groups": number(F.size(F.split(v, "[^0-9]+"))), "luhn": number(luhn(v)), "octets": number(octets(bare_ip(v))),
            "tail": number(v.rlike(r"\.[A-Za-z]{2,6}$")), "left_alnum": number(m["before"].rlike(r"[\p{L}\p{N}]$")), "right_alnum": number(m["after"].rlike(r"^[\p{L}\p{N}]")),
            "hint": number(hint), "other_script": number(v.rlike(r"[^\x00-\x7F]")), "brackets": count(r"[\[\](){}]"), "words": number(F.size(F.split(F.lower(v), r"\bat\b|\bdot\b")) - 1),
            "odd_marks": count("[,_/*]"), "open_end": number(~v.rlike("[A-Za-z0-9]$")), "wide_digits": number(said != v), "least_group": number(F.coalesce(F.array_min(groups), F.lit(0))), "most_group": number(F.coalesce(F.array_max(groups), F.lit(0))),
        }
        return F.struct(
            m["start"].alias("start"), kind.alias("rank"), m["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), kind + 1).alias("kind_name"),
            *[values[f].alias(f"f_{f}") for f in FEATURES],
        )

    return F.transform(found, described)


def trees_as_sql(model, c: Column) -> Column:
    """The margin of fitted trees over a proposal's features."""
    text = re.sub(r"\n\s*\n", "\n", model.toDebugString)
    margin, weights = F.lit(0.0), model.treeWeights
    for tree, body in enumerate(re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", text)[1:]):
        lines = [x.strip() for x in body.strip().split("\n")]

        def node(at: int, lines=lines) -> tuple[Column, int]:
            if lines[at].startswith("Predict:"):
                return F.lit(float(lines[at].split(":")[1])), at + 1
            feature, bound = re.match(r"If \(feature (\d+) <= ([^)]+)\)", lines[at]).groups()
            low, at = node(at + 1)
            high, at = node(at + 1)  # past the line of Else
            return F.when(c[f"f_{FEATURES[int(feature)]}"] <= float(bound), low).otherwise(high), at

        margin = margin + F.lit(float(weights[tree])) * node(0)[0]
    return margin


def meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def decoys(text: Column, key: Column) -> Column:
    """Each of the DECOYS, with numbers from the key, in the place of each base span of a text."""
    spans = F.concat(*[base_spans(text, k) for k in KINDS])

    def made(m: Column) -> Column:
        some = lambda i, most: F.pmod(F.xxhash64(key, m["start"], F.lit(i)), F.lit(most))
        texts = [F.format_string(form, *[F.lit(v) if isinstance(v, str) else some(10 * d + i, v) for i, v in enumerate(values)]) for d, (form, values) in enumerate(DECOYS)]
        return F.array(*[F.concat(F.lit("so it was "), t, F.lit(" then")) for t in texts])

    return F.flatten(F.transform(spans, made))


def disguised(text: Column) -> Column:
    """Each base span of a text in each disguise of its kind: the snippet, and where in it the span stands."""

    def of(kind: str, change) -> Column:
        found = F.when(text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9]"), F.filter(matches(text, BASE[kind]), lambda m: passes(kind, m["value"]))).otherwise(F.array().cast(EMPTY))

        def snippet(m: Column) -> Column:
            value, start = change(m["value"]), F.length(m["before"]).cast("long")
            return F.struct(F.concat(m["before"], value, m["after"]).alias("text"), start.alias("start"), (start + F.length(value)).alias("end"), F.lit(KINDS.index(kind)).alias("rank"))

        return F.transform(found, snippet)

    return F.concat(*[of(kind, change) for kind, change in DISGUISES])


class PiiModel:
    """Boosted trees and one threshold a kind; without trees, only base spans are selected."""

    def __init__(self, trees=None, thresholds: dict[str, float] | None = None):
        self.trees, self.thresholds = trees, thresholds or {}

    def selected(self, proposed: Column, base: Column) -> Column:
        """Of the proposals that touch no base span those above their kind's threshold; of ones that overlap the best."""
        if self.trees is None or not self.thresholds:
            return F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
        least = lambda c: F.coalesce(*[F.when(c["rank"] == KINDS.index(k), F.lit(t)) for k, t in self.thresholds.items()], F.lit(float("inf")))
        new = F.filter(proposed, lambda c: ~F.exists(base, lambda b: meets(b, c)))
        scored = F.transform(new, lambda c: F.struct((trees_as_sql(self.trees, c) - least(c)).alias("over"), (c["end"] - c["start"]).alias("size"), c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind_name"].alias("kind")))

        def best(above: Column) -> Column:
            kept = F.filter(above, lambda c: ~F.exists(above, lambda o: meets(o, c) & (o > c)))
            return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))

        return let(F.filter(scored, lambda c: c["over"] >= 0), best)


def fit(docs: DataFrame, seed: int = 17) -> PiiModel:
    """Trees fitted on the proposals of all documents, as the module's docstring says. Proposals that agree in all that
    the trees look at are one row with their number as its weight."""
    picked = documents(docs)
    held = (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.lit(1000)) < int(CALIBRATE * 1000)).alias("held")
    spans = F.concat(*[base_spans(F.col("text"), k) for k in KINDS])
    plain = picked.select(held, spans.alias("base"), proposals(F.col("text")).alias("found")).select("held", F.explode(F.filter("found", lambda c: ~F.exists("base", lambda b: meets(b, c)))).alias("c"))
    plain = plain.select(F.lit(0.0).alias("label"), "held", "c.*")
    hidden = picked.select(held, F.explode(disguised(F.col("text"))).alias("s")).select("held", "s", F.explode(proposals(F.col("s.text"))).alias("c")).where(meets(F.col("s"), F.col("c")))
    whole = (F.col("s.rank") == F.col("c.rank")) & (F.abs(F.col("s.start") - F.col("c.start")) <= 1) & (F.col("s.end") == F.col("c.end"))
    alike = picked.select(held, F.explode(decoys(F.col("text"), F.col("doc_id"))).alias("s")).select("held", F.explode(proposals(F.col("s"))).alias("c"))
    plain = plain.unionByName(alike.select(F.lit(0.0).alias("label"), "held", "c.*"))
    rows = plain.unionByName(hidden.select(whole.cast("double").alias("label"), "held", "c.*"))
    rows = rows.groupBy("label", "held", *[f"f_{f}" for f in FEATURES]).agg(F.count("*").cast("double").alias("n"))
    rows = materialize(rows.withColumn("kind_rank", F.col("f_kind").cast("int")), "pii-fit")
    data = VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="features").transform(rows)
    train = data.where(~F.col("held")).coalesce(max(4, rows.count() // FIT_ROWS))
    if train.select("label").distinct().count() < 2:
        return PiiModel()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, maxBins=32, weightCol="n").fit(train)
    margin = trees_as_sql(trees, F.struct(*[F.col(f"f_{f}") for f in FEATURES]))
    levels = (
        rows.where("held").select("kind_rank", F.round(margin, 3).alias("m"), "label", "n").groupBy("kind_rank", "m").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    )  # a row for each leaf combination: bounded by the trees, not by the documents
    thresholds = {}
    for k, kind in enumerate(KINDS):
        good = n = 0.0
        for row in sorted((r for r in levels if r["kind_rank"] == k), key=lambda r: -r["m"]):
            good, n = good + row["good"], n + row["n"]
            if good / n >= PRECISION:
                thresholds[kind] = row["m"] - 0.0005
    return PiiModel(trees, thresholds)


def find(docs: DataFrame, model: PiiModel) -> DataFrame:
    """Per document: doc_id, text, base and spans, both arrays of (start, rank, end, kind) in order.

    Null texts count as empty and have no spans. Rows are kept one for one, repeated doc_ids and texts too; other
    columns are dropped. Base spans of different kinds may overlap, and so may added ones.
    """
    with_base = documents(docs).select("doc_id", "text", *[base_spans(F.col("text"), k).alias(f"base_{k}") for k in KINDS], proposals(F.col("text")).alias("proposed"))
    base = F.concat(*[F.col(f"base_{k}") for k in KINDS])
    return with_base.select("doc_id", "text", *[f"base_{k}" for k in KINDS], base.alias("base"), F.array_sort(F.array_distinct(F.concat(base, model.selected(F.col("proposed"), base)))).alias("spans"))


def merged(spans: Column) -> Column:
    """Spans in order with overlapping ones made one, which keeps the first one's kind."""

    def cut(ends: Column) -> Column:
        new = lambda s, i: (i == 0) | (s["start"] >= F.coalesce(F.get(ends, i - 1), F.lit(0)))
        marked = F.transform(spans, lambda s, i: F.struct(i.alias("at"), s["start"].alias("start"), s["kind"].alias("kind"), new(s, i).alias("new")))
        last = lambda f, i: F.get(ends, F.coalesce(F.get(f, i + 1)["at"], F.size(spans)) - 1)
        return let(F.filter(marked, lambda s: s["new"]), lambda f: F.transform(f, lambda s, i: F.struct(s["start"].alias("start"), last(f, i).alias("end"), s["kind"].alias("kind"))))

    return let(running(F.transform(spans, lambda s: s["end"]), F.array_max, F.greatest), cut)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""

    def put(m: Column) -> Column:
        kept = F.transform(
            m, lambda s, i: F.concat(let(F.when(i == 0, F.lit(0).cast("long")).otherwise(m[i - 1]["end"]), lambda at: F.substring(text, (at + 1).cast("int"), (s["start"] - at).cast("int"))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        )
        return F.concat(F.array_join(kept, ""), F.substring(text, (F.element_at(m, -1)["end"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(merged(spans), put))


def redact(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """docs with personal data in text replaced; columns and rows stay, null texts stay null."""
    model = model or fit(docs)
    spans = F.concat(*[base_spans(F.col("text"), k) for k in KINDS])
    found = lambda base: F.array_sort(F.array_distinct(F.concat(base, model.selected(proposals(F.col("text")), base))))
    text = F.when(F.col("text").isNotNull(), let(spans, lambda base: let(found(base), lambda s: redacted(F.col("text"), s))))
    return docs.withColumn("text", text)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = find(docs, fit(docs))
    return out.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], sha256(joined(F.col("base"))).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
