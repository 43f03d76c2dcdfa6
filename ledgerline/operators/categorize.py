"""Merchants and categories: corrections, then rules, then a model, then the fallback."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_descriptor, domain_alias, keyword_category, subset_alias
from ..schema import FALLBACK, INTERNAL_TRANSFER, KEYWORD_RULES, MERCHANT_RULES, MERCHANTS
from ..scratch import written
from .fuzzy import best_names
from .keywords import first_keywords, rule_table

ALIAS_SCORE = 85.0
#: Rules that become expressions of the plan, at most.
LITERAL_RULES = 64


@dataclass(frozen=True)
class Rules:
    """Categories by exact merchant, then by the first keyword that a description holds."""

    merchants: dict[str, str] = field(default_factory=lambda: dict(MERCHANT_RULES))
    keywords: dict[str, str] = field(default_factory=lambda: dict(KEYWORD_RULES))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Rules:
        """Rules from a JSON file {"merchants": {name: category}, "keywords": {word: category}}: a table that people keep
        by hand, so it is read on the driver and becomes literals of the plan."""
        import json

        said = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
        return cls(dict(said.get("merchants", {})), dict(said.get("keywords", {})))


def indel(a: str, b: str) -> int:
    """Insertions and deletions between two texts: their lengths less twice the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def token_set_score(a: str, b: str) -> float:
    """0 to 100: the best similarity among the shared words and either text's words beside them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 100.0
    glue = 1 if shared else 0
    full_a, full_b = len(shared) + glue + len(left), len(shared) + glue + len(right)
    best = 1 - indel(left, right) / (full_a + full_b)
    if shared:
        best = max(best, 1 - (glue + len(left)) / (len(shared) + full_a), 1 - (glue + len(right)) / (len(shared) + full_b))
    return 100 * best


def fuzzy_merchants(texts: DataFrame, least: float = ALIAS_SCORE) -> DataFrame:
    """(cleaned, merchant) for distinct texts: the best canonical name that scores enough, the first on ties."""
    return best_names(texts.select(F.col("cleaned").alias("text")), MERCHANTS, least).toDF("cleaned", "merchant")


def normalized(ledger: DataFrame) -> DataFrame:
    """merchant_norm for every row. Scoring runs over the distinct texts that neither an alias nor whole words settle."""
    names = written(quick_names(ledger), "names")  # read three times, and dear to make
    slow = fuzzy_merchants(names.where(F.col("quick").isNull() & (F.col("cleaned") != "")))
    names = names.join(slow, "cleaned", "left").select("raw_description", F.coalesce("quick", "merchant", "cleaned").alias("merchant_norm"))
    return ledger.join(names, "raw_description", "left").select(*ledger.columns, "merchant_norm")


def quick_names(ledger: DataFrame) -> DataFrame:
    """(raw_description, cleaned, quick) of distinct descriptions: banks print a merchant's again and again, so cleaning
    and aliases run once for each. quick is null where neither an alias nor whole words settle the merchant."""
    texts = ledger.where(F.col("raw_description").isNotNull()).select("raw_description").distinct()
    texts = texts.withColumn("cleaned", clean_descriptor(F.col("raw_description")))
    return texts.withColumn("quick", F.coalesce(domain_alias(F.col("raw_description")), subset_alias(F.col("cleaned"))))


def rule_category(ledger: DataFrame, rules: Rules | None = None) -> DataFrame:
    """rule_category by exact merchant, else by the first keyword. A few rules become expressions; larger sets are tables
    that distinct merchants and descriptions are joined with."""
    rules = rules or Rules()
    if len(rules.merchants) + len(rules.keywords) <= LITERAL_RULES:
        by_name = F.create_map(*[F.lit(x) for pair in rules.merchants.items() for x in pair]) if rules.merchants else F.lit(None).cast("map<string,string>")
        return ledger.withColumn("rule_category", F.coalesce(by_name[F.col("merchant_norm")], keyword_category(F.col("raw_description"), rules.keywords)))
    names = ledger.sparkSession.createDataFrame(list(rules.merchants.items()), "merchant_norm string, _by_name string")
    words = first_keywords(ledger.select(F.col("raw_description").alias("text")), rule_table(ledger.sparkSession, rules.keywords)).toDF("raw_description", "_by_word")
    both = ledger.join(names, "merchant_norm", "left").join(words, "raw_description", "left")
    return both.select(*[F.col(c) for c in ledger.columns], F.coalesce("_by_name", "_by_word").alias("rule_category"))


def categorized(ledger: DataFrame, corrections: DataFrame | None = None, predictions: DataFrame | None = None, transfers: DataFrame | None = None, least: float = 0.6, rules: Rules | None = None) -> DataFrame:
    """category, category_source and category_confidence. corrections: (merchant_norm, user_category); predictions:
    (txn_id, model_category, model_confidence); transfers: (txn_id)."""
    out = rule_category(ledger, rules)
    out = out.join(corrections, "merchant_norm", "left") if corrections is not None else out.withColumn("user_category", F.lit(None).cast("string"))
    out = out.join(predictions, "txn_id", "left") if predictions is not None else out.withColumns({"model_category": F.lit(None).cast("string"), "model_confidence": F.lit(None).cast("double")})
    out = out.join(transfers.withColumn("is_transfer", F.lit(True)), "txn_id", "left") if transfers is not None else out.withColumn("is_transfer", F.lit(None).cast("boolean"))
    moved, user, rule = F.coalesce("is_transfer", F.lit(False)), F.col("user_category").isNotNull(), F.col("rule_category").isNotNull()
    model = F.col("model_category").isNotNull()
    sure = F.col("model_confidence") >= least
    out = out.withColumn("category", F.when(moved, INTERNAL_TRANSFER).when(user, F.col("user_category")).when(rule, F.col("rule_category")).when(model & sure, F.col("model_category")).otherwise(FALLBACK))
    out = out.withColumn("category_source", F.when(moved, "rule").when(user, "user").when(rule, "rule").when(model, "model"))
    out = out.withColumn("category_confidence", F.when(moved | user | rule, 1.0).otherwise(F.coalesce("model_confidence", F.lit(0.0))))
    return out.drop("rule_category", "user_category", "model_category", "model_confidence", "is_transfer")
