"""Ten thousand keywords against a plain search, in order."""

import random

from pyspark.sql import functions as F

from ledgerline.operators import categorize, keywords
from ledgerline.operators.keywords import first_keywords, rule_table

r = random.Random(8)
WORDS = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(3000)]
RULES = {w: f"c{i}" for i, w in enumerate([r.choice(WORDS) + r.choice(["", " ", "-"]) + r.choice(WORDS) for _ in range(9000)] + [f"é{i}" for i in range(1000)] + ["zz", "Q", "X Y"])}


def plain(text):
    return next((v for k, v in RULES.items() if k.upper() in text.upper()), None)


def test_many_keywords(spark):
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 5))) for _ in range(300)] + ["", "q", "ZZ TOP", "É77 x", "pay x y", "nothing 123"]
    df = spark.createDataFrame([(t,) for t in texts * 2] + [(None,)], "text string").repartition(3)
    got = {x.text: x.value for x in first_keywords(df, rule_table(spark, RULES)).collect()}
    assert len(RULES) > 9000 and got == {t: v for t in texts if (v := plain(t))} and len(got) > 100
    assert first_keywords(df, rule_table(spark, {})).count() == 0 and first_keywords(df.limit(0), rule_table(spark, RULES)).count() == 0
    assert {x.value for x in first_keywords(df, rule_table(spark, {"": "all"})).collect()} == {"all"}


def test_large_rule_sets_give_what_small_ones_give(spark, monkeypatch):
    rows = [(i, m, t) for i, (m, t) in enumerate([("Kroger", "x"), ("?", "Monthly service fee"), ("?", "an overdraft fee, interest payment"), ("Netflix", "OVERDRAFT FEE"), (None, None), ("?", "INTEREST PAYMENT")])]
    df = spark.createDataFrame(rows, "txn_id int, merchant_norm string, raw_description string")
    said = lambda: {x.txn_id: x.rule_category for x in categorize.rule_category(df).collect()}
    small = said()
    monkeypatch.setattr(categorize, "LITERAL_RULES", 0)
    assert said() == small and categorize.rule_category(df).columns == [*df.columns, "rule_category"] and sum(v is not None for v in small.values()) == 5
    assert df.withColumn("n", F.lit(1)).count() == 6


def test_texts_meet_only_keywords_that_they_hold(spark, monkeypatch):
    """f5_keyword_table: numbers share all their letters, and a text met every keyword that had some three of its own."""
    monkeypatch.setattr(keywords, "BROADCAST_KEYWORDS", 0)
    rules = spark.range(20_000).select(F.col("id").alias("at"), F.format_string("#%d R", "id").alias("keyword"), F.col("id").cast("string").alias("value"))
    rules = rules.union(rules.selectExpr("at + 100000", "keyword", "'later'"))
    texts = spark.range(500).select(F.format_string("paid %d to cust#%d Ref %d", F.col("id") * 31, F.col("id") * 53, F.col("id") * 7919).alias("text"))
    made = first_keywords(texts, rules)
    assert {r.text: r.value for r in made.collect()} == {f"paid {i * 31} to cust#{i * 53} Ref {i * 7919}": str(i * 53) for i in range(500) if i * 53 < 20_000}
    plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "piece" in plan and "contains(" not in plan
