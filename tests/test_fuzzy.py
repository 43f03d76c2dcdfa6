"""Fuzzy names: built-in scores against the plain ones, and the index against all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import fuzzy
from ledgerline.operators.categorize import indel, token_set_score
from ledgerline.schema import MERCHANTS


@given(st.lists(st.tuples(st.text(alphabet="AB C&é-", max_size=30), st.text(alphabet="AB C&é-", max_size=18)), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_scores_are_the_plain_ones(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("i", fuzzy.score(fuzzy.word_set(F.col("a")), fuzzy.word_set(F.col("b"))).alias("s"), fuzzy.longest_common(F.col("a"), F.col("b")).alias("l")).collect():
        a, b = pairs[r.i]
        assert r.s == pytest.approx(token_set_score(a, b)) and len(a) + len(b) - 2 * r.l == indel(a, b), (a, b)


def plain(text, names, least):
    scores = [token_set_score(text, n.upper()) for n in names]
    return names[scores.index(max(scores))] if max(scores) >= least else None


@pytest.mark.parametrize("least", [60.0, 85.0, 95.0])
def test_the_index_loses_no_name(spark, least):
    r = random.Random(int(least))
    texts = {"", "A", "AA", "ZZ", "H&M", "H&N", "HM", "UBER", "UBERR", "LYF"}
    for _ in range(400):
        t = list(r.choice(MERCHANTS).upper())
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(t) + 1)
            t[i : i + r.randint(0, 1)] = r.choice(["", "X", " ", "E"])
        texts.add(" ".join("".join(t).split()) + r.choice(["", "", " 12", " MAIN STREET STORE"]))
    want = {t: m for t in texts if (m := plain(t, MERCHANTS, least))}
    df = spark.createDataFrame([(t,) for t in sorted(texts) * 2] + [(None,)], "text string").repartition(3)
    got = {x.text: x.name for x in fuzzy.best_names(df, MERCHANTS, least).collect()}
    assert got == want and len(got) > 50
    given = df.where("text IS NOT NULL").distinct().withColumn("words", fuzzy.word_set(F.col("text")))
    assert fuzzy.candidates(given, fuzzy.name_table(spark, MERCHANTS), 85.0).count() < 0.2 * len(texts) * len(MERCHANTS)


def test_no_texts_and_long_names(spark):
    assert fuzzy.best_names(spark.createDataFrame([], "text string"), MERCHANTS, 85.0).count() == 0
    with pytest.raises(ValueError, match="60 letters"):
        fuzzy.name_table(spark, ["x" * 61])


def test_no_python_in_the_plan(spark):
    plan = fuzzy.best_names(spark.createDataFrame([("UBR",)], "text string"), MERCHANTS, 85.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
