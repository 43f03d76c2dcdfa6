"""A category model: character n-grams with TF-IDF weights and scaled numbers into a calibrated multinomial regression."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import amount_bucket, clean_descriptor
from ..scratch import written

NUMBERS = ["bucket", "outflow", "weekday", "weekend"]
#: All that the model sees of a row: rows that agree in it are one kind.
KIND = ["raw_description", "merchant_norm", *NUMBERS]
#: Kinds of rows, with their folds and labels, that one task holds, about.
TASK_KINDS = 10_000
#: Terms of a vocabulary at most: as many as there can be.
ALL = (1 << 31) - 1


def ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams of each word between spaces."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(words, lambda w: F.concat(*[of(w, n) for n in range(low, high + 1)])))


def numbers(rows: DataFrame) -> DataFrame:
    day = F.weekday("posted_date")
    return rows.withColumns({"bucket": amount_bucket(F.col("amount")).cast("double"), "outflow": (F.col("amount") < 0).cast("double"), "weekday": day.cast("double"), "weekend": (day >= 5).cast("double")})


def grams_of(kinds: DataFrame) -> DataFrame:
    text = F.trim(F.concat_ws(" ", clean_descriptor(F.col("raw_description")), F.col("merchant_norm")))
    return kinds.withColumn("grams", ngrams(text))


@dataclass
class Fold:
    """A regression fitted without one part of the rows, and its calibration on that part: for each class, a curve as points."""

    pipeline: PipelineModel
    steps: list[list[tuple[float, float]]]


@dataclass
class CategoryModel:
    """Calibrated models of all folds; a row's probabilities are the mean of theirs."""

    folds: list[Fold]
    index: StringIndexerModel

    def save(self, path: str) -> None:
        """Write the model to a folder that load() reads; what stood there goes."""
        self.index.write().overwrite().save(f"{path}/index")
        for i, fold in enumerate(self.folds):
            fold.pipeline.write().overwrite().save(f"{path}/fold{i}")
        points = [(i, c, k, x, y) for i, fold in enumerate(self.folds) for c, curve in enumerate(fold.steps) for k, (x, y) in enumerate(curve)]
        SparkSession.active().createDataFrame(points, "fold int, class int, at int, x double, y double").coalesce(1).write.mode("overwrite").parquet(f"{path}/curves")

    @classmethod
    def load(cls, path: str) -> CategoryModel:
        index = StringIndexerModel.load(f"{path}/index")
        steps: dict[int, list[list[tuple[float, float]]]] = {}
        for r in SparkSession.active().read.parquet(f"{path}/curves").orderBy("fold", "class", "at").collect():  # a few points a class
            steps.setdefault(r["fold"], [[] for _ in index.labels])[r["class"]].append((r["x"], r["y"]))
        return cls([Fold(PipelineModel.load(f"{path}/fold{i}"), steps[i]) for i in sorted(steps)], index)

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with model_category and model_confidence, which are computed once for each kind."""
        k = len(self.index.labels)
        scored = grams_of(numbers(rows).select(*KIND).distinct())
        for i, fold in enumerate(self.folds):
            made = fold.pipeline.transform(scored)
            raw = F.array(*[calibrated(F.get(vector_to_array("probability"), F.lit(c)), fold.steps[c]) for c in range(k)])
            scored = made.select(*scored.columns, _shares(raw, k).alias(f"_p{i}"))
        mean = lambda c: sum((F.get(f"_p{i}", F.lit(c)) for i in range(len(self.folds))), F.lit(0.0)) / len(self.folds)
        scored = scored.withColumn("_p", F.array(*[mean(c) for c in range(k)]))
        top = F.array_max("_p")
        label = F.element_at(F.array(*map(F.lit, self.index.labels)), F.array_position("_p", top).cast("int"))
        said = scored.select(*[F.col(c).alias(f"_{c}") for c in KIND], label.alias("model_category"), top.alias("model_confidence"))
        given = numbers(rows.select(F.struct("*").alias("_row"), "raw_description", "merchant_norm", "amount", "posted_date"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KIND]
        return given.join(said, same).select("_row.*", "model_category", "model_confidence")


def calibrated(p: Column, points: list[tuple[float, float]]) -> Column:
    """The curve through points at p, level beyond its ends."""
    out = F
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(p <= x1, y0 + (y1 - y0) * (F.greatest(p, F.lit(x0)) - x0) / (x1 - x0 or 1.0))
    return F.lit(points[-1][1]) if out is F else out.otherwise(points[-1][1])


def _shares(values: Column, k: int) -> Column:
    """Values over their sum; all alike where the sum is 0."""
    whole = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda v: F.when(whole > 0, v / whole).otherwise(1.0 / k))


def features(kinds: DataFrame) -> list:
    """The stages up to the features, for kinds of which each stands for n rows: grams of two rows or more with their
    inverse document frequencies, and numbers less their means over their deviations."""
    found = kinds.select("n", F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.sum("n").alias("df")).where("df >= 2").orderBy("gram").collect()  # the vocabulary, which the model holds
    rows = kinds.agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in NUMBERS]).first()
    mean = {c: rows[c] / rows["n"] for c in NUMBERS}
    off = kinds.agg(*[F.sum(F.col("n") * (F.col(c) - mean[c]) ** 2).alias(c) for c in NUMBERS]).first()
    scale = {c: math.sqrt((rows["n"] - 1) / off[c]) if off[c] > 0 else 0.0 for c in NUMBERS}
    counts = CountVectorizerModel.from_vocabulary([r["gram"] for r in found], inputCol="grams", outputCol="tf")
    counts.set(counts.vocabSize, ALL)
    scaled = ", ".join(f"({c} - ({mean[c]!r}D)) * {scale[c]!r}D AS scaled_{c}" for c in NUMBERS)
    return [
        counts,
        ElementwiseProduct(inputCol="tf", outputCol="tfidf", scalingVec=Vectors.dense([math.log((rows["n"] + 1) / (r["df"] + 1)) for r in found])), Normalizer(inputCol="tfidf", outputCol="text"),
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), VectorAssembler(inputCols=["text", *[f"scaled_{c}" for c in NUMBERS]], outputCol="features"),
    ]


def fit(rows: DataFrame, label: str = "category", folds: int = 3, max_iter: int = 2000) -> CategoryModel:
    """Classes weigh alike. A regression is fitted for each fold on the other folds, and each class's probability is
    calibrated on the fold that it hasn't seen; predictions are means over the folds. All rows count; those of one kind,
    label and fold are one row with their number as its weight, which gives the same model."""
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    by_class = Window.partitionBy("label")
    k = len(index.labels)
    data = numbers(index.transform(rows)).select("label", *KIND, F.xxhash64("txn_id").alias("hash"))
    data = data.withColumn("fold", F.row_number().over(by_class.orderBy("hash")) % folds).groupBy("label", "fold", *KIND).agg(F.count("*").cast("double").alias("n"))
    data = written(data, "kinds")
    sizes = data.groupBy("label").agg((data.agg(F.sum("n")).first()[0] / (k * F.sum("n"))).alias("class_weight"))
    data = data.join(F.broadcast(sizes), "label")  # a row for each class
    tasks = max(1, -(-data.count() // TASK_KINDS))  # each step of a regression is a job
    made = []
    for fold in range(folds):
        train = grams_of(data.where(F.col("fold") != fold).coalesce(tasks)).withColumn("weight", F.col("class_weight") * F.col("n")).cache()
        regression = LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter, regParam=1e-3, standardization=False)
        model = Pipeline(stages=[*features(train), regression]).fit(train)
        train.unpersist()
        held = model.transform(grams_of(data.where(F.col("fold") == fold).coalesce(tasks))).select("label", "n", vector_to_array("probability").alias("p")).cache()
        steps = []
        for c in range(k):
            curve = IsotonicRegression(featuresCol="x", weightCol="n").fit(held.select(F.get("p", F.lit(c)).alias("x"), (F.col("label") == c).cast("double").alias("label"), "n"))
            steps.append(list(zip(curve.boundaries.toArray().tolist(), curve.predictions.toArray().tolist(), strict=True)))
        held.unpersist()
        made.append(Fold(model, steps))
    return CategoryModel(made, index)


def calibration_error(rows: DataFrame, truth: str = "category", bins: int = 10) -> DataFrame:
    """(n, ece): the expected calibration error, the mean over rows of how far the share of right answers lies from the
    mean confidence in bins of equal width. Rows without a confidence are left out."""
    held = rows.where(F.col("model_confidence").isNotNull()).withColumn("bin", F.least(F.floor(F.col("model_confidence") * bins), F.lit(bins - 1)))
    hit = F.coalesce((F.col("model_category") == F.col(truth)).cast("double"), F.lit(0.0))
    each = held.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.sum(hit) - F.sum("model_confidence")).alias("off"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum("off"), F.sum("n")).alias("ece"))


def grouped_split(rows: DataFrame, share: float = 0.25) -> DataFrame:
    """is_test by merchant, about `share` of each category's merchants; a category's only merchant is for training."""
    m = rows.select("category", "merchant_norm").distinct()
    w = Window.partitionBy("category")
    order = F.row_number().over(w.orderBy(F.md5(F.col("merchant_norm").cast("binary")), "merchant_norm"))
    n = F.count("*").over(w)
    m = m.withColumn("is_test", (n > 1) & (order <= F.least(n - 1, F.greatest(F.lit(1), F.round(n * share)))))
    return rows.join(m, ["category", "merchant_norm"])


def disjoint(rows: DataFrame) -> bool:
    """Whether no merchant stands both in the training and in the test part of a split."""
    return rows.where("is_test").select("merchant_norm").intersect(rows.where("not is_test").select("merchant_norm")).isEmpty()


def majority(rows: DataFrame) -> DataFrame:
    """Test rows with the training part's most frequent category (the first by name on ties) as model_category."""
    counts = rows.where("not is_test").groupBy("category").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "category").limit(1).select(F.col("category").alias("model_category"))
    return rows.where("is_test").crossJoin(F.broadcast(first))  # one row


def word_model(rows: DataFrame, label: str = "category", max_iter: int = 200) -> DataFrame:
    """Test rows with model_category by whole words alone: the baseline of the character n-grams."""
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows.where("not is_test"))
    words = F.filter(F.split(F.lower(clean_descriptor(F.col("raw_description"))), r"\s+"), lambda w: w != "")
    data = index.transform(rows.withColumn("words", words))
    stages = [CountVectorizer(inputCol="words", outputCol="tf", vocabSize=ALL), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=max_iter, regParam=1e-3)]
    said = Pipeline(stages=stages).fit(data.where("not is_test")).transform(data.where("is_test"))
    return said.withColumn("model_category", F.get(F.array(*map(F.lit, index.labels)), F.col("prediction").cast("int"))).select(*rows.columns, "model_category")


def row_split(rows: DataFrame, share: float = 0.25) -> DataFrame:
    """is_test by row: leaky on purpose, since a merchant's rows stand on both sides."""
    return rows.withColumn("is_test", F.pmod(F.xxhash64("txn_id"), F.lit(1000)) < int(1000 * share))


def macro_f1(rows: DataFrame, truth: str, said: str) -> float:
    c = rows.groupBy(F.col(truth).alias("t"), F.col(said).alias("s")).agg(F.count("*").alias("n"))
    hit = c.where("t = s").select(F.col("t").alias("k"), F.col("n").alias("hit"))
    true, made = c.groupBy(F.col("t").alias("k")).agg(F.sum("n").alias("true")), c.groupBy(F.col("s").alias("k")).agg(F.sum("n").alias("made"))
    f = true.join(made, "k", "full").join(hit, "k", "left").fillna(0).select(F.coalesce(2 * F.col("hit") / (F.coalesce("true", F.lit(0)) + F.coalesce("made", F.lit(0))), F.lit(0.0)).alias("f"))
    return f.agg(F.avg("f")).first()[0]


def threshold_curve(rows: DataFrame, truth: str = "category") -> DataFrame:
    """Coverage and precision for seven thresholds of confidence."""
    t = F.explode(F.array(*[F.lit(x / 10) for x in range(3, 10)]))
    kept = F.col("model_confidence") >= F.col("threshold")
    return rows.withColumn("threshold", t).groupBy("threshold").agg(F.avg(kept.cast("int")).alias("coverage"), F.avg(F.when(kept, (F.col("model_category") == F.col(truth)).cast("int"))).alias("precision"))


def pick_threshold(curve: DataFrame, precision: float = 0.9, fallback: float = 0.7) -> float:
    return curve.where(F.col("precision") >= precision).agg(F.min("threshold")).first()[0] or fallback
