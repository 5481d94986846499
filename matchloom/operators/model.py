"""Pair classifiers: logistic regression and boosted trees of Spark ML, kept with their threshold and flags."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for a missing feature in trees.
ABSENT = -1.0


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 where truth(s1_id, target_id) has them, else 0."""
    return pairs.join(truth.select("s1_id", "target_id").distinct().withColumn("label", F.lit(1.0)), ["s1_id", "target_id"], "left").na.fill(0.0, ["label"])


@dataclass
class Bundle:
    """A fitted model, its features, threshold, and how features were made."""

    model: PipelineModel
    features: list[str]
    threshold: float = 0.5
    flags: dict = field(default_factory=dict)

    def score(self, pairs: DataFrame, name: str = "score") -> DataFrame:
        out = self.model.transform(pairs.na.fill(ABSENT, self.features))
        return out.select(*pairs.columns, vector_to_array("probability")[1].alias(name))

    def save(self, path: str) -> None:
        self.model.write().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps({"features": self.features, "threshold": self.threshold, "flags": self.flags}),)], "bundle string").coalesce(1).write.text(f"{path}/bundle")

    @staticmethod
    def load(spark: SparkSession, path: str, **expected: object) -> Bundle:
        """expected: flags that must be as they were when the model was fitted."""
        facts = json.loads(spark.read.text(f"{path}/bundle").first()[0])
        if wrong := {k: facts["flags"].get(k) for k, v in expected.items() if facts["flags"].get(k) != v}:
            raise ValueError(f"the model was fitted with {wrong}")
        return Bundle(PipelineModel.load(f"{path}/model"), facts["features"], facts["threshold"], facts["flags"])

    def parameters(self) -> int:
        last = self.model.stages[-1]
        return last.totalNumNodes if hasattr(last, "totalNumNodes") else last.numFeatures + 1


def fit(pairs: DataFrame, features: list[str], kind: str = "trees", flags: dict | None = None, seed: int = 2026, iterations: int = 200) -> Bundle:
    """kind: `trees` (boosted, depth 4, step 0.08) or `logistic` (scaled, regularised as C = 1). Missing features become ABSENT."""
    rows = pairs.na.fill(ABSENT, features)
    assemble = VectorAssembler(inputCols=features, outputCol="raw_features")
    if kind == "trees":
        steps = [assemble, GBTClassifier(featuresCol="raw_features", labelCol="label", maxIter=iterations, maxDepth=4, stepSize=0.08, seed=seed)]
    elif kind == "logistic":
        n = rows.count()
        steps = [assemble, StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol="label", regParam=1.0 / max(1, n), maxIter=500, standardization=False)]
    else:
        raise ValueError(f"unknown kind {kind}")
    return Bundle(Pipeline(stages=steps).fit(rows), features, flags=flags or {})


def calibrate(bundle: Bundle, pairs: DataFrame, spine: DataFrame, truth: DataFrame) -> Bundle:
    """The bundle with the threshold that is best on spine's records."""
    from matchloom.operators.evaluate import select_threshold

    scored = bundle.score(pairs.join(spine.select("s1_id"), "s1_id", "left_semi"))
    return Bundle(bundle.model, bundle.features, select_threshold(spine, truth, scored)[0], bundle.flags)


def transfer(pairs: DataFrame, spine: DataFrame, truth: DataFrame, origin: str, features: list[str], kind: str = "trees", iterations: int = 50) -> tuple[Bundle, DataFrame]:
    """Fit and calibrate on the records of one country, evaluate on the others: the bundle and the metrics."""
    from matchloom.operators.evaluate import evaluate, predict

    home, away = spine.where(F.col("country") == origin), spine.where(F.col("country") != origin)
    bundle = calibrate(fit(labelled(pairs.join(home.select("s1_id"), "s1_id", "left_semi"), truth), features, kind, iterations=iterations), pairs, home, truth)
    scored = bundle.score(pairs.join(away.select("s1_id"), "s1_id", "left_semi"))
    return bundle, evaluate(away, truth.join(away, "s1_id", "left_semi"), predict(scored, bundle.threshold))


def keeps(new: dict, old: dict, slack: float = 0.02) -> bool:
    """Whether a new method replaces the old: better on the whole, and on records without links not worse by more than slack."""
    return new["macro_f05"] > old["macro_f05"] and (new["singleton_f05"] or 0) >= (old["singleton_f05"] or 0) - slack


def describe(bundle: Bundle) -> dict:
    return {"features": bundle.features, "threshold": bundle.threshold, "flags": bundle.flags, "parameters": bundle.parameters()}


def score_pairs(texts: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[float]]], name: str = "score", batch: int = 64) -> DataFrame:
    """texts(text_a, text_b, ...) with the score of each pair. scorer is called once a task, where it loads its model, and gives a function for batches.

    A hook for rerankers, of which none is here; a score that isn't finite and from 0 to 1 is refused.
    """

    @F.arrow_udf("double")
    def judge(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        score = scorer()
        for left, right in columns:
            a, b, out = left.to_pylist(), right.to_pylist(), []
            for at in range(0, len(a), batch):
                out += score(a[at : at + batch], b[at : at + batch])
            if len(out) != len(a) or not all(0 <= x <= 1 for x in out):
                raise ValueError("a scorer gives each pair a score from 0 to 1")
            yield pa.array(out, pa.float64())

    return texts.withColumn(name, judge("text_a", "text_b"))


def require_compliant(licence: str | None, parameters: int | None, licences: tuple[str, ...] = ("mit", "apache-2.0"), most: int = 8_000_000_000) -> None:
    """Raise unless a model's licence is one of those allowed and its number of parameters is known and within bounds."""
    if licence not in licences or not isinstance(parameters, int) or not 0 < parameters <= most:
        raise ValueError(f"the model can't be used: licence {licence}, parameters {parameters}")


@dataclass
class Gate:
    """Bounds of a run: seconds, bytes of input, and the seconds that it would take at the pace so far."""

    seconds: float
    input_bytes: int | None = None
    began: float = field(default_factory=time.monotonic)

    def require_input(self, spark: SparkSession, paths: list[str]) -> int:
        """The size of the files, which Hadoop's file systems tell; raises if it is over the bound."""
        total = 0
        for path in paths:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            total += place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
        if self.input_bytes is not None and total > self.input_bytes:
            raise ValueError(f"{total} bytes of input; at most {self.input_bytes} are allowed")
        return total

    def projected(self, done: int, of: int, now: float | None = None) -> float:
        """Seconds for all `of` steps at the pace of the `done` ones."""
        return ((time.monotonic() if now is None else now) - self.began) / max(1, done) * of

    def require_pace(self, done: int, of: int, now: float | None = None) -> float:
        """Raise if time is up, or would be before the last step."""
        now = time.monotonic() if now is None else now
        if now - self.began > self.seconds or self.projected(done, of, now) > self.seconds:
            raise TimeoutError(f"{self.projected(done, of, now):.0f} s projected, {self.seconds:.0f} allowed; no output is complete")
        return self.projected(done, of, now)
