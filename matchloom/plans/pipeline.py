"""The three ways through the engine: a small-data baseline, training on a labelled set, and inference with a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.features import EDIT_FEATURES, TOKEN_FEATURES, with_features
from matchloom.operators import blocking, evaluate, model, sampling, tfidf
from matchloom.sources import sinks


def baseline(s1: DataFrame, targets: DataFrame, truth: DataFrame, k: int = 50, max_features: int | None = 300_000, seed: int = 2026) -> dict:
    """Nearest targets by character TF-IDF, a threshold from 80 % of the records, metrics of the others."""
    text = F.concat("name", F.lit(" "), "address").alias("text")
    found = tfidf.retrieve(s1.select("entity_id", "source", text), targets.select("entity_id", "source", text), k, max_features)
    spine = sampling.grouped_split(s1.select(F.col("entity_id").alias("s1_id"), "country"), seed)
    calibration, validation = (spine.where(F.col("split") == x).drop("split") for x in ("train", "validation"))
    threshold, trials = evaluate.select_threshold(calibration, truth, found)
    predicted = evaluate.predict(found, threshold).join(validation, "s1_id", "left_semi")
    own = truth.join(validation, "s1_id", "left_semi")
    per = evaluate.counts_by_entity(validation, own, found.join(validation, "s1_id", "left_semi"))
    return {"threshold": threshold, "trials": trials, "candidates": found, "metrics": evaluate.evaluate(validation, own, predicted).first().asDict(), "coverage": evaluate.coverage(per).first().asDict(), "slices": evaluate.slices(validation, own, predicted, targets)}


def train(s1: DataFrame, targets: DataFrame, truth: DataFrame, kind: str = "trees", neutral_missing: bool = True, edit: bool = True, k: int = blocking.TOP_K, most: int | None = blocking.MAX_KEY_FREQUENCY, iterations: int = 200, seed: int = 2026) -> tuple[model.Bundle, dict]:
    """Block, make features, fit on 60 % of the records, choose the threshold on 20 % and report the rest."""
    pairs = with_features(blocking.candidates(s1, targets, k, most), neutral_missing, edit).persist()
    spine = sampling.three_way(s1.select(F.col("entity_id").alias("s1_id"), "country"), seed)
    part = {x: spine.where(F.col("split") == x).drop("split") for x in ("train", "calibration", "validation")}
    features = [*TOKEN_FEATURES, *(EDIT_FEATURES if edit else ())]
    flags = {"neutral_missing": neutral_missing, "edit": edit, "k": k, "max_key_frequency": most}
    bundle = model.fit(model.labelled(pairs.join(part["train"], "s1_id", "left_semi"), truth), features, kind, flags, seed, iterations)
    bundle = model.calibrate(bundle, pairs, part["calibration"], truth)
    own = truth.join(part["validation"], "s1_id", "left_semi")
    predicted = evaluate.predict(bundle.score(pairs.join(part["validation"], "s1_id", "left_semi")), bundle.threshold)
    report = evaluate.evaluate(part["validation"], own, predicted).first().asDict()
    pairs.unpersist()
    return bundle, report


def infer(s1: DataFrame, targets: DataFrame, bundle: model.Bundle) -> tuple[DataFrame, DataFrame]:
    """Candidates and matches of all records, with the flags that the model was fitted with. One lazy plan."""
    f = bundle.flags
    pairs = with_features(blocking.candidates(s1, targets, f["k"], f["max_key_frequency"]), f["neutral_missing"], f["edit"])
    scored = bundle.score(pairs)
    return pairs.select("s1_id", "target_id"), evaluate.predict(scored, bundle.threshold).select("s1_id", "target_id")


def infer_exact(s1: DataFrame, targets: DataFrame, weights: list[float], intercept: float, threshold: float, k: int = blocking.TOP_K) -> DataFrame:
    """Matches by exact keys and a logistic score over the ten token features."""
    from matchloom.functions.features import logistic_score

    pairs = with_features(blocking.candidates(s1, targets, k, None, exact=True), edit=False)
    return evaluate.predict(pairs.withColumn("score", logistic_score(TOKEN_FEATURES, weights, intercept)), threshold).select("s1_id", "target_id")


def run(directory: str, s1: DataFrame, targets: DataFrame, bundle: model.Bundle, **facts: object) -> None:
    """Infer, validate and write both outputs; s1 needs a column position."""
    candidates, matches = (t.persist() for t in infer(s1, targets, bundle))
    sinks.write_submission(directory, s1.select(F.col("entity_id").alias("s1_id"), "position"), targets, candidates, matches)
    candidates.unpersist()
    matches.unpersist()
