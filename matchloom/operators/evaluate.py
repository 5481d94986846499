"""Evaluation per reference record: macro F0.5, micro precision and recall, blocking recall, slices, threshold sweeps, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the first sweep; the last accepts nothing.
COARSE = (*(round(0.30 + 0.05 * i, 6) for i in range(14)), 0.0, 1.000001)


def entity_f05(n_true: Column, n_predicted: Column, hits: Column) -> Column:
    """F0.5 of one record; without true links it is 1 if none are predicted, else 0."""
    return F.when(n_true == 0, (n_predicted == 0).cast("double")).otherwise(1.25 * hits / (0.25 * n_true + n_predicted))


def counts_by_entity(spine: DataFrame, truth: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_true, n_predicted and hits for every row of spine(s1_id, *by); records without links keep their row.

    truth(s1_id, target_id) holds for all of `by`; predicted has the columns of `by` too.
    """
    by = by or []
    right = truth.select("s1_id", "target_id").distinct()
    n_true = right.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    shown = predicted.select(*by, "s1_id", "target_id").distinct().join(right.withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left")
    n_predicted = shown.groupBy(*by, "s1_id").agg(F.count("*").alias("n_predicted"), F.count("hit").alias("hits"))
    return spine.select(*by, "s1_id").join(n_true, "s1_id", "left").join(n_predicted, [*by, "s1_id"], "left").na.fill(0, ["n_true", "n_predicted", "hits"])


def metrics(per: DataFrame, by: list[str] | None = None) -> DataFrame:
    """macro_f05, precision, recall, singleton_f05, matched_f05 and multi_match_f05 by group; null where a group has none."""
    f = entity_f05(F.col("n_true"), F.col("n_predicted"), F.col("hits"))
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(F.when(F.count("*") > 0, 0.0))
    return per.groupBy(*(by or [])).agg(
        F.avg(f).alias("macro_f05"),
        share("hits", "n_predicted").alias("precision"),
        share("hits", "n_true").alias("recall"),
        F.avg(F.when(F.col("n_true") == 0, f)).alias("singleton_f05"),
        F.avg(F.when(F.col("n_true") > 0, f)).alias("matched_f05"),
        F.avg(F.when(F.col("n_true") > 1, f)).alias("multi_match_f05"),
    )


def evaluate(spine: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of metrics; predictions for records that spine doesn't have are refused."""
    if predicted.join(spine, "s1_id", "left_anti").limit(1).count():
        raise ValueError("predictions for unknown reference ids")
    return metrics(counts_by_entity(spine, truth, predicted))


def coverage(per: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pairs, candidate_pair_recall, and the shares of all and of matched records whose links are all among the candidates."""
    whole = (F.col("hits") == F.col("n_true")).cast("double")
    return per.groupBy(*(by or [])).agg(
        F.sum("n_predicted").alias("pairs"),
        F.when(F.sum("n_true") > 0, F.sum("hits") / F.sum("n_true")).alias("candidate_pair_recall"),
        F.avg(whole).alias("entity_complete_coverage"),
        F.avg(F.when(F.col("n_true") > 0, whole)).alias("matched_entity_complete_coverage"),
    )


def predict(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return scored.where(F.col(score) >= threshold)


def as_lists(spine: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """s1_id and a sorted comma-separated list of target ids, empty for none, for every record."""
    lists = pairs.groupBy("s1_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("target_id"))).alias(name))
    return spine.select("s1_id").join(lists, "s1_id", "left").na.fill("", [name])


def threshold_metrics(spine: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: tuple[float, ...] = COARSE, score: str = "score") -> DataFrame:
    """threshold and macro_f05 for each threshold, in one pass: pairs meet a grid of bounded size."""
    grid = F.broadcast(scored.sparkSession.createDataFrame([(float(t),) for t in sorted({*thresholds})], "threshold double"))
    kept = scored.join(grid, F.col(score) >= F.col("threshold")).select("threshold", "s1_id", "target_id")
    return metrics(counts_by_entity(spine.join(grid), truth, kept, ["threshold"]), ["threshold"]).select("threshold", "macro_f05")


def select_threshold(spine: DataFrame, truth: DataFrame, scored: DataFrame, score: str = "score") -> tuple[float, list[tuple[float, float]]]:
    """The best threshold (the greater of equals) of a coarse grid, refined around it, and all trials."""
    scored, best = scored.select("s1_id", "target_id", score), lambda tried: max(tried, key=lambda t: (tried[t], t))
    tried = {r["threshold"]: r["macro_f05"] for r in threshold_metrics(spine, truth, scored, COARSE, score).collect()}
    middle = best(tried)
    fine = tuple(t for i in range(-10, 11) if 0 <= (t := round(middle + 0.005 * i, 6)) <= 1 and t not in tried)
    if fine:
        tried |= {r["threshold"]: r["macro_f05"] for r in threshold_metrics(spine, truth, scored, fine, score).collect()}
    return best(tried), sorted(tried.items())


def slices(spine: DataFrame, truth: DataFrame, predicted: DataFrame, targets: DataFrame) -> DataFrame:
    """Metrics of all, of each country of spine(s1_id, country) and of each target source, where truth and predictions are both cut."""
    known = [r["source"] for r in targets.select("source").distinct().orderBy("source").collect()]  # S2 and S3
    pairs = truth.select("s1_id", "target_id").distinct().withColumn("t", F.lit(1)).join(predicted.select("s1_id", "target_id").distinct().withColumn("p", F.lit(1)), ["s1_id", "target_id"], "full_outer").na.fill(0)
    of_target = pairs.join(targets.select(F.col("entity_id").alias("target_id"), "source"), "target_id", "left")
    both = lambda more: F.explode(F.array(F.lit("ALL"), F.concat(F.lit("country:"), "country"), *more)).alias("slice")
    cut = of_target.join(spine.select("s1_id", "country"), "s1_id").select("s1_id", both([F.concat(F.lit("source:"), "source")]), "t", "p").where("slice IS NOT NULL")
    counts = cut.groupBy("slice", "s1_id").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_predicted"), F.sum(F.col("t") * F.col("p")).alias("hits"))
    rows = spine.select("s1_id", both([F.lit(f"source:{s}") for s in known]))
    return metrics(rows.join(counts, ["slice", "s1_id"], "left").na.fill(0), ["slice"])


def bootstrap(per: DataFrame, rounds: int = 1000, seed: int = 2026) -> DataFrame:
    """low and high: the 2.5 and 97.5 percentiles of the mean F0.5 over resamples, each record drawn Poisson(1) times by a hash of its id.

    A record's rows for the rounds are made and added up in one task, so only sums by round are shuffled.
    """
    n = F.broadcast(per.sparkSession.range(rounds).withColumnRenamed("id", "round"))
    place = F.substring(F.md5(F.concat_ws(":", F.col("s1_id"), F.col("round"), F.lit(seed))), 1, 8)
    u = F.conv(place, 16, 10).cast("long") / float(1 << 32)
    bounds, total, p = [], 0.0, 2.718281828459045**-1
    for i in range(12):
        total += p
        bounds.append(round(total, 12))
        p /= i + 1
    times = sum(((u >= b).cast("int") for b in bounds), F.lit(0))
    f = entity_f05(F.col("n_true"), F.col("n_predicted"), F.col("hits"))
    means = per.join(n).select("round", f.alias("f"), times.alias("w")).groupBy("round").agg((F.sum(F.col("f") * F.col("w")) / F.sum("w")).alias("mean"))
    return means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def diagnostic(spine: DataFrame, truth: DataFrame, scored: DataFrame, score: str = "score") -> DataFrame:
    """s1_id, split, n_true and max_score (null without candidates) of every record of spine(s1_id, split)."""
    best = scored.groupBy("s1_id").agg(F.max(score).alias("max_score"))
    links = truth.groupBy("s1_id").agg(F.count_distinct("target_id").alias("n_true"))
    return spine.select("s1_id", "split").join(links, "s1_id", "left").join(best, "s1_id", "left").na.fill(0, ["n_true"])


def totals(spine: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: records, candidate pairs and matches, and records without a match."""
    n = matches.groupBy("s1_id").agg(F.count("*").alias("m"))
    c = candidates.groupBy("s1_id").agg(F.count("*").alias("c"))
    per = spine.select("s1_id").join(c, "s1_id", "left").join(n, "s1_id", "left").na.fill(0)
    return per.agg(F.count("*").alias("records"), F.sum("c").alias("candidates"), F.sum("m").alias("matches"), F.count_if(F.col("m") == 0).alias("unmatched"))


def score_quantiles(spine: DataFrame, truth: DataFrame, scored: DataFrame, score: str = "score") -> DataFrame:
    """Of the greatest score of each record (0 without candidates), by whether it has links: min, quartiles, 95th percentile, max."""
    best = scored.groupBy("s1_id").agg(F.max(score).alias("best"))
    linked = truth.select("s1_id").distinct().withColumn("matched", F.lit(True))
    rows = spine.select("s1_id").join(best, "s1_id", "left").join(linked, "s1_id", "left").select(F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("matched", F.lit(False)).alias("matched"))
    marks = [F.percentile("best", F.lit(p)).alias(f"p{round(100 * p):02d}") for p in (0.25, 0.5, 0.75, 0.95)]
    return rows.groupBy("matched").agg(F.count("*").alias("n"), F.min("best").alias("low"), *marks, F.max("best").alias("high"))


def output_diff(spine: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: links added and removed, records changed, records that lost all links."""
    both = old.select("s1_id", "target_id").distinct().withColumn("was", F.lit(1)).join(new.select("s1_id", "target_id").distinct().withColumn("is", F.lit(1)), ["s1_id", "target_id"], "full_outer")
    per = both.groupBy("s1_id").agg(F.count("was").alias("was"), F.count("is").alias("is"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("is").isNull()).alias("removed"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return spine.join(per, "s1_id", "left").agg(total("added").alias("added"), total("removed").alias("removed"), F.count_if(F.col("added") + F.col("removed") > 0).alias("changed"), F.count_if((F.col("was") > 0) & (F.col("is") == 0)).alias("emptied"))
