"""Reproducible samples and splits by a hash of the id: the same rows whatever the order or partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_order(seed: int, by: str = "s1_id") -> F.Column:
    return F.md5(F.concat(F.col(by), F.lit(f":{seed}")))


def sample(rows: DataFrame, n: int, seed: int = 2026, by: str = "s1_id", without: DataFrame | None = None) -> DataFrame:
    """n rows, each set equally likely; `without` names ids that may not be drawn."""
    if without is not None:
        rows = rows.join(without.select(by), by, "left_anti")
    return rows.orderBy(hash_order(seed, by), by).limit(n)


def fit_sample(pairs: DataFrame, n: int = 30_000, seed: int = 2026, by: str = "target_id") -> DataFrame:
    """At most n of the distinct targets of pairs, for what is fitted on their texts."""
    return sample(pairs.select(by).distinct(), n, seed, by)


def bands(rows: DataFrame, shares: dict[str, float], seed: int = 2026, by: str = "s1_id") -> DataFrame:
    """rows with `split`: by the first 32 bits of the hash, cut at the shares. Disjoint, exhaustive, and without a global order."""
    place = F.conv(F.substring(hash_order(seed, by), 1, 8), 16, 10).cast("long") / float(1 << 32)
    split, low = None, 0.0
    for name, share in shares.items():
        low += share
        split = F.when(place < low, name) if split is None else split.when(place < low, name)
    return rows.withColumn("split", split.otherwise(list(shares)[-1]))


def grouped_split(rows: DataFrame, seed: int = 2026, fraction: float = 0.2, by: str = "s1_id") -> DataFrame:
    """split is train or validation; at least five ids, each once."""
    total, distinct = rows.agg(F.count("*"), F.count_distinct(by)).first()
    if total < 5 or total != distinct:
        raise ValueError("a split needs at least five ids, each once")
    return bands(rows, {"train": 1 - fraction, "validation": fraction}, seed, by)


def three_way(rows: DataFrame, seed: int = 2026, by: str = "s1_id") -> DataFrame:
    return bands(rows, {"train": 0.6, "calibration": 0.2, "validation": 0.2}, seed, by)


def spaced_by_length(rows: DataFrame, length: F.Column, m: int, by: str) -> DataFrame:
    """m rows evenly spaced in the order of their length: rank round(i * (n - 1) / (m - 1)). Ranks come from counts by length, not from one sorted task."""
    n = rows.count()
    wanted = sorted({round(i * (n - 1) / (m - 1)) for i in range(m)}) if m > 1 and n else [0][: n and 1]
    if not wanted:
        return rows.limit(0)
    tagged = rows.withColumn("__length", length)
    counts = {r["__length"]: r["n"] for r in tagged.groupBy("__length").agg(F.count("*").alias("n")).collect()}
    takes, at = [], 0
    for size in sorted(counts):
        inside = [w - at for w in wanted if at <= w < at + counts[size]]
        takes += [(size, w + 1) for w in inside]
        at += counts[size]
    from pyspark.sql import Window

    plan = rows.sparkSession.createDataFrame(takes, "__length int, __nth int")
    numbered = tagged.join(F.broadcast(plan.select("__length").distinct()), "__length").withColumn("__nth", F.row_number().over(Window.partitionBy("__length").orderBy(by)))
    return numbered.join(F.broadcast(plan), ["__length", "__nth"]).drop("__length", "__nth")
