"""Candidate pairs: keys meet in a hash join, frequent keys are left out by rule, the best per source are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import keys as K
from matchloom.functions.features import block_score
from matchloom.functions.text import tokens

MAX_KEY_FREQUENCY, TOP_K = 10, 20


def document_frequency(records: DataFrame, text: str) -> DataFrame:
    """token and df: in how many records it is."""
    return records.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def reference_keys(s1: DataFrame, names: DataFrame | None = None, addresses: DataFrame | None = None, by_address: bool = True, exact: bool = False) -> DataFrame:
    """entity_id and key of reference records(entity_id, name, address); frequencies are those of s1 unless given."""
    name, address = F.col("name"), F.col("address")
    if exact:
        return s1.select("entity_id", F.explode(F.array_distinct(K.exact_keys(name, address))).alias("key"))
    rows = K.rarest(s1.select("entity_id", "name", "address"), K.name_words(name), names if names is not None else document_frequency(s1, "name"), "rare")
    found = K.query_keys(F.col("name"), F.col("address"), F.col("rare"))
    if by_address:
        rows = K.rarest(rows, K.address_words(F.col("address")), addresses if addresses is not None else document_frequency(s1, "address"), "rare_address")
        found = F.concat(found, K.address_query_keys(F.col("address"), F.col("rare_address")))
    return rows.select("entity_id", F.explode(F.array_distinct(found)).alias("key"))


def target_keys(targets: DataFrame, by_address: bool = True, exact: bool = False) -> DataFrame:
    """entity_id and key of target records."""
    name, address = F.col("name"), F.col("address")
    found = K.exact_keys(name, address) if exact else F.concat(K.target_keys(name, address), K.address_target_keys(address)) if by_address else K.target_keys(name, address)
    return targets.select("entity_id", F.explode(F.array_distinct(found)).alias("key"))


def key_frequency(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def capped(keys: DataFrame, most: int | None = MAX_KEY_FREQUENCY) -> DataFrame:
    """keys without those of more than `most` reference records: part of the method, and what bounds a key's fan-out."""
    return keys if most is None else keys.join(key_frequency(keys).where(F.col("n") <= most).select("key"), "key", "left_semi").select("entity_id", "key")


def block(s1: DataFrame, targets: DataFrame, most: int | None = MAX_KEY_FREQUENCY, by_address: bool = True, exact: bool = False) -> DataFrame:
    """Distinct (s1_id, target_id) that share a key. The capped index is small beside the targets' keys; Spark broadcasts it if it is small enough."""
    index = capped(reference_keys(s1, by_address=by_address, exact=exact), most).select(F.col("entity_id").alias("s1_id"), "key")
    return target_keys(targets, by_address, exact).select(F.col("entity_id").alias("target_id"), "key").join(index, "key").select("s1_id", "target_id").distinct()


def with_records(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """pairs with both records' columns: name, address, country, and target_name, target_address, target_country, target_source."""
    left = s1.select(F.col("entity_id").alias("s1_id"), "name", "address", "country")
    right = targets.select(F.col("entity_id").alias("target_id"), F.col("name").alias("target_name"), F.col("address").alias("target_address"), F.col("country").alias("target_country"), F.col("source").alias("target_source"))
    return pairs.join(left, "s1_id").join(right, "target_id")


def scored(pairs: DataFrame, by_address: bool = True) -> DataFrame:
    return pairs.withColumn("blocking_score", block_score(*(F.col(c) for c in ("name", "address", "target_name", "target_address")), by_address=by_address))


def top_k(pairs: DataFrame, k: int = TOP_K, score: str = "blocking_score", rank: str = "blocking_rank", descending_ids: bool = True) -> DataFrame:
    """The k best per reference record and source, with their rank; ties go to the greater target id, or the smaller one."""
    order = F.desc("target_id") if descending_ids else F.asc("target_id")
    best = Window.partitionBy("s1_id", "target_source").orderBy(F.desc(score), order)
    return pairs.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= k)


def candidates(s1: DataFrame, targets: DataFrame, k: int = TOP_K, most: int | None = MAX_KEY_FREQUENCY, by_address: bool = True, exact: bool = False) -> DataFrame:
    """Ranked candidates with both records' columns."""
    return top_k(scored(with_records(block(s1, targets, most, by_address, exact), s1, targets), by_address or exact), k)


def block_curve(ranked: DataFrame, truth: DataFrame, spine: DataFrame, floors: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3, 0.5), ks: tuple[int, ...] = (5, 10, 20, 50)) -> DataFrame:
    """For each score floor and k: pairs kept, and pair recall and coverage, in one pass over a grid of bounded size."""
    from matchloom.operators.evaluate import counts_by_entity, coverage

    grid = ranked.sparkSession.createDataFrame([(float(f), int(k)) for f in floors for k in ks], "floor double, k int")
    kept = ranked.join(F.broadcast(grid), (F.col("blocking_score") >= F.col("floor")) & (F.col("blocking_rank") <= F.col("k")))
    per = counts_by_entity(spine.join(F.broadcast(grid)), truth, kept.select("floor", "k", "s1_id", "target_id"), ["floor", "k"])
    return coverage(per, ["floor", "k"])
