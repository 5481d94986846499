"""Records from the tables at hand: documents as businesses, customers and suppliers as names with digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import normalize, tokens
from matchloom.sources.staging import stage


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, source, name, address and country of documents, staged: the texts are read once, whatever is done with the records.

    A whole text is normalised; of its distinct words, those nearest to five letters first and those alike in the order of their letters, the first
    four are the name and the next eight the address. The id's remainder by 3 gives the source.
    """
    rows = whole_texts(spark, sf_dir)
    ranked = F.array_sort(F.transform(tokens(F.col("body")), lambda t: F.struct(F.abs(F.length(t) - 5).alias("n"), t.alias("t"))))
    part = lambda at, n: F.concat_ws(" ", F.transform(F.slice("ranked", at, n), lambda x: x["t"]))
    return stage(rows.select("entity_id", "source", ranked.alias("ranked"), "country").select("entity_id", "source", part(1, 4).alias("name"), part(5, 8).alias("address"), "country"))


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, source, body (the whole normalised text) and country of documents."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.col("doc_id") % 3 + 1
    return rows.select(F.concat(F.lit("S"), number, F.lit("-"), "doc_id").alias("entity_id"), F.concat(F.lit("S"), number).alias("source"), normalize(F.col("text")).alias("body"), F.coalesce("lang", F.lit("")).alias("country"))


def split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference and target records."""
    return records.where("source = 'S1'"), records.where("source <> 'S1'")


def spine(s1: DataFrame) -> DataFrame:
    return s1.select(F.col("entity_id").alias("s1_id"), "country")


def truth(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (s1_id, target_id): the same name, and addresses that share half of their words or more."""
    a = s1.select(F.col("entity_id").alias("s1_id"), "name", tokens(F.col("address")).alias("a"))
    b = targets.select(F.col("entity_id").alias("target_id"), "name", tokens(F.col("address")).alias("b"))
    both = a.where("name <> ''").join(b, "name")
    return both.where(F.size(F.array_intersect("a", "b")) * 2 >= F.greatest(F.lit(1), F.size(F.array_union("a", "b")))).select("s1_id", "target_id")


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, source (S1 customers, S2 suppliers), name and address (the nation's name and key)."""
    nation = F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet"))  # 25 rows by definition
    parts = []
    for table, c, source in (("customer", "c_custkey c_name c_nationkey", "S1"), ("supplier", "s_suppkey s_name s_nationkey", "S2")):
        key, name, of = c.split()
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, name, of)
        parts.append(rows.join(nation, F.col(of) == F.col("n_nationkey")).select(F.concat(F.lit(f"{source}-"), F.col(key)).alias("entity_id"), F.lit(source).alias("source"), normalize(F.col(name), False).alias("name"), normalize(F.concat_ws(" ", "n_name", "n_nationkey"), False).alias("address"), F.col("n_name").alias("country")))
    return parts[0].unionByName(parts[1])
