"""Dataset audits: lengths, missing values, duplicates, link histograms, shared targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("name", "address", "country")


def lengths(records: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """By source and column: mean, standard deviation, min, max, interpolated quartiles and the exact 25th, 50th, 75th and 95th percentile values of lengths."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.length(c).alias("n")) for c in columns]))
    marks = [F.percentile("n", F.lit(p)).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)]
    exact = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)").cast("long").alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75, 0.95)]
    rows = records.select("source", pairs.alias("x")).select("source", "x.*")
    return rows.groupBy("source", "field").agg(F.count("*").alias("rows"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").cast("long").alias("low"), F.max("n").cast("long").alias("high"), *marks, *exact)


def missing(records: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """By source: rows, duplicate ids, and blank values of each column."""
    blank = [F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "").alias(f"blank_{c}") for c in columns]
    ids = records.groupBy("source", "entity_id").agg(F.count("*").alias("n")).groupBy("source").agg((F.sum("n") - F.count("*")).alias("duplicate_ids"))
    return records.groupBy("source").agg(F.count("*").alias("rows"), *blank).join(ids, "source")


def countries(records: DataFrame) -> DataFrame:
    return records.groupBy("source", "country").agg(F.count("*").alias("rows"))


def match_histogram(spine: DataFrame, truth: DataFrame) -> DataFrame:
    """By country and number of links: records."""
    n = truth.groupBy("s1_id").agg(F.count_distinct("target_id").alias("links"))
    return spine.join(n, "s1_id", "left").na.fill(0, ["links"]).groupBy("country", "links").agg(F.count("*").alias("records"))


def match_classes(spine: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: records with no, one and many links."""
    links = F.col("links")
    return match_histogram(spine, truth).agg(*[F.coalesce(F.sum(F.when(c, F.col("records"))), F.lit(0)).alias(n) for n, c in (("zero", links == 0), ("one", links == 1), ("many", links > 1))])


def shared_targets(truth: DataFrame) -> DataFrame:
    """One row: linked targets, those linked to several records, and the most records of one target."""
    per = truth.groupBy("target_id").agg(F.count_distinct("s1_id").alias("n"))
    return per.agg(F.count("*").alias("targets"), F.count_if(F.col("n") > 1).alias("shared"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def shared_examples(truth: DataFrame, n: int = 10) -> DataFrame:
    """target_id, n and records of the n targets that most records are linked to, of those linked to several; records are the first five."""
    per = truth.select("target_id", "s1_id").distinct().groupBy("target_id").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "target_id").limit(n)
    first = Window.partitionBy("target_id").orderBy("s1_id")
    least = truth.select("target_id", "s1_id").distinct().join(F.broadcast(per), "target_id").withColumn("nth", F.row_number().over(first)).where("nth <= 5")  # n rows
    return least.groupBy("target_id", "n").agg(F.concat_ws(",", F.array_sort(F.collect_list("s1_id"))).alias("records"))


def review(rows: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """case_type, error_category, n and share of its case of hand-reviewed rows, and `gate`: the first of kinds that names the category, if any."""
    per = rows.groupBy("case_type", "error_category").agg(F.count("*").alias("n"))
    whole = per.groupBy("case_type").agg(F.sum("n").alias("of"))
    gate = F.coalesce(*[F.when(F.col("error_category").isin(*c), F.lit(k)) for k, c in kinds.items()], F.lit(None).cast("string"))
    return per.join(F.broadcast(whole), "case_type").select("case_type", "error_category", "n", (F.col("n") / F.col("of")).alias("share"), gate.alias("gate"))  # a row for each case


def review_gates(rows: DataFrame, kinds: dict[str, tuple[str, ...]], least: dict[str, float], unclear: tuple[str, ...] = ()) -> DataFrame:
    """gate, n, share, and status: cleared if the share of its categories reaches the gate's least, indeterminate if it would with all unclear ones."""
    total = F.greatest(F.lit(1), F.count("*"))
    counts = [F.count_if(F.col("error_category").isin(*c)).alias(k) for k, c in kinds.items()]
    one = rows.agg(total.alias("total"), F.count_if(F.col("error_category").isin(*unclear)).alias("open"), *counts)
    each = one.select("total", "open", F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("n"), F.lit(float(least[k])).alias("least")) for k in kinds])).alias("x")).select("total", "open", "x.*")
    share, most = F.col("n") / F.col("total"), (F.col("n") + F.col("open")) / F.col("total")
    return each.select("gate", "n", share.alias("share"), F.when(share >= F.col("least"), "cleared").when(most >= F.col("least"), "indeterminate").otherwise("not_cleared").alias("status"))


def links_by_source(truth: DataFrame) -> DataFrame:
    return truth.groupBy(F.substring("target_id", 1, 2).alias("source")).agg(F.count("*").alias("links"))


def label_findings(lists: DataFrame, spine: DataFrame, targets: DataFrame) -> DataFrame:
    """One row of counts for lists(s1_id, ids array): duplicate rows, unknown and missing records, repeated ids, unknown targets."""
    each = lists.select("s1_id", F.explode("ids").alias("target_id"))
    n = lambda t, name: t.agg(F.count("*").alias(name))
    parts = [
        n(lists.groupBy("s1_id").count().where("count > 1"), "duplicate_labels"),
        n(lists.select("s1_id").distinct().join(spine, "s1_id", "left_anti"), "unknown_records"),
        n(spine.join(lists, "s1_id", "left_anti"), "missing_records"),
        n(lists.where(F.size("ids") != F.size(F.array_distinct("ids"))), "repeated_matches"),
        n(each.join(targets.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti"), "unknown_targets"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


def require_clean(findings: DataFrame) -> None:
    """Raise if any count isn't 0."""
    bad = {k: v for k, v in findings.first().asDict().items() if v}
    if bad:
        raise ValueError(f"the labels don't fit the records: {bad}")
