"""Sinks: validated list-valued TSVs, JSON lines, experiment logs, manifests, packages. None overwrites."""

from __future__ import annotations

import hashlib
import json
import platform
import zipfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.features import pair_text
from matchloom.operators.evaluate import as_lists
from matchloom.operators.validate import official_findings, require_submission
from matchloom.sources.readers import id_list


def write_lists(lists: DataFrame, path: str) -> None:
    """Tab-separated files, each with the header, in the order of lists.position, which isn't written: sorted ranges that tasks write side by side."""
    rows = lists.repartitionByRange("position").sortWithinPartitions("position").drop("position")
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def concatenate(path: str, out: str) -> None:
    """One local file, which mustn't exist, from the files of a table of lists: the header once, then all rows in order, a block at a time."""
    with open(out, "xb") as to:
        for n, part in enumerate(sorted(Path(path.removeprefix("file://")).glob("part-*"))):
            with open(part, "rb") as f:
                header = f.readline()
                if n == 0:
                    to.write(header)
                while block := f.read(1 << 20):
                    to.write(block)


def write_scored(rows: DataFrame, path: str) -> None:
    """Scored pairs or candidates as TSV with a header, in as many files as there are partitions."""
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_submission(directory: str, spine: DataFrame, targets: DataFrame, candidates: DataFrame, matches: DataFrame) -> None:
    """candidate_pairs and matching_results in the order of spine(s1_id, position), validated before writing and as read back."""
    if matches.join(spine, "s1_id", "left_anti").limit(1).count():
        raise ValueError("matches for unknown reference ids")
    lists = {"candidate_pairs": as_lists(spine, candidates, "candidate_entity_ids"), "matching_results": as_lists(spine, matches, "matched_entity_ids")}
    require_submission(spine, targets, candidates, lists["matching_results"].withColumn("ids", id_list(F.col("matched_entity_ids"))))
    for name, rows in lists.items():
        ordered = rows.join(spine.select("s1_id", "position"), "s1_id").withColumnRenamed("s1_id", "source1_entity_id")
        write_lists(ordered, f"{directory}/{name}.tsv")
    spark = spine.sparkSession
    findings = official_findings(spark, f"{directory}/matching_results.tsv", f"{directory}/candidate_pairs.tsv", spine, targets)
    if found := findings.collect():
        raise ValueError(f"what was written doesn't validate: {found[:3]}")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_pair_texts(pairs: DataFrame, path: str) -> str:
    """Pairs as a pair scorer reads them; returns a digest that doesn't depend on their order."""
    texts = pairs.select(
        F.col("s1_id").alias("source1_entity_id"),
        F.col("target_id").alias("target_entity_id"),
        pair_text("name", "address", "country", "A").alias("text_a"),
        pair_text("target_name", "target_address", "target_country", "B").alias("text_b"),
    )
    texts.write.json(path)
    return table_digest(texts)


def table_digest(rows: DataFrame) -> str:
    """SHA-256 over the count and the summed hashes of rows: the same for any order or partitioning."""
    h = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    return hashlib.sha256(repr(tuple(rows.agg(F.count("*"), *parts).first())).encode()).hexdigest()


def append_experiment(spark, path: str, row: dict) -> None:  # noqa: ANN001
    """Add a row to a table of experiments."""
    spark.createDataFrame([{k: str(v) for k, v in row.items()}]).write.mode("append").json(path)


def experiment_summary(spark, path: str, by: str = "name", best: str = "macro_f05") -> DataFrame:  # noqa: ANN001
    """The best row of each experiment of a log, and how many it has; of equals that with the greatest text."""
    rows = spark.read.json(path)
    top = rows.groupBy(by).agg(F.max(F.struct(F.col(best).cast("double").alias("score"), F.struct(*rows.columns).alias("row"))).alias("x"), F.count("*").alias("runs"))
    return top.select("x.row.*", "runs")


def write_manifest(path: str, spark=None, inputs: dict[str, str] | None = None, commit: str | None = None, **facts: object) -> dict:  # noqa: ANN001
    """Facts, digests of the lines of input files, a commit, versions and the time as JSON, in a file that mustn't exist."""
    manifest = {"created": datetime.now(UTC).isoformat(), "commit": commit, "python": platform.python_version(), "inputs": {k: table_digest(spark.read.text(v)) for k, v in (inputs or {}).items()}, **facts}
    if spark is not None:
        manifest["spark"] = spark.version
    with open(path, "x") as f:
        json.dump(manifest, f, indent=1, sort_keys=True, default=str)
    return manifest


def package(spark, directory: str, spine: DataFrame, targets: DataFrame, out: str) -> str:  # noqa: ANN001
    """A zip of a validated output folder, refused on any finding; returns its SHA-256."""
    if found := official_findings(spark, f"{directory}/matching_results.tsv", f"{directory}/candidate_pairs.tsv", spine, targets).collect():
        raise ValueError(f"the output doesn't validate: {found[:3]}")
    with zipfile.ZipFile(out, "x", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(Path(directory).rglob("*")):
            if f.is_file() and not f.name.startswith((".", "_")):
                z.write(f, f.relative_to(directory))
    return hashlib.sha256(Path(out).read_bytes()).hexdigest()
