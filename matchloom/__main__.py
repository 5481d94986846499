"""Command line: python -m matchloom COMMAND. A configuration is JSON with the paths of `train` and `test` (s1, s2, s3; labels of train)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import audit, model, validate
from matchloom.plans import pipeline
from matchloom.sources import readers, sinks
from matchloom.sources.staging import stage


def records(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """entity_id, source, name, address, country and position (the order of the lines) of all three sources, staged."""
    columns = ["entity_id", "source", *(F.col(f"normalized_{c}").alias(c) for c in ("name", "address", "country"))]
    return stage(readers.read_sources(spark, paths).select(*columns, F.monotonically_increasing_id().alias("position")))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("source = 'S1'"), rows.where("source <> 'S1'").drop("position")


def labelled(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = records(spark, config["train"])
    return *split(rows), stage(readers.read_truth(spark, config["train"]["labels"], rows))


def run_audit(spark: SparkSession, a: argparse.Namespace) -> None:
    s1, targets, truth = labelled(spark, readers.load_config(a.config))
    every, spine = s1.drop("position").unionByName(targets), s1.select(F.col("entity_id").alias("s1_id"), "country")
    tables = {"lengths": audit.lengths(every), "missing": audit.missing(every), "countries": audit.countries(every), "links": audit.match_histogram(spine, truth), "classes": audit.match_classes(spine, truth), "shared": audit.shared_targets(truth), "sources": audit.links_by_source(truth)}
    for name, table in tables.items():
        sinks.write_jsonl(table, f"{a.out}/{name}")


def run_baseline(spark: SparkSession, a: argparse.Namespace) -> None:
    config = readers.load_config(a.config)
    model.Gate(a.seconds, a.input_bytes).require_input(spark, list(config["train"].values()))
    s1, targets, truth = labelled(spark, config)
    found = pipeline.baseline(s1, targets, truth, a.k or config.get("candidate_k_per_source", 50), config.get("max_features", 300_000), config.get("seed", 2026))
    sinks.write_scored(found["candidates"], f"{a.out}/train_candidates")
    sinks.write_jsonl(found["slices"], f"{a.out}/slices")
    facts = {k: found[k] for k in ("threshold", "metrics", "coverage")}
    sinks.append_experiment(spark, f"{a.out}/experiments", {"name": "baseline", "threshold": found["threshold"], **found["metrics"]})
    print(json.dumps(facts))


def run_train(spark: SparkSession, a: argparse.Namespace) -> None:
    config = readers.load_config(a.config)
    bundle, report = pipeline.train(*labelled(spark, config), kind=a.kind, neutral_missing=not a.missing_as_zero, edit=not a.no_edit, k=a.k or 20, most=a.cap, iterations=a.iterations, seed=config.get("seed", 2026))
    bundle.save(f"{a.out}/model")
    sinks.append_experiment(spark, f"{a.out}/experiments", {"name": a.kind, "threshold": bundle.threshold, **report})
    print(json.dumps({**report, "threshold": bundle.threshold, "parameters": bundle.parameters()}))


def run_infer(spark: SparkSession, a: argparse.Namespace) -> None:
    config = readers.load_config(a.config)
    pipeline.run(a.out, *split(records(spark, config["test"])), model.Bundle.load(spark, f"{a.model}/model"))


def run_exact(spark: SparkSession, a: argparse.Namespace) -> None:
    """A linear model is JSON with weights of the ten token features, intercept and threshold."""
    with open(a.model) as f:
        linear = json.load(f)
    s1, targets = split(records(spark, readers.load_config(a.config)["test"]))
    found = pipeline.infer_exact(s1, targets, linear["weights"], linear["intercept"], linear["threshold"], a.k or 20)
    found = stage(found)
    sinks.write_submission(a.out, s1.select(F.col("entity_id").alias("s1_id"), "position"), targets, found, found)


def run_package(spark: SparkSession, a: argparse.Namespace) -> None:
    s1, targets = split(records(spark, readers.load_config(a.config)["test"]))
    print(sinks.package(spark, a.out, s1.select(F.col("entity_id").alias("s1_id")), targets, a.zip))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("audit", run_audit), ("baseline", run_baseline), ("train", run_train), ("infer", run_infer), ("exact", run_exact), ("package", run_package)):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("--config", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--k", type=int, help="candidates for each record and source")
        if name == "baseline":
            p.add_argument("--seconds", type=float, default=3600)
            p.add_argument("--input-bytes", type=int, default=500_000_000)
        if name == "train":
            p.add_argument("--kind", choices=("trees", "logistic"), default="trees")
            p.add_argument("--cap", type=int, default=10, help="records that a key may have")
            p.add_argument("--iterations", type=int, default=200)
            p.add_argument("--no-edit", action="store_true")
            p.add_argument("--missing-as-zero", action="store_true")
        if name in ("infer", "exact"):
            p.add_argument("--model", required=True)
        if name == "package":
            p.add_argument("--zip", required=True)
    checks = commands.add_parser("validate")
    checks.add_argument("rest", nargs=argparse.REMAINDER)
    a = parser.parse_args(arguments)
    if a.command == "validate":
        return validate.main(a.rest)
    a.run(SparkSession.builder.getOrCreate(), a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
