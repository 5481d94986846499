"""Validation of outputs: errors raised before writing, and findings as a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.sources.staging import stage

HEADERS = {"matching": ("source1_entity_id", "matched_entity_ids"), "candidate": ("source1_entity_id", "candidate_entity_ids")}


def _any(rows: DataFrame) -> bool:
    return bool(rows.limit(1).count())


def require_submission(spine: DataFrame, targets: DataFrame, candidates: DataFrame, lists: DataFrame) -> None:
    """Raise unless candidates are distinct and known, and lists(s1_id, ids) cover every record once with distinct candidates of its own."""
    ids = targets.select(F.col("entity_id").alias("target_id"))
    if _any(candidates.groupBy("s1_id", "target_id").count().where("count > 1")):
        raise ValueError("a candidate pair is there twice")
    if _any(candidates.join(spine, "s1_id", "left_anti")) or _any(candidates.join(ids, "target_id", "left_anti")):
        raise ValueError("candidates with ids that no record has")
    if _any(lists.groupBy("s1_id").count().where("count > 1")) or _any(lists.join(spine, "s1_id", "left_anti")) or _any(spine.join(lists, "s1_id", "left_anti")):
        raise ValueError("each reference record needs one row of output")
    if _any(lists.where(F.col("ids").isNull() | (F.size("ids") != F.size(F.array_distinct("ids"))))):
        raise ValueError("a record has a match twice")
    if _any(not_contained(lists.select("s1_id", F.explode("ids").alias("target_id")), candidates)):
        raise ValueError("a match is no candidate")


def not_contained(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that aren't candidates."""
    return matches.select("s1_id", "target_id").join(candidates, ["s1_id", "target_id"], "left_anti")


FINDINGS = "file string, level string, rule string, n long, examples string"


def _summary(file: str, events: DataFrame, level: str = "error") -> DataFrame:
    """A row (file, level, rule, n, examples) for each rule of events(rule, id): how many ids, and the first five. No task gathers a rule's ids."""
    each = stage(events.distinct())
    first = Window.partitionBy("rule").orderBy("id")
    least = each.withColumn("nth", F.row_number().over(first)).where("nth <= 5").groupBy("rule").agg(F.concat_ws(",", F.array_sort(F.collect_list("id"))).alias("examples"))
    return each.groupBy("rule").agg(F.count("*").alias("n")).join(least, "rule").select(F.lit(file).alias("file"), F.lit(level).alias("level"), "rule", "n", "examples")


def list_findings(file: str, rows: DataFrame, spine: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """What is wrong with rows(s1_id, ids): repeated rows or ids, reference ids, other prefixes, unknown targets, missing and unknown records.

    A join with the spine tells of records, one with the targets of ids; what they find is counted in one aggregate.
    """
    rows = stage(rows.select("s1_id", "ids"))
    per = rows.groupBy("s1_id").agg(F.count("*").alias("times"), F.count_if(F.size("ids") != F.size(F.array_distinct("ids"))).alias("repeats"))
    both = per.join(spine.select("s1_id").distinct().withColumn("known", F.lit(True)), "s1_id", "full_outer")
    rule = lambda test, name: F.when(test, F.lit(name))
    of_rows = [rule(F.col("times") > 1, "duplicate_row"), rule(F.col("repeats") > 0, "repeated_id"), rule(F.col("times").isNull(), "missing_record"), rule(F.col("known").isNull(), "unknown_record")]
    events = both.select(F.explode(F.array_compact(F.array(*of_rows))).alias("rule"), F.col("s1_id").alias("id"))
    each = rows.select(F.explode("ids").alias("id"))
    own, other = F.startswith("id", F.lit("S1-")), ~F.col("id").rlike("^S[123]-")
    events = events.unionByName(each.where(own | other).select(F.when(own, "self_match").otherwise("wrong_prefix").alias("rule"), "id"))
    if targets is not None:
        unknown = each.where(~own & ~other).join(targets.select(F.col("entity_id").alias("id")), "id", "left_anti")
        events = events.unionByName(unknown.select(F.lit("unknown_target").alias("rule"), "id"))
    return _summary(file, events)


def containment_finding(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning with the records that have matches which aren't candidates."""
    return _summary("matching", not_contained(matches, candidates).select(F.lit("not_in_candidates").alias("rule"), F.col("s1_id").alias("id")), "warning")


def _parsed(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame | None, DataFrame]:
    """Rows (s1_id, ids) of a result file, None if its header is wrong, and findings about its form. A missing file of candidates is only a warning."""
    wrong = lambda rule, text="", level="error": spark.createDataFrame([(kind, level, rule, 1, text)], FINDINGS)
    try:
        lines = spark.read.text(path)
        head = lines.limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None, wrong("file_not_found", path, "error" if kind == "matching" else "warning")
    if not head:
        return None, wrong("empty_file")
    header = head[0][0]
    if "\t" not in header and "," in header:
        return None, wrong("comma_separated", header)
    if tuple(c.strip().lower() for c in header.split("\t")) != HEADERS[kind]:
        return None, wrong("header", header)
    # The first line of the file is its header; another like it is a row as any other. The reader's own header option tells them apart.
    body = spark.read.schema("value string").option("header", True).option("sep", "\u0001").option("quote", "").option("enforceSchema", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path).where("value IS NOT NULL")
    no_tab, no_utf8 = ~F.contains("value", F.lit("\t")) & (F.trim("value") != ""), F.contains("value", F.lit("\ufffd"))  # what bytes outside UTF-8 are read as
    rules = F.explode(F.array_compact(F.array(F.when(no_tab, "no_tab"), F.when(no_utf8, "not_utf8")))).alias("rule")
    bad = _summary(kind, body.select(rules, F.col("value").alias("id")))
    cut = body.where(F.contains("value", F.lit("\t"))).select(F.substring_index("value", "\t", 1).alias("s1_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("rest"))
    return cut.select("s1_id", F.when(F.trim("rest") == "", F.array().cast("array<string>")).otherwise(F.split("rest", ",")).alias("ids")), bad


def match_targets(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, DataFrame]:
    """Ids (entity_id) of the target files that are there, None without any, and a warning for each that isn't."""
    from matchloom.sources.readers import read_ids

    found, lost = None, []
    for path in paths:
        try:
            ids = read_ids(spark, path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            lost.append(("targets", "warning", "file_not_found", 1, path))
            continue
        found = ids if found is None else found.unionByName(ids)
    return found, spark.createDataFrame(lost, FINDINGS)


def official_findings(spark: SparkSession, matching: str, candidate: str, spine: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Findings (file, level, rule, n, examples) about two result files; none for a valid pair. Without targets, ids aren't looked up, which is a warning."""
    out, rows = [], {}
    for kind, path in (("matching", matching), ("candidate", candidate)):
        rows[kind], form = _parsed(spark, path, kind)
        out.append(form)
        if rows[kind] is not None:
            out.append(list_findings(kind, rows[kind], spine, targets))
    if all(r is not None for r in rows.values()):
        out.append(containment_finding(*(rows[k].select("s1_id", F.explode("ids").alias("target_id")) for k in ("matching", "candidate"))))
    if targets is None:
        out.append(spark.createDataFrame([("targets", "warning", "ids_not_checked", 1, "")], FINDINGS))
    return reduce(DataFrame.unionByName, out)


def main(arguments: list[str]) -> int:
    """matching_file candidate_file folder_of_records [--check-ids]: prints findings; 0 if there are no errors."""
    from matchloom.sources.readers import read_ids

    spark = SparkSession.builder.getOrCreate()
    matching, candidate, folder = arguments[:3]
    targets, lost = match_targets(spark, [f"{folder}/test_source{n}.tsv" for n in (2, 3)]) if "--check-ids" in arguments else (None, None)
    try:
        spine = read_ids(spark, f"{folder}/test_source1.tsv").withColumnRenamed("entity_id", "s1_id")
        found = official_findings(spark, matching, candidate, spine, targets)
        found = (found if lost is None else found.unionByName(lost)).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"ERROR records: file_not_found: {folder}/test_source1.tsv")
        return 1
    for f in found:
        print(f"{f['level'].upper()} {f['file']}: {f['rule']} ({f['n']}): {f['examples']}")
    return int(any(f["level"] == "error" for f in found))


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
