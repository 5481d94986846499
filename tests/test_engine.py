"""Small tables with results worked out by hand, round trips, and every query against its SQL."""

import collections
import glob
import itertools
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from matchloom.functions import features, keys, text
from matchloom.operators import audit, blocking, evaluate, model, sampling, tfidf, validate
from matchloom.plans import adapter, pipeline
from matchloom.sources import readers, sinks

SF = "/root/testdata/sf0.001"
RECORD = "entity_id string, source string, name string, address string, country string"
PAIRS = "s1_id string, target_id string"


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list | tuple) else repr(round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return db


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("er_")))
def test_query_equals_sql(spark, db, name):
    want = db.sql(__spark_entry__.oracle_sql()[name])
    columns, rows = want.columns, want.fetchall()
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in rows) == sorted(repr([plain(r[c]) for c in order]) for r in got.collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize(
    ("given", "want"),
    [("Łódź ﬁlm—STUDIO №７", "łódź film studio no7"), ("  A&B  (Hungary) Kft. ", "a b hungary kft"), ("½ price", "1 2 price"), ("Straße 5/B", "straße 5 b"), ("", ""), (None, ""), ("!?", "")],
)
def test_normalize(spark, given, want):
    assert value(spark, text.normalize(F.lit(given))) == want


def test_folding_needs_a_switch(spark, monkeypatch):
    with pytest.raises(RuntimeError):
        text.fold_diacritics(F.lit("ñ"))
    monkeypatch.setattr(text, "DIACRITIC_FOLDING_ENABLED", True)
    assert value(spark, text.fold_diacritics(F.lit("señor Čapek ø"))) == "senor Capek ø"


@pytest.mark.parametrize(
    ("true", "said", "want"),
    [
        ("pqr", "pqr", 1.0),
        ("", "", 1.0),
        ("", "pq", 0.0),
        ("pq", "", 0.0),
        ("pqrs", "pq", 1.25 * 2 / (0.25 * 4 + 2)),  # all right, half found
        ("p", "pqr", 1.25 / (0.25 + 3)),  # one of three right
        ("pq", "rs", 0.0),
    ],
)
def test_f05(spark, true, said, want):
    found = value(spark, evaluate.entity_f05(F.lit(len(true)), F.lit(len(said)), F.lit(len(set(true) & set(said)))))
    assert found == pytest.approx(want)


def test_metrics_by_hand(spark):
    """Four records: found whole, half found, wrongly linked, rightly left alone."""
    spine = spark.createDataFrame([(f"r{i}", "x") for i in range(4)], "s1_id string, country string")
    truth = spark.createDataFrame([("r0", "t1"), ("r1", "t2"), ("r1", "t3")], PAIRS)
    said = spark.createDataFrame([("r0", "t1"), ("r1", "t2"), ("r2", "t9")], PAIRS)
    row = evaluate.evaluate(spine, truth, said).first()
    half = 1.25 / (0.25 * 2 + 1)
    assert row["macro_f05"] == pytest.approx((1 + half + 0 + 1) / 4)
    assert (row["precision"], row["recall"], row["singleton_f05"], row["multi_match_f05"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5, pytest.approx(half))
    cover = evaluate.coverage(evaluate.counts_by_entity(spine, truth, said)).first()
    assert (cover["candidate_pair_recall"], cover["entity_complete_coverage"], cover["matched_entity_complete_coverage"]) == (pytest.approx(2 / 3), 0.75, 0.5)
    with pytest.raises(ValueError, match="unknown"):
        evaluate.evaluate(spine, truth, spark.createDataFrame([("r9", "t1")], PAIRS))
    targets = spark.createDataFrame([("t1", "S2"), ("t2", "S2"), ("t3", "S3"), ("t9", "S3")], "entity_id string, source string")
    cut = {r["slice"]: r["macro_f05"] for r in evaluate.slices(spine, truth, said, targets).collect()}
    # By S2 records 2 and 3 have no link; by S3 record 1 loses its link and record 2 has a wrong one.
    assert cut == {"ALL": pytest.approx(row["macro_f05"]), "country:x": pytest.approx(row["macro_f05"]), "source:S2": 1.0, "source:S3": 0.5}


def test_threshold_sweep_by_hand(spark):
    spine = spark.createDataFrame([("r0",), ("r1",)], "s1_id string")
    truth = spark.createDataFrame([("r0", "t0")], PAIRS)
    scored = spark.createDataFrame([("r0", "t0", 0.72), ("r1", "t1", 0.64)], f"{PAIRS}, score double")
    best, tried = evaluate.select_threshold(spine, truth, scored)
    assert best == 0.72  # the greatest that keeps the one and drops the other, in steps of 0.005
    assert dict(tried)[1.000001] == 0.5
    nothing = spark.createDataFrame([], PAIRS)
    assert evaluate.select_threshold(spine, nothing, scored)[0] > 1


def test_splits_and_samples(spark):
    ids = spark.createDataFrame([(f"S1-{i}",) for i in range(60)], "s1_id string")
    first, again = (sorted(sampling.grouped_split(t).collect()) for t in (ids, ids.repartition(5)))
    assert first == again
    assert len(first) == 60
    assert {r["split"] for r in first} == {"train", "validation"}
    with pytest.raises(ValueError, match="five"):
        sampling.grouped_split(ids.limit(4))
    some = sampling.sample(ids, 20)
    rest = sampling.sample(ids, 40, 7, without=some)
    assert some.unionByName(rest).distinct().count() == 60
    lengths = spark.createDataFrame([(i, "x" * (i * i)) for i in range(9)], "k int, t string")
    assert sorted(r["k"] for r in sampling.spaced_by_length(lengths, F.length("t"), 5, "k").collect()) == [0, 2, 4, 6, 8]


def test_keys_meet(spark):
    """Words in another order, a legal form more, and a number in the address in common."""
    frequency = spark.createDataFrame([("kestrel", 2), ("marine", 5), ("group", 40)], "token string, df long")
    query = spark.createDataFrame([("S1-1", "kestrel marine group", "7 quay")], "entity_id string, name string, address string")
    asked = {r["key"] for r in blocking.reference_keys(query, frequency, by_address=False).select("key").collect()}
    meets = lambda name, address: asked & set(value(spark, keys.target_keys(F.lit(name), F.lit(address))))
    assert meets("marine kestrel", "") == {keys.SEP.join(("p", "kestrel", "marine"))}
    assert meets("kestrel boats", "7 harbour") == {keys.SEP.join(("a", "kestrel", "7"))}
    assert not meets("marine group", "quay")


def test_features_by_hand(spark):
    """Two of four words of the names in common, one of the two numbers, the same country."""
    c = [F.lit(x) for x in ("blue fern tea", "8 mill lane 40", "fiji", "blue fern coffee", "8 mill road", "fiji")]
    found = features.token_features(*c)
    got = value(spark, F.array(*[found[n].cast("double") for n in features.TOKEN_FEATURES]))
    want = {"name_jaccard": 2 / 4, "address_jaccard": 2 / 5, "name_exact": 0, "address_exact": 0, "numeric_jaccard": 1 / 2, "numeric_conflict": 0, "country_match": 1, "name_length_ratio": 13 / 16, "address_length_ratio": 11 / 14, "address_missing": 0}
    assert dict(zip(features.TOKEN_FEATURES, got, strict=True)) == pytest.approx(want)
    clash = features.token_features(F.lit("fern"), F.lit("3 elm"), F.lit("a"), F.lit("fern"), F.lit("9 elm"), F.lit("b"))
    assert value(spark, clash["numeric_conflict"]) == 1
    gone = features.token_features(F.lit("fern"), F.lit("3 elm"), F.lit("a"), F.lit("fern"), F.lit(""), F.lit("a"), neutral_missing=True)
    shown = dict(zip(features.TOKEN_FEATURES, value(spark, F.array(*[gone[n].cast("double") for n in features.TOKEN_FEATURES])), strict=True))
    assert {k for k, v in shown.items() if v is None} == features.NEUTRAL
    assert (shown["address_missing"], shown["name_exact"]) == (1, 1)
    edit = features.edit_features(F.lit("fern"), F.lit(""), F.lit("ferns"), F.lit("3 elm"))
    assert value(spark, F.array(*[edit[n] for n in features.EDIT_FEATURES])) == pytest.approx([4 / 5, 0, 8 / 9, 0, 8 / 9, 0])
    neutral = features.edit_features(F.lit("fern"), F.lit(""), F.lit("ferns"), F.lit("3 elm"), neutral_missing=True)
    assert [k for k, v in zip(features.EDIT_FEATURES, value(spark, F.array(*[neutral[n] for n in features.EDIT_FEATURES])), strict=True) if v is None] == [n for n in features.EDIT_FEATURES if n.startswith("address")]


def test_ratios_by_hand():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    words = ["", "a", "granite", "grafted", "aabab", "babaa"]
    for a, b in itertools.product(words, words):
        assert features.common_subsequence(a, b) == slow(a, b)
        want = max((200 * slow(a, b[i : i + n]) / (len(a) + len(b[i : i + n])) for i in range(len(b) + 1) for n in [len(a)]), default=0) if a and len(a) <= len(b) else None
        assert want is None or features.partial_ratio(a, b) >= want - 1e-9
    assert features.token_sort_ratio("stone mill", "mill stone") == 100
    assert features.token_set_ratio("stone mill", "mill stone works") == 100
    assert features.token_sort_ratio("stone", "stony") == pytest.approx(80)
    assert features.weighted_ratio("stone mill", "mill stone") == pytest.approx(95)  # in another order counts a little less
    assert (features.weighted_ratio("", "x"), features.ratio("", "")) == (0, 100)
    assert features.weighted_ratio("mill", "the old mill by the stone bridge") == pytest.approx(90)  # a part of the longer


def _records(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_retrieve_and_write(spark, tmp_path):
    s1 = _records(spark, [("S1-7", "S1", "osaka lamp works", "4 bay", "japan"), ("S1-8", "S1", "", "", "")])
    targets = _records(spark, [("S2-1", "S2", "osaka lamp works", "4 bay", "japan"), ("S2-2", "S2", "osaka clock works", "4 bay", "japan"), ("S3-1", "S3", "osaka lamp works", "4 bay", ""), ("S3-2", "S3", "zzz", "", "")])
    as_text = lambda t: t.select("entity_id", "source", F.concat_ws(" ", "name", "address").alias("text"))
    found = tfidf.retrieve(as_text(s1), as_text(targets), 1)
    assert {(r["s1_id"], r["target_id"], r["score"]) for r in found.collect()} == {("S1-7", "S2-1", 1.0), ("S1-7", "S3-1", 1.0)}
    spine = spark.createDataFrame([("S1-8", 0), ("S1-7", 1)], "s1_id string, position int")
    sinks.write_submission(str(tmp_path / "out"), spine, targets, found, found.where("target_source = 'S3'"))
    for name in ("candidate_pairs", "matching_results"):
        sinks.concatenate(f"{tmp_path}/out/{name}.tsv", f"{tmp_path}/{name}")
    assert (tmp_path / "candidate_pairs").read_text() == "source1_entity_id\tcandidate_entity_ids\nS1-8\t\nS1-7\tS2-1,S3-1\n"
    assert (tmp_path / "matching_results").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-8\t\nS1-7\tS3-1\n"
    with pytest.raises(ValueError, match="no candidate"):
        sinks.write_submission(str(tmp_path / "bad"), spine, targets, found, spark.createDataFrame([("S1-8", "S2-1")], PAIRS))
    assert len(sinks.package(spark, f"{tmp_path}/out", spine, targets, str(tmp_path / "out.zip"))) == 64
    with pytest.raises(ValueError, match="at least 1"):
        tfidf.retrieve(as_text(s1), as_text(targets), 0)


def test_many_output_files_are_one_order(spark, tmp_path):
    """Outputs are sorted ranges in files of their own, whose headers are no rows."""
    lists = spark.range(3000).select(F.format_string("S1-%05d", F.lit(2999) - F.col("id")).alias("source1_entity_id"), F.lit("").alias("matched_entity_ids"), "id").withColumnRenamed("id", "position")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_lists(lists, f"{tmp_path}/m.tsv")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(glob.glob(f"{tmp_path}/m.tsv/part-*")) > 1
    sinks.concatenate(f"{tmp_path}/m.tsv", f"{tmp_path}/one")
    assert [x.split("\t")[0] for x in (tmp_path / "one").read_text().splitlines()[1:]] == [f"S1-{i:05d}" for i in range(2999, -1, -1)]
    rows, _ = validate._parsed(spark, f"{tmp_path}/m.tsv", "matching")
    assert rows.count() == 3000


def test_official_findings(spark, tmp_path):
    spine, targets = spark.createDataFrame([("S1-3",), ("S1-4",)], "s1_id string"), spark.createDataFrame([("S2-5",)], "entity_id string")
    good, bad, comma = tmp_path / "good.tsv", tmp_path / "bad.tsv", tmp_path / "comma.tsv"
    good.write_text("source1_entity_id\tcandidate_entity_ids\nS1-3\tS2-5\nS1-4\t\n")
    bad.write_text("source1_entity_id\tmatched_entity_ids\nS1-3\tS2-5,S2-5,S1-0,Q\nS1-3\tS2-6\nbroken\nsource1_entity_id\tmatched_entity_ids\n")
    comma.write_text("source1_entity_id,matched_entity_ids\n")
    found = {(r["file"], r["rule"]): (r["level"], r["n"], r["examples"]) for r in validate.official_findings(spark, str(bad), str(good), spine, targets).collect()}
    assert found["matching", "no_tab"] == ("error", 1, "broken")
    assert found["matching", "unknown_record"] == ("error", 1, "source1_entity_id")  # a second header is a row
    assert found["matching", "missing_record"] == ("error", 1, "S1-4")
    assert found["matching", "not_in_candidates"][0] == "warning"
    assert {r for f, r in found if f == "matching"} == {"no_tab", "duplicate_row", "repeated_id", "self_match", "wrong_prefix", "missing_record", "unknown_record", "unknown_target", "not_in_candidates"}
    form = {(r["level"], r["rule"]) for r in validate.official_findings(spark, str(comma), f"{tmp_path}/none", spine).collect()}
    assert form == {("error", "comma_separated"), ("warning", "file_not_found"), ("warning", "ids_not_checked")}
    assert {(r["level"], r["rule"]) for r in validate.official_findings(spark, f"{tmp_path}/none", str(good), spine, targets).collect()} == {("error", "file_not_found")}


def test_validator_command(spark, tmp_path, capsys):
    for n in (1, 2):
        (tmp_path / f"test_source{n}.tsv").write_text(f"entity_id\tbusiness_name\nS{n}-1\tx\n")
    (tmp_path / "m").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n")
    (tmp_path / "c").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\n")
    assert validate.main([f"{tmp_path}/m", f"{tmp_path}/c", str(tmp_path), "--check-ids"]) == 0
    assert "test_source3.tsv" in capsys.readouterr().out  # a file that isn't there is a warning
    (tmp_path / "m").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-2\n")
    assert validate.main([f"{tmp_path}/m", f"{tmp_path}/c", str(tmp_path), "--check-ids"]) == 1
    (tmp_path / "test_source1.tsv").unlink()
    assert validate.main([f"{tmp_path}/m", f"{tmp_path}/c", str(tmp_path)]) == 1
    ids, lost = validate.match_targets(spark, [f"{tmp_path}/none"])
    assert ids is None
    assert lost.count() == 1


def test_sources_and_labels(spark, tmp_path):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for n, ids in (("s1", ("S1-p", "S1-q")), ("s2", ("S2-m",)), ("s3", ("S3-n",))):
        (tmp_path / f"{n}.tsv").write_text(head + "".join(f'{i}\t"The ""Oak"" Inn"\t\tPT\n' for i in ids))
    paths = {n: f"{tmp_path}/{n}.tsv" for n in ("s1", "s2", "s3")}
    sources = readers.read_sources(spark, paths)
    assert {(r["normalized_name"], r["business_address"]) for r in sources.collect()} == {("the oak inn", "")}
    labels = tmp_path / "truth.tsv"
    cases = [('S1-p\t["S2-m"]\n', "one label row"), ("S1-p\tS2-m,S2-m\nS1-q\t\n", "twice"), ("S1-p\tS2-z\nS1-q\t\n", "unknown target"), ("S1-p\t \nS1-q\t\n", "malformed"), ("S1-p\t[1]\nS1-q\t\n", "malformed"), ("S1-p\tS2-m\nS1-p\t\nS1-q\t\n", "repeated")]
    for body, message in cases:
        labels.write_text("source1_entity_id\tmatched_entity_ids\n" + body)
        with pytest.raises(ValueError, match=message):
            readers.read_truth(spark, str(labels), sources)
    labels.write_text('source1_entity_id\tmatched_entity_ids\nS1-p\tS2-m,S3-n\nS1-q\t\n')
    assert readers.read_truth(spark, str(labels), sources).count() == 2
    with pytest.raises(ValueError, match="lacks"):
        readers.read_tsv(spark, str(labels), ("entity_id",))
    assert {r["entity_id"] for r in readers.read_ids(spark, paths["s1"]).collect()} == {"S1-p", "S1-q"}
    (tmp_path / "s2.tsv").write_text(head + "S1-p\tx\ty\tz\n")
    with pytest.raises(ValueError, match="two sources"):
        readers.read_sources(spark, paths)
    (tmp_path / "lines.tsv").write_text('a\tb\n"one\ntwo"\tx\n')
    assert [r["a"] for r in readers.read_tsv(spark, f"{tmp_path}/lines.tsv", quoted_lines=True).collect()] == ["one\ntwo"]
    (tmp_path / "odd.tsv").write_text("a\tb\n1\t2\n1\n1\t2\t3\n")
    assert readers.malformed(spark, f"{tmp_path}/odd.tsv") == 2


def test_files_beside_the_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"seed": 4, "train": {"s1": "a.tsv"}, "test": {"s1": "/abs/b.tsv"}}))
    config = readers.load_config(f"{tmp_path}/c.json")
    assert (config["seed"], config["train"]["s1"], config["test"]["s1"]) == (4, f"{tmp_path}/a.tsv", "/abs/b.tsv")
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    made = sinks.write_manifest(f"{tmp_path}/m.json", spark, {"s1": f"{tmp_path}/a.tsv"}, commit="abc", threshold=0.5)
    assert json.loads((tmp_path / "m.json").read_text()) == made
    assert (made["commit"], made["threshold"], len(made["inputs"]["s1"])) == ("abc", 0.5, 64)
    with pytest.raises(FileExistsError):
        sinks.write_manifest(f"{tmp_path}/m.json")
    for name, score in (("a", 0.4), ("a", 0.6), ("b", 0.5)):
        sinks.append_experiment(spark, f"{tmp_path}/log", {"name": name, "macro_f05": score})
    assert {(r["name"], r["macro_f05"], r["runs"]) for r in sinks.experiment_summary(spark, f"{tmp_path}/log").collect()} == {("a", "0.6", 2), ("b", "0.5", 1)}
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, t string")
    assert sinks.table_digest(a) == sinks.table_digest(a.orderBy(F.desc("i")).repartition(3)) != sinks.table_digest(a.limit(1))


def test_scores_must_cover_the_pairs(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "source1_entity_id string, target_entity_id string")
    cases = [([0.5, 0.25], None), ([0.5], "cover"), ([0.5, 1.5], "finite"), ([0.5, 0.5, 0.5], "repeated")]
    for n, (scores, message) in enumerate(cases):
        rows = [("a", "bcc"[i], x) for i, x in enumerate(scores)]
        sinks.write_jsonl(spark.createDataFrame(rows, readers.SCORES), f"{tmp_path}/{n}")
        if message:
            with pytest.raises(ValueError, match=message):
                readers.import_scores(spark, f"{tmp_path}/{n}", pairs)
        else:
            assert readers.import_scores(spark, f"{tmp_path}/{n}", pairs).count() == 2
    with pytest.raises(ValueError, match="other pairs"):
        readers.import_scores(spark, f"{tmp_path}/0", pairs, {"pairs_sha256": "x"}, "y")
    with pytest.raises(ValueError, match="other pairs"):
        readers.aligned(spark.createDataFrame([("a", "b")], PAIRS), spark.createDataFrame([("a", "c", 1.0)], f"{PAIRS}, x double"))


def test_gates(spark, tmp_path):
    model.require_compliant("mit", 568_000_000)
    for licence, n in (("gpl", 5), ("mit", None), ("mit", 9_000_000_000), (None, 5)):
        with pytest.raises(ValueError, match="can't be used"):
            model.require_compliant(licence, n)
    (tmp_path / "big").write_bytes(b"x" * 1000)
    assert model.Gate(10, 1000).require_input(spark, [f"{tmp_path}/big"]) == 1000
    with pytest.raises(ValueError, match="1000 bytes"):
        model.Gate(10, 999).require_input(spark, [f"{tmp_path}/big"])
    gate = model.Gate(100, began=0.0)
    assert gate.require_pace(10, 50, now=20.0) == 100.0
    for done, now in ((10, 20.1), (50, 101.0)):
        with pytest.raises(TimeoutError):
            gate.require_pace(done, 50, now=now)
    old = {"macro_f05": 0.5, "singleton_f05": 0.6}
    assert model.keeps({"macro_f05": 0.51, "singleton_f05": 0.59}, old)
    assert not model.keeps({"macro_f05": 0.51, "singleton_f05": 0.57}, old)
    assert not model.keeps({"macro_f05": 0.5, "singleton_f05": 0.9}, old)
    clean = spark.createDataFrame([(0, 0)], "a int, b int")
    audit.require_clean(clean)
    with pytest.raises(ValueError, match="'b': 2"):
        audit.require_clean(spark.createDataFrame([(0, 2)], "a int, b int"))
    bad = model.score_pairs(spark.createDataFrame([("a", "b")], "text_a string, text_b string"), lambda: lambda a, b: [2.0] * len(a))
    with pytest.raises(Exception, match="from 0 to 1"):
        bad.collect()


def _town(spark):
    """Records of three sources; every fourth of the first has no link."""
    rows = [(f"S{s}-{i}", f"S{s}", f"harbour {i} traders", f"{i} wharf" if i % 4 or s == 1 else f"{i} other pier", "chile" if i % 3 else "peru") for s in (1, 2, 3) for i in range(48)]
    records = _records(spark, rows)
    s1, targets = records.where("source = 'S1'"), records.where("source <> 'S1'")
    truth = spark.createDataFrame([(f"S1-{i}", f"S{s}-{i}") for s in (2, 3) for i in range(48) if i % 4], PAIRS)
    return s1, targets, s1.select(F.col("entity_id").alias("s1_id"), "country"), truth


def test_end_to_end(spark, tmp_path):
    s1, targets, spine, truth = _town(spark)
    assert audit.match_classes(spine, truth).first().asDict() == {"zero": 12, "one": 0, "many": 36}
    assert audit.shared_targets(truth).first()["shared"] == 0
    bundle, report = pipeline.train(s1, targets, truth, iterations=5)
    assert report["macro_f05"] > 0.8
    facts = model.describe(bundle)
    assert facts["parameters"] == bundle.parameters() > 0
    bundle.save(f"{tmp_path}/model")
    again = model.Bundle.load(spark, f"{tmp_path}/model", edit=True, k=blocking.TOP_K)
    with pytest.raises(ValueError, match="fitted with"):
        model.Bundle.load(spark, f"{tmp_path}/model", edit=False)
    candidates, matches = pipeline.infer(s1, targets, again)
    assert matches.join(truth, ["s1_id", "target_id"], "left_semi").count() > 40
    ordered = s1.withColumn("position", F.substring("entity_id", 4, 9).cast("int"))
    pipeline.run(f"{tmp_path}/out", ordered, targets, again)
    lines = readers.read_tsv(spark, f"{tmp_path}/out/matching_results.tsv")
    assert lines.count() == 48
    assert lines.select(F.explode(readers.id_list(F.col("matched_entity_ids")))).count() == matches.count()
    exact = pipeline.infer_exact(s1, targets, [0.0, 0.0, 1.0, 1.0, *[0.0] * 6], -1.5, 0.5)
    same = s1.select(F.col("entity_id").alias("s1_id"), "name", "address").join(targets.select(F.col("entity_id").alias("target_id"), "name", "address"), ["name", "address"])
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, same.select("s1_id", "target_id").collect()))
    assert math.isfinite(pipeline.baseline(s1, targets, truth, 2)["threshold"])
    assert readers.same_pairs(candidates, blocking.candidates(s1, targets).select("s1_id", "target_id"))


def test_logistic_equals_its_folded_score(spark):
    s1, targets, spine, truth = _town(spark)
    pairs = features.with_features(blocking.candidates(s1, targets), edit=False)
    bundle = model.fit(model.labelled(pairs, truth), list(features.TOKEN_FEATURES), "logistic")
    assert bundle.parameters() == 11
    _, scaler, last = bundle.model.stages
    scales = [x or 1.0 for x in scaler.std.toArray()]
    coefficients = [c if s else 0.0 for c, s in zip(last.coefficients.toArray(), scaler.std.toArray(), strict=True)]
    weights, constant = features.linear_weights(coefficients, last.intercept, scaler.mean.toArray(), scales)
    plain_score = features.logistic_score(features.TOKEN_FEATURES, weights, constant)
    for r in bundle.score(pairs.withColumn("by_hand", plain_score)).collect():
        assert r["score"] == pytest.approx(r["by_hand"], abs=1e-6)
    _, away = model.transfer(pairs, spine, truth, "chile", list(features.TOKEN_FEATURES), "logistic")
    assert away.first()["macro_f05"] > 0.5


def test_trees_equal_a_walk_through_their_nodes(spark):
    """Scores of boosted trees from the trees' printed form: the sum of weighted leaves through the logistic function."""
    import re

    rows = __spark_entry__.queries()["er_pair_features"](spark, SF).limit(60).withColumn("label", (F.col("name_jaccard") + F.col("address_jaccard") > 0.6).cast("double"))
    names = list(features.TOKEN_FEATURES)
    bundle = model.fit(rows, names, "trees", iterations=4)
    trees = bundle.model.stages[-1]

    def walk(lines, x):
        """lines: (depth, text). The branch taken, down to a leaf."""
        depth, line = lines[0]
        if m := re.match(r"Predict: (\S+)", line):
            return float(m[1])
        k, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        other = next(i for i, (d, t) in enumerate(lines) if d == depth and t.startswith("Else"))
        return walk(lines[1:other] if x[int(k)] <= float(limit) else lines[other + 1 :], x)

    parts = re.split(r"\n\s*Tree \d+ \(weight (\S+)\):\n", trees.toDebugString)
    forest = [(float(w), [(len(t) - len(t.lstrip()), t.strip()) for t in body.splitlines() if t.strip()]) for w, body in zip(parts[1::2], parts[2::2], strict=True)]
    assert len(forest) == 4
    for r in bundle.score(rows).collect():
        margin = sum(w * walk(lines, [r[c] for c in names]) for w, lines in forest)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-2 * margin)), abs=1e-9)


def test_levenshtein_counts_letters(spark):
    """Letters outside ASCII are one each, as the SQL's recoded names have them."""
    assert value(spark, features.levenshtein_similarity(F.lit("größe"), F.lit("grosse"))) == pytest.approx(1 - 3 / 6)
    assert value(spark, features.levenshtein_similarity(F.lit("né"), F.lit("ne"))) == 0.5


def test_records_read_whole_texts(spark, tmp_path):
    """Texts that differ only far from their beginning are different records."""
    common = " ".join(f"w{i}" for i in range(400))
    rows = [(3, f"{common} cedar", "en"), (4, f"{common} birch", "en"), (6, f"{common} birch", "en"), (7, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["entity_id"]: (r["name"], r["address"]) for r in adapter.documents(spark, str(tmp_path)).collect()}
    assert found["S1-3"] != found["S2-4"] == found["S1-6"]
    assert found["S2-7"] == ("", "")


def test_stream_equals_batch(spark, tmp_path):
    from matchloom.streaming import scoring

    s1, targets = adapter.split(adapter.documents(spark, SF))
    targets.write.parquet(f"{tmp_path}/in")
    index = blocking.capped(blocking.reference_keys(s1)).select(F.col("entity_id").alias("s1_id"), "key")
    stream = spark.readStream.schema(targets.schema).parquet(f"{tmp_path}/in")
    query = scoring.keep_best(scoring.candidate_stream(stream, s1, index), f"{tmp_path}/out", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    pick = lambda t: sorted(map(tuple, t.select("s1_id", "target_id", "blocking_rank").collect()))
    last = max(glob.glob(f"{tmp_path}/out/batch=*"), key=lambda f: int(f.rpartition("=")[2]))
    assert pick(spark.read.parquet(last)) == pick(blocking.candidates(s1, targets))


def test_command_line(spark, tmp_path, capsys):
    """Train on labelled files, infer on others, validate and pack what comes out; and the other commands."""
    from matchloom.__main__ import main

    for part in ("train", "test"):
        for s in (1, 2, 3):
            rows = [f"S{s}-{i}\tHarbour {i} Traders\t{i if i % 4 or s == 1 else 900 + i} Wharf\t{'Chile' if i % 3 else 'Peru'}\n" for i in range(40, 0, -1)]
            (tmp_path / f"{part}{s}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(rows))
    (tmp_path / "labels.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{f'S2-{i},S3-{i}' if i % 4 else ''}\n" for i in range(1, 41)))
    config = {part: {f"s{s}": f"{part}{s}.tsv" for s in (1, 2, 3)} for part in ("train", "test")}
    config["train"]["labels"] = "labels.tsv"
    (tmp_path / "c.json").write_text(json.dumps(config))
    common = ["--config", f"{tmp_path}/c.json"]
    assert main(["train", *common, "--out", f"{tmp_path}/run", "--iterations", "3", "--k", "2"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["macro_f05"] > 0.8
    assert main(["infer", *common, "--out", f"{tmp_path}/out", "--model", f"{tmp_path}/run"]) == 0
    assert main(["package", *common, "--out", f"{tmp_path}/out", "--zip", f"{tmp_path}/out.zip"]) == 0
    for name in ("matching_results", "candidate_pairs"):
        sinks.concatenate(f"{tmp_path}/out/{name}.tsv", f"{tmp_path}/{name}.tsv")
    assert [x.split("\t")[0] for x in (tmp_path / "matching_results.tsv").read_text().splitlines()[1:]] == [f"S1-{i}" for i in range(40, 0, -1)]
    for s in (1, 2, 3):
        (tmp_path / f"test_source{s}.tsv").write_text((tmp_path / f"test{s}.tsv").read_text())
    assert main(["validate", f"{tmp_path}/matching_results.tsv", f"{tmp_path}/candidate_pairs.tsv", str(tmp_path), "--check-ids"]) == 0
    (tmp_path / "linear.json").write_text(json.dumps({"weights": [0, 0, 1, 1, 0, 0, 0, 0, 0, 0], "intercept": -1.5, "threshold": 0.5}))
    assert main(["exact", *common, "--out", f"{tmp_path}/exact", "--model", f"{tmp_path}/linear.json"]) == 0
    assert readers.read_tsv(spark, f"{tmp_path}/exact/matching_results.tsv").where("matched_entity_ids <> ''").count() == 30
    assert main(["audit", *common, "--out", f"{tmp_path}/audit"]) == 0
    assert spark.read.json(f"{tmp_path}/audit/classes").first().asDict() == {"zero": 10, "many": 30, "one": 0}
    assert main(["baseline", *common, "--out", f"{tmp_path}/base", "--k", "2"]) == 0
    with pytest.raises(ValueError, match="bytes of input"):
        main(["baseline", *common, "--out", f"{tmp_path}/big", "--input-bytes", "10"])


def test_bytes_outside_utf8_are_a_finding(spark, tmp_path):
    (tmp_path / "m").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-\xff\n")
    (tmp_path / "c").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\t\n")
    spine = spark.createDataFrame([("S1-1",)], "s1_id string")
    assert "not_utf8" in {r["rule"] for r in validate.official_findings(spark, f"{tmp_path}/m", f"{tmp_path}/c", spine).collect()}


def _cosine_by_hand(texts, fit):
    """A function of two texts: the cosine of their weighted grams, worked out with dictionaries."""
    count = lambda t: collections.Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1))
    df = collections.Counter(g for t in fit for g in count(t))
    raw = {t: {g: n * (math.log((1 + len(fit)) / (1 + df[g])) + 1) for g, n in count(t).items() if g in df} for t in texts}
    norm = {t: math.sqrt(sum(x * x for x in w.values())) for t, w in raw.items()}
    return lambda a, b: sum(x * raw[b].get(g, 0) for g, x in raw[a].items()) / (norm[a] * norm[b]) if norm[a] and norm[b] else 0.0


def test_cosines_fit_on_all_targets_and_send_blocks(spark, monkeypatch):
    """Without a bound every target of a pair is fitted on; no row for each gram of a record passes a shuffle, whatever characters the texts have."""
    monkeypatch.setattr(tfidf, "PAIRS", 3)
    names = ["osaka lamp works", "", "ab", "łódź 𝒳𝒴𝒵 works", "aaaaaaa", "osaka lamp works", "".join(map(chr, range(0x4E00, 0x4E00 + 9000))), "lamp"]
    s1 = _records(spark, [(f"S1-{i}", "S1", n, f"{i} bay road", "") for i, n in enumerate(names)])
    targets = _records(spark, [(f"S2-{i}", "S2", n, f"{i % 3} bay street", "") for i, n in enumerate(reversed(names))] + [("S2-99", "S2", "in no pair, lamp", "bay", "")])
    pairs = spark.createDataFrame([(f"S1-{i}", f"S2-{j}", i * j) for i in range(8) for j in range(8) if (i + j) % 3], f"{PAIRS}, extra int")
    found = tfidf.with_cosines(pairs, s1, targets, None, None)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r["entity_id"]: {"name_cosine": r["name"], "address_cosine": r["address"], "combined_cosine": f"{r['name']} {r['address']}"} for r in s1.union(targets).collect()}
    got = found.collect()
    assert len(got) == pairs.count() and all(r["extra"] == int(r["s1_id"][3:]) * int(r["target_id"][3:]) for r in got)
    for field in ("name_cosine", "address_cosine", "combined_cosine"):
        cosine = _cosine_by_hand({x[field] for x in rows.values()}, [x[field] for n, x in rows.items() if n != "S2-99"])
        assert [r[field] for r in got] == pytest.approx([cosine(rows[r["s1_id"]][field], rows[r["target_id"]][field]) for r in got], abs=1e-9)
    assert [r["name_address_product"] for r in got] == pytest.approx([r["name_cosine"] * r["address_cosine"] for r in got])


def test_retrieve_by_parts_equals_brute_force(spark, monkeypatch):
    """Parts of the queries meet parts of the targets, and texts rather than pairs of gram rows travel; ties, copies, blanks and nulls included."""
    monkeypatch.setattr(tfidf, "TARGETS", 7)
    monkeypatch.setattr(tfidf, "ASKED", 5)
    words = ["lamp", "lump", "lampé", "works", "osaka", "日本語店", "ab", "aaaaaa"]
    names = [f"{a} {b}" for a, b in itertools.product(words, words[:4])] + ["", None, "ab", "osaka works", "osaka works"]
    s1 = [(f"S1-{i}", "S1", n) for i, n in enumerate(names) if i % 2 == 0]
    targets = [(f"S{2 + i % 2}-{i}", f"S{2 + i % 2}", n) for i, n in enumerate(names * 3)]
    frame = lambda rows: spark.createDataFrame(rows, "entity_id string, source string, text string")
    found = tfidf.retrieve(frame(s1), frame(targets), 4, None)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    cosine = _cosine_by_hand({n or "" for n in names}, [n or "" for _, _, n in s1 + targets])
    want = []
    for i, _, a in s1:
        for source in ("S2", "S3"):
            near = sorted((-round(cosine(a or "", b or ""), 6), j) for j, s, b in targets if s == source)
            want += [(i, j, source, -x, rank) for rank, (x, j) in enumerate(near[:4], 1) if x < 0]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
