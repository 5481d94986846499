"""The training-data operators against brute force, round trips, held-out accuracy and odd tables."""

import base64
import glob
import hashlib
import html
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from matchloom.llm import decontaminate, html_extract, lang_id, license_scan, lm_score, near_dedup, packing, quality_classifier, quality_rules, warc
from matchloom.llm.common import FOLD, WordHasher
from matchloom.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, found string, class_id long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def odd_rows():
    """Nulls, empty and repeated rows, ties, no words, a long text; columns whose names operators use themselves."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (1, text), (2, text), (3, text + " thirteen"), (4, None), (5, ""), (6, "... !!!"), (7, "a b"), (None, "lost id " + text), (8, "x" * 20_000), (9, "word " * 30_000), (10, "é" * 50 + "\x1c\x85 <|endoftext|> ½ 你好　世界")]
    return [(i, t, None if i == 7 else "en", None, None if i == 2 else len(t or ""), 0.5, "d", "f", 3) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('odd')}/documents.parquet"
    spark.createDataFrame(odd_rows(), DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(table):
    return {r["doc_id"]: r["text"] for r in table.collect()}


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    columns, rows = want.columns, want.fetchall()
    got = __spark_entry__.queries()[name](spark, SF)
    order = sorted(columns)
    assert sorted(got.columns) == order
    assert sorted(repr([r[columns.index(c)] for c in order]) for r in rows) == sorted(repr([r[c] for c in order]) for r in got.collect())


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n.startswith("op")))
def test_registered_queries_cover_their_table(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    table, key = ("pages", "page_id") if "page_id" in got.columns else ("documents", "doc_id")
    every = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    have = {r[0] for r in got.select(key).collect()}
    assert have <= every if name.startswith("op5_") else have == every


def test_operators_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, ""), (4, "a b")], "item_id long, text string")
    runs = {
        "language": lang_id.train_and_predict,
        "quality": lambda d: quality_classifier.classify(d, labels),
        "dedup": near_dedup.classes,
        "lm": lm_score.score,
        "licence": license_scan.scan,
        "rules": quality_rules.measure,
    }
    for f in runs.values():
        assert f(odd).count() == 12
        assert f(none).count() == 0
    assert {r["doc_id"] for r in decontaminate.contaminated(odd, items).collect()} == {1, 2, 3, None}
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert packing.best_fit(none).count() == 0
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(odd).collect()}
    assert (found[1], found[2], found[3], found[4], found[5], found[6]) == (1, 1, 1, 4, 5, 6)
    und = {r["doc_id"]: r["lang_pred"] for r in lang_id.train_and_predict(odd).collect()}
    assert (und[4], und[5], und[6]) == ("und", "und", "und")
    assert {r["doc_id"]: r["n_words"] for r in lm_score.score(odd).collect()}[4] == 0


def test_filters_keep_columns(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for keep in (lambda d: quality_classifier.keep_accepted(d, labels), quality_rules.keep_good, near_dedup.keep_one, lambda d: decontaminate.keep_clean(d, items)):
        assert keep(odd).dtypes == odd.dtypes
        assert keep(none).count() == 0
    assert quality_classifier.keep_accepted(odd, labels).count() == 12  # nothing learned: nothing rejected
    kept = Counter(r["doc_id"] for r in near_dedup.keep_one(odd).collect())
    assert kept == Counter([1, 4, 5, 6, 7, 8, 9, 10]) or kept == Counter([1, None, 4, 5, 6, 7, 8, 9, 10])
    assert {r["doc_id"] for r in decontaminate.keep_clean(odd, items).collect()} == {4, 5, 6, 7, 8, 9, 10}


def test_language_held_out(spark, docs):
    rows = lang_id.train_and_predict(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.95


def test_quality_on_unseen_labels(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    rows = quality_classifier.classify(big, labels.where(seen)).join(labels.where(~seen), "doc_id").collect()
    assert np.mean([r["accepted"] for r in rows if r["quality"] == 1]) > 0.97
    assert np.mean([not r["accepted"] for r in rows if r["quality"] == 0]) > 0.8


def test_platt_and_cotraining_views():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    a, b = (np.stack([y + rng.normal(0, 0.4, 400), rng.normal(size=400)], axis=1).astype(np.float32) for _ in range(2))
    shown = np.where(np.arange(400) < 120, y, -1)
    model = quality_classifier.cotrain(a, b, shown, np.arange(400))
    p = model.score(a, b)[2]
    assert np.mean((p > 0.5) == y) > 0.85
    assert quality_classifier.cotrain(a, b, np.ones(400, dtype=int), np.arange(400)) is None


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    rows = [(1, "http://a\nb", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1"), (None, "u", "y"), (None, "u", "y"), (6, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.round_trip(pages, path=f"file://{tmp_path}/w").collect()
    source = {i: (h or "").encode() for i, _, h in rows}
    assert len(found) == len(rows)
    for r in found:
        body = source[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in found}
    assert {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", None), (None, "response", None)} <= kinds
    read = warc.read(spark, f"file://{tmp_path}/w", "record_id string, record_type string, payload binary").where("record_type = 'revisit'")
    assert "PushedFilters" in read._jdf.queryExecution().toString() or read.count() == 3
    assert {bytes(r["payload"]) for r in read.collect()} == {b""}
    all_large = warc.round_trip(pages, min_revisit_bytes=2, path=f"file://{tmp_path}/m").collect()
    assert {r["record_type"] for r in all_large} == {"response"}
    skipped = list(warc.records(open(glob.glob(f"{tmp_path}/w/*.warc.gz")[0], "rb"), lambda h: True, False))
    assert all(p is None for _, p in skipped)


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    same, weighted = [], []
    for _ in range(40):
        x = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        y = np.concatenate([x[:150], rng.integers(1, 1 << 62, 50).astype(np.uint64)])
        v, _ = near_dedup.signatures(np.concatenate([x, y]), None, np.array([0, 200, 400]), 140)
        same.append((v[0] == v[1]).mean())
        wx, wy = rng.uniform(0.2, 4, 200), rng.uniform(0.2, 4, 200)
        v, _ = near_dedup.signatures(np.concatenate([x, x]), np.concatenate([wx, wy]), np.array([0, 200, 400]), 140)
        weighted.append((v[0] == v[1]).mean() - np.minimum(wx, wy).sum() / np.maximum(wx, wy).sum())
    assert np.mean(same) == pytest.approx(0.6, abs=0.02)
    assert np.mean(weighted) == pytest.approx(0, abs=0.02)


def test_dedup_loses_no_link(spark):
    """A family whose members are alike in steps, so links form chains, beside unrelated texts that share a passage."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage, rows = [word() for _ in range(150)], [word() for _ in range(60)], []
    for i in range(60):
        for _ in range(3):
            base[rng.randrange(len(base))] = word()
        rows.append((i, " ".join(base)))
    rows += [(1000 + i, " ".join([*(word() for _ in range(30)), *passage, *(word() for _ in range(10))])) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    link = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(link):
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table).collect()}
    assert got == {i: root(i) for i in sets}
    counted = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table, weights="count").collect()}
    assert counted == got  # no window repeats here


def test_prefix_pairs_are_complete(spark):
    rng = random.Random(5)
    rows = []
    for i in range(80):
        base = rng.sample(range(400), 40) if i % 4 == 0 else rows[-1][1][:]
        for _ in range(rng.randint(0, 6)):
            base[rng.randrange(len(base))] = rng.randrange(400, 10_000)
        rows.append((i, sorted({*base}), i))
    table = spark.createDataFrame(rows, "node long, elements array<long>, label long")
    got = {(r["a"], r["b"]) for r in near_dedup._prefix_pairs(table, 0.8).collect()}
    sets = {i: set(e) for i, e, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert want and want <= got


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(50, 51), (51, 50), (60, 60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 60: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes():
    raws = [b"Hello, World a", "é—b".encode(), None, b"", b"hello world A"]
    hashes, starts = WordHasher().of(raws)
    cut = [(r or b"").translate(FOLD).split() for r in raws]
    assert starts.tolist() == np.cumsum([0, *map(len, cut)]).tolist()
    flat = [w for c in cut for w in c]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(0, last[j] + (2 if x == y else -1), last[j + 1] - 1, row[-1] - 1))
        best = max(best, *row)
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        items, text = rng.integers(1, 6, (4, 9)).astype(np.uint64), rng.integers(1, 6, (4, 20)).astype(np.uint64)
        lengths = rng.integers(1, 10, 4)
        best, _ = decontaminate.align(items, lengths, text)
        assert best.tolist() == [smith_waterman(i[:n].tolist(), t.tolist()) for i, n, t in zip(items, lengths, text, strict=True)]


def test_decontamination_finds_edited_copies(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items, rng = {r["item_id"]: r["text"] for r in bench.collect()}, random.Random(4)
    noise = [f"zq{i}" for i in range(50)]
    planted = []
    for k, (i, t) in enumerate(sorted(items.items())):
        w = [rng.choice(noise) if rng.random() < 0.15 else x for x in t.split()]
        planted.append((10_000 + k, " ".join([*rng.choices(noise, k=100), *w, *rng.choices(noise, k=100)]), i))
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(rows, bench).collect()}
    assert np.mean([(d, i) in found for d, _, i in planted]) > 0.95
    folded = {i: " " + " ".join(words(t)) + " " for i, t in items.items()}
    exact = {(d, i) for d, t in texts(docs).items() for line in [" " + " ".join(words(t)) + " "] for i, f in folded.items() if len(f.split()) >= 3 and f in line}
    assert exact <= set(found)
    assert {k for k in found if k[0] < 10_000} == exact
    for d, i, r in ((d, i, found[d, i]) for d, i in exact):
        assert words(texts(docs)[d])[r["first_word"] : r["last_word"] + 1] == words(items[i])


def test_decontamination_finds_any_part_of_a_leaked_item(spark):
    """The later half of an item beside many full copies of it, a reworded first half, every fourth word changed: found as brute force says."""
    item = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for part in (["xx", *item[29:], "yy"], ["xx", *item[:31], "yy"], [f"z{i}" if i < 29 else x for i, x in enumerate(item)], [x if i % 4 else f"z{i}" for i, x in enumerate(item)], item[:20], item[40:] + item[:20]):
        rows = spark.createDataFrame([(i, " ".join(item)) for i in range(25)] + [(25, " ".join(part))], "doc_id long, text string")
        found = {r["doc_id"]: r["score"] for r in decontaminate.contaminated(rows, bench).collect()}
        number = {w: k for k, w in enumerate(sorted({*item, *part}))}
        score = smith_waterman([number[w] for w in item], [number[w] for w in part]) / 120
        assert found == pytest.approx({i: 1.0 for i in range(25)} | ({25: score} if score >= 0.5 else {}))
        assert {r["doc_id"] for r in decontaminate.keep_clean(rows, bench).collect()} == ({25} if score < 0.5 else set())


def test_lm_of_other_orders_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], re.findall(r"[^\W_]+", r["text"].lower())) for r in docs.limit(40).collect()]
    counts = Counter(tuple(w[i : i + n]) for _, w in rows for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)

    def log_prob(w):
        out = 0.0
        for i in range(len(w)):
            deepest = min(i, 3)
            for n in range(deepest, -1, -1):
                g = tuple(w[i - n : i + 1])
                if n == 0 or counts[g] >= 2:
                    out += math.log(counts[g] / (counts[g[:-1]] if n else total)) + (deepest - n) * math.log(0.4)
                    break
        return out

    got = {r["doc_id"]: r["log_prob"] for r in lm_score.score(docs.limit(40).coalesce(1), order=4, block_bytes=20_000, range_bytes=30_000).collect()}
    for d, w in rows:
        assert got[d] == pytest.approx(log_prob(w), rel=1e-9)


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for table in (docs.select("doc_id", "text"), odd):
        rows = packing.best_fit(table).collect()
        per, seqs = {}, {}
        for r in rows:
            per.setdefault(r["doc_id"], []).append(r)
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in seqs.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 4096
        total = 0
        for d in table.select("doc_id", "text").distinct().collect():
            ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
            want = [(k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
            got = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in per[d["doc_id"]]})
            assert got == want
        total = sum(r["length"] for r in rows)
        assert len(seqs) <= 1.03 * -(-total // 4096) + 1


def test_rounds_are_best_fit():
    rng = random.Random(6)
    lengths = Counter(rng.randint(1, 64) for _ in range(500))
    runs = packing.rounds(list(lengths.items()), 64)
    free, opened = [], 0  # best fit, one piece after the other
    for n in sorted(lengths.elements(), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(64 - n)
    used = {}
    for length, _, count, per, seq, _ in runs:
        for i in range(count):
            used[seq + i // per] = used.get(seq + i // per, 0) + length
    assert sum(r[2] for r in runs) == 500
    assert max(used.values()) <= 64
    assert len(used) == len(free) and opened == 0
    assert len(runs) <= 64 * (1 + 3 * 6)


def test_licences(spark, docs, odd):
    for table in (docs, odd):
        for r in license_scan.scan(table).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
            w = words(r["text"])
            places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
            assert (r["n_words"], r["n_base"]) == (len(w), len(places))
            assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
            assert {x for _, x in places} <= {*r["labels"].split(",")}
            assert 0 <= r["score"] <= 1
    scan = lambda t: license_scan.Scanner().scan(t.encode())[5]
    assert scan("SPDX-License-Identifier: Apache-2.0") == "apache-2.0"
    assert scan("under the GNU Lesser General Public License, version 2.1 or later") == "lgpl-2.1-or-later"
    assert scan("please submit the form by mit post") == ""
    assert len(license_scan.rules()) > 200


def test_licence_spellings_and_gate(docs):
    scanner = license_scan.Scanner()
    spellings = {
        "GPLv2": "gpl-2", "(GPLv3)": "gpl-3", "GPLv2 or later": "gpl-2-or-later", "LGPLv2.1": "lgpl-2.1", "AGPLv3 only": "agpl-3-only", "MPLv2.0": "mpl-2.0", "GPL3": "gpl-3",
        "FreeBSD license": "bsd", "GPL v3, 29 June 2007": "gpl-3", "GPL version 2, 1991": "gpl-2", "released under the GPLv3": "gpl-3", "GPL-2.0-only": "gpl-2.0-only",
        "FreeBSD 14": "", "php5 and python3": "", "gplv2x": "", "xgplv2": "", "GPL 2007": "",
    }
    for text, label in spellings.items():
        assert (text, scanner.scan(text.encode())[5]) == (text, label)
    every = {rule.keyword for rule in license_scan.rules()}
    mixed = [f"a {name} b" for name in spellings] + [f"under the {n[1]}{v}{d} license" for n in license_scan.NAMES for v in ("", "v", " ", " v") for d in ("", 1, 2, "3 0")]
    for text in [*mixed, *texts(docs).values()]:  # the gate keeps from no rule what it would find
        found = text.encode().translate(FOLD).split()
        keys = {scanner.words[w] for w in scanner.gate.intersection(found)}
        assert scanner.detections(b" ".join(found), keys) == scanner.detections(b" ".join(found), every)


def test_quality_rules(spark, docs, odd):
    piece = quality_rules.Vocabularies(*quality_rules._paths(None, None))
    for table in (docs, odd):
        for r in quality_rules.measure(table).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
            t = r["text"] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            repeated = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
            assert r["base_failed"] == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
            assert not (r["base_failed"] and r["kept"])
            n = sum(len(x) for x in piece.piece.encode(w))
            assert r["chars_per_token"] == pytest.approx(sum(map(len, w)) / max(1, n))
    assert not quality_rules.verdict(quality_rules.BANDS["latin"], 1.0, 1.0, 0.0, 6.0, 500)


def test_quality_bands_are_learnt_and_judge_short_texts(spark):
    rng = random.Random(7)
    words = ["house", "water", "people", "street", "morning", "little", "because", "nothing", "garden", "number", "between", "another"]
    rows = [(i, " ".join(rng.choices(words, k=30 if i % 2 else 200)), "en") for i in range(300)]
    rows += [(i, " ".join("".join(rng.choices("xqzjkv0123456789", k=12)) for _ in range(12 if i % 2 else 120)), "en") for i in range(300, 306)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in quality_rules.measure(table).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert {i for i, r in found.items() if not r["kept"]} == set(range(300, 306))
    assert {r["doc_id"] for r in quality_rules.keep_good(table).collect()} == set(range(300))
    assert {r["doc_id"]: r["kept"] for r in quality_rules.measure(table.repartition(7)).collect()} == {i: r["kept"] for i, r in found.items()}
    assert not quality_rules.verdict(quality_rules.BANDS["latin"], 1.0, 1.0, 0.0, 3.0, 60)


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.DOTALL)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(p|h\d|br)\b[^>]*>", " ", article))).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (text, len(text))
    menu = "Home News Sport Weather Travel Money Contact us today"
    rows = [(i, "http://h/x", f"<div>{menu}</div><p>unique{i} text{i}</p><div class='ad'>buy</div><!-- <p>no --><script>a<b</script>") for i in range(5)]
    rows += [(9, None, None), (10, "http://h/y", ""), (10, "http://h/y", "<p>tom &amp; jerry&nbsp;x<br>y<b>z</b></p><aside>s</aside>"), (11, "http://k", "<main><header>kept</header><nav>n</nav>a<p class=comments>c<p>b</main><footer>f")]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["page_id"], []).append(r["text"])
    assert by[3] == ["unique3 text3"]
    assert sorted(by[10]) == ["", "tom & jerry x yz"]
    assert (by[9], by[11]) == ([""], ["kept a b"])


def test_host_suffixes_equal_brute_force(spark):
    """A large host: passages that all, few or two pages share, beside other hosts, repeated ids and rows."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    menu, rare = [word() for _ in range(12)], [[word() for _ in range(9)] for _ in range(6)]
    rows = []
    for i in range(600):
        parts = [[word() for _ in range(rng.randrange(0, 15))], *([menu] if i % 5 else []), *([rare[i % 6]] if i < 12 else []), [word() for _ in range(4)]]
        rng.shuffle(parts)
        host = "http://other/" if i % 50 == 0 else "HTTP://Big/" if i % 2 else "http://big/"
        rows.append((None if i % 90 == 7 else i, f"{host}{i}", "".join(f"<p>{' '.join(p)}</p>" for p in parts)))
    rows += rows[200:202]  # repeated rows of an id are one page
    cut = [re.sub("<[^>]*>", " ", h).split() for _, _, h in rows]
    hosts = [u.lower().split("/")[2] for _, u, _ in rows]
    own = [n if i is None else f"id {i}" for n, (i, _, _) in enumerate(rows)]
    held = {}
    for n, w in enumerate(cut):
        for k in range(len(w) - 7):
            held.setdefault((hosts[n], *w[k : k + 8]), set()).add(own[n])
    want = []
    for n, w in enumerate(cut):
        gone = {k + j for k in range(len(w) - 7) if len(held[hosts[n], *w[k : k + 8]]) > 1 for j in range(8)}
        want.append((rows[n][0] or -1, rows[n][1], " ".join(x for k, x in enumerate(w) if k not in gone)))
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or -1, r["url"], r["text"]) for r in found) == sorted(want)
    assert any(len(g) == 2 for g in held.values())
    judged = html_extract.extract(spark.createDataFrame([(i, "http://h", f"<article>{' '.join(menu)} own{i}</article>") for i in range(3)], "page_id long, url string, html string"), trust_markup=False)
    assert {r["text"] for r in judged.collect()} == {"own0", "own1", "own2"}


def test_copies_of_a_page_keep_their_text(spark):
    """Equal pages under two urls, cut into elements in different ways, beside pages that share only a menu."""
    menu, text = " ".join(f"menu{i}" for i in range(9)), " ".join(f"word{i}" for i in range(40))
    rows = [(1, "http://h/a", f"<p>{menu}</p><p>{text}</p>"), (2, "http://h/b", f"<div>{menu}<p>{text}</p></div>"), (3, "http://h/c", f"<p>{menu}</p><p>own text</p>")]
    rows += [(4, "http://k/a", f"<p>{text}</p>"), (5, "http://k/b", f"<p>{text}</p>")]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: text, 2: text, 3: "own text", 4: text, 5: text}


def test_article_sections_and_links_are_kept():
    kept = ['<h2 id="related-work">x</h2>', '<section id="social-structure">x</section>', '<div id="notice-periods">x</div>', '<p id="comments-on-the-law">x</p>', '<h3 id="share-capital">x</h3>', '<p id="comments">x</p>']
    kept += ['<a href="/hidden-lake">x</a>', '<span title="the hidden river">x</span>', '<p data-hidden="no">x</p>', '<p title="class=ad">x</p>', '<p class="related-work social-structure">x</p>', '<h2 data-role="banner">x</h2>', "<p title='a style=\"display:none\"'>x</p>"]
    dropped = ['<p hidden>x</p>', '<p title="a" HIDDEN="">x</p>', '<p class="big ad">x</p>', '<div class="cookie-banner">x</div>', '<div class=sidebar-left>x</div>', '<p role=navigation>x</p>', '<p style="color:red; display: none">x</p>', "<p aria-hidden='true'>x</p>"]
    for tag in kept:
        assert (tag, html_extract.parse(f"<article>a {tag} b</article>")[0].split()) == (tag, ["a", "x", "b"])
    for tag in dropped:
        assert (tag, html_extract.parse(f"<article>a {tag} b</article>")[0].split()) == (tag, ["a", "b"])
    assert html_extract.parse('<h2 id="comments">x</h2><div id="sidebar">y</div><div id="comments">z</div><div id="share-capital">w</div>') == ("", ["x", "w"])


def test_pipeline_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "decontamination", "packing"]
    now = docs
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, now, SF).write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        if name == "packing":
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in now.select("doc_id").collect()}
            break
        assert after.dtypes == now.dtypes
        assert after.join(now, "doc_id", "left_anti").count() == 0
        if name == "near_dedup":
            kinds = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(now).collect()}
            assert {r[0] for r in after.select("doc_id").collect()} == set(kinds.values())
        now = after
    assert corpus_pipeline.run(spark, SF).count() > 0


# What follows covers the second round: hashing, odd input of single operators, and methods against plain versions of themselves.


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_polynomial_hashes_confuse(spark):
    """The Thue-Morse word of 1,024 letters and its complement: a polynomial hash modulo 2**64 can't tell them apart."""
    from tokenizers import Tokenizer

    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    hashes, _ = WordHasher().of([a.encode(), b.encode()])
    assert hashes[0] != hashes[1]
    rest = " ".join(f"w{i}" for i in range(4))
    table = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {rest}"), (4, f"{b} {rest}")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table).collect()} == {i: i for i in (1, 2, 3, 4)}
    item = spark.createDataFrame([(1, f"{a} {rest}")], "item_id long, text string")
    assert {(r["doc_id"], r["score"]) for r in decontaminate.contaminated(table, item).collect()} == {(3, 1.0), (4, 0.8)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: zlib.crc32(np.asarray([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for i, t in ((r["doc_id"], r["text"]) for r in table.collect())}
    assert {r["doc_id"]: r["ids_crc32"] for r in packing.best_fit(table).collect()} == want
    counts = {r["doc_id"]: r["log_prob"] for r in lm_score.score(table).collect()}
    assert counts[1] == pytest.approx(math.log(2 / 12))  # each long word twice among twelve


def test_tokens_compare_words_not_hashes(docs):
    from tokenizers import Tokenizer

    class Weak(WordHasher):
        def _hashes(self, *a):
            return super()._hashes(*a) & np.uint64(127)

    path = public_tokenizers.path("word_bpe_49k.json")
    raws = [(t or "").encode() for t in list(texts(docs).values())[:40]]
    tokenizer, tokens = Tokenizer.from_file(path), packing.Tokens(path)
    tokens.hasher = Weak(packing.SPACED)
    want = [np.asarray(tokenizer.encode(r.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes() for r in raws]
    assert tokens.of(raws[:30]) == want[:30]
    assert tokens.of(raws[20:]) == want[20:]


def test_every_licence_rule_finds_its_text_and_no_other():
    """A text made from each rule's pattern is found, by the gate too; with its first and last word changed the rule says nothing."""
    from re import _constants as C
    from re import _parser

    def sample(tree, long):
        out = ""
        for op, av in tree:
            if op is C.LITERAL:
                out += chr(av)
            elif op is C.BRANCH:
                out += sample(av[1][-1 if long else 0], long)
            elif op is C.SUBPATTERN:
                out += sample(av[3], long)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                out += sample(av[2], long) * (max(av[0], min(1, av[1])) if long else av[0])
            elif op is C.IN:
                out += chr(av[0][1]) if av[0][0] is C.LITERAL else "2"
            elif op is C.ANY:
                out += "x"
            else:
                assert op in (C.ASSERT, C.ASSERT_NOT)
        return out

    scanner, every = license_scan.Scanner(), license_scan.rules()
    assert len(every) > 450
    assert len(license_scan.SIGNATURES) > 170
    for rule in every:
        for long in (False, True):
            text = sample(_parser.parse(rule.pattern.pattern.decode()), long).encode()
            assert text == b" ".join(text.translate(FOLD).split()), text  # folded already
            assert rule.pattern.fullmatch(text), text
            assert rule.keyword in {scanner.words.get(w) for w in text.split()}, text
            if not long:  # without its optional words
                assert not rule.pattern.search(b"x" + text[:-1] + b"qqq"), text


def detections_by_force(line):
    """All rules on a text; a detection goes if one that is kept, of its priority or a higher one, holds it."""
    found = []
    for rule in license_scan.rules():
        for m in rule.pattern.finditer(line):
            groups = [g.decode() for g in m.groups() if g]
            version = next((g.replace(" ", ".") for g in groups if g[0].isdigit()), "")
            later = "-or-later" if any("later" in g for g in groups) else "-only" if "only" in groups else ""
            found.append((-rule.priority, m.start() - m.end(), m.start(), rule.label + (version and f"-{version}") + later))
    kept = []
    for p, size, at, label in sorted(found):
        if not any(a <= at and at - size <= b for a, b, _ in kept):
            kept.append((at, at - size, label))
    return {label for *_, label in kept}


def test_licence_labels_equal_brute_force(docs):
    notices = [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "BSD-3-Clause or BSD 3-Clause License, MIT-licensed, MIT-style license, PHP License, version 3.01, http://creativecommons.org/licenses/by-sa/4.0/",
    ]
    scanner = license_scan.Scanner()
    for text in [*notices, *(t or "" for t in texts(docs).values())]:
        line = b" ".join(text.encode().translate(FOLD).split())
        base = {label for phrase, label in license_scan.BASE.items() if re.search(rf"(?<![^ ]){phrase}(?![^ ])", line.decode())}
        assert {x for x in scanner.scan(text.encode())[5].split(",") if x} == base | detections_by_force(line)
    assert [scanner.scan(t.encode())[5] for t in notices] == ["gpl,gpl-2-or-later", "apache,apache-2.0", "bsd-3-clause,cc-by-sa-4.0,mit,php-3.01"]
    assert scanner.scan(b"licensed under the gpl 3 2007 edition")[5] == "gpl-3"


def test_archives_of_others_and_empty_ones(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, path=f"file://{tmp_path}/none").count() == 0
    (tmp_path / "bare").mkdir()
    assert warc.read(spark, f"file://{tmp_path}/bare").count() == 0
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    head = b"WARC/1.0\r\nwarc-type:response\r\nWARC-TARGET-URI: http://x:80/a\r\nContent-length:%d\r\n\r\n" % len(body)
    other = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(head + body + b"\r\n\r\n" + other)
    rows = warc.read(spark, f"file://{tmp_path}/in").collect()
    assert [(r["record_type"], r["target_uri"], r["content_length"], bytes(r["payload"])) for r in rows] == [("response", "http://x:80/a", len(body), b"hello"), ("metadata", None, 3, b"abc")]
    by = lambda test: [r["record_type"] for r in warc.read(spark, f"file://{tmp_path}/in").where(test).collect()]
    assert by("target_uri IS NOT NULL") == by("target_uri LIKE 'http://x%'") == by("content_length > 3") == by("record_type = 'response'") == ["response"]
    assert by("target_uri IS NULL") == by("content_length <= 3") == by("record_type IN ('metadata', 'x')") == ["metadata"]


def test_archives_of_a_page_that_most_have(spark, tmp_path):
    """A third of all pages are empty, some rows repeat; other columns have clashing names."""
    rows = [(i, f"u{i}", "" if i % 3 == 0 else "same" if i % 3 == 1 and i > 30 else f"own {i}", "p", "response") for i in range(90)] + [(5, "u5", "own 5", "p", "revisit")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_type string").repartition(5)
    found = warc.round_trip(pages, path=f"file://{tmp_path}/w").collect()
    last = {}
    for i, _, h, *_ in rows:
        last[h] = max(i, last.get(h, -1))
    body = {i: h for i, _, h, *_ in rows}
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in found if r["page_id"] != 5) == sorted((i, "response", None) if last[h] == i else (i, "revisit", last[h]) for i, h in body.items() if i != 5)
    assert sorted(r["record_type"] for r in found if r["page_id"] == 5) == ["response", "revisit"]


def test_pages_on_odd_rows(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = [(1, "http://h", "<article>a</article>", "t", 5, "x"), (None, None, None, "t", 5, "x"), (1, "http://h", "<article>a</article>", "t", 5, "x"), (2, "http://h", "<article>" + "word " * 50_000 + "</article>", None, None, None)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, blocks string")).collect()
    assert sorted((r["page_id"] or 0, len(r["text"]), r["n_chars"]) for r in found) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 249_999, 249_999)]


def test_comments_in_articles_of_their_own():
    for page in (
        '<article>Story</article><article class="comment">reader says</article>',
        '<article>Story<article class="comment-body">reader <article class="reply">says</article></article></article>',
        '<article>Story</article><article itemscope itemtype="https://schema.org/Comment">reader says</article>',
        '<article class="post">Story</article><section class="comments-list"><article>reader says</article></section>',
    ):
        assert html_extract.parse(page) == ("Story", [])
    assert html_extract.parse('<main class="content sidebar-left"><article class="post-comment-law">Story</article></main>')[0] == "Story"


def test_lm_levels_and_settings_change_nothing(spark, docs):
    want = {r["doc_id"]: (r["n_words"], r["log_prob"]) for r in lm_score.score(docs).collect()}
    several = lm_score.score(docs.repartition(3), block_bytes=5_000, range_bytes=2_000, fan_bits=3)  # three levels or more
    license_scan.scan(docs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["doc_id"]: (r["n_words"], r["log_prob"]) for r in several.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    assert got.keys() == want.keys()
    for d, (n, x) in want.items():
        assert got[d] == (n, None if x is None else pytest.approx(x, rel=1e-9))


def test_calibration_ends_where_the_loss_is_flat():
    rng = np.random.default_rng(4)
    for shift, spread in ((0, 1), (3, 0.2), (-40, 25), (0.5, 300)):
        z = rng.normal(size=(800, 2)) * spread + shift
        y = (rng.random(800) < 1 / (1 + np.exp(-np.clip(2 * z[:, 0] / spread - z[:, 1] / spread, -30, 30)))).astype(float)
        w, slope = quality_classifier.calibrate(z, y, rng.random(800) + 0.5)
        assert slope < 1e-2
    z = np.linspace(-8, 8, 400)  # log-odds four times too sure
    y = (rng.random(400) < 1 / (1 + np.exp(-z / 4))).astype(float)
    a, b = quality_classifier.platt(z, y)
    assert (a, b) == (pytest.approx(0.25, abs=0.08), pytest.approx(0, abs=0.4))
    assert quality_classifier.platt(-z, y)[0] == 0  # a view that is always wrong says nothing


def test_cotraining_in_spark_equals_cotraining_in_memory(spark):
    """The same model as from all rows in one array, with pseudo-labels from every unlabelled row."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()
    table = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    given = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    model = quality_classifier.fit(table, spark.createDataFrame(list(given.items()), "doc_id long, quality int"), max_taught=20, rounds=2)
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    marked = [r for r in rows if r["doc_id"] in given]
    free = sorted((r for r in rows if r["doc_id"] not in given), key=lambda r: r["doc_id"])
    every = marked + free
    a = quality_classifier.text_view([(r["text"] or "").encode() for r in every])
    b = quality_classifier.meta_view([[r["lang"], r["source"]] for r in every], [r["n_chars"] for r in every])
    y = np.array([given.get(r["doc_id"], -1) for r in every])
    sizes = Counter(given.values())
    weights = np.array([sizes[v] / (y == v).sum() if v >= 0 else 1.0 for v in y])
    order = np.array([zlib.crc32(str(r["doc_id"]).encode()) for r in every])
    plain = quality_classifier.cotrain(a, b, y, order, 2, weights=weights, max_taught=20)
    assert model.text == pytest.approx(plain.text, abs=1e-3)
    assert model.meta == pytest.approx(plain.meta, abs=1e-3)
    assert model.combine == pytest.approx(plain.combine, abs=2e-2)
    assert quality_classifier.meta_view([["en", "s"]], [5.0]).shape[1] == b.shape[1]


def test_quality_is_calibrated_on_unseen_labels(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = quality_classifier.classify(big, labels.where(seen)).join(labels.where(~seen), "doc_id").collect()
    loss = -np.mean([math.log(r["score"] if r["quality"] else 1 - r["score"]) for r in rows])
    share = np.mean([r["quality"] for r in rows])
    assert loss < 0.35 * -(share * math.log(share) + (1 - share) * math.log(1 - share))
    assert np.mean([r["score"] for r in rows]) == pytest.approx(share, abs=0.05)


def test_language_equals_plain_naive_bayes(spark, docs):
    """The same sums, one window at a time; and with little room for the model fewer cells, but every language."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.limit(40).collect() if r["text"] and r["lang"]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(table, "text", "lang", buckets=1 << 10)
    cells = lang_id.Cells(1 << 10)
    counts = {(lang, k): Counter() for lang in model.langs for k in range(3)}
    for _, t, lang in rows:
        for k, found in enumerate(cells.of([t])[0]):
            counts[lang, k].update(found[found < 1 << 10].tolist())
    n = Counter(lang for *_, lang in rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score_1"] if "score_1" in r else r["score"]) for r in lang_id.predict(table, model).collect()}
    for i, t, _ in rows:
        total = {}
        for lang in model.langs:
            total[lang] = math.log(n[lang] / len(rows))
            for k, found in enumerate(cells.of([t])[0]):
                size = sum(counts[lang, k].values()) + 0.5 * (1 << 10)
                total[lang] += sum(math.log((counts[lang, k][c] + 0.5) / size) for c in found[found < 1 << 10].tolist())
        best = max(total, key=lambda x: (total[x], x))
        assert got[i] == (best, pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), abs=1e-3))
    many = spark.createDataFrame([(i, f"text number {i}", f"l{i % 300}") for i in range(600)], "doc_id long, text string, lang string")
    small = lang_id.fit(many, "text", "lang", model_bytes=1 << 20)
    assert len(small.langs) == 300
    assert small.log_p.nbytes <= (1 << 20) + 4 * 3 * 300


def test_buckets_that_most_rows_are_in(spark):
    """A third of all rows in one group of near copies, and weights that decide: repeated windows count as often as they stand."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(base[:110] + [word() for _ in range(5)])) for i in range(100)] + [(1000 + i, " ".join(word() for _ in range(40))) for i in range(200)]
    phrase = [word() for _ in range(5)]
    rows += [(2000, " ".join(phrase * 2 + base[:20])), (2001, " ".join(phrase * 12 + base[:20]))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in ((i, t.split()) for i, t in rows)}
    alike = lambda x, y: sum((x & y).values()) / sum((x | y).values())
    assert all(alike(sets[0], sets[i]) >= 0.8 for i in range(100))
    assert len(sets[2000] & sets[2001]) / len(sets[2000] | sets[2001]) >= 0.8 > alike(sets[2000], sets[2001])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table).collect()}
    assert got == {i: 0 if i < 100 else i for i in sets}
    as_sets = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(table, weights="set").collect()}
    assert as_sets == got | {2001: 2000}


def test_joined_plan_equals_broadcast_plan(spark, docs, monkeypatch):
    parts = packing.pieces(docs.select("doc_id", "text"))
    key = lambda t: sorted((r["length"], r["sequence_id"], r["offset"]) for r in t.collect())
    want = key(packing.pack(parts))
    monkeypatch.setattr(packing, "MAX_BROADCAST_RUNS", 0)
    assert key(packing.pack(parts)) == want
    monkeypatch.setattr(near_dedup, "MAX_BROADCAST_ROWS", 0)
    assert near_dedup.keep_one(docs).count() == len({r["class_id"] for r in near_dedup.classes(docs).collect()})


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    for name, table in (("odd", odd), ("none", none)):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int").limit(0).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "words that no text here has in a row")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        assert {r["doc_id"] for r in found} == ({1} if name == "odd" else set())


def test_kept_equals_brute_force(spark):
    """Bands from numpy's quartiles over the same groups, and each text judged by them in plain Python."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [(100_000 + i, " ".join("".join(random.Random(i * 100 + k).choices("xqzjkv0123456789", k=12)) for k in range(60)), "en") for i in range(4)]
    table = table.unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    found = quality_rules.measure(table).join(table.select("doc_id", "lang", "text"), "doc_id").collect()
    piece = quality_rules.Vocabularies(*quality_rules._paths(None, None)).piece
    sizes = {r["doc_id"]: sum(map(len, piece.encode((r["text"] or "").split()))) if r["text"] else 0 for r in found}
    length = lambda i: min(max(int(math.log2(max(1, sizes[i]))), quality_rules.LENGTHS[0]), quality_rules.LENGTHS[1])
    values = lambda r: (r["chars_per_token"], r["chars_per_token_bytes"], r["byte_share"], r["entropy"] / min(math.log2(max(2, sizes[r["doc_id"]])), 10))
    groups = {}
    for r in found:
        if not r["base_failed"]:
            for kind in (("lang", r["lang"]), ("script", r["script"])):
                groups.setdefault((*kind, length(r["doc_id"])), []).append([round(v, 3) for v in values(r)])
    bands = {}
    for key, rows in groups.items():
        if key[1] is not None and len(rows) >= quality_rules.MIN_GROUP:
            low, high = np.percentile(np.array(rows), [25, 75], axis=0)
            reach = quality_rules.SPREAD * np.maximum(high - low, quality_rules.LEAST_WIDTH)
            bands[key] = [(a if below else -math.inf, b if above else math.inf) for a, b, (below, above) in zip(low - reach, high + reach, ((1, 1), (1, 1), (0, 1), (1, 0)), strict=True)]
    judged = 0
    for r in found:
        band = bands.get(("lang", r["lang"], length(r["doc_id"]))) or bands.get(("script", r["script"], length(r["doc_id"])))
        if r["base_failed"]:
            assert not r["kept"]
        elif band:
            judged += 1
            if all(abs(v - edge) > 2e-3 for v, own in zip(values(r), band, strict=True) for edge in own):  # next to an edge rounding decides
                assert r["kept"] == all(a <= v <= b for v, (a, b) in zip(values(r), band, strict=True)), r
        else:
            assert r["kept"] == quality_rules.verdict(quality_rules.BANDS.get(r["lang"]) or quality_rules.BANDS[r["script"]], r["chars_per_token"], r["chars_per_token_bytes"], r["byte_share"], r["entropy"], sizes[r["doc_id"]])
    assert judged > 500
    assert {r["doc_id"] for r in found if r["kept"]}.isdisjoint(i for i, *_ in junk)
