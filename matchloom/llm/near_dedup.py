"""Near-duplicate detection by DartMinHash signatures and banded joining.

A text is folded to words, its elements are its distinct windows of five words (a shorter text is one element), and the similarity
of two texts is the weighted Jaccard similarity of their elements: with weights "count", the default, an element weighs as often as the text
has it, so the similarity is that of the multisets; with weights "set" each weighs 1. Darts are thrown by hashing: each unit of weight of an element is a column whose ranks
are cut into unit cells, a cell gets Poisson(1) darts, a dart has a rank within its cell, a weight within its column (it counts
if that lies within the element's weight) and one of k coordinates; only darts below the rank t / total weight are thrown, about t =
k ln k + 2k a text however long. The earliest dart of each coordinate is its signature value, so two texts agree in a coordinate
with the probability of their similarity. A text with an empty coordinate is thrown again to twice the rank.

Texts that agree in all values of a band are candidates. Equal texts are one node from the start. In each bucket every node is paired
with the bucket's least node; pairs are verified on all their elements; what is verified is joined to components. Buckets that hold
several components try other centers a few times. The nodes of those that still do are then joined by the rarest of their elements (a
prefix join, which finds every link between components), so no link is left out, while a bucket of one large group, or of texts that share a
passage and little else, costs no more than its size. A bucket that a large share of all rows is in doesn't meet its center in one task: such buckets are few, whatever the
corpus, and their centers are broadcast (`join_split`). With 28 bands of 5 values a pair of similarity 0.8 escapes with a probability of 1.5e-5.

Defined results: null texts are a class each; empty texts and texts without a word are grouped only with equal texts; a class is named by
its least doc_id (null if it has none); repeated rows are copies; ties don't arise, as a link depends on its two texts only; a long text is taken
whole; an empty table has no classes; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Scratch, WordHasher, by_chunk, fresh, join_split, mix, ngram_hashes, small_batches, stage, tidy
from matchloom.llm.graph import components

WORDS, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 28, 5
#: Times that buckets of several components try other centers.
MERGING_ROUNDS = 2
#: Rows of (digest, node) that may be broadcast: about 40 bytes each. Beyond, tables are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Digests that a task remembers so as to sign a copied text once; forgetting only costs time.
MAX_SEEN = 200_000

_CDF = np.cumsum(np.exp(-1.0) / np.concatenate([[1.0], np.cumprod(np.arange(1.0, 20.0))]))


def shingles(words: np.ndarray, starts: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's windows of n words, repeats included, and where each text's begin. A text of fewer words has one window."""
    counts = np.diff(starts)
    m = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(m)])
    out = np.zeros(at[-1], dtype=np.uint64)
    rows = np.repeat(np.arange(len(counts)), m)
    where = starts[rows] + np.arange(len(rows)) - at[rows]
    long = counts[rows] >= n
    if len(words) >= n:
        out[long] = ngram_hashes(words, n)[where[long]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = words[starts[i] : starts[i + 1]]
        out[at[i]] = ngram_hashes(own, len(own))[0] ^ np.uint64(len(own))
    return out, at


def elements(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text in order, how often it has them, and where each text's begin."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate([first, [len(h)]]))
    return h[first], counts, np.searchsorted(r[first], np.arange(len(starts)))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(hashes: np.ndarray, weights: np.ndarray | None, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """DartMinHash values (texts x k) of weighted sets, and which texts have any. weights None: 1 each, and repeats of an element change nothing."""
    n = len(starts) - 1
    sizes = np.diff(starts)
    rows = np.repeat(np.arange(n), sizes)
    total = np.bincount(rows, weights=weights, minlength=n) if weights is not None else sizes.astype(np.float64)
    out = np.zeros((n, k), dtype=np.uint64)
    some = total > 0
    todo, reach = np.flatnonzero(some), np.divide(k * np.log(k) + 2.0 * k, total, out=np.zeros(n), where=some)
    while len(todo):
        here = np.zeros(n, dtype=bool)
        here[todo] = True
        own = np.flatnonzero(here[rows])
        limit = reach[rows[own]]
        slots = np.ceil(limit).astype(np.int64)
        columns = np.ones(len(own), dtype=np.int64) if weights is None else np.ceil(weights[own]).astype(np.int64)
        cells = slots * columns
        of = np.repeat(np.arange(len(own)), cells)
        i = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        slot, column = i % slots[of], i // slots[of]
        g = mix(hashes[own][of] + mix((slot * 0x10001 + column * 0x1000003 + 1).astype(np.uint64)))
        darts = np.searchsorted(_CDF, _unit(g), side="right")
        d = np.repeat(np.arange(len(of)), darts)
        number = (np.arange(len(d)) - np.repeat(np.cumsum(darts) - darts, darts)).astype(np.uint64)
        h = mix(g[d] + (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        rank = slot[d] + _unit(h)
        fine = rank <= limit[of[d]]
        if weights is not None:
            fine &= column[d] + _unit(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))) < weights[own][of[d]]
        d, h, rank = d[fine], h[fine], rank[fine]
        key = rows[own][of[d]] * k + (mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(k)).astype(np.int64)
        least = np.full(n * k, np.inf)
        np.minimum.at(least, key, rank)
        won = rank == least[key]
        flat = out.reshape(-1)
        flat[key[won]] = h[won]
        full = np.isfinite(least.reshape(n, k)).all(axis=1)
        todo = todo[~full[todo]]
        reach[todo] *= 2
    return out, some


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band of `rows` values (texts x bands)."""
    n, k = values.shape
    cut = values.reshape(n, k // rows, rows)
    h = np.tile(np.arange(1, k // rows + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (n, 1))
    for i in range(rows):
        h = mix((h ^ cut[:, :, i]) * np.uint64(0x9E3779B97F4A7C15))
    return h


def _signed(rows: DataFrame, bands: int, band_rows: int, words: int, counted: bool) -> DataFrame:
    """digest and band keys; a text that a task sees again is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()

        def work(batch: pa.RecordBatch, raws: list[bytes | None]) -> pa.RecordBatch | None:
            digests, new = batch.column("digest").to_pylist(), []
            for i, d in enumerate(digests):
                if d not in seen:
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen.add(d)
                    new.append(i)
            if not new:
                return None
            found, at = shingles(*hasher.of(raws[i] for i in new), words)
            if counted:
                found, weights, at = elements(found, at)
            values, some = signatures(found, weights.astype(np.float64) if counted else None, at, bands * band_rows)
            keys = band_keys(values, band_rows).view(np.int64)
            lengths = np.where(some, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(keys[some].reshape(-1)))
            return pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(new)), lists], names=["digest", "bands"])

        return by_chunk(batches, "text", work)

    return rows.mapInArrow(tidy(run), "digest string, bands array<long>")


def _element_lists(rows: DataFrame, words: int, counted: bool) -> DataFrame:
    """node and the sorted hashes of its elements; with weights, the c-th repeat of an element is an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()

        def work(batch: pa.RecordBatch, raws: list[bytes | None]) -> pa.RecordBatch:
            found, counts, at = elements(*shingles(*hasher.of(raws), words))
            if counted:
                rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
                of = np.repeat(np.arange(len(found)), counts)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                found, at = mix(found[of] + nth.astype(np.uint64)), np.searchsorted(rows[of], np.arange(len(at)))
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.view(np.int64)))], names=["node", "elements"])

        return by_chunk(batches, "text", work)

    return rows.mapInArrow(tidy(run), "node long, elements array<long>")


def _few(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it is stored and has few rows."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_ROWS else table


def links(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS, weights: str = "count", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (digest, node): one for each distinct text; and links (a, b, similarity) between nodes, which hold every component together.

    scratch holds the tables on the way; its owner clears it once the links are used.
    """
    stage = (scratch or Scratch()).stage
    counted = {"set": False, "count": True}[weights]
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.md5(docs[text].cast("string")).alias("digest"), docs[text].cast("string").alias("text")).where("text IS NOT NULL")
    nodes = stage(_signed(texts, bands, band_rows, words, counted).groupBy("digest").agg(F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    rows = nodes.select("node", F.explode("bands").alias("band"))
    buckets = stage(rows.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("last"), F.count("*").alias("n")).where("center < last").select("band", "center", "n"))
    shared = stage(join_split(rows, buckets, "band", "n", _total(buckets)).select("band", "node", "center"))
    tried = stage(shared.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct())

    met = stage(shared.select("node").distinct().join(nodes.select("node", "digest"), "node"))
    copies = texts.join(_few(met), "digest").select("node", "text")
    lists = stage(_element_lists(copies, words, counted).groupBy("node").agg(F.first("elements").alias("elements")))

    def verified(pairs: DataFrame) -> DataFrame:
        left = lists.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
        right = lists.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
        fits = F.least(F.size("of_a"), F.size("of_b")) >= similarity * F.greatest(F.size("of_a"), F.size("of_b"))
        both = pairs.join(right, "b").join(left, "a").where(fits)
        common = F.size(F.array_intersect("of_a", "of_b"))
        return both.select("a", "b", (common / (F.size("of_a") + F.size("of_b") - common)).alias("similarity")).where(F.col("similarity") >= similarity)

    good = stage(verified(tried))
    place = stage(_named(shared.select("band", "node"), components(good)))
    for turn in range(MERGING_ROUNDS):
        # Buckets that still hold several components try another center, each its own; what is linked joins components.
        order = F.struct(F.xxhash64("node", "band", F.lit(turn)), F.col("node"), F.col("label"))
        mixed = place.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min(order).alias("center"), F.count("*").alias("n")).where("least < most")
        mixed = stage(mixed.select("band", F.col("center.node").alias("center"), F.col("center.label").alias("its"), "n"))
        rest = stage(join_split(place, mixed, "band", "n", _total(mixed)))
        pairs = rest.where("label <> its").select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
        fresh_pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"))
        found = stage(verified(fresh_pairs))
        good, tried = good.unionByName(found), tried.unionByName(fresh_pairs)
        rest = rest.select("band", "node", "label")
        ends = found.join(_labels(rest, "a"), "a").join(_labels(rest, "b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        named = components(ends).withColumnRenamed("label", "new")
        place = stage(rest.join(named.withColumnRenamed("node", "label"), "label", "left").select("band", "node", F.coalesce("new", "label").alias("label")))
    mixed = stage(place.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n")).where("least < most").select("band", "n"))
    rest = stage(join_split(place, mixed, "band", "n", _total(mixed)).select("node", "label").distinct())
    untried = _prefix_pairs(lists.join(rest, "node"), similarity).join(tried, ["a", "b"], "left_anti")
    return nodes.select("digest", "node"), good.unionByName(stage(verified(stage(untried))))


def _total(buckets: DataFrame) -> int:
    """Rows of all buckets."""
    return buckets.agg(F.sum("n")).first()[0] or 0


def _prefix_pairs(rows: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of rows(node, elements, label) with different labels, among them all whose sets have a similarity of t or more.

    Elements are ordered by how many rows have them. The first common element of such a pair is among the first n - ceil(t * n) + 1 of each
    row of n elements, and its places leave room for enough others. A longer row looks for shorter ones in the classes of sizes that its
    element's place allows, so rows that share only what very many have don't meet. The commonest label of a key is kept from meeting itself, so the rows of one large group don't pair.
    """
    each = rows.select("node", "label", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    spread = each.groupBy("e").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    in_order = each.join(spread, "e").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "e", (F.col("lo") < F.col("hi")).alias("mixed")))).alias("es"))  # a row's own elements
    slack = 1e-9
    first = stage(in_order.select("node", "label", "n", F.posexplode("es").alias("i", "x")).where((F.col("i") <= F.col("n") - F.ceil(t * F.col("n") - slack)) & F.col("x.mixed")).select("node", "label", "n", "i", F.col("x.e").alias("e")))
    size_class = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(1.05))).cast("int")
    least, most = F.ceil(t * F.col("n") - slack), F.least(F.col("n").cast("long"), F.floor((F.col("n") - F.col("i")) * (1 + t) / t - F.col("n") + slack))
    shorter = first.select("e", size_class(F.col("n")).alias("c"), "label", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("i").alias("j"))
    longer = first.where(most >= least).select("e", F.explode(F.sequence(size_class(least), size_class(most))).alias("c"), F.col("label").alias("its"), F.col("node").alias("x"), F.col("n").alias("nx"), "i")
    # The label that most rows of a key have never meets itself: 1 is that against others, 2 others against that, 3 others among themselves.
    often = shorter.select("e", "c", "label").union(longer.select("e", "c", "its")).groupBy("e", "c", "label").agg(F.count("*").alias("k")).groupBy("e", "c").agg(F.max_by("label", F.struct("k", "label")).alias("top"))
    roles = lambda name, mine, theirs: F.explode(F.when(F.col(name) == F.col("top"), F.array(F.lit(mine))).otherwise(F.array(F.lit(theirs), F.lit(3)))).alias("role")
    longer = longer.join(often, ["e", "c"]).select("e", "c", "its", "x", "nx", "i", roles("its", 1, 2))
    shorter = shorter.join(often, ["e", "c"]).select("e", "c", "label", "y", "ny", "j", roles("label", 2, 1))
    both = longer.join(shorter, ["e", "c", "role"]).where("its <> label")
    room = F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) >= t / (1 + t) * (F.col("nx") + F.col("ny")) - slack
    fits = (F.col("ny") >= t * F.col("nx") - slack) & ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x"))))
    return both.where(room & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(band, node) with the nodes' labels; a node without a link is its own."""
    return rows.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))


def _labels(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.col("node").alias(name), F.col("label").alias(f"label_{name}")).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """doc_id, digest and class_id of every row."""
    scratch = Scratch()
    nodes, found = links(docs, text, scratch=scratch, **options)
    named = components(found)
    rows = docs.select(docs[doc_id].alias("doc_id"), F.md5(docs[text].cast("string")).alias("digest"))
    least = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    member = least.join(nodes, "digest").join(named, "node", "left").select("digest", "least", F.coalesce("label", "node").alias("class"))
    member = stage(member)
    scratch.clear()
    names = member.groupBy("class").agg(F.min("least").alias("class_id"))
    by_digest = member.join(names, "class").select(F.col("digest").alias("of"), "class_id")
    return rows.join(by_digest, F.col("digest") == F.col("of"), "left").select("doc_id", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """One row of each class, with its columns as they were: that of the least doc_id; of rows alike in id and text, any one."""
    found = stage(classes(docs, doc_id, text, **options))
    key, of = fresh(docs, "digest"), fresh(docs, "of_digest")
    counts = found.where("digest IS NOT NULL").groupBy("doc_id", "digest", "class_id").agg(F.count("*").alias("n"))
    # Of a class's least id there can be several texts; the least digest stays.
    best = counts.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("class_id").alias("of_class")).agg(F.min("digest").alias("kept"))
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("kept"))
    judged = stage(counts.join(best, F.col("class_id").eqNullSafe(F.col("of_class")), "left").select("doc_id", "digest", "n", F.coalesce(stays, F.lit(False)).alias("stays")))
    rows = docs.withColumn(key, F.md5(docs[text].cast("string")))
    same = lambda t: rows[doc_id].eqNullSafe(t["doc_id"]) & (rows[key] == t["digest"])
    gone = _few(stage(judged.where("NOT stays OR n > 1").select("doc_id", "digest")))
    out = rows.join(gone, same(gone), "left_anti").drop(key)
    again = stage(judged.where("stays AND n > 1").select("doc_id", "digest"))
    if again.limit(1).count():
        repeats = rows.join(_few(again), same(again), "left_semi")
        out = out.unionByName(repeats.groupBy(F.col(doc_id).alias(of), F.col(key)).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return out
