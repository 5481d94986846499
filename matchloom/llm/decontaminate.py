"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Texts are folded to words. Every window of `seed_words` words of a test item is a seed, however many documents hold it: whichever part of
an item a document copies has its seeds, also where the item leaked into very many. Where a document holds a seed, the item is aligned with
the words around it (match 2, mismatch -1, gap -1). The score is the best local alignment's as a share of a perfect one; a pair at or above
`threshold` is contaminated. Copies with words changed, left out or put in score by how much of the item is left. Frequent windows cost
little: an alignment can't match more of an item's words than the text around the seed holds, and is left out where these are too few for
the threshold. That bound loses nothing.

The items' index goes to every task, a block of at most MAX_BLOCK_BYTES of item text at a time; more items mean more passes. Documents
aren't shuffled; windows are aligned in batches of bounded size; a document is looked at whole.
Defined results: null or empty texts and items match nothing, as do items of fewer words than a seed; repeated items are found separately;
repeated documents each get rows; of places in a text that score alike the first is reported; a long text is looked at whole; an empty table, or
an empty benchmark, gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from matchloom.llm.common import WordHasher, mix, ngram_hashes, raw_texts, small_batches, spans, tidy

SEED_WORDS, THRESHOLD = 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of item text in one index, cells of one batch of alignments, and places of seeds that are looked at at once.
MAX_BLOCK_BYTES, MAX_CELLS, MAX_PLACES = 8 << 20, 4 << 20, 1 << 20
CHUNK_BYTES = 1 << 20


@dataclass
class Index:
    """Items' words, and their windows as seeds: `grams` sorted, `posts[bounds[g]:bounds[g + 1]]` the (item, position) of gram g."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    bounds: np.ndarray
    posts: np.ndarray
    filter: np.ndarray

    @staticmethod
    def of(ids: list, texts: list[str | None], n: int) -> Index:
        words, starts = WordHasher().of((t or "").encode() for t in texts)
        items = [words[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        found = [ngram_hashes(w, n) for w in items]
        posts = np.array([(i, p) for i, g in enumerate(found) for p in range(len(g))], dtype=np.int64).reshape(-1, 2)
        every = np.concatenate([*found, np.zeros(0, dtype=np.uint64)])
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        bounds, posts = np.concatenate([first, [len(every)]]), posts[order]
        seen = np.zeros(1 << 20, dtype=bool)
        seen[grams >> np.uint64(44)] = True
        return Index(ids, items, grams, bounds, posts, seen)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes that are grams, and which."""
        if not len(self.grams):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        gram = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        same = self.grams[gram] == hashes[at]
        return at[same], gram[same]


def _windows(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of all texts, with the number of the text that each is of or -1 where it crosses texts."""
    hashes = ngram_hashes(words, n)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    m = len(hashes)
    return hashes, np.where(rows[:m] == rows[n - 1 : n - 1 + m], rows[:m], -1)


def align(items: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of items[i, :lengths[i]] with texts[i]: score, and the column after its last matched word. A word 0 in texts matches nothing."""
    n, width = texts.shape
    before = np.zeros((n, width + 1), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    for i in range(items.shape[1]):
        now = np.zeros_like(before)
        now[:, 1:] = before[:, :-1] + np.where((texts == items[:, i : i + 1]) & (texts != 0), MATCH, MISMATCH)
        np.maximum(now, before + GAP, out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp  # gaps along the row
        now[lengths <= i] = 0
        top = now.argmax(axis=1)
        value = now[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        before = now
    return best, end


def _aligned(index: Index, words: np.ndarray, starts: np.ndarray, rows: np.ndarray, items: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, and first and last word in the text, for windows [low, high) of texts `rows`; 0 where a window lacks the words for the threshold."""
    lengths = np.array([len(w) for w in index.words], dtype=np.int64)[items]
    score, first, last = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, int(MAX_CELLS // (3 * lengths[order[min(len(order) - 1, at + 64)]] + 64)))
        part = order[at : at + min(size, 4096)]
        at += len(part)
        tall, wide = int(lengths[part].max()), int((high - low)[part].max())
        a = np.zeros((len(part), tall), dtype=np.uint64)
        for k, i in enumerate(part.tolist()):
            a[k, : lengths[i]] = index.words[items[i]]
        where = low[part][:, None] + np.arange(wide)
        inside = where < high[part][:, None]
        b = np.where(inside, words[np.minimum(where, len(words) - 1)], np.uint64(0))
        salt = mix(np.arange(1, len(part) + 1, dtype=np.uint64))[:, None]  # words meet within a window only
        there = np.isin(a ^ salt, b[inside] ^ np.broadcast_to(salt, b.shape)[inside]) & (np.arange(tall) < lengths[part][:, None])
        able = there.sum(axis=1) >= threshold * lengths[part]  # each word of the item matches once at most
        part, a, b = part[able], a[able], b[able]
        if not len(part):
            continue
        best, end = align(a, lengths[part], b)
        # Backwards from the end: where it begins.
        back = np.zeros_like(a)
        for k, i in enumerate(part.tolist()):
            back[k, : lengths[i]] = index.words[items[i]][::-1]
        column = end[:, None] - 1 - np.arange(wide)
        _, length = align(back, lengths[part], np.where(column >= 0, np.take_along_axis(b, np.maximum(column, 0), axis=1), np.uint64(0)))
        score[part] = best / (MATCH * lengths[part])
        last[part] = low[part] + end - 1
        first[part] = low[part] + end - length
    return score, first - starts[rows], last - starts[rows]


def matches(index: Index, hasher: WordHasher, raws: list[bytes | None], n: int, threshold: float) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, first word, last word, distinct seeds) of the contaminated pairs, one for each pair."""
    words, starts = hasher.of(raws)
    hashes, of = _windows(words, starts, n)
    at, gram = index.hits(hashes)
    at, gram = at[of[at] >= 0], gram[of[at] >= 0]
    if not len(at):
        return []
    posts = index.bounds[gram + 1] - index.bounds[gram]
    lengths = np.array([len(w) for w in index.words], dtype=np.int64)
    places = []
    for lo, hi in spans(posts.tolist(), MAX_PLACES):
        hit = np.repeat(np.arange(lo, hi), posts[lo:hi])
        post = index.posts[index.bounds[gram][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(posts[lo:hi]) - posts[lo:hi], posts[lo:hi])]
        row, item, diagonal = of[at[hit]], post[:, 0], at[hit] - post[:, 1]
        slack = np.maximum(4, lengths[item] // 4)
        # Seeds of one copy lie on nearly one diagonal: one window for each band of diagonals.
        places.append(np.unique(np.stack([row, item, (diagonal - starts[row]) // slack, gram[hit]], axis=1), axis=0))
    found = np.unique(np.concatenate(places), axis=0) if len(places) > 1 else places[0]
    edge = np.flatnonzero(np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)]))
    seeds = np.diff(np.concatenate([edge, [len(found)]]))
    places = found[edge]
    rows, items = places[:, 0], places[:, 1]
    room = np.maximum(4, lengths[items] // 4)
    low = np.maximum(starts[rows], starts[rows] + places[:, 2] * room - room)
    high = np.minimum(starts[rows + 1], starts[rows] + (places[:, 2] + 2) * room + lengths[items])
    score, first, last = _aligned(index, words, starts, rows, items, low, high, threshold)
    best: dict[tuple[int, int], tuple] = {}
    for r, i, s, a, b, k in zip(rows.tolist(), items.tolist(), score.tolist(), first.tolist(), last.tolist(), seeds.tolist(), strict=True):
        if s >= threshold and (r, i) not in best or s >= threshold and s > best[r, i][0]:
            best[r, i] = (s, a, b, k)
    return [(r, i, *found) for (r, i), found in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """benchmark in parts of at most about MAX_BLOCK_BYTES of text."""
    rows = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[text].cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // MAX_BLOCK_BYTES)
    return [rows] if n <= 1 else [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _index(block: DataFrame, n: int) -> Index:
    """The seeds of a block."""
    items = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda x: (x[0] is None, x[0], x[1]))
    return Index.of([x[0] for x in items], [x[1] for x in items], n)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", seed_words: int = SEED_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word and n_seeds: a row for each contaminated pair of a document and an item."""
    small_batches(docs.sparkSession)
    kinds = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {benchmark.schema[item_id].dataType.simpleString()}, score double, first_word long, last_word long, n_seeds long"
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    item_kind, out = to_arrow_type(benchmark.schema[item_id].dataType), None
    for block in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(_index(block, seed_words))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            hasher, index = WordHasher(), shared.value
            for batch in batches:
                raws = raw_texts(batch.column("text"))
                for lo, hi in spans((len(r or b"") for r in raws), CHUNK_BYTES):
                    if found := matches(index, hasher, raws[lo:hi], seed_words, threshold):
                        r, i, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).take(pa.array(r)), pa.array([index.ids[k] for k in i], item_kind), *(pa.array(x) for x in rest)], names=["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"])

        part = rows.mapInArrow(tidy(find), kinds)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", seed_words: int = SEED_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no item, with their columns as they were."""
    small_batches(docs.sparkSession)
    out = docs
    for block in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(_index(block, seed_words))
        out = out.where(_clean(shared, seed_words, threshold)(out[text].cast("string")))
    return out


def _clean(shared: Broadcast, seed_words: int, threshold: float) -> Callable[[Column], Column]:
    """A function that tells which texts hold no item."""

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher, index = WordHasher(), shared.value
        for column in columns:
            raws = raw_texts(column)
            fine = np.ones(len(raws), dtype=bool)
            for lo, hi in spans((len(r or b"") for r in raws), CHUNK_BYTES):
                for found in matches(index, hasher, raws[lo:hi], seed_words, threshold):
                    fine[lo + found[0]] = False
            yield pa.array(fine)

    @F.arrow_udf("boolean")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(work)(columns)

    return clean
