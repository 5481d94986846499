"""Language-model scores by stupid backoff, computed relationally.

Words are the runs of letters and digits of the lower-cased text. Counts of n-grams up to `order` cover all documents; of those of two words
or more the model keeps what occurs `min_count` times. A word scores count(n-gram) / count(context) for the longest n-gram that ends with it
and is kept, times `alpha` for each step of backoff; one word alone scores its share of all words.

Documents of a scan partition form blocks of about BLOCK_BYTES, cut by the texts' sizes alone. A block's distinct n-grams, with the block's counts (so
frequent n-grams are combined before the shuffle), are dealt by the leading bits of their hashes to at most 2**FAN_BITS parts of the count
table; a part adds up what all blocks ask for and sends each block its totals; blocks then meet their totals in a join and sum each document's
scores. A block sends at most 2**FAN_BITS rows, so rows grow as the corpus does. Where a part would hold more than RANGE_BYTES of text, its
rows first meet in groups of 2**FAN_BITS blocks, which combine their counts and ask the next level, by the next bits of the hashes: a level for
every factor of 2**FAN_BITS. So a task holds a block, a group's rows or a part of bounded size, whatever the corpus. Rows carry packed arrays:
sorted 64-bit hashes of n-grams as differences, and counts. A row for each n-gram of each document would be the plainer relation; at some 20
bytes of shuffle for each of three n-grams a word it writes several times what it reads, which packing avoids.

Defined results: a null text, or one without a word, has 0 words and null scores; repeated rows are counted, and scored, one by one; a long text is
a block of its own, and whole; ties don't arise; an empty table gives no rows; other columns don't matter. The table must give the same rows in
the same partitions when it is read again, as a stored table does; a checksum of each block refuses others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import FOLD, Scratch, WordHasher, give_back, ngram_hashes, per_row, small_batches, stage, tidy

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Bytes of text of a block, and of all text for each part of the count table at most; bits of a hash that a level deals by.
BLOCK_BYTES, RANGE_BYTES, FAN_BITS = 6 << 20, 16 << 20, 11
_ROWS = "part long, block long, checksum long, words long"
_OTHER = regex.compile(r"[^\x00-\x7F\p{L}\p{N}]+")


def folded(text: str | None) -> bytes:
    """Lower-cased bytes that FOLD cuts into the text's words."""
    if not text:
        return b""
    if not text.isascii():
        return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")
    return text.encode()


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences (low bytes as they are, the others and the counts compressed)."""
    import zstandard

    steps = np.diff(values, prepend=np.uint64(0)) if len(values) else values
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    rest = zstandard.compress(np.ascontiguousarray(planes[5:]).tobytes() + np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)
    return struct.pack("<q", len(values)) + np.ascontiguousarray(planes[:5]).tobytes() + rest


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n = struct.unpack_from("<q", data)[0]
    low = np.frombuffer(data, dtype=np.uint8, count=5 * n, offset=8).reshape(5, n)
    rest = np.frombuffer(zstandard.decompress(data[8 + 5 * n :]), dtype=np.uint8)
    planes = np.concatenate([low, rest[: 3 * n].reshape(3, n)])
    counts = np.ascontiguousarray(rest[3 * n :].reshape(4, n).T).view("<u4").reshape(-1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64), counts


def _pack_totals(totals: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(totals.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_totals(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1).T).view("<u8").reshape(-1).astype(np.int64)


class Block:
    """The n-grams of some documents: for each order the hash of the n-gram that ends with a word, where it has one."""

    def __init__(self, hasher: WordHasher, texts: list[str | None], order: int):
        self.words, self.starts = hasher.of(map(folded, texts))
        self.before = np.arange(len(self.words)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        self.ends = [np.flatnonzero(self.before >= n - 1) for n in range(1, order + 1)]
        self.hashes = [ngram_hashes(self.words, n)[at - (n - 1)] ^ np.uint64(n) if len(at) else np.zeros(0, dtype=np.uint64) for n, at in enumerate(self.ends, 1)]
        self.checksum = int(np.add.reduce(self.words * (np.arange(len(self.words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)))) >> 1 if len(self.words) else 0

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of all orders, and how often each occurs."""
        every = np.sort(np.concatenate(self.hashes))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=np.int64)
        return every[first], np.diff(np.concatenate([first, [len(every)]]))

    def scores(self, totals: np.ndarray, n_words: int, alpha: float, min_count: int) -> np.ndarray:
        """The summed logarithm of each document, from the totals of the distinct hashes in order."""
        step = np.log(alpha)
        which = np.unique(np.concatenate(self.hashes), return_inverse=True)[1]
        cuts = np.cumsum([0, *map(len, self.hashes)])
        deepest = np.minimum(self.before, len(self.hashes) - 1)
        value, shorter = np.zeros(len(self.words)), None
        for n, at in enumerate(self.ends):
            counts = np.zeros(len(self.words), dtype=np.int64)
            counts[at] = totals[which[cuts[n] : cuts[n + 1]]]
            if n == 0:
                value = np.log(np.maximum(counts, 1) / max(1, n_words)) + deepest * step
            else:
                kept = np.flatnonzero(counts >= min_count)
                value[kept] = np.log(counts[kept] / shorter[kept - 1]) + (deepest[kept] - n) * step
            shorter = counts
        return per_row(value, self.starts)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """Blocks of consecutive documents, numbered by partition and place. Where they are cut depends on the rows alone."""
    context = TaskContext.get()
    base, number, kept, size = (context.partitionId() if context else 0) << 24, 0, [], 0
    for batch in batches:
        lo = 0
        for hi, n in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), 1):
            size += n + 16
            if size >= most:
                kept.append(batch.slice(lo, hi - lo))
                yield base + number, pa.Table.from_batches(kept)
                number, kept, size, lo = number + 1, [], 0, hi
        if lo < batch.num_rows:
            kept.append(batch.slice(lo))
    if kept:
        yield base + number, pa.Table.from_batches(kept)


def _dealt(hashes: np.ndarray, counts: np.ndarray, part: int, level: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed) of sorted hashes, cut by their bits of a level; part: the bits of the levels before."""
    own = ((hashes << np.uint64(level * bits)) >> np.uint64(64 - bits)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield part << bits | int(own[lo]), _pack(hashes[lo:hi], counts[lo:hi])


def _rows(rows: list[tuple], last: str) -> pa.Table:
    kinds = [*[pa.int64()] * 4, pa.binary()]
    return pa.table([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=["part", "block", "checksum", "words", last])


def _summed(asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all lists in order, and their counts added up."""
    hashes, which = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
    return hashes, np.bincount(which, weights=np.concatenate([c for _, c in asked]).astype(np.float64)).astype(np.int64)  # exact below 2**53


def _totals(asked: DataFrame, levels: int, bits: int, scratch: Scratch, level: int = 0) -> DataFrame:
    """asked (part, block, checksum, words, grams) with the totals over all blocks of each row's n-grams instead of the n-grams."""

    def answer(table: pa.Table) -> pa.Table:
        lists = [_unpack(x) for x in table["grams"].to_pylist()]
        hashes, totals = _summed(lists)
        out = [_pack_totals(totals[np.searchsorted(hashes, h)]) for h, _ in lists]
        give_back()
        return pa.table([*(table[c] for c in ("part", "block", "checksum", "words")), pa.array(out, pa.binary())], names=["part", "block", "checksum", "words", "totals"])

    if levels == 1:
        return asked.groupBy("part").applyInArrow(answer, f"{_ROWS}, totals binary")

    def merge(table: pa.Table) -> pa.Table:
        hashes, counts = _summed([_unpack(x) for x in table["grams"].to_pylist()])
        part, group = table["part"][0].as_py(), table["group"][0].as_py()
        return _rows([(p, group, 0, 0, packed) for p, packed in _dealt(hashes, counts, part, level + 1, bits)], "grams")

    def spread(table: pa.Table, pieces: pa.Table) -> pa.Table:
        lists = [_unpack(x) for x in table["grams"].to_pylist()]
        hashes, _ = _summed(lists)
        totals = np.concatenate([np.zeros(0, dtype=np.int64), *map(_unpack_totals, pieces.sort_by("piece")["totals"].to_pylist())])
        out = [_pack_totals(totals[np.searchsorted(hashes, h)]) for h, _ in lists]
        give_back()
        return pa.table([*(table[c] for c in ("part", "block", "checksum", "words")), pa.array(out, pa.binary())], names=["part", "block", "checksum", "words", "totals"])

    asked = scratch.stage(asked)
    groups = max(1, -(-asked.select("block").distinct().count() >> bits))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    merged = asked.groupBy("part", "group").applyInArrow(merge, f"{_ROWS}, grams binary")
    found = _totals(merged, levels - 1, bits, scratch, level + 1)
    pieces = found.select(F.shiftright("part", bits).alias("part"), F.col("block").alias("group"), F.col("part").alias("piece"), "totals")
    return asked.groupBy("part", "group").cogroup(pieces.groupBy("part", "group")).applyInArrow(spread, f"{_ROWS}, totals binary")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, n_words, log_prob (natural logarithm, summed) and mean_log_prob of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    size, levels = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 1
    while size > range_bytes << levels * fan_bits:
        levels += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(FOLD)
        for number, table in _blocks(batches, block_bytes):
            block = Block(hasher, table["text"].to_pylist(), order)
            made = [(part, number, block.checksum, len(block.words), packed) for part, packed in _dealt(*block.distinct(), 0, 0, fan_bits)]
            for at in range(0, len(made), 256):
                yield from _rows(made[at : at + 256], "grams").to_batches()

    scratch = Scratch()
    asked = rows.mapInArrow(tidy(ask), f"{_ROWS}, grams binary")
    answers = stage(_totals(asked, levels, fan_bits, scratch))
    scratch.clear()
    n_words = answers.groupBy("block").agg(F.first("words").alias("words")).agg(F.sum("words")).first()[0] or 0

    def number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _blocks(batches, block_bytes):
            place = 0
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([number] * batch.num_rows, pa.int64()), pa.array(range(place, place + batch.num_rows), pa.int64()), batch.column("doc_id"), batch.column("text")], names=["block", "place", "doc_id", "text"])
                place += batch.num_rows

    def judge(documents: pa.Table, totals: pa.Table) -> pa.Table:
        documents, totals = documents.sort_by("place"), totals.sort_by("part")
        block = Block(WordHasher(FOLD), documents["text"].to_pylist(), order)
        distinct, _ = block.distinct()
        found = np.concatenate([np.zeros(0, dtype=np.int64), *map(_unpack_totals, totals["totals"].to_pylist())])
        if len(found) != len(distinct) or any(x != block.checksum for x in totals["checksum"].to_pylist()):
            raise ValueError("the table gave other rows when it was read again; store it first")
        log_prob = block.scores(found, n_words, alpha, min_count)
        n = np.diff(block.starts)
        none = n == 0
        give_back()
        return pa.table([documents["doc_id"], pa.array(n), pa.array(log_prob, mask=none), pa.array(log_prob / np.maximum(1, n), mask=none)], names=["doc_id", "n_words", "log_prob", "mean_log_prob"])

    numbered = rows.mapInArrow(tidy(number_rows), f"block long, place long, doc_id {kind}, text string")
    return numbered.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, f"doc_id {kind}, n_words long, log_prob double, mean_log_prob double")
