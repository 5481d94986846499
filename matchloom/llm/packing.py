"""Best-fit packing of documents into sequences of at most `seq_len` tokens.

Only documents longer than a sequence are cut. Packing is bulk-synchronous: pieces are range-sorted by length, which gives each piece
a rank among those of its length; rounds go from the longest length to the shortest. In a round all pieces of one length look for
the gap that follows their length in the sorted gaps (the smallest that holds them); where several want the same gap, the lower rank
gets it and fills it as often as it fits, the next ones go on to the next gap; gaps are updated; what finds no gap opens
sequences. This is best-fit decreasing. As pieces of one length, and gaps of one size, are alike, a round works on runs of them
(length, first rank, count), not on pieces: the table of gaps has at most `seq_len` sizes, and all rounds together make no more than
seq_len * (1 + 3 * log2(seq_len)) runs however many documents there are (each length adds at most three runs of gaps, and filling a
run leaves less than half its gap). So the sweep is small enough for one process, while tokenising, sorting, ranking and placing stay
distributed. A piece of a hot length costs nothing extra: the range sort splits lengths by a hash.

Defined results: a null text is empty and gives one piece, the end token alone; repeated rows are packed one by one; pieces of one length go by
a hash of their rows; a long text is cut and kept whole; an empty table gives no rows; null ids stay null; other columns don't matter.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import SPACED, WordHasher, by_chunk, fresh, small_batches, stage, tidy

SEQ_LEN, END = 4096, 1
#: Texts with these go to the tokenizer whole: white space on which libraries differ, and special tokens.
_WHOLE = (b"<|", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: A word of Latin-1 letters and then punctuation: the tokenizer cuts it between them, and its lower case is Python's.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: Fixed value: how a tokenizer must cut texts for its words to be remembered.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose ids a worker remembers: about 60 MB.
CACHE_WORDS = 1_500_000
#: Rows of the final plan (runs of pieces) that a broadcast may have; beyond, it is joined. Rounds give at most about 150,000; range partitions add theirs.
MAX_BROADCAST_RUNS = 2_000_000


class Tokens:
    """Ids of texts, as little-endian unsigned 32-bit numbers.

    A tokenizer that cuts texts at white space before anything else, into words whose last token is marked, gives a word the same ids
    whatever its neighbours; so words' ids are remembered, up to CACHE_WORDS words. They are looked up by 64-bit hashes, and their bytes are then
    compared, so words with one hash don't get each other's ids: texts with such a word go to the tokenizer whole. When there are too many,
    those seen in one chunk only since the last time are forgotten. New words of letters go through the same merges without the normaliser, which leaves them as they are,
    many in one call; the marks tell where each ends. Other tokenizers get whole texts.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.hasher = WordHasher(SPACED)
        self.hashes, self.flat = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype="<u4")
        self.offsets, self.lengths, self.used = (np.zeros(0, dtype=np.int32) for _ in range(3))
        self.bytes, self.bytes_at, self.bytes_long = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)  # the words themselves
        form = json.loads(self.tokenizer.to_str())
        steps = [(x["type"], x.get("behavior"), x.get("invert"), x.get("use_regex")) for x in (form["pre_tokenizer"] or {}).get("pretokenizers", [])]
        cuts = [x["pattern"].get("Regex") for x in (form["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_word = steps == [("Split", "Removed", True, None), ("ByteLevel", None, None, False)] and cuts == [_CUT] and form["model"].get("end_of_word_suffix") == "</w>" and [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if self.by_word:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Remember the ids of words, whose hashes are in order and new."""
        parts, cores = [], set()
        for w in words:
            m = _SIMPLE.fullmatch(t := w.decode("utf-8", "replace"))
            parts.append((m[1].lower(), m[2]) if m else (t, ""))
            if m:
                cores.add(parts[-1][0])
        letters, rest = list(cores), list({p for pair in parts for p in pair}.difference(cores))
        ids = dict(zip(letters, self._letters(letters), strict=True))
        ids.update(zip(rest, [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)], strict=True))
        made = [ids[a] + ids[b] for a, b in parts]
        lengths = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        at = np.searchsorted(self.hashes, hashes)
        self.offsets = np.insert(self.offsets, at, len(self.flat) + np.cumsum(lengths) - lengths)
        self.hashes, self.lengths, self.used = np.insert(self.hashes, at, hashes), np.insert(self.lengths, at, lengths), np.insert(self.used, at, 0)
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(made), dtype="<u4")])
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.bytes_at, self.bytes_long = np.insert(self.bytes_at, at, len(self.bytes) + np.cumsum(sizes) - sizes), np.insert(self.bytes_long, at, sizes)
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), dtype=np.uint8)])

    def _forget(self) -> None:
        keep = self.used > 1
        if keep.sum() > self.most // 2:
            keep[:] = False
        self.flat, self.bytes = _gather(self.flat, self.offsets[keep], self.lengths[keep]), _gather(self.bytes, self.bytes_at[keep], self.bytes_long[keep])
        self.bytes_long = self.bytes_long[keep]
        self.bytes_at = np.cumsum(self.bytes_long, dtype=np.int32) - self.bytes_long
        self.hashes, self.lengths = self.hashes[keep], self.lengths[keep]
        self.offsets, self.used = np.cumsum(self.lengths, dtype=np.int32) - self.lengths, np.zeros(len(self.hashes), dtype=np.int32)

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin-1 letters, five hundred in a call."""
        if not words:
            return []
        lines = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *(np.array(e.ids, dtype="<u4") for e in self.plain.encode_batch_fast(lines, add_special_tokens=False))])
        ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):
            raise ValueError("a word has not one last token")
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def of(self, raws: list[bytes | None]) -> list[bytes]:
        whole = {i: self._encode(raw.decode("utf-8", "replace")) for i, raw in enumerate(raws) if raw and (not self.by_word or any(x in raw for x in _WHOLE))}
        hashes, starts, joined, first, last = self.hasher.places(b"" if i in whole else raw for i, raw in enumerate(raws))
        distinct, which = np.unique(hashes, return_inverse=True)
        if len(self.hashes) + len(distinct) > self.most or max(len(self.flat), len(self.bytes)) > 1 << 30:  # places are 32-bit numbers
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            some = np.zeros(len(distinct), dtype=np.int64)
            some[which] = np.arange(len(which))  # a place where each word stands
            some = some[new]
            self._learn(distinct[new], [joined[a:b] for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        if len(at):
            self.used[at] += 1
        of = at[which]
        data = np.frombuffer(joined, dtype=np.uint8)
        same = [_equal(data, first[i : i + 50_000], (last - first)[i : i + 50_000], self.bytes, self.bytes_at[of[i : i + 50_000]], self.bytes_long[of[i : i + 50_000]]) for i in range(0, len(of), 50_000)]
        for k in np.flatnonzero(~np.concatenate([np.zeros(0, dtype=bool), *same])).tolist():  # another word with the hash of a remembered one
            i = int(np.searchsorted(starts, k, side="right")) - 1
            if i not in whole:
                whole[i] = self._encode(raws[i].decode("utf-8", "replace"))
        lengths = self.lengths[of]
        ids = _gather(self.flat, self.offsets[of], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[starts].tolist()
        return [(whole[i] if i in whole else ids[ends[i] : ends[i + 1]]).tobytes() for i in range(len(raws))]


def _gather(flat: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[at[i]:at[i] + lengths[i]] for all i, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return flat[np.repeat(at - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _equal(a: np.ndarray, a_at: np.ndarray, a_long: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_long: np.ndarray) -> np.ndarray:
    """For each i whether a and b have the same a_long[i], and b_long[i], values from a_at[i] and b_at[i] on."""
    out = a_long == b_long
    own = np.flatnonzero(out)
    ends = np.cumsum(a_long[own])
    out[own[np.searchsorted(ends, np.flatnonzero(_gather(a, a_at[own], a_long[own]) != _gather(b, b_at[own], a_long[own])), side="right")]] = False
    return out


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN, end: int | None = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every document, and with with_ids their ids (binary, little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    file, tail = path or public_tokenizers.path("word_bpe_49k.json"), b"" if end is None else int(end).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(file)

        def work(batch: pa.RecordBatch, raws: list[bytes | None]) -> pa.RecordBatch:
            rows, out = [], []
            for i, ids in enumerate(tokens.of(raws)):
                ids += tail
                for k, at in enumerate(range(0, max(len(ids), 1), 4 * seq_len)):
                    part = ids[at : at + 4 * seq_len]
                    rows.append(i)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(kinds)])
            made = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *(pa.array(x, type=k) for x, k in zip(made, kinds, strict=True))], names=names)

        return by_chunk(batches, "text", work)

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def rounds(lengths: list[tuple[int, int]], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit for (length, count): runs (length, first rank, count, per sequence, first sequence, offset) in order of length and rank.

    In a run, rank first + i goes to sequence first sequence + i // per at offset + (i % per) * length.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size: runs of sequences (first, count) that have it
    sizes: list[int] = []  # sorted


    def add(size: int, first: int, n: int) -> None:
        if size and n:
            if not gaps[size]:
                bisect.insort(sizes, size)
            gaps[size].append((first, n))

    out, opened = [], 0
    for length, count in sorted((x for x in lengths if x[1]), reverse=True):
        rank = 0
        if length == 0:  # nothing to place: all in the first sequence, or in one of their own
            out.append((0, 0, count, count, 0, 0))
            opened = max(opened, 1)
            continue
        while rank < count:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del sizes[at]
            else:
                size, first, n = seq_len, opened, -(-(count - rank) // (seq_len // length))
                opened += n
            per, left = size // length, count - rank
            full = min(n, left // per)
            if full:
                out.append((length, rank, full * per, per, first, seq_len - size))
                add(size - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and 0 < left < per:
                out.append((length, rank, left, per, first + full, seq_len - size))
                add(size - left * length, first + full, 1)
                rank, full = rank + left, full + 1
            add(size, first + full, n - full)
    return out


def pack(parts: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """parts (any table with an integer column length, at most seq_len) with sequence_id and offset; parts should be a stored table."""
    low, salt, place, run_of = (fresh(parts, x) for x in ("sorted_length", "salt", "place", "run"))
    n = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.xxhash64(*[parts[c] for c in parts.columns if c != "ids"])
    sorted_parts = parts.withColumn(low, F.col("length").cast("long")).withColumn(salt, key).repartitionByRange(n, F.desc(low), salt).sortWithinPartitions(F.desc(low), salt).drop(salt)
    kept = stage(sorted_parts.withColumn(place, F.monotonically_increasing_id()))
    # A range partition holds few lengths, each in one run of places: at most lengths + partitions runs in all.
    found = kept.groupBy(F.shiftright(place, 33).alias("p"), F.col(low).alias("l")).agg(F.min(place).alias("at"), F.count("*").alias("n")).toArrow().to_pylist()
    if found and max(r["l"] for r in found) > seq_len:
        raise ValueError(f"a piece is longer than {seq_len}")
    found.sort(key=lambda r: (-r["l"], r["at"]))
    total: dict[int, int] = defaultdict(int)
    for r in found:
        total[r["l"]] += r["n"]
    by_length = defaultdict(list)
    for x in rounds(list(total.items()), seq_len):
        by_length[x[0]].append(x)
    # Cut the runs of ranks at the runs of places.
    plan, ranked = [], defaultdict(int)
    todo = {length: (list(reversed(runs))) for length, runs in by_length.items()}
    for r in found:
        length, at, left = r["l"], r["at"], r["n"]
        while left:
            _, first, count, per, seq, offset = run = todo[length][-1]
            skip = ranked[length] - first
            take = min(left, count - skip)
            plan.append((at, take, skip, per, seq, offset))
            at, left, ranked[length] = at + take, left - take, ranked[length] + take
            if skip + take == count:
                todo[length].pop()
            del run
    plan.sort()
    if len(plan) > MAX_BROADCAST_RUNS:
        return _joined(kept, plan, low, place, parts.columns)
    table = kept.sparkSession.sparkContext.broadcast(np.array(plan, dtype=np.int64).reshape(-1, 6))

    def work(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        runs = table.value
        for places, lengths in columns:
            at, size = places.to_numpy(zero_copy_only=False), lengths.to_numpy(zero_copy_only=False)
            own = runs[np.searchsorted(runs[:, 0], at, side="right") - 1]
            i = at - own[:, 0] + own[:, 2]
            yield pa.StructArray.from_arrays([pa.array(own[:, 4] + i // own[:, 3]), pa.array(own[:, 5] + i % own[:, 3] * size)], names=["sequence_id", "offset"])

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def assign(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from tidy(work)(columns)

    return kept.withColumn(run_of, assign(place, low)).select(*parts.columns, F.col(f"{run_of}.sequence_id").alias("sequence_id"), F.col(f"{run_of}.offset").alias("offset"))


def _joined(kept: DataFrame, plan: list[tuple], low: str, place: str, columns: list[str]) -> DataFrame:
    """As `assign`, for a plan too large to broadcast: runs are cut at range partitions already, so they join by partition and place."""
    runs = kept.sparkSession.createDataFrame(plan, "at long, n long, skip long, per long, seq long, first long")
    same = (F.shiftright(place, 33) == F.shiftright("at", 33)) & (F.col(place) >= F.col("at")) & (F.col(place) < F.col("at") + F.col("n"))
    i = F.col(place) - F.col("at") + F.col("skip")
    return kept.join(runs, same).select(*columns, (F.col("seq") + F.floor(i / F.col("per"))).alias("sequence_id"), (F.col("first") + i % F.col("per") * F.col(low)).alias("offset"))


def best_fit(docs: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    return pack(stage(pieces(docs, seq_len=seq_len)), seq_len)
