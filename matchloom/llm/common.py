"""What the operators of this subpackage share: staged tables, Arrow batches and word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that Python handles at once; it bounds the memory of a worker, not what is read.
CHUNK_BYTES = 1 << 20
#: Rows in an Arrow batch at most. Texts can be long, so batches are small.
BATCH_ROWS = 500
#: Words whose hash or tokens a worker remembers. The memory is emptied when full; results don't depend on it.
CACHE_WORDS = 250_000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most BATCH_ROWS rows, as one row can be a whole book.

    Batches are cut when a plan runs, after its operator has returned, so the setting stays. All operators want the same, a smaller value is
    left as it is, and no result depends on where batches end.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the driver ends.

    Without the setting a local session gets a folder of its own; a cluster is refused, as its machines share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="matchloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/matchloom-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return re.sub("^file:/+", "file:///", fs.makeQualified(place).toString())


def stage(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return the table: it cuts lineage and outlives executors."""
    return stage_at(df)[0]


def stage_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As `stage`, with the folder, so that it can be given to `discard` once nothing reads the table any more."""
    folder = work_dir(df.sparkSession)
    df.write.parquet(f"{folder}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table"), folder


def discard(spark: SparkSession, folder: str | None) -> None:
    """Delete the folder of a staged table: what was made from it must be staged itself by then."""
    if folder:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Staged tables that are deleted together, once what was made from them is staged itself."""

    def __init__(self) -> None:
        self.folders: list[tuple[SparkSession, str]] = []

    def stage(self, df: DataFrame) -> DataFrame:
        table, folder = stage_at(df)
        self.folders.append((df.sparkSession, folder))
        return table

    def clear(self) -> None:
        while self.folders:
            discard(*self.folders.pop())


def join_split(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner", most: int = 2000) -> DataFrame:
    """rows joined with groups on `key`, of which groups has a row for each value, without one task for the rows of a frequent value.

    groups.size says how many rows have the value, and total how many rows there are. At most `most` values can have more than total / most
    of the rows, so those are broadcast, however large the tables, and rows with them stay where they are; the others meet in an even
    shuffle. groups should be a stored table, as it is read three times; rows is read twice. how: inner or left.
    """
    limit = max(1, total // most)
    hot, cold = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    keys = F.broadcast(hot.select(key))
    of_hot = rows.join(F.broadcast(hot), key)
    return of_hot.unionByName(rows.join(keys, key, "left_anti").join(cold, key, how))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def give_back() -> None:
    """Return freed memory to the machine: workers outlive tasks, and what one stage has freed the next may not reuse."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has this
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work on batches, giving memory back when the task's batches end."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        give_back()

    return run


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


def spans(lengths: Iterable[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `most` bytes; a longer row gets a range of its own."""
    lo = size = 0
    hi = -1
    for hi, n in enumerate(lengths):
        if size and size + n > most:
            yield lo, hi
            lo, size = hi, 0
        size += n
    if hi >= lo:
        yield lo, hi + 1


def by_chunk(batches: Iterable[pa.RecordBatch], text: str, work: Callable[[pa.RecordBatch, list[bytes | None]], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Apply work to slices of the batches that hold about CHUNK_BYTES of the column `text`."""
    for batch in batches:
        raws = raw_texts(batch.column(text))
        for lo, hi in spans(len(r or b"") for r in raws):
            out = work(batch.slice(lo, hi - lo), raws[lo:hi])
            if out is not None and out.num_rows:
                yield out


def per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i+1]]; starts has one entry more than there are rows."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    h = np.asarray(h, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the windows of n words, from the words' hashes."""
    m = max(0, len(words) - n + 1)
    h = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix(h)


#: Bytes to bytes: A-Z in lower case, what is neither a letter, a digit nor outside ASCII to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes to bytes: ASCII white space to a space.
SPACED = bytes(32 if b in b" \t\n\v\f\r" else b for b in range(256))


class Memo:
    """Numbers words: a word's number indexes what `learn` appended for it. Bounded by emptying between chunks."""

    def __init__(self, learn: Callable[[list[bytes]], None], reset: Callable[[], None], most: int = CACHE_WORDS):
        self.learn, self.reset, self.most, self.known = learn, reset, most, {}

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
            self.reset()
        out = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing.tolist()))
            at = len(self.known)
            self.learn(new)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
            out[missing] = np.fromiter((self.known[words[i]] for i in missing.tolist()), dtype=np.int64, count=len(missing))
        return out


class WordHasher:
    """64-bit hashes of folded words, the same on every machine.

    All words of a chunk are hashed at once, eight bytes in a step: the bytes, as a number, are joined to the hash so far and mixed. The few words
    of more than LONG bytes go through BLAKE2.
    """

    LONG = 64
    _MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    _P = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, fold: bytes = FOLD) -> None:
        self.fold = fold

    def of(self, raws: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts one after the other, and where each text starts (one entry more than texts)."""
        parts = [r or b"" for r in raws]
        found, starts, n = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], 0
        for lo, hi in spans(map(len, parts), 1 << 20):  # a piece's arrays take some twenty times its bytes
            words, at = self.places(parts[lo:hi])[:2]
            found.append(words)
            starts.append(at[1:] + n)
            n += len(words)
        return np.concatenate(found), np.concatenate(starts)

    def places(self, raws: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """As `of`, and the texts joined by spaces with each word's first byte and the byte after its last."""
        parts = [r or b"" for r in raws]
        offsets = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum(np.fromiter((len(r) + 1 for r in parts), dtype=np.int64, count=len(parts)), out=offsets[1:])
        joined = b" ".join(parts) + b" "
        folded = joined.translate(self.fold) + b" " * 8
        inside = np.zeros(len(joined) + 1, dtype=np.int8)
        inside[1:] = np.frombuffer(folded, dtype=np.uint8)[: len(joined)] != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1])  # the last byte is a space, so starts and ends alternate
        first, last = edges[::2], edges[1::2]
        return self._hashes(folded, first, last - first), np.searchsorted(first, offsets), joined, first, last

    def _hashes(self, folded: bytes, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        eights = np.ndarray((len(folded) - 7,), dtype="<u8", buffer=folded, strides=(1,))  # the eight bytes from each place on
        h = mix(lengths.astype(np.uint64) * self._P)
        todo, at, left = np.arange(len(first)), first, np.where(lengths <= self.LONG, lengths, 0)
        while len(todo):
            h[todo] = mix((h[todo] ^ (eights[at] & self._MASKS[np.minimum(left, 8)])) * self._P)
            more = np.flatnonzero(left > 8)
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(lengths > self.LONG).tolist():
            word = folded[first[i] : first[i] + lengths[i]]
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h
