"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything that is no letter becomes a space, runs of spaces become one. Windows of 1 to `orders`
characters are hashed into cells: as many as keep the model of all languages within MODEL_BYTES, BUCKETS at most. `fit` counts cells by language over a bounded sample of labelled rows, in Spark; the
matrix of log-probabilities (languages x buckets) is broadcast; `predict` sums its columns over the sparse cells of a batch in numpy.
Scoring is one pass without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the first language in alphabetical order;
with no training rows every text is ``und``. Null ids never train. Repeated rows are predicted alike; a long text is read whole; an empty table
gives no rows; names that a table has already get a number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import per_row, small_batches, spans, tidy

#: Rows that training reads about; which ones, a hash of the id decides.
MAX_TRAIN_ROWS = 20_000
#: Cells of an order at most, and bytes of the matrix that is broadcast: with more languages than 85 there are fewer cells, but never fewer languages.
BUCKETS, ORDERS, ALPHA, MODEL_BYTES = 1 << 16, 3, 0.5, 64 << 20
#: Characters handled at once.
CHUNK_CHARS = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def _letter_table() -> np.ndarray:
    """For each code point of the first plane whether it is a letter or a combining mark."""
    found = np.zeros(1 << 16, dtype=bool)
    for m in regex.finditer(r"[\p{L}\p{M}]+", "".join(map(chr, [*range(0xD800), *[32] * 0x800, *range(0xE000, 0x10000)]))):
        found[m.start() : m.end()] = True
    return found


class Cells:
    """Hashed character n-grams of texts."""

    def __init__(self, buckets: int = BUCKETS, orders: int = ORDERS):
        self.letters, self.buckets, self.orders = _letter_table(), buckets, orders

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each order the cells of all texts one after the other (a window that has no letter, or crosses texts, is `buckets`); and the texts' starts."""
        lowered = [t.lower() + "\n" for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype="<u4")
        ends = np.cumsum(np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered)))
        letter = self.letters[np.minimum(points, 0xFFFF)] | (points > 0xFFFF)
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of each run of other characters the first stays, as a space
        kept = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(keep, out=kept[1:])
        starts = np.concatenate([[0], kept[ends]])
        c = np.where(letter, points, 0)[keep].astype(np.uint32)
        out, h = [], c * np.uint32(0x9E3779B1)
        shift = np.uint32(32 - int(np.log2(self.buckets)))
        for order in range(1, self.orders + 1):
            cells = np.full(len(c), self.buckets, dtype=np.int32)
            m = len(c) - order + 1
            if m > 0:
                if order > 1:
                    h = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[order - 1 :] * np.uint32(0xC2B2AE35)
                g = (h[:m] ^ (h[:m] >> np.uint32(13))) * np.uint32(0x9E3779B1)
                cells[:m] = g >> shift
                if order == 1:
                    cells[c == 0] = self.buckets
                else:  # a space may begin or end a window, not stand inside it
                    for k in range(1, order - 1):
                        cells[:m][c[k : k + m] == 0] = self.buckets
                    if order > 1:
                        cells[:m][(c[:m] == 0) & (c[order - 1 :] == 0)] = self.buckets
                    # windows must not cross texts
                    for k in range(1, order):
                        bad = starts[1:] - k
                        cells[bad[bad >= 0]] = self.buckets
            out.append(cells)
        return out, starts


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # (orders, buckets + 1, languages); the last cell weighs nothing
    prior: np.ndarray


def _pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for lo, hi in spans((len(t or "") for t in texts), CHUNK_CHARS):
            yield batch.slice(lo, hi - lo), texts[lo:hi]


def fit(rows: DataFrame, text: str, lang: str, buckets: int = BUCKETS, orders: int = ORDERS, alpha: float = ALPHA, model_bytes: int = MODEL_BYTES) -> Model:
    """Counts are summed by task, then by Spark: at most model_bytes / 4 of them reach the driver, whose arrays are as large."""
    small_batches(rows.sparkSession)
    labelled = rows.select(rows[text].cast("string").alias("text"), rows[lang].cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # at most as many as training rows
    langs = sorted(sizes)
    while buckets > 2 and 4 * orders * buckets * len(langs) > model_bytes:
        buckets //= 2
    number = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, total = Cells(buckets, orders), {}
        for batch, texts in _pieces(batches, "text"):
            names = batch.column("lang").to_pylist()
            found, starts = cells.of(texts)
            for i, name in enumerate(names):
                if name in number:
                    own = total.setdefault(name, np.zeros((orders, buckets + 1), dtype=np.int64))
                    for k in range(orders):
                        np.add.at(own[k], found[k][starts[i] : starts[i + 1]], 1)
        for name, own in total.items():
            order, cell = np.nonzero(own[:, :buckets])
            yield pa.RecordBatch.from_arrays([pa.array([number[name]] * len(cell), pa.int32()), pa.array(order, pa.int32()), pa.array(cell, pa.int32()), pa.array(own[order, cell], pa.int64())], names=["l", "o", "c", "n"])

    log_p = np.zeros((orders, buckets + 1, len(langs)), dtype=np.float32)
    if langs:
        found = labelled.mapInArrow(tidy(count), "l int, o int, c int, n long").groupBy("l", "o", "c").agg(F.sum("n").alias("n")).toArrow()
        log_p[found["o"].to_numpy(), found["c"].to_numpy(), found["l"].to_numpy()] = found["n"].to_numpy()
        del found
        for p in log_p:  # an order at a time, in place
            total = p.sum(axis=0, dtype=np.float64) + alpha * buckets
            p[:buckets] += alpha
            np.log(p[:buckets], out=p[:buckets])
            p[:buckets] -= np.log(total).astype(np.float32)
            p[:buckets] -= p[:buckets].max(axis=1, keepdims=True)  # what all languages share doesn't tell them apart; without it sums stay small
    n = np.array([sizes[x] for x in langs], dtype=float)
    return Model(langs, log_p, np.log(n / max(1.0, n.sum())))


def predict(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """rows with lang_pred and score, the posterior probability of that language, appended; names that rows has already get a number."""
    from matchloom.llm.common import fresh

    small_batches(rows.sparkSession)
    shared, n_langs = rows.sparkSession.sparkContext.broadcast(model), len(model.langs)

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        orders, buckets = m.log_p.shape[0], m.log_p.shape[1] - 1
        cells = Cells(buckets, orders)
        for column in columns:
            texts = column.to_pylist()
            names, scores = [], []
            for lo, hi in spans((len(t or "") for t in texts), CHUNK_CHARS):
                part = [t or "" for t in texts[lo:hi]]
                found, starts = cells.of(part)
                total = np.tile(m.prior, (len(part), 1))
                for k in range(orders):
                    for j in range(n_langs):
                        total[:, j] += per_row(m.log_p[k, :, j][found[k]], starts)
                for i, t in enumerate(part):
                    if not n_langs or not _LETTER.search(t):
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best = int(total[i].argmax())
                    names.append(m.langs[best])
                    scores.append(float(1 / np.exp(total[i] - total[i, best]).sum()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def tell(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(work)(columns)

    told = fresh(rows, "told")
    return rows.withColumn(told, tell(rows[text].cast("string"))).select(*rows.columns, F.col(f"{told}.lang_pred").alias(fresh(rows, "lang_pred")), F.col(f"{told}.score").alias(fresh(rows, "score")))


def train_and_predict(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows whose crc32(doc_id) mod 4 is 2 are held out of training.

    max_train_rows bounds the training rows: of more, those with the smallest hashes of their ids are taken.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    view = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    usable = view.where((fold != 2) & F.col("lang").isNotNull())
    n = usable.select("doc_id").count()
    share = 1 << 30 if n <= max_train_rows else int((1 << 30) * max_train_rows / n)
    model = fit(usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share), "text", "lang")
    return predict(view.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
