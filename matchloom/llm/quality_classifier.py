"""Quality classifier by co-training.

Two logistic regressions see a document in two ways: the text view has the frequencies of hashed three-byte strings of the whole text and the
numbers of its layout (lines, shares of capitals, digits, symbols and white space, distinct words); the metadata view has what comes with a page and nothing read from its text: recorded language, source and length. Each round both views are
fitted and calibrated, score every unlabelled document in a pass without a shuffle, and each gives the documents that it is surest of
among all, with their labels, to the other view. At the end the views' calibrated log-odds are combined by a third regression, on labelled rows
of its own, and every document is scored in one pass. Labelled rows are dealt to folds: three fifths fit the views, a fifth calibrates
them, a fifth combines them.

Fitting reads a bounded sample of the labelled rows: at most max_labelled / 2 of each class, those with the smallest hashes of their ids, so a
rare class is there; weights give the classes their shares of all labels back. A view teaches at most max_taught documents a round, shared out
by class, of any number that qualify. Only these rows' features reach the driver, in one array that is fitted in place.

Defined results: a null text counts as empty; missing metadata is a value of its own; without labels of both classes, and for an empty table, every
document is accepted with score 1; rows without a label or id never train; of rows with one id the one with the least features trains; ties of confidence
go to the smaller id; repeated rows are scored alike, a long text whole; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import discard, fresh, give_back, raw_texts, small_batches, spans, stage_at, tidy

MAX_LABELLED, MAX_TAUGHT, ROUNDS, SURE = 4000, 200, 3, 0.97
BUCKETS, LAYOUT, NAME_CELLS, LENGTHS = 2048, 10, 64, 16
CHUNK_BYTES = 1 << 19
#: Confidences are compared in steps of this, so that they don't depend on the last bits of sums.
STEP = 1e-9


#: Byte classes: other, capital, digit, symbol, sentence mark, line end, other white space, part of a character outside ASCII.
_CLASS = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 4 if b in b".,;:?!'\"-()" else 5 if b == 10 else 6 if b in b" \t\r\v\f" else 7 if b >= 128 else 0 if 97 <= b <= 122 else 3 for b in range(256)], dtype=np.int64)


def text_view(raws: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed three-byte strings, and the layout, to half precision."""
    n = len(raws)
    out = np.zeros((n, BUCKETS + LAYOUT), dtype=np.float32)
    if not n:
        return out
    data = np.frombuffer(b"\0\0".join(raws) + b"\0\0", dtype=np.uint8)
    lengths = np.fromiter((len(r) + 2 for r in raws), dtype=np.int64, count=n)
    rows = np.repeat(np.arange(n), lengths)
    wide = data.astype(np.uint32)
    h = ((wide[:-2] * np.uint32(0x10001) + wide[1:-1] * np.uint32(0x101)) ^ wide[2:]) * np.uint32(0x9E3779B1)
    cells = (h >> np.uint32(32 - int(np.log2(BUCKETS)))).astype(np.int64)
    own = np.ones(len(data), dtype=bool)
    own[np.cumsum(lengths) - 1] = own[np.cumsum(lengths) - 2] = False  # strings that begin between texts belong to none
    own = own[: len(cells)]
    counts = np.bincount(rows[: len(cells)][own] * BUCKETS + cells[own], minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    kinds = np.bincount(rows * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)
    size = np.maximum(1, lengths - 2)
    kinds[:, 3] -= 2  # the two bytes between texts
    layout = out[:, BUCKETS:]
    layout[:, 0:5] = np.sqrt(kinds[:, 1:6] / size[:, None])
    layout[:, 5] = np.sqrt(kinds[:, 7] / size)
    layout[:, 6] = np.log1p(lengths) / 10
    layout[:, 7] = np.log1p(lengths / (1 + kinds[:, 5])) / 10
    for i, raw in enumerate(raws):
        words, lines = raw.split(), raw.split(b"\n")
        layout[i, 8] = len(set(words)) / len(words) ** 0.9 if words else 0
        layout[i, 9] = len(set(lines)) / len(lines)
    return out.astype(np.float16).astype(np.float32)


def meta_view(names: list[list], numbers: list[float | None]) -> np.ndarray:
    """Hashed cells of the names (language, source) that come with documents, and the recorded length: its logarithm and a cell for its size."""
    width = len(names[0]) if names else 0
    out = np.zeros((len(names), 1 + LENGTHS + NAME_CELLS * width), dtype=np.float32)
    for i, (own, number) in enumerate(zip(names, numbers, strict=True)):
        if number is None or not np.isfinite(number):
            out[i, 1] = 1
        else:
            size = np.log1p(max(0.0, number))
            out[i, 0], out[i, 1 + min(LENGTHS - 1, 1 + int(size))] = size / 10, 1
        for k, name in enumerate(own):
            out[i, 1 + LENGTHS + NAME_CELLS * k + (crc32(str(name).encode()) % (NAME_CELLS - 1) + 1 if name is not None else 0)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights of a logistic regression, the last one the constant; accelerated gradient steps, without a copy of x."""
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    v, t = w.copy(), 1.0
    share = (weights / weights.sum()).astype(np.float32)
    curve = 0.25 * (float(share @ np.einsum("ij,ij->i", x, x)) + 1) + penalty
    slope = np.empty_like(w)
    for _ in range(steps):
        off = share * (1 / (1 + np.exp(-np.clip(x @ v[:-1] + v[-1], -30, 30))) - y)
        slope[:-1], slope[-1] = off @ x, off.sum()
        new = v - (slope + penalty * v) / curve
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = (new + (last - 1) / t * (new - w)).astype(np.float32), new
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(z: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, pull: float = 1e-3) -> tuple[np.ndarray, float]:
    """Slopes and a constant that turn log-odds z (rows x views) into probabilities of y; and the length of the loss's slope there, next to 0.

    Platt's softened targets; Newton's steps, halved until the loss falls. `pull` draws slopes weakly to 1 / views, so separable rows have an answer.
    """
    z = np.hstack([z, np.ones((len(z), 1))]).astype(float)
    share = np.ones(len(y)) if weights is None else weights / weights.mean()
    good, bad = float(share @ y), float(share @ (1 - y))
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    start = np.concatenate([np.full(z.shape[1] - 1, 1 / max(1, z.shape[1] - 1)), [0.0]])
    pulls = np.concatenate([np.full(z.shape[1] - 1, pull), [1e-9]])

    def loss(w: np.ndarray) -> float:
        s = z @ w
        return float(share @ (np.logaddexp(0, s) - target * s)) + 0.5 * float(pulls @ (w - start) ** 2)

    def slope(w: np.ndarray) -> np.ndarray:
        return z.T @ (share * (1 / (1 + np.exp(-np.clip(z @ w, -500, 500))) - target)) + pulls * (w - start)

    w = start.copy()
    now = loss(w)
    for _ in range(100):
        g = slope(w)
        if np.abs(g).max() < 1e-7 * max(1.0, share.sum()):
            break
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        h = (z * (share * p * (1 - p))[:, None]).T @ z + np.diag(pulls)
        step, size = np.linalg.lstsq(h, g, rcond=None)[0], 1.0
        while size > 1e-9 and loss(w - size * step) > now - 1e-4 * size * float(g @ step):
            size /= 2
        w = w - size * step
        now = loss(w)
    return w, float(np.abs(slope(w)).max())


def platt(z: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and constant that calibrate log-odds z. A view that orders the rows wrongly gets a slope of 0: it then says nothing."""
    (a, b), _ = calibrate(z[:, None], y, weights)
    if a <= 0:
        (b,), _ = calibrate(z[:, None][:, :0], y, weights)
        a = 0.0
    return float(a), float(b)


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    scale: tuple[np.ndarray, np.ndarray]
    calibrations: list[tuple[float, float]]
    combine: tuple[float, float, float] = (0.5, 0.5, 0.0)

    def views(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Calibrated log-odds of good quality by text and by metadata, in double precision: the same however rows are cut into batches."""
        return [s * odds(x.astype(np.float64), w.astype(np.float64)) + c for x, w, (s, c) in zip((a, (b.astype(np.float64) - self.scale[0]) / self.scale[1]), (self.text, self.meta), self.calibrations, strict=True)]

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality by text, by metadata and by both."""
        za, zb = self.views(a, b)
        return chance(za), chance(zb), chance(self.combine[0] * np.clip(za, -10, 10) + self.combine[1] * np.clip(zb, -10, 10) + self.combine[2])


#: Rows that a view teaches the other: their features in both views, and their labels.
Taught = tuple[np.ndarray, np.ndarray, np.ndarray]


def shared_out(shares: dict[int, float], most: int) -> dict[int, int]:
    """How many documents of each class a view teaches at most."""
    return {value: max(1, round(most * share)) for value, share in shares.items()}


def cotrain(a: np.ndarray, b: np.ndarray, y: np.ndarray, order: np.ndarray, rounds: int = ROUNDS, sure: float = SURE, weights: np.ndarray | None = None, surest: Callable[[Model, dict[int, int], float], list[Taught]] | None = None, max_taught: int = MAX_TAUGHT) -> Model | None:
    """Fit on views a and b; y is 1, 0, or -1 where there is no label. order: numbers that deal rows to folds. None if a class is missing.

    surest(model, most, sure) gives, for each view, rows not asked for before that the view is sure of, at most so many of each class; without it they are taken from the rows with y = -1.
    """
    known = y >= 0
    weights = np.ones(len(y)) if weights is None else weights
    folds = [known & (order % 5 > 1), known & (order % 5 == 0), known & (order % 5 == 1)]
    if any(len({*y[f].tolist()}) < 2 for f in folds):
        folds = [known] * 3  # too few rows for folds of their own
    train, held, last = (np.flatnonzero(f) for f in folds)
    if len({*y[train].tolist()}) < 2:
        return None
    surest = surest or _from_rows(a, b, np.flatnonzero(~known), order)
    centre, spread = b[train].mean(axis=0), b[train].std(axis=0) + 0.05
    scaled = lambda x: (x - centre) / spread
    shares = {v: float(weights[train][y[train] == v].sum() / weights[train].sum()) for v in (1, 0)}
    # Room for all that will be taught, so that no round copies what is there.
    room = len(train) + rounds * 2 * sum(shared_out(shares, max_taught).values())
    views = [np.empty((room, x.shape[1]), dtype=np.float32) for x in (a, b)]
    views[0][: len(train)], views[1][: len(train)] = a[train], scaled(b[train])
    labels, trust = ([np.empty(room, dtype=np.float32) for _ in views] for _ in range(2))
    used = [len(train)] * 2
    for own, sure_of in zip(labels, trust, strict=True):
        own[: len(train)], sure_of[: len(train)] = y[train], weights[train] / weights[train].mean()
    for turn in range(rounds + 1):
        fits, marks = [], []
        for k, x in enumerate((a, b)):
            own, n = labels[k][: used[k]], used[k]
            good = float((trust[k][:n] * own).sum() / trust[k][:n].sum())
            balance = np.where(own > 0, 0.5 / good, 0.5 / (1 - good)) ** 0.5
            fits.append(logistic(views[k][:n], own, trust[k][:n] * balance))
            marks.append(platt(odds(x[held] if k == 0 else scaled(x[held]), fits[-1]), y[held].astype(float), weights[held]))
        model = Model(fits[0], fits[1], (centre, spread), marks)
        if turn == rounds:
            break
        for k, (new_a, new_b, said) in enumerate(surest(model, shared_out(shares, max_taught), sure)):
            to, n = 1 - k, len(said)
            views[to][used[to] : used[to] + n] = scaled(new_b) if to else new_a
            labels[to][used[to] : used[to] + n], trust[to][used[to] : used[to] + n] = said, 0.5  # a pseudo-label counts half
            used[to] += n
    z = np.clip(np.stack(model.views(a[last], b[last]), axis=1), -10, 10)
    both, _ = calibrate(z, y[last].astype(float), weights[last])
    for k in (0, 1):
        if both[k] < 0:  # a view that only seems to speak against itself is left out
            one, _ = calibrate(z[:, [1 - k]], y[last].astype(float), weights[last])
            both = np.array([0.0, one[0], one[1]]) if k == 0 else np.array([one[0], 0.0, one[1]])
    model.combine = tuple(map(float, both))
    return model


def confidence(z: np.ndarray) -> np.ndarray:
    """The chance of good quality in steps of STEP, as a whole number."""
    return np.round(chance(z) / STEP).astype(np.int64)


def _from_rows(a: np.ndarray, b: np.ndarray, pool: np.ndarray, order: np.ndarray) -> Callable[[Model, dict[int, int], float], list[Taught]]:
    """What views are surest of among rows `pool` of a and b, which are in the order of their ids; it comes in the order of `order` and id."""
    told: list[set[int]] = [set(), set()]

    def surest(model: Model, most: dict[int, int], sure: float) -> list[Taught]:
        out = []
        for k, z in enumerate(model.views(a[pool], b[pool])):
            good, rows = confidence(z), []
            for value, how in ((1, good), (0, round(1 / STEP) - good)):
                chosen = [i for i in np.argsort(-how, kind="stable").tolist() if how[i] >= round(sure / STEP) and i not in told[k]][: most[value]]
                told[k].update(chosen)
                rows += [(order[pool[i]], i, value) for i in chosen]
            own = [i for _, i, _ in sorted(rows)]
            out.append((a[pool[own]], b[pool[own]], np.array([value for *_, value in sorted(rows)], dtype=np.float32)))
        return out

    return surest


def _inputs(docs: DataFrame, text: str, names: tuple[str, ...], number: str | None) -> list[Column]:
    return [docs[text].cast("string"), F.array(*[docs[c].cast("string") for c in names]), (docs[number] if number else F.lit(None)).cast("double")]


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of equal length from a column of their bytes."""
    n = len(column)
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=kind).reshape(n, -1).astype(np.float32) if n else np.zeros((0, 0), dtype=np.float32)


def _features(view: DataFrame, chosen: DataFrame) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """chosen (id and other columns, a bounded table) with the two views of those that view has, in the order of hash and id."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, tags, sizes = [r or b"" for r in raw_texts(batch.column("text"))], batch.column("names").to_pylist(), batch.column("number").to_pylist()
            for lo, hi in spans(map(len, raws), CHUNK_BYTES):
                a, b = text_view(raws[lo:hi]).astype(np.float16), meta_view(tags[lo:hi], sizes[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array([x.tobytes() for x in a]), pa.array([x.tobytes() for x in b])], names=["id", "a", "b"])

    rows = view.join(F.broadcast(chosen.select("id").distinct()), "id").select("id", "text", "names", "number")
    seen = rows.mapInArrow(tidy(look), f"id {view.schema['id'].dataType.simpleString()}, a binary, b binary").groupBy("id").agg(F.min(F.struct("a", "b")).alias("x"))
    found = chosen.join(seen, "id").withColumn("order", F.crc32(F.col("id").cast("string").cast("binary"))).orderBy("order", "id")
    table = found.select(*chosen.columns, "order", "x.a", "x.b").toArrow()
    return table, _matrix(table["a"], np.float16), _matrix(table["b"], np.float32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source"), number: str | None = "n_chars", label_id: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED, max_taught: int = MAX_TAUGHT, rounds: int = ROUNDS, sure: float = SURE) -> Model | None:
    """A model from at most max_labelled labelled rows, and from what the views are surest of among all others."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(labels[label_id].alias("id"), labels[label].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    by_hash = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_labelled // 2)
    kind = docs.schema[doc_id].dataType
    sampled = [(r["id"], r["y"]) for y in (0, 1) for r in by_hash(y).select(F.col("id").cast(kind).alias("id"), "y").collect()]
    view = docs.select(docs[doc_id].alias("id"), *(c.alias(x) for c, x in zip(_inputs(docs, text, names, number), ("text", "names", "number"), strict=True))).where("id IS NOT NULL")
    table, a, b = _features(view, spark.createDataFrame(sampled, f"id {kind.simpleString()}, y int"))
    y = table["y"].to_numpy()
    have = {v: int((y == v).sum()) for v in (0, 1)}
    if not all(have.values()):
        return None
    # Labels of documents that aren't there count in neither share, on the assumption that they are as many in both classes.
    weights = np.where(y == 1, sizes[1] / have[1], sizes[0] / have[0])
    order = table["order"].to_numpy()
    del table
    told: list[list] = [[], []]

    def surest(model: Model, most: dict[int, int], limit: float) -> list[Taught]:
        shared = spark.sparkContext.broadcast(model)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                raws, tags, sizes = [r or b"" for r in raw_texts(batch.column("text"))], batch.column("names").to_pylist(), batch.column("number").to_pylist()
                for lo, hi in spans(map(len, raws), CHUNK_BYTES):
                    own = [pa.array(confidence(z)) for z in m.views(text_view(raws[lo:hi]), meta_view(tags[lo:hi], sizes[lo:hi]))]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *own], names=["id", "p0", "p1"])

        scored, folder = stage_at(view.mapInArrow(tidy(judge), f"id {kind.simpleString()}, p0 long, p1 long").groupBy("id").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1")).join(known.select(F.col("id").cast(kind).alias("id")), "id", "left_anti"))
        one, chosen = round(1 / STEP), []
        for k in (0, 1):
            free = scored.join(F.broadcast(spark.createDataFrame([(i,) for i in told[k]], f"id {kind.simpleString()}")), "id", "left_anti")  # at most rounds * max_taught ids
            for value, how in ((1, F.col(f"p{k}")), (0, F.lit(one) - F.col(f"p{k}"))):
                best = free.select("id", how.alias("how")).where(F.col("how") >= round(limit / STEP)).orderBy(F.desc("how"), "id").limit(most[value])
                chosen.append(best.select("id", F.lit(k).alias("k"), F.lit(value).alias("y")))
        rows = [tuple(r) for r in reduce(DataFrame.unionByName, chosen).collect()]
        table, new_a, new_b = _features(view, spark.createDataFrame(rows, f"id {kind.simpleString()}, k int, y int"))
        by, said = table["k"].to_numpy(), table["y"].to_numpy().astype(np.float32)
        out = [(new_a[by == k], new_b[by == k], said[by == k]) if len(said) else (np.zeros((0, a.shape[1]), np.float32), np.zeros((0, b.shape[1]), np.float32), said) for k in (0, 1)]
        for i, k, _ in rows:
            told[k].append(i)
        shared.destroy()
        discard(spark, folder)
        return out

    made = cotrain(a, b, y, order, rounds, sure, weights, surest, max_taught)
    del a, b
    give_back()
    return made


def scored(docs: DataFrame, model: Model | None, name: str, text: str = "text", names: tuple[str, ...] = ("lang", "source"), number: str | None = "n_chars") -> DataFrame:
    """docs with a struct column `name`: p_text, p_meta and score, the calibrated probabilities of good quality."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = shared.value
        for texts, tags, sizes in columns:
            raws, tags, sizes = [r or b"" for r in raw_texts(texts)], tags.to_pylist(), sizes.to_pylist()
            out = np.ones((3, len(raws)))
            for lo, hi in spans(map(len, raws), CHUNK_BYTES) if m else ():
                out[:, lo:hi] = m.score(text_view(raws[lo:hi]), meta_view(tags[lo:hi], sizes[lo:hi]))
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], names=["p_text", "p_meta", "score"])

    @F.arrow_udf("struct<p_text:double,p_meta:double,score:double>")
    def judge(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from tidy(work)(columns)

    return docs.withColumn(name, judge(*_inputs(docs, text, names, number)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score and accepted of every row of docs(doc_id, text, lang, source, n_chars)."""
    view = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return scored(view, fit(view, labels), "found").select("doc_id", "found.p_text", "found.p_meta", "found.score", (F.col("found.score") >= threshold).alias("accepted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are accepted, with their columns as they were."""
    name = fresh(docs, "found")
    return scored(docs, fit(docs, labels), name).where(F.col(f"{name}.score") >= threshold).select(*docs.columns)
