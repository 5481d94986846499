"""Quality rules: base counts of a text, and tokeniser fertility with rejection bands per language or script.

A text has words ``[^\\x20\\x09-\\x0D]+``. Public vocabularies measure it: characters per token, the share of byte-fallback
tokens and the entropy of the tokens. A text outside the band of its language and length is rejected. Bands are learnt: all texts
that pass the base rules are grouped by language, and by script, and by the power of two of their number of tokens; a band reaches SPREAD
times the distance of the quartiles beyond them, so short texts, whose ratios vary more, have wider bands. A text is judged by its
language's band or, where fewer than MIN_GROUP texts made that, by its script's, and where those are too few as well by BANDS.

Texts are measured once, in one pass; the quartiles come from counts of rounded values, which tasks merge, so they are exact and don't
depend on partitioning.

Defined results: a null text counts as empty, has no words and fails; repeated rows each get a row; a null id stays null; ties of scripts go to the
first in SCRIPTS; a long text is measured whole; an empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import Memo, by_chunk, fresh, mix, per_row, raw_texts, small_batches, spans, stage, tidy

#: Bands where too few texts are there to learn from, by language or script: least and most characters per token in either vocabulary, most byte-fallback share, and least
#: entropy as a share of the greatest that so many tokens can have (see `verdict`).
BANDS = {
    "latin": (1.3, 9.0, 0.25, 0.30),
    "cyrillic": (0.8, 7.0, 0.40, 0.30),
    "greek": (0.5, 6.0, 0.60, 0.30),
    "cjk": (0.3, 4.0, 0.90, 0.30),
    "other": (0.2, 9.0, 0.95, 0.25),
    "none": (0.7, 9.0, 0.50, 0.30),
}
#: Words that a text needs, and the share of them in repeated five-word windows that it may have, in percent.
MIN_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: Texts that a learnt band needs; how many quartile distances it reaches beyond the quartiles, and the least such distance; powers of two of tokens.
MIN_GROUP, SPREAD, LEAST_WIDTH, LENGTHS = 50, 5.0, 0.02, (5, 12)

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, chars_per_token_bytes double, byte_share double, entropy double, script string"
_SYMBOLS = b"#*$%&|<>"


def script_of(word: str) -> int:
    """Index into SCRIPTS by the first letter."""
    for c in word:
        if c.isalpha():
            o = ord(c)
            return 0 if o < 0x370 or 0x1E00 <= o < 0x1F00 else 2 if o < 0x400 or 0x1F00 <= o < 0x2000 else 1 if o < 0x530 else 3 if 0x2E80 <= o < 0xD7B0 or 0xF900 <= o < 0xFB00 or o >= 0x20000 else 4
    return 5


SCRIPTS = ("latin", "cyrillic", "greek", "cjk", "other", "none")


class Vocabularies:
    """What the vocabularies make of each word. Words stand alone, so a word's tokens don't depend on its neighbours."""

    def __init__(self, piece_path: str, bytes_path: str):
        import base64

        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(bytes_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.by_bytes = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())])
        self.memo = Memo(self._learn, self._reset)
        self._reset()

    def _reset(self) -> None:
        self.tokens: list[bytes] = []
        self.chars, self.symbols, self.byte_tokens, self.scripts = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in new]
        self.tokens += [np.asarray(ids, dtype="<u2").tobytes() for ids in self.piece.encode(texts, num_threads=1)]
        grow = lambda a, values: np.concatenate([a, np.fromiter(values, dtype=np.int64, count=len(new))])
        self.chars = grow(self.chars, map(len, texts))
        self.symbols = grow(self.symbols, (len(w) - len(w.translate(None, _SYMBOLS)) for w in new))
        self.byte_tokens = grow(self.byte_tokens, (len(self.by_bytes.encode_ordinary(" " + t)) for t in texts))
        self.scripts = grow(self.scripts, map(script_of, texts))


def repeated_words(ids: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, how many of its words stand in windows found twice or more in that text."""
    n, rows = len(ids), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    m = n - window + 1
    if m <= 0:
        return np.zeros(len(starts) - 1, dtype=np.int64)
    at = np.flatnonzero(rows[:m] == rows[window - 1 :])
    h = mix(rows[at].astype(np.uint64) + np.uint64(1))
    for i in range(window):
        h = (h ^ mix(ids[at + i].astype(np.uint64))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    order = np.sort(h)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(n + 1, dtype=np.int64)
    if len(twice):
        hit = at[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
    return per_row((np.cumsum(covered)[:n] > 0).astype(np.int64), starts)


def dup_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def verdict(band: tuple, cpt: float, cpt_bytes: float, share: float, entropy: float, n_tokens: int) -> bool:
    """Whether a text lies in the band."""
    least, most, most_bytes, flat = band
    return least <= cpt <= most and least <= cpt_bytes <= most and share <= most_bytes and entropy >= flat * min(np.log2(max(1, n_tokens)), 10.0)


#: What bands bound: from below, from above, and as a column (entropy as a share of the greatest that so many tokens can have).
_BOUNDED = {
    "chars_per_token": (True, True, F.col),
    "chars_per_token_bytes": (True, True, F.col),
    "byte_share": (False, True, F.col),
    "entropy": (True, False, lambda c: F.col(c) / F.least(F.log2(F.greatest(F.col("n_tokens"), F.lit(2))), F.lit(10.0))),
}


def judged(measured: DataFrame) -> DataFrame:
    """measured (COLUMNS, n_tokens and lang) with `kept` by learnt bands where there are enough texts."""
    length = F.least(F.greatest(F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))), F.lit(LENGTHS[0])), F.lit(LENGTHS[1]))
    values = {c: as_column(c) for c, (_, _, as_column) in _BOUNDED.items()}
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("by_lang"), F.col("lang").alias("kind")), F.struct(F.lit(False).alias("by_lang"), F.col("script").alias("kind"))))
    fine = measured.where("NOT base_failed").select(kinds.alias("of"), length.alias("length"), *(F.round(v, 3).alias(c) for c, v in values.items())).where("of.kind IS NOT NULL")
    quartiles = fine.groupBy("of.by_lang", "of.kind", "length").agg(F.count(F.lit(1)).alias("n"), *(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in values)).where(F.col("n") >= MIN_GROUP)
    bands = []
    for r in quartiles.collect():
        row = [r["by_lang"], r["kind"], r["length"]]
        for c, (below, above, _) in _BOUNDED.items():
            reach = SPREAD * max(r[c][1] - r[c][0], LEAST_WIDTH)
            row += [r[c][0] - reach if below else None, r[c][1] + reach if above else None]
        bands.append(row)
    edges = [f"{c}_{side}" for c in values for side in ("least", "most")]
    learnt = measured.sparkSession.createDataFrame(bands, ", ".join(["by_lang boolean, kind string, length long", *(f"{e} double" for e in edges)]))
    out = measured.withColumn("length", length)
    for prefix, column, by_lang in (("lang", "lang", True), ("script", "script", False)):
        own = learnt.where(F.col("by_lang") == by_lang).select(F.col("kind").alias(f"{prefix}_kind"), F.col("length").alias(f"{prefix}_length"), F.struct(*edges).alias(f"{prefix}_band"))
        out = out.join(F.broadcast(own), (F.col(column) == F.col(f"{prefix}_kind")) & (F.col("length") == F.col(f"{prefix}_length")), "left")  # a few rows for each language
    band = F.coalesce("lang_band", "script_band")
    inside = F.lit(True)
    for c, v in values.items():
        inside = inside & F.coalesce(v >= band[f"{c}_least"], F.lit(True)) & F.coalesce(v <= band[f"{c}_most"], F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & F.when(band.isNull(), F.col("kept")).otherwise(inside)).select(*measured.columns)


class Measurer:
    """Measures the texts of a chunk; one lives as long as a task."""

    def __init__(self, piece_path: str, bytes_path: str, bands: dict):
        self.vocabularies, self.bands = Vocabularies(piece_path, bytes_path), bands

    def rows(self, raws: list[bytes | None], langs: list[str | None]) -> list[tuple]:
        """A tuple in the order of COLUMNS, and the number of tokens, for each text; kept is by the fixed bands."""
        words: list[bytes] = []
        starts = [0]
        for raw in raws:
            words += (raw or b"").split()
            starts.append(len(words))
        v, at = self.vocabularies, np.array(starts)
        ids = v.memo.ids(words)
        n_words, chars, symbols, n_bytes = np.diff(at), *(per_row(a[ids], at) for a in (v.chars, v.symbols, v.byte_tokens))
        repeats, scripts, numbers, out = repeated_words(ids, at), v.scripts[ids], ids.tolist(), []
        for i, raw in enumerate(raws):
            own = np.frombuffer(b"".join(map(v.tokens.__getitem__, numbers[starts[i] : starts[i + 1]])), dtype="<u2")
            counts = np.bincount(own, minlength=len(v.is_byte))
            share = float(counts[v.is_byte].sum() / max(1, len(own)))
            p = counts[counts > 0] / max(1, len(own))
            entropy = float(-(p * np.log2(p)).sum()) + 0.0
            most = np.bincount(scripts[starts[i] : starts[i + 1]], minlength=6)
            script = SCRIPTS[int(most[:5].argmax())] if most[:5].any() else "none"
            cpt, cpt_bytes = float(chars[i] / max(1, len(own))), float(chars[i] / max(1, n_bytes[i]))
            failed = bool(n_words[i] < MIN_WORDS or 100 * repeats[i] > MOST_REPEATED * n_words[i])
            kept = not failed and bool(verdict(self.bands.get(langs[i]) or self.bands[script], cpt, cpt_bytes, share, entropy, len(own)))
            out.append((int(n_words[i]), int(chars[i]), int(symbols[i]), dup_lines(raw or b""), int(repeats[i]), failed, kept, cpt, cpt_bytes, share, entropy, script, len(own)))
        return out


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", bands: dict | None = None, piece_path: str | None = None, bytes_path: str | None = None) -> DataFrame:
    """doc_id, the base counts, the verdict and the measurements of every row, whatever other columns docs has.

    bands: by language or script, instead of what is learnt; every script needs one. A row without a language is judged by its script.
    """
    small_batches(docs.sparkSession)
    paths, use, kind, names = _paths(piece_path, bytes_path), bands or BANDS, docs.schema[doc_id].dataType.simpleString(), [c.split()[0] for c in COLUMNS.split(", ")]
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), (docs[lang] if lang else F.lit(None)).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer(*paths, use)
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4 + [pa.string(), pa.int64()]

        def work(batch: pa.RecordBatch, raws: list[bytes | None]) -> pa.RecordBatch:
            made = zip(*measurer.rows(raws, batch.column("lang").to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)), batch.column("lang")], names=["doc_id", *names, "n_tokens", "lang"])

        return by_chunk(batches, "text", work)

    measured = rows.mapInArrow(tidy(run), f"doc_id {kind}, {COLUMNS}, n_tokens long, lang string")
    return (measured if bands else judged(stage(measured))).select("doc_id", *names)


def keep_good(docs: DataFrame, text: str = "text", lang: str | None = "lang", bands: dict | None = None) -> DataFrame:
    """The rows of docs that pass, with their columns as they were."""
    small_batches(docs.sparkSession)
    paths, use, name = _paths(None, None), bands or BANDS, fresh(docs, "found")
    fields = ["base_failed boolean", "kept boolean", "chars_per_token double", "chars_per_token_bytes double", "byte_share double", "entropy double", "script string", "n_tokens long"]
    kinds = [pa.bool_()] * 2 + [pa.float64()] * 4 + [pa.string(), pa.int64()]

    def work(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        measurer = Measurer(*paths, use)
        for texts, langs in columns:
            raws, names, made = raw_texts(texts), langs.to_pylist(), []
            for lo, hi in spans(len(r or b"") for r in raws):
                made += [x[5:] for x in measurer.rows(raws[lo:hi], names[lo:hi])]
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in made], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in fields])

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ':') for f in fields)}>")
    def found(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from tidy(work)(columns)

    language = (docs[lang] if lang else F.lit(None)).cast("string")
    measured = docs.withColumn(name, found(docs[text].cast("string"), language))
    if bands:
        return measured.where(F.col(f"{name}.kept")).select(*docs.columns)
    measured = stage(measured)
    language = (F.col(lang) if lang else F.lit(None)).cast("string")
    table = measured.select(F.struct(*docs.columns).alias("row"), language.alias("lang"), *(F.col(f"{name}.{f.split()[0]}") for f in fields))
    return judged(table).where("kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _paths(piece: str | None, by_bytes: str | None) -> tuple[str, str]:
    return piece or public_tokenizers.path("piece_bpe_32k.model"), by_bytes or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
