"""Features of candidate pairs: token features and scores as column expressions, edit features partly in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from matchloom.functions.text import has_digit, jaccard, length_ratio, tokens

TOKEN_FEATURES = ("name_jaccard", "address_jaccard", "name_exact", "address_exact", "numeric_jaccard", "numeric_conflict", "country_match", "name_length_ratio", "address_length_ratio", "address_missing")
EDIT_FEATURES = ("name_levenshtein", "address_levenshtein", "name_token_sort", "address_token_sort", "name_weighted_ratio", "address_weighted_ratio")
COSINES = ("combined_cosine", "name_cosine", "address_cosine")
#: All of the larger linear model, in its order.
COSINE_FEATURES = (*COSINES, *TOKEN_FEATURES, "name_address_product")
#: Those that say nothing when an address is missing.
NEUTRAL = frozenset(("address_jaccard", "address_exact", "numeric_jaccard", "numeric_conflict", "address_length_ratio"))


def block_score(name: Column, address: Column, target_name: Column, target_address: Column, by_address: bool = True) -> Column:
    """What ranks candidates: mostly the names' similarity, or, if by_address, the addresses' where that is more."""
    of_names, of_addresses = jaccard(tokens(name), tokens(target_name)), jaccard(tokens(address), tokens(target_address))
    score = F.lit(0.65) * of_names + F.lit(0.30) * of_addresses + F.lit(0.05) * (name == target_name).cast("double")
    return F.greatest(score, F.lit(0.85) * of_addresses + F.lit(0.15) * of_names) if by_address else score


def token_features(name: Column, address: Column, country: Column, target_name: Column, target_address: Column, target_country: Column, neutral_missing: bool = False) -> dict[str, Column]:
    """The ten token features by name; with neutral_missing those of NEUTRAL are null when an address is missing."""
    a, b = tokens(address), tokens(target_address)
    digits, others = F.filter(a, has_digit), F.filter(b, has_digit)
    missing = (address == "") | (target_address == "")
    found = {
        "name_jaccard": jaccard(tokens(name), tokens(target_name)),
        "address_jaccard": jaccard(a, b),
        "name_exact": (name == target_name).cast("double"),
        "address_exact": ((address != "") & (address == target_address)).cast("double"),
        "numeric_jaccard": jaccard(digits, others),
        "numeric_conflict": ((F.size(digits) > 0) & (F.size(others) > 0) & ~F.arrays_overlap(digits, others)).cast("double"),
        "country_match": (country == target_country).cast("double"),
        "name_length_ratio": length_ratio(name, target_name),
        "address_length_ratio": length_ratio(address, target_address),
        "address_missing": missing.cast("double"),
    }
    return {k: F.when(~missing, c) if neutral_missing and k in NEUTRAL else c for k, c in found.items()}


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; 1 for two empty texts."""
    return F.when((a == "") & (b == ""), 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & places.get(c, 0)
        rows = (rows + hit | rows - hit) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised insert-delete similarity, 0 to 100."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : min(len(b), i + n)]) for i in range(1 - n, len(b)))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one, two = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    return max([ratio(one, two), *([ratio(both, one), ratio(both, two)] if both else [])])


def weighted_ratio(a: str, b: str) -> float:
    """The best of the ratios above, those of parts and sets weighed down; an approximation from public descriptions."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    parts = partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    if set(a.split()) & set(b.split()):
        parts = 100.0
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * parts)


def _compared(function) -> Column:  # noqa: ANN001
    @F.arrow_udf("double")
    def apply(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in columns:
            yield pa.array([None if a is None or b is None else function(a, b) / 100 for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.float64())

    return apply


def edit_features(name: Column, address: Column, target_name: Column, target_address: Column, neutral_missing: bool = False) -> dict[str, Column]:
    """The six edit features by name; with a missing address those of addresses are 0, or null with neutral_missing."""
    missing = (address == "") | (target_address == "")
    absent = F.lit(None).cast("double") if neutral_missing else F.lit(0.0)
    known = lambda c: F.when(~missing, c)  # noqa: E731  null isn't compared
    out = {"name_levenshtein": levenshtein_similarity(name, target_name), "address_levenshtein": levenshtein_similarity(address, target_address)}
    for kind, function in (("token_sort", token_sort_ratio), ("weighted_ratio", weighted_ratio)):
        compared = _compared(function)
        out |= {f"name_{kind}": compared(name, target_name), f"address_{kind}": compared(known(address), known(target_address))}
    return {k: F.when(missing, absent).otherwise(out[k]) if k.startswith("address") else out[k] for k in EDIT_FEATURES}


def linear_weights(coefficients: Sequence[float], intercept: float, means: Sequence[float], scales: Sequence[float]) -> tuple[list[float], float]:
    """Weights and constant of a logistic model with its scaler folded in."""
    weights = [c / s for c, s in zip(coefficients, scales, strict=True)]
    return weights, intercept - sum(w * m for w, m in zip(weights, means, strict=True))


def logistic_score(columns: Sequence[str], weights: Sequence[float], intercept: float) -> Column:
    z = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)), F.lit(float(intercept)))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))


def with_features(pairs: DataFrame, neutral_missing: bool = False, edit: bool = True) -> DataFrame:
    """pairs with name, address, country and the target's, and the features appended."""
    c = [F.col(x) for x in ("name", "address", "country", "target_name", "target_address", "target_country")]
    found = token_features(*c, neutral_missing=neutral_missing)
    return pairs.withColumns(found | (edit_features(c[0], c[1], c[3], c[4], neutral_missing) if edit else {}))


def pair_text(name: str, address: str, country: str, label: str) -> Column:
    """A record as a pair scorer reads it."""
    return F.concat(F.lit(f"RECORD {label}\n[NAME] "), F.col(name), F.lit("\n[ADDRESS] "), F.col(address), F.lit("\n[COUNTRY] "), F.col(country))


def finite(value: Column, kind: DataType | None = None) -> Column:
    """value without what JSON can't say: null for a number that isn't finite, also inside arrays, structs and maps of the type `kind`."""
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: finite(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[finite(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: finite(x, kind.valueType))
    if kind is None or isinstance(kind, DoubleType | FloatType):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return value


def finite_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*[finite(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])
