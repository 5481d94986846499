"""Text normalisation and token sets, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whether fold_diacritics may be used: for experiments only.
DIACRITIC_FOLDING_ENABLED = False


def _each(function) -> Column:  # noqa: ANN001
    @F.arrow_udf("string")
    def apply(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([None if x is None else function(x) for x in column.to_pylist()], pa.string())

    return apply


def nfkc(text: Column) -> Column:
    """Compatibility composition. Spark has none, so text outside ASCII goes through Python in Arrow batches; ASCII stays in the JVM."""
    outside = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_each(lambda x: unicodedata.normalize("NFKC", x))(outside), text)


def normalize(text: Column, compose: bool = True) -> Column:
    """Compose, lower-case, let letters and digits stand and turn everything else into single spaces; null becomes empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(F.lower(nfkc(text) if compose else text), r"[^\p{L}\p{N}]+", " "))


def fold_diacritics(text: Column) -> Column:
    """Drop combining marks after decomposition. Refused unless the experiment is switched on."""
    if not DIACRITIC_FOLDING_ENABLED:
        raise RuntimeError("diacritic folding is for experiments only; DIACRITIC_FOLDING_ENABLED is off")
    return _each(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))(text)


def tokens(text: Column) -> Column:
    """Distinct words of normalised text; none for empty text."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def is_number(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def has_digit(token: Column) -> Column:
    return token.rlike(r"\p{Nd}")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of token sets; 0 for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a), F.length(b))


def prepare(records: DataFrame, compose: bool = True) -> DataFrame:
    """Add the seven derived columns to records; the given ones stay as they are."""
    out = records.withColumns({"raw_name": F.col("business_name"), "raw_address": F.col("business_address")})
    out = out.withColumns({"normalized_name": normalize(F.col("business_name"), compose), "normalized_address": normalize(F.col("business_address"), compose), "normalized_country": normalize(F.col("country"), compose)})
    tagged = F.concat(F.lit("[NAME] "), "normalized_name", F.lit(" [ADDRESS] "), "normalized_address", F.lit(" [COUNTRY] "), "normalized_country")
    return out.withColumns({"retrieval_text": F.concat("normalized_name", F.lit(" "), "normalized_address"), "combined_text": tagged})


def source_of(entity_id: Column) -> Column:
    """S1, S2 or S3 by the prefix; null for any other id."""
    return F.when(entity_id.rlike("^S[123]-"), F.substring(entity_id, 1, 2))
