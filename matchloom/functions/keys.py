"""Blocking keys as array columns. A key is its tag and parts, joined by a character that normalised text can't have.

Reference records get few keys, of their rarest words; target records get all combinations, so the two meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import has_digit, is_number, tokens

SEP = "\u0001"
#: Legal forms, left out of exact keys only.
LEGAL_FORMS = ("limited", "private", "pvt", "ltd", "llc", "inc", "incorporated", "corp", "corporation", "llp", "co", "company")


def key(tag: str, *parts: Column) -> Column:
    return F.concat_ws(SEP, F.lit(tag), *parts)


def all_pairs(words: Column, tag: str) -> Column:
    """A key for every pair of a sorted array."""
    return F.flatten(F.transform(words, lambda x, i: F.transform(F.slice(words, i + 2, F.greatest(F.size(words), F.lit(1))), lambda y: key(tag, x, y))))


def product(a: Column, b: Column, tag: str) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: key(tag, x, y))))


def name_words(name: Column) -> Column:
    return F.array_sort(F.filter(tokens(name), lambda t: F.length(t) > 2))


def address_words(address: Column) -> Column:
    return F.array_sort(F.filter(tokens(address), lambda t: (F.length(t) >= 3) & ~is_number(t)))


def numbers(address: Column) -> Column:
    return F.array_sort(F.filter(tokens(address), is_number))


def long_words(address: Column) -> Column:
    return F.filter(tokens(address), lambda t: (F.length(t) >= 5) & ~has_digit(t))


def first(words: Column, n: int, order: Callable[[Column], Column]) -> Column:
    """The first n words by order, then by the word."""
    ranked = F.array_sort(F.transform(words, lambda t: F.struct(order(t).alias("o"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, n), lambda x: x["t"])


def rarest(records: DataFrame, words: Column, frequency: DataFrame, name: str, n: int = 2, by: str = "entity_id") -> DataFrame:
    """records with an array column `name`: each one's n rarest words; words without a frequency are rarest.

    frequency(token, df) is joined to the exploded words and only words of one record are gathered, so it may be of any size.
    """
    each = records.select(F.col(by).alias("__by"), F.explode(words).alias("token")).join(frequency, "token", "left")
    best = each.groupBy("__by").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))), 1, n).alias("__best"))
    return records.join(best, records[by] == best["__by"], "left").withColumn(name, F.coalesce(F.transform("__best", lambda x: x["token"]), F.array().cast("array<string>"))).drop("__by", "__best")


def query_keys(name: Column, address: Column, rare: Column) -> Column:
    """Name; the pair of the two rarest words; the rarest with the three smallest numbers and two longest words of the address."""
    spots = F.concat(F.slice(numbers(address), 1, 3), first(long_words(address), 2, lambda t: -F.length(t)))
    pair = F.when(F.size(rare) == 2, F.array(key("p", F.array_min(rare), F.array_max(rare)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(key("n", name)), pair, product(F.slice(rare, 1, 1), spots, "a"))


def target_keys(name: Column, address: Column) -> Column:
    """Name; every pair of words; every word with every number and long word of the address."""
    words = name_words(name)
    return F.concat(F.array(key("n", name)), all_pairs(words, "p"), product(words, F.concat(numbers(address), long_words(address)), "a"))


def address_query_keys(address: Column, rare: Column) -> Column:
    """Address, if any; the pair of its two rarest words; the rarest with the three smallest numbers."""
    none = F.array().cast("array<string>")
    whole = F.when(address != "", F.array(key("z", address))).otherwise(none)
    pair = F.when(F.size(rare) == 2, F.array(key("w", F.array_min(rare), F.array_max(rare)))).otherwise(none)
    return F.concat(whole, pair, product(F.slice(rare, 1, 1), F.slice(numbers(address), 1, 3), "d"))


def address_target_keys(address: Column) -> Column:
    """Address, if any; every pair of words; every word with every number."""
    whole = F.when(address != "", F.array(key("z", address))).otherwise(F.array().cast("array<string>"))
    words = address_words(address)
    return F.concat(whole, all_pairs(words, "w"), product(words, numbers(address), "d"))


def exact_keys(name: Column, address: Column) -> Column:
    """The name's words without legal forms (or the name, if it has no others), and the address's words."""
    core = F.array_sort(F.array_except(tokens(name), F.array(*map(F.lit, LEGAL_FORMS))))
    by_name = F.when(F.size(core) > 0, key("e", F.concat_ws(SEP, core))).otherwise(key("n", name))
    by_address = F.when(address != "", F.array(key("x", F.concat_ws(SEP, F.array_sort(tokens(address)))))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(by_name), by_address)
