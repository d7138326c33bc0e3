"""Entropy and lexical measures of strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_entropy(items: Column) -> Column:
    """Shannon entropy in bits of an array's values; 0 for an empty one."""
    total = F.size(items)
    share = lambda x: F.size(F.filter(items, lambda y: y == x)) / total
    bits = F.aggregate(F.array_distinct(items), F.lit(0.0), lambda acc, x: acc - share(x) * F.log2(share(x)))
    return F.when(total > 0, bits).otherwise(0.0)


def characters(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def char_entropy(s: Column) -> Column:
    return _fold_entropy(characters(s))


def ngram_entropy(s: Column, n: int = 2) -> Column:
    starts = F.sequence(F.lit(1), F.length(s) - n + 1)
    grams = F.when(F.length(s) >= n, F.transform(starts, lambda i: F.substr(s, i, F.lit(n))))
    return F.coalesce(_fold_entropy(grams), F.lit(0.0))


def _share(s: Column, other: str) -> Column:
    return F.when(F.length(s) > 0, F.length(F.regexp_replace(s, other, "")) / F.length(s)).otherwise(0.0)


def digit_ratio(s: Column) -> Column:
    """ASCII digits; other scripts' digits do not count."""
    return _share(s, "[^0-9]")


def vowel_ratio(s: Column) -> Column:
    return _share(F.lower(s), "[^aeiou]")


def domain_label(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def entropy_of_counts(counts: Column) -> Column:
    """For an array of counts: entropy in bits; zero counts are skipped and no counts give 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n)
    return F.aggregate(F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda a, n: a - n / total * F.log2(n / total))
