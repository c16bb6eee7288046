"""Normalisation and similarity of names, phones, villages and ages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of address that aren't part of a name.
HONORIFICS = ("mr", "mrs", "ms", "dr", "smt", "shri")


def tokens(name: Column) -> Column:
    """Words of a name in lower case, letters only, without forms of address; none for a null name."""
    letters = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z\s]", " ")
    return F.filter(F.split(letters, r"\s+"), lambda t: (t != "") & ~t.isin(*HONORIFICS))


def normal_name(name: Column) -> Column:
    return F.array_join(tokens(name), " ")


def normal_phone(phone: Column) -> Column:
    """Digits; the last ten where there are ten or more."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits)


def last4(phone: Column) -> Column:
    p = normal_phone(phone)
    return F.when(F.length(p) >= 4, F.right(p, F.lit(4))).otherwise(F.lit(""))


def normal_village(village: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(village, F.lit(""))), r"\.", " "), r"\s+", " "))


def name_similarity(source: Column, reference: Column, near: Column, shortest: Column) -> Column:
    """Share of the longer token set that the source's tokens match: 1 exact, 0.75 within one edit.

    source, reference: distinct tokens or their hashes. near: of source tokens with three letters or more, ``token`` and
    the reference tokens one edit ``away``. A near match also needs three letters in the reference's shortest token."""
    exact = F.size(F.array_intersect(source, reference))
    close = F.when((F.size(near) > 0) & (shortest >= 3), F.size(F.filter(near, lambda x: ~F.array_contains(reference, x["token"]) & F.arrays_overlap(x["away"], reference)))).otherwise(0)
    return F.when((F.size(source) == 0) | (F.size(reference) == 0), 0.0).otherwise(F.least(F.lit(1.0), (exact + 0.75 * close) / F.greatest(F.size(source), F.size(reference))))


def variants(token: Column) -> Column:
    """A token and what is left of it without one letter: tokens one edit apart have one of these in common."""
    return F.array_distinct(F.concat(F.array(token), F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))))


def village_similarity(a: Column, b: Column) -> Column:
    close = (F.abs(F.length(a) - F.length(b)) <= 1) & (F.least(F.length(a), F.length(b)) >= 5)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(close & (F.levenshtein(a, b, 1) >= 0), 0.9).otherwise(0.0)


def age_similarity(a: Column, b: Column) -> Column:
    gap = F.abs(a.cast("double") - b.cast("double"))
    return F.when(gap.isNull(), 0.0).when(gap == 0, 1.0).when(gap <= 2, 0.5).when(gap <= 5, 0.25).otherwise(0.0)


def same(a: Column, b: Column) -> Column:
    return F.coalesce(((a == b) & (a != "")).cast("double"), F.lit(0.0))
