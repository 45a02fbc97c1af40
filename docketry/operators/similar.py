"""Pairs of similar texts without comparing all with all.

Two texts within d edits share, at a shift of d letters at most, one of any d + 1 parts that one of them is cut into. So
the right side is indexed by its parts, the left side looks up its substrings at those lengths and shifts, and only texts
that meet are compared. No pair that is similar enough is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edits(longest: Column, share: float) -> Column:
    """Edits that two texts may differ by, the longer of which has so many letters."""
    return F.floor(longest * (1 - share) + 1e-9).cast("int")


def _part(i: Column, length: Column, d: Column) -> tuple[Column, Column]:
    """Start and length of part i of d + 1 parts of a text, the longer parts last."""
    base, longer = F.floor(length / (d + 1)).cast("int"), length % (d + 1)
    extra = F.greatest(F.lit(0), i - (d + 1 - longer))
    return i * base + extra, base + F.when(i >= d + 1 - longer, 1).otherwise(0)


def _key(length: Column, d: Column, i: Column, piece: Column) -> Column:
    return F.concat_ws(" ", length.cast("string"), d.cast("string"), i.cast("string"), piece)


def _indexed(text: Column, share: float) -> Column:
    """The parts under which a text of the right side is found, for every number of edits that a partner may allow."""
    n = F.length(text)
    allowed = F.array_distinct(F.transform(F.sequence(n, F.floor(n / share).cast("int")), lambda m: _edits(m, share)))

    def parts(d: Column) -> Column:
        def one(i: Column) -> Column:
            start, size = _part(i, n, d)
            return _key(n, d, i, F.substring(text, start + 1, size))

        return F.transform(F.sequence(F.lit(0), d), one)

    return F.flatten(F.transform(allowed, parts))


def _looked_up(text: Column, share: float) -> Column:
    """The keys under which the partners of a text of the left side are indexed."""
    n = F.length(text)

    def of_length(length: Column) -> Column:
        d = _edits(F.greatest(n, length), share)

        def at(i: Column) -> Column:
            start, size = _part(i, length, d)
            shifts = F.filter(F.sequence(-d, d), lambda k: (start + k >= 0) & (start + k + size <= n))
            return F.transform(shifts, lambda k: _key(length, d, i, F.substring(text, start + k + 1, size)))

        return F.flatten(F.transform(F.sequence(F.lit(0), d), at))

    lengths = F.sequence(F.ceil(n * share - 1e-9).cast("int"), F.floor(n / share).cast("int"))
    return F.flatten(F.transform(lengths, of_length))


def similar_pairs(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """(scope, a, b, similarity) of distinct texts a of left and b of right, both (scope, text), whose similarity, 1 less
    the edit distance over the longer length, is share or more. share is over one half. Null and empty texts and null
    scopes have no pair. Texts that many rows have should be made distinct by the caller's columns; here they are."""
    if not 0.5 < share <= 1:
        raise ValueError("share must be over 0.5 and at most 1")
    fit = F.col("scope").isNotNull() & (F.length("text") > 0)
    a = left.select("scope", "text").filter(fit).distinct().select("scope", F.col("text").alias("a"), F.explode(_looked_up(F.col("text"), share)).alias("key"))
    b = right.select("scope", "text").filter(fit).distinct().select("scope", F.col("text").alias("b"), F.explode(_indexed(F.col("text"), share)).alias("key"))
    met = a.join(b, ["scope", "key"]).select("scope", "a", "b").distinct()
    similarity = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    return met.withColumn("similarity", similarity).filter(F.col("similarity") >= share - 1e-12)
