"""Expressions on DNA strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(sequence: Column) -> Column:
    """Complement of A, C, G, T, N in either case, reversed; other letters stay."""
    return F.reverse(F.translate(sequence, "ACGTNacgtn", "TGCANtgcan"))


def dna_letters(text: Column) -> Column:
    """The letters A, C, G, T of a text, in upper case."""
    return F.regexp_replace(F.upper(text), "[^ACGT]", "")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def kmers(sequence: Column, k: int = 4) -> Column:
    """All windows of k letters, in order; none if the sequence is shorter."""
    return F.when(F.length(sequence) >= k, F.transform(F.sequence(F.lit(1), F.length(sequence) - (k - 1)), lambda i: F.substr(sequence, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical_kmers(k: int = 4) -> list[str]:
    """All canonical k-mers, sorted."""
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
    words = [""]
    for _ in range(k):
        words = [w + c for w in words for c in "ACGT"]
    return sorted({min(w, "".join(pair[c] for c in reversed(w))) for w in words})


def gc_percent(sequence: Column) -> Column:
    """100 * (G + C) / (A + C + G + T); 0 without any of them."""
    gc = F.length(F.regexp_replace(sequence, "[^GC]", ""))
    acgt = F.length(F.regexp_replace(sequence, "[^ACGT]", ""))
    return F.when(acgt > 0, 100.0 * gc / acgt).otherwise(F.lit(0.0))


def direct_repeat(sequence: Column, seed: int) -> Column:
    """Length of the suffix that starts where the first ``seed`` letters last occur, if the sequence starts with it; else 0."""
    n = F.length(sequence)
    behind = F.instr(F.reverse(sequence), F.reverse(F.left(sequence, F.lit(seed))))  # letters behind the last occurrence, and 1
    span = seed + behind - 1
    hit = (n >= 4 * seed) & (n > span) & (span <= F.floor(n / 2)) & (F.right(sequence, span) == F.left(sequence, span))
    return F.when(hit, span).otherwise(F.lit(0)).cast("long")


def inverted_repeat(sequence: Column, seed: int) -> Column:
    """Length, at most half, of what the sequence and its reverse complement have in common at the start; 0 below ``seed``."""
    n = F.length(sequence)
    half = F.floor(n / 2).cast("int")

    def common(other: Column) -> Column:
        differ = F.filter(F.sequence(F.lit(seed + 1), half), lambda j: F.substr(sequence, j, F.lit(1)) != F.substr(other, j, F.lit(1)))
        hit = (n >= 4 * seed) & (F.left(sequence, F.lit(seed)) == F.left(other, F.lit(seed)))
        return F.when(hit, F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, half)).otherwise(F.lit(0)).cast("long")

    # as an array of one, the reverse complement is made once a row and not once a letter
    return F.get(F.transform(F.array(reverse_complement(sequence)), common), 0)


def wrapped(sequence: Column, width: int = 80) -> Column:
    """Lines of ``width`` letters."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
