"""Scalar functions on sequences, scores and flags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY = 1, 2, 4, 8, 16, 32, 64, 128, 256


def complement(seq: Column) -> Column:
    """Upper-case complement of A, C, G, T; everything else stays."""
    return F.translate(seq, "ACGT", "TGCA")


def revcomp(seq: Column) -> Column:
    """Reverse complement; lower-case letters become upper-case complements, other characters stay."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCATGCA"))


def revcomp_read(seq: Column, qual: Column) -> Column:
    """(seq, qual) of the read on the other strand: its qualities are reversed."""
    return F.struct(revcomp(seq).alias("seq"), F.reverse(qual).alias("qual"))


def partial_read(seq: Column, qual: Column, start: Column, length: Column) -> Column:
    """(seq, qual) of `length` letters from the 0-based start on."""
    return F.struct(F.substr(seq, start + 1, length).alias("seq"), F.substr(qual, start + 1, length).alias("qual"))


def sound_mapq(mapq: Column) -> Column:
    """mapq, or an error if it does not fit a byte."""
    return F.when(mapq.between(0, 255) | mapq.isNull(), mapq).otherwise(F.raise_error(F.concat(F.lit("mapping quality out of range: "), mapq.cast("string"))).cast("int"))


def nt4(seq: Column) -> Column:
    """A, C, G, T in either case as 0 to 3, anything else as 4."""
    return F.translate(F.regexp_replace(seq, "(?s)[^ACGTacgt]", "4"), "ACGTacgt", "01230123")


def acgt_only(seq: Column, letter: str = "A") -> Column:
    """Characters other than A, C, G, T are replaced by `letter` (a choice of ours)."""
    return F.regexp_replace(seq, "(?s)[^ACGT]", letter)


def dna_view(text: Column) -> Column:
    """A DNA-like view of any text: letters are dealt over A, C, G, T in alphabetical order, the rest becomes N."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return F.regexp_replace(F.translate(text, letters, ("ACGT" * 13)), "(?s)[^ACGT]", "N")


def ilog2(x: Column) -> Column:
    return F.floor(F.log2(x)).cast("int")


def mate_name(name: Column) -> Column:
    """Read name without /1 or /2."""
    return F.regexp_replace(name, "/[12]$", "")


def min_score(length: Column) -> Column:
    """Least score of an alignment of a read of this length: 20 + 8 ln(length), truncated."""
    return (20 + 8 * F.ln(length)).cast("int")


def mapq_se(score: Column, second: Column, sub_n: Column, length: Column, match: int = 2, mismatch: int = 4, min_len: int = 25) -> Column:
    """Mapping quality of a single read from its best and second-best score and the number of near-best hits."""
    sub = F.when(second > 0, second).otherwise(F.lit(min_len * match))
    identity = 1.0 - (length * match - score) / F.lit(float(match + mismatch)) / length
    weight = F.when(length < 50, F.lit(1.0)).otherwise(F.lit(3.0) / F.ln(length)) * identity * identity
    raw = (6.02 * (score - sub) / F.lit(float(match)) * weight * weight + 0.499).cast("int") - F.when(sub_n > 0, (4.343 * F.ln(sub_n + 1) + 0.499).cast("int")).otherwise(F.lit(0))
    return F.when(sub >= score, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(60), raw)))


def sam_flag(paired: Column, mapped: Column, mate_mapped: Column, reverse: Column, mate_reverse: Column, first: Column) -> Column:
    bit = lambda c, b: F.when(c, F.lit(b)).otherwise(F.lit(0))
    both = mapped & mate_mapped
    pair = bit(both, PROPER) + bit(~mate_mapped, MATE_UNMAPPED) + bit(mate_reverse & mate_mapped, MATE_REVERSE) + F.when(first, F.lit(FIRST)).otherwise(F.lit(SECOND)) + F.lit(PAIRED)
    return bit(~mapped, UNMAPPED) + bit(reverse & mapped, REVERSE) + F.when(paired, pair).otherwise(F.lit(0))
