"""Column functions over nucleotide strings; none needs Python at run time. Offsets are 0-based, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each base or ambiguity code and its complement, upper case then lower.
BASES = "ACGTUNRYKMBVDHSWacgtunrykmbvdhsw"
COMPLEMENTS = "TGCAANYRMKVBHDSWtgcaanyrmkvbhdsw"
#: Fixed value: the character for phred 30.
PHRED30 = "?"
#: How long a barcode is, how many errors it may have, and the length of the part that one must leave whole.
BARCODE, BARCODE_ERRORS, PART = 36, 3, 9
#: Letters that stand for bases when reads are made from prose.
LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "acgtacgtacgtacgtacgtacgtac"


def dna(text: Column) -> Column:
    """Prose as a nucleotide string: letters become bases in turn, all else goes."""
    return F.upper(F.regexp_replace(F.translate(F.lower(text), LETTERS, AS_BASES), "[^acgt]", ""))


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def cut(seq: Column, start: Column | int, end: Column | int) -> Column:
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.substring(seq, start + 1, end - start)


def suffix(seq: Column, n: Column | int) -> Column:
    """The last n characters; the whole string where it has fewer."""
    return F.right(seq, n if isinstance(n, Column) else F.lit(n))


def but_suffix(seq: Column, n: Column | int) -> Column:
    """All but the last n characters; empty where there are no more."""
    return F.left(seq, F.greatest(F.char_length(seq) - n, F.lit(0)))


def fake_quality(seq: Column) -> Column:
    return F.repeat(F.lit(PHRED30), F.char_length(seq))


def first_token(header: Column) -> Column:
    return F.split(header, r"\s+")[0]


def parts(seq: Column, size: int = PART, complete: bool = True) -> Column:
    """Array of (place, kmer): the disjoint parts from the left; without `complete` the last one is left out."""
    n = F.floor(F.char_length(seq) / size).cast("int") - (0 if complete else 1)
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct((i * size).alias("place"), F.substring(seq, i * size + 1, F.lit(size)).alias("kmer")),
    )


def pieces(seq: Column, size: int = BARCODE) -> Column:
    """Array of (place, piece): all disjoint pieces of the given size from the left; what is left over at the end goes."""
    n = F.floor(F.char_length(seq) / size).cast("int")
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("place"), F.substring(seq, i * size + 1, F.lit(size)).alias("piece")),
    )


def windows(seq: Column, size: int = PART, complete: bool = True) -> Column:
    """Array of the distinct kmers at all offsets; without `complete` the last offset is left out."""
    n = F.char_length(seq) - size + (1 if complete else 0)
    return F.array_distinct(
        F.transform(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda j: F.substring(seq, j + 1, F.lit(size)),
        )
    )
