"""Column expressions on sequences, names and bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the plain and of the ambiguity letters.
PLAIN = ("ACGTacgt", "TGCAtgca")
IUPAC = ("ACGTURYKMBDHVacgturykmbdhv", "TGCAAYRMKVHDBtgcaayrmkvhdb")
# Letters an ambiguity code stands for.
CODES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def reverse_complement(text: Column, iupac: bool = False) -> Column:
    """Other characters stay as they are."""
    return F.reverse(F.translate(text, *(IUPAC if iupac else PLAIN)))


def src_species(src: Column) -> Column:
    """The part of ``species.sequence`` before the last dot; the whole name if there is none."""
    return F.when(F.contains(src, F.lit(".")), F.regexp_extract(src, r"\A(.*)\.[^.]*\z", 1)).otherwise(src)


def src_sequence(src: Column) -> Column:
    """The part after the last dot, null if there is none."""
    return F.when(F.contains(src, F.lit(".")), F.substring_index(src, ".", -1))


def forward_start(start: Column, size: Column, strand: Column, src_size: Column) -> Column:
    """Start on the forward strand of a component given on its own strand."""
    return F.when(strand == "-", src_size - start - size).otherwise(start)


def forward_end(start: Column, size: Column, strand: Column, src_size: Column) -> Column:
    return F.when(strand == "-", src_size - start).otherwise(start + size)


def gap_count(text: Column, gap: str = "-") -> Column:
    return F.length(text) - F.length(F.translate(text, gap, ""))


def bin_for_range(start: Column, end: Column, *, shift: int = 17, step: int = 3, levels: int = 6) -> Column:
    """Number of the smallest standard bin that holds [start, end), finest bins last.

    Level k (0: the whole) has 2^(step k) bins; its first has the number of all bins on the levels above.
    """
    out = F.lit(0).cast("bigint")
    for k in range(1, levels):
        wide = shift + step * (levels - 1 - k)
        first = sum(2 ** (step * j) for j in range(k))
        a, b = F.shiftright(start.cast("bigint"), wide), F.shiftright(F.greatest(end.cast("bigint") - 1, start.cast("bigint")), wide)
        out = F.when(a == b, a + first).otherwise(out)
    return out


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def chars(text: Column) -> Column:
    """Characters as an array; null gives null and an empty text an empty array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_codes(text: Column, codes: Mapping[str, int]) -> Column:
    """array<int> of the characters' codes, -1 for others."""
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.transform(chars(text), lambda c: F.coalesce(F.try_element_at(table, c), F.lit(-1)))


def radix_codes(texts: Sequence[Column], codes: Mapping[str, int]) -> Column:
    """One number per column of equally long texts: sum of code x base^i; -1 where any character has none."""
    base = max(codes.values()) + 1
    each = F.arrays_zip(*[char_codes(t, codes).alias(f"c{i}") for i, t in enumerate(texts)])

    def number(column: Column) -> Column:
        parts = [column[f"c{i}"] for i in range(len(texts))]
        bad = F.lit(False)
        total = F.lit(0).cast("bigint")
        for i, p in enumerate(parts):
            bad, total = bad | (p < 0), total + p * base**i
        return F.when(bad, F.lit(-1).cast("bigint")).otherwise(total)

    return F.transform(each, number)


def map_codes(values: Column, mapping: Mapping[int, int]) -> Column:
    """Maps an array of integers; unmapped ones become -1."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.transform(values, lambda v: F.coalesce(F.try_element_at(table, v), F.lit(-1)))


def collapse_codes(mapping: Mapping[int, int], a: int, b: int) -> dict[int, int]:
    """A mapping in which the outputs a and b are one; outputs stay without holes."""
    low, high = min(a, b), max(a, b)
    return {k: low if v == high else v - (v > high) for k, v in mapping.items()}


def expand_code(mapping: Mapping[int, int], key: int) -> dict[int, int]:
    """A mapping in which the input ``key`` has an output of its own."""
    return {**mapping, key: max(mapping.values(), default=-1) + 1}


def consensus_pattern(code: str) -> str:
    """A regular expression for an ambiguity-code motif."""
    return "".join(f"[{CODES[c.upper()]}]" for c in code)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters."""
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")
