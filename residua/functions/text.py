"""String, bit and number helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_any(text: Column, delimiters: str, keep_empty: bool = False) -> Column:
    """Split at any of a set of characters."""
    escaped = "".join("\\" + c if c in "\\]^-[" else c for c in delimiters)
    parts = F.split(text, f"[{escaped}]")
    return parts if keep_empty else F.filter(parts, lambda p: p != "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda p: p != "")


def split_quoted(text: Column) -> Column:
    """Words at blanks or tabs; single or double quotes keep a stretch together."""
    word = r"""((?:"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|[^ \t"'])+)"""
    return F.regexp_extract_all(strip(text), F.lit(word), F.lit(1))


def squash(parts: Column) -> Column:
    """Drop strings that hold nothing but white space."""
    return F.filter(parts, lambda p: strip(p) != "")


def log_sum_exp(values: Column, limit: int | None = None) -> Column:
    """log of the sum of exponentials of the first ``limit`` values."""
    used = values if limit is None else F.slice(values, 1, limit)
    top = F.array_max(used)
    total = F.aggregate(used, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return top + F.log(total)


def percent(part: Column, whole: Column) -> Column:
    return (F.lit(100.0) * part / whole).cast("long")


def bits_masked(bits: Column, mask: Column) -> Column:
    """All 64 bits of ``bits & mask`` as a string."""
    return F.lpad(F.bin(bits.bitwiseAND(mask)), 64, "0")


def bits_last(bits: Column, positions: int) -> Column:
    """The lowest ``positions`` bits as a string."""
    return F.substring(F.lpad(F.bin(bits), 64, "0"), 65 - positions, positions)


def file_stem(path: Column) -> Column:
    """File name without folders and without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
