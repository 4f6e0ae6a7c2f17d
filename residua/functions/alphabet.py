"""Residue alphabets: cleaning, indices, reduced codes, packed k-mers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from residua import constants as C

UNKNOWN_MODES = ("cycle", "drop", "error", "keep")
# bytes of text that are cleaned together
_BLOCK = 1 << 20

_RESIDUES = np.frombuffer(C.RESIDUES.encode(), np.uint8)
# upper-case letter of each byte, 0 if it is none
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = _UPPER[97:123] = np.arange(65, 91)
_UNKNOWN = np.zeros(256, bool)
_UNKNOWN[np.frombuffer(C.NON_RESIDUES.encode(), np.uint8)] = True


def _cycled_block(texts: pa.StringArray) -> pa.StringArray:
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    letters = _UPPER[np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]]
    kept = letters > 0
    ends = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)]).astype(np.int32)[offsets - offsets[0]]
    letters = letters[kept]
    at = np.flatnonzero(_UNKNOWN[letters])
    position = at - ends[np.searchsorted(ends, at, "right") - 1]
    letters[at] = _RESIDUES[(letters[at] + position) % 20]
    valid = None if texts.null_count == 0 else texts.is_valid().buffers()[1]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes()), valid)


def _cycled(texts: pa.Array) -> pa.Array:
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    cuts = np.unique(np.searchsorted(offsets[:-1], np.arange(offsets[0], offsets[-1] + 1, _BLOCK)))
    cuts = [0, *cuts[(cuts > 0) & (cuts < len(texts))].tolist(), len(texts)]
    return pa.concat_arrays([_cycled_block(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])


def clean_residues(text: Column, unknown: str = "cycle") -> Column:
    """Upper-case letters of ``text`` as a sequence over the twenty residues.

    Letters that are no residue (B J O U X Z) are replaced by the residue at
    index (character code + zero-based position) mod 20 with ``cycle``, so the
    same input always gives the same sequence; ``drop`` removes them, ``error``
    fails the job and ``keep`` leaves them in.
    """
    text = F.col(text) if isinstance(text, str) else text
    letters = F.upper(F.regexp_replace(text, "[^A-Za-z]+", ""))
    if unknown == "keep":
        return letters
    if unknown == "drop":
        return F.translate(letters, C.NON_RESIDUES, "")
    if unknown == "error":
        bad = letters.rlike(f"[{C.NON_RESIDUES}]")
        return F.when(bad, F.raise_error(F.concat(F.lit("unknown residue in "), letters))).otherwise(letters)
    if unknown != "cycle":
        raise ValueError(f"unknown must be one of {UNKNOWN_MODES}")

    return F.arrow_udf(_cycled, T.StringType())(text.cast("string"))


def residue_index(letter: Column) -> Column:
    """Zero-based index of a one-letter residue, -1 when it is none."""
    return F.when(F.length(letter) == 1, F.instr(F.lit(C.RESIDUES), letter) - 1).otherwise(F.lit(-1))


def reduce_sequence(seq: Column, alphabet: str = "murphy10") -> Column:
    """Every residue replaced by the code of its group."""
    return F.translate(seq, C.RESIDUES, C.group_codes(alphabet))


def representative_sequence(reduced: Column, alphabet: str = "murphy10") -> Column:
    """Group codes back to each group's representative residue."""
    symbols = "0123456789ABCDEFGHIJ"[: len(C.REDUCED_ALPHABETS[alphabet])]
    return F.translate(reduced, symbols, C.REPRESENTATIVES[alphabet])


def octet_code(kmer: Column, length: int = 3) -> Column:
    """Base-8 number of a k-mer over the eight residue groups, first residue lowest."""
    digits = F.reverse(reduce_sequence(F.substring(kmer, 1, length), "octet"))
    return F.conv(digits, 8, 10).cast("int")


def octet_digits(code: Column, length: int = 3) -> Column:
    """The base-8 digits of :func:`octet_code`, first residue first."""
    return F.reverse(F.lpad(F.conv(code.cast("string"), 10, 8), length, "0"))


def seed_number(seq: Column, start: Column | int, length: int = 6) -> Column:
    """Reduced k-mer at a zero-based ``start`` read as a decimal number, -1 if it is cut off."""
    start = F.lit(start) if isinstance(start, int) else start
    piece = F.substring(reduce_sequence(seq), start + 1, F.lit(length))
    return F.when((F.length(piece) == length) & piece.rlike("^[0-9]+$"), piece.cast("long")).otherwise(F.lit(-1))
