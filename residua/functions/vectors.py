"""Points in Euclidean space: embedding k-mers, distances, dot products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from residua import constants as C

# beyond this many terms one generated method grows too large to be compiled well
UNROLL_LIMIT = 16


def _table(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def kmer_point(kmer: Column) -> Column:
    """Concatenated coordinates of the residues, eight per residue; NULL on a non-residue."""
    coordinates = _table([C.COORDINATES[r] for r in C.RESIDUES])
    blocks = F.transform(
        F.split(kmer, ""),
        lambda c: F.element_at(coordinates, F.nullif(F.instr(F.lit(C.RESIDUES), c), F.lit(0))),
    )
    return F.flatten(blocks)


def point_at(seq: Column, position: Column, k: int) -> Column:
    """Point of the k-mer at a zero-based position of a sequence."""
    return kmer_point(F.substring(seq, position + 1, F.lit(k)))


def strict_kmer_point(kmer: Column, k: int = 10) -> Column:
    """:func:`kmer_point` that fails the job on a wrong length or letter."""
    valid = (F.length(kmer) == k) & kmer.rlike(f"^[{C.RESIDUES}]+$")
    return F.when(valid, kmer_point(kmer)).otherwise(
        F.raise_error(F.concat(F.lit("not a valid k-mer: "), kmer)).cast("array<double>")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def distance_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance as a built-in expression."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_sq(a, b))


@F.pandas_udf(T.DoubleType())
def _row_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    if len(a) == 0:
        return pd.Series([], dtype="float64")
    return pd.Series(np.sqrt(((np.stack(a.to_numpy()) - np.stack(b.to_numpy())) ** 2).sum(axis=1)))


def row_distance(a: Column, b: Column) -> Column:
    """Distance of two wide arrays per row, one vector operation per Arrow batch.

    For 64 and more coordinates this is several times faster than the built-in
    higher-order functions, which box every coordinate.
    """
    return _row_distance(a.cast("array<double>"), b.cast("array<double>"))


def kmer_codes(kmer: Column) -> Column:
    """Residue indices of a k-mer; comparing k-mers by these is plain array access."""
    return F.transform(F.split(kmer, ""), lambda c: (F.instr(F.lit(C.RESIDUES), c) - 1).cast("int"))


def residue_pair_sum(a: Column, b: Column, table: Sequence[Sequence[float]], k: int, kind: str,
                     a_from: int = 0, b_from: int = 0) -> Column:
    """Sum over k positions of a 20 x 20 residue table, from two arrays of residue indices.

    Comparing two k-mers this way needs their letters only, so joins carry k
    small numbers per side instead of 8k doubles.
    """
    cells = F.array(*[F.lit(x).cast(kind) for row in table for x in row])
    if k <= UNROLL_LIMIT:
        total = F.lit(0).cast(kind)
        for i in range(k):
            total = total + F.get(cells, a.getItem(a_from + i) * 20 + b.getItem(b_from + i))
        return total
    left, right = F.slice(a, a_from + 1, k), F.slice(b, b_from + 1, k)
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: F.get(cells, x * 20 + y)), F.lit(0).cast(kind), lambda s, v: s + v
    )


def position_scores(a: Column, b: Column, table: Sequence[Sequence[float]], kind: str) -> Column:
    """The residue table's value at each position of two arrays of residue indices."""
    cells = F.array(*[F.lit(x).cast(kind) for row in table for x in row])
    return F.zip_with(a, b, lambda x, y: F.get(cells, x * 20 + y))


def kmer_distance_sq(a: Column, b: Column, k: int, start: int = 0) -> Column:
    """Squared distance of two k-mers' points over k positions, from their residue indices."""
    return residue_pair_sum(a, b, C.COORDINATE_DISTANCE_SQ, k, "double", start, start)


def blosum_score(a: Column, b: Column, k: int, a_from: int = 0, b_from: int = 0) -> Column:
    return residue_pair_sum(a, b, C.BLOSUM62, k, "int", a_from, b_from)


def blosum_distance(a: Column, b: Column, k: int, a_from: int = 0, b_from: int = 0) -> Column:
    return residue_pair_sum(a, b, C.BLOSUM_DISTANCE, k, "int", a_from, b_from)


def triangle_violations(table: Sequence[Sequence[float]]) -> int:
    """How many ordered triples break the triangle inequality (a 20-row check)."""
    n = range(len(table))
    return sum(table[i][j] > table[i][k] + table[k][j] for i in n for j in n for k in n)
