"""Locality-sensitive hash keys."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from residua import constants as C
from residua.functions.vectors import dot


@dataclass(frozen=True)
class LshFamily:
    """``tables`` hash tables, each keyed by ``lines`` random projections.

    One projection is floor((a.x + b) / width) with a standard normal and b
    uniform in [0, width). Parameters depend on the seed only and are rounded so
    that they can be printed exactly.
    """

    dim: int
    lines: int = 4
    tables: int = 4
    width: float = 50.0
    seed: int = 17
    decimals: int = 4

    def directions(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.round(rng.standard_normal((self.tables, self.lines, self.dim)), self.decimals)

    def offsets(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed + 1)
        return np.round(rng.uniform(0, self.width, (self.tables, self.lines)), self.decimals)


def line_bucket(point: Column, direction, offset: float, width: float) -> Column:
    """Bucket of one projection as a built-in expression."""
    literal = F.array(*[F.lit(float(x)) for x in direction])
    return F.floor((dot(point, literal) + F.lit(float(offset))) / F.lit(float(width)))


def lsh_buckets_native(point: Column, family: LshFamily) -> Column:
    """The buckets of every table's projections, from built-in expressions only."""
    a, b = family.directions(), family.offsets()
    return F.array(
        *[
            F.array(*[line_bucket(point, a[t, j], b[t, j], family.width) for j in range(family.lines)])
            for t in range(family.tables)
        ]
    )


def _mix(buckets: np.ndarray) -> np.ndarray:
    """One 64-bit key per table from its buckets, [row, table, line] -> [row, table].

    Two different bucket lists share a key about once in 2^64 cases; that would
    add a candidate, which the distance check after the join decides.
    """
    key = np.full(buckets.shape[:2], 1469598103934665603, dtype=np.uint64)
    for j in range(buckets.shape[2]):
        key = (key ^ buckets[:, :, j].astype(np.uint64)) * np.uint64(1099511628211)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _keys_frame(totals: np.ndarray, width: float, tables: int, lines: int) -> pd.DataFrame:
    buckets = np.floor(totals / width).astype(np.int64).reshape(len(totals), tables, lines)
    return pd.DataFrame(_mix(buckets), columns=[f"k{t}" for t in range(tables)])


def _keys_type(tables: int) -> T.StructType:
    # plain number columns cross the Arrow border without a Python object per row
    return T.StructType([T.StructField(f"k{t}", T.LongType()) for t in range(tables)])


def keys_array(keys: Column, tables: int) -> Column:
    """The keys of :func:`lsh_keys` as one array."""
    return F.array(*[keys[f"k{t}"] for t in range(tables)])


def lsh_keys(point: Column, family: LshFamily) -> Column:
    """Struct of one key per table, all projections of an Arrow batch in one matrix product."""
    tables, lines, width = family.tables, family.lines, family.width
    a = family.directions().reshape(-1, family.dim).T.copy()
    b = family.offsets().reshape(-1)

    @F.pandas_udf(_keys_type(tables))
    def keys(points: pd.Series) -> pd.DataFrame:
        x = np.stack(points.to_numpy()) if len(points) else np.empty((0, a.shape[0]))
        return _keys_frame(x @ a + b, width, tables, lines)

    return keys(point.cast("array<double>"))


_INDEX = np.full(256, -1, dtype=np.int64)
_INDEX[[ord(r) for r in C.RESIDUES]] = np.arange(20)


def letter_codes(kmers: pa.Array, k: int) -> np.ndarray:
    """Residue numbers of a column of k-mers, [row, position], read from its bytes."""
    if not len(kmers):
        return np.empty((0, k), np.int64)
    lengths = np.frombuffer(kmers.buffers()[1], np.int32)[kmers.offset:kmers.offset + len(kmers) + 1]
    letters = np.frombuffer(kmers.buffers()[2], np.uint8)[lengths[0]:lengths[-1]]
    return _INDEX[letters.reshape(-1, k)]


def kmer_totals(k: int, family: LshFamily):
    """A function from residue numbers to the shifted projections of their points, [row, table * line].

    The projection of a k-mer point is a sum of one number per position and
    residue; two positions are looked up at once, so k / 2 look-ups replace a
    product over 8k coordinates and only k bytes per row travel to the worker.
    """
    if family.dim != C.POINT_WIDTH * k:
        raise ValueError("the hash family must have 8 dimensions per residue")
    coordinates = np.array([C.COORDINATES[r] for r in C.RESIDUES])
    directions = family.directions().reshape(-1, k, C.POINT_WIDTH)
    # [position, residue, projection]
    parts = np.einsum("pkc,rc->krp", directions, coordinates)
    pairs = [(parts[i][:, None, :] + parts[i + 1][None, :, :]).reshape(400, -1) for i in range(0, k - 1, 2)]
    b = family.offsets().reshape(-1)

    def totals(codes: np.ndarray) -> np.ndarray:
        out = np.tile(b, (len(codes), 1))
        for i, table in enumerate(pairs):
            out += table[codes[:, 2 * i] * 20 + codes[:, 2 * i + 1]]
        if k % 2:
            out += parts[k - 1][codes[:, k - 1]]
        return out

    return totals


def _codes_of(kmers: pd.Series, k: int) -> np.ndarray:
    return _INDEX[np.frombuffer("".join(kmers).encode("ascii"), dtype=np.uint8).reshape(-1, k)]


def kmer_lsh_keys(kmer: Column, k: int, family: LshFamily) -> Column:
    """Keys of a k-mer's point, from the letters."""
    tables, lines, width = family.tables, family.lines, family.width
    totals = kmer_totals(k, family)

    @F.pandas_udf(_keys_type(tables))
    def keys(kmers: pd.Series) -> pd.DataFrame:
        return _keys_frame(totals(_codes_of(kmers, k)), width, tables, lines)

    return keys(kmer)


def table_keys(totals: np.ndarray, family: LshFamily) -> np.ndarray:
    """The key of each table, [row, table]."""
    buckets = np.floor(totals / family.width).astype(np.int64)
    return _mix(buckets.reshape(len(totals), family.tables, family.lines))


def probe_template(lines: int, probes: int) -> list[list[int]]:
    """Sets of borders to cross, most promising first, as ranks of a point's 2 * lines borders by distance.

    The expected squared distance of the border of each rank depends on the
    number of lines alone, so all points share the sets (query-directed
    multi-probe). A set never crosses both borders of one line: the ranks of
    these mirror each other.
    """
    n = 2 * lines
    scale = 4 * (lines + 1) * (lines + 2)
    expected = [r * (r + 1) / scale if r <= lines else 1 - (n + 1 - r) / (lines + 1) + (n + 1 - r) * (n + 2 - r) / scale
                for r in range(1, n + 1)]
    out: list[list[int]] = [[]]
    heap = [(expected[0], [0])]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if not any(n - 1 - r in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1] + 1
        if last < n:
            heapq.heappush(heap, (score - expected[last - 1] + expected[last], [*ranks[:-1], last]))
            heapq.heappush(heap, (score + expected[last], [*ranks, last]))
    return out


def probe_keys(totals: np.ndarray, family: LshFamily, probes: int) -> np.ndarray:
    """Keys of the buckets to look into, [row, table, probe]: a point's own and those behind its nearest borders."""
    scaled = (totals / family.width).reshape(len(totals), family.tables, family.lines)
    own = np.floor(scaled)
    borders = np.concatenate([scaled - own, own + 1 - scaled], axis=2)
    order = np.argsort(borders, axis=2, kind="stable")
    keys = []
    for ranks in probe_template(family.lines, probes):
        buckets = own.astype(np.int64)
        for r in ranks:
            line, step = order[:, :, r] % family.lines, np.where(order[:, :, r] < family.lines, -1, 1)
            np.put_along_axis(buckets, line[:, :, None], np.take_along_axis(buckets, line[:, :, None], 2) + step[:, :, None], 2)
        keys.append(_mix(buckets))
    return np.stack(keys, axis=2)


def kmer_probe_keys(kmer: Column, k: int, family: LshFamily, probes: int) -> Column:
    """Array of tables * probes keys of a k-mer, table after table."""
    totals = kmer_totals(k, family)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(kmers: pd.Series) -> pd.Series:
        return pd.Series(list(probe_keys(totals(_codes_of(kmers, k)), family, probes).reshape(len(kmers), -1)))

    return keys(kmer)


def collision_probability(distance: float, width: float) -> float:
    """Chance that one projection puts two points at ``distance`` into one bucket."""
    ratio = width / distance
    below = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def expected_recall(distance: float, width: float, lines: int, tables: int) -> float:
    """Chance that a pair at ``distance`` meets in at least one table."""
    return 1 - (1 - collision_probability(distance, width) ** lines) ** tables


@dataclass(frozen=True)
class KernelFamily:
    """Random Fourier bits: bit i is set when cos(w_i.x + b_i) + t_i >= 0.

    w is normal with standard deviation sigma squared, t uniform in (-1, 1) and
    b uniform in (0, 2 pi).
    """

    dim: int = 512
    bits: int = 16
    sigma: float = 0.2
    seed: int = 23
    decimals: int = 6

    def weights(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.round(rng.normal(0.0, self.sigma**2, (self.bits, self.dim)), self.decimals)

    def thresholds(self) -> np.ndarray:
        return np.round(np.random.default_rng(self.seed + 1).uniform(-1, 1, self.bits), self.decimals)

    def phases(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed + 2)
        return np.round(rng.uniform(0, 2 * math.pi, self.bits), self.decimals)


def kernel_bucket(projections: list[Column], family: KernelFamily) -> Column:
    """Bucket number from the projections w_i.x."""
    t, b = family.thresholds(), family.phases()
    bucket = F.lit(0).cast("long")
    for i, p in enumerate(projections):
        on = F.cos(p + F.lit(float(b[i]))) + F.lit(float(t[i])) >= 0
        bucket = bucket + F.when(on, F.lit(1 << i)).otherwise(F.lit(0))
    return bucket
