"""Centroids, spreads, profiles and pre-groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residua import constants as C
from residua.functions.hashing import KernelFamily, kernel_bucket
from residua.functions.vectors import row_distance
from residua.operators.layout import join_split_hot


def centroids(points: DataFrame, group: str, dim: int, point: str = "point",
              weight: str | None = None) -> DataFrame:
    """Mean point and size of every group, combined before the shuffle.

    With ``weight`` the rows are themselves means of that many points.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    sums = [F.sum(F.col(point).getItem(i) * w).alias(f"_s{i}") for i in range(dim)]
    total = points.groupBy(group).agg(F.sum(w).cast("long").alias("size"), *sums)
    mean = F.array(*[F.col(f"_s{i}") / F.col("size") for i in range(dim)])
    return total.select(group, mean.alias("center"), "size")


def cluster_radius(points: DataFrame, centers: DataFrame, group: str, id_col: str = "point_id") -> DataFrame:
    """Largest distance of a member to its centre."""
    paired = join_split_hot(points, centers, [group], [id_col])
    measured = paired.select(group, row_distance(F.col("point"), F.col("center")).alias("_d"))
    return measured.groupBy(group).agg(F.max("_d").alias("radius"))


def mean_pair_distance_sq(points: DataFrame, group: str, dim: int, point: str = "point") -> DataFrame:
    """Mean squared distance over all pairs of a group's members, without forming pairs.

    The squared distances of all n(n-1)/2 pairs add up to n * sum |x|^2 - |sum x|^2.
    """
    sums = [F.sum(F.col(point).getItem(i)).alias(f"_s{i}") for i in range(dim)]
    squares = sum((F.col(point).getItem(i) * F.col(point).getItem(i) for i in range(dim)), F.lit(0.0))
    total = points.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.sum(squares).alias("_q"), *sums)
    square_of_sum = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(dim)), F.lit(0.0))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    mean = (F.col("size") * F.col("_q") - square_of_sum) / pairs
    return total.filter("size > 1").select(group, "size", mean.alias("mean_sq"))


def weight_matrix(members: DataFrame, motif: str = "motif", kmer: str = "kmer",
                  copies: str | None = None, letters: str = C.MOTIF_LETTERS) -> DataFrame:
    """Letter frequency at each position of each motif, one column per letter.

    ``copies`` names a column that says how often a row's k-mer occurs.
    """
    weight = F.lit(1) if copies is None else F.col(copies)
    cells = members.select(motif, weight.alias("_w"), F.posexplode(F.split(F.col(kmer), "")).alias("pos", "_aa"))
    counts = [F.sum(F.when(F.col("_aa") == a, F.col("_w")).otherwise(F.lit(0))).alias(a) for a in letters]
    total = cells.groupBy(motif, "pos").agg(F.sum("_w").alias("_n"), *counts)
    return total.select(motif, "pos", *[(F.col(a) / F.col("_n")).alias(a) for a in letters])


def feature_counts(seqs: DataFrame, id_col: str = "protein_id", length: int = 3) -> DataFrame:
    """Sparse histogram of each sequence's k-mers over the eight residue groups; a row is one sequence."""

    @F.arrow_udf("array<struct<code:int,n:long>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.unique(_octet_codes(text.as_py(), length), return_counts=True) for text in texts]
            ends = np.cumsum([0, *(len(codes) for codes, _ in found)])
            cells = [np.concatenate([pair[i] for pair in found] or [np.zeros(0, np.int64)]) for i in (0, 1)]
            rows = pa.StructArray.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64())], names=["code", "n"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    found = seqs.select(id_col, F.explode(counted("seq")).alias("_f"))
    return found.select(id_col, F.col("_f.code").alias("code"), F.col("_f.n").alias("n"))


def _octet_codes(text: str | None, length: int) -> np.ndarray:
    """Base-8 number of each k-mer, first residue lowest."""
    digits = _OCTETS[np.frombuffer((text or "").encode("ascii"), dtype=np.uint8)]
    n = len(digits) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    return sum(digits[i:i + n] << (3 * i) for i in range(length))


_OCTETS = np.zeros(256, dtype=np.int64)
_OCTETS[[ord(r) for r in C.RESIDUES]] = [int(c) for c in C.group_codes("octet")]


def pre_groups(seqs: DataFrame, family: KernelFamily, id_col: str = "protein_id",
               length: int = 3) -> DataFrame:
    """Bucket of every sequence from the kernel hash of its histogram, in one pass where it is read.

    Sequences shorter than ``length`` have no histogram and no bucket.
    """
    weights = np.ascontiguousarray(family.weights().T)

    @F.arrow_udf("array<double>")
    def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts = np.stack([np.bincount(_octet_codes(t.as_py(), length), minlength=len(weights)) for t in texts])
            yield pa.array(list(counts @ weights), pa.list_(pa.float64()))

    rows = seqs.filter(F.length("seq") >= length).select(id_col, projected("seq").alias("_p"))
    projections = [F.col("_p")[i] for i in range(family.bits)]
    return rows.select(id_col, kernel_bucket(projections, family).alias("bucket"))


def bucket_histograms(buckets: DataFrame, lengths: DataFrame, id_col: str = "protein_id"
                      ) -> tuple[DataFrame, DataFrame]:
    """How many buckets have each size, and each total sequence length."""
    per = buckets.join(lengths, id_col).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.sum("length").alias("total_length")
    )
    sizes = per.groupBy("size").agg(F.count(F.lit(1)).alias("n_buckets"))
    totals = per.groupBy("total_length").agg(F.count(F.lit(1)).alias("n_buckets"))
    return sizes, totals


def annotation_summary(rows: DataFrame, length: str, fields: Sequence[str], unknown: str = "unknown"
                       ) -> DataFrame:
    """Totals over all rows and over the rows whose annotation fields are all unknown."""
    blank: Column = F.lit(True)
    for field in fields:
        blank = blank & (F.col(field) == unknown)
    totals = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(blank).alias("n_unknown"),
        F.sum(length).cast("long").alias("total_length"),
        F.coalesce(F.sum(F.when(blank, F.col(length))), F.lit(0)).cast("long").alias("unknown_length"),
    )
    return totals.select(
        "*",
        (F.col("n_unknown") / F.col("total")).alias("unknown_share"),
        (F.col("unknown_length") / F.nullif(F.col("n_unknown"), F.lit(0))).alias("unknown_mean_length"),
    )
