"""How rows are spread over tasks: checked broadcasts, split hot keys, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# bytes a side may have to be sent whole to every executor
BROADCAST_BYTES = 64 << 20
# a key is hot when it holds more than this share of the rows, so that at most
# 1 / HOT_SHARE keys can be hot, whatever the size of the data
HOT_SHARE = 0.002
HOT_MIN_ROWS = 20_000
# rows of a hot key that one salt stands for
SALT_ROWS = 250_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a narrow scan that has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *keys)


def by_key(df: DataFrame, key: str, rows: int = 4_096) -> DataFrame:
    """Rows of one key in one partition, of about ``rows`` rows each.

    What is grouped by the key and more afterwards is not shuffled again, and a
    partition's groups fit a task's memory.
    """
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.select(key).count() // rows))
    return df.repartition(parts, key)


def small_enough(df: DataFrame, row_bytes: int = 1_000) -> bool:
    """Whether ``df`` surely fits the broadcast bound, given the width of a row.

    Counts the rows up to the bound and no further.
    """
    rows = max(1, BROADCAST_BYTES // row_bytes)
    return df.limit(rows + 1).count() <= rows


def hot_keys(df: DataFrame, keys: Sequence[str], sample_by: Sequence[str], share: float = HOT_SHARE,
             min_rows: int = HOT_MIN_ROWS, rate: int = 16) -> DataFrame:
    """(keys, _n): keys with about more than ``share`` of all rows and ``min_rows`` rows, and how many.

    Counted on one in ``rate`` rows, chosen by hash; what this misses is joined
    unsplit, so only speed depends on it. At most 1/share keys qualify.
    """
    sampled = df.filter(F.pmod(F.xxhash64(*[F.col(c) for c in sample_by]), F.lit(rate)) == 0)
    counts = sampled.groupBy(*keys).agg((F.count(F.lit(1)) * rate).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter((F.col("_n") > total * F.lit(share)) & (F.col("_n") > min_rows))


def split_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str],
              share: float = HOT_SHARE, min_rows: int = HOT_MIN_ROWS,
              salt_rows: int = SALT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Give both sides a ``_salt`` column so that no hot key meets in one task.

    Rows of ``left`` under a hot key are spread by ``salt_by`` over as many salts
    as the key's size asks for; the matching rows of ``right`` are repeated once per salt. All other rows
    get salt 0. Joining on keys and ``_salt`` yields exactly the unsalted join.
    Only rows of hot keys are repeated.
    """
    hot = hot_keys(left, keys, salt_by, share, min_rows)
    # 32 at least, so that a key just above the limits is also spread over the cores of a machine
    hot = F.broadcast(hot.select(*keys, F.greatest(F.lit(32), F.ceil(F.col("_n") / salt_rows)).cast("int").alias("_salts")))
    spread_salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.col("_salts")).cast("int")
    salted = left.join(hot, list(keys), "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), spread_salt).otherwise(F.lit(0))
    ).drop("_salts")
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = right.join(hot, list(keys), "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return salted, repeated


def join_split_hot(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str],
                   how: str = "inner", **kw) -> DataFrame:
    """Equi-join with hot keys of ``left`` split; ``how`` may be inner, left, left_semi or left_anti.

    ``left`` is read twice, so it should be a scan, a short projection or a
    checkpoint; after longer plans the runtime's own skew splitting is cheaper.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep or filter the left side can be split")
    salted, repeated = split_hot(left, right, keys, salt_by, **kw)
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def range_slices(df: DataFrame, order: str, slices: int | None = None) -> Column:
    """Slice number of each row by value of a numeric column, about equally filled.

    Slice borders are a few approximate quantiles, fixed before use, so a
    repeated task computes the same slice; equal values share a slice.
    """
    slices = slices or 4 * df.sparkSession.sparkContext.defaultParallelism
    borders = df.approxQuantile(order, [i / slices for i in range(1, slices)], 0.5 / slices)
    borders = sorted(set(borders))
    if not borders:
        return F.lit(0)
    literal = F.array(*[F.lit(b) for b in borders])
    return F.size(F.filter(literal, lambda b: b < F.col(order).cast("double")))


def running_total(df: DataFrame, slice_col: str, order: Sequence, value: str, name: str,
                  combine: str = "sum") -> DataFrame:
    """Running sum or max over all rows in order, without a global window.

    ``slice_col`` must grow with the order. A window runs inside every slice and
    what the earlier slices amount to is added from a table with one row per slice.
    """
    fold = {"sum": F.sum, "max": F.max}[combine]
    per_slice = df.groupBy(slice_col).agg(fold(value).alias("_part"))
    earlier = W.orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.select(slice_col, fold("_part").over(earlier).alias("_before"))
    inside = fold(value).over(W.partitionBy(slice_col).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("_in", inside).join(F.broadcast(carried), slice_col, "left")
    if combine == "sum":
        total = F.col("_in") + F.coalesce(F.col("_before"), F.lit(0))
    else:
        total = F.greatest(F.col("_in"), F.col("_before"))
    return out.withColumn(name, total).drop("_in", "_before")
