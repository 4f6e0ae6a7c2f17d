"""Best-fit packing of documents into training sequences under conflict constraints."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residua.llm.texts import stored, texts_of

CAPACITY = 2048
# pieces that are packed together; the number of shards follows from the number of rows
SHARD_ROWS = 4096


def count_tokens(text: str = "text") -> Column:
    """Words between ASCII blanks and one end mark; the end mark alone for a null text."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([len(t.encode().split()) + 1 if t else 1 for t in texts_of(texts)], pa.int64())

    return F.arrow_udf(count, "long").asNondeterministic()(F.col(text))


class Bins:
    """Open bins by residual, each with a bitmap of its sources and one of its duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_residual: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset): the tightest bin with room and without a conflict, else a new one."""
        at = bisect_left(self.by_residual, (size, -1))
        while at < len(self.by_residual):  # successors, from the tightest on
            residual, number = self.by_residual[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.by_residual[at]
                break
            at += 1
        else:
            residual, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if residual > size:
            insort(self.by_residual, (residual - size, number))
        return number, self.capacity - residual


def _bits(values: pd.Series) -> list[int]:
    """A bit for each value that occurs twice or more; others cannot conflict."""
    again = values.notna() & values.duplicated(keep=False)
    codes, _ = pd.factorize(values.where(again))
    return [1 << int(c) if c >= 0 else 0 for c in codes]


def _pack_shard(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "cluster"], ascending=[False, True, True, True],
                                kind="stable").reset_index(drop=True)
        bins = Bins(capacity)
        placed = [
            bins.place(size, source, cluster)
            for size, source, cluster in zip(rows["n_tokens"].tolist(), _bits(rows["source"]), _bits(rows["cluster"]))
        ]
        rows["bin"] = [b for b, _ in placed]
        rows["offset"] = [o for _, o in placed]
        return rows[["doc_id", "piece", "n_tokens", "source", "cluster", "shard", "bin", "offset"]]

    return pack


def pack(docs: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens", source: str = "source",
         cluster: str = "cluster", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, source, cluster, shard, bin, offset): where every token of ``docs`` goes.

    A document beyond the capacity is cut into full pieces, which fill bins of
    their own (shard -1, bin null), and a rest. Rests and shorter documents are
    packed best-fit decreasing, shard by shard. A bin holds at most one
    document of a source and one of a duplicate cluster; a null source or
    cluster conflicts with none. Documents with null, zero or negative sizes
    take no room and are left out; repeated rows are packed one by one; ties
    are broken by id. An empty table gives an empty one.

    Only ids and numbers are shuffled. Rows are dealt to shards by hash, so no
    source or cluster is gathered in one task, and a shard holds about
    ``shard_rows`` rows whatever the size of the table.
    """
    rows = stored(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(n_tokens).cast("long").alias("_size"),
        F.col(source).cast("string").alias("source"), F.col(cluster).cast("long").alias("cluster"),
    ).filter("_size > 0"), "sizes")
    last = F.ceil(F.col("_size") / capacity) - 1
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start_token"),
        F.least(F.lit(capacity), F.col("_size") - F.col("piece") * capacity).alias("n_tokens"), "source", "cluster",
    )
    full = F.col("n_tokens") == capacity
    alone = pieces.filter(full).select(
        "doc_id", "piece", "start_token", "n_tokens", "source", "cluster", F.lit(-1).alias("shard"),
        F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"),
    )
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = pieces.filter(~full).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "cluster"), F.lit(shards)).cast("int")
    )
    packed = dealt.drop("start_token").groupBy("shard").applyInPandas(
        _pack_shard(capacity),
        "doc_id long, piece long, n_tokens long, source string, cluster long, shard int, bin long, offset long",
    )
    return packed.select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), "n_tokens", "source", "cluster", "shard",
        "bin", "offset",
    ).unionByName(alone)
