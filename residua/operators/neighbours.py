"""The k-mers that score best against a seed, by similarity or by distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from residua import constants as C


def _fold(table: np.ndarray, codes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest-cost letter strings for one seed, ordered by cost and then by letters.

    Costs add up over positions, so the best prefixes of each length are enough
    to find the best strings of the next length.
    """
    costs = np.zeros(1)
    texts = np.zeros(1, dtype="U1")
    texts[0] = ""
    letters = np.array(sorted(C.RESIDUES))
    column = [C.RESIDUES.index(x) for x in letters]
    for code in codes:
        costs = (costs[:, None] + table[code][column][None, :]).ravel()
        texts = np.char.add(np.repeat(texts, 20), np.tile(letters, len(texts)))
        keep = np.lexsort((texts, costs))[:top]
        costs, texts = costs[keep], texts[keep]
    return costs, texts


# segments of seeds whose lists are kept for later seeds
_KEPT = 4096
# seeds of more letters are folded letter by letter: their numbers would not fit 64 bits with the cost
_LONGEST = 12


class SegmentLists:
    """The best letter strings of every segment of a batch of seeds, shared by all seeds that hold it.

    A list is a sorted array of numbers, cost first and letters second. The list
    of a segment joins those of its halves: string i of one half and j of the
    other can be among the best ``top`` only if (i + 1)(j + 1) <= top, as all
    pairs of earlier strings come before it. So about top * ln(top) pairs are
    looked at instead of all.
    """

    def __init__(self, table: np.ndarray, top: int):
        self.letters = sorted(C.RESIDUES)
        order = [C.RESIDUES.index(x) for x in self.letters]
        costs = table[np.ix_(order, order)].astype(np.int64)
        # costs from zero up, so that numbers sort as (cost, letters)
        self.least = int(costs.min())
        self.costs, self.top = costs - self.least, top
        self.number = {x: i for i, x in enumerate(self.letters)}
        rows = [np.arange(top // (i + 1)) for i in range(top)]
        self.left = np.repeat(np.arange(top), [len(r) for r in rows])
        self.right = np.concatenate(rows)
        self.known: dict[str, np.ndarray] = {}

    def best(self, segment: str) -> np.ndarray:
        """Sorted numbers: cost * 20^length + the string in base 20."""
        found = self.known.get(segment)
        if found is not None:
            return found
        if len(segment) == 1:
            found = np.sort(self.costs[self.number[segment]] * 20 + np.arange(20))[:self.top]
        else:
            half = len(segment) // 2
            found = self._joined(self.best(segment[:half]), self.best(segment[half:]), half, len(segment) - half)
        if len(self.known) >= _KEPT:
            self.known.pop(next(iter(self.known)))
        self.known[segment] = found
        return found

    def _joined(self, left: np.ndarray, right: np.ndarray, left_size: int, right_size: int) -> np.ndarray:
        inside = (self.left < len(left)) & (self.right < len(right))
        a, b = left[self.left[inside]], right[self.right[inside]]
        lower, upper = 20**right_size, 20**left_size
        joined = (a // upper + b // lower) * (upper * lower) + (a % upper) * lower + b % lower
        if len(joined) > self.top:
            joined = np.partition(joined, self.top - 1)[:self.top]
        return np.sort(joined)

    def strings(self, numbers: np.ndarray, size: int) -> np.ndarray:
        codes = numbers[:, None] // 20 ** np.arange(size - 1, -1, -1) % 20
        return np.array([ord(x) for x in self.letters], np.uint8)[codes].view(f"S{size}").ravel()

    def scores(self, numbers: np.ndarray, size: int) -> np.ndarray:
        return numbers // 20**size + size * self.least


def _costs(by: str) -> tuple[int, np.ndarray]:
    if by not in ("similarity", "distance"):
        raise ValueError("by must be similarity or distance")
    sign = -1 if by == "similarity" else 1
    return sign, sign * np.array(C.BLOSUM62 if by == "similarity" else C.BLOSUM_DISTANCE, dtype=np.int64)


def best_neighbours(seeds: DataFrame, top: int, by: str = "similarity") -> DataFrame:
    """(kmer, neighbour, score, place): the ``top`` best-scoring k-mers of every distinct seed.

    ``similarity`` ranks by falling BLOSUM62 score, ``distance`` by rising BLOSUM
    distance; equal scores are ordered by their letters. Seeds arrive sorted, so
    that neighbours in the order share the lists of their first letters.
    """
    sign, table = _costs(by)
    names = ["kmer", "neighbour", "score", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SegmentLists(table, top)
        for batch in batches:
            for kmer in batch.column("kmer").to_pylist():
                if len(kmer) > _LONGEST:
                    costs, texts = _fold(table, np.array([C.RESIDUES.index(c) for c in kmer]), top)
                    made = texts.astype(object)
                else:
                    numbers = lists.best(kmer)
                    costs = lists.scores(numbers, len(kmer))
                    made = lists.strings(numbers, len(kmer)).astype(f"U{len(kmer)}").astype(object)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kmer] * len(made)), pa.array(made, pa.string()), pa.array((sign * costs).astype(np.int64)),
                     pa.array(np.arange(1, len(made) + 1))], names=names)

    return _sorted_seeds(seeds).mapInArrow(run, "kmer string, neighbour string, score long, place long")


def _sorted_seeds(seeds: DataFrame) -> DataFrame:
    # by hash, so that no task gets all seeds of one beginning; sorted, so that each task's list of halves is short-lived
    return seeds.filter(F.length("kmer") > 0).select("kmer").distinct().sortWithinPartitions("kmer")


def neighbour_overlaps(seeds: DataFrame, tops: list[int]) -> DataFrame:
    """(top, n_seeds, n_shared, overlap): how much of the most similar k-mers is among the nearest ones, per list length.

    Both lists of a seed are made and compared where the seed is, for all lengths
    at once, and only sums leave the task.
    """
    most = max(tops)
    (_, similar), (_, near) = _costs("similarity"), _costs("distance")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = SegmentLists(similar, most), SegmentLists(near, most)
        sums = {t: [0, 0, 0] for t in tops}
        for batch in batches:
            for kmer in batch.column("kmer").to_pylist():
                size = 20 ** len(kmer)
                _, i, j = np.intersect1d(one.best(kmer) % size, two.best(kmer) % size, assume_unique=True, return_indices=True)
                met = np.sort(np.maximum(i, j))
                for t in tops:
                    seen = sums[t]
                    seen[0] += 1
                    seen[1] += min(t, size)
                    seen[2] += int(np.searchsorted(met, t))
        yield pa.RecordBatch.from_pydict({
            "top": pa.array(tops, pa.int64()), **{name: pa.array([sums[t][n] for t in tops], pa.int64())
                                                 for n, name in enumerate(("n_seeds", "_listed", "n_shared"))}})

    short = seeds.filter(F.length("kmer") <= _LONGEST)
    parts = _sorted_seeds(short).mapInArrow(run, "top long, n_seeds long, _listed long, n_shared long")
    return parts.groupBy("top").agg(*[F.sum(c).alias(c) for c in ("n_seeds", "_listed", "n_shared")]).filter(
        "n_seeds > 0").select("top", "n_seeds", "n_shared", (F.col("n_shared") / F.col("_listed")).alias("overlap"))


def top_overlap(similar: DataFrame, near: DataFrame, tops: list[int]) -> DataFrame:
    """Mean share of the top similar k-mers found among the top near ones, per list length."""
    both = similar.select("kmer", "neighbour", F.col("place").alias("_s")).join(
        near.select("kmer", "neighbour", F.col("place").alias("_d")), ["kmer", "neighbour"], "left"
    )
    sized = both.withColumn("top", F.explode(F.array(*[F.lit(t) for t in tops]))).filter("_s <= top")
    per = sized.groupBy("top", "kmer").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") <= F.col("top")).alias("_hit")
    )
    return per.groupBy("top").agg(F.avg(F.col("_hit") / F.col("_n")).alias("overlap"),
                                  F.count(F.lit(1)).alias("n_seeds"))
