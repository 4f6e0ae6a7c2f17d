"""Hard-negative mining: an inverted multi-index whose cells are visited by half-score bounds until windows are certain."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from residua.llm.texts import hash_bound, stored
from residua.operators.layout import spread

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
# words of each half's codebook, and the bounded sample of rows they are fitted on; all rows are indexed
CODEWORDS = 16
SAMPLE = 20_000
# rows that one index holds; a larger partition is searched index after index
INDEX_ROWS = 32_768
# anchors that are sent to all tasks together; more are searched block after block
ANCHORS = 20_000
# rows scored by one product
STEP = 256

_NO_SCORE = -(1 << 62)
_FOUND = "query int, place int, vec_id long, score long"


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def codebook(sample: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of some half vectors, begun at rows far from each other."""
    sample = np.unique(sample, axis=0).astype(np.float64)
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centers = sample[[0]]
    near = ((sample - centers[0]) ** 2).sum(1)
    while len(centers) < min(words, len(sample)):
        centers = np.vstack([centers, sample[np.argmax(near)]])
        near = np.minimum(near, ((sample - centers[-1]) ** 2).sum(1))
    for _ in range(rounds):
        own = _nearest(sample, centers)
        for c in np.unique(own):
            centers[c] = sample[own == c].mean(0)
    return centers


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers ** 2).sum(1) - 2 * rows @ centers.T, axis=1)


class MultiIndex:
    """Rows by the pair of codewords of their halves, with the radius of every codeword here."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: list[np.ndarray]):
        self.middle = vectors.shape[1] // 2
        self.books = books
        codes, self.radii = [], []
        for half, book in zip(self.halves(vectors), books):
            half = half.astype(np.float64)
            own = _nearest(half, book)
            far = np.zeros(len(book))
            np.maximum.at(far, own, np.sqrt(((half - book[own]) ** 2).sum(1)))
            codes.append(own)
            self.radii.append(far)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, cell = ids[order], labels[order], cell[order]
        # doubles are exact up to 2^53; whole numbers beyond that
        peak = int(np.abs(vectors).max(initial=0))
        self.exact = vectors.shape[1] * peak * peak >= 1 << 53
        self.vectors = vectors[order] if self.exact else vectors[order].astype(np.float64)
        self.starts = np.searchsorted(cell, np.arange(len(books[0]) * len(books[1]) + 1)).tolist()

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[..., :self.middle], vectors[..., self.middle:]

    def cells(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, first row, last row) of the filled cells, highest upper bound first.

        A half's score with any row of a codeword lies within the half's length
        times the radius of its score with the codeword. Both lists of bounds
        are sorted, and a heap joins them: a sum's followers are never higher.
        """
        upper, lower, words = [], [], []
        for half, book, radii in zip(self.halves(anchor.astype(np.float64)), self.books, self.radii):
            scores, reach = book @ half, np.sqrt(half @ half) * radii * (1 + 1e-9) + 1e-3
            order = np.argsort(-(scores + reach), kind="stable")
            upper.append((scores + reach)[order].tolist())
            lower.append((scores - reach)[order].tolist())
            words.append(order.tolist())
        (u, v), (lu, lv), (wu, wv) = upper, lower, words
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(v):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
            cell = wu[i] * len(wv) + wv[j]
            if self.starts[cell] < self.starts[cell + 1]:
                yield -bound, lu[i] + lv[j], self.starts[cell], self.starts[cell + 1]

    def search(self, anchor_id: int, label: int, anchor: np.ndarray, same: bool, windows: list[tuple[int, int, int]],
               top: int, first_only: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest, known last place) the first ``top`` (ids, scores), high scores first.

        Rows of the anchor's own id take no part. Cells are visited until the
        next bound is below what every window still needs.
        """
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(windows)
        needs = [max(low, known) for low, _, known in windows]
        highest = max(high for _, high, _ in windows)
        vector = anchor if self.exact else anchor.astype(np.float64)
        waiting: list[np.ndarray] = []
        held = 0

        def settle() -> None:
            rows = np.concatenate(waiting)
            scores = (self.vectors[rows] @ vector).astype(np.int64)
            ids = self.ids[rows]
            fits = ((self.labels[rows] == label) == same) & (ids != anchor_id) & (scores >= min(needs)) & (scores <= highest)
            ids, scores = ids[fits], scores[fits]
            for w, (_, high, _) in enumerate(windows):
                some = (scores <= high) & (scores >= needs[w])
                if some.any():
                    i, s = np.concatenate([best[w][0], ids[some]]), np.concatenate([best[w][1], scores[some]])
                    order = np.lexsort((i, -s))[:top]
                    best[w] = i[order], s[order]
                    if len(order) == top:
                        needs[w] = max(needs[w], int(s[order[-1]]))

        for bound, below, start, end in self.cells(anchor):
            if bound < min(needs):
                break
            if below > highest:
                continue
            waiting.append(np.arange(start, end))
            held += end - start
            if held >= STEP:
                settle()
                waiting, held = [], 0
                if first_only:
                    break
        if waiting:
            settle()
        return best


def _indexes(batches: Iterator[pa.RecordBatch], width: int, books: list[np.ndarray]) -> Iterator[MultiIndex]:
    held: list[pa.RecordBatch] = []

    def made() -> MultiIndex:
        table = pa.Table.from_batches(held)
        return MultiIndex(table.column("vec_id").to_numpy(), table.column("label").to_numpy(),
                          matrix(table.column("vector").combine_chunks(), width), books)

    for batch in batches:
        for at in range(0, batch.num_rows, INDEX_ROWS):
            part = batch.slice(at, INDEX_ROWS)
            if held and sum(b.num_rows for b in held) + part.num_rows > INDEX_ROWS:
                yield made()
                held = []
            held.append(part)
    if held:
        yield made()


def _visit(asked: Broadcast, windows: Broadcast, width: int, books: Broadcast, same: bool, top: int, first_only: bool):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = asked.value
        limits, centers = windows.value, books.value
        for index in _indexes(batches, width, centers):
            out: list[np.ndarray] = []
            for q, wanted in limits.items():
                best = index.search(ids[q], labels[q], vectors[q], same, wanted, top, first_only)
                for place, (found, scores) in enumerate(best):
                    if len(found):
                        n = len(found)
                        out.append(np.stack([np.full(n, q), np.full(n, place), found, scores], 1))
            table = np.concatenate(out) if out else np.empty((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(table[:, 0].astype(np.int32)), pa.array(table[:, 1].astype(np.int32)), pa.array(table[:, 2]),
                 pa.array(table[:, 3])], names=["query", "place", "vec_id", "score"])

    return visit


def _first_rows(found: DataFrame, top: int) -> DataFrame:
    """The first rows of each window over all indexes; every task cuts its own before they are shuffled."""
    order = W.partitionBy("query", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def usable(vec_id: Column, vector: Column, label: Column) -> Column:
    """Whether a row takes part."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vec_id.isNotNull() & label.isNotNull() & F.coalesce(good, F.lit(False))


def hard_negatives(vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding",
                   label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH, scale: int = SCALE, block: int = ANCHORS, sample: int = SAMPLE,
                   codewords: int = CODEWORDS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` holds for.

    A score is the inner product of floor(scale * x) of both vectors. An
    anchor's positives are the first ``positives`` other rows of its label; for
    each, the negatives are the first ``negatives`` rows of other labels whose
    score is ``low`` to ``high`` percent of the positive's. Ties go to the
    smaller id. Rows with a null id, label, vector or component, or one that is
    not finite, take no part. Rows that repeat count each, but a row never
    meets rows of its own id, and an anchor that repeats is asked once. Shorter
    vectors are filled up with zeros. Extra columns are not used; an empty
    table gives an empty one.

    The codebooks are fitted on a bounded sample; all rows are indexed, where
    they lie, in indexes of bounded size. Anchors are a stated query set and
    are sent in blocks of bounded size. Each index first visits its best cells;
    what these find bounds the last place of each window everywhere, and the
    second visit ends where no cell can reach it, so results are exact.
    """
    spark = vectors.sparkSession
    numbers = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))
    rows = vectors.filter(usable(F.col(vec_id), F.col(vector), F.col(label))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), numbers.alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("_anchor"))
    rows = stored(spread(rows, "vec_id"), "vectors")
    count, width = rows.agg(F.count("vec_id"), F.max(F.size("vector"))).first()
    found = None
    if count and width:
        kept = rows.filter(F.xxhash64("vec_id", "vector") <= hash_bound(sample, count)).select("vector").toArrow()
        some = matrix(kept.column("vector").combine_chunks(), width)
        middle = width // 2
        books = spark.sparkContext.broadcast([codebook(half, codewords) for half in (some[:, :middle], some[:, middle:])])
        asked = stored(rows.filter("_anchor").select("vec_id", "label", "vector").distinct(), "anchors")
        parts = max(1, -(-asked.count() // block))
        for part in range(parts):
            own = asked.filter(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(parts)) == part).toArrow()
            if not own.num_rows:
                continue
            made = _mine(rows.select("vec_id", "label", "vector"), own, width, books, positives, negatives, low, high)
            found = made if found is None else found.unionByName(made)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    return found


def _mine(rows: DataFrame, own: pa.Table, width: int, books: Broadcast, positives: int, negatives: int, low: int,
          high: int) -> DataFrame:
    """The result for one block of anchors."""
    spark = rows.sparkSession
    ids = own.column("vec_id").to_pylist()
    asked = spark.sparkContext.broadcast(
        (ids, own.column("label").to_pylist(), matrix(own.column("vector").combine_chunks(), width)))

    def first(windows: dict, same: bool, top: int, first_only: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(windows)
        found = rows.mapInArrow(_visit(asked, shared, width, books, same, top, first_only), _FOUND)
        return _first_rows(found, top)

    def search(windows: dict, same: bool, top: int) -> DataFrame:
        last = first(windows, same, top, True).filter(F.col("rank") == top).select("query", "place", "score")
        known = {(r["query"], r.place): r.score for r in last.collect()}
        tight = {q: [(a, b, known.get((q, p), k)) for p, (a, b, k) in enumerate(w)] for q, w in windows.items()}
        return stored(first(tight, same, top, False), "windows")

    everything = {q: [(_NO_SCORE, -_NO_SCORE, _NO_SCORE)] for q in range(len(ids))}
    near = search(everything, True, positives).select("query", "rank", F.col("vec_id").alias("positive_id"),
                                                      F.col("score").alias("positive_score"))
    # a few numbers for each anchor of the block
    windows: dict[int, list] = {}
    for r in near.orderBy("query", "rank").collect():
        s = r.positive_score
        windows.setdefault(r["query"], []).append((-(-low * s // 100), high * s // 100, _NO_SCORE))
    far = search(windows, False, negatives)
    names = spark.createDataFrame(list(enumerate(ids)), "query int, anchor_id long")
    chosen = far.select("query", (F.col("place") + 1).alias("_place"), "rank", F.col("vec_id").alias("negative_id"),
                        F.col("score").alias("negative_score"))
    joined = chosen.join(near.withColumnRenamed("rank", "_place"), ["query", "_place"]).join(names, "query")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
