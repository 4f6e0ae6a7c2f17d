"""Ranked lexical search: impact vectors in norm buckets, Cauchy-Schwarz and coordinate bounds, exact integer scores."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from residua.llm.texts import plain_words, stored, texts_of

TOP = 10
# impact vectors of one norm bucket
BUCKET = 4096
# bytes of query text that are ranked together; more are ranked block after block
QUERY_BYTES = 4 << 20
# how many of a query's largest coordinates are summed before the rest is bounded
FOCUS = 6
# rows of one Arrow batch looked at together
_ROWS = 512

_HITS = "query int, doc_id long, score long"


def _vectors(terms: Broadcast):
    """(doc_id, n, terms, counts) of each text: all its words counted, those of the queries named."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.value
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                sizes, names, counts = [], [], []
                for text in texts_of(batch.column("text")):
                    words = plain_words(text)
                    found = sorted((number[w], c) for w, c in Counter(words).items() if w in number)
                    sizes.append(len(words))
                    names.append([f[0] for f in found])
                    counts.append([f[1] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.int32())),
                     pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return count


class Bucket:
    """Impact vectors of about equal length, by term."""

    def __init__(self, ids: pa.Array, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        self.ids = ids
        order = np.argsort(terms, kind="stable")
        self.rows, self.terms, self.impacts = rows[order], terms[order], impacts[order]
        self.squares = np.zeros(len(ids))
        np.add.at(self.squares, rows, impacts.astype(np.float64) ** 2)
        self.longest = math.sqrt(self.squares.max(initial=0.0))

    def postings(self, term: int) -> slice:
        low, high = np.searchsorted(self.terms, [term, term + 1])
        return slice(int(low), int(high))

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of at least ``least``; terms by descending weight.

        Cauchy-Schwarz rejects the bucket, or what its rows can still reach
        beyond the focus coordinates; those left are scored in integers.
        """
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        real = weights.astype(np.float64)
        # a little more than the bound, so that rounding of doubles never rejects
        slack = 1 + 1e-9
        if math.sqrt(real @ real) * self.longest * slack < least:
            return none
        partial, rest = np.zeros(len(self.ids), np.int64), self.squares.copy()
        spans = [self.postings(t) for t in terms.tolist()]
        for weight, span in list(zip(weights, spans))[:FOCUS]:
            rows, impacts = self.rows[span], self.impacts[span]
            partial[rows] += weight * impacts
            rest[rows] -= impacts.astype(np.float64) ** 2
        left = real[FOCUS:]
        # subtraction of squares loses at most a few last digits of the row's whole square
        bound = partial + math.sqrt(left @ left) * np.sqrt(np.maximum(rest, 0) + 1e-9 * self.squares) * slack
        alive = (bound >= least) & ((partial > 0) | (len(left) > 0))
        if not alive.any():
            return none
        for weight, span in list(zip(weights, spans))[FOCUS:]:
            rows, impacts = self.rows[span], self.impacts[span]
            keep = alive[rows]
            partial[rows[keep]] += weight * impacts[keep]
        rows = np.flatnonzero(alive & (partial >= max(least, 1)))
        return rows, partial[rows]


def _buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Bucket]:
    """Rows arrive by descending length; so many of them in a row are one bucket."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            terms, impacts = part.column("terms"), part.column("impacts")
            lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
            yield Bucket(part.column("doc_id"), np.repeat(np.arange(part.num_rows), lengths),
                         terms.flatten().to_numpy(zero_copy_only=False), impacts.flatten().to_numpy(zero_copy_only=False))


def _best(ids: pa.Array, rows: np.ndarray, scores: np.ndarray, top: int) -> list[tuple[int | None, int]]:
    """The first (doc_id, score), highest score and then lowest id first, null ids last."""
    if len(rows) > 4 * top:
        cut = np.partition(scores, len(scores) - top)[len(scores) - top]
        rows, scores = rows[scores >= cut], scores[scores >= cut]
    named = [(ids[int(r)].as_py(), int(s)) for r, s in zip(rows, scores)]
    return sorted(named, key=_order)[:top]


def _order(hit: tuple[int | None, int]) -> tuple:
    return -hit[1], hit[0] is None, hit[0] or 0


def _search(asked: Broadcast, least: Broadcast | None, top: int, bucket: int, first_only: bool):
    """(query, doc_id, score): the best rows of a partition for each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = asked.value
        known = least.value if least is not None else {}
        best: dict[int, list] = {}
        for part in _buckets(batches, bucket):
            for q, (terms, weights) in queries.items():
                held = best.get(q, [])
                bound = max(known.get(q, 1), held[-1][1] if len(held) == top else 1)
                rows, scores = part.search(terms, weights, bound)
                if len(rows):
                    best[q] = sorted(held + _best(part.ids, rows, scores, top), key=_order)[:top]
            if first_only:
                break
        out = [(q, i, s) for q, hits in best.items() for i, s in hits]
        made = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(m, t) for m, t in zip(made, (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return search


def _block(spark, docs: DataFrame, asked: list, top: int, bucket: int) -> DataFrame:
    """(query, doc_id, score) of the best rows for each of some queries (number, words)."""
    number: dict[bytes, int] = {}
    named = {q: sorted({number.setdefault(w, len(number)) for w in words}) for q, words in asked}
    rows = stored(docs.mapInArrow(_vectors(spark.sparkContext.broadcast(number)),
                                  "doc_id long, n long, terms array<int>, counts array<long>"), "terms")
    n_docs, length = rows.filter("n > 0").agg(F.count("n"), F.sum("n")).first()
    if not n_docs:
        return spark.createDataFrame([], _HITS)
    # one row for each term of the queries
    df = {r.term: r.df for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("term").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    queries = {}
    for q, terms in named.items():
        heavy = sorted(((weight[t], t) for t in terms if weight.get(t, 0) > 0), reverse=True)
        queries[q] = np.array([t for _, t in heavy], np.int64), np.array([w for w, _ in heavy], np.int64)
    m = F.expr(f"10 + ((90 * n * {n_docs}) div {length})")
    impact = rows.withColumn("m", m).withColumn(
        "impacts", F.expr("transform(counts, c -> (1000000000 * c) div (1000 * c + 8 * m))"))
    squared = F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ordered = stored(impact.filter(F.size("terms") > 0).select("doc_id", "terms", "impacts", squared.alias("_square"))
                     .sortWithinPartitions(F.desc("_square")).drop("_square"), "impacts")
    shared = spark.sparkContext.broadcast(queries)

    def run(bounds: Broadcast | None, first_only: bool) -> DataFrame:
        return ordered.mapInArrow(_search(shared, bounds, top, bucket, first_only), _HITS)

    # the longest vectors of each file give every query a score that its last place has at least
    last = _first_rows(run(None, True), "query", top).filter(F.col("rank") == top)
    bounds = {r["query"]: r.score for r in last.collect()}
    return run(spark.sparkContext.broadcast(bounds), False)


def _first_rows(hits: DataFrame, query: str, top: int) -> DataFrame:
    """``hits`` with their rank, up to ``top``; every task cuts its own rows before they are shuffled."""
    order = W.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, bucket: int = BUCKET, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` rows of ``docs`` with the highest scores above 0 for each query.

    Terms are lower-cased runs of letters, digits and non-ASCII characters.
    Each different (item_id, text) row of ``queries`` is one query and its
    terms count once; a null or blank text asks for nothing. Rows of ``docs``
    that repeat are ranked each; a null text has no terms; equal scores come by
    ascending id, null ids last. Other columns are not used; empty tables give
    an empty one.

    Texts are read once for each block of queries (``query_bytes``) and stay
    where they are. In every file the vectors lie in descending length, cut
    into buckets. A query skips a bucket, or a row, whose length cannot reach
    its last place; what is left is scored in integers.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = stored(queries.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(
        "text IS NOT NULL").distinct().withColumn("_long", F.monotonically_increasing_id()), "queries")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // query_bytes
    found = None
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("_long"), F.lit(parts)) == part).select("_long", "item_id", "text").collect()
        names = {i: (r["_long"], r["item_id"]) for i, r in enumerate(rows)}
        hits = _block(spark, docs, [(i, plain_words(r["text"])) for i, r in enumerate(rows)], top, bucket)
        keys = spark.createDataFrame([(i, n) for i, (n, _) in names.items()], "query int, _long long")
        hits = hits.join(F.broadcast(keys), "query").select("_long", "doc_id", "score")
        found = hits if found is None else found.unionByName(hits)
    ranked = _first_rows(found, "_long", top).join(asked.select("_long", "item_id"), "_long")
    return ranked.select("item_id", "rank", "doc_id", "score")
