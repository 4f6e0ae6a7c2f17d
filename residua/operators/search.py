"""Radius search, nearest centre, pairs within a radius."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residua import constants as C
from residua.functions.hashing import (
    LshFamily, keys_array, kmer_lsh_keys, kmer_probe_keys, kmer_totals, letter_codes, lsh_keys, probe_keys,
    probe_template, table_keys,
)
from residua.functions.vectors import kmer_codes, kmer_distance_sq, row_distance
from residua.operators.layout import BROADCAST_BYTES, join_split_hot, small_enough, split_hot
from residua.session import cut_lineage


def _met_before(left: str, right: str, tables: int) -> Column:
    """Whether both sides already share a key in a table before the current one.

    A pair that meets in several tables is kept in the first of them only, so
    no later shuffle has to remove duplicates.
    """
    before = F.lit(False)
    for t in range(tables - 1):
        same = F.col(left)[f"k{t}"] == F.col(right)[f"k{t}"]
        before = before | ((F.col("_table") > t) & same)
    return before


def _keyed(side: DataFrame, keys: str, tables: int) -> DataFrame:
    return side.select("*", F.posexplode(keys_array(F.col(keys), tables)).alias("_table", "_key"))


def _pair_up(points: DataFrame, centers: DataFrame, small: bool, spread_by: str) -> DataFrame:
    """Pairs of both sides that share (_table, _key).

    A small centre side is broadcast and the points are not shuffled at all;
    otherwise both are shuffled and hot keys are split.
    """
    if small:
        return points.join(F.broadcast(centers), ["_table", "_key"])
    points, centers = split_hot(points, centers, ["_table", "_key"], [spread_by])
    return points.join(centers, ["_table", "_key", "_salt"])


def distinct_kmers(kmers: DataFrame, col: str = "kmer") -> DataFrame:
    """Copies of a k-mer share one point, so searches run on distinct k-mers."""
    return kmers.select(col).distinct()


def _coded_centers(centers: DataFrame) -> DataFrame:
    return distinct_kmers(centers).select(F.col("kmer").alias("center"), kmer_codes(F.col("kmer")).alias("_cc"))


def _kmer_hits(kmers: DataFrame, centers: DataFrame, k: int, radius: float, key_points, seen_before,
               located: bool = False) -> DataFrame:
    """Hits of keyed centres among k-mers; ``located`` gives every occurrence with its other columns.

    Copies of a k-mer share one point. With a small centre side every k-mer is
    looked up where it is read and copies of hits are dropped at the end; with a
    large one copies are merged first, so that they are shuffled once.
    """
    # key, table number, residue indices, letters and the hash table's own needs
    small = small_enough(centers, 200 + 12 * k)
    if located and not small:
        return locate_hits(_kmer_hits(kmers, centers, k, radius, key_points, seen_before), kmers)
    kept = kmers.columns if located else ["kmer"]
    points = kmers.select(*kept) if small else distinct_kmers(kmers)
    points = key_points(points)
    fresh = _pair_up(points, centers, small, "kmer").withColumn("_pc", kmer_codes(F.col("kmer"))).filter(~seen_before)
    d = F.sqrt(kmer_distance_sq(F.col("_cc"), F.col("_pc"), k))
    hits = fresh.select("center", *kept, d.alias("distance")).filter(F.col("distance") <= radius)
    if located or not small:
        return hits
    return hits.groupBy("center", "kmer").agg(F.first("distance").alias("distance"))


# bytes that one key of a centre takes in the sorted lists sent to the k-mers
_KEY_BYTES = 24
# candidate pairs of one table that a task measures at once
_CANDIDATES = 200_000


def _measured_pairs(left: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) of all places of each row's run, a bounded number at a time; runs start at ``left``."""
    rows = np.flatnonzero(counts)
    ends = np.cumsum(counts[rows])
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CANDIDATES, "right")))
        some, n = rows[at:upto], counts[rows[at:upto]]
        first = np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(some, n), np.repeat(left[some], n) + np.arange(n.sum()) - first
        at = upto


def _probed_hits(sent, k: int, radius: float, family: LshFamily):
    """Hits of a bounded set of centres among k-mers, found in the buckets the centres look into."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, codes, names = sent.value
        totals, cells = kmer_totals(k, family), np.array(C.COORDINATE_DISTANCE_SQ).ravel()
        for batch in batches:
            own = letter_codes(batch.column("kmer"), k)
            keys = table_keys(totals(own), family)
            found = []
            for t, (known, owner, present) in enumerate(tables):
                maybe = np.flatnonzero(present[keys[:, t] & (len(present) - 1)])
                left = np.searchsorted(known, keys[maybe, t])
                counts = np.searchsorted(known, keys[maybe, t], "right") - left
                for row, place in _measured_pairs(left, counts):
                    row, center = maybe[row], owner[place]
                    square = cells[codes[center] * 20 + own[row]].sum(1)
                    near = square <= radius * radius + 1e-9
                    found.append((center[near], row[near], square[near]))
            if found:
                center, row, square = (np.concatenate(x) for x in zip(*found))
                near = np.sqrt(square) <= radius
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(center[near])), batch.column("kmer").take(pa.array(row[near])), pa.array(np.sqrt(square[near]))],
                    names=["center", "kmer", "distance"])

    return find


def kmer_radius_lsh(centers: DataFrame, kmers: DataFrame, k: int, radius: float, family: LshFamily,
                    probes: int = 24) -> DataFrame:
    """(center, kmer, distance) for distinct k-mers found by multi-probe LSH within the radius.

    A subset of :func:`kmer_radius_exact` with equal distances. A k-mer has one
    bucket in each table; a centre looks into its own and into those behind its
    nearest borders, ``probes`` in all, so few tables of narrow buckets suffice.
    While the centres' keys pass the broadcast bound, k-mers are hashed and
    measured where they are read and only hits leave the task; beyond it the
    keys of both sides are joined.
    """
    # few lines have fewer neighbouring buckets
    probes = len(probe_template(family.lines, probes))
    distinct = distinct_kmers(centers)
    spark = kmers.sparkSession
    if small_enough(distinct, _KEY_BYTES * family.tables * probes):
        names = distinct.toArrow().column("kmer").combine_chunks().cast(pa.string())
        codes = letter_codes(names, k)
        keys = probe_keys(kmer_totals(k, family)(codes), family, probes)
        tables = []
        for t in range(family.tables):
            flat = keys[:, t, :].ravel()
            order = np.argsort(flat, kind="stable")
            # most keys of k-mers are not among the centres' and are told by a few of their bits
            present = np.zeros(1 << 23, dtype=bool)
            present[flat & (len(present) - 1)] = True
            tables.append((flat[order], (order // probes).astype(np.int32), present))
        if not len(names):
            return _coded_centers(centers).select("center", F.lit("").alias("kmer"), F.lit(0.0).alias("distance")).limit(0)
        sent = spark.sparkContext.broadcast((tables, codes, names))
        hits = kmers.select("kmer").mapInArrow(
            _probed_hits(sent, k, radius, family), "center string, kmer string, distance double")
    else:
        looked = F.posexplode(kmer_probe_keys(F.col("center"), k, family, probes)).alias("_probe", "_key")
        c = _coded_centers(centers).select("center", "_cc", looked)
        c = cut_lineage(c.withColumn("_table", F.floor(F.col("_probe") / probes).cast("int")).drop("_probe"))
        points = distinct_kmers(kmers).withColumn("_pkeys", kmer_lsh_keys(F.col("kmer"), k, family))
        keyed = _keyed(points, "_pkeys", family.tables).select("kmer", "_table", "_key")
        met = _pair_up(keyed, c, False, "kmer")
        d = F.sqrt(kmer_distance_sq(F.col("_cc"), kmer_codes(F.col("kmer")), k))
        hits = met.select("center", "kmer", d.alias("distance")).filter(F.col("distance") <= radius)
    # a pair that meets in several tables, or whose k-mer has copies, counts once
    return hits.groupBy("center", "kmer").agg(F.first("distance").alias("distance"))


def _blocks(k: int, m: int) -> list[tuple[int, int]]:
    """m runs of (start, length) that cover k positions."""
    borders = [round(i * k / m) for i in range(m + 1)]
    return [(a + 1, b - a) for a, b in zip(borders, borders[1:])]


# most neighbours a centre's block may have on average
NEIGHBOURS = 500
# cells of the grid on which sums of squared distances are counted
_GRID = 4096


def _expected_neighbours(longest: int, limit: float) -> np.ndarray:
    """[length, cell]: mean number of blocks up to a cell's squared distance from a random block of that length.

    Distances are rounded down to the grid, so a count is never too low.
    """
    steps, weights = np.unique(
        np.floor(np.array(C.COORDINATE_DISTANCE_SQ).ravel() * (_GRID - 1) / limit).astype(int), return_counts=True)
    found = np.zeros((longest + 1, _GRID))
    found[0, 0] = 1.0
    for n in range(1, longest + 1):
        for step, weight in zip(steps.tolist(), (weights / 20).tolist()):
            if step < _GRID:
                found[n, step:] += weight * found[n - 1, :_GRID - step]
    return found.cumsum(axis=1)


def _choose_blocks(k: int, limit: float, neighbours: int = NEIGHBOURS) -> list[tuple[int, int]]:
    """The blocks under which the fewest pairs meet, among those whose neighbourhoods stay small.

    When no choice keeps the neighbourhoods small, the one with the fewest
    neighbours per centre is taken.
    """
    if limit <= 0:
        return _blocks(k, 1)
    counts = _expected_neighbours(k, limit)
    plans = []
    for m in range(1, k + 1):
        blocks = _blocks(k, m)
        near = [counts[n, min(_GRID - 1, int((_GRID - 1) / m) + 1)] for _, n in blocks]
        share = sum(x / 20.0**n for x, (_, n) in zip(near, blocks))
        plans.append((max(near) > neighbours, share if max(near) <= neighbours else sum(near), m))
    return _blocks(k, min(plans)[2])


def _near_blocks(block: Column, limit: float) -> Column:
    """All residue strings of a block's length within a squared distance of it."""
    near = F.array(*[
        F.array(*[F.struct(F.lit(b).alias("r"), F.lit(C.COORDINATE_DISTANCE_SQ[i][j]).alias("d"))
                  for j, b in enumerate(C.RESIDUES) if C.COORDINATE_DISTANCE_SQ[i][j] <= limit])
        for i in range(20)
    ])
    start = F.array(F.struct(F.lit("").alias("text"), F.lit(0.0).alias("sq")))

    def longer(found: Column, code: Column) -> Column:
        options = F.get(near, code)
        grown = F.flatten(F.transform(found, lambda s: F.transform(
            options, lambda o: F.struct(F.concat(s["text"], o["r"]).alias("text"), (s["sq"] + o["d"]).alias("sq")))))
        return F.filter(grown, lambda g: g["sq"] <= limit)

    return F.transform(F.aggregate(kmer_codes(block), start, longer), lambda g: g["text"])


def kmer_radius_exact(centers: DataFrame, kmers: DataFrame, k: int, radius: float, located: bool = False) -> DataFrame:
    """(center, kmer, distance) for all distinct k-mers within the radius, by equi-joins.

    With ``located`` every occurrence of a k-mer is a row of its own and keeps its
    columns; few enough centres find it where it is read, without a join back.

    The squared distance is a sum over positions. When it is at most radius^2 and
    the k positions are cut into m blocks, some block's share is at most
    radius^2 / m. The centre's blocks are therefore replaced by all their
    neighbours within that share and joined with the k-mers' blocks on equality.
    A small radius needs one block, whose neighbours are the hits themselves; a
    larger one takes more and shorter blocks.
    """
    limit = radius * radius
    blocks = _choose_blocks(k, limit)
    # a little slack, so rounding never loses a pair; the distance decides
    share = limit / len(blocks) + 1e-9

    def texts(col: str) -> Column:
        return F.array(*[F.substring(F.col(col), s, n) for s, n in blocks])

    near = F.transform(texts("center"), lambda block: _near_blocks(block, share))
    c = _coded_centers(centers).select("center", "_cc", F.posexplode(near).alias("_table", "_near"))
    c = c.select("center", "_cc", "_table", F.explode("_near").alias("_key"))
    # a pair that meets in several blocks counts in the first of them
    before = F.lit(False)
    for t, (s, n) in enumerate(blocks[:-1]):
        part = kmer_distance_sq(F.col("_cc"), F.col("_pc"), n, s - 1)
        before = before | ((F.col("_table") > t) & (part <= share))

    def keyed(points: DataFrame) -> DataFrame:
        return points.select("*", F.posexplode(texts("kmer")).alias("_table", "_key"))

    return _kmer_hits(kmers, c, k, radius, keyed, before, located)


def locate_hits(hits: DataFrame, kmers: DataFrame) -> DataFrame:
    """Hits on distinct k-mers joined back to every occurrence of the k-mer."""
    return join_split_hot(kmers, hits, ["kmer"], [c for c in kmers.columns if c != "kmer"])


def radius_lsh(centers: DataFrame, points: DataFrame, radius: float, family: LshFamily) -> DataFrame:
    """LSH radius search over (center_id, center) and (point_id, point)."""
    c = _keyed(centers.select("center_id", "center", lsh_keys(F.col("center"), family).alias("_ckeys")),
               "_ckeys", family.tables)
    p = _keyed(points.select("point_id", "point", lsh_keys(F.col("point"), family).alias("_pkeys")),
               "_pkeys", family.tables)
    small = small_enough(c, 200 + 8 * family.dim)
    fresh = _pair_up(p, c, small, "point_id").filter(~_met_before("_pkeys", "_ckeys", family.tables))
    d = row_distance(F.col("point"), F.col("center"))
    return fresh.select("center_id", "point_id", d.alias("distance")).filter(F.col("distance") <= radius)


# rows of one side a block comparison holds
BLOCK_ROWS = 8_000


# pivots of the metric cells, and the points they are chosen from
PIVOTS = 256
PIVOT_SAMPLE = 4_096
# points whose distances to the pivot are near each other and that are compared in one product
_RING = 256


def choose_pivots(points: DataFrame, count: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Some points far from each other, out of a bounded sample; they decide how fast a search is, not what it finds."""
    rows = points.count()
    bound = min((1 << 63) - 1, -(1 << 63) + ((sample << 64) // max(1, rows)))
    kept = points.filter(F.xxhash64("point") <= bound).select("point").limit(4 * sample).toArrow()
    some = np.unique(np.array(kept.column("point").to_pylist(), dtype=float).reshape(kept.num_rows, -1), axis=0)
    if not len(some):
        some = np.array([points.first().point], dtype=float)
    chosen = some[[0]]
    near = ((some - chosen[0]) ** 2).sum(1)
    while len(chosen) < count and near.max() > 0:
        chosen = np.vstack([chosen, some[near.argmax()]])
        near = np.minimum(near, ((some - chosen[-1]) ** 2).sum(1))
    return chosen


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


# how far a distance from a matrix product may be off, as a share of the lengths involved
_ROUNDING = 1e-6


def _cell_of(pivots):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _to_pivots(np.stack(pdf["point"].to_numpy()), pivots.value)
                pdf["_cell"] = d.argmin(1).astype("int32")
                pdf["_far"] = d[np.arange(len(d)), d.argmin(1)]
                yield pdf

    return place


def _cells_near(pivots, reach, radius: float):
    """The cells that may hold points within the radius of each centre."""

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest, farthest = reach.value
        for whole in batches:
            for at in range(0, len(whole), 1024):
                pdf = whole.iloc[at:at + 1024]
                x = np.stack(pdf["center"].to_numpy())
                d = _to_pivots(x, pivots.value)
                slack = radius + _ROUNDING * (1 + np.sqrt((x * x).sum(1)))[:, None] + _ROUNDING * np.maximum(farthest, 0)
                # d(centre, pivot) and d(point, pivot) differ by no more than d(centre, point), and no pivot is
                # nearer to a point of the cell than the cell's own
                fits = (d - slack <= farthest) & (d + slack >= nearest) & (d <= d.min(1)[:, None] + 2 * slack)
                i, j = np.nonzero(fits)
                yield pd.DataFrame({"center_id": pdf["center_id"].to_numpy()[i], "center": pdf["center"].to_numpy()[i],
                                    "_cell": j.astype("int32"), "_far": d[i, j]})

    return enter


def _block_hits(radius: float):
    """Hits between one block of points and one block of centres."""

    def run(points: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"center_id": [], "point_id": [], "distance": []}).astype(
            {"center_id": "int64", "point_id": "int64"})
        if len(points) == 0 or len(centers) == 0:
            return none
        ringed = "_far" in points
        if ringed:
            points, centers = points.sort_values("_far"), centers.sort_values("_far")
        x, y = np.stack(points["point"].to_numpy()), np.stack(centers["center"].to_numpy())
        parts = [none]
        step = _RING if ringed else 1024
        for at in range(0, len(x), step):
            low, high = 0, len(y)
            if ringed:
                far, own = centers["_far"].to_numpy(), points["_far"].to_numpy()[at:at + step]
                slack = radius + _ROUNDING * (1 + own[-1] + far[-1] + np.abs(x[at:at + step]).max() * x.shape[1])
                low, high = np.searchsorted(far, own[0] - slack), np.searchsorted(far, own[-1] + slack, "right")
            for by in range(low, high, BLOCK_ROWS):
                i, j, d = _near_pairs(x[at:at + step], y[by:min(high, by + BLOCK_ROWS)], radius)
                parts.append(pd.DataFrame({
                    "center_id": centers["center_id"].to_numpy()[by + j],
                    "point_id": points["point_id"].to_numpy()[at + i], "distance": d,
                }))
        return pd.concat(parts)

    return run


def _near_pairs(x: np.ndarray, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) within the radius."""
    xs, ys = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :]
    # the product form rounds differently: keep a margin, then measure exactly
    i, j = np.nonzero(xs + ys - 2 * (x @ y.T) <= radius * radius + 1e-9 * (1 + xs + ys))
    d = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
    near = d <= radius
    return i[near], j[near], d[near]


def _near_sent_centers(points: DataFrame, held: pa.Table, radius: float) -> DataFrame:
    """Hits of a bounded table of centres, which is sent to the points where they are read."""
    ids = held.column("center_id").to_numpy()
    vectors = np.array(held.column("center").to_pylist(), dtype=float)
    sent = points.sparkSession.sparkContext.broadcast((ids, vectors))
    compare = _block_hits(radius)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = sent.value
        centers = pd.DataFrame({"center_id": ids, "center": list(vectors)})
        for pdf in batches:
            yield compare(pdf, centers)

    rows = points.select("point_id", F.col("point").cast("array<double>").alias("point"))
    return rows.mapInPandas(near, "center_id long, point_id long, distance double")


def radius_exact(centers: DataFrame, points: DataFrame, dim: int, radius: float,
                 sent_rows: int | None = None) -> DataFrame:
    """All (center_id, point_id, distance) within the radius.

    Centres that pass the broadcast bound are sent to the points, which are then
    not shuffled. Otherwise each point belongs to the cell of its nearest pivot,
    and a centre is entered into the cells that the triangle inequality leaves:
    those whose span of distances to the pivot comes within the radius of its own
    distance. A cell's points and centres are cut into blocks of bounded size, so
    a cell that holds most of the data is spread over many tasks; inside a pair
    of blocks only rings of like distance to the pivot are compared.
    """
    spark = points.sparkSession
    centers = centers.select(F.col("center_id").cast("long").alias("center_id"),
                             F.col("center").cast("array<double>").alias("center"))
    points = points.select("point_id", F.col("point").cast("array<double>").alias("point"))
    most = BROADCAST_BYTES // (64 + 8 * dim) if sent_rows is None else sent_rows
    held = centers.limit(most + 1).toArrow()
    if held.num_rows <= most:
        return _near_sent_centers(points, held, radius)
    none = points.select(F.lit(0).cast("long").alias("center_id"), F.col("point_id").cast("long").alias("point_id"),
                         F.lit(0.0).alias("distance")).limit(0)
    if points.isEmpty():
        return none
    pivots = spark.sparkContext.broadcast(choose_pivots(points))
    placed = cut_lineage(points.mapInPandas(_cell_of(pivots), "point_id long, point array<double>, _cell int, _far double"))
    # one row for each pivot
    spans = placed.groupBy("_cell").agg(F.min("_far").alias("near"), F.max("_far").alias("far"), F.count("_far").alias("n")).collect()
    nearest, farthest = np.full(len(pivots.value), np.inf), np.full(len(pivots.value), -np.inf)
    for r in spans:
        nearest[r["_cell"]], farthest[r["_cell"]] = r["near"], r["far"]
    farthest = np.where(np.isfinite(farthest), farthest, -1e300)
    reach = spark.sparkContext.broadcast((nearest, farthest))
    entered = cut_lineage(centers.mapInPandas(
        _cells_near(pivots, reach, radius), "center_id long, center array<double>, _cell int, _far double"))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        counted = side.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
        return counted.select("_cell", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias(name))

    # at most as many rows as there are pivots; cells without points or without centres drop out here
    shape = F.broadcast(blocks(placed, "_pn").join(blocks(entered, "_cn"), "_cell"))
    p = placed.join(shape, "_cell").select(
        "point_id", "point", "_far", "_cell", F.pmod(F.xxhash64("point_id"), F.col("_pn")).cast("int").alias("_pb"),
        F.explode(F.sequence(F.lit(0), F.col("_cn") - 1)).alias("_cb"))
    c = entered.join(shape, "_cell").select(
        "center_id", "center", "_far", "_cell", F.explode(F.sequence(F.lit(0), F.col("_pn") - 1)).alias("_pb"),
        F.pmod(F.xxhash64("center_id"), F.col("_cn")).cast("int").alias("_cb"))
    group = ["_cell", "_pb", "_cb"]
    return p.groupBy(*group).cogroup(c.groupBy(*group)).applyInPandas(
        _block_hits(radius), "center_id long, point_id long, distance double")


def nearest_center(hits: DataFrame, point_id: str = "point_id", center_id: str = "center_id") -> DataFrame:
    """The nearest centre of each point among search hits; the lower id wins ties."""
    best = F.min(F.struct(F.col("distance"), F.col(center_id))).alias("_best")
    return hits.groupBy(point_id).agg(best).select(
        point_id, F.col(f"_best.{center_id}").alias(center_id), F.col("_best.distance").alias("distance")
    )


def pairs_within(points: DataFrame, dim: int, radius: float) -> DataFrame:
    """Unordered pairs (a < b) of one point set within the radius."""
    centers = points.select(F.col("point_id").alias("center_id"), F.col("point").alias("center"))
    hits = radius_exact(centers, points, dim, radius).filter("center_id < point_id")
    return hits.select(F.col("center_id").alias("id_a"), F.col("point_id").alias("id_b"), "distance")


def split_by_radius(measured: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Rows within the radius and the rest."""
    return measured.filter(F.col("distance") <= radius), measured.filter(F.col("distance") > radius)


def owner_of_position(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """Owner of each global position, from spans (start, length, owner) that do not overlap.

    Both sides are cut into cells of fixed width, so finding the span around a
    position is an equi-join; a span is entered once per cell it touches.
    """
    width = 1 << 14
    end = F.col("start") + F.col("length")
    cells = F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))
    entered = spans.filter("length > 0").withColumn("_cell", F.explode(cells))
    located = positions.withColumn("_cell", F.floor(F.col("pos") / width))
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < end)
    split = [c for c in positions.columns]
    return join_split_hot(located, entered, ["_cell"], split).filter(inside).drop("_cell")
