"""Clustering: leaders, LSH hierarchy, connected components."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from residua import constants as C
from residua.functions.hashing import LshFamily, letter_codes, lsh_keys
from residua.functions.vectors import kmer_point, row_distance
from residua.operators.groups import centroids
from residua.operators.layout import join_split_hot
from residua.session import cut_lineage

# points one task may hold of one bucket
CHUNK = 2_000
# points of each side of a pair of blocks of a larger bucket, and how many of them are compared at once
SIDE = 4_000
STRIP = 512

_RESIDUE_POINTS = np.array([C.COORDINATES[r] for r in C.RESIDUES])


def _matrix(points: pd.Series) -> np.ndarray:
    """The points of a block as rows; k-mers travel as text and become points only here."""
    if not isinstance(points.iloc[0], str):
        return np.stack(points.to_numpy())
    codes = letter_codes(pa.array(points, pa.string()), len(points.iloc[0]))
    return _RESIDUE_POINTS[codes].reshape(len(points), -1)


def _first_matches(pdf: pd.DataFrame, radius_sq: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy pass over one bounded bucket, in (leader first, id) order."""
    ids = pdf["id"].to_numpy()
    free = ~pdf["is_leader"].to_numpy(dtype=bool)
    order = np.lexsort((ids, free))
    ids, free, vectors = ids[order], free[order], _matrix(pdf["point"])[order]
    joined = np.full(len(ids), -1, dtype=np.int64)
    centers = np.empty(len(ids), dtype=np.int64)
    n = 0
    for i in range(len(ids)):
        if free[i] and n:
            delta = vectors[centers[:n]] - vectors[i]
            near = np.flatnonzero(np.einsum("ij,ij->i", delta, delta) <= radius_sq)
            if len(near):
                joined[i] = ids[centers[near[0]]]
                continue
        centers[n] = i
        n += 1
    return ids[joined >= 0], joined[joined >= 0]


def _leader_pass(radius_sq: float):
    """The greedy pass for each bucket of one pack."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_first_matches(bucket, radius_sq) for _, bucket in pdf.groupby("bucket", sort=False)]
        return pd.DataFrame({"id": np.concatenate([p[0] for p in parts]),
                             "leader": np.concatenate([p[1] for p in parts])})

    return run


def _settle(bounded: DataFrame, radius: float) -> DataFrame:
    """(id, leader) inside buckets of at most about CHUNK rows.

    Many buckets are tiny, so they are handed over in packs of a few CHUNKs.
    """
    packs = 1 + bounded.count() // (2 * CHUNK)
    packed = bounded.select("bucket", "id", "is_leader", "point",
                            F.pmod(F.xxhash64("bucket"), F.lit(packs)).alias("_pack"))
    return packed.groupBy("_pack").applyInPandas(_leader_pass(radius * radius), "id long, leader long")


def _first_rows(radius: float, earlier: bool):
    """(id, first): the lowest id of a block within the radius of each point of another block."""

    def run(points: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if len(points) == 0 or len(others) == 0:
            return pd.DataFrame({"id": [], "first": []}).astype("int64")
        others = others.sort_values("id")
        ids, own = others["id"].to_numpy(), points["id"].to_numpy()
        x, y = _matrix(points["point"]), _matrix(others["point"])
        limit, ys = radius * radius, (y * y).sum(1)
        first = np.full(len(own), -1, dtype=np.int64)
        for at in range(0, len(own), STRIP):
            part = x[at:at + STRIP]
            xs = (part * part).sum(1)[:, None]
            # the product form rounds differently: what lies near the border is measured exactly
            square, margin = xs + ys - 2 * (part @ y.T), 1e-9 * (1 + xs + ys)
            near = square <= limit - margin
            if earlier:
                allowed = ids[None, :] < own[at:at + STRIP, None]
                near &= allowed
            i, j = np.nonzero(np.abs(square - limit) < margin)
            near[i, j] = ((part[i] - y[j]) ** 2).sum(1) <= limit
            if earlier:
                near &= allowed
            place = near.argmax(1)
            first[at:at + STRIP] = np.where(near[np.arange(len(place)), place], place, -1)
        found = first >= 0
        return pd.DataFrame({"id": own[found], "first": ids[first[found]]})

    return run


def _first_near(points: DataFrame, others: DataFrame, radius: float, earlier: bool = False) -> DataFrame:
    """(id, first): for points with one of ``others`` of their bucket within the radius, the lowest id of those.

    With ``earlier`` only lower ids count. Both sides of a bucket are cut into
    blocks of bounded size; a pair of blocks is one task's matrix product, and a
    point leaves it with one number.
    """
    def blocks(side: DataFrame, name: str) -> DataFrame:
        counted = side.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
        return counted.select("bucket", F.ceil(F.col("_n") / SIDE).cast("int").alias(name))

    # new names, as both sides may be one table
    others = others.select(*[F.col(c).alias(c) for c in ("bucket", "id", "point")])
    shape = blocks(points, "_pn").join(blocks(others, "_on"), "bucket")
    p = points.join(shape, "bucket").select(
        "bucket", "id", "point", F.pmod(F.xxhash64("id"), F.col("_pn")).cast("int").alias("_pb"),
        F.explode(F.sequence(F.lit(0), F.col("_on") - 1)).alias("_ob"))
    o = others.join(shape, "bucket").select(
        "bucket", "id", "point", F.explode(F.sequence(F.lit(0), F.col("_pn") - 1)).alias("_pb"),
        F.pmod(F.xxhash64("id"), F.col("_on")).cast("int").alias("_ob"))
    group = ["bucket", "_pb", "_ob"]
    met = p.groupBy(*group).cogroup(o.groupBy(*group)).applyInPandas(_first_rows(radius, earlier), "id long, first long")
    return met.groupBy("id").agg(F.min("first").alias("first"))


def _large_buckets(live: DataFrame, radius: float) -> DataFrame:
    """The greedy pass for buckets beyond CHUNK points, (id, leader).

    The order of the pass is kept, but not its steps: existing leaders take what
    lies within the radius. Of the rest, all points without an undecided earlier
    neighbour become leaders at once, and their neighbours are decided too; the
    leaders are the lexicographically first independent set, which is what the
    pass one by one would choose. In the end each point joins its first leader.
    Rounds grow with the longest chain of neighbours by falling id, not with the
    number of points.
    """
    leaders = live.filter("is_leader").select("bucket", "id", "point")
    free = live.filter("NOT is_leader").select("bucket", "id", "point")
    taken = cut_lineage(_first_near(free, leaders, radius))
    open_points = cut_lineage(free.join(taken.select("id"), "id", "left_anti").select("bucket", "id", "point"))
    waiting, chosen = open_points, None
    while not waiting.isEmpty():
        blocked = cut_lineage(_first_near(waiting, waiting, radius, earlier=True).select("id"))
        roots = cut_lineage(waiting.join(blocked, "id", "left_anti").select("bucket", "id", "point"))
        later = waiting.join(blocked, "id", "left_semi").select("bucket", "id", "point")
        covered = cut_lineage(_first_near(later, roots, radius).select("id"))
        chosen = roots if chosen is None else cut_lineage(chosen.unionByName(roots))
        waiting = cut_lineage(later.join(covered, "id", "left_anti").select("bucket", "id", "point"))
    if chosen is not None:
        joined = _first_near(open_points.join(chosen.select("id"), "id", "left_anti").select("bucket", "id", "point"), chosen, radius)
        taken = taken.unionByName(joined)
    return taken.select("id", F.col("first").alias("leader"))


def leader_clusters(points: DataFrame, radius: float, family: LshFamily) -> DataFrame:
    """(id, leader) for every point of (id, point): LSH rounds of first-match leaders. A point may be given as the text of a k-mer.

    In each of ``family.tables`` rounds the points not yet taken are hashed; in
    every bucket, existing leaders first and then by id, a free point joins the
    first leader within the radius or becomes a candidate itself. Points that
    stay alone are their own leader. Copies of a point behave alike, so each
    distinct point is clustered once. A k-mer stays text in all that is shuffled
    or kept, a few bytes where its point has eight numbers a residue.
    """
    rounds = family.tables
    as_text = isinstance(points.schema["point"].dataType, T.StringType)
    tagged = points.select("id", F.col("point") if as_text else F.col("point").cast("array<double>").alias("point"))
    place: Column = kmer_point(F.col("point")) if as_text else F.col("point")
    state = cut_lineage(
        tagged.groupBy("point").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("_copies")).select(
            "id", "point", (F.col("_copies") > 1).alias("copied"),
            F.lit(False).alias("is_leader"), F.lit(None).cast("long").alias("leader"),
        )
    )
    for t in range(rounds):
        one = replace(family, tables=1, seed=family.seed + 1000 * t)
        live = state.filter("leader IS NULL").withColumn(
            "bucket", lsh_keys(place, one)["k0"]
        ).select("id", "point", "is_leader", "bucket")
        sizes = live.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        sized = live.join(sizes, "bucket")
        sized = cut_lineage(sized)
        small = sized.filter(F.col("_n") <= CHUNK).drop("_n")
        large = sized.filter(F.col("_n") > CHUNK).drop("_n")
        joined = _settle(small, radius)
        if not large.isEmpty():
            joined = joined.unionByName(_large_buckets(large, radius))
        joined = cut_lineage(joined)
        heads = joined.select(F.col("leader").alias("id")).distinct().withColumn("_head", F.lit(True))
        state = state.join(joined.withColumnRenamed("leader", "_joined"), "id", "left")
        state = state.join(heads, "id", "left").select(
            "id", "point", "copied",
            # a copy of a point no one took has joined it in this round
            (F.col("is_leader") | F.coalesce("_head", F.lit(False))
             | (F.col("copied") & F.coalesce("leader", "_joined").isNull())).alias("is_leader"),
            F.coalesce("leader", "_joined").alias("leader"),
        )
        state = cut_lineage(state)
    settled = state.select("point", F.coalesce("leader", "id").alias("leader"))
    return tagged.join(settled, "point").select("id", "leader")


def hierarchical_clusters(points: DataFrame, radius: float, family: LshFamily) -> DataFrame:
    """(id, cluster_id, radius): LSH rounds that merge clusters near their bucket's centre.

    Every round hashes the cluster centres. In each bucket the size-weighted
    centre is taken; clusters whose distance to it plus their own radius is at
    most half the radius merge, and the merged radius is measured from the
    members. All steps are aggregations combined before the shuffle.
    """
    dim = family.dim
    points = points.select("id", F.col("point").cast("array<double>").alias("point"))
    members = cut_lineage(points.select("id", F.col("id").alias("cluster_id")))
    clusters = cut_lineage(points.select(
        F.col("id").alias("cluster_id"), F.col("point").alias("center"),
        F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("radius"),
    ))
    for t in range(family.tables):
        one = replace(family, tables=1, seed=family.seed + 1000 * t)
        keyed = clusters.withColumn("bucket", lsh_keys(F.col("center"), one)["k0"])
        keyed = cut_lineage(keyed)
        # a bucket of one cluster has nothing to merge
        shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("bucket")
        middles = centroids(keyed, "bucket", dim, "center", "size").join(shared, "bucket", "left_semi").select(
            "bucket", F.col("center").alias("_middle")
        )
        near = keyed.join(middles, "bucket")
        near = near.filter(row_distance(F.col("center"), F.col("_middle")) + F.col("radius") <= radius / 2)
        near = cut_lineage(near.drop("_middle"))
        targets = near.groupBy("bucket").agg(
            F.min("cluster_id").alias("_target"), F.count(F.lit(1)).alias("_n")
        ).filter("_n > 1").drop("_n")
        moves = cut_lineage(near.join(targets, "bucket"))
        if moves.isEmpty():
            continue
        members = members.join(moves.select("cluster_id", "_target"), "cluster_id", "left").select("id", F.coalesce("_target", "cluster_id").alias("cluster_id"))
        members = cut_lineage(members)
        merged = centroids(moves, "_target", dim, "center", "size")
        merged = merged.withColumnRenamed("_target", "cluster_id")
        inside = members.join(merged.select("cluster_id", "center"), "cluster_id")
        inside = inside.join(points, "id")
        measured = inside.select("cluster_id", row_distance(F.col("point"), F.col("center")).alias("_d"))
        radii = measured.groupBy("cluster_id").agg(F.max("_d").alias("radius"))
        kept = clusters.join(moves.select("cluster_id"), "cluster_id", "left_anti")
        clusters = cut_lineage(kept.unionByName(merged.join(radii, "cluster_id")))
    return members.join(clusters.select("cluster_id", "radius"), "cluster_id")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the lowest id each node is connected to.

    Labels travel along edges and are then replaced by the label of the label,
    so long chains shrink quickly. Minima are combined before the shuffle and a
    hub's edges are split.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    ).filter("src <> dst").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        sent = join_split_hot(
            both, labels.select(F.col("id").alias("src"), "component"), ["src"], ["dst"]
        ).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("_seen"))
        nearer = labels.join(sent, "id", "left").select(
            "id", F.col("component").alias("_old"), F.least("component", "_seen").alias("component")
        )
        nearer = cut_lineage(nearer)
        jump = nearer.select(F.col("id").alias("component"), F.col("component").alias("_next"))
        moved = join_split_hot(nearer, jump, ["component"], ["id"], how="left").select(
            "id", "_old", F.least("component", "_next").alias("component")
        )
        moved = cut_lineage(moved)
        labels = moved.select("id", "component")
        if moved.filter("component <> _old").isEmpty():
            return labels


def cluster_listing(members: DataFrame, names: DataFrame) -> DataFrame:
    """(leader, size, name) with every cluster's size beside its members' names."""
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    return members.join(sizes, "leader").join(names, "id").select("leader", "size", "name")
