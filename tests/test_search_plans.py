"""How much the searches and clusterings compare, and that they stay exact."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua import constants as C
from residua.functions import hashing as H
from residua.functions.hashing import LshFamily
from residua.functions.vectors import kmer_point
from residua.operators import cluster as L, search as S

CELL = np.array(C.COORDINATE_DISTANCE_SQ)


def test_probe_template_sets():
    sets = H.probe_template(4, 40)
    assert sets[0] == [] and len({tuple(s) for s in sets}) == len(sets)
    assert all(len({min(r, 7 - r) for r in s}) == len(s) for s in sets)
    assert len(H.probe_template(2, 100)) == 9
    assert sets[1] == [0] and [1] in sets[:4] and [0, 1] in sets[:6]


def test_probe_keys_are_keys_of_neighbouring_buckets():
    family = H.LshFamily(dim=8, lines=3, tables=2, width=10.0)
    totals = np.random.default_rng(2).uniform(-40, 40, (30, 6))
    keys = H.probe_keys(totals, family, 27)
    near = {tuple(s) for s in np.stack(np.meshgrid(*[[-1, 0, 1]] * 3), -1).reshape(-1, 3)}
    for row in range(30):
        for t in range(2):
            own = np.floor(totals[row].reshape(2, 3)[t] / 10).astype(np.int64)
            want = {int(H._mix((own + np.array(s))[None, None, :])[0, 0]) for s in near}
            got = keys[row, t].tolist()
            assert set(got) == want and len(set(got)) == 27
            assert got[0] == int(H._mix(own[None, None, :])[0, 0])


def substituted(seed, n, k=10):
    """k-mers and copies of them with one or two close residues."""
    dice = random.Random(seed)
    near = [[j for j in range(20) if 0 < CELL[i][j] <= 25] for i in range(20)]
    centers, points = [], []
    while len(centers) < n:
        c = [dice.randrange(20) for _ in range(k)]
        o = list(c)
        for p in [p for p in range(k) if near[c[p]]][:dice.choice([1, 1, 2])]:
            o[p] = dice.choice(near[c[p]])
        if 0 < sum(CELL[a][b] for a, b in zip(c, o)) <= 25:
            centers.append("".join(C.RESIDUES[x] for x in c))
            points.append("".join(C.RESIDUES[x] for x in o))
    noise = ["".join(dice.choice(C.RESIDUES) for _ in range(k)) for _ in range(n)]
    return centers, points + noise


@pytest.mark.parametrize("small", [True, False])
def test_multi_probe_recall(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(S, "small_enough", lambda df, row_bytes=0: False)
    centers, points = substituted(4, 400)
    c, p = (spark.createDataFrame([(x,) for x in rows], "kmer string") for rows in (centers, points))
    exact = {(r.center, r.kmer): r.distance for r in S.kmer_radius_exact(c, p, 10, 5.0).collect()}
    rows = S.kmer_radius_lsh(c, p, 10, 5.0, H.LshFamily(80, 16, 2, 40.0), 24).collect()
    found = {(r.center, r.kmer): r.distance for r in rows}
    assert len(found) == len(rows) and found.keys() <= exact.keys() and len(exact) >= 400
    assert all(found[pair] == pytest.approx(exact[pair]) for pair in found)
    assert len(found) >= 0.95 * len(exact)
    single = S.kmer_radius_lsh(c, p, 10, 5.0, H.LshFamily(80, 16, 2, 40.0), 1).count()
    assert single < 0.6 * len(exact)


class Sent:
    def __init__(self, value):
        self.value = value


def test_pivot_cells_compare_few_pairs(monkeypatch):
    """Clustered points of 64 dimensions: under a tenth of all pairs is measured, and no hit is lost."""
    import pandas as pd

    dice = np.random.default_rng(9)
    middles = dice.normal(size=(60, 64)) * 10
    x = np.repeat(middles, 50, 0) + dice.normal(size=(3000, 64)) * 0.3
    y = np.repeat(middles, 20, 0) + dice.normal(size=(1200, 64)) * 0.3
    radius, pivots = 3.4, [x[0]]
    near = ((x - x[0]) ** 2).sum(1)
    while len(pivots) < 50:
        pivots.append(x[near.argmax()])
        near = np.minimum(near, ((x - pivots[-1]) ** 2).sum(1))
    pivots = Sent(np.array(pivots))
    placed = pd.concat(S._cell_of(pivots)([pd.DataFrame({"point_id": range(3000), "point": list(x)})]))
    spans = placed.groupby("_cell")["_far"].agg(["min", "max"]).reindex(range(50))
    reach = Sent((spans["min"].fillna(np.inf).to_numpy(), spans["max"].fillna(-1e300).to_numpy()))
    entered = pd.concat(S._cells_near(pivots, reach, radius)([pd.DataFrame({"center_id": range(1200), "center": list(y)})]))
    measured = []
    pairs = S._near_pairs
    monkeypatch.setattr(S, "_near_pairs", lambda a, b, r: (measured.append(len(a) * len(b)), pairs(a, b, r))[1])
    compare, found = S._block_hits(radius), set()
    for cell, own in placed.groupby("_cell"):
        hits = compare(own, entered[entered["_cell"] == cell])
        found |= set(zip(hits["center_id"].astype(int), hits["point_id"].astype(int)))
    square = (y * y).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * y @ x.T
    expected = set(zip(*(i.tolist() for i in np.nonzero(square <= radius * radius))))
    assert found == expected and len(expected) > 10_000
    assert sum(measured) < 0.1 * 3000 * 1200


def test_large_centre_sets_stay_exact(spark):
    dice = np.random.default_rng(10)
    x, y = dice.normal(size=(500, 5)), dice.normal(size=(300, 5))
    x[:80] = x[0]
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "point_id long, point array<double>")
    centers = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "center_id long, center array<double>")
    for radius in (0.0, 0.7, 2.5, 50.0):
        got = {(r.center_id, r.point_id) for r in S.radius_exact(centers, frame, 5, radius, sent_rows=10).collect()}
        square = ((y[:, None, :] - x[None, :, :]) ** 2).sum(2)
        assert got == set(zip(*(i.tolist() for i in np.nonzero(np.sqrt(square) <= radius))))
    assert S.radius_exact(centers, frame.limit(0), 5, 1.0, sent_rows=10).collect() == []


def test_hot_bucket_settles_in_few_rounds(spark, monkeypatch):
    """One bucket of all points equals the sequential pass, in rounds far fewer than its slices of CHUNK points."""
    monkeypatch.setattr(L, "SIDE", 300)
    calls = []
    inner = L._first_near
    monkeypatch.setattr(L, "_first_near", lambda *a, **kw: (calls.append(kw.get("earlier", False)), inner(*a, **kw))[1])
    dice = np.random.default_rng(3)
    x, radius = dice.normal(size=(1500, 3)), 0.45
    old = [5, 40, 900]
    rows = [(0, i, i in old, r.tolist()) for i, r in enumerate(x)]
    live = spark.createDataFrame(rows, "bucket long, id long, is_leader boolean, point array<double>")
    got = {r.id: r.leader for r in L._large_buckets(live, radius).collect()}
    centers, expected = list(old), {}
    for i in range(1500):
        if i in old:
            continue
        near = [c for c in centers if ((x[c] - x[i]) ** 2).sum() <= radius * radius]
        if near:
            expected[i] = near[0]
        else:
            centers.append(i)
    assert got == expected and len(centers) > 150
    # slices of 20 points would take 75 rounds
    assert sum(calls) <= 15


def test_kmers_are_clustered_as_text(spark, monkeypatch):
    """The clusters of k-mers given as text are those of their points, and no point is kept or shuffled between steps."""
    monkeypatch.setattr(L, "CHUNK", 20)
    dice = np.random.default_rng(5)
    cores = ["".join(dice.choice(list("ACDEFGHIKLMNPQRSTVWY"), 10)) for _ in range(12)]
    kmers = [c[:at] + dice.choice(list("ILVM")) + c[at + 1:] for c in cores for at in dice.integers(0, 10, 15)] + cores + cores[:3]
    texts = spark.createDataFrame([(i, str(k)) for i, k in enumerate(kmers)], "id long, point string")
    family = LshFamily(dim=80, lines=2, tables=2, width=60.0)
    slow = L.leader_clusters(texts.select("id", kmer_point(F.col("point")).alias("point")), 25.0, family)
    expected = sorted(map(tuple, slow.collect()))
    kept, inner = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: (kept.append(df.schema), inner(df))[1])
    got = L.leader_clusters(texts, 25.0, family)
    assert sorted(map(tuple, got.collect())) == expected and len({leader for _, leader in expected}) < 100
    assert kept and not any("array" in schema.simpleString() for schema in kept)
