import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua import constants as C
from residua.functions.hashing import KernelFamily, LshFamily, lsh_keys
from residua.operators import (
    cluster as L, evaluate as E, groups as G, kmers as K, layout, neighbours as N, search as S, sequences as SQ,
)


def random_seqs(n, low, high, seed, letters=C.RESIDUES):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]


def proteins(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "protein_id long, seq string")


def square(a, b):
    return sum(C.COORDINATE_DISTANCE_SQ[C.RESIDUES.index(x)][C.RESIDUES.index(y)] for x, y in zip(a, b))


def test_explode_kmers_over_pieces(spark):
    seqs = ["", "AC", "ACD", "ACDE"] + random_seqs(3, 2040, 4200, 1)
    rows = K.explode_kmers(proteins(spark, seqs), 3).collect()
    got = sorted((r.protein_id, r.pos, r.kmer) for r in rows)
    assert got == sorted((i, p, s[p:p + 3]) for i, s in enumerate(seqs) for p in range(len(s) - 2))


def test_counts_and_samples(spark):
    seqs = ["AAAAC", "CAAAA", "AC"]
    counted = {r.kmer: (r.n, r.protein_id, r.pos) for r in K.count_kmers(K.explode_kmers(proteins(spark, seqs), 3)).collect()}
    assert counted == {"AAA": (4, 0, 0), "AAC": (1, 0, 2), "CAA": (1, 1, 0)}
    once = K.drop_repeated(K.explode_kmers(proteins(spark, seqs), 3)).collect()
    assert sorted(r.kmer for r in once) == ["AAC", "CAA"]
    long = random_seqs(40, 50, 300, 2)
    sample = K.sample_kmers(proteins(spark, long), 10, first=30).collect()
    assert sample and all(r.pos % (30 + r.protein_id % 20) == 0 and r.protein_id < 30 for r in sample)
    numbered = K.number_in_order(proteins(spark, long).join(
        spark.createDataFrame([(r.protein_id, r.pos, r.kmer) for r in sample], "protein_id long, pos int, kmer string"),
        "protein_id"), "protein_id", "pos").collect()
    order = sorted((r.protein_id, r.pos) for r in sample)
    assert sorted((r.ordinal, (r.protein_id, r.pos)) for r in numbered) == list(enumerate(order))


def test_split_hot_keeps_the_join(spark):
    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(60).select(F.col("id").alias("k"), F.col("id").alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right.filter("v < 40"), "k", how)
        split = layout.join_split_hot(left, right.filter("v < 40"), ["k"], ["id"], how, share=0.01, min_rows=10)
        assert sorted(map(tuple, split.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    hot = layout.hot_keys(left, ["k"], ["id"], share=0.1, min_rows=10).collect()
    assert [r.k for r in hot] == [0]


def test_running_totals(spark):
    rng = random.Random(4)
    values = [(i, rng.randint(0, 9), rng.random()) for i in range(500)]
    df = spark.createDataFrame(values, "o long, v long, x double")
    df = df.withColumn("slice", layout.range_slices(df, "o", 7))
    assert df.select("slice").distinct().count() > 4
    got = sorted((r.o, r.s) for r in layout.running_total(df, "slice", ["o"], "v", "s").collect())
    assert got == list(enumerate(itertools.accumulate(v for _, v, _ in values)))
    got = sorted((r.o, r.s) for r in layout.running_total(df, "slice", ["o"], "x", "s", "max").collect())
    assert got == list(enumerate(itertools.accumulate((x for *_, x in values), max)))


@pytest.mark.parametrize("k,radius", [(6, 3.0), (6, 5.0), (6, 12.0), (6, 30.0), (5, 60.0), (3, 0.0)])
def test_kmer_radius_exact_is_complete(spark, monkeypatch, k, radius):
    monkeypatch.setattr(S, "NEIGHBOURS", 40)
    if radius in (5.0, 12.0):
        monkeypatch.setattr(S, "small_enough", lambda df, row_bytes=0: False)
    letters = "ILVMKR" if radius < 10 else C.RESIDUES
    centers, points = random_seqs(25, k, k, 5, letters), random_seqs(300, k, k, 6, letters)
    points += centers[:5]
    found = S.kmer_radius_exact(spark.createDataFrame([(c,) for c in centers], "kmer string"),
                                spark.createDataFrame([(p,) for p in points], "kmer string"), k, radius)
    rows = found.collect()
    expected = {(c, p) for c in centers for p in points if square(c, p) <= radius * radius}
    assert len(rows) == len(expected) and {(r.center, r.kmer) for r in rows} == expected
    assert all(r.distance**2 == pytest.approx(square(r.center, r.kmer), abs=1e-6) for r in rows)


@pytest.mark.parametrize("small", [True, False])
def test_kmer_radius_lsh_is_a_subset(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(S, "small_enough", lambda df, row_bytes=0: False)
    centers, points = random_seqs(40, 6, 6, 7, "ILVMK"), random_seqs(400, 6, 6, 8, "ILVMK")
    c = spark.createDataFrame([(x,) for x in centers], "kmer string")
    p = spark.createDataFrame([(x,) for x in points], "kmer string")
    exact = {(r.center, r.kmer): r.distance for r in S.kmer_radius_exact(c, p, 6, 9.0).collect()}
    few = S.kmer_radius_lsh(c, p, 6, 9.0, LshFamily(48, 4, 3, 20.0)).collect()
    assert len(few) == len({(r.center, r.kmer) for r in few})
    assert all(exact[r.center, r.kmer] == pytest.approx(r.distance) for r in few)
    assert 0 < len(few) < len(exact)
    many = S.kmer_radius_lsh(c, p, 6, 9.0, LshFamily(48, 1, 8, 500.0)).count()
    assert many == len(exact)


def vectors(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "point_id long, point array<double>")


def test_radius_exact_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(300, 6)), rng.normal(size=(70, 6))
    c = vectors(spark, y).select(F.col("point_id").alias("center_id"), F.col("point").alias("center"))
    for radius in (0.8, 2.0, 10.0):
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        got = S.radius_exact(c, vectors(spark, x), 6, radius).collect()
        assert sorted((r.point_id, r.center_id) for r in got) == sorted(zip(*map(list, np.nonzero(d <= radius))))
    hits = S.radius_exact(c, vectors(spark, x), 6, 3.0)
    best = {r.point_id: r.center_id for r in S.nearest_center(hits).collect()}
    assert best == {i: int(d[i].argmin()) for i in range(300) if d[i].min() <= 3.0}
    pairs = S.pairs_within(vectors(spark, y), 6, 1.5).collect()
    dy = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
    assert len(pairs) == (np.triu(dy <= 1.5, 1)).sum()


def test_radius_plans_have_no_cross_join(spark):
    x = vectors(spark, np.random.default_rng(1).normal(size=(20, 4)))
    c = x.select(F.col("point_id").alias("center_id"), F.col("point").alias("center"))
    kmers = spark.createDataFrame([(k,) for k in random_seqs(20, 5, 5, 3)], "kmer string")
    frames = [S.radius_exact(c, x, 4, 1.0), S.radius_lsh(c, x, 1.0, LshFamily(4)),
              S.kmer_radius_exact(kmers, kmers, 5, 4.0), S.kmer_radius_lsh(kmers, kmers, 5, 4.0, LshFamily(40))]
    for f in frames:
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def leaders_slowly(x, radius, family, keys):
    leader, is_leader = [None] * len(x), [False] * len(x)
    for t in range(family.tables):
        buckets = {}
        for i in range(len(x)):
            if leader[i] is None:
                buckets.setdefault(keys[t][i], []).append(i)
        for ids in buckets.values():
            centers = [i for i in ids if is_leader[i]]
            for i in ids:
                if is_leader[i]:
                    continue
                for c in centers:
                    if np.sqrt(((x[i] - x[c]) ** 2).sum()) <= radius:
                        leader[i], is_leader[c] = c, True
                        break
                else:
                    centers.append(i)
    return [i if v is None else v for i, v in enumerate(leader)]


@pytest.mark.parametrize("chunk", [2000, 7])
def test_leader_clusters_match_the_sequential_pass(spark, monkeypatch, chunk):
    from dataclasses import replace

    monkeypatch.setattr(L, "CHUNK", chunk)
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(90, 3)), 3)
    x[60:75] = x[10]
    x[80] = x[81]
    family, radius = LshFamily(3, 1, 3, 2.5), 0.8
    keys = []
    for t in range(3):
        one = replace(family, tables=1, seed=family.seed + 1000 * t)
        rows = vectors(spark, x).select("point_id", lsh_keys(F.col("point"), one)["k0"].alias("k")).collect()
        keys.append([r.k for r in sorted(rows, key=lambda r: r.point_id)])
    got = L.leader_clusters(vectors(spark, x).withColumnRenamed("point_id", "id"), radius, family).collect()
    assert [r.leader for r in sorted(got, key=lambda r: r.id)] == leaders_slowly(x, radius, family, keys)


def test_hierarchical_clusters(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(scale=0.2, size=(30, 4)) + 5 * i for i in range(3)])
    radius = 4.0
    points = vectors(spark, x).withColumnRenamed("point_id", "id")
    got = L.hierarchical_clusters(points, radius, LshFamily(4, 2, 3, 8.0)).collect()
    assert sorted(r.id for r in got) == list(range(90))
    groups = {}
    for r in got:
        groups.setdefault(r.cluster_id, []).append(r)
    assert 3 <= len(groups) < 60
    for cid, rows in groups.items():
        members = x[[r.id for r in rows]]
        spread = np.sqrt(((members - members.mean(axis=0)) ** 2).sum(axis=1)).max()
        assert rows[0].radius == pytest.approx(spread, abs=1e-9) and spread <= radius
        assert cid == min(r.id for r in rows) and len({r.id // 30 for r in rows}) == 1


def test_components(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 141), (200, 201)]
    nodes = sorted({n for e in edges for n in e} | {999})
    got = L.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "id long"))
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.id: r.component for r in got.collect()} == root


def test_groups(spark):
    x = np.random.default_rng(2).normal(size=(40, 4))
    df = vectors(spark, x).withColumn("g", F.col("point_id") % 3)
    for r in G.centroids(df, "g", 4).collect():
        assert np.allclose(r.center, x[r.g::3].mean(axis=0)) and r.size == len(x[r.g::3])
    for r in G.mean_pair_distance_sq(df, "g", 4).collect():
        m = x[r.g::3]
        d = [((a - b) ** 2).sum() for a, b in itertools.combinations(m, 2)]
        assert r.mean_sq == pytest.approx(np.mean(d))
    m = spark.createDataFrame([("a", "AC"), ("a", "AD"), ("b", "WW")], "motif string, kmer string")
    w = {(r.motif, r.pos): r for r in G.weight_matrix(m).collect()}
    assert (w["a", 0].A, w["a", 1].C, w["a", 1].D, w["b", 1].W, w["b", 1].A) == (1, 0.5, 0.5, 1, 0)


def test_pre_groups_put_copies_together(spark):
    seqs = random_seqs(30, 50, 90, 13)
    seqs += seqs[:10] + ["AC"]
    got = {r.protein_id: r.bucket for r in G.pre_groups(proteins(spark, seqs), KernelFamily()).collect()}
    assert 40 not in got and all(got[i] == got[30 + i] for i in range(10)) and len(set(got.values())) > 3


def test_best_neighbours(spark):
    seeds = ["WCA", "IKL"]
    everything = ["".join(t) for t in itertools.product(sorted(C.RESIDUES), repeat=3)]
    df = spark.createDataFrame([(s,) for s in seeds], "kmer string")
    for by, table, sign in (("similarity", C.BLOSUM62, -1), ("distance", C.BLOSUM_DISTANCE, 1)):
        rows = N.best_neighbours(df, 200, by).collect()
        for s in seeds:
            score = {t: sum(table[C.RESIDUES.index(a)][C.RESIDUES.index(b)] for a, b in zip(s, t)) for t in everything}
            best = sorted(everything, key=lambda t: (sign * score[t], t))[:200]
            mine = sorted((r for r in rows if r.kmer == s), key=lambda r: r.place)
            assert [(r.neighbour, r.score) for r in mine] == [(t, score[t]) for t in best]


def test_evaluation(spark):
    truth = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 30.0), ("n", "c", 26.0)], "motif string, protein string, distance double")
    found = spark.createDataFrame([("m", "a", 1.0), ("n", "c", 26.0), ("n", "z", 2.0)], "motif string, protein string, distance double")
    matched = E.match_truth(truth, found)
    r = E.weighted_recall(matched, 40).first()
    assert (r.tp, r.n_missed, r.n_truth) == (1.5, 1, 3) and r.fn == pytest.approx(1 / 6)
    assert {(b.bin, b.tp, b.fn) for b in E.recall_by_bin(matched).collect()} == {(10, 1, 0), (300, 0, 1), (260, 1, 0)}
    c = E.count_ratio(truth, found).first()
    assert (c.n_truth, c.n_found, c.n_both, c.ratio) == (3, 3, 2, 1.0)


def test_pvalues(spark):
    rng = random.Random(6)
    p = [round(rng.random() ** 3, 2) for _ in range(400)] + [0.5] * 200
    df = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    counts = sorted({v: p.count(v) for v in p}.items())
    adjusted, seen, top = {}, 0, 0.0
    for v, n in counts:
        seen += n
        top = max(top, v * (len(p) / seen))
        adjusted[v] = top
    got = SQ.adjust_pvalues(df).collect()
    assert len(got) == len(p) and all(r.adjusted == pytest.approx(adjusted[r.p]) for r in got)
    for alpha in (0.01, 0.05, 0.3, 1.0):
        s, i = sorted(p), 0
        while i < len(s) - 1 and s[i + 1] < alpha * (i + 1) / len(s):
            i += 1
        assert SQ.fdr_cutoff(df, alpha).first().cutoff == s[i]
    assert SQ.fdr_cutoff(df, 0).first().cutoff > 1e308


def test_frames_and_suffixes(spark):
    dna = spark.createDataFrame([("d", "ATGAAAGTTGGGCCCTTTAAACCC" * 2), ("n", "ACGT")], "name string, seq string")
    frames = {r.frame: r.aa for r in SQ.six_frames(dna).collect()}
    back = dna.select("name", F.reverse(F.translate("seq", "ACGT", "TGCA")).alias("seq"))
    swapped = {r.frame: r.aa for r in SQ.six_frames(back).collect()}
    assert frames and frames == {(f + 3) % 6: a for f, a in swapped.items()}
    assert sorted(r.orf_idx for r in SQ.number_frames(SQ.six_frames(dna)).collect()) == list(range(len(frames)))
    seqs = ["BANANA".replace("B", "C"), "ANA"] + random_seqs(2, 300, 700, 8, "AC")
    rows = SQ.suffix_order(proteins(spark, seqs), depth=50).collect()
    expected = sorted((s[p:p + 50], i, p) for i, s in enumerate(seqs) for p in range(len(s)))
    assert [(r.suffix, r.protein_id, r.pos) for r in rows] == expected


def test_sampling(spark):
    a = [r.kmer for r in SQ.random_kmers(spark, 500, 4, 1).orderBy("id").collect()]
    assert a == [r.kmer for r in SQ.random_kmers(spark, 500, 4, 1).orderBy("id").collect()]
    assert set("".join(a)) == set(C.RESIDUES)
    members = spark.range(300).select(F.col("id").alias("member_idx"), (F.col("id") % 5).cast("string").alias("motif"))
    assert SQ.truncate_motifs(members, 3, 10).groupBy("motif").count().collect().__len__() == 3
    mixed = [r.member_idx for r in SQ.shuffled(members, 3, "member_idx").collect()]
    assert sorted(mixed) == list(range(300)) and mixed != sorted(mixed)
    assert 10 < SQ.one_in(members, 10, "member_idx").count() < 60
    spans = spark.createDataFrame([(0, 40000, "a"), (40000, 5, "b"), (40005, 100000, "c")], "start long, length long, owner string")
    at = spark.createDataFrame([(0,), (39999,), (40000,), (40004,), (40005,), (140004,), (140005,)], "pos long")
    got = {r.pos: r.owner for r in S.owner_of_position(at, spans).collect()}
    assert got == {0: "a", 39999: "a", 40000: "b", 40004: "b", 40005: "c", 140004: "c"}


def test_block_plans_are_instant_and_never_single_letters():
    start = time.perf_counter()
    for k, radius in ((25, 24.0), (25, 49.38), (10, 5.0), (10, 30.0)):
        blocks = S._choose_blocks(k, radius * radius)
        assert sum(n for _, n in blocks) == k and max(n for _, n in blocks) > 1
    assert time.perf_counter() - start < 2
    # counts on the grid are never below the exact ones
    exact = np.sort(np.array(C.COORDINATE_DISTANCE_SQ).ravel())
    found = S._expected_neighbours(1, 100.0)[1]
    assert found[-1] >= (exact <= 100.0 * (1 - 1 / S._GRID)).sum() / 20 - 1e-9


def test_small_centre_sets_are_sent_and_agree_with_cells(spark):
    dice = np.random.default_rng(12)
    x, y = dice.normal(size=(300, 6)), dice.normal(size=(40, 6))
    points, centers = vectors(spark, x), vectors(spark, y).select(F.col("point_id").alias("center_id"), F.col("point").alias("center"))
    rows = lambda frame: sorted((r.center_id, r.point_id, round(r.distance, 9)) for r in frame.collect())
    sent, cells = S.radius_exact(centers, points, 6, 2.0), S.radius_exact(centers, points, 6, 2.0, sent_rows=10)
    assert rows(sent) == rows(cells) and rows(sent)
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_get_salts_by_size(spark):
    left = spark.range(60_000).select(F.lit(1).alias("k"), "id").unionByName(spark.range(100).select((F.col("id") + 2).cast("int").alias("k"), "id"))
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    salted, repeated = layout.split_hot(left, right, ["k"], ["id"], salt_rows=1000)
    assert repeated.filter("k = 1").count() > 40 and repeated.filter("k = 2").count() == 1
    assert salted.join(repeated, ["k", "_salt"]).count() == left.join(right, "k").count()


def test_peptides_in_order(spark):
    rows = [(2, "MK"), (1, "MK"), (3, "AC"), (4, "")]
    assert [r.protein_id for r in SQ.sort_peptides(spark.createDataFrame(rows, "protein_id long, seq string")).collect()] == [4, 3, 1, 2]


def test_neighbour_lists_share_segments(spark):
    rng = random.Random(14)
    seeds = ["".join(rng.choice(C.RESIDUES) for _ in range(k)) for k in (1, 2, 5, 6, 6, 10, 10, 13)]
    seeds += [seeds[5][:5] + seeds[6][5:], "", seeds[3]]
    df = spark.createDataFrame([(s,) for s in seeds], "kmer string")
    for by in ("similarity", "distance"):
        sign, table = N._costs(by)
        rows = N.best_neighbours(df, 300, by).collect()
        for seed in set(seeds) - {""}:
            costs, texts = N._fold(table, np.array([C.RESIDUES.index(c) for c in seed]), 300)
            mine = sorted((r for r in rows if r.kmer == seed), key=lambda r: r.place)
            assert [(r.neighbour, r.score) for r in mine] == [(str(t), sign * int(c)) for t, c in zip(texts, costs)]


def test_neighbour_overlaps_equal_joined_lists(spark):
    rng = random.Random(15)
    seeds = ["".join(rng.choice(C.RESIDUES) for _ in range(6)) for _ in range(25)]
    df = spark.createDataFrame([(s,) for s in seeds], "kmer string")
    tops = [1, 5, 100, 1000]
    got = {r.top: (r.n_seeds, r.overlap) for r in N.neighbour_overlaps(df, tops).collect()}
    joined = N.top_overlap(N.best_neighbours(df, 1000), N.best_neighbours(df, 1000, "distance"), tops).collect()
    assert set(got) == set(tops) and all(got[r.top] == (r.n_seeds, pytest.approx(r.overlap)) for r in joined)
