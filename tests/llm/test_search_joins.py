"""The similarity join, the ranked search and the negative mining against brute force, edges and bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.llm import jaccard, negatives, ranking


def sets_slowly(rows, size=3):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in w]
        out.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def joined_slowly(rows, percent=90):
    sets = sets_slowly(rows)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(doc, least.get(g, doc))
    return sorted(((d, len(s), least.get(g)) for (d, _), s, g in zip(rows, sets, group)), key=repr)


def families(seed, n=160):
    """Texts of many lengths with copies, copies with a few words changed, and chains of such."""
    dice = random.Random(seed)
    word = lambda: f"w{dice.randrange(4000)}"
    rows = []
    for i in range(n):
        if rows and dice.random() < 0.6:
            words = dice.choice(rows)[1].split()
            for _ in range(dice.choice([0, 1, 1, 2, 3, 6])):
                if words:
                    words[dice.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(dice.choice([1, 2, 3, 4, 8, 11, 12, 13, 20, 60, 61, 100, 200, 400]))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.similarity_components(docs, tile=16).collect()), key=repr)
    assert got == joined_slowly(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_join_takes_edges(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = sorted(map(tuple, jaccard.similarity_components(edge_docs).collect()), key=repr)
    assert got == joined_slowly(rows)
    assert jaccard.similarity_components(edge_docs.limit(0)).collect() == []


def test_linked_sets_share_a_cell_and_pass_the_bitmap():
    dice = np.random.default_rng(5)
    lows = jaccard.bands()
    for n in [9, 10, 12, 19, 40, 57, 130, 500, 2100, 30_000]:
        whole = np.unique(dice.integers(0, 2**63, 2 * n, np.uint64))[:n]
        for _ in range(20):
            lost = int(dice.integers(0, n // 19 + 1))
            more = jaccard.most_apart(2 * n - lost) - lost
            other = np.unique(np.concatenate([dice.choice(whole, n - lost, replace=False),
                                              dice.integers(0, 2**63, max(0, min(more, lost)), np.uint64)]))
            shared = len(np.intersect1d(whole, other))
            if 100 * shared < 90 * (len(whole) + len(other) - shared):
                continue
            if not np.array_equal(whole, other):
                assert set(jaccard.set_cells(whole, lows)) & set(jaccard.set_cells(other, lows))
            maps = [jaccard.bitmap(v) for v in (whole, other)]
            words = min(map(len, maps)) // 8
            apart = int(np.bitwise_count(jaccard._folded(maps[0], words) ^ jaccard._folded(maps[1], words)).sum())
            assert apart <= len(whole) + len(other) - 2 * shared


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_slowly(docs, items, top=10):
    terms = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in TERM.findall(t or "")]
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                    for w in set(terms(text)) if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket, query_bytes", [(7, 1 << 20), (4096, 300)])
def test_ranking_equals_brute_force(spark, bucket, query_bytes):
    dice = random.Random(3)
    word = lambda: f"t{int(dice.paretovariate(0.6))}"
    docs = [(i, " ".join(word() for _ in range(dice.choice([0, 1, 5, 30, 200])))) for i in range(300)]
    docs += [(5, docs[7][1]), (None, docs[9][1]), (None, None), (301, "Tie tie"), (300, "tie TIE")]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(25)]
    items += [(3, items[3][1]), (3, "tie"), (None, "t1 t2"), (90, None), (91, ""), (92, "nowhere at all")]
    got = ranking.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                         spark.createDataFrame(items, "item_id long, text string"), bucket=bucket, query_bytes=query_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_slowly(docs, items)


def test_ranking_takes_edges(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    asked = edge_docs.select(F.concat(F.lit("q"), "doc_id").alias("item_id"), "text", F.lit(1).alias("score"), F.lit(2).alias("rank"))
    items = [(r.item_id, r.text) for r in asked.collect()]
    got = ranking.search(edge_docs, asked)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked_slowly(rows, items)
    assert ranking.search(edge_docs.limit(0), asked).collect() == []
    assert ranking.search(edge_docs, asked.limit(0)).collect() == []


def test_buckets_are_pruned():
    dice = np.random.default_rng(1)
    rows = np.repeat(np.arange(500), 4)
    terms = np.concatenate([dice.choice(50, 4, replace=False) for _ in range(500)])
    import pyarrow as pa
    part = ranking.Bucket(pa.array(range(500)), rows, terms, dice.integers(1, 1000, 2000))
    asked, weights = np.arange(10), np.arange(10, 0, -1)
    full = np.zeros(500, np.int64)
    for t, w in zip(asked, weights):
        np.add.at(full, part.rows[part.terms == t], w * part.impacts[part.terms == t])
    for least in (1, 2000, int(np.sort(full)[-5]), 10**9):
        found, scores = part.search(asked, weights, least)
        assert found.tolist() == np.flatnonzero(full >= least).tolist() and (scores == full[found]).all()


def mined_slowly(rows, anchors, positives=5, negatives=10):
    good = [(i, v, x) for i, x, v in rows if i is not None and v is not None and x is not None
            and all(c is not None and math.isfinite(c) for c in x)]
    good = [(i, v, [math.floor(256 * c) for c in x]) for i, v, x in good]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, v, x in {(i, v, tuple(x)) for i, v, x in good if anchors(i)}:
        scored = sorted((-dot(x, y), j, w) for j, w, y in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == v][:positives]:
            fits = [r for r in scored if r[2] != v and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(fits)]
    return sorted(out)


def mined(frame, **kw):
    return sorted(map(tuple, negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, **kw).collect()))


def test_mining_equals_brute_force(spark):
    dice = np.random.default_rng(8)
    centers = dice.normal(size=(6, 9))
    rows = [(i, (centers[i % 6] + dice.normal(size=9) * 0.5).tolist(), int(dice.integers(0, 3))) for i in range(600)]
    rows += [(600 + i, rows[0][1], i % 3) for i in range(60)]
    names = "vec_id long, embedding array<double>, label int"
    for block, words in ((20_000, 8), (9, 4)):
        assert mined(spark.createDataFrame(rows, names), block=block, codewords=words) == mined_slowly(rows, lambda i: i % 10 == 0)


def test_mining_takes_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 1.0], 2), (3, None, 1), (4, [1.0, None], 1),
            (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0, 2.0], None), (None, [1.0, 2.0], 2), (8, [1.0], 2), (9, [], 2),
            (10, [-1.0, -1.0], 2), (12, [0.9, 0.8], 2), (11, [0.9, 0.8], 2), (11, [0.9, 0.8], 2), (20, [3e9, 1e9], 7), (21, [2e9, 1.0], 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit(1)).withColumn("query", F.lit("x"))
    assert mined(frame) == mined_slowly(rows, lambda i: i % 10 == 0)
    assert mined(frame.limit(0)) == [] and mined(frame.filter("vec_id = 9")) == []


def test_cells_come_by_falling_bounds_that_hold():
    dice = np.random.default_rng(4)
    vectors = dice.integers(-200, 200, (700, 10))
    books = [negatives.codebook(h, 6) for h in (vectors[:, :5], vectors[:, 5:])]
    index = negatives.MultiIndex(np.arange(700), np.zeros(700, np.int64), vectors, books)
    anchor = dice.integers(-200, 200, 10)
    last, seen = math.inf, 0
    for upper, lower, a, b in index.cells(anchor):
        scores = index.vectors[a:b] @ anchor
        assert upper <= last and scores.max() <= upper and scores.min() >= lower
        last, seen = upper, seen + b - a
    assert seen == 700


def test_most_cells_stay_unvisited_in_clustered_data(monkeypatch):
    dice = np.random.default_rng(6)
    centers = dice.normal(size=(30, 16)) * 300
    vectors = (np.repeat(centers, 200, 0) + dice.normal(size=(6000, 16)) * 10).astype(np.int64)
    books = [negatives.codebook(h, 16) for h in (vectors[:, :8], vectors[:, 8:])]
    index = negatives.MultiIndex(np.arange(6000), np.zeros(6000, np.int64), vectors, books)
    visited = []
    cells = negatives.MultiIndex.cells

    def watched(self, anchor):
        for cell in cells(self, anchor):
            visited.append(cell[3] - cell[2])
            yield cell

    monkeypatch.setattr(negatives.MultiIndex, "cells", watched)
    none = -(1 << 62)
    for anchor in range(0, 6000, 500):
        index.search(anchor, 0, vectors[anchor], True, [(none, -none, none)], 5)
    assert sum(visited) < 12 * 6000 / 3
