"""k-mers counted, scored and linked where they are read, against plain loops."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua import constants as C
from residua.functions import alphabet as A
from residua.operators import groups as G, kmers as K, packed as P, search as S
from residua.operators.layout import by_key
from residua.plans.catalog import QUERIES

TEXTS = [(1, "ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWY"), (2, "MKVLAAGIVACDEFGHIKLMNPW"), (3, "AC"), (4, ""), (5, None),
         (None, "MKVLAAGIVWWWWWWWWWWWWWWWWWWWW"), (1, "MKVLAAGIVKKKKKKKKKKKKK")]


@pytest.fixture
def seqs(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)  # sequences of several blocks
    return spark.createDataFrame(TEXTS, "protein_id long, seq string")


def windows(k):
    return [(i, at, t[at:at + k]) for i, t in TEXTS if t for at in range(len(t) - k + 1)]


def exchanges(frame):
    """The keys that rows are shuffled by."""
    return [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_distinct_counts(seqs):
    n = Counter(w for _, _, w in windows(10))
    assert tuple(P.distinct_counts(seqs, 10).first()) == (len(n), sum(c == 1 for c in n.values()))
    # one number for each k-mer of a block is all that is shuffled
    assert all("seq" not in line for line in exchanges(P.distinct_counts(seqs, 10)))


def test_single_kmers(seqs):
    n = Counter(w for _, _, w in windows(10))
    want = [(i, at, w) for i, at, w in windows(10) if n[w] == 1]
    assert sorted(map(tuple, P.single_kmers(seqs, 10).collect()), key=repr) == sorted(want, key=repr)


def test_letter_matrix(seqs):
    named = seqs.withColumn("motif", F.when(F.col("protein_id") == 2, F.lit(None)).otherwise(F.lit("x")))
    cells = Counter((None if i == 2 else "x", j, a) for i, _, w in windows(8) for j, a in enumerate(w))
    rows = P.letter_matrix(named, 8, "motif").collect()
    assert len(rows) == 16
    for row in rows:
        total = sum(cells[row.motif, row.pos, a] for a in C.RESIDUES)
        assert all(row[a] == pytest.approx(cells[row.motif, row.pos, a] / total) for a in C.MOTIF_LETTERS)


def score(table, a, b):
    return sum(int(table[C.RESIDUES.index(x)][C.RESIDUES.index(y)]) for x, y in zip(a, b))


def test_half_scores(seqs):
    want = {}
    for i, _, w in windows(20):
        want.setdefault(i, []).append((score(C.BLOSUM62, w[:10], w[10:]), score(C.BLOSUM_DISTANCE, w[:10], w[10:])))
    rows = P.half_scores(seqs, 10, C.BLOSUM62, C.BLOSUM_DISTANCE).collect()
    assert {tuple(r) for r in rows} == {
        (i, len(v), sum(s for s, _ in v), sum(d for _, d in v), max(s for s, _ in v), min(d for _, d in v)) for i, v in want.items()}


def test_prefix_correlation(seqs):
    for row in P.prefix_correlation(seqs, 10, (2, 10), C.BLOSUM62, C.BLOSUM_DISTANCE).collect():
        pairs = [(score(C.BLOSUM62, w[:row.k], w[10:]), score(C.BLOSUM_DISTANCE, w[:row.k], w[10:])) for _, _, w in windows(20)]
        assert row.n == len(pairs) and row.correlation == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1])


def test_shared_links(spark, seqs):
    long = "MKVLAAGIVWYRNDCQEGHILKMFPSTWYV"
    rows = [(i, seq) for i, seq in enumerate([long, "AA" + long, long[3:28], long[:24], "CCC" + long[5:], "W" * 40, "W" * 30, None])]
    links = P.shared_links(spark.createDataFrame(rows, "protein_id long, seq string"), 25)
    root = list(range(len(rows)))
    for a, b in links.collect():
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert root == [0, 0, 0, 3, 0, 5, 5, 7]


def test_counted_kmers_keep_the_first_place_without_sorting(seqs):
    found = K.count_kmers(K.explode_kmers(seqs, 4))
    n, first = Counter(w for _, _, w in windows(4)), {}
    for i, at, w in windows(4):
        first[w] = min(first.get(w, (2**63, 0)), (-(2**63) if i is None else i, at))
    want = {(w, n[w], None if i == -(2**63) else i, at) for w, (i, at) in first.items()}
    assert {tuple(r) for r in found.collect()} == want
    assert found.schema["protein_id"].dataType == seqs.schema["protein_id"].dataType
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_named_points_read_the_sample_once(seqs):
    known = seqs.filter("protein_id IS NOT NULL")
    names = known.select("protein_id", F.lit("n").alias("name")).distinct()
    sample = K.sample_kmers(known, 5, steps=1)
    named = K.named_points(sample, names)
    assert sorted(r.name for r in named.collect()) == sorted(
        f"n#{r.protein_id}${r.pos}@{r.kmer}*{i}" for i, r in enumerate(sample.orderBy("protein_id", "pos").collect()))
    assert "substring(seq" not in named._jdf.queryExecution().optimizedPlan().toString()


def test_cleaned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "_BLOCK", 8)
    texts = ["Box of jazz", None, "", "été-Ünïcode z", "12 3", "oooooooooooooooooooooooo", "ABC\nxyz"]
    want = [t if t is None else "".join(
        C.RESIDUES[(ord(c) + i) % 20] if c in C.NON_RESIDUES else c
        for i, c in enumerate(c.upper() for c in t if c.isascii() and c.isalpha())) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert [r.s for r in rows.select("i", A.clean_residues(F.col("t")).alias("s")).orderBy("i").collect()] == want


@pytest.mark.parametrize("name", ["karlin_statistics", "sum_statistics"])
def test_lengths_are_read_once(spark, tmp_path, name):
    rows = spark.createDataFrame([(i, "ACDEFGHIKL" * (10 + i)) for i in range(30)], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert "text" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0


def test_feature_counts(seqs):
    code = dict(zip(C.RESIDUES, map(int, C.group_codes("octet"))))
    want = Counter((i, sum(code[a] << 3 * j for j, a in enumerate(t[at:at + 3])))
                   for i, t in TEXTS if i not in (1, None) for at in range(len(t or "") - 2))
    rows = G.feature_counts(seqs.filter("protein_id <> 1")).collect()
    assert {(r.protein_id, r.code): r.n for r in rows} == dict(want) and len(rows) == len(want)


def test_located_hits_without_a_join_back(seqs):
    kmers = K.explode_kmers(seqs, 4)
    centers = kmers.filter("protein_id = 2").select("kmer")
    found = S.kmer_radius_exact(centers, kmers, 4, 6.0, located=True)
    # the centres' own copies are dropped by a shuffle, windows are not shuffled
    assert sum("hashpartitioning(kmer" in line for line in exchanges(found)) == 1
    want = S.locate_hits(S.kmer_radius_exact(centers, kmers, 4, 6.0), kmers).select(*found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() > 20


def test_windows_stay_with_their_sequence(spark, seqs):
    found = K.explode_kmers(by_key(seqs, "protein_id", 2), 3).groupBy("kmer", "protein_id").count()
    assert len(exchanges(found)) == 1 and "hashpartitioning(protein_id" in exchanges(found)[0]
    assert {tuple(r) for r in found.collect()} == {(w, i, n) for (i, w), n in Counter((i, w) for i, _, w in windows(3)).items()}


@pytest.mark.parametrize("name", ["kmer_positions", "kmer_lateral"])
def test_no_shuffle_by_kmer_and_id(spark, tmp_path, name):
    rows = spark.createDataFrame([(i % 40, "ACDEFGHIKL" * 3) for i in range(100)], "doc_id long, text string")
    # as many files as a large table has, so that the scan is not spread
    rows.repartition(40).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5m")
    try:
        found = QUERIES[name](spark, str(tmp_path))
        assert not any("hashpartitioning(kmer" in line and "protein_id" in line or "hashpartitioning(protein_id" in line and "kmer" in line
                       for line in exchanges(found))
        assert {r.n_proteins for r in found.collect()} == {40}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def packed_runs(rows, k, parts):
    """(batch of runs, windows sent) of all windows of the sequences, each text as a block of its own letters."""
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "seq": [s for _, s in rows]})
    for _, letters, first, row, pos in P.window_blocks(iter([batch]), k):
        yield P._packed_runs(letters, first, row, pos, pos.astype(np.int32) % 7 // 6, k, parts, batch.column("id")), len(first)


def test_runs_hold_every_window_once(monkeypatch):
    dice = np.random.default_rng(3)
    rows = [(i, "".join(dice.choice(list(C.RESIDUES), n))) for i, n in ((7, 900), (None, 9), (None, 400), (8, 10), (9, 900))] + [(5, "A" * 60)]
    monkeypatch.setattr(P, "PASS_WINDOWS", 300)
    monkeypatch.setattr(P, "BLOCK", 500)
    sent = list(packed_runs(rows + rows[:1], 10, 4))
    found, met = [], []
    for part in range(4):
        own = [b.filter(pa.array([x == part for x in b.column("part").to_pylist()])) for b, _ in sent]
        runs = P._Runs(iter(own), 10)
        for n, (numbers, text, pos, mark) in enumerate(runs.passes([(0, 4), (4, 6)])):
            kmers = [a + b for a, b in zip(*(P._texts(pa.array(x), pa.array([size])).to_pylist() for x, size in zip(numbers, (4, 6))))]
            found += zip(runs.ids.take(pa.array(text)).to_pylist(), pos.tolist(), kmers, mark.tolist())
            met += [(w, (part, n)) for w in set(kmers)]
    want = [(i, at, s[at:at + 10], at % 7 // 6) for i, s in rows + rows[:1] for at in range(len(s) - 9)]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    # equal k-mers meet in one part and pass
    assert len(met) == len({w for w, _ in met}) and len({p for _, p in met}) > 4


def test_single_kmers_travel_as_runs(seqs):
    assert all("number" not in line for line in exchanges(P.single_kmers(seqs, 10)))
    numbers, texts = 0, 0
    for batch, windows in packed_runs([(1, "".join(np.random.default_rng(4).choice(list(C.RESIDUES), 50_000)))], 10, 2):
        texts += sum(len(b) for b in batch.column("body").to_pylist())
        numbers += 3 * 8 * windows
    # letters, places and marks are less than half of a number, an id and a place for each window
    assert texts < numbers / 2


def test_links_are_a_forest_and_travel_as_runs(spark):
    one, two = P._forest(np.array([5, 9, 3, 3, 20, 9]), np.array([9, 3, 5, 9, 21, 9]))
    assert set(zip(one.tolist(), two.tolist())) == {(3, 5), (3, 9), (20, 21)}
    rows = [(i, "ACDEFGHIKLMNPQRSTVWYACDEFGHIKL") for i in range(40)]
    links = P.shared_links(spark.createDataFrame(rows, "protein_id long, seq string"), 25)
    assert all("n0" not in line for line in exchanges(links))
    assert {b for _, b in links.collect()} == set(range(1, 40))


def test_hashes_that_meet_do_not_unite_kmers(spark, monkeypatch):
    """k-mers are compared whole; a block falls back on sorting where hashes of different ones meet."""
    rows = [(1, "ACDEFGHIKLMNPQRSTVWYACDEF"), (2, "YWVTSRQPNMLKIHGFEDCAYWVTS"), (3, "ACDEFGHIKLMNPQRSTVWYACDEF")]
    kept, grouped = [], []

    class Caught:
        def __getattr__(self, name):
            return lambda *a: self

        def first(self):
            return (100,)

        def mapInArrow(self, work, kind):
            kept.append(work)
            return self

        def applyInArrow(self, work, kind):
            grouped.append(work)
            return self

    monkeypatch.setattr(P, "_run_parts", lambda *a: 1)
    monkeypatch.setattr(P, "_mixed", lambda numbers: np.zeros(len(numbers[0]), np.uint64))
    P.shared_links(Caught(), 25)
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "seq": [s for _, s in rows]})
    sent = list(kept[0](iter([batch])))
    pairs = [tuple(r.values()) for b in grouped[0]((0,), iter(sent)) for r in b.to_pylist()]
    assert pairs == [(1, 3)]
