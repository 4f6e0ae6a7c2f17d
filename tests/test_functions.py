import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua import constants as C
from tests_support import adjust_slowly

from residua.functions import alphabet as A, dna as D, hashing as H, quality as Q, scoring as S, text as X, vectors as V


def one(spark, expr, **values):
    row = spark.createDataFrame([values]) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_fixed_values_are_consistent():
    assert C.BLOSUM62 == [list(r) for r in zip(*C.BLOSUM62)]
    assert V.triangle_violations(C.BLOSUM_DISTANCE) == 0
    assert C.MIN_RESIDUE_DISTANCE_SQ == pytest.approx(8.786247, abs=1e-5)
    assert C.raw_score_from_bits(25, False) == pytest.approx(48.172, abs=1e-3)
    assert C.UNGAPPED_DROP == pytest.approx(8.937, abs=1e-3)
    assert C.GAPPED_DROP == pytest.approx(26.978, abs=1e-3)
    assert C.reduced_blosum()[0][0] == pytest.approx(1.88889, abs=1e-5)
    for groups in C.REDUCED_ALPHABETS.values():
        assert sorted("".join(groups)) == sorted(C.RESIDUES)
    d = np.sqrt(np.array(C.BLOSUM_DISTANCE, dtype=float))
    e = np.sqrt(np.array(C.COORDINATE_DISTANCE_SQ))
    assert np.corrcoef(d.ravel() ** 2, e.ravel())[0, 1] > 0.9


def test_clean_residues(spark):
    assert one(spark, A.clean_residues(F.col("t")), t="m-k v\nX") == "MKV" + C.RESIDUES[(ord("X") + 3) % 20]
    assert one(spark, A.clean_residues(F.col("t"), "drop"), t="aBJc*") == "AC"
    assert one(spark, A.clean_residues(F.col("t")), t="") == ""
    with pytest.raises(Exception, match="unknown residue"):
        one(spark, A.clean_residues(F.col("t"), "error"), t="ABC")


def test_reduced_alphabet_codes(spark):
    assert one(spark, A.octet_code(F.col("t")), t="RNC") == 1 + 8 * 2 + 64 * 3
    assert one(spark, A.octet_digits(A.octet_code(F.col("t"))), t="ARN") == "012"
    assert one(spark, A.seed_number(F.col("t"), 1), t="AAKECGH") == 12345
    assert one(spark, A.seed_number(F.col("t"), 5), t="AAKECGH") == -1
    assert one(spark, A.representative_sequence(A.reduce_sequence(F.col("t"))), t="RDV") == "KEI"


def test_points_and_distances(spark):
    p = one(spark, V.kmer_point(F.col("t")), t="AW")
    assert p == C.COORDINATES["A"] + C.COORDINATES["W"]
    a, b = "MKVLA", "MRVIA"
    pa = sum((C.COORDINATES[x] for x in a), [])
    pb = sum((C.COORDINATES[x] for x in b), [])
    expected = sum((x - y) ** 2 for x, y in zip(pa, pb))
    codes = (V.kmer_codes(F.col("a")), V.kmer_codes(F.col("b")))
    assert one(spark, V.kmer_distance_sq(*codes, 5), a=a, b=b) == pytest.approx(expected)
    assert one(spark, V.distance_sq(F.col("a"), F.col("b")), a=pa, b=pb) == pytest.approx(expected)
    assert one(spark, V.row_distance(F.col("a"), F.col("b")), a=pa, b=pb) == pytest.approx(math.sqrt(expected))
    assert one(spark, V.blosum_score(*codes, 5), a=a, b=b) == 5 + 2 + 4 + 2 + 4
    long = "MKVLA" * 5
    assert one(spark, V.blosum_score(V.kmer_codes(F.col("a")), V.kmer_codes(F.col("a")), 25), a=long) == 5 * (5 + 5 + 4 + 4 + 4)
    with pytest.raises(Exception, match="not a valid k-mer"):
        one(spark, V.strict_kmer_point(F.col("a"), 10), a="MKX")


def test_lsh_keys_agree_with_native_buckets(spark):
    rng = random.Random(3)
    kmers = ["".join(rng.choice(C.RESIDUES) for _ in range(6)) for _ in range(300)]
    kmers += [k[:5] + rng.choice(C.RESIDUES) for k in kmers]
    family = H.LshFamily(dim=48, lines=3, tables=2, width=30.0)
    df = spark.createDataFrame([(k,) for k in set(kmers)], "kmer string")
    rows = df.select(
        H.lsh_buckets_native(V.kmer_point(F.col("kmer")), family).alias("n"),
        H.lsh_keys(V.kmer_point(F.col("kmer")), family).alias("p"),
        H.kmer_lsh_keys(F.col("kmer"), 6, family).alias("k"),
    ).collect()
    for t in range(2):
        by_bucket = {}
        for r in rows:
            assert r.p[t] == r.k[t]
            by_bucket.setdefault(tuple(r.n[t]), set()).add(r.p[t])
        assert all(len(v) == 1 for v in by_bucket.values())
        assert len({next(iter(v)) for v in by_bucket.values()}) == len(by_bucket)
        assert len(by_bucket) < len(rows)


def test_expected_recall():
    assert H.collision_probability(49.38, 395) == pytest.approx(0.900, abs=1e-3)
    assert H.expected_recall(49.38, 50, 4, 4) == pytest.approx(0.075, abs=1e-3)


def test_dna(spark):
    assert one(spark, D.revcomp(D.revcomp(F.col("s"))), s="ACGTNacgtn") == "ACGTNacgtn"
    assert one(spark, D.index_to_mer(D.mer_to_index(F.col("s")), 6), s="GATTAC") == "GATTAC"
    assert one(spark, D.mer_to_index(F.col("s")), s="ACGT") == 27
    table = {}
    for i, a in enumerate(C.CODON_RESIDUES):
        table[C.CODON_BASES[i // 16] + C.CODON_BASES[i // 4 % 4] + C.CODON_BASES[i % 4]] = a
    df = spark.createDataFrame(list(table.items()), "codon string, aa string")
    assert df.filter(D.codon_residue(F.col("codon")) != F.col("aa")).count() == 0
    assert one(spark, D.translate_frame(F.col("s"), 1), s="CATGAAATAAGGG") == "MK"
    assert one(spark, D.translate_frame(F.col("s"), 0), s="TAAATG") == ""
    assert one(spark, D.codon_residue(F.col("s")), s="ANG") == "X"


def clip_slowly(read, adaptor):
    def same(i):
        return sum(x == y for x, y in zip(read[i:i + 14], adaptor[:14]))

    for i in range(0, max(0, len(read) - 13)):
        if same(i) >= 11:
            return i
    for i in range(max(0, len(read) - 13), max(0, len(read) - 4)):
        if same(i) >= len(read) - i - 1:
            return i
    return None


def test_adaptors(spark):
    adaptor = "ACGTTGCAACGTAG"
    rng = random.Random(5)
    reads = ["", "ACG", "GGGACGTTGCAACGTAGTTT", "GGGGGGGGGGGGACGTTG", adaptor, "TTTTTTTTTTTTTTTACGTT"]
    reads += ["".join(rng.choice("ACGT") for _ in range(60)) + adaptor[: rng.randint(0, 14)] for _ in range(60)]
    df = spark.createDataFrame([(r,) for r in reads], "read string")
    for r in df.select("read", D.adaptor_start(F.col("read"), adaptor).alias("at"), D.clip_adaptor(F.col("read"), adaptor).alias("c")).collect():
        at = clip_slowly(r.read, adaptor)
        assert r.at == at
        assert r.c == (r.read if at is None else r.read[:at] + "N" * (len(r.read) - at))
    first, second = D.split_adaptors(F.col("s"))
    assert (one(spark, first, s="AC:GT"), one(spark, second, s="AC:GT"), one(spark, second, s="AC")) == ("AC", "GT", "AC")


def test_quality(spark):
    assert one(spark, Q.error_to_score(F.col("p")), p=0.001) == pytest.approx(30)
    assert one(spark, Q.score_to_error(Q.error_to_score(F.col("p"), "solexa"), "solexa"), p=0.2) == pytest.approx(0.2)
    assert one(spark, Q.score_to_char(F.col("q")), q=99) == chr(60 + 33)
    assert one(spark, Q.char_to_score(F.col("c"), "solexa"), c="h") == 40
    assert one(spark, Q.probability_to_char(F.col("p")), p=0.9) == chr(10 + 33)
    assert one(spark, Q.sniff_kind(F.lit(70), F.lit(80))) == "phred"
    assert one(spark, Q.sniff_kind(F.lit(70), F.lit(100))) == "solexa"
    assert one(spark, Q.dispatch_error(F.lit(10.0), F.lit("phred"), False)) == pytest.approx(0.1)


def test_text(spark):
    assert one(spark, X.split_quoted(F.col("s")), s=""" a 'b c' "d e"f g """) == ["a", "'b c'", '"d e"f', "g"]
    assert one(spark, X.split_any(F.col("s"), ",]", True), s="a,,b]c") == ["a", "", "b", "c"]
    assert one(spark, X.squash(X.split_any(F.col("s"), ",")), s="a, ,b") == ["a", "b"]
    assert one(spark, X.log_sum_exp(F.col("v")), v=[1000.0, 1000.0]) == pytest.approx(1000 + math.log(2))
    assert one(spark, X.percent(F.lit(2), F.lit(3))) == 66
    assert one(spark, X.bits_last(F.lit(5).cast("long"), 4)) == "0101"
    assert one(spark, X.file_stem(F.col("s")), s="/a/b/c.x.fa") == "c.x"


def test_length_adjustment(spark):
    cases = [(m, n, k) for m in (5, 11, 40, 100, 350, 2000) for n, k in ((200, 2), (5000, 20), (10**6, 3000), (10**9, 10**6))]
    df = spark.createDataFrame(cases, "m long, n long, k long")
    for r in df.select("*", S.length_adjustment(F.col("m"), F.col("n"), F.col("k")).alias("a")).collect():
        assert r.a == adjust_slowly(r.m, r.n, r.k), r


def test_recall_weights(spark):
    assert one(spark, S.recall_weight(F.lit(23.0), 50)) == 1
    assert one(spark, S.recall_weight(F.lit(28.0), 50)) == pytest.approx(0.25)
    assert one(spark, S.recall_weight_linear(F.lit(49.38))) == pytest.approx(0.5)
    with pytest.raises(Exception, match="beyond the search radius"):
        one(spark, S.recall_weight(F.lit(51.0), 50))
    assert one(spark, S.log10_evalue(F.lit(0.0))) == -10000
    assert one(spark, S.length_cutoff(F.lit(100))) == math.ceil(100 * 290.15 * 100**-0.562 / 100)
