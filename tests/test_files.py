import pytest
from pyspark.sql import functions as F

from residua import constants as C
from residua.functions.hashing import LshFamily
from residua.operators import groups as G, search as S
from residua.sinks import text as T
from residua.sources import lines as R, motifs as M, sequences as Q
from residua.streaming.search import stream_kmer_hits


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def test_fasta_edge_cases(spark, tmp_path):
    text = ">p1 demo\r\nMKV\r\nlaa\r\n>p2\n>p3 x\nAB*-C\n\n>p1\nWW\n"
    path = put(tmp_path, "a.fa", text)
    rows = sorted(Q.read_fasta(spark, path).collect())
    assert [(r.protein_id, r.name, r.seq) for r in rows] == [
        (0, "p1", "MKVLAA"), (1, "p2", ""), (2, "p3", "A" + C.RESIDUES[(ord("B") + 1) % 20] + "C"), (3, "p1", "WW")]
    assert [r.name for r in sorted(Q.read_fasta(spark, path, full_name=True, keep_empty=False).collect())] == [
        "p1 demo", "p3 x", "p1"]
    assert Q.fetch_fasta(spark, path, "p1").first().seq == "MKVLAA"
    assert {r.name for r in Q.read_kmer_fasta(spark, path, keep_mark=True).collect()} == {">p1", ">p3"}
    put(tmp_path, "b.txt", ">no\nA\n")
    assert Q.read_fasta(spark, str(tmp_path), suffix=".fa").count() == 4
    listed = put(tmp_path, "list.txt", path + "\n\n")
    assert R.read_path_list(spark, listed) == [path]


def test_two_line_fasta(spark, tmp_path):
    rows = sorted(Q.read_two_line_fasta(spark, put(tmp_path, "t", ">a\nMK\n>b\n>c\n")).collect())
    assert [(r.name, r.well_formed) for r in rows] == [("a", True), ("b", False)]


def test_lines_over_many_splits(spark, tmp_path):
    body = "".join(f"#h{i}\n" + "".join(f"m{i}_{j}\n" for j in range(i % 7)) for i in range(400))
    path = put(tmp_path, "g.txt", body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = R.read_lines(spark, path)
        assert lines.select("_start").distinct().count() > 5
        numbered = sorted((r.line_no, r.value) for r in R.number_lines(lines).collect())
        assert [v for _, v in numbered] == body.split() and [n for n, _ in numbered] == list(range(len(numbered)))
        members = M.read_groups(spark, path, min_size=3).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = {(f"h{i}", j, f"m{i}_{j}") for i in range(400) if i % 7 >= 3 for j in range(i % 7)}
    assert {(r.motif, r.member_idx, r.seq) for r in members} == expected and len(members) == len(expected)


def test_points_hits_and_truth(spark, tmp_path):
    points = M.read_named_points(spark, put(tmp_path, "p", "a#0$0@MK*0\n1 2.5\nb\n3 4\n"))
    assert [(r.name, r.point) for r in sorted(points.collect())] == [("a#0$0@MK*0", [1.0, 2.5]), ("b", [3.0, 4.0])]
    assert [r.center for r in sorted(M.read_centers(spark, put(tmp_path, "c", "1 2\n3 4\n")).collect())] == [[1, 2], [3, 4]]
    assert M.read_hits(spark, put(tmp_path, "h", "m1 p1 12.5\n")).first().distance == 12.5
    truth = M.read_truth_list(spark, put(tmp_path, "t", "#pattern name\nm1 p1 5 14\nm1 p1 7 9\nm2 p1 1 2\n"))
    assert sorted(map(tuple, truth.collect())) == [("m1", "p1"), ("m2", "p1")]
    pos = M.read_suffix_positions(spark, put(tmp_path, "s", "0\t4\n1\t2\n"))
    assert [(r.protein_id, r.pos) for r in sorted(pos.collect())] == [(0, 4), (1, 2)]


STOCKHOLM = """# STOCKHOLM 1.0
#=GF ID   Demo
#=GF AC   PF1.2
#=GF TP   Motif
#=GF SQ   3
#=GS q-1/3-9  AC x
q-1/3-9  MK.VLa-WW
q2/1-7   MKcVLAWWW
q2/1-7   AAAAAAAAA
//
# STOCKHOLM 1.0
#=GF ID   Other
#=GF SQ   1
q3/1-2   MKVLAWWW
//
"""


def test_stockholm(spark, tmp_path):
    entries, rows = M.read_stockholm(spark, put(tmp_path, "s.sto", STOCKHOLM))
    first, second = sorted(entries.collect())
    assert (first.ID, first.AC, first.TP, first.SQ, second.ID, second.AC) == ("Demo", "PF1.2", "Motif", 3, "Other", None)
    assert sorted((r.seqname, r.start, r.stop, r.alignment) for r in rows.collect()) == [
        ("q-1", 3, 9, "MK.VLa-WW"), ("q2", 1, 7, "MKcVLAWWW"), ("q3", 1, 2, "MKVLAWWW")]
    bad = M.count_mismatches(entries, rows).collect()
    assert [(r.ID, r.SQ, r.n_read) for r in bad] == [("Demo", 3, 2)]
    blocks = M.first_blocks(rows, ["entry", "seqname"], 6).collect()
    assert [(r.block, r.seqname) for r in blocks] == [("MKVLAW", "q2")]
    every = M.column_blocks(rows, 5, keep_one_in=1).filter("entry = 0").collect()
    starts = {(r.column, r.block) for r in every}
    assert (0, "MKVLA") in starts and (2, "VLAWW") in starts and not any("-" in b for _, b in starts)
    dump = [r.value for r in T.entry_dump_lines(entries, rows).collect()]
    assert dump[0].startswith("ID: Demo") and dump[1].split("\t")[3:] == ["MKVL-WW", "MK.VLa-WW"]
    assert len(T.entry_dump_lines(entries, rows, "motifs").collect()) == 4
    assert not any("q2" in r.value for r in T.entry_dump_lines(entries, rows, "no_gaps").collect())
    lines = [r.value for r in T.block_lines(M.first_blocks(rows, ["entry", "seqname"], 6), entries).collect()]
    assert lines == ["#ID:Demo#AC:PF1.2", "MKVLAW"]
    names = spark.createDataFrame([("#=GS q7/3-9 AC x",)], "v string").select(M.gs_name(F.col("v")).alias("n"))
    assert names.first().n == "q7"


def test_fastq_and_prb(spark, tmp_path):
    path = put(tmp_path, "r.fq", "@r1\nACGT\n+\nIIII\n@r2\nAC\n+r2\n!\"\n")
    reads = Q.with_scores(Q.read_fastq(spark, path))
    assert {r.name: r.scores for r in reads.collect()} == {"r1": [40.0] * 4, "r2": [0.0, 1.0]}
    assert Q.is_fastq(spark, path) and not Q.is_fastq(spark, put(tmp_path, "x.fa", "\n>a\nA\n"))
    roles = Q.line_roles(R.number_lines(R.read_lines(spark, path))).filter("role = 'score'").collect()
    assert sorted(r.value for r in roles) == ['!"', "IIII"]
    with pytest.raises(Exception, match="malformed FASTQ"):
        Q.read_fastq(spark, put(tmp_path, "bad.fq", "r1\nA\n+\nI\n")).collect()
    prb = Q.read_prb(spark, put(tmp_path, "p.prb", "40 -40 -40 -40 1 2 3 4\n5 6 7 8\n"))
    assert [r.scores for r in sorted(prb.collect())] == [[[40, -40, -40, -40], [1, 2, 3, 4]], [[5, 6, 7, 8]]]
    with pytest.raises(Exception, match="multiple of four"):
        Q.read_prb(spark, put(tmp_path, "bad.prb", "1 2 3\n")).collect()
    mapped = Q.read_mapped_reads(spark, put(tmp_path, "m", "a b c d e f g hhh i\n"))
    assert mapped.first().qual == "hhh" and Q.quality_kind(mapped).first().kind == "solexa"


def test_empty_reads_peptides_and_vectors_keep_their_place(spark, tmp_path):
    first = put(tmp_path, "one.fq", "@r1\n\n+\n\n@r2\nAC\n+\nII\n\n\n")
    second = put(tmp_path, "two.fq", "@r3\nG\n+\nI\n@r4\n\n+\n\n")
    reads = Q.with_scores(Q.read_fastq(spark, [first, second]))
    assert sorted((r.read_id, r.name, r.seq, r.scores) for r in reads.collect()) == [
        (0, "r1", "", []), (1, "r2", "AC", [40.0, 40.0]), (2, "r3", "G", [40.0]), (3, "r4", "", [])]
    pairs = Q.read_two_line_fasta(spark, put(tmp_path, "two.fa", ">a\n\n>b\nMK\n>c\n\n")).collect()
    assert sorted((r.protein_id, r.name, r.seq, r.well_formed) for r in pairs)[:2] == [(0, "a", "", True), (1, "b", "MK", True)]
    named = M.read_named_points(spark, put(tmp_path, "pts", "p\n\nq\n1 2\n")).collect()
    assert sorted((r.name, r.point) for r in named) == [("p", []), ("q", [1.0, 2.0])]


def test_short_lines_fail_unless_lenient(spark, tmp_path):
    path = put(tmp_path, "short", "m p 1.5\n\nm q\n")
    with pytest.raises(Exception, match="fewer than 3 fields"):
        M.read_hits(spark, path).collect()
    assert M.read_hits(spark, path, lenient=True).count() == 1
    with pytest.raises(Exception, match="fewer than 9 fields"):
        M.read_annotations(spark, path).collect()


def test_numbers_need_no_shuffle_of_text(spark, tmp_path):
    path = put(tmp_path, "lines", "".join(f"line {i}\n" for i in range(500)))
    lines = R.number_lines(R.read_lines(spark, path))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    shuffles = [row for row in plan.splitlines() if "Exchange hashpartitioning" in row]
    assert not any("value" in row for row in shuffles) and "BroadcastHashJoin" in plan
    assert sorted((r.line_no, r.value) for r in lines.collect()) == [(i, f"line {i}") for i in range(500)]


def test_annotations(spark, tmp_path):
    text = "1 g1 300 Complete EUR unknown unknown unknown unknown\n2 g2 100 Complete EUR Firm unknown unknown unknown x y\n"
    rows = M.read_annotations(spark, put(tmp_path, "a", text))
    r = G.annotation_summary(rows, "Length", ["PhylumLevel", "GenusLevel", "KEGGAnnotation", "eggNOGAnnotation"]).first()
    assert (r.total, r.n_unknown, r.total_length, r.unknown_length, r.unknown_share) == (2, 1, 400, 300, 0.5)


def test_line_layouts(spark, tmp_path):
    clusters = spark.createDataFrame([(0, 0, "a"), (0, 2, "c"), (1, 1, "b")], "leader long, id long, name string")
    path = str(tmp_path / "clusters")
    T.write_lines(T.cluster_lines(clusters), path)
    files = sorted((tmp_path / "clusters").glob("part-*"))
    assert "".join(f.read_text() for f in files).split() == ["#clusterid:0:size2", "a", "c", "#clusterid:1:size1", "b"]
    matrix = G.weight_matrix(spark.createDataFrame([("m", "AC")], "motif string, kmer string"))
    lines = [r.value for r in T.motif_matrix_lines(matrix, 2).collect()]
    assert lines[0].startswith("MEME version 4") and lines[1].startswith("MOTIF m") and lines[2].startswith("1.00 0.00")
    bins = spark.createDataFrame([(1, 0.0, 0, 3), (2, 1.0, 2, 0), (3, 0.5, 1, 1)], "bin long, ratio double, tp long, fn long")
    assert {r.value for r in T.accuracy_lines(bins).collect()} == {"1 0 fn 3", "2 1 tp 2", "3 0.5 1 1"}
    frames = spark.createDataFrame([("d", 0, "MK")], "name string, orf_idx int, aa string")
    assert T.orf_fasta_lines(frames).first().value == ">d_0\nMK"
    kmers = spark.createDataFrame([("MKVLAAGIVG",)], "kmer string")
    assert len(T.coordinate_rows(kmers).first().value.split("\t")) == 80
    hits = spark.createDataFrame([("m", "p", 1.5), ("m", "q", 3.0)], "motif string, protein string, distance double")
    T.write_split_hits(hits, 2.0, str(tmp_path / "hits"))
    assert M.read_hits(spark, str(tmp_path / "hits")).count() == 1
    assert M.read_hits(spark, str(tmp_path / "hits.notlessthan")).first().protein == "q"


def test_streaming_search_equals_batch(spark, tmp_path):
    kmers = ["MKVLA", "MKILA", "WWWWW", "MRVLA", "IIIII", "VIIII"]
    centers = spark.createDataFrame([("MKVLA",), ("IIIII",)], "kmer string")
    family = LshFamily(40, 2, 3, 60.0)
    folder = str(tmp_path / "in")
    spark.createDataFrame([(i, k) for i, k in enumerate(kmers)], "id long, kmer string").repartition(3).write.parquet(folder)
    arriving = spark.readStream.schema("id long, kmer string").option("maxFilesPerTrigger", 1).parquet(folder)
    q = (stream_kmer_hits(arriving, centers, 5, 6.0, family).writeStream.format("memory").queryName("stream_hits")
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    q.processAllAvailable()
    q.stop()
    got = {(r.center, r.kmer) for r in spark.table("stream_hits").collect()}
    batch = S.kmer_radius_lsh(centers, spark.createDataFrame([(k,) for k in kmers], "kmer string"), 5, 6.0, family)
    assert got == {(r.center, r.kmer) for r in batch.collect()} and len(got) >= 3
