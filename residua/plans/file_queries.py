"""Listings and readers: each table is written in a text format, read back, and compared line by line or row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from residua import constants as C
from residua.functions.alphabet import clean_residues
from residua.operators import kmers as K, packed as P, sequences as SQ
from residua.operators.suffixes import suffix_ranks
from residua.plans import genome_queries  # noqa: F401  (its SQL is read below)
from residua.plans.registry import (
    DNA_LETTERS, ORACLES, dna, kmers_sql, proteins, proteins_sql, query, residues_sql, scratch_path, table,
)
from residua.sinks import text as T
from residua.sources import motifs as M, sequences as Q
from residua.sources.lines import number_lines, read_lines


def _listed(lines: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """(line_no, value) of a listing after it was written."""
    path = scratch_path(lines.sparkSession, name)
    T.write_lines(lines, path, order)
    return number_lines(read_lines(lines.sparkSession, path)).select("line_no", "value")


@query("dna_header_round_trip", f"""
SELECT concat('doc', doc_id, ' of ', source) AS name, translate({residues_sql()}, '{C.RESIDUES}', '{DNA_LETTERS}') AS seq FROM documents""")
def dna_header_round_trip(spark, sf_dir):
    """DNA records with whole header lines, in lower case until they are read."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = dna(spark, sf_dir).join(sources, "doc_id")
    path = scratch_path(spark, "dna")
    T.write_lines(T.fasta_lines(rows.select(
        F.concat(F.lit("doc"), "doc_id", F.lit(" of "), "source").alias("name"), F.lower("seq").alias("seq"))), path)
    return Q.read_fasta(spark, path, "dna", full_name=True).select("name", "seq")


@query("two_line_round_trip", f"""
WITH {proteins_sql()} SELECT row_number() OVER (ORDER BY protein_id) - 1 AS protein_id, concat('p', protein_id, ' x') AS name, seq, TRUE AS well_formed FROM proteins""")
def two_line_round_trip(spark, sf_dir):
    rows = proteins(spark, sf_dir).select("protein_id", F.concat(F.lit("p"), "protein_id", F.lit(" x")).alias("name"), "seq")
    path = scratch_path(spark, "two-line")
    T.write_lines(T.fasta_lines(rows), path, ["protein_id"])
    return Q.read_two_line_fasta(spark, path)


@query("kmer_fasta_round_trip", f"""
WITH {proteins_sql("benchmark", "item_id")}, {kmers_sql(10)}, d AS (SELECT DISTINCT kmer FROM kmers)
SELECT row_number() OVER (ORDER BY kmer) - 1 AS kmer_id, concat('>k-', kmer) AS name, kmer AS seq FROM d""")
def kmer_fasta_round_trip(spark, sf_dir):
    rows = K.explode_kmers(proteins(spark, sf_dir, "benchmark", "item_id"), 10).select("kmer").distinct()
    named = rows.select(F.concat(F.lit("k-"), "kmer", F.lit(" again")).alias("name"), F.col("kmer").alias("seq"))
    path = scratch_path(spark, "kmers")
    T.write_lines(T.fasta_lines(named), path, ["seq"])
    return Q.read_kmer_fasta(spark, path, keep_mark=True)


@query("truth_list_round_trip", """
SELECT DISTINCT concat('m', label) AS motif, concat('p', vec_id) AS protein FROM embeddings""")
def truth_list_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_at"), F.concat_ws(
        "\t", F.concat(F.lit("m"), "label"), F.concat(F.lit("p"), "vec_id"), F.lit("seen")).alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("_at"), F.lit("motif\tprotein\tnote").alias("value"))
    path = scratch_path(spark, "truth")
    T.write_lines(head.unionByName(rows), path, ["_at"])
    return M.read_truth_list(spark, path)


def _clusters(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("label IS NOT NULL").select(
        F.col("label").cast("long").alias("leader"), F.col("vec_id").alias("id"), F.concat(F.lit("v"), "vec_id").alias("name"))


def _clusters_sql(header: str) -> str:
    return f"""
WITH m AS (SELECT label AS leader, vec_id AS id FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT leader, 0 AS part, NULL AS id, {header} AS value FROM (SELECT leader, count(*) AS n FROM m GROUP BY leader)
  UNION ALL SELECT leader, 1, id, concat('v', id) FROM m)
SELECT row_number() OVER (ORDER BY leader, part, id) - 1 AS line_no, value FROM l"""


@query("cluster_listing", _clusters_sql("concat('#cluster', leader)"))
def cluster_listing(spark, sf_dir):
    return _listed(T.cluster_lines(_clusters(spark, sf_dir), with_size=False), "clusters")


@query("sized_cluster_listing", _clusters_sql("concat('#clusterid:', leader, ':size', n)"))
def sized_cluster_listing(spark, sf_dir):
    return _listed(T.cluster_lines(_clusters(spark, sf_dir)), "sized-clusters")


@query("meme_listing", f"""
WITH p AS (SELECT doc_id AS protein_id, lang, {residues_sql()} AS seq FROM documents),
k AS (SELECT lang, substr(seq, CAST(i AS INTEGER), 8) AS kmer FROM (SELECT lang, seq, unnest(range(1, length(seq) - 6)) AS i FROM p)),
c AS (SELECT lang, j - 1 AS pos, substr(kmer, CAST(j AS INTEGER), 1) AS aa FROM (SELECT lang, kmer, unnest(range(1, 9)) AS j FROM k)),
cells AS (SELECT lang AS motif, pos, {", ".join(f"printf('%.4f', count(*) FILTER (aa = '{a}') / count(*)) AS {a}" for a in C.MOTIF_LETTERS)} FROM c GROUP BY lang, pos),
l AS (SELECT '' AS motif, -2 AS pos, 0 AS n, 'MEME version 4' AS value UNION ALL SELECT '', -2, 1, '' UNION ALL SELECT '', -2, 2, 'ALPHABET= {C.MOTIF_LETTERS}'
  UNION ALL SELECT '', -2, 3, '' UNION ALL SELECT DISTINCT motif, -1, 0, concat('MOTIF ', motif) FROM cells
  UNION ALL SELECT DISTINCT motif, -1, 1, 'letter-probability matrix: alength= {len(C.MOTIF_LETTERS)} w= 8' FROM cells
  UNION ALL SELECT motif, pos, 0, concat_ws(' ', {", ".join(C.MOTIF_LETTERS)}) FROM cells)
SELECT row_number() OVER (ORDER BY motif, pos, n) - 1 AS line_no, value FROM l""")
def meme_listing(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("protein_id"), "lang")
    matrix = P.letter_matrix(proteins(spark, sf_dir).join(langs, "protein_id").withColumnRenamed("lang", "motif"), 8, "motif")
    return _listed(T.motif_matrix_lines(matrix, 8, digits=4), "meme")


@query("score_folders", """
SELECT CAST(1 + n_chars % 5 AS BIGINT) AS k, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1""")
def score_folders(spark, sf_dir):
    """One folder of scores for each length, read back with its name."""
    rows = table(spark, sf_dir, "documents").select((1 + F.col("n_chars") % 5).cast("long").alias("k"), F.col("n_chars").alias("score"))
    path = scratch_path(spark, "scores")
    T.scores_by_length(rows, path)
    return spark.read.text(path).groupBy(F.col("k").cast("long").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query("length_listing", f"""
WITH {proteins_sql()} SELECT CAST(length(seq) AS BIGINT) AS length, count(*) AS n FROM proteins GROUP BY 1""")
def length_listing(spark, sf_dir):
    lengths = proteins(spark, sf_dir).select(F.length("seq").alias("length"))
    path = scratch_path(spark, "lengths")
    T.write_lines(T.length_lines(lengths, "length"), path)
    return read_lines(spark, path).groupBy(F.col("value").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("prb_round_trip", f"""
WITH {proteins_sql("benchmark", "item_id")}, s AS (SELECT protein_id, seq FROM proteins WHERE seq <> '')
SELECT row_number() OVER (ORDER BY protein_id) - 1 AS read_id, CAST(length(seq) AS BIGINT) AS n_bases,
  CAST(list_sum(list_transform(string_split(seq, ''), lambda c: 3 * ascii(c) - 40)) AS BIGINT) AS total FROM s""")
def prb_round_trip(spark, sf_dir):
    """Four numbers for each letter."""
    seqs = proteins(spark, sf_dir, "benchmark", "item_id").filter("seq <> ''")
    codes = F.transform(F.split("seq", ""), lambda c: F.when(c != "", F.concat_ws(
        " ", F.ascii(c), F.lit(-40), F.ascii(c), F.ascii(c))))
    path = scratch_path(spark, "prb")
    T.write_lines(seqs.select("protein_id", F.array_join(F.filter(codes, lambda c: c.isNotNull()), "\t").alias("value")),
                  path, ["protein_id"])
    total = F.aggregate(F.flatten("scores"), F.lit(0.0), lambda s, x: s + x)
    return Q.read_prb(spark, path).select("read_id", F.size("scores").cast("long").alias("n_bases"), total.cast("long").alias("total"))


@query("suffix_position_round_trip", f"""
WITH {proteins_sql("benchmark", "item_id")}, s AS (SELECT protein_id, unnest(range(0, length(seq))) AS pos, seq FROM proteins)
SELECT row_number() OVER (ORDER BY substr(seq, CAST(pos + 1 AS INTEGER)), protein_id, pos) - 1 AS line_no, protein_id, CAST(pos AS INTEGER) AS pos FROM s""")
def suffix_position_round_trip(spark, sf_dir):
    """The sorted suffixes of all items as a file of positions."""
    ranks = suffix_ranks(proteins(spark, sf_dir, "benchmark", "item_id"))
    path = scratch_path(spark, "suffixes")
    T.write_lines(T.tab_lines(ranks, "protein_id", "pos"), path, ["rank", "protein_id", "pos"])
    return M.read_suffix_positions(spark, path)


@query("fastq_line_roles", """
SELECT kind AS role, count(*) AS n_lines FROM conversations, (SELECT unnest(['name', 'sequence', 'score_name', 'score']) AS kind) GROUP BY kind""")
def fastq_line_roles(spark, sf_dir):
    reads = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("r"), "conv_id", F.lit("."), "turn").alias("name"), clean_residues(F.col("text")).alias("seq"))
    path = scratch_path(spark, "roles")
    T.write_lines(T.fastq_lines(reads.withColumn("qual", F.col("seq"))), path)
    # the whole file is FASTQ by its first character, which chooses the roles
    if not Q.is_fastq(spark, path):
        raise ValueError("a file of reads that does not look like one")
    return Q.line_roles(number_lines(read_lines(spark, path))).groupBy("role").agg(F.count(F.lit(1)).alias("n_lines"))


@query("sorted_peptides", f"""
WITH {proteins_sql()} SELECT row_number() OVER (ORDER BY seq, protein_id) - 1 AS line_no, concat_ws(chr(9), protein_id, seq) AS value FROM proteins""")
def sorted_peptides(spark, sf_dir):
    rows = SQ.sort_peptides(proteins(spark, sf_dir))
    return _listed(T.tab_lines(rows, "protein_id", "seq"), "peptides", ["seq", "protein_id"])


@query("orf_listing", f"""
WITH f AS ({ORACLES["orf_frames"]}), l AS (SELECT doc_id, orf_idx, 0 AS n, concat('>d', doc_id, '_', orf_idx) AS value FROM f
  UNION ALL SELECT doc_id, orf_idx, 1, aa FROM f)
SELECT row_number() OVER (ORDER BY doc_id, orf_idx, n) - 1 AS line_no, value FROM l""")
def orf_listing(spark, sf_dir):
    frames = SQ.number_frames(SQ.six_frames(dna(spark, sf_dir), "doc_id"), "doc_id")
    return _listed(T.orf_fasta_lines(frames.withColumn("name", F.concat(F.lit("d"), "doc_id"))), "orf", ["doc_id", "orf_idx"])


@query("single_kmers", f"""
WITH {proteins_sql()}, {kmers_sql(10)}
SELECT min(protein_id) AS protein_id, min(pos) AS pos, kmer FROM kmers GROUP BY kmer HAVING count(*) = 1""")
def single_kmers(spark, sf_dir):
    """k-mers that occur once in all documents, with their place."""
    return P.single_kmers(proteins(spark, sf_dir), 10)
