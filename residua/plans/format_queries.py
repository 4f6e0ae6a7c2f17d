"""Tables written in each text format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua import constants as C
from residua.functions.alphabet import clean_residues
from residua.operators import groups as G, search as S
from residua.plans.registry import (
    CENTERS_SQL, DNA_LETTERS, POINTS_SQL, points, proteins, proteins_sql, query, residues_sql, scratch_path, table,
)
from residua.sinks import text as T
from residua.sources import motifs as M, sequences as Q


@query("fasta_round_trip", f"WITH {proteins_sql()} SELECT concat('doc', protein_id) AS name, seq, length(seq) AS length FROM proteins")
def fasta_round_trip(spark, sf_dir):
    """Raw texts as multi-line FASTA; reading cleans them."""
    rows = table(spark, sf_dir, "documents")
    body = F.regexp_replace("text", r"(^|\n)>", "$1 ")
    named = rows.select(F.concat(F.lit("doc"), "doc_id", F.lit(" of "), "source").alias("name"), body.alias("seq"))
    path = scratch_path(spark, "fasta")
    T.write_lines(T.fasta_lines(named), path)
    read = Q.read_fasta(spark, path)
    return read.select("name", "seq", F.col("length").cast("long").alias("length"))


@query("fasta_order", f"""
WITH {proteins_sql()} SELECT row_number() OVER (ORDER BY protein_id) - 1 AS protein_id, protein_id AS doc_id, length(seq) AS length FROM proteins""")
def fasta_order(spark, sf_dir):
    """Records numbered in file order."""
    seqs = proteins(spark, sf_dir).withColumn("name", F.concat(F.lit("d"), "protein_id"))
    path = scratch_path(spark, "ordered")
    T.write_lines(T.fasta_lines(seqs), path, ["protein_id"])
    read = Q.read_fasta(spark, path)
    return read.select("protein_id", F.regexp_replace("name", "d", "").cast("long").alias("doc_id"),
                       F.col("length").cast("long").alias("length"))


@query("points_round_trip", f"""
WITH {POINTS_SQL} SELECT concat('v', point_id) AS name, len(point) AS dims, round(list_sum(point), 6) AS total FROM points""")
def points_round_trip(spark, sf_dir):
    rows, _ = points(spark, sf_dir)
    path = scratch_path(spark, "points")
    T.write_lines(T.named_point_lines(rows.select(F.concat(F.lit("v"), "point_id").alias("name"), "point")), path)
    read = M.read_named_points(spark, path)
    total = F.aggregate("point", F.lit(0.0), lambda s, x: s + x)
    return read.select("name", F.size("point").cast("long").alias("dims"), F.round(total, 6).alias("total"))


@query("centers_round_trip", f"""
WITH {POINTS_SQL}, {CENTERS_SQL} SELECT row_number() OVER (ORDER BY center_id) - 1 AS center_id, round(list_sum(center), 6) AS total FROM centers""")
def centers_round_trip(spark, sf_dir):
    rows, dim = points(spark, sf_dir)
    path = scratch_path(spark, "centers")
    T.write_lines(T.center_lines(G.centroids(rows, "label", dim)), path, ["label"])
    total = F.aggregate("center", F.lit(0.0), lambda s, x: s + x)
    return M.read_centers(spark, path).select("center_id", F.round(total, 6).alias("total"))


@query("groups_round_trip", f"""
WITH p AS (SELECT source, doc_id, {residues_sql()} AS seq FROM documents),
r AS (SELECT source AS motif, row_number() OVER (PARTITION BY source ORDER BY doc_id, seq) - 1 AS member_idx, seq FROM p WHERE seq <> ''),
big AS (SELECT motif FROM r GROUP BY motif HAVING count(*) >= 10)
SELECT r.* FROM r WHERE motif IN (SELECT motif FROM big)""")
def groups_round_trip(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("protein_id"), F.col("source").alias("motif"))
    members = proteins(spark, sf_dir).filter("seq <> ''").join(sources, "protein_id")
    path = scratch_path(spark, "groups")
    T.write_lines(T.group_lines(members.withColumnRenamed("protein_id", "member_idx")), path)
    return M.read_groups(spark, path, min_size=10)


@query("hits_round_trip", f"""
WITH {POINTS_SQL}, {CENTERS_SQL} SELECT concat('m', center_id) AS motif, concat('p', point_id) AS protein,
  round(list_distance(center, point), 6) AS distance, list_distance(center, point) <= 0.98 AS near FROM centers, points WHERE list_distance(center, point) <= 1.0""")
def hits_round_trip(spark, sf_dir):
    rows, dim = points(spark, sf_dir)
    centers = G.centroids(rows, "label", dim).select(F.col("label").alias("center_id"), "center")
    hits = S.radius_exact(centers, rows, dim, 1.0).select(
        F.concat(F.lit("m"), "center_id").alias("motif"), F.concat(F.lit("p"), "point_id").alias("protein"), "distance")
    path = scratch_path(spark, "hits")
    T.write_split_hits(hits, 0.98, path)
    both = M.read_hits(spark, path).withColumn("near", F.lit(True)).unionByName(
        M.read_hits(spark, f"{path}.notlessthan").withColumn("near", F.lit(False)))
    return both.withColumn("distance", F.round("distance", 6))


def _alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    aligned = F.regexp_replace("text", "[^A-Za-z]+", ".")
    return rows.select("doc_id", "source", "lang", F.concat(F.lit("q-"), "doc_id").alias("seqname"),
                       F.lit(3).cast("long").alias("start"), F.col("n_chars").cast("long").alias("stop"),
                       F.concat(F.lit("."), aligned).alias("alignment"))


@query("stockholm_round_trip", """
WITH a AS (SELECT source, concat('q-', doc_id) AS seqname, 3 AS start, n_chars AS stop, concat('.', regexp_replace(text, '[^A-Za-z]+', '.', 'g')) AS alignment FROM documents)
SELECT source AS "ID", concat('AC_', source) AS "AC", count(*) OVER (PARTITION BY source) AS "SQ", seqname,
  CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, length(alignment) AS width, upper(substr(regexp_replace(alignment, '[.a-z]+', '', 'g'), 1, 4)) AS states FROM a""")
def stockholm_round_trip(spark, sf_dir):
    rows = _alignment(spark, sf_dir)
    entries = rows.groupBy(F.col("source").alias("entry")).agg(F.count(F.lit(1)).alias("SQ"))
    entries = entries.select("entry", F.col("entry").alias("ID"), F.concat(F.lit("AC_"), "entry").alias("AC"),
                             F.lit("made of documents").alias("DE"), F.lit("Motif").alias("TP"), "SQ")
    path = scratch_path(spark, "stockholm")
    lines = T.stockholm_lines(entries, rows.select(F.col("source").alias("entry"), "seqname", "start", "stop", "alignment"))
    T.write_lines(lines, path)
    heads, aligned = M.read_stockholm(spark, path)
    both = aligned.join(heads, "entry")
    states = F.substring(F.regexp_replace("alignment", "[.a-z]+", ""), 1, 4)
    return both.select("ID", "AC", "SQ", "seqname", "start", "stop", F.length("alignment").cast("long").alias("width"),
                       states.alias("states"))


@query("fastq_round_trip", f"""
WITH r AS (SELECT concat('r', conv_id, '.', turn) AS name, translate({residues_sql()}, '{C.RESIDUES}', '{DNA_LETTERS}') AS seq FROM conversations)
SELECT name, seq, CASE WHEN seq = '' THEN 0 ELSE CAST(list_sum(list_transform(string_split(seq, ''), lambda c: ascii(c) - 33)) AS BIGINT) END AS total, 'phred' AS kind FROM r""")
def fastq_round_trip(spark, sf_dir):
    """Reads whose quality string is the read itself, which fits the phred encoding only."""
    rows = table(spark, sf_dir, "conversations")
    seq = F.translate(clean_residues(F.col("text")), C.RESIDUES, DNA_LETTERS)
    reads = rows.select(F.concat(F.lit("r"), "conv_id", F.lit("."), "turn").alias("name"), seq.alias("seq"))
    path = scratch_path(spark, "fastq")
    T.write_lines(T.fastq_lines(reads.withColumn("qual", F.col("seq"))), path)
    read = Q.with_scores(Q.read_fastq(spark, path))
    kind = Q.quality_kind(read).select("kind").scalar()
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + x)
    return read.select("name", "seq", total.cast("long").alias("total"), kind.alias("kind"))


@query("annotation_round_trip", """
WITH r AS (SELECT d.doc_id, n_chars, source, lang, COALESCE(CAST(quality AS VARCHAR), 'unknown') AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS length, count(*) FILTER (q = 'unknown') AS n_unknown FROM r GROUP BY lang""")
def annotation_round_trip(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    quality = F.coalesce(F.col("quality").cast("string"), F.lit("unknown"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.concat(F.lit("g"), "doc_id").alias("gene"), "n_chars", F.lit("Complete").alias("c"),
        F.lit("EUR").alias("o"), F.col("lang").alias("phylum"), F.col("source").alias("genus"), quality.alias("k"),
        quality.alias("e"))
    path = scratch_path(spark, "annotation")
    T.write_lines(T.tab_lines(rows, *rows.columns), path)
    read = M.read_annotations(spark, path)
    return read.groupBy(F.col("PhylumLevel").alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Length").alias("length"),
        F.count_if(F.col("eggNOGAnnotation") == "unknown").alias("n_unknown"))
