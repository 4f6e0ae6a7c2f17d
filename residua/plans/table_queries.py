"""Queries written as SQL text over table functions, and tables that pass through the data sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua import constants as C
from residua.functions.alphabet import clean_residues
from residua.functions.table_functions import register_functions
from residua.operators import kmers as K
from residua.operators.layout import by_key
from residua.plans.genome_queries import _codon_sql, _DNA_SQL
from residua.plans.format_queries import _alignment
from residua.plans.registry import (
    DNA_LETTERS, dna, kmers_sql, proteins, proteins_sql, query, residues_sql, scratch_path, table,
)
from residua.sinks import text as T
from residua.sources import motifs as M
from residua.sources.formats import register_formats, written_parts


@query("kmer_lateral", f"""
WITH {proteins_sql()}, {kmers_sql(4)} SELECT kmer, count(*) AS n, count(DISTINCT protein_id) AS n_proteins, CAST(sum(pos) AS BIGINT) AS places FROM kmers GROUP BY kmer""")
def kmer_lateral(spark, sf_dir):
    return register_functions(spark).sql("""
        SELECT kmer, sum(n) AS n, count(*) AS n_proteins, sum(places) AS places FROM (
          SELECT protein_id, kmer, count(*) AS n, sum(begin + pos) AS places
          FROM (SELECT protein_id, begin, kmers(piece, 4) AS windows
            FROM (SELECT protein_id, kmer_pieces(seq, 4) AS pieces FROM {proteins}), LATERAL inline(pieces)),
            LATERAL inline(windows)
          GROUP BY protein_id, kmer) GROUP BY kmer""", proteins=by_key(proteins(spark, sf_dir), "protein_id"))


@query("frame_lateral", f"""
WITH {_DNA_SQL}, strands AS (SELECT doc_id, 0 AS strand, seq FROM dna
  UNION ALL SELECT doc_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM dna),
frames AS (SELECT doc_id, strand * 3 + f AS frame, substr(seq, CAST(f + 1 AS INTEGER)) AS s FROM strands, (SELECT unnest([0, 1, 2]) AS f))
SELECT doc_id, CAST(frame AS INTEGER) AS frame, split_part(array_to_string(list_transform(regexp_extract_all(s, '...'), lambda c: {_codon_sql('c')}), ''), '*', 1) AS aa FROM frames""")
def frame_lateral(spark, sf_dir):
    # each text has six frames; without "outer" Spark would make them a first time to drop empty lists
    return register_functions(spark).sql(
        "SELECT doc_id, frame, aa FROM (SELECT doc_id, frames(seq) AS found FROM {dna}), LATERAL inline_outer(found)", dna=dna(spark, sf_dir))


@query("run_lateral", f"""
WITH {proteins_sql()}, l AS (SELECT protein_id, i, substr(seq, CAST(i AS INTEGER), 1) AS letter FROM (SELECT protein_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM proteins)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY protein_id, letter ORDER BY i) AS grp FROM l)
SELECT protein_id, min(i) - 1 AS start, letter, count(*) AS length, repeat(letter, count(*)) AS run FROM g GROUP BY protein_id, letter, grp HAVING count(*) >= 2""")
def run_lateral(spark, sf_dir):
    """Runs of equal residues."""
    return register_functions(spark).sql(
        "SELECT protein_id, start, letter, length, run FROM {proteins}, LATERAL runs(seq, 2, true)",
        proteins=proteins(spark, sf_dir))


@query("fasta_source", f"""
WITH {proteins_sql()} SELECT concat('doc', protein_id) AS name, concat('doc', protein_id, ' of all') AS header, seq FROM proteins""")
def fasta_source(spark, sf_dir):
    """Records in lines of 60 letters, written and read by the data source."""
    register_formats(spark)
    named = proteins(spark, sf_dir).select(F.concat(F.lit("doc"), "protein_id", F.lit(" of all")).alias("name"), "seq")
    path = scratch_path(spark, "fasta-source")
    named.write.format("fasta").option("width", 60).mode("append").save(path)
    return spark.read.format("fasta").load(path).select("name", "header", "seq")


@query("fastq_source", f"""
SELECT concat('r', conv_id, '.', turn, ' again') AS name, translate({residues_sql()}, '{C.RESIDUES}', '{DNA_LETTERS}') AS seq,
  translate({residues_sql()}, '{C.RESIDUES}', '@+I#@+I#@+I#@+I#@+I#') AS qual FROM conversations""")
def fastq_source(spark, sf_dir):
    """Reads whose qualities hold the marks of names and separators, in ranges far shorter than a part."""
    register_formats(spark)
    seq = clean_residues(F.col("text"))
    reads = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("r"), "conv_id", F.lit("."), "turn", F.lit(" again")).alias("name"),
        F.translate(seq, C.RESIDUES, DNA_LETTERS).alias("seq"), F.translate(seq, C.RESIDUES, "@+I#" * 5).alias("qual"))
    path = scratch_path(spark, "fastq-source")
    reads.write.format("fastq").mode("append").save(path)
    size = written_parts(spark, path).agg(F.max("bytes")).first()[0] or 1
    return spark.read.format("fastq").option("rangeBytes", max(1, size // 4)).load(path).select("name", "seq", "qual")


@query("stockholm_source", """
SELECT concat('e', doc_id) AS "ID", source AS "AC", CAST(1 AS BIGINT) AS "SQ", concat('q-', doc_id) AS seqname, CAST(3 AS BIGINT) AS start, CAST(n_chars AS BIGINT) AS stop,
  concat('.', regexp_replace(text, '[^A-Za-z]+', '.', 'g')) AS alignment FROM documents""")
def stockholm_source(spark, sf_dir):
    """An entry for each document; entries are read whole by ranges, without numbering or filling lines."""
    register_formats(spark)
    rows = _alignment(spark, sf_dir).withColumn("entry", F.col("doc_id"))
    entries = rows.select("entry", F.concat(F.lit("e"), "doc_id").alias("ID"), F.col("source").alias("AC"),
                          F.lit("made of documents").alias("DE"), F.lit("Motif").alias("TP"), F.lit(1).alias("SQ"))
    path = scratch_path(spark, "stockholm-source")
    T.stockholm_lines(entries, rows).select("value").write.format("listing").mode("append").save(path)
    lines = spark.read.format("stockholm").load(path).withColumn("entry", F.struct("file", "entry"))
    heads, aligned = M.entry_tables(lines)
    return aligned.join(heads, "entry").select("ID", "AC", "SQ", "seqname", "start", "stop", "alignment")


@query("written_parts", f"""
WITH {proteins_sql()}, {kmers_sql(6)}, d AS (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(length(kmer) + length(CAST(n AS VARCHAR)) + 2) AS BIGINT) AS n_bytes, TRUE AS in_order FROM d""")
def written_parts_totals(spark, sf_dir):
    """What the commit of a sorted listing states: rows, bytes, and whether parts follow each other."""
    register_formats(spark)
    counted = K.count_kmers(K.explode_kmers(proteins(spark, sf_dir), 6)).orderBy("kmer")
    path = scratch_path(spark, "parts")
    T.tab_lines(counted, "kmer", "n").select("value").write.format("listing").mode("overwrite").save(path)
    parts = written_parts(spark, path)
    return parts.agg(F.sum("rows").alias("n_rows"), F.sum("bytes").alias("n_bytes"),
                     (F.max(F.col("first") + F.col("rows")) == F.sum("rows")).alias("in_order"))
