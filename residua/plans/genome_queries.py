"""Reading frames, DNA k-mers, qualities, adaptors, p-values and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua import constants as C
from residua.functions import dna as D, quality as Q, text as X
from residua.operators import kmers as K, sequences as SQ
from residua.plans.registry import DNA_LETTERS, dna, points, proteins_sql, query, residues_sql, table

_DNA_SQL = f"""{proteins_sql()}, dna AS (
  SELECT protein_id AS doc_id, translate(seq, '{C.RESIDUES}', '{DNA_LETTERS}') AS seq FROM proteins)"""


def _codon_sql(codon: str) -> str:
    place = [f"(strpos('{C.CODON_BASES}', substr({codon}, {i}, 1)) - 1)" for i in (1, 2, 3)]
    return f"substr('{C.CODON_RESIDUES}', {place[0]} * 16 + {place[1]} * 4 + {place[2]} + 1, 1)"


@query("orf_frames", f"""
WITH {_DNA_SQL}, strands AS (SELECT doc_id, 0 AS strand, seq FROM dna
  UNION ALL SELECT doc_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM dna),
frames AS (SELECT doc_id, strand * 3 + f AS frame, substr(seq, CAST(f + 1 AS INTEGER)) AS s FROM strands, (SELECT unnest([0, 1, 2]) AS f)),
aa AS (SELECT doc_id, frame, split_part(array_to_string(list_transform(regexp_extract_all(s, '...'), lambda c: {_codon_sql('c')}), ''), '*', 1) AS aa FROM frames)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY frame) - 1 AS orf_idx, aa FROM aa WHERE length(aa) >= 6""")
def orf_frames(spark, sf_dir):
    frames = SQ.number_frames(SQ.six_frames(dna(spark, sf_dir), "doc_id"), "doc_id")
    return frames.withColumn("orf_idx", F.col("orf_idx").cast("long"))


@query("dna_kmers", f"""
WITH {_DNA_SQL}, k AS (SELECT substr(seq, CAST(i AS INTEGER), 5) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM dna)),
c AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer),
x AS (SELECT *, list_transform(range(1, 6), lambda i: strpos('ACGT', substr(kmer, CAST(i AS INTEGER), 1)) - 1) AS d FROM c)
SELECT kmer, n, CAST(d[1] * 256 + d[2] * 64 + d[3] * 16 + d[4] * 4 + d[5] AS BIGINT) AS idx,
  CAST((3 - d[5]) * 256 + (3 - d[4]) * 64 + (3 - d[3]) * 16 + (3 - d[2]) * 4 + (3 - d[1]) AS BIGINT) AS rc_idx,
  kmer AS back, translate(kmer, 'ACGT', 'TGCA') AS back_complement, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM x""")
def dna_kmers(spark, sf_dir):
    counted = K.explode_kmers(dna(spark, sf_dir), 5, "doc_id").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    index = D.mer_to_index(F.col("kmer"))
    return counted.select(
        "kmer", "n", index.alias("idx"), D.mer_to_index(F.col("kmer"), complemented=True).alias("rc_idx"),
        D.index_to_mer(index, 5).alias("back"), D.index_to_mer(index, 5, complemented=True).alias("back_complement"),
        D.revcomp(F.col("kmer")).alias("rc"))


@query("base_codes", """
WITH l AS (SELECT unnest(string_split(text, '')) AS c FROM conversations),
n AS (SELECT c AS letter, count(*) AS n FROM l WHERE regexp_full_match(c, '[A-Za-z]') GROUP BY c),
u AS (SELECT *, upper(letter) AS b FROM n)
SELECT letter, n,
  CASE b WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS plain,
  CASE letter WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS upper_only,
  CASE b WHEN 'A' THEN 0 WHEN 'C' THEN 3 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS bisulfite,
  CASE b WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 0 WHEN 'T' THEN 3 ELSE 4 END AS bisulfite_ag,
  CASE b WHEN 'A' THEN 3 WHEN 'C' THEN 2 WHEN 'G' THEN 1 WHEN 'T' THEN 0 ELSE 4 END AS complement,
  CASE b WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' ELSE 'N' END AS back,
  CASE letter WHEN 'A' THEN 'T' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' WHEN 'T' THEN 'A'
    WHEN 'a' THEN 't' WHEN 'c' THEN 'g' WHEN 'g' THEN 'c' WHEN 't' THEN 'a'
    ELSE CASE WHEN ascii(letter) >= 97 THEN 'n' ELSE 'N' END END AS paired FROM u""")
def base_codes(spark, sf_dir):
    letters = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "")).alias("letter"))
    counted = letters.filter(F.col("letter").rlike("^[A-Za-z]$")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("letter")
    return counted.select(
        "letter", "n", D.base_code(c).alias("plain"), D.base_code(c, any_case=False).alias("upper_only"),
        D.base_code(c, "bisulfite").alias("bisulfite"), D.base_code(c, "bisulfite_ag").alias("bisulfite_ag"),
        D.base_code(c, "complement").alias("complement"), D.code_base(D.base_code(c)).alias("back"),
        D.complement(c).alias("paired"))


ADAPTOR = "ACGTTGCAACGTAG"


@query("adaptor_clip", f"""
WITH r AS (SELECT conv_id, turn, translate({residues_sql()}, '{C.RESIDUES}', '{DNA_LETTERS}') AS read FROM conversations),
w AS (SELECT conv_id, turn, read, list_transform(range(0, greatest(length(read) - 4, 0)), lambda i: struct_pack(spot := i,
    n := least(14, length(read) - i),
    same := {' + '.join(f"CASE WHEN substr(read, CAST(i + {j + 1} AS INTEGER), 1) = '{a}' THEN 1 ELSE 0 END" for j, a in enumerate(ADAPTOR))})) AS w FROM r),
s AS (SELECT conv_id, turn, read, COALESCE(list_filter(w.w, lambda x: x.n = 14 AND x.same >= 11)[1].spot,
  list_filter(w.w, lambda x: x.n < 14 AND x.same >= x.n - 1)[1].spot) AS spot FROM w)
SELECT conv_id, turn, COALESCE(spot, -1) AS "at", COALESCE(length(read) - spot, 0) AS clipped, CASE WHEN spot IS NULL THEN read ELSE rpad(substr(read, 1, CAST(spot AS INTEGER)), CAST(length(read) AS INTEGER), 'N') END AS kept FROM s""")
def adaptor_clip(spark, sf_dir):
    from residua.functions.alphabet import clean_residues

    reads = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.translate(clean_residues(F.col("text")), C.RESIDUES, DNA_LETTERS).alias("read"))
    at = D.adaptor_start(F.col("read"), ADAPTOR).cast("long")
    return reads.select("conv_id", "turn", F.coalesce(at, F.lit(-1)).alias("at"),
                        F.coalesce(F.length("read") - at, F.lit(0)).alias("clipped"),
                        D.clip_adaptor(F.col("read"), ADAPTOR).alias("kept"))


@query("quality_scores", """
WITH p AS (SELECT l_orderkey, l_linenumber, (l_discount + 0.01) / 2 AS e FROM lineitem),
s AS (SELECT *, -10 * log10(e) AS ph, -10 * log10(e / (1 - e)) AS so FROM p)
SELECT l_orderkey, l_linenumber, round(ph, 6) AS phred, round(so, 6) AS solexa,
  chr(CAST(trunc(least(60, ph)) AS INTEGER) + 33) AS phred_char, chr(CAST(trunc(least(40, so)) AS INTEGER) + 64) AS solexa_char,
  round(pow(10.0, -trunc(least(60, ph)) / 10), 9) AS phred_error,
  round(pow(10.0, -trunc(least(40, so)) / 10) / (1 + pow(10.0, -trunc(least(40, so)) / 10)), 9) AS solexa_error FROM s""")
def quality_scores(spark, sf_dir):
    e = (F.col("l_discount") + 0.01) / 2
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", e.alias("e"))
    chars = rows.select("*", Q.error_to_char(F.col("e")).alias("phred_char"),
                        Q.error_to_char(F.col("e"), "solexa").alias("solexa_char"))
    return chars.select(
        "l_orderkey", "l_linenumber", F.round(Q.error_to_score(F.col("e")), 6).alias("phred"),
        F.round(Q.error_to_score(F.col("e"), "solexa"), 6).alias("solexa"), "phred_char", "solexa_char",
        F.round(Q.char_to_error(F.col("phred_char")), 9).alias("phred_error"),
        F.round(1 - Q.char_to_probability(F.col("solexa_char"), "solexa"), 9).alias("solexa_error"))


_P_SQL = """p AS (SELECT l_orderkey, l_linenumber, CAST((l_orderkey * 31 + l_partkey * 17 + l_linenumber) % 9973 + 1 AS DOUBLE) / 9973.0 AS u FROM lineitem),
q AS (SELECT l_orderkey, l_linenumber, u * u * u AS p FROM p),
counts AS (SELECT p, count(*) AS n FROM q GROUP BY p),
ranked AS (SELECT p, n, sum(n) OVER (ORDER BY p) AS r, sum(n) OVER () AS t FROM counts)"""


def _pvalues(spark, sf_dir):
    u = (F.pmod(F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber"), F.lit(9973)) + 1) / F.lit(9973.0)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", u.alias("u"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("u") * F.col("u") * F.col("u")).alias("p"))


@query("pvalue_adjust", f"""
WITH {_P_SQL}, a AS (SELECT p, max(p * (t / r)) OVER (ORDER BY p) AS adjusted FROM ranked)
SELECT l_orderkey, l_linenumber, round(q.p, 9) AS p, round(adjusted, 9) AS adjusted FROM q JOIN a ON q.p = a.p""")
def pvalue_adjust(spark, sf_dir):
    rows = SQ.adjust_pvalues(_pvalues(spark, sf_dir), "p", "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"))


@query("fdr_cutoff", f"""
WITH {_P_SQL}, s AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS t FROM q),
f AS (SELECT min(i) AS j FROM s WHERE i > 0 AND p >= 0.2 * i / t)
SELECT max(p) AS cutoff FROM s, f WHERE f.j IS NULL OR i < f.j""")
def fdr_cutoff(spark, sf_dir):
    return SQ.fdr_cutoff(_pvalues(spark, sf_dir), 0.2)


@query("text_words", r"""
WITH t AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words,
  CAST(len(list_filter(regexp_split_to_array(text, '[,.]'), lambda x: regexp_matches(x, '[^\s]'))) AS BIGINT) AS n_parts,
  CAST(trunc(100.0 * len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) / length(text)) AS BIGINT) AS share
FROM t""")
def text_words(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    words = F.size(X.split_words(F.col("text"))).cast("long")
    return rows.select("conv_id", "turn", words.alias("n_words"),
                       F.size(X.squash(X.split_any(F.col("text"), ",."))).cast("long").alias("n_parts"),
                       X.percent(words, F.length("text")).alias("share"))


@query("bit_strings", """
SELECT event_id, lpad(bin(user_id & 85), 64, '0') AS masked, substr(lpad(bin(user_id), 64, '0'), 53, 12) AS low FROM events""")
def bit_strings(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("long")
    return rows.select("event_id", X.bits_masked(user, F.lit(85).cast("long")).alias("masked"),
                       X.bits_last(user, 12).alias("low"))


@query("log_sum_exp", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 9) AS total,
  round(list_max(v[1:16]) + ln(list_sum(list_transform(v[1:16], lambda x: exp(x - list_max(v[1:16]))))), 9) AS head FROM v""")
def log_sum_exp(spark, sf_dir):
    rows, _ = points(spark, sf_dir)
    return rows.select(F.col("point_id").alias("vec_id"), F.round(X.log_sum_exp(F.col("point")), 9).alias("total"),
                       F.round(X.log_sum_exp(F.col("point"), 16), 9).alias("head"))
