"""k-mers, residue alphabets, features and pre-groups of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from residua import constants as C
from residua.functions import vectors as V
from residua.functions.alphabet import octet_code, octet_digits, reduce_sequence, representative_sequence, seed_number
from residua.functions.hashing import KernelFamily
from residua.operators import groups as G, kmers as K, packed as P
from residua.operators.neighbours import best_neighbours, neighbour_overlaps, top_overlap
from residua.operators.search import owner_of_position
from residua.operators.layout import by_key, range_slices, running_total
from residua.operators.sequences import suffix_order, truncate_motifs
from residua.operators.suffixes import suffix_ranks
from residua.plans.registry import (
    kmers_sql, list_sql, pair_sum_sql, proteins, proteins_sql, query, residues_sql, table,
)
from residua.session import cut_lineage
from residua.sources.motifs import first_blocks

KERNEL = KernelFamily()


@query("kmer_positions", f"""
WITH {proteins_sql()}, {kmers_sql(3)}
SELECT kmer, count(*) AS n, count(DISTINCT protein_id) AS n_proteins, CAST(sum(pos) AS BIGINT) AS pos_sum,
       min(pos) AS pos_min, max(pos) AS pos_max
FROM kmers GROUP BY kmer""")
def kmer_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a sequence's windows are counted where it is
    found = K.explode_kmers(by_key(proteins(spark, sf_dir), "protein_id"), 3)
    per = found.groupBy("kmer", "protein_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("s"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    return per.groupBy("kmer").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_proteins"), F.sum("s").alias("pos_sum"),
        F.min("lo").cast("long").alias("pos_min"), F.max("hi").cast("long").alias("pos_max"),
    )


@query("kmer_count", f"""
WITH {proteins_sql()}, {kmers_sql(4)},
firsts AS (SELECT kmer, count(*) AS n, min(struct_pack(a := protein_id, b := pos)) AS f FROM kmers GROUP BY kmer)
SELECT kmer, n, f.a AS protein_id, f.b AS pos FROM firsts""")
def kmer_count(spark, sf_dir):
    counted = K.count_kmers(K.explode_kmers(proteins(spark, sf_dir), 4))
    return counted.withColumn("pos", F.col("pos").cast("long"))


@query("kmer_distinct_stats", f"""
WITH {proteins_sql()}, {kmers_sql(10)},
stats AS (SELECT count(*) AS n_peptides, CAST(max(length(seq)) AS BIGINT) AS longest,
                 CAST(sum(length(seq)) AS BIGINT) AS total_length FROM proteins)
SELECT stats.*, (SELECT count(DISTINCT kmer) FROM kmers) AS n_distinct,
       (SELECT count(*) FROM (SELECT kmer FROM kmers GROUP BY kmer HAVING count(*) = 1)) AS n_unique FROM stats""")
def kmer_distinct_stats(spark, sf_dir):
    seqs = proteins(spark, sf_dir)
    counts = P.distinct_counts(seqs, 10).withColumn("one", F.lit(1))
    return K.peptide_stats(seqs).withColumn("one", F.lit(1)).join(counts, "one").drop("one")


def sample_sql(k: int) -> str:
    return f"""{proteins_sql()}, {kmers_sql(k)},
taken AS (SELECT * FROM kmers WHERE pos % (30 + protein_id % 20) = 0),
sample AS (SELECT kmer, min(struct_pack(a := protein_id, b := pos)) AS f FROM taken GROUP BY kmer)"""


_SAMPLE_SQL = sample_sql(25)


@query("kmer_sample", f"WITH {_SAMPLE_SQL} SELECT f.a AS protein_id, f.b AS pos, kmer FROM sample")
def kmer_sample(spark, sf_dir):
    return K.sample_kmers(proteins(spark, sf_dir), 25).withColumn("pos", F.col("pos").cast("long"))


COORDINATES_SQL = "[" + ", ".join(list_sql(C.COORDINATES[r]) for r in C.RESIDUES) + "]"


@query("named_points", f"""
WITH {_SAMPLE_SQL}, numbered AS (
  SELECT f.a AS p, f.b AS o, kmer, row_number() OVER (ORDER BY f.a, f.b) - 1 AS n FROM sample)
SELECT concat('doc', p, '#', p, '$', o, '@', kmer, '*', n) AS name, 200 AS dims,
       round(list_sum(list_transform(range(1, 26), lambda i: list_sum(list_transform(
         {COORDINATES_SQL}[strpos('{C.RESIDUES}', substr(kmer, CAST(i AS INTEGER), 1))], lambda x: x * x)))), 4) AS norm_sq
FROM numbered""")
def named_points(spark, sf_dir):
    seqs = proteins(spark, sf_dir)
    names = seqs.select("protein_id", F.concat(F.lit("doc"), "protein_id", F.lit(" text")).alias("name"))
    named = K.named_points(K.sample_kmers(seqs, 25), names)
    return named.select("name", F.size("point").alias("dims"),
                        F.round(V.dot(F.col("point"), F.col("point")), 4).alias("norm_sq"))


@query("kmer_points", f"""
WITH {proteins_sql()}, {kmers_sql(3)}, d AS (SELECT DISTINCT kmer FROM kmers),
e AS (SELECT kmer, unnest(range(0, 24)) AS dim FROM d)
SELECT kmer, dim, {COORDINATES_SQL}[strpos('{C.RESIDUES}', substr(kmer, CAST(dim // 8 + 1 AS INTEGER), 1))][dim % 8 + 1] AS coordinate
FROM e""")
def kmer_points(spark, sf_dir):
    distinct = K.explode_kmers(proteins(spark, sf_dir), 3).select("kmer").distinct()
    rows = distinct.select("kmer", F.posexplode(V.kmer_point(F.col("kmer"))).alias("dim", "coordinate"))
    return rows.withColumn("dim", F.col("dim").cast("long"))


@query("kmer_blosum", f"""
WITH {proteins_sql()}, {kmers_sql(20)}, halves AS (
  SELECT protein_id, substr(kmer, 1, 10) AS a, substr(kmer, 11, 10) AS b FROM kmers),
scored AS (SELECT protein_id, {pair_sum_sql('a', 'b', C.BLOSUM62, 10)} AS s,
                  {pair_sum_sql('a', 'b', C.BLOSUM_DISTANCE, 10)} AS d FROM halves)
SELECT protein_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS similarity, CAST(sum(d) AS BIGINT) AS distance,
       CAST(max(s) AS BIGINT) AS most_similar, CAST(min(d) AS BIGINT) AS nearest FROM scored GROUP BY protein_id""")
def kmer_blosum(spark, sf_dir):
    return P.half_scores(proteins(spark, sf_dir), 10, C.BLOSUM62, C.BLOSUM_DISTANCE)


_CORRELATION_K = (2, 5, 10)


def _correlation_sql() -> str:
    parts = [
        f"SELECT {k} AS k, {pair_sum_sql('substr(kmer, 1, %d)' % k, 'substr(kmer, 11, %d)' % k, C.BLOSUM62, k)} AS s, "
        f"{pair_sum_sql('substr(kmer, 1, %d)' % k, 'substr(kmer, 11, %d)' % k, C.BLOSUM_DISTANCE, k)} AS d FROM kmers"
        for k in _CORRELATION_K
    ]
    return (f"WITH {proteins_sql()}, {kmers_sql(20)}, scored AS ({' UNION ALL '.join(parts)}) "
            "SELECT CAST(k AS BIGINT) AS k, count(*) AS n, round(corr(s, d), 6) AS correlation FROM scored GROUP BY k")


@query("score_correlation", _correlation_sql())
def score_correlation(spark, sf_dir):
    found = P.prefix_correlation(proteins(spark, sf_dir), 10, _CORRELATION_K, C.BLOSUM62, C.BLOSUM_DISTANCE)
    return found.withColumn("correlation", F.round("correlation", 6))


_REDUCED = C.group_codes("murphy10")


@query("group_frequency", f"""
WITH {proteins_sql()}, letters AS (
  SELECT unnest(string_split(translate(seq, '{C.RESIDUES}', '{_REDUCED}'), '')) AS grp FROM proteins)
SELECT grp, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS frequency FROM letters WHERE grp <> '' GROUP BY grp""")
def group_frequency(spark, sf_dir):
    rows = K.group_frequency(proteins(spark, sf_dir).filter("seq <> ''"))
    return rows.withColumn("frequency", F.round("frequency", 9))


@query("seed_word_counts", f"""
WITH {proteins_sql()}, reduced AS (SELECT protein_id, translate(seq, '{C.RESIDUES}', '{_REDUCED}') AS seq FROM proteins),
{kmers_sql(6, 'reduced')}, counts AS (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer)
SELECT count(*) AS n_words, CAST(sum(n) AS BIGINT) AS n_positions, max(n) AS most, median(n) AS median FROM counts""")
def seed_word_counts(spark, sf_dir):
    return K.seed_word_counts(proteins(spark, sf_dir))


@query("reduced_codes", f"""
WITH {proteins_sql()}, {kmers_sql(6)}, d AS (SELECT DISTINCT kmer FROM kmers),
g AS (SELECT kmer, translate(kmer, '{C.RESIDUES}', '{C.group_codes('octet')}') AS o,
             translate(kmer, '{C.RESIDUES}', '{_REDUCED}') AS m,
             translate(kmer, '{C.RESIDUES}', '{C.group_codes('dayhoff6')}') AS y FROM d)
SELECT m AS murphy, y AS dayhoff, translate(y, '012345', '{C.REPRESENTATIVES['dayhoff6']}') AS shown,
       CAST(m AS BIGINT) AS seed, substr(o, 1, 3) AS digits,
       CAST(substr(o, 1, 1) AS BIGINT) + 8 * CAST(substr(o, 2, 1) AS BIGINT) + 64 * CAST(substr(o, 3, 1) AS BIGINT) AS code,
       count(*) AS n
FROM g GROUP BY ALL""")
def reduced_codes(spark, sf_dir):
    d = K.explode_kmers(proteins(spark, sf_dir), 6).select("kmer").distinct()
    y = reduce_sequence(F.col("kmer"), "dayhoff6")
    rows = d.select(
        reduce_sequence(F.col("kmer")).alias("murphy"), y.alias("dayhoff"),
        representative_sequence(y, "dayhoff6").alias("shown"), seed_number(F.col("kmer"), 0).alias("seed"),
        octet_digits(octet_code(F.col("kmer"))).alias("digits"), octet_code(F.col("kmer")).cast("long").alias("code"),
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


_OCTET = C.group_codes("octet")
_FEATURES_SQL = f"""{proteins_sql()}, {kmers_sql(3)},
coded AS (SELECT protein_id, translate(kmer, '{C.RESIDUES}', '{_OCTET}') AS o FROM kmers),
features AS (SELECT protein_id, CAST(o[1] AS BIGINT) + 8 * CAST(o[2] AS BIGINT) + 64 * CAST(o[3] AS BIGINT) AS code,
                    count(*) AS n FROM coded GROUP BY 1, 2)"""


@query("feature_histogram", f"""
WITH {_FEATURES_SQL}
SELECT protein_id, count(*) AS n_codes, CAST(sum(n) AS BIGINT) AS n_kmers, max(n) AS most,
       CAST(sum(code * n) AS BIGINT) AS weighted FROM features GROUP BY protein_id""")
def feature_histogram(spark, sf_dir):
    return G.feature_counts(proteins(spark, sf_dir)).groupBy("protein_id").agg(
        F.count(F.lit(1)).alias("n_codes"), F.sum("n").alias("n_kmers"), F.max("n").alias("most"),
        F.sum(F.col("code").cast("long") * F.col("n")).alias("weighted"),
    )


def _klsh_sql() -> str:
    w, t, b = KERNEL.weights(), KERNEL.thresholds(), KERNEL.phases()
    values = ", ".join(
        "(" + ", ".join([str(code)] + [repr(float(x)) for x in w[:, code]]) + ")" for code in range(KERNEL.dim)
    )
    names = ", ".join(f"w{i}" for i in range(KERNEL.bits))
    sums = ", ".join(f"sum(n * CAST(w{i} AS DOUBLE)) AS p{i}" for i in range(KERNEL.bits))
    bits = " + ".join(
        f"CASE WHEN cos(p{i} + {float(b[i])!r}) + {float(t[i])!r} >= 0 THEN {1 << i} ELSE 0 END"
        for i in range(KERNEL.bits)
    )
    return (f"{_FEATURES_SQL}, weights(code, {names}) AS (VALUES {values}), "
            f"projected AS (SELECT protein_id, {sums} FROM features JOIN weights USING (code) GROUP BY protein_id), "
            f"grouped AS (SELECT protein_id, CAST({bits} AS BIGINT) AS bucket FROM projected)")


KLSH_SQL = _klsh_sql()


@query("klsh_buckets", f"WITH {KLSH_SQL} SELECT protein_id, bucket FROM grouped")
def klsh_buckets(spark, sf_dir):
    return G.pre_groups(proteins(spark, sf_dir), KERNEL)


@query("bucket_histograms", f"""
WITH {KLSH_SQL}, per AS (
  SELECT bucket, count(*) AS size, CAST(sum(length(seq)) AS BIGINT) AS total FROM grouped JOIN proteins USING (protein_id) GROUP BY bucket)
SELECT 'size' AS kind, size AS amount, count(*) AS n_buckets FROM per GROUP BY size
UNION ALL SELECT 'length', total, count(*) FROM per GROUP BY total""")
def bucket_histograms(spark, sf_dir):
    seqs = proteins(spark, sf_dir)
    lengths = seqs.select("protein_id", F.length("seq").cast("long").alias("length"))
    sizes, totals = G.bucket_histograms(G.pre_groups(seqs, KERNEL), lengths)
    return sizes.select(F.lit("size").alias("kind"), F.col("size").alias("amount"), "n_buckets").unionByName(
        totals.select(F.lit("length").alias("kind"), F.col("total_length").alias("amount"), "n_buckets"))


@query("suffix_order", f"""
WITH {proteins_sql()}, s AS (SELECT protein_id, unnest(range(0, length(seq))) AS pos, seq FROM proteins)
SELECT protein_id, pos, substr(seq, CAST(pos + 1 AS INTEGER), 10) AS head FROM s""")
def ordered_suffixes(spark, sf_dir):
    rows = suffix_order(proteins(spark, sf_dir))
    return rows.select("protein_id", F.col("pos").cast("long").alias("pos"), F.substring("suffix", 1, 10).alias("head"))


@query("suffix_ranks")
def ranked_suffixes(spark, sf_dir):
    """The exact rank of each suffix of all documents; SQL would have to hold every suffix as a text."""
    return suffix_ranks(proteins(spark, sf_dir))


@query("item_suffix_ranks", f"""
WITH {proteins_sql("benchmark", "item_id")}, s AS (SELECT protein_id AS item_id, unnest(range(0, length(seq))) AS pos, seq FROM proteins)
SELECT item_id, pos, rank() OVER (ORDER BY substr(seq, CAST(pos + 1 AS INTEGER))) AS rank FROM s""")
def item_suffix_ranks(spark, sf_dir):
    return suffix_ranks(proteins(spark, sf_dir, "benchmark", "item_id")).withColumnRenamed("protein_id", "item_id")

@query("weight_matrix", f"""
WITH p AS (SELECT doc_id AS protein_id, lang, {residues_sql()} AS seq FROM documents),
k AS (SELECT lang, substr(seq, CAST(i AS INTEGER), 8) AS kmer FROM
      (SELECT lang, seq, unnest(range(1, length(seq) - 6)) AS i FROM p)),
c AS (SELECT lang, j - 1 AS pos, substr(kmer, CAST(j AS INTEGER), 1) AS aa FROM (SELECT lang, kmer, unnest(range(1, 9)) AS j FROM k))
SELECT lang AS motif, pos, {', '.join(f"round(count(*) FILTER (aa = '{a}') / count(*), 9) AS {a}" for a in C.MOTIF_LETTERS)}
FROM c GROUP BY lang, pos""")
def weight_matrix(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("protein_id"), "lang")
    named = proteins(spark, sf_dir).join(langs, "protein_id")
    matrix = P.letter_matrix(named.withColumnRenamed("lang", "motif"), 8, "motif")
    return matrix.select("motif", F.col("pos").cast("long").alias("pos"),
                         *[F.round(a, 9).alias(a) for a in C.MOTIF_LETTERS])


@query("annotation_summary", """
WITH r AS (SELECT d.doc_id, d.n_chars, COALESCE(CAST(quality AS VARCHAR), 'unknown') AS q,
                  COALESCE(CAST(toxic AS VARCHAR), 'unknown') AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
a AS (SELECT count(*) AS total, count(*) FILTER (q = 'unknown' AND t = 'unknown') AS n_unknown,
             CAST(sum(n_chars) AS BIGINT) AS total_length,
             CAST(COALESCE(sum(n_chars) FILTER (q = 'unknown' AND t = 'unknown'), 0) AS BIGINT) AS unknown_length FROM r)
SELECT *, round(n_unknown / total, 9) AS unknown_share, round(unknown_length / NULLIF(n_unknown, 0), 6) AS unknown_mean_length FROM a""")
def annotation_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left").select(
        "n_chars",
        F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"),
        F.coalesce(F.col("toxic").cast("string"), F.lit("unknown")).alias("toxic"),
    )
    out = G.annotation_summary(rows, "n_chars", ["quality", "toxic"])
    return out.withColumns({"unknown_share": F.round("unknown_share", 9),
                            "unknown_mean_length": F.round("unknown_mean_length", 6)})


@query("match_state_blocks", """
WITH a AS (SELECT doc_id, source, regexp_replace(text, '[^A-Za-z]+', '.', 'g') AS alignment FROM documents),
b AS (SELECT doc_id, source, substr(regexp_replace(alignment, '[.a-z]+', '', 'g'), 1, 5) AS block FROM a),
f AS (SELECT block, min(doc_id) AS doc_id FROM b WHERE length(block) = 5 GROUP BY block)
SELECT f.block, f.doc_id, b.source FROM f JOIN b ON f.doc_id = b.doc_id AND f.block = b.block""")
def match_state_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.regexp_replace("text", "[^A-Za-z]+", ".").alias("alignment"))
    return first_blocks(rows, ["doc_id"], 5)


@query("top_neighbours", f"""
WITH {proteins_sql()}, {kmers_sql(2)}, seeds AS (SELECT DISTINCT kmer FROM kmers),
letters AS (SELECT unnest(string_split('{C.RESIDUES}', '')) AS l), cand AS (SELECT a.l || b.l AS neighbour FROM letters a, letters b),
scored AS (SELECT kmer, neighbour, {pair_sum_sql('kmer', 'neighbour', C.BLOSUM62, 2)} AS score FROM seeds, cand),
placed AS (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY score DESC, neighbour) AS place FROM scored)
SELECT kmer, neighbour, CAST(score AS BIGINT) AS score, place FROM placed WHERE place <= 25""")
def top_neighbours(spark, sf_dir):
    return best_neighbours(K.explode_kmers(proteins(spark, sf_dir), 2), 25)


@query("neighbour_overlap", f"""
WITH {proteins_sql()}, {kmers_sql(2)}, seeds AS (SELECT DISTINCT kmer FROM kmers),
letters AS (SELECT unnest(string_split('{C.RESIDUES}', '')) AS l), cand AS (SELECT a.l || b.l AS neighbour FROM letters a, letters b),
scored AS (SELECT kmer, neighbour, {pair_sum_sql('kmer', 'neighbour', C.BLOSUM62, 2)} AS s,
                  {pair_sum_sql('kmer', 'neighbour', C.BLOSUM_DISTANCE, 2)} AS d FROM seeds, cand),
placed AS (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY s DESC, neighbour) AS ps,
                  row_number() OVER (PARTITION BY kmer ORDER BY d, neighbour) AS pd FROM scored),
tops AS (SELECT unnest([1, 5, 20, 50]) AS top),
per AS (SELECT top, kmer, count(*) AS n, count(*) FILTER (pd <= top) AS hit FROM placed JOIN tops ON ps <= top GROUP BY top, kmer)
SELECT CAST(top AS BIGINT) AS top, round(avg(hit / n), 9) AS overlap, count(*) AS n_seeds FROM per GROUP BY top""")
def neighbour_overlap(spark, sf_dir):
    seeds = K.explode_kmers(proteins(spark, sf_dir), 2)
    rows = top_overlap(best_neighbours(seeds, 50), best_neighbours(seeds, 50, "distance"), [1, 5, 20, 50])
    return rows.select(F.col("top").cast("long").alias("top"), F.round("overlap", 9).alias("overlap"), "n_seeds")


@query("neighbours_of_three", f"""
WITH {proteins_sql()}, {kmers_sql(3)}, seeds AS (SELECT DISTINCT kmer FROM kmers),
letters AS (SELECT unnest(string_split('{C.RESIDUES}', '')) AS l), cand AS (SELECT a.l || b.l || c.l AS neighbour FROM letters a, letters b, letters c),
scored AS (SELECT kmer, neighbour, {pair_sum_sql('kmer', 'neighbour', C.BLOSUM62, 3)} AS score FROM seeds, cand)
SELECT kmer, neighbour, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY kmer ORDER BY score DESC, neighbour) AS place
FROM scored QUALIFY place <= 50""")
def neighbours_of_three(spark, sf_dir):
    return best_neighbours(K.explode_kmers(proteins(spark, sf_dir), 3), 50)


# list lengths of the study of similar against near k-mers
OVERLAP_TOPS = [1, 5, 10, 20, 30, 50, 80, 100, 150, 200, 300, 500, 1000]


def _item_overlaps(spark, sf_dir, k):
    found = neighbour_overlaps(K.explode_kmers(proteins(spark, sf_dir, "benchmark", "item_id"), k), OVERLAP_TOPS)
    return found.withColumn("overlap", F.round("overlap", 9))


@query("neighbour_overlap_six")
def neighbour_overlap_six(spark, sf_dir):
    """Lists up to 1,000 of all 6-mers of the items; SQL would have to score 64 million candidates for each."""
    return _item_overlaps(spark, sf_dir, 6)


@query("neighbour_overlap_ten")
def neighbour_overlap_ten(spark, sf_dir):
    return _item_overlaps(spark, sf_dir, 10)


@query("position_owner", f"""
WITH {proteins_sql()}, spans AS (
  SELECT protein_id, length(seq) AS length, sum(length(seq)) OVER (ORDER BY protein_id) - length(seq) AS start FROM proteins),
total AS (SELECT sum(length(seq)) AS n FROM proteins),
positions AS (SELECT event_id, CAST((event_id * 7919) % (SELECT n FROM total) AS BIGINT) AS pos FROM events)
SELECT event_id, pos, protein_id, CAST(pos - start AS BIGINT) AS at FROM positions JOIN spans ON pos >= start AND pos < start + length""")
def position_owner(spark, sf_dir):
    # read by the quantiles, both passes of the running total and the sum
    lengths = cut_lineage(proteins(spark, sf_dir).select("protein_id", F.length("seq").cast("long").alias("length")))
    sliced = lengths.withColumn("_slice", range_slices(lengths, "protein_id"))
    spans = cut_lineage(running_total(sliced, "_slice", ["protein_id"], "length", "_end").select(
        "protein_id", "length", (F.col("_end") - F.col("length")).alias("start")))
    total = lengths.agg(F.sum("length")).scalar()
    positions = table(spark, sf_dir, "events").select(
        "event_id", F.pmod(F.col("event_id") * 7919, total).alias("pos"))
    return owner_of_position(positions, spans).select(
        "event_id", "pos", "protein_id", (F.col("pos") - F.col("start")).alias("at"))


@query("truncate_motifs", f"""
WITH p AS (SELECT source AS motif, doc_id AS member_idx, {residues_sql()} AS seq FROM documents),
m AS (SELECT DISTINCT motif FROM p ORDER BY motif LIMIT 12),
r AS (SELECT p.*, row_number() OVER (PARTITION BY motif ORDER BY member_idx) AS place FROM p WHERE motif IN (SELECT motif FROM m))
SELECT motif, member_idx, seq FROM r WHERE place <= 30""")
def truncated(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("protein_id"), F.col("source").alias("motif"))
    members = proteins(spark, sf_dir).join(sources, "protein_id").withColumnRenamed("protein_id", "member_idx")
    return truncate_motifs(members, 12, 30).select("motif", "member_idx", "seq")
