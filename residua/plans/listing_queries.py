"""Alignment dumps, blocks, coordinates and reports: written, read back, compared line by line or field by field."""

from __future__ import annotations

from pyspark.sql import functions as F

from residua import constants as C
from residua.functions.vectors import point_at
from residua.operators import evaluate as E, kmers as K, search as S
from residua.plans import search_queries  # noqa: F401  (its SQL is read below)
from residua.plans.file_queries import _listed
from residua.plans.format_queries import _alignment
from residua.plans.kmer_queries import COORDINATES_SQL
from residua.plans.registry import ORACLES, POINTS_SQL, QUERIES, kmers_sql, points, proteins, proteins_sql, query, scratch_path, table
from residua.sinks import text as T
from residua.sources import motifs as M
from residua.sources.lines import fields, read_lines


def _entries(spark, sf_dir):
    """Documents as alignments, their sources as entries; sources of one digit are motifs, others declare a row too many."""
    rows = _alignment(spark, sf_dir).withColumn("entry", F.col("source"))
    motif = F.length("entry") == 4
    entries = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("SQ")).select(
        "entry", F.concat(F.lit("id_"), "entry").alias("ID"), F.concat(F.lit("AC_"), "entry").alias("AC"),
        F.lit("documents").alias("DE"), F.when(motif, "Motif").otherwise("Family").alias("TP"),
        (F.col("SQ") + (~motif).cast("long")).alias("SQ"))
    return entries, rows.select("entry", "seqname", "start", "stop", "alignment")


_ENTRIES_SQL = """
a AS (SELECT source AS entry, concat('q-', doc_id) AS seqname, 3 AS start, n_chars AS stop, concat('.', regexp_replace(text, '[^A-Za-z]+', '.', 'g')) AS alignment FROM documents),
e AS (SELECT entry, count(*) AS n, count(*) + CASE WHEN length(entry) = 4 THEN 0 ELSE 1 END AS sq, CASE WHEN length(entry) = 4 THEN 'Motif' ELSE 'Family' END AS tp FROM a GROUP BY entry)"""


def _dump_sql(layout: str) -> str:
    entries = "e WHERE tp = 'Motif'" if layout == "motifs" else "e"
    rows = {"full": "TRUE", "no_gaps": "NOT regexp_matches(alignment, '[a-z]')", "motifs": "length(entry) = 4"}[layout]
    last = ", alignment" if layout == "full" else ""
    wide = "CASE WHEN length({0}::VARCHAR) < 8 THEN lpad({0}::VARCHAR, 8, ' ') ELSE {0}::VARCHAR END"
    return f"""
WITH {_ENTRIES_SQL}, l AS (
  SELECT entry, 0 AS part, '' AS seqname, unnest([0, 1, 2, 3, 4]) AS n, unnest([concat('ID: id_', entry), concat('AC: AC_', entry), 'DE: documents', concat('TP: ', tp), concat('SQ: ', sq)]) AS value FROM {entries}
  UNION ALL SELECT entry, 1, seqname, 0, concat_ws(chr(9), CASE WHEN length(seqname) < 20 THEN rpad(seqname, 20, ' ') ELSE seqname END,
    {wide.format("start")}, {wide.format("stop")}, regexp_replace(alignment, '[.a-z]+', '', 'g'){last}) FROM a WHERE {rows}
  UNION ALL SELECT entry, 2, '', 0, '-----------------END----------------' FROM {entries})
SELECT row_number() OVER (ORDER BY entry, part, seqname, n) - 1 AS line_no, value FROM l"""


def _add_dump(layout: str) -> None:
    @query(f"{layout}_dump_listing", _dump_sql(layout))
    def dump(spark, sf_dir):
        return _listed(T.entry_dump_lines(*_entries(spark, sf_dir), layout), f"{layout}-dump")


for _layout in ("full", "no_gaps", "motifs"):
    _add_dump(_layout)


@query("fixed_block_listing", f"""
WITH {_ENTRIES_SQL}, b AS (SELECT entry, seqname, substr(regexp_replace(alignment, '[.a-z]+', '', 'g'), 1, 4) AS block FROM a),
f AS (SELECT min(entry) AS entry, block FROM b WHERE length(block) = 4 GROUP BY block),
l AS (SELECT DISTINCT entry, 0 AS part, concat('#ID:id_', entry, '#AC:AC_', entry) AS value FROM f UNION ALL SELECT entry, 1, block FROM f)
SELECT row_number() OVER (ORDER BY entry, part, value) - 1 AS line_no, value FROM l""")
def fixed_block_listing(spark, sf_dir):
    """Each block of four match states under the first entry that holds it."""
    entries, rows = _entries(spark, sf_dir)
    blocks = M.first_blocks(rows, ["entry", "seqname"], 4)
    return _listed(T.block_lines(blocks, entries), "blocks")


@query("declared_counts", f"""
WITH {_ENTRIES_SQL} SELECT concat('id_', entry) AS "ID", CAST(sq AS BIGINT) AS "SQ", n AS n_read FROM e WHERE n <> sq""")
def declared_counts(spark, sf_dir):
    """Entries of a Stockholm file that declare another number of rows than they hold."""
    path = scratch_path(spark, "declared")
    T.write_lines(T.stockholm_lines(*_entries(spark, sf_dir)), path)
    return M.count_mismatches(*M.read_stockholm(spark, path)).select("ID", "SQ", "n_read")


@query("column_blocks", """
WITH a AS (SELECT item_id AS entry, concat(regexp_replace(text, '[^A-Za-z]+', '.', 'g'), 'ACDE') AS alignment FROM benchmark),
c AS (SELECT entry, alignment, unnest(range(0, length(alignment))) AS "column" FROM a),
b AS (SELECT entry, "column", substr(regexp_replace(substr(alignment, CAST("column" + 1 AS INTEGER)), '[.a-z]+', '', 'g'), 1, 4) AS block FROM c)
SELECT entry, "column", block FROM b WHERE length(block) = 4""")
def column_blocks(spark, sf_dir):
    """Blocks of four match states from every column of the items."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), F.concat(
        F.regexp_replace("text", "[^A-Za-z]+", "."), F.lit("ACDE")).alias("alignment"))
    return M.column_blocks(rows, 4).withColumn("column", F.col("column").cast("long"))


@query("coordinate_listing", f"""
WITH {proteins_sql("benchmark", "item_id")}, {kmers_sql(10)}, d AS (SELECT DISTINCT kmer FROM kmers),
c AS (SELECT kmer, unnest(range(0, 80)) AS dim FROM d),
v AS (SELECT kmer, dim, {COORDINATES_SQL}[strpos('{C.RESIDUES}', substr(kmer, CAST(dim // 8 + 1 AS INTEGER), 1))][dim % 8 + 1] AS x FROM c)
SELECT CAST(80 AS BIGINT) AS n_fields, round(sum(x), 6) AS total, round(sum(x * (dim + 1)), 6) AS weighted FROM v GROUP BY kmer""")
def coordinate_listing(spark, sf_dir):
    """Tab-separated coordinates of all k-mers, summed up plainly and by column after reading."""
    distinct = K.explode_kmers(proteins(spark, sf_dir, "benchmark", "item_id"), 10).select("kmer").distinct()
    path = scratch_path(spark, "coordinates")
    T.write_lines(T.coordinate_rows(distinct), path)
    values = fields(F.col("value")).cast("array<double>")
    read = read_lines(spark, path).select(values.alias("x"))

    def total(of):
        return F.round(F.aggregate(of, F.lit(0.0), lambda s, x: s + x), 6)

    return read.select(F.size("x").cast("long").alias("n_fields"), total(F.col("x")).alias("total"),
                       total(F.transform("x", lambda x, i: x * (i + 1))).alias("weighted"))


@query("placed_points", f"""
WITH {proteins_sql()}, p AS (SELECT protein_id, seq, length(seq) // 2 AS pos FROM proteins WHERE length(seq) >= 12),
c AS (SELECT protein_id, pos, substr(seq, CAST(pos + 1 AS INTEGER), 3) AS kmer, unnest(range(0, 24)) AS dim FROM p)
SELECT protein_id, CAST(pos AS BIGINT) AS pos, dim, {COORDINATES_SQL}[strpos('{C.RESIDUES}', substr(kmer, CAST(dim // 8 + 1 AS INTEGER), 1))][dim % 8 + 1] AS coordinate FROM c""")
def placed_points(spark, sf_dir):
    """The point of the 3-mer in the middle of each protein, cut out by position."""
    placed = proteins(spark, sf_dir).filter(F.length("seq") >= 12).withColumn("pos", F.floor(F.length("seq") / 2))
    rows = placed.select("protein_id", "pos", F.posexplode(point_at(F.col("seq"), F.col("pos").cast("int"), 3)).alias("dim", "coordinate"))
    return rows.withColumn("dim", F.col("dim").cast("long"))


@query("accuracy_listing", ORACLES["recall_by_bin"])
def accuracy_listing(spark, sf_dir):
    """The accuracy report, its three layouts read back into bins."""
    path = scratch_path(spark, "accuracy")
    T.write_lines(T.accuracy_lines(QUERIES["recall_by_bin"](spark, sf_dir)), path, ["bin"])
    part = fields(F.col("value"))
    read = read_lines(spark, path).select(part.alias("f"))
    second, third, last = (F.get("f", F.lit(i)) for i in (1, 2, 3))
    one_kind = F.coalesce(third.isin("tp", "fn"), F.lit(False))
    return read.select(
        F.get("f", F.lit(0)).cast("long").alias("bin"), second.cast("double").alias("ratio"),
        F.when(third == "fn", "0").when(one_kind, last).otherwise(third).cast("long").alias("tp"),
        F.when(third == "tp", "0").otherwise(last).cast("long").alias("fn"))


@query("sorted_hits", f"""
WITH {POINTS_SQL}, h AS (SELECT concat('m', a.point_id) AS motif, concat('p', b.point_id) AS protein, list_distance(a.point, b.point) AS d
  FROM points a, points b WHERE a.point_id % 100 = 0 AND list_distance(a.point, b.point) <= 1.0)
SELECT row_number() OVER (ORDER BY motif, protein) - 1 AS line_no, concat(motif, ' ', protein) AS value, round(d, 6) AS distance FROM h""")
def sorted_hits(spark, sf_dir):
    """Hits of every hundredth point, a stated query set, against all points, sorted by both names over all files."""
    rows, dim = points(spark, sf_dir)
    asked = rows.filter(F.col("point_id") % 100 == 0).select(F.col("point_id").alias("center_id"), F.col("point").alias("center"))
    hits = S.radius_exact(asked, rows, dim, 1.0).select(
        F.concat(F.lit("m"), "center_id").alias("motif"), F.concat(F.lit("p"), "point_id").alias("protein"), "distance")
    lines = _listed(T.hit_lines(E.sort_hits(hits)), "sorted-hits", ["motif", "protein"])
    return lines.select("line_no", F.regexp_extract("value", r"^(\S+ \S+)", 1).alias("value"),
                        F.round(F.regexp_extract("value", r"(\S+)$", 1).cast("double"), 6).alias("distance"))
