"""Radius search, nearest centres, recall and centroids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from residua import constants as C
from residua.functions.hashing import LshFamily, line_bucket, probe_template
from residua.functions.vectors import dot
from residua.operators import evaluate as E, groups as G, kmers as K, search as S
from residua.plans.registry import (
    CENTERS_SQL, POINTS_SQL, kmers_sql, list_sql, matrix_sql, points, proteins, proteins_sql, query,
)

RADIUS = 0.98
LSH = LshFamily(dim=64, lines=4, tables=6, width=2.0)
KMER_K = 10
KMER_RADIUS = 5.0
KMER_LSH = LshFamily(dim=8 * KMER_K, lines=16, tables=2, width=40.0)
KMER_PROBES = 24


def _centers(spark, sf_dir):
    rows, dim = points(spark, sf_dir)
    centers = G.centroids(rows, "label", dim).select(F.col("label").alias("center_id"), "center", "size")
    return centers, rows, dim


def _family(dim: int) -> LshFamily:
    return LshFamily(dim=dim, lines=LSH.lines, tables=LSH.tables, width=LSH.width)


_BOTH = f"{POINTS_SQL}, {CENTERS_SQL}"
_DISTANCES = f"""{_BOTH}, measured AS (
  SELECT center_id, point_id, list_distance(center, point) AS distance FROM centers, points)"""


@query("radius_exact", f"""
WITH {_DISTANCES} SELECT CAST(center_id AS BIGINT) AS center_id, point_id, round(distance, 6) AS distance
FROM measured WHERE distance <= {RADIUS}""")
def radius_exact(spark, sf_dir):
    centers, rows, dim = _centers(spark, sf_dir)
    hits = S.radius_exact(centers, rows, dim, RADIUS)
    return hits.select(F.col("center_id").cast("long").alias("center_id"), "point_id",
                       F.round("distance", 6).alias("distance"))


@query("radius_split", f"""
WITH {_DISTANCES}, near AS (SELECT * FROM measured WHERE distance <= 1.0)
SELECT CAST(center_id AS BIGINT) AS center_id, count(*) FILTER (distance <= {RADIUS}) AS n_near,
       count(*) FILTER (distance > {RADIUS}) AS n_far FROM near GROUP BY center_id""")
def radius_split(spark, sf_dir):
    centers, rows, dim = _centers(spark, sf_dir)
    near, far = S.split_by_radius(S.radius_exact(centers, rows, dim, 1.0), RADIUS)
    sides = near.select("center_id", F.lit(1).alias("n"), F.lit(0).alias("f")).unionByName(
        far.select("center_id", F.lit(0).alias("n"), F.lit(1).alias("f")))
    return sides.groupBy(F.col("center_id").cast("long").alias("center_id")).agg(
        F.sum("n").alias("n_near"), F.sum("f").alias("n_far"))


def _keys_sql(vector: str) -> str:
    a, b = LSH.directions(), LSH.offsets()
    keys = []
    for t in range(LSH.tables):
        lines = ", '_', ".join(
            f"CAST(floor((list_dot_product({vector}, {list_sql(a[t, j])}) + {float(b[t, j])!r}) / {LSH.width!r}) AS BIGINT)"
            for j in range(LSH.lines))
        keys.append(f"concat({lines})")
    return "[" + ", ".join(keys) + "]"


_MET = " OR ".join(f"ck[{t}] = pk[{t}]" for t in range(1, LSH.tables + 1))
_LSH_SQL = f"""{_BOTH}, ckeys AS (SELECT center_id, center, {_keys_sql('center')} AS ck FROM centers),
pkeys AS (SELECT point_id, point, {_keys_sql('point')} AS pk FROM points),
found AS (SELECT center_id, point_id, list_distance(center, point) AS distance FROM ckeys, pkeys WHERE {_MET}),
hits AS (SELECT * FROM found WHERE distance <= {RADIUS})"""


@query("radius_lsh", f"""
WITH {_LSH_SQL} SELECT CAST(center_id AS BIGINT) AS center_id, point_id, round(distance, 6) AS distance FROM hits""")
def radius_lsh(spark, sf_dir):
    centers, rows, dim = _centers(spark, sf_dir)
    hits = S.radius_lsh(centers, rows, RADIUS, _family(dim))
    return hits.select(F.col("center_id").cast("long").alias("center_id"), "point_id",
                       F.round("distance", 6).alias("distance"))


@query("nearest_center", f"""
WITH {_LSH_SQL}, best AS (SELECT point_id, min(struct_pack(d := distance, c := center_id)) AS b FROM hits GROUP BY point_id)
SELECT point_id, CAST(b.c AS BIGINT) AS center_id, round(b.d, 6) AS distance FROM best""")
def nearest_center(spark, sf_dir):
    centers, rows, dim = _centers(spark, sf_dir)
    best = S.nearest_center(S.radius_lsh(centers, rows, RADIUS, _family(dim)))
    return best.select("point_id", F.col("center_id").cast("long").alias("center_id"),
                       F.round("distance", 6).alias("distance"))


_TRUTH_SQL = f"""{_LSH_SQL}, exact AS (
  SELECT center_id, point_id, list_distance(center, point) AS distance FROM centers, points
  WHERE list_distance(center, point) <= {RADIUS}),
matched AS (SELECT e.*, h.point_id IS NOT NULL AS hit FROM exact e LEFT JOIN hits h
  ON e.center_id = h.center_id AND e.point_id = h.point_id)"""

_PAIR = ("center_id", "point_id")


def _truth_and_found(spark, sf_dir):
    centers, rows, dim = _centers(spark, sf_dir)
    return S.radius_exact(centers, rows, dim, RADIUS), S.radius_lsh(centers, rows, RADIUS, _family(dim))


@query("lsh_recall", f"""
WITH {_TRUTH_SQL}, s AS (
  SELECT COALESCE(sum(1 - distance / 98.76) FILTER (hit), 0) AS tp, COALESCE(sum(1 - distance / 98.76) FILTER (NOT hit), 0) AS fn,
         count(*) FILTER (NOT hit) AS n_missed, count(*) AS n_truth FROM matched)
SELECT round(tp, 6) AS tp, round(fn, 6) AS fn, n_missed, n_truth, round(tp / (tp + fn), 6) AS recall FROM s""")
def lsh_recall(spark, sf_dir):
    matched = E.match_truth(*_truth_and_found(spark, sf_dir), keys=_PAIR)
    rows = E.weighted_recall(matched, RADIUS, linear=True)
    return rows.withColumns({c: F.round(c, 6) for c in ("tp", "fn", "recall")})


# units of the recall query in which the reciprocal weight is not flat
_RECIPROCAL_UNIT = 40.0


@query("reciprocal_recall", f"""
WITH {_TRUTH_SQL}, w AS (SELECT hit, CASE WHEN d <= {C.RECALL_FLAT_DISTANCE!r} THEN 1 ELSE least(1, 1 / (d - {C.RECALL_FLAT_DISTANCE!r})) END AS w
  FROM (SELECT hit, distance * {_RECIPROCAL_UNIT!r} AS d FROM matched)),
s AS (SELECT COALESCE(sum(w) FILTER (hit), 0) AS tp, COALESCE(sum(w) FILTER (NOT hit), 0) AS fn,
      count(*) FILTER (NOT hit) AS n_missed, count(*) AS n_truth FROM w)
SELECT round(tp, 6) AS tp, round(fn, 6) AS fn, n_missed, n_truth, round(tp / (tp + fn), 6) AS recall FROM s""")
def reciprocal_recall(spark, sf_dir):
    matched = E.match_truth(*_truth_and_found(spark, sf_dir), keys=_PAIR)
    rows = E.weighted_recall(matched.withColumn("distance", F.col("distance") * _RECIPROCAL_UNIT), RADIUS * _RECIPROCAL_UNIT)
    return rows.withColumns({c: F.round(c, 6) for c in ("tp", "fn", "recall")})

@query("recall_by_bin", f"""
WITH {_TRUTH_SQL}, b AS (SELECT CAST(floor(distance * 500) AS BIGINT) AS bin, hit FROM matched)
SELECT bin, round(count(*) FILTER (hit) / count(*), 9) AS ratio, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn
FROM b GROUP BY bin""")
def recall_by_bin(spark, sf_dir):
    matched = E.match_truth(*_truth_and_found(spark, sf_dir), keys=_PAIR)
    return E.recall_by_bin(matched, per_unit=500.0).withColumn("ratio", F.round("ratio", 9))


@query("count_ratio", f"""
WITH {_TRUTH_SQL} SELECT (SELECT count(*) FROM exact) AS n_truth, (SELECT count(*) FROM hits) AS n_found,
  (SELECT count(*) FROM matched WHERE hit) AS n_both, round((SELECT count(*) FROM hits) / (SELECT count(*) FROM exact), 9) AS ratio""")
def count_ratio(spark, sf_dir):
    return E.count_ratio(*_truth_and_found(spark, sf_dir), keys=_PAIR).withColumn("ratio", F.round("ratio", 9))


@query("centroid", f"""
WITH {_BOTH}, e AS (SELECT center_id, size, center, unnest(range(0, len(center))) AS dim FROM centers)
SELECT CAST(center_id AS BIGINT) AS center_id, size, dim, round(center[dim + 1], 6) AS value FROM e""")
def centroid(spark, sf_dir):
    centers, _, _ = _centers(spark, sf_dir)
    rows = centers.select(F.col("center_id").cast("long").alias("center_id"), "size",
                          F.posexplode("center").alias("dim", "value"))
    return rows.withColumns({"dim": F.col("dim").cast("long"), "value": F.round("value", 6)})


@query("cluster_radius", f"""
WITH {_BOTH} SELECT CAST(label AS BIGINT) AS label, round(max(list_distance(center, point)), 6) AS radius
FROM points JOIN centers ON label = center_id GROUP BY label""")
def cluster_radius(spark, sf_dir):
    rows, dim = points(spark, sf_dir)
    radii = G.cluster_radius(rows, G.centroids(rows, "label", dim), "label")
    return radii.select(F.col("label").cast("long").alias("label"), F.round("radius", 6).alias("radius"))


@query("mean_pair_distance", f"""
WITH {POINTS_SQL}, pairs AS (
  SELECT a.label, list_distance(a.point, b.point) AS d FROM points a JOIN points b ON a.label = b.label AND a.point_id < b.point_id),
n AS (SELECT label, count(*) AS size FROM points GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, any_value(size) AS size, round(avg(d * d), 6) AS mean_sq FROM pairs JOIN n USING (label) GROUP BY label""")
def mean_pair_distance(spark, sf_dir):
    rows, dim = points(spark, sf_dir)
    return G.mean_pair_distance_sq(rows, "label", dim).select(
        F.col("label").cast("long").alias("label"), "size", F.round("mean_sq", 6).alias("mean_sq"))


@query("center_pairs", f"""
WITH {_BOTH} SELECT CAST(a.center_id AS BIGINT) AS id_a, CAST(b.center_id AS BIGINT) AS id_b,
  round(list_distance(a.center, b.center), 6) AS distance FROM centers a JOIN centers b ON a.center_id < b.center_id
WHERE list_distance(a.center, b.center) <= 1.0""")
def center_pairs(spark, sf_dir):
    centers, _, dim = _centers(spark, sf_dir)
    pairs = S.pairs_within(centers.select(F.col("center_id").cast("long").alias("point_id"),
                                          F.col("center").alias("point")), dim, 1.0)
    return pairs.withColumn("distance", F.round("distance", 6))


@query("lsh_lines", f"""
WITH {POINTS_SQL} SELECT point_id,
  {', '.join(f"CAST(floor((list_dot_product(point, {list_sql(LSH.directions()[0, j])}) + {float(LSH.offsets()[0, j])!r}) / {LSH.width!r}) AS BIGINT) AS line_{j}" for j in range(LSH.lines))},
  round(list_dot_product(point, point), 6) AS norm_sq FROM points""")
def lsh_lines(spark, sf_dir):
    rows, dim = points(spark, sf_dir)
    family = _family(dim)
    a, b = family.directions(), family.offsets()
    return rows.select("point_id", *[
        line_bucket(F.col("point"), a[0, j], b[0, j], family.width).alias(f"line_{j}") for j in range(family.lines)
    ], F.round(dot(F.col("point"), F.col("point")), 6).alias("norm_sq"))


# k-mers of the benchmark texts searched in the k-mers of the documents --------

def _kmer_sides(spark, sf_dir):
    probes = K.explode_kmers(proteins(spark, sf_dir, "benchmark", "item_id"), KMER_K)
    return probes, K.explode_kmers(proteins(spark, sf_dir), KMER_K)


def _kmer_sides_sql() -> str:
    return (f"{proteins_sql()}, {proteins_sql('benchmark', 'item_id', 'items')}, "
            f"{kmers_sql(KMER_K)}, {kmers_sql(KMER_K, 'items', 'probes')}, "
            "p AS MATERIALIZED (SELECT DISTINCT kmer FROM kmers), c AS MATERIALIZED (SELECT DISTINCT kmer AS center FROM probes)")


def _square_sql(a: str, b: str) -> str:
    index = f"strpos('{C.RESIDUES}', substr({{}}, {{}}, 1))"
    cells = [f"({index.format(a, i)} - 1) * 20 + {index.format(b, i)}" for i in range(1, KMER_K + 1)]
    return " + ".join(f"m[{cell}]" for cell in cells)


_CELLS = f"cells AS (SELECT {matrix_sql(C.COORDINATE_DISTANCE_SQ)}::DOUBLE[] AS m)"


@query("kmer_radius_exact", f"""
WITH {_kmer_sides_sql()}, {_CELLS},
met AS (SELECT center, kmer FROM c JOIN p ON substr(center, 1, 3) = substr(kmer, 1, 3)
  UNION SELECT center, kmer FROM c JOIN p ON substr(center, 4, 4) = substr(kmer, 4, 4)
  UNION SELECT center, kmer FROM c JOIN p ON substr(center, 8, 3) = substr(kmer, 8, 3)),
d AS (SELECT center, kmer, {_square_sql('center', 'kmer')} AS sq FROM met, cells)
SELECT center, kmer, round(sqrt(sq), 6) AS distance FROM d WHERE sq <= {KMER_RADIUS ** 2}""")
def kmer_radius_exact(spark, sf_dir):
    probes, database = _kmer_sides(spark, sf_dir)
    return S.kmer_radius_exact(probes, database, KMER_K, KMER_RADIUS).withColumn("distance", F.round("distance", 6))


def _kmer_parts_sql() -> str:
    """One row of lists: for each projection, a number per position and residue."""
    a = KMER_LSH.directions().reshape(-1, KMER_K, 8)
    coordinates = np.array([C.COORDINATES[r] for r in C.RESIDUES])
    parts = np.einsum("pkc,rc->pkr", a, coordinates)
    lists = ", ".join(f"{list_sql(parts[j].reshape(-1))} AS v{j}" for j in range(len(parts)))
    return f"parts AS (SELECT {lists})"


def _kmer_lists_sql(source: str, col: str) -> str:
    """For each k-mer a list per table: its projections in units of the width."""
    b = KMER_LSH.offsets().reshape(-1)
    sums = [f"({' + '.join(f'v{j}[c{i}]' for i in range(KMER_K))} + {float(b[j])!r}) / {KMER_LSH.width!r}" for j in range(len(b))]
    n = KMER_LSH.lines
    lists = ", ".join(f"[{', '.join(sums[t * n:t * n + n])}] AS x{t}" for t in range(KMER_LSH.tables))
    codes = ", ".join(
        f"{20 * i} + strpos('{C.RESIDUES}', substr({col}, {i + 1}, 1)) AS c{i}" for i in range(KMER_K))
    return f"SELECT {col}, {lists} FROM (SELECT {col}, {codes} FROM {source}) s, parts"


def _kmer_keys_sql() -> str:
    """Buckets of the k-mers; those a centre looks into, by the ranks of its borders."""
    n, tables = KMER_LSH.lines, range(KMER_LSH.tables)
    floors = ", ".join(f"list_transform(x{t}, lambda v: CAST(floor(v) AS SMALLINT)) AS k{t}" for t in tables)
    sides = " UNION ALL ".join(f"SELECT center, {t} AS t, x{t} AS x FROM cx" for t in tables)
    ranks = ", ".join(f"[{', '.join(str(r + 1) for r in s)}]::INTEGER[]" for s in probe_template(n, KMER_PROBES))
    border = lambda d, s: f"list_transform(range(1, {n + 1}), lambda j: struct_pack(d := {d}, j := j, s := {s}))"
    return (f"ph AS MATERIALIZED (SELECT kmer, {floors} FROM ({_kmer_lists_sql('p', 'kmer')})), "
            f"cx AS MATERIALIZED ({_kmer_lists_sql('c', 'center')}), "
            f"cz AS (SELECT *, list_sort(list_concat({border('x[j] - floor(x[j])', -1)}, {border('floor(x[j]) + 1 - x[j]', 1)})) AS z FROM ({sides})), "
            f"ch AS MATERIALIZED (SELECT center, t, list_transform(range(1, {n + 1}), lambda j: CAST(floor(x[j]) + coalesce(list_sum("
            f"list_transform(list_filter(ranks, lambda r: z[r].j = j), lambda r: z[r].s)), 0) AS SMALLINT)) AS k "
            f"FROM cz, (SELECT unnest([{ranks}]) AS ranks))")


def _kmer_met_sql() -> str:
    unions = [f"SELECT center, kmer FROM ch JOIN ph ON t = {t} AND k = k{t}" for t in range(KMER_LSH.tables)]
    return "met AS (" + " UNION ".join(unions) + ")"


@query("kmer_radius_lsh", f"""
WITH {_kmer_sides_sql()}, {_CELLS}, {_kmer_parts_sql()}, {_kmer_keys_sql()},
{_kmer_met_sql()}, d AS (SELECT center, kmer, {_square_sql('center', 'kmer')} AS sq FROM met, cells)
SELECT center, kmer, round(sqrt(sq), 6) AS distance FROM d WHERE sq <= {KMER_RADIUS ** 2}""")
def kmer_radius_lsh(spark, sf_dir):
    probes, database = _kmer_sides(spark, sf_dir)
    hits = S.kmer_radius_lsh(probes, database, KMER_K, KMER_RADIUS, KMER_LSH, KMER_PROBES)
    return hits.withColumn("distance", F.round("distance", 6))


@query("located_hits", f"""
WITH {_kmer_sides_sql()}, {_CELLS},
met AS (SELECT center, kmer FROM c JOIN p ON substr(center, 1, 3) = substr(kmer, 1, 3)
  UNION SELECT center, kmer FROM c JOIN p ON substr(center, 4, 4) = substr(kmer, 4, 4)
  UNION SELECT center, kmer FROM c JOIN p ON substr(center, 8, 3) = substr(kmer, 8, 3)),
d AS (SELECT center, kmer, {_square_sql('center', 'kmer')} AS sq FROM met, cells),
h AS (SELECT center, kmer, sqrt(sq) AS distance FROM d WHERE sq <= {KMER_RADIUS ** 2})
SELECT k.protein_id, count(*) AS n_hits, round(min(distance), 6) AS nearest, count(DISTINCT center) AS n_centers
FROM kmers k JOIN h USING (kmer) GROUP BY k.protein_id""")
def located_hits(spark, sf_dir):
    probes, database = _kmer_sides(spark, sf_dir)
    per = S.kmer_radius_exact(probes, database, KMER_K, KMER_RADIUS, located=True).groupBy("protein_id", "center").agg(
        F.count(F.lit(1)).alias("n"), F.min("distance").alias("d"))
    return per.groupBy("protein_id").agg(F.sum("n").alias("n_hits"), F.round(F.min("d"), 6).alias("nearest"),
                                         F.count(F.lit(1)).alias("n_centers"))
