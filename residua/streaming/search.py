"""Radius search over arriving k-mers against fixed centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from residua.functions.hashing import LshFamily, keys_array, kmer_lsh_keys, kmer_probe_keys, probe_template
from residua.functions.vectors import kmer_codes, kmer_distance_sq
from residua.operators.layout import small_enough


def stream_kmer_hits(arriving: DataFrame, centers: DataFrame, k: int, radius: float, family: LshFamily,
                     probes: int = 24) -> DataFrame:
    """(center, kmer, ..., distance) for each arriving row, stateless.

    The centres are the static side and look into ``probes`` buckets of each
    table; they are broadcast only when small enough. A pair is emitted once, in
    the first table it meets.
    """
    probes = len(probe_template(family.lines, probes))
    c = centers.select("kmer").distinct().select(F.col("kmer").alias("center"), kmer_codes(F.col("kmer")).alias("_cc"))
    c = c.withColumn("_looked", kmer_probe_keys(F.col("center"), k, family, probes))
    c = c.select("*", F.posexplode("_looked").alias("_probe", "_key")).withColumn(
        "_table", F.floor(F.col("_probe") / probes).cast("int"))
    if small_enough(c):
        c = F.broadcast(c)
    p = arriving.withColumn("_pc", kmer_codes(F.col("kmer")))
    p = p.withColumn("_pkeys", kmer_lsh_keys(F.col("kmer"), k, family))
    p = p.select("*", F.posexplode(keys_array(F.col("_pkeys"), family.tables)).alias("_table", "_key"))
    d = kmer_distance_sq(F.col("_cc"), F.col("_pc"), k)
    before = F.lit(False)
    for t in range(family.tables - 1):
        seen = F.array_contains(F.slice("_looked", t * probes + 1, probes), F.col("_pkeys")[f"k{t}"])
        before = before | ((F.col("_table") > t) & seen)
    hits = p.join(c, ["_table", "_key"]).filter(~before & (d <= radius * radius))
    return hits.select("center", *arriving.columns, F.sqrt(d).alias("distance"))
