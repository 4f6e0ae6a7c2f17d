"""Measuring approximate search results against exact ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from residua import constants as C
from residua.functions.scoring import recall_weight, recall_weight_linear


def match_truth(truth: DataFrame, found: DataFrame, keys: tuple[str, str] = ("motif", "protein")) -> DataFrame:
    """Truth rows with ``hit`` telling whether the result has the pair too."""
    present = found.select(*keys).distinct().withColumn("_found", F.lit(True))
    return truth.join(present, list(keys), "left").withColumn(
        "hit", F.coalesce("_found", F.lit(False))
    ).drop("_found")


def weighted_recall(matched: DataFrame, radius: float, linear: bool = False,
                    flat: float = C.RECALL_FLAT_DISTANCE) -> DataFrame:
    """Weights of found and missed pairs, their ratio, and the number missed.

    The weight falls with the distance: linearly, or beyond ``flat`` as the reciprocal of the excess.
    """
    d = F.col("distance")
    weight = recall_weight_linear(d) if linear else recall_weight(d, radius, flat)
    sums = matched.withColumn("_w", weight).agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("_w"))), F.lit(0.0)).alias("tp"),
        F.coalesce(F.sum(F.when(~F.col("hit"), F.col("_w"))), F.lit(0.0)).alias("fn"),
        F.count_if(~F.col("hit")).alias("n_missed"),
        F.count(F.lit(1)).alias("n_truth"),
    )
    return sums.select("*", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))


def recall_by_bin(matched: DataFrame, per_unit: float = 10.0, bins: int | None = None) -> DataFrame:
    """Share of pairs found in each distance bin, with the counts behind it; ``bins`` lists only the first ones."""
    binned = matched.withColumn("bin", F.floor(F.col("distance") * per_unit))
    if bins is not None:
        binned = binned.filter(F.col("bin") < bins)
    return binned.groupBy("bin").agg(
        F.count_if(F.col("hit")).alias("tp"), F.count_if(~F.col("hit")).alias("fn")
    ).select("bin", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("ratio"), "tp", "fn")


def count_ratio(truth: DataFrame, found: DataFrame, keys: tuple[str, str] = ("motif", "protein")) -> DataFrame:
    """Distinct pairs found over distinct pairs in the truth, whether or not they agree."""
    sides = truth.select(*keys, F.lit(1).alias("_t"), F.lit(0).alias("_f")).unionByName(
        found.select(*keys, F.lit(0).alias("_t"), F.lit(1).alias("_f"))
    )
    pairs = sides.groupBy(*keys).agg(F.max("_t").alias("_t"), F.max("_f").alias("_f"))
    return pairs.agg(
        F.sum("_t").alias("n_truth"), F.sum("_f").alias("n_found"),
        F.sum(F.col("_t") * F.col("_f")).alias("n_both"),
    ).select("*", (F.col("n_found") / F.col("n_truth")).alias("ratio"))


def sort_hits(hits: DataFrame, keys: tuple[str, str] = ("motif", "protein")) -> DataFrame:
    return hits.orderBy(*keys, "distance")
