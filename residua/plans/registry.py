"""Named queries over the given tables, each with an equivalent in plain SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from residua import constants as C
from residua.functions.alphabet import clean_residues
from residua.operators.layout import spread
from residua.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/residua-{name}-{uuid.uuid4().hex}"


# the text tables read as proteins and as DNA ---------------------------------

DNA_LETTERS = "ACGT" * 5


def proteins(spark: SparkSession, sf_dir: str, source: str = "documents", key: str = "doc_id") -> DataFrame:
    """(protein_id, seq) of a text table: its letters, unknown ones replaced."""
    rows = spread(table(spark, sf_dir, source).select(F.col(key).alias("protein_id"), "text"), "protein_id")
    return rows.select("protein_id", clean_residues(F.col("text")).alias("seq"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = proteins(spark, sf_dir)
    return seqs.select(F.col("protein_id").alias("doc_id"), F.translate("seq", C.RESIDUES, DNA_LETTERS).alias("seq"))


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(point_id, label, point) of the embeddings, and their width."""
    rows = table(spark, sf_dir, "embeddings")
    least, width = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != width:
        raise ValueError(f"vectors of {least} to {width} numbers in one table")
    return rows.select(
        F.col("vec_id").alias("point_id"), "label", F.col("embedding").cast("array<double>").alias("point")
    ), width


# the same in SQL -------------------------------------------------------------

def residues_sql(text: str = "text") -> str:
    letters = f"string_split(upper(regexp_replace({text}, '[^A-Za-z]+', '', 'g')), '')"
    swap = (f"CASE WHEN c <> '' AND contains('{C.NON_RESIDUES}', c) THEN "
            f"substr('{C.RESIDUES}', CAST((ascii(c) + i - 1) % 20 + 1 AS INTEGER), 1) ELSE c END")
    return f"array_to_string(list_transform({letters}, lambda c, i: {swap}), '')"


def proteins_sql(source: str = "documents", key: str = "doc_id", name: str = "proteins") -> str:
    return f"{name} AS (SELECT {key} AS protein_id, {residues_sql()} AS seq FROM {source})"


def kmers_sql(k: int, source: str = "proteins", name: str = "kmers", seq: str = "seq", key: str = "protein_id") -> str:
    return (f"{name} AS (SELECT {key}, i - 1 AS pos, substr(s, CAST(i AS INTEGER), {k}) AS kmer FROM "
            f"(SELECT {key}, {seq} AS s, unnest(range(1, length({seq}) - {k} + 2)) AS i FROM {source}))")


def list_sql(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


POINTS_SQL = "points AS (SELECT vec_id AS point_id, label, CAST(embedding AS DOUBLE[]) AS point FROM embeddings)"

CENTERS_SQL = (
    "centers AS (SELECT label AS center_id, list(m ORDER BY i) AS center, max(n) AS size FROM "
    "(SELECT label, i, avg(point[i]) AS m, count(*) AS n FROM "
    "(SELECT label, point, unnest(range(1, len(point) + 1)) AS i FROM points) GROUP BY label, i) GROUP BY label)"
)


def matrix_sql(rows) -> str:
    """A 20 x 20 table as one flat list, indexed (a - 1) * 20 + b."""
    return "[" + ", ".join(repr(x) for row in rows for x in row) + "]"


def pair_sum_sql(a: str, b: str, rows, k: int) -> str:
    index = f"strpos('{C.RESIDUES}', substr({{}}, CAST(i AS INTEGER), 1))"
    cell = f"({index.format(a)} - 1) * 20 + {index.format(b)}"
    return f"list_sum(list_transform(range(1, {k + 1}), lambda i: {matrix_sql(rows)}[{cell}]))"
