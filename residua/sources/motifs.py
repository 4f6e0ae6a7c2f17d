"""Point, motif, search-result, alignment and annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from residua.operators.layout import join_split_hot
from residua.sources.lines import fields, fill_down, number_lines, read_lines, with_fields


def read_named_points(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, name, point): a name line, then a line of numbers, which may be empty."""
    lines = number_lines(read_lines(spark, path), trim_end=True)
    even = F.col("line_no") % 2 == 0
    rows = lines.groupBy(F.floor(F.col("line_no") / 2).alias("point_id")).agg(
        F.max(F.when(even, F.trim("value"))).alias("name"), F.max(F.when(~even, F.col("value"))).alias("_v")
    )
    values = fields(F.coalesce("_v", F.lit("")))
    return rows.select("point_id", "name", values.cast("array<double>").alias("point"))


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """(center_id, center): one vector per line, numbered by line."""
    lines = number_lines(read_lines(spark, path).filter(F.trim("value") != ""), "center_id")
    return lines.select("center_id", fields(F.col("value")).cast("array<double>").alias("center"))


def read_groups(spark: SparkSession, path: str, min_size: int = 1) -> DataFrame:
    """(motif, member_idx, seq) from ``#name`` headers; smaller groups are left out."""
    lines = number_lines(read_lines(spark, path).filter(F.trim("value") != ""))
    header = F.when(F.col("value").startswith("#"), F.struct(F.expr("substring(value, 2)").alias("motif"), "line_no"))
    filled = fill_down(lines, header, "_head").filter(~F.col("value").startswith("#") & F.col("_head").isNotNull())
    members = filled.select(
        F.col("_head.motif").alias("motif"),
        (F.col("line_no") - F.col("_head.line_no") - 1).alias("member_idx"), F.trim("value").alias("seq"),
    )
    if min_size <= 1:
        return members
    large = members.groupBy("motif").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size)
    return join_split_hot(members, large.select("motif"), ["motif"], ["member_idx"], how="left_semi")


def read_hits(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """(motif, protein, distance) per line; shorter lines fail the job unless ``lenient``."""
    return with_fields(read_lines(spark, path), 3, lenient).select(
        F.get("_fields", F.lit(0)).alias("motif"), F.get("_fields", F.lit(1)).alias("protein"),
        F.get("_fields", F.lit(2)).cast("double").alias("distance"),
    )


def read_truth_list(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """(motif, protein) from the first two fields of every line after the header line."""
    lines = with_fields(number_lines(read_lines(spark, path)).filter(F.col("line_no") > 0), 2, lenient)
    return lines.select(F.get("_fields", F.lit(0)).alias("motif"), F.get("_fields", F.lit(1)).alias("protein")).distinct()


def gf_value(line: Column, tag: str) -> Column:
    """First word after a ``#=GF`` tag, NULL on other lines."""
    return F.nullif(F.regexp_extract(line, rf"^#=GF\s+{tag}\s+(\S+)", 1), F.lit(""))


def gs_name(line: Column) -> Column:
    """Sequence name of a ``#=GS`` line, cut at the range."""
    return F.nullif(F.regexp_extract(line, r"^#=GS\s+([^/\s]+)", 1), F.lit(""))


def row_range(name: Column) -> list[Column]:
    """Name, start and stop of ``name/start-stop``."""
    pattern = r"^(.*)/(\d+)-(\d+)$"
    return [
        F.regexp_extract(name, pattern, 1).alias("seqname"),
        F.regexp_extract(name, pattern, 2).try_cast("long").alias("start"),
        F.regexp_extract(name, pattern, 3).try_cast("long").alias("stop"),
    ]


def read_stockholm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries (entry, ID, AC, DE, TP, SQ) and rows (entry, seqname, start, stop, alignment).

    An entry is known by the number of its ``# STOCKHOLM`` line. A sequence named
    twice counts once, with its first row.
    """
    lines = number_lines(read_lines(spark, path).filter(F.trim("value") != ""))
    opened = F.when(F.col("value").startswith("# STOCKHOLM"), F.col("line_no"))
    return entry_tables(fill_down(lines, opened, "entry").filter(F.col("entry").isNotNull()))


def entry_tables(inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and rows as above from the lines (entry, line_no, value) of entries; any type may name an entry."""
    v = F.col("value")
    tags = inside.filter(v.startswith("#=GF"))
    first = {tag: F.min_by(gf_value(v, tag), F.when(gf_value(v, tag).isNotNull(), F.col("line_no"))) for tag in
             ("ID", "AC", "DE", "TP", "SQ")}
    entries = tags.groupBy("entry").agg(*[expr.alias(tag) for tag, expr in first.items()])
    entries = entries.withColumn("SQ", F.col("SQ").try_cast("long"))
    rows = inside.filter(~v.startswith("#") & ~v.startswith("//"))
    columns = fields(v)
    rows = rows.select("entry", "line_no", F.get(columns, F.lit(0)).alias("_name"),
                       F.get(columns, F.lit(1)).alias("alignment"))
    rows = rows.groupBy("entry", "_name").agg(F.min_by("alignment", "line_no").alias("alignment"))
    return entries, rows.select("entry", *row_range(F.col("_name")), "alignment")


def count_mismatches(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries whose declared number of sequences differs from the rows read."""
    read = rows.groupBy("entry").agg(F.count(F.lit(1)).alias("n_read"))
    both = entries.join(read, "entry", "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))
    return both.filter(~F.col("SQ").eqNullSafe(F.col("n_read"))).select("entry", "ID", "SQ", "n_read")


def match_states(alignment: Column, length: int) -> Column:
    """First ``length`` match columns of an aligned row; NULL when short or gapped."""
    states = F.substring(F.regexp_replace(alignment, "[.a-z]+", ""), 1, length)
    return F.when((F.length(states) == length) & ~states.contains("-"), states)


def first_blocks(rows: DataFrame, order: list[str], length: int) -> DataFrame:
    """Fixed-length match-state blocks, each distinct block kept where it comes first in order."""
    cut = rows.withColumn("block", match_states(F.col("alignment"), length)).filter(F.col("block").isNotNull())
    others = [c for c in rows.columns if c != "alignment"]
    first = cut.groupBy("block").agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias("_first"))
    return first.select("block", "_first.*")


def column_blocks(rows: DataFrame, length: int, keep_one_in: int = 1, seed: int = 5) -> DataFrame:
    """Match-state blocks from every start column; columns are sampled one in ``keep_one_in``.

    The look-ahead lists, for each column, the shortest stretch that holds
    ``length`` match states; once a column has none, later ones have none either,
    so the list index is the column.
    """
    stretch = F.lit("(?=((?:[.a-z]*[^.a-z]){%d}))." % length)
    found = rows.select(
        "entry", F.posexplode(F.regexp_extract_all("alignment", stretch, F.lit(1))).alias("column", "_text")
    )
    block = F.regexp_replace("_text", "[.a-z]+", "")
    kept = F.pmod(F.xxhash64(F.lit(seed), "entry", "column"), F.lit(keep_one_in)) == 0
    return found.filter(kept).select("entry", "column", block.alias("block")).filter(~F.col("block").contains("-"))


def read_annotations(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Nine of the white-space separated columns of a gene annotation table; shorter lines fail unless ``lenient``."""
    names = ["ID", "Name", "Length", "Completeness", "GroupOrigin", "PhylumLevel", "GenusLevel",
             "KEGGAnnotation", "eggNOGAnnotation"]
    rows = with_fields(read_lines(spark, path), len(names), lenient)
    picked = [F.get("_fields", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return rows.select(*picked).withColumn("Length", F.col("Length").try_cast("long"))


def read_suffix_positions(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, pos) pairs in file order."""
    columns = fields(F.col("value"))
    lines = number_lines(read_lines(spark, path).filter(F.trim("value") != ""))
    return lines.select("line_no", F.get(columns, F.lit(0)).cast("long").alias("protein_id"),
                        F.get(columns, F.lit(1)).cast("int").alias("pos"))
