"""Sequence files: FASTA, k-mer FASTA, FASTQ, PRB, mapped reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from residua.functions.alphabet import clean_residues
from residua.functions.quality import sniff_kind, string_scores
from residua.sources.lines import fields, number_lines, read_lines, with_fields


def read_fasta(spark: SparkSession, path: str | list[str], kind: str = "protein", full_name: bool = False,
               unknown: str = "cycle", keep_empty: bool = True, suffix: str | None = None,
               id_col: str = "protein_id") -> DataFrame:
    """(id, name, seq, length): one row per record, sequences over any number of lines.

    The name ends at the first blank unless ``full_name``. ``protein`` sequences
    are cleaned to residues; ``dna`` ones are upper-cased.
    """
    records = read_lines(spark, path, "\n>", suffix)
    parts = F.split(F.regexp_replace("value", r"^\s*>", ""), "\n", 2)
    header, body = F.trim(F.get(parts, F.lit(0))), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    name = header if full_name else F.regexp_extract(header, r"^(\S*)", 1)
    if kind == "protein":
        seq = clean_residues(body, unknown)
    elif kind == "dna":
        seq = F.upper(F.regexp_replace(body, r"\s+", ""))
    else:
        raise ValueError("kind must be protein or dna")
    parsed = records.filter(F.trim("value") != "").select(
        "_file", "_start", "_mid", name.alias("name"), seq.alias("seq")
    )
    if not keep_empty:
        parsed = parsed.filter("seq <> ''")
    numbered = number_lines(parsed, id_col)
    return numbered.select(id_col, "name", "seq", F.length("seq").alias("length"))


def fetch_fasta(spark: SparkSession, path: str, target: str, kind: str = "protein") -> DataFrame:
    """The first record with a given name."""
    named = read_fasta(spark, path, kind).filter(F.col("name") == target)
    return named.orderBy("protein_id").limit(1)


def read_kmer_fasta(spark: SparkSession, path: str, keep_mark: bool = False) -> DataFrame:
    """(kmer_id, name, seq) of a file with one k-mer per record; names may keep their > mark."""
    rows = read_fasta(spark, path, id_col="kmer_id", keep_empty=False)
    name = F.concat(F.lit(">"), F.col("name")) if keep_mark else F.col("name")
    return rows.select("kmer_id", name.alias("name"), "seq")


def read_two_line_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(protein_id, name, seq, well_formed) where name and peptide lines must alternate; a peptide may be empty."""
    lines = number_lines(read_lines(spark, path), trim_end=True)
    pair = F.floor(F.col("line_no") / 2)
    even = F.col("line_no") % 2 == 0
    rows = lines.groupBy(pair.alias("protein_id")).agg(
        F.max(F.when(even, F.col("value"))).alias("_name"), F.coalesce(F.max(F.when(~even, F.col("value"))), F.lit("")).alias("seq")
    )
    good = F.col("_name").startswith(">") & ~F.coalesce(F.col("seq").startswith(">"), F.lit(True))
    return rows.select("protein_id", F.regexp_replace("_name", "^>", "").alias("name"), "seq",
                       good.alias("well_formed"))


def read_fastq(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """(read_id, name, seq, qual) from four-line records; wrong markers fail the job when strict.

    Every line counts, so reads may be empty; only blank lines at the end of a file do not, of which
    one may be the quality line of an empty read.
    """
    lines = number_lines(read_lines(spark, path), trim_end=True)
    place = F.col("line_no") % 4

    def line(i: int) -> Column:
        return F.max(F.when(place == i, F.col("value")))

    rows = lines.groupBy(F.floor(F.col("line_no") / 4).alias("read_id")).agg(
        line(0).alias("_name"), line(1).alias("seq"), line(2).alias("_plus"), F.coalesce(line(3), F.lit("")).alias("qual")
    )
    good = F.col("_name").startswith("@") & F.col("_plus").startswith("+") & (
        F.length("seq") == F.length("qual")
    )
    name = F.regexp_replace("_name", "^@", "")
    if strict:
        problem = F.raise_error(F.concat(F.lit("malformed FASTQ record "), F.col("read_id")))
        name = F.when(F.coalesce(good, F.lit(False)), name).otherwise(problem.cast("string"))
    return rows.select("read_id", name.alias("name"), "seq", "qual")


def quality_kind(reads: DataFrame, quality: str = "qual") -> DataFrame:
    """One row with the encoding that fits every quality character."""
    letters = F.filter(F.split(quality, ""), lambda c: c != "")
    codes = reads.select(F.transform(letters, lambda c: F.ascii(c)).alias("_codes"))
    limits = codes.agg(F.min(F.array_min("_codes")).alias("lowest"), F.max(F.array_max("_codes")).alias("highest"))
    return limits.select("lowest", "highest", sniff_kind(F.col("lowest"), F.col("highest")).alias("kind"))


def with_scores(reads: DataFrame) -> DataFrame:
    """Reads with numeric scores; the encoding is inferred from all of them."""
    kind = quality_kind(reads).select("kind").scalar()
    scores = F.when(kind == "solexa", string_scores(F.col("qual"), "solexa")).otherwise(
        string_scores(F.col("qual"), "phred")
    )
    return reads.withColumn("scores", scores)


def is_fastq(spark: SparkSession, path: str) -> bool:
    """Whether the first visible character of a file is @."""
    first = read_lines(spark, path).filter(F.trim("value") != "").orderBy("_file", "_start", "_mid").limit(1)
    row = first.select(F.trim("value").startswith("@").alias("y")).first()
    return bool(row and row.y)


def read_prb(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, scores): four numbers per base; other line lengths fail the job."""
    lines = number_lines(read_lines(spark, path).filter(F.trim("value") != ""), "read_id")
    numbers = fields(F.col("value")).cast("array<double>")
    whole = F.when(F.size(numbers) % 4 == 0, numbers).otherwise(
        F.raise_error(F.lit("PRB line is not a multiple of four")).cast("array<double>")
    )
    quads = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(whole) / 4).cast("int") - 1), lambda i: F.slice(whole, i * 4 + 1, F.lit(4))
    )
    return lines.select("read_id", quads.alias("scores"))


def read_mapped_reads(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """(qual) from the eighth column of a mapped-reads file; shorter lines fail the job unless ``lenient``."""
    return with_fields(read_lines(spark, path), 8, lenient).select(F.get("_fields", F.lit(7)).alias("qual"))


def line_roles(lines: DataFrame) -> DataFrame:
    """Role of each numbered FASTQ line: name, sequence, score_name or score."""
    role = F.element_at(
        F.array(*[F.lit(x) for x in ("name", "sequence", "score_name", "score")]),
        (F.pmod(F.col("line_no"), F.lit(4)) + 1).cast("int"),
    )
    return lines.withColumn("role", role)
