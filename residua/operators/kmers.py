"""k-mers: enumeration, counting, sampling, peptide statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from residua import constants as C
from residua.functions.alphabet import reduce_sequence
from residua.functions.vectors import kmer_point
from residua.operators.layout import range_slices, running_total
from residua.session import cut_lineage

PIECE = 2048


def explode_kmers(seqs: DataFrame, k: int, id_col: str = "protein_id", seq_col: str = "seq") -> DataFrame:
    """All k-mers with their zero-based position; sequences shorter than k give none.

    Two look-ahead patterns keep this linear: the first cuts a sequence into
    pieces that overlap by k-1, the second lists the windows of one piece. No
    row ever holds more than one piece's windows, however long the sequence.
    """
    piece = F.lit("(?=(.{1,%d})).{1,%d}" % (PIECE + k - 1, PIECE))
    window = F.lit("(?=(.{%d}))" % k)
    pieces = seqs.select(
        F.col(id_col),
        F.posexplode(F.regexp_extract_all(F.col(seq_col), piece, F.lit(1))).alias("_piece", "_text"),
    )
    windows = pieces.select(
        F.col(id_col),
        "_piece",
        F.posexplode(F.regexp_extract_all("_text", window, F.lit(1))).alias("_at", "kmer"),
    )
    return windows.select(id_col, (F.col("_piece") * PIECE + F.col("_at")).alias("pos"), "kmer")


def count_kmers(kmers: DataFrame, id_col: str = "protein_id") -> DataFrame:
    """Each distinct k-mer with its count and its first position; a null id is before all others.

    A place is one number if ids are whole numbers: the least number is kept in
    a hash table, while the least pair would have all rows sorted.
    """
    kind = kmers.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        return kmers.groupBy("kmer").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.col(id_col), F.col("pos"))).alias("_first"),
        ).select("kmer", "n", F.col(f"_first.{id_col}").alias(id_col), F.col("_first.pos").alias("pos"))
    number, step = "decimal(38,0)", F.lit(1 << 32).cast("decimal(11,0)")
    no_id = F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")
    place = F.coalesce(F.col(id_col).cast("decimal(20,0)"), no_id) * step + F.col("pos")
    counted = kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.min(place.cast(number)).alias("_first"))
    pos = F.pmod("_first", step.cast(number))
    first = ((F.col("_first") - pos) / step).cast("decimal(20,0)")
    return counted.select("kmer", "n", F.nullif(first, no_id).cast(kind).alias(id_col), pos.cast(kmers.schema["pos"].dataType).alias("pos"))


def peptide_stats(seqs: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Number of peptides, longest and total length."""
    return seqs.agg(
        F.count(F.lit(1)).alias("n_peptides"),
        F.max(F.length(seq_col)).cast("long").alias("longest"),
        F.sum(F.length(seq_col)).cast("long").alias("total_length"),
    )


def sample_kmers(seqs: DataFrame, k: int, id_col: str = "protein_id", min_step: int = 30,
                 steps: int = 20, first: int | None = None) -> DataFrame:
    """A strided sample of distinct k-mers: a protein contributes every s-th position.

    s lies in [min_step, min_step + steps) and follows from the protein's id, so
    the sample can be repeated. A k-mer is kept where it occurs first. ``first``
    restricts the sample to the proteins with the lowest ids.
    """
    used = seqs if first is None else seqs.filter(F.col(id_col) < first)
    step = F.lit(min_step) + F.pmod(F.col(id_col), F.lit(steps))
    last = F.length("seq") - k
    places = F.explode(F.sequence(F.lit(0), last, step.cast("int"))).alias("pos")
    taken = used.filter(last >= 0).select(id_col, "seq", places).select(
        id_col, "pos", F.substring(F.col("seq"), F.col("pos") + 1, F.lit(k)).alias("kmer"))
    return count_kmers(taken, id_col).select(id_col, "pos", "kmer")


def number_in_order(df: DataFrame, id_col: str, pos_col: str, name: str = "ordinal") -> DataFrame:
    """Zero-based number of each row in (id, position) order, computed slice by slice."""
    per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_rows"))
    sliced = per_id.withColumn("_slice", range_slices(per_id, id_col))
    starts = running_total(sliced, "_slice", [id_col], "_rows", "_end")
    starts = starts.select(id_col, (F.col("_end") - F.col("_rows")).alias("_start"))
    # positions are numbered inside blocks, so a long sequence is never one task
    block = (F.col(pos_col) / PIECE).cast("long")
    per_block = df.groupBy(id_col, block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(id_col).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(id_col, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(id_col, "_block").orderBy(pos_col)) - 1
    numbered = df.withColumn("_block", block).withColumn("_in", inside)
    offsets = offsets.join(starts, id_col)
    return (
        numbered.join(offsets, [id_col, "_block"])
        .withColumn(name, F.col("_start") + F.col("_before") + F.col("_in"))
        .drop("_block", "_in", "_before", "_start")
    )


def named_points(sample: DataFrame, names: DataFrame, id_col: str = "protein_id") -> DataFrame:
    """Sampled k-mers as named points: ``name#protein$position@kmer*ordinal``."""
    # numbering reads the sample several times
    numbered = number_in_order(cut_lineage(sample), id_col, "pos").join(names, id_col)
    label = F.concat(
        F.get(F.split("name", r"\s+"), F.lit(0)), F.lit("#"), F.col(id_col), F.lit("$"), F.col("pos"),
        F.lit("@"), F.col("kmer"), F.lit("*"), F.col("ordinal"),
    )
    return numbered.select(label.alias("name"), kmer_point(F.col("kmer")).alias("point"))


def drop_repeated(kmers: DataFrame, key: str = "kmer") -> DataFrame:
    """Rows whose k-mer occurs once; counts are combined before the shuffle."""
    once = kmers.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[
        F.first(c).alias(c) for c in kmers.columns if c != key
    ])
    return once.filter("_n = 1").select(*kmers.columns)


def group_frequency(seqs: DataFrame, alphabet: str = "murphy10", seq_col: str = "seq") -> DataFrame:
    """Share of every residue group among all residues."""
    text = F.col(seq_col)
    groups: dict[str, str] = {}
    for residue, code in zip(C.RESIDUES, C.group_codes(alphabet)):
        groups[code] = groups.get(code, "") + residue
    sums = seqs.agg(*[F.sum(F.length(text) - F.length(F.translate(text, letters, ""))).cast("long").alias(code)
                      for code, letters in groups.items()])
    listed = sums.select(F.explode(F.array(*[
        F.struct(F.lit(code).alias("grp"), F.col(f"`{code}`").alias("n")) for code in groups])).alias("_g"), *[
        F.col(f"`{code}`") for code in groups])
    total = sum(F.col(f"`{code}`") for code in groups)
    return listed.select("_g.grp", "_g.n", (F.col("_g.n") / total).alias("frequency")).filter("n > 0")


def seed_word_counts(seqs: DataFrame, length: int = 6, id_col: str = "protein_id") -> DataFrame:
    """How many of the 10^length reduced words occur, how often, and the median count."""
    words = explode_kmers(seqs.select(id_col, reduce_sequence(F.col("seq")).alias("seq")), length, id_col)
    counts = words.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_words"),
        F.sum("n").alias("n_positions"),
        F.max("n").alias("most"),
        F.percentile("n", 0.5).alias("median"),
    )
