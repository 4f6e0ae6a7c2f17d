"""Text layouts. Each function returns a frame of lines or writes one.

A header and its members are separate lines in one range-sorted frame, so a
cluster or motif of any size is written by several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from residua import constants as C


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write the ``value`` column, sorted over all files when an order is given."""
    if order:
        lines = lines.orderBy(*order)
    lines.select("value").write.mode("overwrite").text(path)


def _under_headers(headers: DataFrame, members: DataFrame, key: str, order: str) -> DataFrame:
    """Header lines (key, value) before their member lines (key, order, value)."""
    top = headers.select(key, F.lit(0).alias("_part"), F.lit(None).cast("long").alias(order), "value")
    rest = members.select(key, F.lit(1).alias("_part"), F.col(order).cast("long").alias(order), "value")
    return top.unionByName(rest).orderBy(key, "_part", order, "value")


def cluster_lines(members: DataFrame, with_size: bool = True) -> DataFrame:
    """``#clusterid:n:sizem`` or ``#clustern`` and the names; members are (leader, id, name)."""
    header = F.concat(F.lit("#clusterid:"), F.col("leader"), F.lit(":size"), F.col("n")) if with_size else (
        F.concat(F.lit("#cluster"), F.col("leader")))
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    return _under_headers(sizes.select("leader", header.alias("value")),
                          members.select("leader", "id", F.col("name").alias("value")), "leader", "id")


def group_lines(members: DataFrame) -> DataFrame:
    """``#motif`` and its members; members are (motif, member_idx, seq)."""
    headers = members.select("motif").distinct().select("motif", F.concat(F.lit("#"), F.col("motif")).alias("value"))
    return _under_headers(headers, members.select("motif", "member_idx", F.col("seq").alias("value")),
                          "motif", "member_idx")


def number(value: Column, digits: int = 6) -> Column:
    """A double as plain text without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value), r"(\.\d*?)0+$", "$1")


def vector_text(point: Column, separator: str = " ") -> Column:
    return F.array_join(F.transform(point, lambda x: x.cast("string")), separator)


def named_point_lines(points: DataFrame) -> DataFrame:
    """A name and its vector on two lines."""
    return points.select("name", F.concat("name", F.lit("\n"), vector_text(F.col("point"))).alias("value"))


def center_lines(centers: DataFrame, name: str | None = None) -> DataFrame:
    text = vector_text(F.col("center"))
    return centers.select("*", (F.concat(F.col(name), F.lit("\n"), text) if name else text).alias("value"))


def coordinate_rows(kmers: DataFrame, k: int = 10) -> DataFrame:
    """Tab-separated coordinates of valid k-mers; a wrong letter or length fails the job."""
    from residua.functions.vectors import strict_kmer_point

    return kmers.select("kmer", vector_text(strict_kmer_point(F.col("kmer"), k), "\t").alias("value"))


def fasta_lines(seqs: DataFrame, name: Column | None = None, seq: str = "seq") -> DataFrame:
    name = F.col("name") if name is None else name
    return seqs.select("*", F.concat(F.lit(">"), name, F.lit("\n"), F.col(seq)).alias("value"))


def motif_fasta_lines(members: DataFrame) -> DataFrame:
    """``>motifI_seqJ`` records of (motif_idx, member_idx, seq)."""
    return fasta_lines(members, F.concat(F.lit("motif"), F.col("motif_idx"), F.lit("_seq"), F.col("member_idx")))


def orf_fasta_lines(frames: DataFrame) -> DataFrame:
    return fasta_lines(frames, F.concat("name", F.lit("_"), "orf_idx"), "aa")


def hit_lines(hits: DataFrame) -> DataFrame:
    """``motif protein distance``."""
    return hits.select("*", F.concat_ws(" ", "motif", "protein", F.col("distance").cast("string")).alias("value"))


def write_split_hits(hits: DataFrame, radius: float, path: str) -> None:
    """Hits within the radius and, in a second folder, those beyond it."""
    lines = hit_lines(hits)
    write_lines(lines.filter(F.col("distance") <= radius), path)
    write_lines(lines.filter(F.col("distance") > radius), path + ".notlessthan")


def tab_lines(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("*", F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value"))


def accuracy_lines(bins: DataFrame) -> DataFrame:
    """``bin ratio tp fn``; bins with one kind only name it."""
    both = F.concat_ws(" ", "bin", F.col("ratio").cast("string"), "tp", "fn")
    missed = F.concat_ws(" ", "bin", F.lit("0"), F.lit("fn"), "fn")
    found = F.concat_ws(" ", "bin", F.lit("1"), F.lit("tp"), "tp")
    return bins.select("*", F.when(F.col("tp") == 0, missed).when(F.col("fn") == 0, found).otherwise(both).alias("value"))


def motif_matrix_lines(matrix: DataFrame, width: int, letters: str = C.MOTIF_LETTERS, digits: int = 2) -> DataFrame:
    """MEME version 4 text: a file header, then per motif its header and one row per position."""
    preamble = matrix.sparkSession.range(1).select(
        F.lit("").alias("motif"), F.lit(-2).alias("pos"),
        F.lit(f"MEME version 4\n\nALPHABET= {letters}\n").alias("value"),
    )
    headers = matrix.select("motif").distinct().select(
        "motif", F.lit(-1).alias("pos"),
        F.concat(F.lit("MOTIF "), F.col("motif"),
                 F.lit(f"\nletter-probability matrix: alength= {len(letters)} w= {width}")).alias("value"),
    )
    cells = F.concat_ws(" ", *[F.format_string(f"%.{digits}f", F.col(a)) for a in letters])
    rows = matrix.select("motif", F.col("pos").cast("int").alias("pos"), cells.alias("value"))
    return preamble.unionByName(headers).unionByName(rows).orderBy("motif", "pos")


def _evalue_text(e: Column) -> Column:
    return (F.when(e < 0.01, F.format_string("%.1e", e)).when(e < 10, F.format_string("%.2f", e))
            .otherwise(F.format_string("%.0f", e)))


def m8_lines(rows: DataFrame) -> DataFrame:
    """Twelve tab-separated columns per hit."""
    return rows.select("*", F.concat_ws(
        "\t", "query", "subject", F.format_string("%.1f", F.col("identity")), "aln_len", "mismatch", "gap_open",
        "q_start", "q_end", "s_start", "s_end", _evalue_text(F.col("evalue")),
        F.format_string("%.1f", F.col("bit_score")),
    ).alias("value"))


def m8_commented_lines(rows: DataFrame) -> DataFrame:
    """The tabular layout with a comment block before each query's hits."""
    counts = rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    titles = ("query id, subject id, % identity, alignment length, mismatches, gap opens, q. start, q. end, "
              "s. start, s. end, evalue, bit score")
    header = F.concat(F.lit("# Query: "), F.col("query"), F.lit(f"\n# Fields: {titles}\n# "), F.col("n"),
                      F.lit(" hits found"))
    body = m8_lines(rows).select("query", F.col("rank").cast("long").alias("rank"), "value")
    return _under_headers(counts.select("query", header.alias("value")), body, "query", "rank")


def alignment_lines(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Query, midline and subject of each hit; of each query's ``most`` best ones if given."""
    if most is not None:
        hits = hits.filter(F.col("rank") <= most)
    title = F.format_string(
        "%s vs %s bits=%s E-value=%s identity=%s%% aln-len=%d mismatch=%d gap-openings=%d",
        "query", "subject", F.col("bits").cast("string"), F.col("evalue").cast("string"),
        F.col("identity").cast("string"), "aln_len", "mismatch", "gap_open",
    )
    text = F.concat(title, F.lit("\nQuery:\t"), "q_text", F.lit("\n      \t"), "midline",
                    F.lit("\nSbjct:\t"), "t_text", F.lit("\n"))
    return hits.select("*", text.alias("value"))


def stockholm_lines(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries and rows back to Stockholm text."""
    def tag(name: str) -> Column:
        return F.concat(F.lit(f"#=GF {name}   "), F.coalesce(F.col(name).cast("string"), F.lit("")))

    head = F.concat_ws("\n", F.lit("# STOCKHOLM 1.0"), *[tag(t) for t in ("ID", "AC", "DE", "TP", "SQ")])
    name = F.format_string("%s/%d-%d", "seqname", "start", "stop")
    parts = entries.select("entry", F.lit(0).alias("_part"), F.lit("").alias("_name"), head.alias("value"))
    parts = parts.unionByName(rows.select("entry", F.lit(1).alias("_part"), name.alias("_name"),
                                          F.concat_ws(" ", name, "alignment").alias("value")))
    parts = parts.unionByName(entries.select("entry", F.lit(2).alias("_part"), F.lit("").alias("_name"),
                                             F.lit("//").alias("value")))
    return parts.orderBy("entry", "_part", "_name")


def entry_dump_lines(entries: DataFrame, rows: DataFrame, layout: str = "full") -> DataFrame:
    """Readable dump: ``full``; ``no_gaps`` without rows that hold insertions; ``motifs`` for TP Motif only."""
    if layout == "motifs":
        entries = entries.filter("TP = 'Motif'")
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{t}: "), F.coalesce(F.col(t).cast("string"), F.lit("")))
                               for t in ("ID", "AC", "DE", "TP", "SQ")])
    kept = rows.join(entries.select("entry"), "entry", "left_semi")
    if layout == "no_gaps":
        kept = kept.filter(~F.col("alignment").rlike("[a-z]"))
    states = F.regexp_replace("alignment", "[.a-z]+", "")
    padded = F.when(F.length("seqname") < 20, F.rpad("seqname", 20, " ")).otherwise(F.col("seqname"))

    def wide(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(F.length(text) < 8, F.lpad(text, 8, " ")).otherwise(text)

    columns = [padded, wide("start"), wide("stop"), states]
    if layout == "full":
        columns.append(F.col("alignment"))
    parts = entries.select("entry", F.lit(0).alias("_part"), F.lit("").alias("seqname"), head.alias("value"))
    parts = parts.unionByName(kept.select("entry", F.lit(1).alias("_part"), "seqname",
                                          F.concat_ws("\t", *columns).alias("value")))
    parts = parts.unionByName(entries.select("entry", F.lit(2).alias("_part"), F.lit("").alias("seqname"),
                                             F.lit("-----------------END----------------").alias("value")))
    return parts.orderBy("entry", "_part", "seqname")


def block_lines(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """``#ID:..#AC:..`` headers and fixed-length blocks."""
    used = entries.join(blocks.select("entry").distinct(), "entry", "left_semi")
    header = F.concat(F.lit("#ID:"), "ID", F.lit("#AC:"), "AC")
    members = blocks.select("entry", F.lit(0).alias("_o"), F.col("block").alias("value"))
    return _under_headers(used.select("entry", header.alias("value")), members, "entry", "_o")


def length_lines(rows: DataFrame, length: str) -> DataFrame:
    return rows.select(F.col(length).cast("string").alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select("*", F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def scores_by_length(scored: DataFrame, path: str, k: str = "k", score: str = "score") -> None:
    """One folder of scores per k, a score per line."""
    scored.select(F.col(k), F.col(score).cast("string").alias("value")).write.mode("overwrite").partitionBy(k).text(path)
