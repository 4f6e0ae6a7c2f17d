"""Functions for SQL text: k-mers and reading frames as lists for ``LATERAL inline``, runs of letters as a table function.

The list functions are SQL functions that are put in place of their calls when a
query is analysed, so they stay in generated code, without a join or a shuffle.
Lists are named in a subquery first: ``inline`` takes a column, not such a call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession, types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from residua import constants as C
from residua.operators.kmers import PIECE


class Runs:
    """``runs(seq, least)``: (start, letter, length) of maximal runs of one letter, of ``least`` letters or more.

    ``runs(seq, least, true)`` gives their text as well. The later arguments
    must be constants, from which the columns follow when a query is analysed.
    NULL and empty texts have no runs.
    """

    @staticmethod
    def analyze(seq: AnalyzeArgument, least: AnalyzeArgument, with_text: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(seq.dataType, (T.StringType, T.NullType)):
            raise ValueError("runs: the first argument is a text")
        if not least.isConstantExpression or not isinstance(least.value, int) or least.value < 1:
            raise ValueError("runs: the shortest run is a constant of at least 1")
        if with_text is not None and not (with_text.isConstantExpression and isinstance(with_text.value, bool)):
            raise ValueError("runs: whether texts are given is a constant")
        schema = T.StructType().add("start", T.LongType()).add("letter", T.StringType()).add("length", T.LongType())
        if with_text is not None and with_text.value:
            schema = schema.add("run", T.StringType())
        return AnalyzeResult(schema)

    def eval(self, seq: str | None, least: int, with_text: bool = False) -> Iterator[tuple]:
        if not seq:
            return
        # lone surrogates cannot be encoded and are one letter each like all others
        codes = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        lengths = np.diff(np.append(begins, len(codes)))
        for i in np.flatnonzero(lengths >= least):
            start, n = int(begins[i]), int(lengths[i])
            row = (start, seq[start], n)
            yield (*row, seq[start:start + n]) if with_text else row


def _codons() -> list[tuple[str, str]]:
    bases = C.CODON_BASES
    return list(zip((a + b + c for a in bases for b in bases for c in bases), C.CODON_RESIDUES))


def _codons_sql() -> str:
    return "map(" + ", ".join(f"'{c}', '{r}'" for c, r in _codons()) + ")"


def _functions() -> list[str]:
    complement = "regexp_replace(translate(dna, 'ACGT', 'TGCA'), '[^ACGT]', 'N')"
    stops = "|".join(codon for codon, residue in _codons() if residue == "*")
    # a codon skips line ends, which the dot does not take; only what stands before the first stop is cut and translated
    head = f"'^(?:(?:(?!.{{3}})(?s:.))*+(?!{stops}).{{3}})*+'"

    def residues(strand: str, offset: str) -> str:
        codons = f"regexp_extract_all(regexp_extract(substring({strand}, {offset} + 1), {head}, 0), '(.{{3}})', 1)"
        return f"array_join(transform({codons}, c -> coalesce(element_at({_codons_sql()}, c), 'X')), '')"

    # each strand is made once for its three frames
    strands = f"array(named_struct('at', 0, 'text', dna), named_struct('at', 3, 'text', reverse({complement})))"
    frame_list = (f"flatten(transform({strands}, s -> transform(array(0, 1, 2), "
                  f"o -> named_struct('frame', s.at + o, 'aa', {residues('s.text', 'o')}))))")
    return [
        # pieces of a text that overlap by k - 1 letters, each with the place where it begins
        f"""kmer_pieces(seq STRING, k INT) RETURNS ARRAY<STRUCT<begin: BIGINT, piece: STRING>>
        RETURN transform(regexp_extract_all(seq, concat('(?s)(?=(.{{1,', {PIECE} - 1 + k, '}})).{{1,{PIECE}}}'), 1),
          (p, i) -> named_struct('begin', CAST(i AS BIGINT) * {PIECE}, 'piece', p))""",
        """kmers(seq STRING, k INT) RETURNS ARRAY<STRUCT<pos: BIGINT, kmer: STRING>>
        RETURN transform(regexp_extract_all(seq, concat('(?s)(?=(.{', k, '}))'), 1),
          (w, i) -> named_struct('pos', CAST(i AS BIGINT), 'kmer', w))""",
        f"frame_residues(strand STRING, offset INT) RETURNS STRING RETURN {residues('strand', 'offset')}",
        f"frames(dna STRING) RETURNS ARRAY<STRUCT<frame: INT, aa: STRING>> RETURN {frame_list}",
    ]


def register_functions(spark: SparkSession) -> SparkSession:
    """Make ``kmer_pieces``, ``kmers``, ``frame_residues``, ``frames`` and ``runs`` known to SQL text of the session.

    ``kmers`` lists all windows of a text in one row; texts of any length are cut
    by ``kmer_pieces`` first, whose pieces hold every window once.
    """
    for body in _functions():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    spark.udtf.register("runs", udtf(Runs))
    return spark
