"""DNA bases, codons, packed k-mers and adaptor clipping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from residua import constants as C

# one digit for A, C, G and T under each conversion; every other letter is 4
_BASE_DIGITS = {
    "plain": "0123",
    "bisulfite": "0323",
    "bisulfite_ag": "0103",
    "complement": "3210",
}


def complement(seq: Column) -> Column:
    """A-T and C-G exchanged with case kept; other letters become N or n."""
    known = F.translate(seq, "ACGTacgt", "TGCAtgca")
    return F.regexp_replace(F.regexp_replace(known, "[^ACGTNa-z]", "N"), "[^ACGTNacgtn]", "n")


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def base_code(letter: Column, conversion: str = "plain", any_case: bool = True) -> Column:
    """0-3 for the four bases under a conversion, 4 for everything else."""
    letter = F.upper(letter) if any_case else letter
    digits = _BASE_DIGITS[conversion]
    code = F.lit(4)
    for base, digit in zip("ACGT", digits):
        code = F.when(letter == base, F.lit(int(digit))).otherwise(code)
    return code


def code_base(code: Column, complemented: bool = False) -> Column:
    letters = "TGCA" if complemented else "ACGT"
    return F.when(code.between(0, 3), F.substring(F.lit(letters), code + 1, F.lit(1))).otherwise(F.lit("N"))


def is_base(letter: Column) -> Column:
    return base_code(letter) < 4


def mer_to_index(mer: Column, complemented: bool = False) -> Column:
    """Base-4 number of a DNA k-mer, first base highest.

    ``complemented`` gives the number of its reverse complement.
    """
    digits = F.translate(mer, "ACGT", "0123")
    if complemented:
        digits = F.reverse(F.translate(mer, "ACGT", "3210"))
    return F.conv(digits, 4, 10).cast("long")


def index_to_mer(index: Column, n: int, complemented: bool = False) -> Column:
    """The DNA k-mer of a base-4 number.

    ``complemented`` exchanges the bases; the order of digits stays.
    """
    letters = "TGCA" if complemented else "ACGT"
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, 4), n, "0"), "0123", letters)


def codon_residue(codon: Column) -> Column:
    """Residue of a codon, * for a stop, X when a base is unknown."""

    def place(i: int) -> Column:
        return F.instr(F.lit(C.CODON_BASES), F.substring(codon, i, 1)) - 1

    first, second, third = place(1), place(2), place(3)
    known = (F.length(codon) == 3) & (first >= 0) & (second >= 0) & (third >= 0)
    return F.when(
        known, F.substring(F.lit(C.CODON_RESIDUES), first * 16 + second * 4 + third + 1, F.lit(1))
    ).otherwise(F.lit("X"))


def translate_frame(dna: Column, offset: Column | int) -> Column:
    """Residues from a zero-based offset up to the first stop codon."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    rest = F.substring(dna, offset + 1, F.length(dna))
    codons = F.regexp_extract_all(rest, F.lit("(.{3})"), F.lit(1))
    stops = [i for i, r in enumerate(C.CODON_RESIDUES) if r == "*"]
    bases = C.CODON_BASES
    names = [bases[i // 16] + bases[i // 4 % 4] + bases[i % 4] for i in stops]

    # only the codons before the first stop are translated
    def head(all_codons: Column) -> Column:
        found = F.filter(F.array(*[F.array_position(all_codons, n) for n in names]), lambda p: p > 0)
        end = F.coalesce(F.array_min(found).cast("int") - 1, F.size(all_codons))
        return F.array_join(F.transform(F.slice(all_codons, F.lit(1), end), codon_residue), "")

    return F.element_at(F.transform(F.array(codons), head), 1)


def adaptor_matches(read: Column, position: Column, adaptor: str) -> Column:
    """How many of the adaptor's first letters agree with the read at a position."""
    head = adaptor[: C.ADAPTOR_HEAD]
    total = F.lit(0)
    for i, letter in enumerate(head):
        total = total + (F.substring(read, position + i + 1, F.lit(1)) == letter).cast("int")
    return total


def adaptor_start(read: Column, adaptor: str) -> Column:
    """Zero-based position at which a read is clipped, NULL when it is not.

    The first position with enough agreement over the adaptor's head wins; after
    it, near the end of the read, all but one of the remaining letters must agree.
    One look-ahead per position enumerates the windows in linear time.
    """
    head = C.ADAPTOR_HEAD
    windows = F.transform(
        F.regexp_extract_all(read, F.lit("(?s)(?=(.{1,%d}))." % head), F.lit(1)),
        lambda window, i: F.struct(
            i.alias("at"),
            F.length(window).alias("n"),
            adaptor_matches(window, F.lit(0), adaptor).alias("same"),
        ),
    )
    full = F.filter(windows, lambda w: (w["n"] == head) & (w["same"] >= C.ADAPTOR_MATCHES))
    tail = F.filter(
        windows,
        lambda w: (w["n"] < head) & (w["n"] >= C.ADAPTOR_MIN_OVERLAP) & (w["same"] >= w["n"] - 1),
    )
    return F.coalesce(F.get(full, F.lit(0))["at"], F.get(tail, F.lit(0))["at"])


def clip_adaptor(read: Column, adaptor: str) -> Column:
    """The read with everything from the adaptor on replaced by N."""
    start = adaptor_start(read, adaptor)
    clipped = F.rpad(F.substring(read, F.lit(1), start), F.length(read), F.lit("N"))
    return F.when(start.isNull(), read).otherwise(clipped)


def split_adaptors(adaptor: Column) -> tuple[Column, Column]:
    """``T[:A]`` into both adaptors; a single one serves for both."""
    parts = F.split(adaptor, ":")
    checked = F.when(F.size(parts) > 2, F.raise_error(F.lit("adaptor format is T[:A]")).cast("string"))
    first = checked.otherwise(F.get(parts, F.lit(0)))
    second = checked.otherwise(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))
    return first, second
