"""Base-call quality: scores, characters and error probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from residua import constants as C

KINDS = ("phred", "solexa")


def _limits(kind: str) -> tuple[int, int, tuple[int, int]]:
    if kind == "phred":
        return C.PHRED_OFFSET, C.PHRED_CAP, C.PHRED_CODES
    if kind == "solexa":
        return C.SOLEXA_OFFSET, C.SOLEXA_CAP, C.SOLEXA_CODES
    raise ValueError(f"kind must be one of {KINDS}")


def error_to_score(p: Column, kind: str = "phred") -> Column:
    odds = p if kind == "phred" else p / (1 - p)
    _limits(kind)
    return -10 * F.log10(odds)


def score_to_error(score: Column, kind: str = "phred") -> Column:
    _limits(kind)
    odds = F.pow(F.lit(10.0), -score / 10)
    return odds if kind == "phred" else odds / (1 + odds)


def char_to_score(character: Column, kind: str = "phred") -> Column:
    return F.ascii(character) - _limits(kind)[0]


def score_to_char(score: Column, kind: str = "phred") -> Column:
    offset, cap, _ = _limits(kind)
    return F.chr(F.least(F.lit(cap).cast("double"), score.cast("double")).cast("int") + offset)


def is_valid_code(code: Column, kind: str = "phred") -> Column:
    low, high = _limits(kind)[2]
    return code.between(low, high)


def char_to_error(character: Column, kind: str = "phred") -> Column:
    return score_to_error(char_to_score(character, kind), kind)


def char_to_probability(character: Column, kind: str = "phred") -> Column:
    return 1 - char_to_error(character, kind)


def error_to_char(p: Column, kind: str = "phred") -> Column:
    return score_to_char(error_to_score(p, kind), kind)


def probability_to_char(p: Column, kind: str = "phred") -> Column:
    return error_to_char(1 - p, kind)


def string_scores(quality: Column, kind: str = "phred") -> Column:
    """Scores of a quality string, one per character."""
    letters = F.filter(F.split(quality, ""), lambda c: c != "")  # an empty string splits into one empty letter
    return F.transform(letters, lambda c: char_to_score(c, kind).cast("double"))


def dispatch_error(value: Column, kind: Column, is_char: bool) -> Column:
    """Error probability of a character or score whose encoding is a column."""
    to_error = char_to_error if is_char else score_to_error
    return F.when(kind == "solexa", to_error(value, "solexa")).otherwise(to_error(value, "phred"))


def sniff_kind(lowest: Column, highest: Column) -> Column:
    """Encoding of a file from the range of its character codes; phred wins ties.

    ``solexa`` needs every code inside its range and one outside phred's.
    """
    fits_phred = is_valid_code(lowest, "phred") & is_valid_code(highest, "phred")
    fits_solexa = is_valid_code(lowest, "solexa") & is_valid_code(highest, "solexa")
    return F.when(fits_phred, F.lit("phred")).when(fits_solexa, F.lit("solexa"))
