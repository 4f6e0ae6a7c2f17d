"""Line-first cleaning: rules per line, failed lines removed, documents that lose too much rejected."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from residua.llm.texts import free_name, one_text

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
# fixed values: phrases of notices, menus and scripts, lower case
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "this site uses cookies", "enable javascript", "lorem ipsum", "click here", "read more", "sign up", "log in",
    "subscribe to our newsletter", "share this", "powered by",
)
# fixed values: signs that stand between the entries of a menu, alone between blanks
NAVIGATION = ("|", ">", "»", "›", "•", "·", "/", "::")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules (shares of words or characters) and of the document rule."""

    navigation_share: float = 0.2
    navigation_count: int = 3
    symbol_share: float = 0.2
    punctuation_share: float = 0.4
    shout_share: float = 0.8
    shout_words: int = 4
    repeat_words: int = 10
    repeat_share: float = 0.7
    lost_share: float = 0.4
    least_words: int = 10
    repeat_window: int = 5
    repeat_percent: int = 20


RULES = Rules()
_BLANK = re.compile(r"[ \t\n\x0b\x0c\r]")
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))
_PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_PHRASES = [p.encode() for p in BOILERPLATE]
_SIGNS = frozenset(s.encode() for s in NAVIGATION)


def _count(line: bytes, signs: bytes) -> int:
    return len(line) - len(line.translate(None, signs))


def line_fault(line: bytes, words: list[bytes], rules: Rules = RULES) -> str | None:
    """The first rule that a line (UTF-8, with its words) breaks; None for a line that stays.

    Letters and punctuation are the ASCII ones, sizes are bytes.
    """
    n = len(words)
    if not n:
        return None
    signs = sum(w in _SIGNS for w in words)
    if signs >= rules.navigation_count and signs >= rules.navigation_share * n:
        return "navigation"
    size = sum(map(len, words))
    if _count(line, SYMBOLS) >= rules.symbol_share * size:
        return "symbols"
    if n >= 2 and _count(line, _PUNCTUATION) > rules.punctuation_share * size:
        return "punctuation"
    low = line.lower()
    if any(phrase in low for phrase in _PHRASES):
        return "boilerplate"
    if n >= rules.shout_words:
        upper = _count(line, _UPPER)
        if upper and upper >= rules.shout_share * _count(line, _LETTERS):
            return "shouting"
    if n >= rules.repeat_words and n - len(set(words)) > rules.repeat_share * n:
        return "repetition"
    return None


def repeated_words(words: list[bytes], window: int) -> int:
    """Words that lie in a window occurring at least twice, first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    code, kinds = ids, len(numbers)
    span = 1
    if kinds == n:
        return 0
    while span < window:  # numbers of longer and longer windows, exact at each step
        step = min(span, window - span)
        code = code[:len(code) - step] * np.int64(kinds) + code[step:]
        _, code, counts = np.unique(code, return_inverse=True, return_counts=True)
        kinds, span = len(counts), span + step
        if kinds == len(code):
            return 0
    twice = counts[code] > 1
    change = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def measure(text: str | None, rules: Rules = RULES) -> dict:
    """Counts of one text, the lines that stay and the verdict."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    kept, lost, filled, faults = [], 0, 0, {}
    verdicts: dict[bytes, tuple[str | None, int]] = {}
    for line in raw.split(b"\n") if n else ():
        if line in verdicts:
            fault, size = verdicts[line]
        else:
            own = line.split()
            fault, size = line_fault(line, own, rules), len(own)
            if not size:
                continue
            verdicts[line] = fault, size
        filled += 1
        if fault:
            lost += size
            faults[fault] = faults.get(fault, 0) + 1
        else:
            kept.append(line)
    repeated = repeated_words(words, rules.repeat_window)
    base_failed = n < rules.least_words or 100 * repeated > rules.repeat_percent * n
    return {
        "n_words": n,
        "word_chars": len(text or "") - (len(raw) - len(raw.translate(None, BLANKS))),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": filled - len(verdicts),
        "n_repeat_words": repeated,
        "n_lost_words": lost,
        "faults": sorted(faults),
        "clean_text": None if text is None else b"\n".join(kept).decode(),
        "base_failed": base_failed,
        "kept": not base_failed and lost <= rules.lost_share * n,
    }


FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "n_lost_words": pa.int64(), "faults": pa.list_(pa.string()),
    "base_failed": pa.bool_(), "kept": pa.bool_(),
}
KIND = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, "
        "faults array<string>, base_failed boolean, kept boolean")


def assess(docs: DataFrame, text: str = "text", into: str = "quality", rules: Rules = RULES,
           clean: bool = False) -> DataFrame:
    """``docs`` with a struct ``into`` of counts, broken rules and the verdict ``kept``.

    A null or empty text has no words and fails. A text passes if it has enough
    words, few of them in repeated windows, and keeps most words after its
    failed lines are removed. With ``clean`` the struct also holds the text
    without those lines. Each row is judged alone and in place: no shuffle, and
    a task holds one batch of texts. ``into`` must not be a column of ``docs``.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{into} is a column already")
    kind = KIND + (", clean_text string" if clean else "")
    fields = FIELDS | ({"clean_text": pa.string()} if clean else {})
    column = one_text(lambda: lambda value: measure(value, rules), kind, fields)
    return docs.withColumn(into, column(F.col(text)))


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with failed lines removed from their text."""
    mark = free_name(docs, "_quality")
    found = assess(docs, text, mark, rules, clean=True).filter(F.col(mark)["kept"])
    return found.withColumn(text, F.col(mark)["clean_text"]).drop(mark)
