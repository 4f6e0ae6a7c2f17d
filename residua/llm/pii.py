"""Personal data: strict patterns, and candidates of loose patterns that boosted trees accept."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from residua.llm.boosting import BINS, Boosted, bins_of, boosted_scores, cuts_of, gradient_sums
from residua.llm.texts import by_pieces, free_name, hash_bound, stored, texts_of

KINDS = ("email", "ip", "card", "phone")
# different candidates that one block of training rows holds; a single block is worked on where the trees are made
BLOCK_ROWS = 100_000
# thresholds are whole parts of one
PARTS = 10_000
# share of true ones among accepted candidates that a kind's threshold must reach on held-back candidates
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number starts where no digit stands before it, else each long run of digits would be tried from every digit
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# kinds but email need a digit, and a loose address one of these: the literal starts are found fast in texts that have none
_DIGIT = re.compile(r"[0-9]")
_SITE = r"[A-Za-z0-9-]{1,63}(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]"
_AT = [re.compile(start + _SITE) for start in (r" at ", r"@ ?", r"at ?[)\]}] ?")]
# the high-recall generators
_LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?[(\[{] ?at ?[)\]}] ?| at |@| @ )[A-Za-z0-9-]{1,63}"
                         r"(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ .\-/_]?[0-9]){11,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+|00)?(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .\-/]?[0-9]{3}[ .\-/][0-9]{3,4}(?![0-9])")),
)
_HINTS = re.compile(r"mail|contact|phone|tel|call|mobile|fax|card|visa|credit|pay|ip|addr|host|server", re.I)
_CODES = re.compile(r"version|licen|token|key|secret|hash|sha|id\b|isbn|=\s*[\"']?$", re.I)
FEATURES = 22


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def strict_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the strict patterns match, by start and then kind."""
    if not text:
        return []
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return found
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if _small_parts(m[0])]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in address.split(".")))


def loose_spans(text: str | None) -> list[tuple[int, int, str]]:
    """Candidates of every generator; they may overlap."""
    text = text or ""
    address, digit = any(p.search(text) for p in _AT), _DIGIT.search(text)
    return [(*m.span(), kind) for kind, pattern in _LOOSE if (address if kind == "email" else digit) for m in pattern.finditer(text)]


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate, as numbers."""
    span, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 24]
    digits = re.sub(r"[^0-9]", "", span)
    groups = re.findall(r"[0-9]+", span)
    side = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0
    return [
        float(KINDS.index(kind)), len(span), len(digits), len(groups), max(map(len, groups), default=0),
        min(map(len, groups), default=0), len(set(re.sub(r"[0-9A-Za-z]", "", span))), float(span[0] == "+"),
        float("(" in span), float("@" in span), span.count("."), span.count("-"), span.count(" "),
        float(len(digits) >= 12 and luhn(digits)), max((min(int(g), 10**6) for g in groups), default=0),
        float(kind == "ip" and _small_parts(".".join(groups))), len(set(digits)), side(before[-1:]), side(after[:1]),
        float(bool(_HINTS.search(before))), float(bool(_CODES.search(before))), float(sum(c.isalpha() for c in span)),
    ]


def _variants(span: str, kind: str) -> list[str]:
    """Other ways in which people write the same datum."""
    if kind == "email":
        local, domain = span.rsplit("@", 1)
        return [f"{local} at {domain.replace('.', ' dot ')}", f"{local} (at) {domain}", f"{local}[at]{domain.replace('.', '[dot]')}"]
    if kind == "phone":
        bare = span.lstrip("+")
        return [bare, "00" + bare, re.sub(r"^[0-9]{1,2}[ .-]+", "", bare), bare.replace(" ", ".")]
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", span)
        return [sep.join(digits[i:i + 4] for i in range(0, len(digits), 4)) for sep in (".", "/", "_")]
    return [span.replace(".", sep) for sep in (":", "_", ",")]


class Covered:
    """Places under spans, asked and added to by bisection, so that texts full of numbers stay cheap."""

    def __init__(self, spans: Iterable[tuple[int, int, str]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        """Add a span that touches no other."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def training_rows(text: str) -> list[tuple[list[float], float]]:
    """(features, label) of a text's candidates.

    What the strict patterns match is true, and so is each of its variants in
    the same place. A candidate that touches no strict match is false.
    """
    strict, out = strict_spans(text), []
    known, covered = set(strict), Covered(strict)
    for start, end, kind in loose_spans(text):
        if (start, end, kind) in known:
            out.append((features(text, start, end, kind), 1.0))
        elif not covered.touches(start, end):
            out.append((features(text, start, end, kind), 0.0))
    for start, end, kind in strict:
        for other in _variants(text[start:end], kind):
            left, right = text[max(0, start - 32):start], text[end:end + 32]
            for a, b, k in loose_spans(left + other + right):
                if k == kind and a <= len(left) and b >= len(left) + len(other) - 1 and b > a:
                    out.append((features(left + other + right, a, b, k), 1.0))
    return out


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, rows, labels, places = [], [], [], []
        for i, text in enumerate(texts_of(batch.column("text"))):
            for place, (x, y) in enumerate(training_rows(text)):
                hashes.append(batch.column("h")[i].as_py())
                places.append(place)
                rows.append(x)
                labels.append(y)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes, pa.int64()), pa.array(places, pa.int64()), pa.array(rows, pa.list_(pa.float64())),
             pa.array(labels, pa.float64())], names=["h", "place", "x", "y"])


def thresholds(kinds: np.ndarray, scores: np.ndarray, truth: np.ndarray, precision: float = PRECISION,
               count: np.ndarray | None = None) -> dict[str, float]:
    """For each kind the lowest score from which on enough candidates are true; above 1 if there is none.

    With ``count`` a row stands for so many candidates, of which ``truth`` are true.
    """
    out = {}
    count = np.ones(len(truth)) if count is None else count
    for number, kind in enumerate(KINDS):
        own = kinds == number
        order = np.argsort(-scores[own], kind="stable")
        s, y, n = scores[own][order], truth[own][order], count[own][order]
        share = np.cumsum(y) / np.cumsum(n)
        last_of_tie = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
        good = np.flatnonzero((share >= precision) & last_of_tie & (s >= 0.5))
        out[kind] = float(s[good[-1]]) if len(good) and y[:good[-1] + 1].any() else 2.0
    return out


def candidates(docs: DataFrame, text: str = "text", sample_docs: int | None = None) -> DataFrame:
    """(h, place, x, y): the training rows of all different texts, or of about ``sample_docs`` of those with a digit or @."""
    rows = docs.select(F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    if sample_docs is not None:
        rows = rows.filter(F.col("text").rlike("[0-9@]"))
        total = rows.select("h").distinct().count()
        rows = rows.filter(F.col("h") <= F.lit(hash_bound(sample_docs, total)).cast("long"))
    # copies have equal rows, so what is shuffled are candidates and no texts
    return rows.mapInArrow(_sample, "h long, place long, x array<double>, y double").dropDuplicates(["h", "place"])


def _binned(cuts: list[np.ndarray]):
    """Rows (kind, key, held, y) with the bins of the features as ``key``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            keys = [row.tobytes() for row in bins_of(cuts, x)]
            held = batch.column("h").to_numpy() % 3 == 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, 0].astype(np.int32)), pa.array(keys, pa.binary()), pa.array(held), batch.column("y")],
                names=["kind", "key", "held", "y"])

    return work


def _rows_of(block: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, true ones, candidates) of some rows of equal bins."""
    keys = np.frombuffer(b"".join(block.column("key").to_pylist()), np.uint8).reshape(-1, FEATURES)
    return keys, block.column("positive").to_numpy(), block.column("n").to_numpy()


def _summed(rows: DataFrame, blocks: int):
    """:func:`gradient_sums` over all ``rows``; each block gives one row of a fixed size."""
    if blocks == 1:
        block = _rows_of(rows.toArrow())
        return lambda *at: gradient_sums(*block, *at)

    def sums(start, trees, features, borders, level):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(gradient_sums(*_rows_of(b), start, trees, features, borders, level) for b in batches if b.num_rows)
            if not isinstance(total, int):
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        found = rows.mapInArrow(work, "sums binary").toArrow().column("sums").to_pylist()
        return sum(np.frombuffer(f, np.int64) for f in found).reshape(2, 1 << level, FEATURES, BINS + 1)

    return sums


def fit(docs: DataFrame, text: str = "text", sample_docs: int | None = None, block_rows: int = BLOCK_ROWS) -> dict:
    """Trees and thresholds from the candidates of all different texts; two thirds of the texts teach, the others set the thresholds.

    Candidates of equal bins are one row with a count. Histograms of gradients are summed where the rows are;
    they are whole numbers, so the trees do not depend on how the rows are dealt. ``sample_docs`` looks at fewer texts.
    """
    rows = stored(candidates(docs, text, sample_docs), "pii-candidates")
    held = F.pmod("h", F.lit(3)) == 0
    steps = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, BINS)])
    whole = rows.groupBy(held.alias("held")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), *[F.percentile(F.col("x")[i], steps).alias(f"q{i}") for i in range(FEATURES)])
    sides = {r["held"]: r for r in whole.collect()}
    empty = {"start": 0.0, "features": np.zeros((0, 7), int), "borders": np.zeros((0, 7)), "leaves": np.zeros((0, 8)),
             "thresholds": dict.fromkeys(KINDS, 2.0)}
    if len(sides) < 2 or not 0 < sides[False]["y"] < sides[False]["n"]:
        return empty
    cuts = [cuts_of(sides[False][f"q{i}"]) for i in range(FEATURES)]
    equal = stored(rows.mapInArrow(_binned(cuts), "kind int, key binary, held boolean, y double").groupBy("kind", "key", "held").agg(
        F.sum("y").alias("positive"), F.count(F.lit(1)).cast("double").alias("n")), "pii-equal")
    teaching = equal.filter("NOT held").select("key", "positive", "n")
    blocks = max(1, -(-teaching.count() // block_rows))
    if blocks > 1:
        teaching = stored(teaching.repartition(blocks), "pii-blocks")
    trees = Boosted().fit_sums(cuts, sides[False]["y"] / sides[False]["n"], _summed(teaching, blocks))
    model = {k: getattr(trees, k) for k in ("start", "features", "borders", "leaves")}
    # borders are cuts, so each row's bins stand for its features
    binned = model | {"borders": np.array([[np.searchsorted(cuts[f], b) for f, b in zip(*t)] for t in zip(trees.features, trees.borders)])}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.floor(boosted_scores(binned, _rows_of(batch)[0]) * PARTS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(part), batch.column("positive"), batch.column("n")],
                                             names=["kind", "part", "positive", "n"])

    scores = equal.filter("held").select("kind", "key", "positive", "n").mapInArrow(scored, "kind int, part int, positive double, n double")
    table = scores.groupBy("kind", "part").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n")).toArrow()
    kind, part, positive, n = (table.column(c).to_numpy() for c in ("kind", "part", "positive", "n"))
    return model | {"thresholds": thresholds(kind, part / PARTS, positive, count=n)}


def all_spans(model: dict, text: str | None) -> tuple[list, list]:
    """(strict spans, all spans), each by start and then kind.

    A candidate is added if its score reaches the threshold of its kind and it
    touches no strict span and no added one of a higher score.
    """
    strict = strict_spans(text)
    base = Covered(strict)
    free = [s for s in loose_spans(text) if not base.touches(s[0], s[1])]
    if not free or not len(model["features"]):
        return strict, strict
    scores = boosted_scores(model, np.array([features(text, *s) for s in free]))
    added: list[tuple[int, int, str]] = []
    taken = Covered()
    for i in np.argsort(-scores, kind="stable").tolist():
        start, end, kind = free[i]
        if scores[i] >= model["thresholds"][kind] and not taken.touches(start, end):
            added.append(free[i])
            taken.add(start, end)
    return strict, sorted(strict + added, key=lambda s: (s[0], KINDS.index(s[2])))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SPAN_SQL = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, model: dict, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with a struct ``into``: the strict spans and all spans, in code points, end exclusive.

    Null and empty texts have none. Rows are looked at in place; a model that
    has learned nothing adds nothing. ``into`` must not be a column of ``docs``.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{into} is a column already")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of small trees

    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = sent.value
        for texts in batches:
            both = [all_spans(known, t) for t in texts_of(texts)]
            as_rows = [[[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in side] for side in zip(*both)] or [[], []]
            yield pa.StructArray.from_arrays([pa.array(as_rows[0], _SPAN), pa.array(as_rows[1], _SPAN)], names=["base", "spans"])

    column = F.arrow_udf(look, f"base {_SPAN_SQL}, spans {_SPAN_SQL}").asNondeterministic()
    return docs.withColumn(into, column(F.col(text)))


def _masked(text: str | None, spans: list[dict]) -> str | None:
    if not text or not spans:
        return text
    out, last = [], 0
    for s in spans:
        if s["start"] >= last:
            out += [text[last:s["start"]], f"[{s['kind'].upper()}]"]
        last = max(last, s["end"])
    return "".join(out) + text[last:]


def _masked_piece(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([_masked(t, s) for t, s in zip(texts_of(texts), spans.to_pylist())], pa.string())


def redact(docs: DataFrame, model: dict | None = None, text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans by that of the first."""
    mark = free_name(docs, "_pii")

    def mask(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield by_pieces(_masked_piece, texts, spans)

    found = find(docs, fit(docs, text) if model is None else model, text, mark)
    column = F.arrow_udf(mask, "string").asNondeterministic()
    return found.withColumn(text, column(F.col(text), F.col(mark)["spans"])).select(*[F.col(f"`{c}`") for c in docs.columns])
