"""Substring dedup: shared k-mer seeds, chained in order with gap costs, chains aligned word by word."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from residua.llm.texts import plain_words, sorted_groups, stored, texts_of
from residua.operators.layout import small_enough

SEED_WORDS = 8
# k-mers of which the least is a seed, so that a run of SEED_WORDS + WINNOW - 1 equal words always shares one
WINNOW = 16
GAP_COST = 0.0625
MOST_GAP = 64
FLANK = 64
LEAST_WORDS = 50
LEAST_IDENTITY = 0.8
BLOCK = 128
# chains of a pair of documents that are aligned together
BUNDLE = 512
_HELD_WORDS = 200_000


class WordHashes:
    """64-bit hashes of words; remembers a bounded number of them."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > _HELD_WORDS:
            self.memo = {}
        memo, digest = self.memo, xxhash.xxh64_intdigest
        out = []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = digest(w)
            out.append(h)
        return np.array(out, np.uint64)


def seeds_of(hashes: np.ndarray, k: int = SEED_WORDS, window: int = WINNOW,
             least_words: int = LEAST_WORDS, apart: int = FLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the winnowed k-mers; of equal ones in a row the first.

    Equal seeds stand ``apart`` words from each other; 0 keeps all of them. One word repeated ``least_words`` times or more also has a seed of its own,
    which shorter repetitions of the word do not share.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ hashes[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    size = min(window, n)
    least, reach = h, 1
    while reach < size:
        step = min(reach, size - reach)
        least = np.minimum(least[:len(least) - step], least[step:])
        reach += step
    chosen = np.zeros(n, bool)
    for shift in range(size):
        chosen[shift:shift + len(least)] |= h[shift:shift + len(least)] == least
    again = np.zeros(n, bool)
    again[1:] = chosen[:-1] & (h[1:] == h[:-1])
    at = np.flatnonzero(chosen & ~again)
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    long = starts[np.diff(np.append(starts, n)) > least_words - k]
    made = np.append(h[at], h[long] * np.uint64(3) + np.uint64(1)), np.append(at, long)
    return _apart(*made, apart) if apart else made


def _apart(hashes: np.ndarray, at: np.ndarray, words: int = FLANK) -> tuple[np.ndarray, np.ndarray]:
    """Without seeds that stand less than ``words`` after an equal one that stays.

    A sketch of a text of repeated lines. It is no base for passages: where the
    other text holds the line less often, each repetition needs its own match.
    """
    order = np.lexsort((at, hashes))
    h, place = hashes[order], at[order]
    again = np.append(False, h[1:] == h[:-1]) if len(h) else np.zeros(0, bool)
    keep = np.ones(len(at), bool)
    last = 0
    for i in np.flatnonzero(again).tolist():
        if not again[i - 1]:
            last = int(place[i - 1])
        if place[i] - last < words:
            keep[i] = False
        else:
            last = int(place[i])
    chosen = np.sort(order[keep])
    return hashes[chosen], at[chosen]


def _seed_rows(k: int, window: int, least_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            made, places, untils, owners, held = [], [], [], [], 0

            def out() -> pa.RecordBatch:
                joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (made, owners, places, untils)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(joined[0].view(np.int64), pa.int64()), pa.array(joined[1], pa.int64()),
                     *[pa.array(j.astype(np.int32), pa.int32()) for j in joined[2:]]],
                    names=["seed", "doc_id", "place", "until"])

            for doc, text in zip(ids, texts_of(batch.column("text"))):
                own = hashes.of(plain_words(text))
                h, at = seeds_of(own, k, window, least_words, apart=0)
                changes = np.append(np.flatnonzero(own[1:] != own[:-1]) + 1, len(own))
                made.append(h)
                places.append(at)
                untils.append(np.maximum(at, changes[np.searchsorted(changes, at, side="right")] - k))
                owners.append(np.full(len(at), doc, np.int64))
                held += len(at)
                if held >= _HELD_WORDS:
                    yield out()
                    made, places, untils, owners, held = [], [], [], [], 0
            yield out()

    return rows


def _stretch_rows(k: int, window: int, least_words: int):
    """Stretches of a document in which an equal run of ``least_words`` shared with another one may lie.

    Such a run has a shared seed at most ``window`` - 1 words from each of its ends, and between these
    no two neighbours further apart than ``window``, but for repetitions of one word.
    """
    names = ["doc_id", "start", "end"]
    margin = window - 1
    least = max(0, least_words - k + 1 - window - margin)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        doc = first = last = None
        for batch in batches:
            for of, at, until in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "place", "until")]):
                if of == doc and at <= last + window:
                    last = max(last, until)
                    continue
                if doc is not None and last - first >= least:
                    out.append((doc, max(0, first - margin), last + k + margin))
                doc, first, last = of, at, until
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], names=names)
                out = []
        if doc is not None and last - first >= least:
            out.append((doc, max(0, first - margin), last + k + margin))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in list(zip(*out)) or [[]] * 3], names=names)

    return rows


def _gram_rows(least_words: int):
    """(gram, doc_id, place) of each run of ``least_words`` words in the stretches."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["doc_id", "start"]):
            parts: dict[int, bytes] = {}
            for block, words in zip(group.column("block").to_pylist(), group.column("words").to_pylist()):
                parts.setdefault(block, words)
            doc, low, high = (group.column(c)[0].as_py() for c in ("doc_id", "start", "end"))
            first, words = _span(parts, low, high - 1)
            words = words[low - first:high - first].astype(np.uint64)
            n = len(words) - least_words + 1
            for at in range(0, n, _HELD_WORDS):
                size = min(_HELD_WORDS, n - at)
                h = np.zeros(size, np.uint64)
                for j in range(least_words):
                    h = (h ^ words[at + j:at + j + size]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64), pa.int64()), pa.array(np.full(size, doc, np.int64), pa.int64()),
                     pa.array(np.arange(low + at, low + at + size, dtype=np.int32), pa.int32())],
                    names=["gram", "doc_id", "place"])

    return rows


def spread_matches(x: list[int], y: list[int], whole: list[bool], every: int = WINNOW) -> tuple[list[int], list[int]]:
    """Seed matches, and of matches of whole runs that follow each other word by word one in ``every``, by y and x."""
    out = {(b, a) for a, b, w in zip(x, y, whole) if not w}
    since: dict[int, tuple[int, int]] = {}
    for b, a in sorted((b, a) for a, b, w in zip(x, y, whole) if w):
        last, kept = since.get(b - a, (-2, -2))
        if last + 1 != b or b - kept >= every:
            out.add((b, a))
            kept = b
        since[b - a] = b, kept
    ordered = sorted(out)
    return [a for _, a in ordered], [b for b, _ in ordered]


class Fenwick:
    """Best (value, number) among the ranks up to a given one."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)

    def put(self, rank: int, value: tuple[float, int]) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank]:
                self.best[rank] = value
            rank += rank & -rank

    def upto(self, rank: int) -> tuple[float, int]:
        """Over ranks below ``rank``."""
        out = (-1e18, -1)
        while rank > 0:
            out = max(out, self.best[rank])
            rank -= rank & -rank
        return out


def chains(x: list[int], y: list[int], k: int = SEED_WORDS, gap_cost: float = GAP_COST,
           most_gap: int = MOST_GAP) -> list[list[tuple[int, int]]]:
    """Collinear chains of matches (x in one text, y in the other, by y), each match in one of them.

    A match scores its words and pays for the words skipped on both sides since
    its predecessor, the best one before it on both sides. A chain is cut where
    it skips more than ``most_gap`` words.
    """
    ranks = sorted(set(x))
    tree = Fenwick(len(ranks))
    score, before = [0.0] * len(x), [-1] * len(x)
    waiting: list[int] = []
    for i, (a, b) in enumerate(zip(x, y)):
        if waiting and y[waiting[-1]] < b:  # only matches that are strictly earlier in y may precede
            for j in waiting:
                tree.put(bisect_left(ranks, x[j]), (score[j] + gap_cost * (x[j] + y[j]), j))
            waiting = []
        value, j = tree.upto(bisect_left(ranks, a))
        gain = value - gap_cost * (a + b)
        score[i], before[i] = k + max(0.0, gain), j if gain > 0 else -1
        waiting.append(i)
    used = [False] * len(x)
    out = []
    for i in sorted(range(len(x)), key=lambda i: (-score[i], i)):
        chain: list[tuple[int, int]] = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and max(chain[-1][0] - x[i], chain[-1][1] - y[i]) > most_gap:
                out.append(chain[::-1])
                chain = []
            chain.append((x[i], y[i]))
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


_CHAINS = pa.list_(pa.struct([("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32()))]))
_CHAINS_SQL = "array<struct<xs:array<int>,ys:array<int>>>"


def _chain_rows(k: int, gap_cost: float, most_gap: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int32(), _CHAINS]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)],
                                              names=["doc_id", "ref_id", "bundle", "chains"])

        for group in sorted_groups(batches, ["doc_id", "ref_id"]):
            doc, ref = group.column("doc_id")[0].as_py(), group.column("ref_id")[0].as_py()
            x, y = spread_matches(*[group.column(c).to_pylist() for c in ("x", "y", "whole")])
            found = chains(x, y, k, gap_cost, most_gap)
            found.sort(key=lambda c: (c[0][1], c[0][0]))
            for number, at in enumerate(range(0, len(found), BUNDLE)):
                some = found[at:at + BUNDLE]
                out.append((doc, ref, number, [{"xs": [p[0] for p in c], "ys": [p[1] for p in c]} for c in some]))
                held += len(some)
            if held >= 5_000:
                yield made()
                out, held = [], 0
        yield made()

    return rows


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        owners, numbers, words, held = [], [], [], 0
        for doc, text in zip(ids, texts_of(batch.column("text"))):
            own = hashes.of(plain_words(text)).astype(np.uint32)
            for number in range(0, -(-len(own) // BLOCK)):
                owners.append(doc)
                numbers.append(number)
                words.append(own[number * BLOCK:(number + 1) * BLOCK].tobytes())
            held += len(own)
            if held > 10 * _HELD_WORDS:
                yield _blocks(owners, numbers, words)
                owners, numbers, words, held = [], [], [], 0
        yield _blocks(owners, numbers, words)


def _blocks(owners: list, numbers: list, words: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(owners, pa.int64()), pa.array(numbers, pa.int32()), pa.array(words, pa.binary())],
        names=["of_id", "block", "words"])


def edit_columns(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Columns (equal, words of a, words of b) of a global alignment with the fewest edits.

    Of these the one with the most equal words, and then the fewest columns.
    """
    rows = [[(j, 0, j) for j in range(len(b) + 1)]]  # (edits, -equal, columns)
    for i, u in enumerate(a, 1):
        above, row = rows[-1], [(i, 0, i)]
        for j, v in enumerate(b, 1):
            e, m, c = above[j - 1]
            best = (e, m - 1, c + 1) if u == v else (e + 1, m, c + 1)
            for e, m, c in (above[j], row[j - 1]):
                best = min(best, (e + 1, m, c + 1))
            row.append(best)
        rows.append(row)
    i, j = len(a), len(b)
    out = []
    while i or j:
        at = rows[i][j]
        if i and j:
            same = a[i - 1] == b[j - 1]
            e, m, c = rows[i - 1][j - 1]
            if at == ((e, m - 1, c + 1) if same else (e + 1, m, c + 1)):
                out.append((int(same), 1, 1))
                i, j = i - 1, j - 1
                continue
        if i and at == (rows[i - 1][j][0] + 1, rows[i - 1][j][1], rows[i - 1][j][2] + 1):
            out.append((0, 1, 0))
            i -= 1
        else:
            out.append((0, 0, 1))
            j -= 1
    return out[::-1]


def edit_matches(a: list[int], b: list[int]) -> tuple[int, int]:
    """(equal words, columns) of a global alignment with the fewest edits."""
    made = edit_columns(a, b)
    return sum(c[0] for c in made), len(made)


def _reach(equal: np.ndarray) -> int:
    """How far an extension goes: where equal words (+1) outweigh different ones (-2) the most."""
    if not len(equal):
        return 0
    total = np.cumsum(np.where(equal, 1, -2))
    best = int(total.argmax())
    return best + 1 if total[best] > 0 else 0


# words skipped on each side to get past an insertion, a deletion or a longer change, the fewest first
_SKIPS = sorted(((u, v) for u in range(4) for v in range(4) if u or v), key=lambda s: (sum(s), s))
_RESUME = 4


def _straight(equal: np.ndarray) -> np.ndarray:
    """Columns of two pieces of the same length, word against word."""
    out = np.ones((len(equal), 3), np.int64)
    out[:, 0] = equal
    return out


def _extend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Columns (equal, words of a, words of b) of an extension from the start of both arrays."""
    i = j = 0
    parts = [np.zeros((0, 3), np.int64)]
    while True:
        size = min(len(a) - i, len(b) - j)
        more = a[i:i + size] == b[j:j + size]
        grown = _reach(more)
        parts.append(_straight(more[:grown]))
        i, j = i + grown, j + grown
        for u, v in _SKIPS:
            x, y = a[i + u:i + u + _RESUME], b[j + v:j + v + _RESUME]
            if len(x) == len(y) == _RESUME and (x == y).all():
                i, j = i + u, j + v
                parts.append(np.array([(0, n < u, n < v) for n in range(max(u, v))], np.int64))
                break
        else:
            return np.concatenate(parts)


def align(ref: np.ndarray, doc: np.ndarray, xs: list[int], ys: list[int], k: int = SEED_WORDS,
          flank: int = FLANK) -> tuple[int, int, np.ndarray]:
    """(ref start, doc start, columns) of a chain in two word arrays; columns are (equal, words of ref, words of doc)."""
    x0, y0 = xs[0], ys[0]
    back = _extend(ref[max(0, x0 - flank):x0][::-1], doc[max(0, y0 - flank):y0][::-1])[::-1]
    parts = [back]
    at_x, at_y = x0, y0
    for x, y in zip(xs, ys):
        if x + k <= at_x or y + k <= at_y:
            continue
        if x + k - at_x == y + k - at_y:
            parts.append(_straight(ref[at_x:x + k] == doc[at_y:y + k]))
        else:
            parts.append(np.array(edit_columns(ref[at_x:x + k].tolist(), doc[at_y:y + k].tolist()), np.int64))
        at_x, at_y = x + k, y + k
    parts.append(_extend(ref[at_x:at_x + flank], doc[at_y:at_y + flank]))
    return x0 - int(back[:, 1].sum()), y0 - int(back[:, 2].sum()), np.concatenate(parts)


def pieces(columns: np.ndarray, least_words: int = LEAST_WORDS, least_identity: float = LEAST_IDENTITY) -> list[tuple[int, int]]:
    """Runs (start, end) of columns that reach the identity and the words of the document by themselves.

    All of the columns if they do. Else runs that start and end with equal words
    and together hold every column that lies in any such run; few of them overlap.
    """
    n = len(columns)
    over = np.append(0.0, np.cumsum(columns[:, 0] - least_identity))
    starts = np.flatnonzero(columns[:, 0])
    if not n or not len(starts):
        return []
    best_after = np.maximum.accumulate(over[::-1])[::-1]
    ends = np.searchsorted(-best_after, 1e-9 - over[starts], side="right") - 1  # the last place that keeps the identity
    after_equal = np.maximum.accumulate(np.append(0, np.where(columns[:, 0] > 0, np.arange(1, n + 1), 0)))
    ends = after_equal[ends]
    words = np.append(0, np.cumsum(columns[:, 2]))
    fits = (ends > starts) & (words[ends] - words[starts] >= least_words)
    out: list[tuple[int, int]] = []
    known = list(zip(starts[fits].tolist(), ends[fits].tolist()))
    i = reached = 0
    while i < len(known):
        if known[i][0] > reached:
            reached = known[i][0]
        best = (0, 0)
        while i < len(known) and known[i][0] <= reached:
            if known[i][1] > best[1]:
                best = known[i]
            i += 1
        if best[1] > reached:
            out.append(best)
            reached = best[1]
    return out


def _span(parts: dict[int, bytes], low: int, high: int) -> tuple[int, np.ndarray]:
    """(first place, words) of the blocks that hold the places from ``low`` to ``high``, up to a missing one."""
    first = low // BLOCK
    blocks = []
    for number in range(first, high // BLOCK + 1):
        if number not in parts:
            break
        blocks.append(parts[number])
    return first * BLOCK, np.frombuffer(b"".join(blocks), np.uint32)


def _aligned_rows(k: int, flank: int, least_words: int, least_identity: float):
    names = ["doc_id", "start_word", "end_word", "ref_doc_id", "ref_start_word", "ref_end_word", "n_words", "identity"]
    kinds = [pa.int64()] * 7 + [pa.float64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in sorted_groups(batches, ["doc_id", "ref_id", "bundle"]):
            one = group.column
            parts: tuple[dict[int, bytes], dict[int, bytes]] = ({}, {})
            for side, block, words in zip(one("side").to_pylist(), one("block").to_pylist(), one("words").to_pylist()):
                parts[side].setdefault(block, words)
            known = one("chains").drop_null()
            if not len(known):
                continue
            doc_id, ref_id = one("doc_id")[0].as_py(), one("ref_id")[0].as_py()
            reported: set[tuple[int, int, int, int]] = set()
            for chain in known[0].as_py():
                xs, ys = chain["xs"], chain["ys"]
                from_ref, ref = _span(parts[0], max(0, xs[0] - flank), xs[-1] + k + flank - 1)
                from_doc, doc = _span(parts[1], max(0, ys[0] - flank), ys[-1] + k + flank - 1)
                if not len(ref) or not len(doc):
                    continue
                at_ref, at_doc, columns = align(ref, doc, [x - from_ref for x in xs], [y - from_doc for y in ys], k, flank)
                sums = np.append(np.zeros((1, 3), np.int64), np.cumsum(columns, 0), 0)
                for start, end in pieces(columns, least_words, least_identity):
                    (_, a, c), (_, b, d) = sums[[start, end]].tolist()
                    place = (c + at_doc + from_doc, d + at_doc + from_doc, a + at_ref + from_ref, b + at_ref + from_ref)
                    if place not in reported:
                        reported.add(place)
                        out.append((doc_id, *place[:2], ref_id, *place[2:], d - c,
                                    int(sums[end, 0] - sums[start, 0]) / (end - start)))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*out)) or [[]] * 8, kinds)], names=names)

    return rows


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SEED_WORDS,
                      window: int = WINNOW, gap_cost: float = GAP_COST, most_gap: int = MOST_GAP, flank: int = FLANK,
                      least_words: int = LEAST_WORDS, least_identity: float = LEAST_IDENTITY) -> DataFrame:
    """Passages that a document shares with an earlier one (of a smaller id), exactly or nearly.

    (doc_id, start_word, end_word, ref_doc_id, ref_start_word, ref_end_word, n_words, identity); ends
    are exclusive, words are lower-cased runs of letters, digits and non-ASCII characters. Rows with a
    null id or text have no passages; rows that share an id are one document, whose words are those of
    any one of them if they differ; empty tables give empty ones. Passages inside one document alone
    are not reported. Overlapping passages of different chains are reported one by one. A chain below
    the identity is reported by its runs that reach it.

    Each seed of a document meets the first occurrence of that seed in the corpus, so a seed that n
    documents share makes n - 1 matches. First occurrences are aggregated before the shuffle; a
    frequent seed is joined to one row. Of documents only the blocks of words that chains touch move.

    Seeds of one passage may have different first owners that hold parts of it only. So where shared
    seeds follow each other over ``least_words``, each run of that many words also meets the first
    place that holds the whole run.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    seeds = stored(rows.mapInArrow(_seed_rows(k, window, least_words), "seed long, doc_id long, place int, until int"), "seeds")
    first = seeds.groupBy("seed").agg(
        F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("last"),
    ).filter("first.doc_id < last").select("seed", F.col("first.doc_id").alias("ref_id"), F.col("first.place").alias("x"))
    shared = stored(seeds.join(first, "seed").select("doc_id", "ref_id", "x", "place", "until"), "shared")

    def blocks_in(wanted: DataFrame) -> DataFrame:
        if small_enough(wanted, 16):
            wanted = F.broadcast(wanted)
        return rows.join(wanted, "doc_id", "left_semi").mapInArrow(_block_rows, "of_id long, block int, words binary")

    by_place = shared.select("doc_id", "place", "until").repartition("doc_id").sortWithinPartitions("doc_id", "place")
    stretches = stored(by_place.mapInArrow(
        _stretch_rows(k, window, least_words), "doc_id long, start long, end long"), "stretches")
    parts = stretches.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / BLOCK).cast("int"), F.floor((F.col("end") - 1) / BLOCK).cast("int"))))
    texts = blocks_in(stored(stretches.select("doc_id").distinct(), "stretched")).withColumnRenamed("of_id", "doc_id")
    laid = parts.join(texts, ["doc_id", "block"]).repartition("doc_id", "start").sortWithinPartitions("doc_id", "start", "block")
    grams = stored(laid.mapInArrow(_gram_rows(least_words), "gram long, doc_id long, place int"), "grams")
    holder = grams.groupBy("gram").agg(
        F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("last"),
    ).filter("first.doc_id < last").select("gram", F.col("first.doc_id").alias("ref_id"), F.col("first.place").alias("x"))
    kinds = ((shared, False), (grams.join(holder, "gram"), True))
    matches, whole = (t.filter("doc_id <> ref_id").select(
        "doc_id", "ref_id", "x", F.col("place").alias("y"), F.lit(w).alias("whole")) for t, w in kinds)
    matches = matches.unionByName(whole)
    order = ["doc_id", "ref_id", "y", "x"]
    placed = matches.repartition("doc_id").sortWithinPartitions(*order)
    found = stored(placed.mapInArrow(
        _chain_rows(k, gap_cost, most_gap), f"doc_id long, ref_id long, bundle int, chains {_CHAINS_SQL}"), "chains")

    def side(number: int, of: str, places: str) -> DataFrame:
        def blocks_of(chain):
            low = F.greatest(F.lit(0), F.element_at(chain[places], 1) - flank)
            high = F.element_at(chain[places], -1) + k + flank - 1
            return F.sequence(F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int"))

        blocks = F.array_sort(F.array_distinct(F.flatten(F.transform("chains", blocks_of))))
        return found.select("*", F.posexplode(blocks).alias("_at", "block")).select(
            "doc_id", "ref_id", "bundle", F.lit(number).alias("side"), F.col(of).alias("of_id"), "block",
            F.when((F.col("_at") == 0) & (F.lit(number) == 1), F.col("chains")).alias("chains"))

    asked = side(0, "ref_id", "xs").unionByName(side(1, "doc_id", "ys"))
    wanted = stored(found.select(F.explode(F.array("doc_id", "ref_id")).alias("doc_id")).distinct(), "wanted")
    blocks = blocks_in(wanted)
    met = asked.join(blocks, ["of_id", "block"]).select("doc_id", "ref_id", "bundle", "side", "block", "chains", "words")
    keys = ["doc_id", "ref_id", "bundle"]
    gathered = met.repartition(*keys).sortWithinPartitions(*keys, "side", "block")
    return gathered.mapInArrow(
        _aligned_rows(k, flank, least_words, least_identity),
        "doc_id long, start_word long, end_word long, ref_doc_id long, ref_start_word long, ref_end_word long, "
        "n_words long, identity double")
