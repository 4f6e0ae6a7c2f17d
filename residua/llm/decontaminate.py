"""Benchmark decontamination: test n-grams in a broadcast hash set, scanned over training tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residua.llm.texts import by_pieces, free_name, plain_words, texts_of

WINDOW = 13
# bytes of benchmark text that go into one broadcast set; a larger benchmark is scanned set after set
SET_BYTES = 32 << 20
# words of documents looked at together
_SCAN_WORDS = 200_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPANS = "array<struct<start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class WindowSet:
    """All windows of some items: hashes for the scan, word numbers for the check."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.words: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list]] = {}
        for item_id, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in plain_words(text)], np.int32)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                owners = self.windows.setdefault(size, {}).setdefault(ids[i:i + size].tobytes(), [])
                if item_id not in owners:
                    owners.append(item_id)
        self.factors = np.random.default_rng(13).integers(0, 2**63, window, np.uint64) * np.uint64(2) + np.uint64(1)
        self.hashes = {}
        for size, known in self.windows.items():
            table = np.frombuffer(b"".join(known), np.int32).reshape(-1, size)
            self.hashes[size] = np.unique(self._hash(table))

    def _hash(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros(len(table), np.uint64)
        for i in range(table.shape[1]):
            out = (out ^ (table[:, i].astype(np.uint64) * self.factors[i])) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, list]]:
        """(first word, length, item ids) of each occurrence; 0 stands for a word of no item."""
        at = np.arange(len(ids))
        run = at - np.maximum.accumulate(np.where(ids == 0, at, -1))
        for size, hashes in self.hashes.items():
            starts = np.flatnonzero(run >= size) - size + 1
            for part in range(0, len(starts), 100_000):
                some = starts[part:part + 100_000]
                found = self._hash(ids[some[:, None] + np.arange(size)])
                place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                for start in some[hashes[place] == found].tolist():
                    owners = self.windows[size].get(ids[start:start + size].tobytes())
                    if owners is not None:  # else another window with this hash
                        yield start, size, owners


def _scan_batch(known: WindowSet, texts: pa.Array) -> pa.Array:
    get = known.words.get
    counts: list[int] = []
    spans: list[list[dict]] = []
    items: list[list[int]] = []
    ids: list[int] = []
    bounds: list[int] = []

    def settle() -> None:
        found: dict[int, tuple[list, set]] = {}
        edges = np.array(bounds)
        for start, size, owners in known.hits(np.array(ids, np.int32)):
            doc = int(np.searchsorted(edges, start, "right")) - 1
            ranges, seen = found.setdefault(doc, ([], set()))
            ranges.append((start - bounds[doc], start - bounds[doc] + size))
            seen.update(o for o in owners if o is not None)
        for doc in range(len(bounds)):
            ranges, seen = found.get(doc, ((), ()))
            merged: list[list[int]] = []
            for start, end in sorted(ranges):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            spans.append([{"start": a, "end": b} for a, b in merged])
            items.append(sorted(seen))
        ids.clear()
        bounds.clear()

    for text in texts_of(texts):
        words = plain_words(text)
        counts.append(len(words))
        bounds.append(len(ids))
        ids.extend([get(w, 0) for w in words])
        ids.append(0)
        if len(ids) >= _SCAN_WORDS:
            settle()
    settle()
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.int64()))],
        names=["n_words", "spans", "items"],
    )


def _look(known):
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = WindowSet.__new__(WindowSet)
        windows.__dict__.update(known.value)
        for texts in batches:
            yield _scan_batch(windows, texts)

    return F.arrow_udf(look, f"n_words:long,spans:{SPANS},items:array<long>").asNondeterministic()


def _window_sets(benchmark: DataFrame, item_id: str, text: str, window: int, set_bytes: int) -> Iterator:
    """Broadcast sets that together hold every item, each of a bounded text size."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // set_bytes
    for part in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        # plain containers: executors need no copy of this package to read them
        yield spark.sparkContext.broadcast(vars(WindowSet([tuple(r) for r in own.collect()], window)))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, into: str = "scan",
         set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit, spans of hit words, ids of the items that occur.

    Words are lower-cased runs of letters, digits and non-ASCII characters. An
    item's windows are all its runs of ``window`` words, or the whole item when
    it is shorter; items without words have none. A null text has no words and
    no hits; rows are kept as they are, repeated ones too. Items that share an
    id count once, items with a null id mark words but are not listed. An empty
    benchmark hits nothing. ``into`` must not be a column of ``docs``.

    The documents are read in place without a shuffle. The broadcast set has a
    bounded size; a benchmark beyond it is scanned in several sets whose spans
    are united.
    """
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{into} is a column already")
    parts = []
    out = docs
    for number, known in enumerate(_window_sets(benchmark, item_id, item_text, window, set_bytes)):
        name = free_name(docs, f"_{into}{number}")
        out = out.withColumn(name, _look(known)(F.col(text)))
        parts.append(name)
    spans = F.array_sort(F.concat(*[F.col(p)["spans"] for p in parts]))
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(p)["items"] for p in parts])))
    result = F.struct(
        F.col(parts[0])["n_words"].alias("n_words"), covered(spans).alias("n_hit"), spans.alias("spans"),
        items.alias("items"),
    )
    return out.withColumn(into, result).drop(*parts)


def covered(spans: Column) -> Column:
    """Number of places inside any of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"]))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
        lambda a: a["n"],
    )


def contaminated(n_words: Column, n_hit: Column, one_in: int = 20) -> Column:
    """Whether at least one word in ``one_in`` is hit."""
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def _without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cut in zip(texts_of(texts), spans.to_pylist()):
        if text and cut:
            places = [m.span() for m in _WORD.finditer(text)]
            kept, last = [], 0
            for s in sorted(cut, key=lambda s: s["start"]):
                kept.append(text[last:max(last, places[s["start"]][0])])
                last = max(last, places[s["end"] - 1][1])
            text = "".join(kept) + text[last:]
        out.append(text)
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """``docs`` with every benchmark passage cut out of the text; other texts stay as they are."""
    mark = free_name(docs, "_hits")

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            yield by_pieces(_without_spans, texts, spans)

    column = F.arrow_udf(cut, "string").asNondeterministic()
    found = scan(docs, benchmark, text, into=mark, **kw)
    return found.withColumn(text, column(F.col(text), F.col(mark)["spans"])).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", one_in: int = 20, **kw) -> DataFrame:
    """``docs`` without those in which at least one word in ``one_in`` lies in a benchmark window."""
    mark = free_name(docs, "_hits")
    found = scan(docs, benchmark, text, into=mark, **kw)
    return found.filter(~contaminated(F.col(mark)["n_words"], F.col(mark)["n_hit"], one_in)).drop(mark)
