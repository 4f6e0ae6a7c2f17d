"""Exact set-similarity join on word n-grams: size bands, bitmap signatures in tiles, sorted-array intersection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from residua.llm.texts import sorted_groups, space_words, stored, texts_of
from residua.operators.cluster import components
from residua.operators.layout import small_enough

SHINGLE = 3
PERCENT = 90
# sets of one tile; a cell with more is dealt over a grid of tiles
TILE = 1024
# bits of the widest bitmap; larger sets get a looser bound, never a wrong one
WIDEST = 1 << 14
# hashes of one block of a sorted array
BLOCK = 1024
# how much larger a band's largest set is than its smallest
_GROWTH = 1.37

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ROW = pa.struct([("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary()),
                  ("cells", pa.list_(pa.int64()))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of ``size`` words; of the whole text if it has fewer."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    table = np.array([digest(w) for w in words], np.uint64)
    size = min(size, len(table))
    out = np.full(len(table) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out * _A) ^ _mixed(table[i:len(table) - size + 1 + i] + np.uint64(i))
    return np.unique(_mixed(out))


def most_apart(total: int, percent: int = PERCENT) -> int:
    """The most elements two linked sets of ``total`` elements together may not share."""
    return total * (100 - percent) // (100 + percent)


def bands(percent: int = PERCENT, upto: int = 1 << 40) -> np.ndarray:
    """The smallest size of each band; a set and its partners lie in one band or in two that follow each other."""
    grow = max(_GROWTH, 1.02 * 100 / percent)
    lows = [1]
    while lows[-1] < upto:
        lows.append(max(lows[-1] + 1, int(lows[-1] * grow)))
    return np.array(lows)


def set_cells(values: np.ndarray, lows: np.ndarray, percent: int = PERCENT) -> list[int]:
    """Hashes of the parts of a set, for its own band and the next where it has partners there.

    In a band two linked sets differ in at most d elements, so of d + 1 parts
    by hash one is equal in both: they meet in that part's cell. Where d is
    zero linked sets are equal and no cell is needed.
    """
    n, out = len(values), []
    own = int(np.searchsorted(lows, n, "right")) - 1
    mixed = _mixed(values)
    for band in (own, own + 1):
        if band != own and n * 100 // percent < lows[band]:
            continue
        parts = most_apart(2 * (int(lows[band + 1]) - 1), percent) + 1
        if parts == 1:
            continue
        part = ((mixed >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        filled, starts = np.unique(part[order], return_index=True)
        sums = np.zeros(parts, np.uint64)
        sums[filled] = np.add.reduceat(mixed[order], starts)
        tag = np.arange(parts, dtype=np.uint64) * _A + np.uint64(band)
        out += _mixed(sums ^ _mixed(tag)).view(np.int64).tolist()
    return out


def bitmap(values: np.ndarray) -> bytes:
    """A bit for each hash modulo the width, toggled by each element; about one bit an element."""
    width = 64
    while width < min(len(values), WIDEST):
        width *= 2
    odd = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: bytes, words: int) -> np.ndarray:
    """The bitmap of the same set at a smaller width."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, words), axis=0)


def _signatures(size: int, percent: int):
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lows = bands(percent)
        for texts in batches:
            rows = []
            for text in texts_of(texts):
                values = shingle_set(text, size)
                whole = xxhash.xxh3_128_digest(values.tobytes())
                high, low = np.frombuffer(whole, np.int64).tolist()
                some = len(values) > 0
                rows.append((high, low, len(values), bitmap(values) if some else b"",
                             set_cells(values, lows, percent) if some else []))
            made = list(zip(*rows)) or [[]] * len(_ROW)
            yield pa.StructArray.from_arrays([pa.array(m, f.type) for m, f in zip(made, _ROW)], fields=list(_ROW))

    return F.arrow_udf(sign, "high long, low long, n long, bitmap binary, cells array<long>").asNondeterministic()


def _depth(n: int) -> int:
    """Leading bits of a hash that number its block, for sets of a band that holds ``n`` at most."""
    return max(0, (-(-n // BLOCK) - 1).bit_length())


def _block_table(size: int, percent: int):
    """(high, low, depth, block, hashes) of each text, at the depth of its band and of the next where that differs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = bands(percent)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                values = shingle_set(text, size)
                if not len(values):
                    continue
                high, low = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64).tolist()
                own = int(np.searchsorted(lows, len(values), "right")) - 1
                out = []
                for depth in sorted({_depth(int(lows[b + 1])) for b in (own, own + 1)}):
                    at = (values >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(values), np.int64)
                    blocks, starts = np.unique(at, return_index=True)
                    out += [(high, low, depth, int(b), v.tobytes())
                            for b, v in zip(blocks, np.split(values, starts[1:]))]
                names = ("high", "low", "depth", "block", "hashes")
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                for i in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i:i + 256]), kinds)], names=names)

    return cut


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many hashes two sorted blocks share."""
    for batch in batches:
        counts = []
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            for x, y in zip(part.column("_x").to_pylist(), part.column("_y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                counts.append(int(np.count_nonzero(y[at] == x)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), batch.column("need"), pa.array(counts, pa.int64())],
            names=["a", "b", "need", "shared"])


def _verified(pairs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b) of (a, b, na, nb) that are linked: block by block the sorted arrays are intersected.

    A pair meets at the depth of the larger set's band, so both are cut alike
    and no row holds more than one block of either.
    """
    lows = bands(percent)
    top = F.greatest("na", "nb")
    depth = F.lit(0)
    for low, after in zip(lows.tolist(), lows[1:].tolist()):
        if _depth(after):
            depth = F.when(top >= low, _depth(after)).otherwise(depth) if _depth(after) != _depth(low) else depth
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    # in whole numbers; the division above may be off by one at exact borders
    need = F.when((need - 1) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent, need - 1).otherwise(need)
    asked = stored(pairs.select("a", "b", depth.cast("int").alias("depth"), need.cast("long").alias("need")), "pairs")
    if small_enough(asked, 64):
        asked = F.broadcast(asked)
    # each side finds its own blocks, so only blocks of pairs are shuffled
    left = asked.join(blocks.select(F.col("node").alias("a"), "depth", "block", F.col("hashes").alias("_x")), ["a", "depth"])
    right = asked.join(blocks.select(F.col("node").alias("b"), "depth", "block", F.col("hashes").alias("_y")), ["b", "depth"])
    both = left.join(right.select("a", "b", "block", "_y"), ["a", "b", "block"])
    counted = both.select("a", "b", "need", "_x", "_y").mapInArrow(_shared, "a long, b long, need long, shared long")
    sums = counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("need").alias("need"))
    return stored(sums.filter("shared >= need").select("a", "b"), "verified")


def _bounded(percent: int):
    """(a, b, na, nb) of the pairs whose sizes and bitmaps leave room for a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            room = (na + nb) * (100 - percent) // (100 + percent)
            apart = np.abs(na - nb)
            for i, (x, y) in enumerate(zip(batch.column("_bits_a"), batch.column("_bits_b"))):
                if apart[i] <= room[i]:
                    x, y = x.as_py(), y.as_py()
                    words = min(len(x), len(y)) // 8
                    apart[i] = np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(apart <= room))

    return keep


def _tile_pairs(percent: int, nearest: bool):
    """Pairs of a tile whose bitmaps leave room for a link between different components."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0

        def batch_of():
            table = np.concatenate(found) if found else np.empty((0, 4), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(4)], names=["a", "b", "na", "nb"])

        for group in sorted_groups(batches, ["cell", "tile", "other_tile"]):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            node, n, comp, piece = (group.column(c).to_numpy() for c in ("node", "n", "comp", "piece"))
            rows = group.column("bitmap").to_pylist()
            words = min(len(b) for b in rows) // 8
            bits = np.stack([_folded(b, words) for b in rows])
            first, second = group.column("tile")[0].as_py(), group.column("other_tile")[0].as_py()
            for i in range(len(node)):
                if first == second:
                    others = np.arange(i + 1, len(node))
                elif piece[i] == first:
                    others = np.flatnonzero(piece == second)
                else:
                    continue
                others = others[comp[others] != comp[i]]
                # each element that only one of two sets holds toggles one bit, so the bits that differ are no more
                # than those elements, and (na + nb - bits) / 2 bounds the overlap from above
                apart = np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64)
                room = (n[others] + n[i]) * (100 - percent) // (100 + percent)
                fits = (apart <= room) & (np.abs(n[others] - n[i]) <= room)
                others, apart = others[fits], apart[fits]
                if nearest and len(others):
                    others = others[[np.argmin(apart)]]
                if len(others):
                    one, two = np.minimum(node[others], node[i]), np.maximum(node[others], node[i])
                    swap = node[others] < node[i]
                    found.append(np.stack([one, two, np.where(swap, n[others], n[i]), np.where(swap, n[i], n[others])], 1))
                    held += len(others)
            if held >= 20_000:
                yield batch_of()
                found, held = [], 0
        yield batch_of()

    return compare


def _candidates(members: DataFrame, classes: DataFrame, comp: DataFrame, percent: int, nearest: bool,
                tile: int) -> DataFrame:
    """(a, b, na, nb): pairs that share a cell, lie in different components and may be linked by their bitmaps."""
    placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = stored(placed.select("cell", "node", "comp"), "placed")
    live = placed.groupBy("cell").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.count("node").alias("_n"))
    live = stored(live.filter("_low < _high").select("cell", F.ceil(F.col("_n") / tile).cast("int").alias("_tiles")), "live")
    rows = placed.join(live, "cell").join(classes.select("node", "n", "bitmap"), "node")
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("node"), "_tiles").cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    order = ["cell", "tile", "other_tile"]
    tiles = dealt.select("cell", F.least("piece", "_other").alias("tile"), F.greatest("piece", "_other").alias("other_tile"),
                         "piece", "node", "n", "comp", "bitmap")
    pairs = tiles.repartition(*order).sortWithinPartitions(*order).mapInArrow(
        _tile_pairs(percent, nearest), "a long, b long, na long, nb long")
    return stored(pairs.distinct(), "candidates")


def _blocks(docs: DataFrame, touched: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, depth, block, hashes) of the classes in ``touched`` (node, high, low, first_id)."""
    ids = touched.select(F.col("first_id").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    if small_enough(ids, 16):
        ids = F.broadcast(ids)
    texts = docs.join(ids, "doc_id", "left_semi").select("text")
    unnamed = not touched.filter("first_id IS NULL").isEmpty()
    if unnamed:
        texts = texts.unionByName(docs.filter("doc_id IS NULL").select("text"))
    cut = texts.mapInArrow(_block_table(size, percent), "high long, low long, depth int, block long, hashes binary")
    nodes = touched.select("high", "low", "node")
    if small_enough(nodes, 64):
        nodes = F.broadcast(nodes)
    named = cut.join(nodes, ["high", "low"]).select("node", "depth", "block", "hashes")
    again = docs.select("doc_id").join(ids, "doc_id", "left_semi").groupBy("doc_id").count().filter("count > 1")
    if not unnamed and again.isEmpty():
        return stored(named, "blocks")
    # rows that repeat an id and a text give equal blocks
    return stored(named.groupBy("node", "depth", "block").agg(F.first("hashes").alias("hashes")), "blocks")


def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                          percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component): one row per row of ``docs``.

    A text's set is that of its different runs of ``size`` words (A-Z
    lower-cased, ASCII blanks between words); a shorter text is one run. Texts
    are linked when the shared runs are at least ``percent`` of all runs of
    both, and the component is the smallest doc_id reachable over links. A null
    or blank text has an empty set and is linked with nothing, not with its
    like either. Rows that share an id are judged by their own texts. A null
    doc_id links others but names no component: where all ids are null it is
    null. Other columns are not used; an empty table gives an empty one.

    No link is lost: sizes fall into bands, in each of which linked sets agree
    on at least one part of their hashes. Equal sets are one class from the
    start. In every cell each class is first tried against one other (a star),
    then the tiles compare what is still in different components by bitmaps,
    nearest pairs before all. Every link is confirmed on the sorted arrays.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = stored(docs.select("doc_id", _signatures(size, percent)(F.col("text")).alias("s")).select("doc_id", "s.*"), "sets")
    grouped = marked.filter("n > 0").groupBy("high", "low").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"),
        F.first("cells").alias("cells"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    met = classes.select("node", F.explode("cells").alias("cell"))
    # a class enters a cell once
    live = stored(met.groupBy("cell").count().filter("count > 1").select("cell"), "cells")
    if small_enough(live, 16):
        live = F.broadcast(live)
    members = stored(met.join(live, "cell"), "members")
    touched = stored(classes.select("node", "high", "low", "first_id").join(
        members.select("node").distinct(), "node", "left_semi"), "touched")
    blocks = _blocks(docs, touched, size, percent)

    heads = members.groupBy("cell").agg(F.min("node").alias("head"))
    stars = members.join(heads, "cell").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    for end, n, bits in (("a", "na", "_bits_a"), ("b", "nb", "_bits_b")):
        stars = stars.join(classes.select(F.col("node").alias(end), F.col("n").alias(n), F.col("bitmap").alias(bits)), end)
    stars = stars.mapInArrow(_bounded(percent), "a long, b long, na long, nb long")
    links = _verified(stars, blocks, percent)
    comp = _labels(links)
    for nearest in (True, False):
        pairs = _candidates(members, classes, comp, percent, nearest, tile)
        if pairs.isEmpty():
            break
        more = _verified(pairs, blocks, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = _labels(links)

    labelled = classes.select("high", "low", "node", "first_id").join(comp, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    least = labelled.groupBy("comp").agg(F.min("first_id").alias("component"))
    known = stored(labelled.join(least, "comp").select("high", "low", "component"), "known")
    found = marked.select("doc_id", "high", "low", "n").join(known, ["high", "low"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def _labels(links: DataFrame) -> DataFrame:
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return stored(components(links, ends).select(F.col("id").alias("node"), F.col("component").alias("comp")), "labels")
