"""SimHash near-duplicates: shard trees keyed by Hamming distance, linked into components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from residua.llm.texts import free_name, plain_words, sorted_groups, space_words, stored, texts_of
from residua.operators.cluster import components
from residua.operators.layout import small_enough

SHINGLE = 4
RADIUS = 4
SEED = 42
# fingerprints that one tree may hold; a larger shard becomes several trees
TREE_SIZE = 4096
# fingerprints that share a shard on average, which sets how many bits a shard's key has
SHARD_FILL = 64


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; each is 1 if it is set in over half of the hashed shingles, repeats included."""
    words = space_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    table = np.array(hashes, np.uint64)
    for part in range(0, len(table), 1 << 16):
        bits = np.unpackbits(table[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp", size: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a signed 64-bit column; zero for a text without words."""

    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_signed(fingerprint(t, size, seed)) for t in texts_of(texts)], pa.int64())

    return docs.withColumn(into, F.arrow_udf(digest, "long").asNondeterministic()(F.col(text)))


class BKTree:
    """Each child hangs on the edge numbered by its Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.edges.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            at = self.edges[at].setdefault((value ^ self.values[at]).bit_count(), new)

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the values within the radius; only edges within it are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            low, high = distance - radius, distance + radius
            todo += [child for edge, child in self.edges[at].items() if low <= edge <= high]
        return found


def masks(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """Bit masks of all unions of ``blocks - radius`` blocks.

    Two values within the radius agree on at least one of them, as ``radius``
    differing bits touch at most ``radius`` blocks.
    """
    borders = [round(i * bits / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(borders, borders[1:])]
    return [sum(c) for c in combinations(single, blocks - radius)]


def blocks_for(rows: int, radius: int, fill: int = SHARD_FILL, bits: int = 64) -> int:
    """The fewest blocks whose shards hold about ``fill`` of ``rows`` values that lie at random."""
    blocks = radius + 1
    while blocks < 4 * radius + 2 and rows / 2 ** (bits * (blocks - radius) / blocks) > fill:
        blocks += 1
    return blocks


def _unsigned(value: int) -> int:
    return value & 0xFFFFFFFFFFFFFFFF


def _tree_links(radius: int, words: list[str]):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[int] = []
        right: list[int] = []
        for group in sorted_groups(batches, ["part", "shard", "tree", "other_tree"]):
            if group.num_rows < 2:
                continue
            values, piece = group.column("node").to_pylist(), group.column("piece").to_pylist()
            low, high = group.column("tree")[0].as_py(), group.column("other_tree")[0].as_py()
            tree, joined = BKTree(), list(range(len(values)))

            def root(i: int) -> int:
                while joined[i] != i:
                    joined[i] = joined[joined[i]]
                    i = joined[i]
                return i

            held: list[int] = []
            unsigned = [0] * len(values)
            for word in words:
                unsigned = [(u << 64) | _unsigned(v) for u, v in zip(unsigned, group.column(word).to_pylist())]
            if low != high:
                held = [i for i, p in enumerate(piece) if p == low]
                for i in held:
                    tree.add(unsigned[i])
            for i in range(len(values)):
                if low != high and piece[i] == low:
                    continue
                for j in tree.near(unsigned[i], radius):
                    a, b = root(i), root(held[j])
                    if a != b:
                        joined[a] = b
                if low == high:
                    tree.add(unsigned[i])
                    held.append(i)
            # a star around the least value of each group says as much as all pairs, and a group
            # that meets in many shards has the same star in them
            least: dict[int, int] = {}
            for i, value in enumerate(values):
                least[root(i)] = min(value, least.get(root(i), value))
            for i, value in enumerate(values):
                if value != least[root(i)]:
                    left.append(value)
                    right.append(least[root(i)])
            if len(left) >= 10_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})
                left, right = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return link


def _linked_in_trees(keys: DataFrame, words: list[str], radius: int, tree_size: int) -> DataFrame:
    """(a, b): stars that connect what matches in each shard of ``keys`` (part, shard, node, fingerprint words).

    Each shard is a tree of at most about ``tree_size`` values. A shard beyond
    that is dealt over several trees, and its values are sent to each of them.
    """
    large = (
        keys.groupBy("part", "shard").count().filter(F.col("count") > tree_size)
        .select("part", "shard", F.ceil(F.col("count") / tree_size).cast("int").alias("_trees"))
    )
    trees = F.coalesce("_trees", F.lit(1))
    dealt = keys.join(large, ["part", "shard"], "left").withColumn(
        "piece", F.pmod(F.xxhash64("node"), trees).cast("int")
    ).withColumn("_other", F.explode(F.sequence(F.lit(0), trees - 1)))
    cells = dealt.select(
        "part", "shard", F.least("piece", "_other").alias("tree"), F.greatest("piece", "_other").alias("other_tree"),
        "piece", "node", *words,
    )
    order = ["part", "shard", "tree", "other_tree"]
    placed = cells.repartition(*order).sortWithinPartitions(*order, "node")
    return placed.mapInArrow(_tree_links(radius, words), "a long, b long")


def links(distinct: DataFrame, fp: str = "fp", radius: int = RADIUS, tree_size: int = TREE_SIZE,
          fill: int = SHARD_FILL) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect what lies within ``radius`` bits.

    Fingerprints meet in the shards whose bits they share; no pair within the
    radius is lost. Only a star of each group that a tree connects leaves it.
    """
    rows = distinct.count()
    wanted = masks(blocks_for(rows, radius, fill), radius)
    keys = distinct.select(
        F.col(fp).alias("node"), F.col(fp).alias("fp"),
        F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(_signed(m)).cast("long")) for m in wanted]))
        .alias("part", "shard"),
    )
    return _linked_in_trees(keys, ["fp"], radius, tree_size)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE,
                    seed: int = SEED, radius: int = RADIUS, **kw) -> DataFrame:
    """(doc_id, fp, component): one row per row of ``docs``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; the
    component is the smallest doc_id reachable over links. Texts without words
    (null ones too) have fingerprint zero and are linked like others. A null
    doc_id names no component; a group of such rows alone has a null one. Other
    columns of ``docs`` are not used, an empty table gives an empty one.

    Texts are read once; from then on a row is an id and 64 bits. Copies merge
    before they are compared, so a group of any size is one fingerprint.
    """
    marked = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")),
                                 size=size, seed=seed).select("doc_id", "fp"), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = stored(links(distinct, "fp", radius, **kw).distinct(), "links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = components(edges, ends).select(F.col("id").alias("fp"), F.col("component").alias("label"))
    labelled = distinct.join(label, "fp")
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component"))
    grouped = labelled.select("fp", "label").join(least, "label").select("fp", F.col("component").alias("_near"))
    known = stored(distinct.join(grouped, "fp", "left").select(
        "fp", F.coalesce("_near", "first_id").alias("component")), "labels")
    return marked.join(known, "fp").select("doc_id", "fp", "component")


# wide fingerprints: 128 bits for similarities whose narrow fingerprints would lie too far apart -----------------

WIDE = 128
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
# chance that a pair just at the radius meets in no shard; at a bit less it is far smaller
MISSED = 0.1


def wide_fingerprint(text: str | None, size: int = SIMILAR_SHINGLE) -> tuple[int, int]:
    """(high, low) 64 bits over the shingles of plain words; zero for a text without words."""
    words = plain_words(text)
    if not words:
        return 0, 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh3_128_digest
    last = ends[size - 1:].tolist() if len(words) > size else [len(line)]
    ones, count = np.zeros(WIDE, np.int64), len(last)
    for part in range(0, count, 1 << 15):
        some = zip((ends - lengths)[part:part + (1 << 15)].tolist(), last[part:part + (1 << 15)])
        table = np.frombuffer(b"".join([digest(line[a:b]) for a, b in some]), np.uint8).reshape(-1, WIDE // 8)
        ones += np.unpackbits(table, axis=1).sum(0, dtype=np.int64)
    high, low = np.packbits(2 * ones > count).view(">u8").tolist()
    return _signed(high), _signed(low)


def wide_radius(similarity: float = SIMILARITY, bits: int = WIDE) -> int:
    """Bits in which two fingerprints at this Jaccard similarity differ: the mean and one standard deviation.

    Five in six pairs at the similarity lie within it, nearly all at a twentieth more, one in ten at a fifth less.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + math.sqrt(bits * share * (1 - share)))


def wide_shards(rows: int, radius: int, fill: int = 16, missed: float = MISSED, bits: int = WIDE) -> list[list[int]]:
    """Bit places of each shard key: enough places to spread the rows, enough keys for a pair at the radius."""
    width = max(8, math.ceil(math.log2(max(1, rows) / fill)))
    meet = (1 - radius / bits) ** width
    keys = math.ceil(math.log(missed) / math.log(1 - meet))
    dice = np.random.default_rng(128)
    return [sorted(dice.choice(bits, width, replace=False).tolist()) for _ in range(keys)]


def _wide_fingerprints(docs: DataFrame, text: str, size: int, into: str) -> DataFrame:
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = [wide_fingerprint(t, size) for t in texts_of(texts)]
            yield pa.StructArray.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in (0, 1)], names=["high", "low"])

    return docs.withColumn(into, F.arrow_udf(digest, "high long, low long").asNondeterministic()(F.col(text)))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIMILAR_SHINGLE,
                      similarity: float = SIMILARITY, tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, high, low, component): one row per row of ``docs``.

    Texts are linked when their 128-bit fingerprints over shingles of ``size``
    plain words differ in no more bits than texts of this ``similarity`` do
    (``wide_radius``). A narrow fingerprint cannot tell such pairs from chance
    in a large table. Pairs meet in shards
    of shared random bits; a pair just at the radius is missed with chance
    ``MISSED``, closer ones far less often. Ids, nulls, empty texts and tables
    are treated as in ``near_duplicates``, but texts of equal fingerprint with
    null ids only are linked to nothing else.
    """
    marked = stored(_wide_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), text="text",
                                       size=size, into="fp").select("doc_id", "fp.high", "fp.low"), "wide")
    distinct = stored(marked.groupBy("high", "low").agg(F.min("doc_id").alias("node")), "distinct")
    named = distinct.filter("node is not null")
    radius = wide_radius(similarity)
    keys = []
    for places in wide_shards(named.count(), radius):
        bits = sum(1 << p for p in places)
        high, low = (F.lit(_signed(m)).cast("long") for m in (bits >> 64, bits & 0xFFFFFFFFFFFFFFFF))
        keys.append(F.xxhash64(F.col("high").bitwiseAND(high), F.col("low").bitwiseAND(low)))
    sharded = named.select("node", "high", "low", F.posexplode(F.array(*keys)).alias("part", "shard"))
    edges = stored(_linked_in_trees(sharded, ["high", "low"], radius, tree_size).distinct(), "links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    label = components(edges, ends).select(F.col("id").alias("node"), "component")
    known = stored(distinct.join(label, "node", "left").select(
        "high", "low", F.coalesce("component", "node").alias("component")), "labels")
    return marked.join(known, ["high", "low"]).select("doc_id", "high", "low", "component")


def _without(docs: DataFrame, doc_id: str, ids: DataFrame) -> DataFrame:
    """``docs`` without some ids, which are sent to all tasks if their number is checked to be small."""
    name = free_name(docs, "_gone")
    gone = ids.select(F.col("doc_id").alias(name))
    if small_enough(gone, 16):
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(doc_id) == F.col(name), "left_anti")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each group of similar documents: that of the smallest doc_id.

    Rows that repeat a doc_id are reduced to one. Of rows with a null doc_id
    one stays for each fingerprint that no row with an id has. Texts are not
    shuffled unless the rows to drop are too many to be sent to all tasks.
    """
    found = stored(similar_documents(docs, doc_id, text, **kw), "groups")
    twice = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    twice = stored(twice, "repeated")
    gone = found.filter("doc_id <> component").select("doc_id").distinct().unionByName(twice).distinct()
    out = _without(docs.filter(F.col(doc_id).isNotNull()), doc_id, stored(gone, "dropped"))
    if not twice.isEmpty():
        again = twice.join(found.filter("doc_id = component"), "doc_id", "left_semi")
        name = free_name(docs, "_again")
        out = out.unionByName(docs.join(
            again.select(F.col("doc_id").alias(name)), F.col(doc_id) == F.col(name), "left_semi").dropDuplicates([doc_id]))
    alone = found.filter("component is null").select("high", "low").distinct()
    if not alone.isEmpty():
        mark = free_name(docs, "_fp")
        nameless = _wide_fingerprints(docs.filter(F.col(doc_id).isNull()), text, kw.get("size", SIMILAR_SHINGLE), mark)
        fits = (F.col(mark)["high"] == alone["high"]) & (F.col(mark)["low"] == alone["low"])
        out = out.unionByName(nameless.join(alone, fits, "left_semi").dropDuplicates([mark]).drop(mark))
    return out
