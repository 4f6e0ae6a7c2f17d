"""k-mers of at most twelve residues as numbers: counted in blocks where they are read, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from residua import constants as C

# letters whose windows are looked at together
BLOCK = 1 << 20
# distinct k-mers that meet in one task after the shuffle, on average
TASK_KEYS = 2_000_000
# residues of one 64-bit number
NUMBER = 12
# windows that travel to one task as runs, on average, and how many of them are numbers at once
RUN_WINDOWS = 1 << 23
PASS_WINDOWS = 1 << 21

_LETTERS = np.frombuffer(C.RESIDUES.encode(), np.uint8)
_INDEX = np.full(256, 255, np.uint8)
_INDEX[_LETTERS] = np.arange(20)


def window_blocks(batches: Iterator[pa.RecordBatch], k: int, seq: str = "seq"
                  ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, letters, first, row, pos): all windows of k letters, about ``BLOCK`` at a time.

    ``letters`` holds residue indices; a window begins at its ``first`` there, and
    at ``pos`` of the batch's ``row``. Null and shorter texts have no window.
    """
    for batch in batches:
        held: list[tuple[int, int, str]] = []
        size = 0
        for row, text in enumerate(batch.column(seq)):
            text = text.as_py() or ""
            for at in range(0, len(text) - k + 1, BLOCK):
                held.append((row, at, text[at:at + BLOCK + k - 1]))
                size += len(held[-1][2])
                if size >= BLOCK:
                    yield batch, *_joined(held, k)
                    held, size = [], 0
        if held:
            yield batch, *_joined(held, k)


def _joined(held: list[tuple[int, int, str]], k: int) -> tuple[np.ndarray, ...]:
    letters = residue_indices("".join(text for _, _, text in held))
    lengths = np.array([len(text) for _, _, text in held])
    rows, offsets = np.array([row for row, _, _ in held]), np.array([at for _, at, _ in held])
    n = lengths - k + 1
    which = np.repeat(np.arange(len(held)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return letters, (np.cumsum(lengths) - lengths)[which] + inner, rows[which], offsets[which] + inner


def residue_indices(text: str) -> np.ndarray:
    letters = _INDEX[np.frombuffer(text.encode("utf-8"), np.uint8)]
    if len(letters) and letters.max() > 19:
        raise ValueError("k-mers are numbered over the twenty residues")
    return letters


def window_numbers(letters: np.ndarray, first: np.ndarray, k: int, start: int = 0) -> np.ndarray:
    """The base-20 number of the k letters from ``start`` on in each window."""
    if not 1 <= k <= NUMBER:
        raise ValueError(f"numbers hold 1 to {NUMBER} residues")
    total, width = letters[start:].astype(np.int64), 1
    # as many steps as k has bits: two numbers side by side are one of twice the letters
    for bit in bin(k)[3:]:
        total = total[:-width] * 20 ** width + total[width:]
        width *= 2
        if bit == "1":
            total = total[:-1] * 20 + letters[start + width:]
            width += 1
    return total[first]


def _texts(numbers: pa.Array, lengths: pa.Array) -> pa.Array:
    if not len(numbers):
        return pa.array([], pa.string())
    k = lengths[0].as_py()
    rest = numbers.to_numpy(zero_copy_only=False).copy()
    letters = np.empty((len(rest), k), np.uint8)
    for i in range(k - 1, -1, -1):
        letters[:, i] = _LETTERS[rest % 20]
        rest //= 20
    offsets = pa.py_buffer((np.arange(len(rest) + 1) * k).astype(np.int32).tobytes())
    return pa.StringArray.from_buffers(len(rest), offsets, pa.py_buffer(letters.tobytes()))


def _dealt(rows: DataFrame, seqs: DataFrame, keys: Sequence[str], seq_col: str) -> DataFrame:
    """``rows`` by key, in as many parts as the letters ask for, so that no part outgrows a task's memory."""
    letters = seqs.agg(F.sum(F.length(seq_col))).first()[0] or 0
    parts = max(2 * seqs.sparkSession.sparkContext.defaultParallelism, -(-letters // TASK_KEYS))
    return rows.repartition(parts, *keys)


def distinct_counts(seqs: DataFrame, k: int, seq_col: str = "seq") -> DataFrame:
    """One row: how many different k-mers there are (``n_distinct``) and how many that occur once (``n_unique``).

    A block sends each of its k-mers as one number, with a last digit that says whether it is repeated.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, letters, first, _, _ in window_blocks(batches, k, seq_col):
            found, n = np.unique(window_numbers(letters, first, k), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(2 * found + (n > 1))], names=["key"])

    rows = seqs.select(seq_col).mapInArrow(numbered, "key long")
    rows = rows.select(F.shiftright("key", 1).alias("kmer"), (F.col("key").bitwiseAND(1) + 1).alias("n"))
    counted = _dealt(rows, seqs, ["kmer"], seq_col).groupBy("kmer").agg(F.sum("n").alias("n"))
    return counted.agg(F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("n") == 1).alias("n_unique"))


def _least_words(letters: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The least hash of the shorter words in each window; neighbouring windows share it, and so do equal ones."""
    size = max(1, min(10, (k + 1) * 3 // 5))
    words = window_numbers(letters, np.arange(max(0, len(letters) - size + 1)), size)
    least = (words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)
    width = 1
    while width < k - size + 1:
        step = min(width, k - size + 1 - width)
        least[:-step] = np.minimum(least[:-step], least[step:])
        width += step
    return least[first]


def _mixed(numbers: list[np.ndarray]) -> np.ndarray:
    """One hash of the numbers of each window."""
    total = np.zeros(len(numbers[0]), np.uint64)
    for x in numbers:
        total = (total ^ x.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _packed_runs(letters: np.ndarray, first: np.ndarray, row: np.ndarray, pos: np.ndarray, mark: np.ndarray, k: int, parts: int,
                 ids: pa.Array) -> pa.RecordBatch:
    """(part, n, size, body, ids): windows in order of their place, as compressed runs of letters for each part.

    Windows that follow each other and share their least word and ``mark`` are one
    run, which holds their letters once. Equal windows go to the same part.
    """
    least = _least_words(letters, first, k)
    begin = np.ones(len(first), bool)
    begin[1:] = (first[1:] != first[:-1] + 1) | (least[1:] != least[:-1]) | (mark[1:] != mark[:-1])
    begin = np.flatnonzero(begin)
    n = np.diff(np.append(begin, len(first)))
    part = ((least[begin] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(24)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    borders = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
    made, texts = [], []
    for low, high in zip(borders[:-1], borders[1:]):
        runs = order[low:high]
        own, text = np.unique(row[begin[runs]], return_inverse=True)
        long = n[runs] + k - 1
        places = np.repeat(first[begin[runs]] - np.cumsum(long) + long, long) + np.arange(long.sum())
        numbers = np.stack([n[runs], text, pos[begin[runs]], mark[begin[runs]]]).astype(np.int32)
        # the bytes of one place in a number together
        planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T)
        body = planes.tobytes() + letters[places].tobytes()
        made.append((int(part[runs[0]]), len(runs), len(body), pa.compress(body, codec="zstd", asbytes=True)))
        texts.append(own)
    columns = list(zip(*made)) or [[]] * 4
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, texts)]), pa.int32()),
                                     ids.take(pa.array(np.concatenate(texts) if texts else [], pa.int64())))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([*[pa.array(c, kind) for c, kind in zip(columns, kinds)], lists],
                                      names=["part", "n", "size", "body", "ids"])


_RUNS = "part int, n int, size long, body binary, ids array<long>"


class _Runs:
    """The runs of one part, kept as letters; their windows become numbers some at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch], k: int):
        numbers, letters, ids, texts = [], [], [pa.array([], pa.int64())], 0
        for batch in batches:
            rows = zip(batch.column("n").to_pylist(), batch.column("size").to_pylist(), batch.column("body"), batch.column("ids"))
            for n, size, body, own in rows:
                held = np.frombuffer(pa.decompress(body.as_py(), size, codec="zstd", asbytes=True), np.uint8)
                numbers.append(np.ascontiguousarray(held[:16 * n].reshape(4, -1).T).view(np.int32).reshape(4, n))
                numbers[-1][1] += texts
                letters.append(held[16 * n:])
                ids.append(own.values)
                texts += len(own.values)
        self.k, self.ids = k, pa.chunked_array(ids).combine_chunks()
        self.n, self.text, self.pos, self.mark = np.concatenate(numbers, axis=1) if numbers else np.zeros((4, 0), np.int32)
        self.letters = np.concatenate(letters) if letters else np.zeros(0, np.uint8)
        self.upto = np.cumsum(self.n, dtype=np.int64)

    def passes(self, parts: list[tuple[int, int]]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers, text, pos, mark) of the windows, about PASS_WINDOWS at a time; equal windows come together.

        ``parts`` says where each number begins in a window and how many letters it has.
        """
        total = int(self.upto[-1]) if len(self.upto) else 0
        times = -(-total // PASS_WINDOWS)
        place = np.cumsum(self.n + self.k - 1, dtype=np.int64) - self.n - self.k + 1
        for turn in range(times):
            found = []
            at = 0
            while at < len(self.n):
                end = max(at + 1, int(np.searchsorted(self.upto, self.upto[at] + BLOCK)))
                n = self.n[at:end]
                run = np.repeat(np.arange(at, end), n)
                inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                first = place[run] - place[at] + inner
                some = self.letters[place[at]:place[end - 1] + self.n[end - 1] + self.k - 1]
                numbers = [window_numbers(some, first, size, start) for start, size in parts]
                if times > 1:
                    own = (_mixed(numbers) >> np.uint64(20)) % np.uint64(times) == turn
                    run, inner, numbers = run[own], inner[own], [x[own] for x in numbers]
                found.append((*numbers, self.text[run], self.pos[run] + inner, self.mark[run]))
                at = end
            *numbers, text, pos, mark = (np.concatenate(c) for c in zip(*found))
            yield numbers, text, pos, mark


def _run_parts(seqs: DataFrame, seq_col: str) -> int:
    letters = seqs.agg(F.sum(F.length(seq_col))).first()[0] or 0
    return max(2 * seqs.sparkSession.sparkContext.defaultParallelism, -(-letters // RUN_WINDOWS))


def single_kmers(seqs: DataFrame, k: int, id_col: str = "protein_id", seq_col: str = "seq") -> DataFrame:
    """(id, pos, kmer) of the k-mers that occur once in all sequences; ids are whole numbers.

    A block sends each of its k-mers once, as runs of letters, and marks those that are repeated there.
    """
    parts = _run_parts(seqs, seq_col)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, letters, first, row, pos in window_blocks(batches, k, seq_col):
            _, at, n = np.unique(window_numbers(letters, first, k), return_index=True, return_counts=True)
            mark = np.zeros(len(first), np.int32)
            mark[at] = n > 1
            at.sort()
            yield _packed_runs(letters, first[at], row[at], pos[at], mark[at], k, parts, batch.column("id"))

    def met(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(batches, k)
        for (numbers,), text, pos, mark in runs.passes([(0, k)]):
            found, at, n = np.unique(numbers, return_index=True, return_counts=True)
            single = (n == 1) & (mark[at] == 0)
            at = at[single]
            yield pa.RecordBatch.from_arrays(
                [runs.ids.take(pa.array(text[at])), pa.array(pos[at].astype(np.int64)), _texts(pa.array(found[single]), pa.array([k]))],
                names=["id", "pos", "kmer"])

    rows = seqs.select(F.col(id_col).cast("long").alias("id"), seq_col).mapInArrow(placed, _RUNS)
    single = rows.groupBy("part").applyInArrow(met, "id long, pos long, kmer string")
    return single.select(F.col("id").cast(seqs.schema[id_col].dataType).alias(id_col), "pos", "kmer")


def letter_matrix(seqs: DataFrame, k: int, group: str, seq_col: str = "seq", letters: str = C.MOTIF_LETTERS) -> DataFrame:
    """Letter frequency at each place of all windows of each group, as :func:`groups.weight_matrix` gives it.

    Windows are counted where they are read; a block sends k rows for each of its groups.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, first, row, _ in window_blocks(batches, k, seq_col):
            _, begins = np.unique(row, return_index=True)
            names = batch.column("motif").take(pa.array(row[begins])).dictionary_encode("encode")
            own = np.repeat(names.indices.to_numpy(), np.diff(np.append(begins, len(row))))
            n = len(names.dictionary)
            cells = np.concatenate([np.bincount(own * 20 + found[first + j], minlength=20 * n) for j in range(k)])
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(np.tile(np.arange(n), k))), pa.array(np.repeat(np.arange(k, dtype=np.int32), n)),
                 pa.array(list(cells.reshape(-1, 20)), pa.list_(pa.int64()))], names=["motif", "pos", "n"])

    kind = seqs.schema[group].dataType.simpleString()
    cells = seqs.select(F.col(group).alias("motif"), seq_col).mapInArrow(counted, f"motif {kind}, pos int, n array<long>")
    sums = cells.groupBy("motif", "pos").agg(*[F.sum(F.col("n")[i]).alias(r) for i, r in enumerate(C.RESIDUES)])
    total = sum(F.col(r) for r in C.RESIDUES)
    return sums.select(F.col("motif").alias(group), "pos", *[
        ((F.col(a) if a in C.RESIDUES else F.lit(0).cast("long")) / total).alias(a) for a in letters])


def _place_sums(letters: np.ndarray, apart: int, table: np.ndarray) -> np.ndarray:
    """Running sums of the table's values for the letters at each place and ``apart`` further on."""
    return np.concatenate([[0], np.cumsum(table[letters[:-apart], letters[apart:]])])


def half_scores(seqs: DataFrame, half: int, similarity: Sequence[Sequence[float]], distance: Sequence[Sequence[float]],
                id_col: str = "protein_id", seq_col: str = "seq") -> DataFrame:
    """(id, n, similarity, distance, most_similar, nearest): the halves of each window of ``2 * half`` letters compared."""
    tables = [np.array(t).astype(np.int64) for t in (similarity, distance)]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, letters, first, row, _ in window_blocks(batches, 2 * half, seq_col):
            s, d = (sums[first + half] - sums[first] for sums in (_place_sums(letters, half, t) for t in tables))
            rows, begins = np.unique(row, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(np.diff(np.append(begins, len(row)))),
                 pa.array(np.add.reduceat(s, begins)), pa.array(np.add.reduceat(d, begins)),
                 pa.array(np.maximum.reduceat(s, begins)), pa.array(np.minimum.reduceat(d, begins))],
                names=["id", "n", "s", "d", "most", "least"])

    kind = seqs.schema[id_col].dataType.simpleString()
    found = seqs.select(F.col(id_col).alias("id"), seq_col).mapInArrow(
        compared, f"id {kind}, n long, s long, d long, most long, least long")
    return found.groupBy(F.col("id").alias(id_col)).agg(
        F.sum("n").alias("n"), F.sum("s").alias("similarity"), F.sum("d").alias("distance"),
        F.max("most").alias("most_similar"), F.min("least").alias("nearest"))


def prefix_correlation(seqs: DataFrame, half: int, prefixes: Sequence[int], similarity: Sequence[Sequence[float]],
                       distance: Sequence[Sequence[float]], seq_col: str = "seq") -> DataFrame:
    """(k, n, correlation) of the two scores over the first k letters of each window's halves.

    Scores are whole numbers, so a block sends exact sums of them, their squares and products.
    """
    tables = [np.array(t).astype(np.int64) for t in (similarity, distance)]
    sums = ["n", "s", "d", "ss", "dd", "sd"]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, letters, first, _, _ in window_blocks(batches, 2 * half, seq_col):
            both = [_place_sums(letters, half, t) for t in tables]
            rows = []
            for k in prefixes:
                s, d = (x[first + k] - x[first] for x in both)
                rows.append((k, len(s), s.sum(), d.sum(), (s * s).sum(), (d * d).sum(), (s * d).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows)], names=["k", *sums])

    found = seqs.select(seq_col).mapInArrow(added, "k long, " + ", ".join(f"{c} long" for c in sums))
    total = found.groupBy("k").agg(*[F.sum(c).alias(c) for c in sums])
    n, s, d = F.col("n").cast("double"), F.col("s").cast("double"), F.col("d").cast("double")
    spread = F.sqrt((F.col("ss") - s * s / n) * (F.col("dd") - d * d / n))
    return total.select("k", "n", ((F.col("sd") - s * d / n) / F.nullif(spread, F.lit(0.0))).alias("correlation"))


def shared_links(seqs: DataFrame, k: int, id_col: str = "protein_id", seq_col: str = "seq") -> DataFrame:
    """(a, b): pairs of ids whose links join all sequences that share a k-mer of any length.

    A block links the holders of a k-mer in it and sends the lowest of them, with
    its k-mers as runs of letters; where a k-mer's holders meet, they are linked.
    Of a block's or task's links only as many are kept as join the same ids. The blocks' links
    travel as ids without letters.
    """
    borders = np.linspace(0, k, -(-k // NUMBER) + 1).astype(int).tolist()
    numbered = [(at, upto - at) for at, upto in zip(borders, borders[1:])]
    parts = _run_parts(seqs, seq_col)

    def neighbours(numbers: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A place of each k-mer, and links between the holders of equal ones."""
        mixed = _mixed(numbers)
        order = np.argsort(mixed)
        new = np.ones(len(ids), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in numbers], axis=0)
        if (new[1:] & (mixed[order][1:] == mixed[order][:-1])).any():
            # different k-mers of one hash may lie between each other
            order = np.lexsort(numbers)
            new[1:] = np.any([x[order][1:] != x[order][:-1] for x in numbers], axis=0)
        return order[new], *_forest(*_differing(ids[order], ~new[1:]))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, letters, first, row, pos in window_blocks(batches, k, seq_col):
            ids = batch.column("id").to_numpy()[row]
            at, a, b = neighbours([window_numbers(letters, first, n, at) for at, n in numbered], ids)
            at.sort()
            yield _packed_runs(letters, first[at], row[at], pos[at], np.zeros(len(at), np.int32), k, parts, batch.column("id"))
            if len(a):
                both = pa.ListArray.from_arrays(pa.array([0, 2 * len(a)], pa.int32()), pa.array(np.stack([a, b], 1).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(a[0] % parts)], pa.int32()), pa.array([0], pa.int32()), pa.array([0], pa.int64()),
                     pa.array([None], pa.binary()), both], names=["part", "n", "size", "body", "ids"])

    def linked(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, runs = [(np.zeros(0, np.int64),) * 2], []
        for batch in batches:
            own = pc.is_null(batch.column("body"))
            pairs = batch.column("ids").filter(own).flatten().to_numpy().reshape(-1, 2)
            links.append((pairs[:, 0], pairs[:, 1]))
            runs.append(batch.filter(pc.invert(own)))
        runs = _Runs(iter(runs), k)
        ids = runs.ids.to_numpy()
        for numbers, text, _, _ in runs.passes(numbered):
            links.append(neighbours(numbers, ids[text])[1:])
        a, b = _forest(*(np.concatenate(x) for x in zip(*links)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = seqs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), seq_col).mapInArrow(held, _RUNS)
    return rows.groupBy("part").applyInArrow(linked, "a long, b long").distinct()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same ids as the links (a, b): the lowest of those joined to each of the others."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[:len(a)], at[len(a):]
    lowest = np.arange(len(ids))
    while len(one):
        x, y = lowest[one], lowest[two]
        apart = x != y
        one, two, x, y = one[apart], two[apart], x[apart], y[apart]
        np.minimum.at(lowest, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = lowest[lowest]
            if np.array_equal(jumped, lowest):
                break
            lowest = jumped
    other = np.flatnonzero(lowest != np.arange(len(ids)))
    return ids[lowest[other]], ids[other]


def _differing(ids: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unequal neighbours in ``ids`` where ``joined`` says that they belong together."""
    at = np.flatnonzero(joined & (ids[1:] != ids[:-1]))
    return ids[at], ids[at + 1]
