"""Log-bilinear language model, trained with noise-contrastive estimation over all training tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residua.llm.texts import space_words, stored, texts_of

END = b""
ADD = 0.1
# words whose counts are sent to every task; rarer ones are joined
TOP_WORDS = 200_000
# output classes: the most frequent words have one each, all other words share the rest by their last letters
SINGLE = 192
SHARED = 64
CLASSES = SINGLE + SHARED
CONTEXT = 4
WIDTH = 16
NOISE = 64
ROUNDS = 2
BATCH = 2048
# distinct words that a task counts or remembers before it passes them on or forgets them
HELD_WORDS = 200_000


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII blanks, then the end mark."""
    return [*space_words(text), END]


def shared_class(word: bytes) -> int:
    return SINGLE + crc32(word[-2:]) % SHARED


def shared_class_of(token: Column) -> Column:
    """The same over a binary column."""
    return (F.lit(SINGLE) + F.crc32(F.expr("substring(token, -2, 2)")) % SHARED).cast("int")


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = -1 - shared_class(word)
        return code


class Codes:
    """Numbers of words: the place of a known word, and -1 less the class of any other one.

    Known words come first by class number; of others a bounded number is remembered.
    """

    def __init__(self, known: list[bytes]):
        self.known = {w: i for i, w in enumerate(known)}
        self.memo = _Memo(self.known)
        self.class_of = np.array([i if i < SINGLE else shared_class(w) for i, w in enumerate(known)])

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > len(self.known) + HELD_WORDS:
            self.memo = _Memo(self.known)
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def classes(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.class_of[np.maximum(codes, 0)], -1 - codes)


def contexts(ids: np.ndarray, place: np.ndarray, end: int) -> np.ndarray:
    """The classes before each token, nearest first; the end mark stands before the start of a text."""
    out = np.full((len(ids), CONTEXT), end, np.int64, order="F")
    for k in range(1, CONTEXT + 1):
        column = out[:, k - 1]
        column[k:] = ids[:-k]
        column[place < k] = end
    return out


def start_model(noise: np.ndarray) -> dict[str, np.ndarray]:
    dice = np.random.default_rng(4)
    return {
        "r": dice.normal(0, 0.1, (CLASSES, WIDTH)), "q": dice.normal(0, 0.1, (CLASSES, WIDTH)),
        "c": np.full((CONTEXT, WIDTH), 1.0), "b": np.log(noise),
    }


def _summed(at: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sum of the rows (given as columns) of each class."""
    return np.stack([np.bincount(at, c, CLASSES) for c in columns], axis=1)


class _Work:
    """Arrays that batch after batch is written into, so that no memory is asked for in between."""

    def __init__(self, width: int):
        self.h, self.part = np.empty((BATCH, WIDTH), np.float32), np.empty((BATCH, WIDTH), np.float32)
        self.wide = np.empty((BATCH, width), np.float32)
        self.columns = np.empty((WIDTH, BATCH))

    def hidden(self, tables: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The predicted vectors: context vectors, weighed by place in ``tables``, added up."""
        h, part = self.h[:len(before)], self.part[:len(before)]
        for k in range(CONTEXT):
            np.take(tables[k], before[:, k], axis=0, out=part if k else h, mode="clip")
            if k:
                h += part
        return h

    def product(self, h: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.matmul(h, q, out=self.wide[:len(h)])

    def turned(self, rows: np.ndarray) -> np.ndarray:
        """The columns of some rows, each in one piece."""
        out = self.columns[:, :len(rows)]
        out[...] = rows.T
        return out


def _tables(model: dict[str, np.ndarray]) -> np.ndarray:
    return (model["r"] * model["c"][:, None, :]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in place; below -60 it is 0 to single precision."""
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Adaptive gradient steps on batches; all targets of a batch share its noise words."""

    def __init__(self, model: dict[str, np.ndarray], noise: np.ndarray, seed: int, rate: float = 0.1):
        self.model = {k: v.astype(float).copy() for k, v in model.items()}
        self.squares = {k: np.full(v.shape, 1e-2) for k, v in model.items()}
        self.noise, self.rate, self.seen = noise, rate, 0
        self.work = _Work(NOISE)
        self.log_noise = np.log(NOISE * noise)
        self.steps, self.dice = np.cumsum(noise), np.random.default_rng(seed)

    def step(self, before: np.ndarray, target: np.ndarray) -> None:
        """A step on at most ``BATCH`` targets."""
        m = self.model
        noise = np.minimum(np.searchsorted(self.steps, self.dice.random(NOISE)), CLASSES - 1)
        h, q = self.work.hidden(_tables(m), before), m["q"].astype(np.float32)
        offset = (m["b"] - self.log_noise).astype(np.float32)
        q_own, q_other = q[target], q[noise]
        own = _sigmoid(np.einsum("ij,ij->i", h, q_own) + offset[target]) - np.float32(1)
        other = self.work.product(h, q_other.T)
        other += offset[noise]
        _sigmoid(other)
        q_own *= own[:, None]
        q_own += other @ q_other
        # what each class receives at each place; the other gradients follow from it
        dh = self.work.turned(q_own)
        sums = [_summed(before[:, k], dh) for k in range(CONTEXT)]
        from_noise = (other.T @ h).T
        h *= own[:, None]
        grads = {
            "q": _summed(target, self.work.turned(h)) + _summed(noise, from_noise),
            "b": np.bincount(target, own, CLASSES) + np.bincount(noise, np.ones(len(h), np.float32) @ other, CLASSES),
            "c": np.stack([(m["r"] * s).sum(0) for s in sums]),
            "r": sum(m["c"][k] * s for k, s in enumerate(sums)),
        }
        for name, g in grads.items():
            g /= len(target)
            self.squares[name] += g * g
            m[name] -= self.rate * g / np.sqrt(self.squares[name])
        self.seen += len(target)


def class_log10(model: dict[str, np.ndarray], before: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each target class, by matrix products over batches."""
    q, b = np.ascontiguousarray(model["q"].T, np.float32), model["b"].astype(np.float32)
    # an upper bound of all scores: below it the exponential function cannot overflow
    longest = lambda x: float(np.sqrt((x * x).sum(1)).max())
    bound = float(b.max()) + longest(model["q"]) * sum(longest(model["r"] * c) for c in model["c"])
    ones, out = np.ones(CLASSES, np.float32), np.empty(len(target))
    tables, work = _tables(model), _Work(CLASSES)
    for i in range(0, len(target), BATCH):
        logits = work.product(work.hidden(tables, before[i:i + BATCH]), q)
        logits += b
        if bound > 60:
            logits -= logits.max(1, keepdims=True)
        out[i:i + BATCH] = logits[np.arange(len(logits)), target[i:i + BATCH]]
        out[i:i + BATCH] -= np.log(np.exp(logits, out=logits) @ ones)
    return out / np.log(10)


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) over all rows: every word and the end mark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
            held.clear()
            return made

        for batch in batches:
            for value in texts_of(batch.column(0)):
                held.update(tokens(value))
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    return texts.select(F.col(text).alias("text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(
        F.sum("n").alias("n"))


def top_words(counts: DataFrame, most: int = TOP_WORDS) -> dict[bytes, int]:
    """All words from a certain count on, the lowest for which there are at most ``most``."""
    sizes = counts.groupBy(F.floor(F.log2(F.col("n")) * 8).alias("size")).count().orderBy(F.desc("size")).collect()
    held, least = 0, None
    for row in sizes:
        held += row["count"]
        if held > most:
            break
        least = row["size"]
    if least is None:
        return {}
    table = counts.filter(F.floor(F.log2(F.col("n")) * 8) >= least).select("token", "n").toArrow()
    return dict(zip(table.column("token").to_pylist(), table.column("n").to_pylist()))


def _stream(codes: Codes, texts: Iterator[str | None], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(codes, places in the text, sizes) of some whole texts at a time."""
    held: list[np.ndarray] = []
    sizes: list[int] = []
    count = 0
    for value in texts:
        held.append(codes.of(tokens(value)))
        sizes.append(len(held[-1]))
        count += sizes[-1]
        if count >= most:
            yield np.concatenate(held), np.concatenate([np.arange(n) for n in sizes]), sizes
            held, sizes, count = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate([np.arange(n) for n in sizes]), sizes


def _flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in sorted(model)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train(texts: DataFrame, singles: list[bytes], noise: np.ndarray, text: str = "text",
          rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of local training over all tokens; after each the tasks' models are averaged by tokens seen."""
    model = start_model(noise)
    for number in range(rounds):
        sent = texts.sparkSession.sparkContext.broadcast((model, singles, noise))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            start, known, share = sent.value
            trainer, codes = Trainer(start, share, number), Codes(known)
            values = (t for batch in batches for t in texts_of(batch.column(0)))
            for found, place, _ in _stream(codes, values, 50 * BATCH):
                ids = codes.classes(found)
                before = contexts(ids, place, 0)
                for at in np.array_split(trainer.dice.permutation(len(ids)), -(-len(ids) // BATCH)):
                    trainer.step(before[at], ids[at])
            flat = _flat(trainer.model)
            if trainer.seen:
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array(np.arange(len(flat)), pa.int32()), "value": pa.array(flat * trainer.seen),
                    "seen": pa.array(np.full(len(flat), trainer.seen), pa.int64())})

        parts = texts.select(F.col(text).alias("text")).mapInArrow(learn, "at int, value double, seen long")
        mean = parts.groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value")).toArrow()
        if mean.num_rows:
            flat = np.empty(mean.num_rows)
            flat[mean.column("at").to_numpy()] = mean.column("value").to_numpy()
            model = _shaped(flat, model)
        sent.unpersist()
    return model


_SCORED = ("n_tokens long, n_top long, top_base double, top_shared double, class_score double")


def _score_in_place(sent):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known, logs, class_logs = sent.value
        codes = Codes(known)
        for texts in batches:
            parts: list[list[np.ndarray]] = []
            for found, place, sizes in _stream(codes, texts_of(texts), 20 * BATCH):
                ids, top = codes.classes(found), found >= 0
                log = np.where(top, logs[np.maximum(found, 0)] if len(logs) else 0.0, 0.0)
                each = class_log10(model, contexts(ids, place, 0), ids) - class_logs[ids]
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                # a word with a class of its own has no share to pay for; the end mark may be one without a count
                parts.append([np.array(sizes), *[np.add.reduceat(x, starts) for x in (
                    (top & (log > -9)).astype(np.int64), np.where(log > -9, log, np.log10(ADD)), np.where(ids >= SINGLE, log, 0.0), each)]])
            columns = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0)] * 5
            kinds = [pa.int64()] * 2 + [pa.float64()] * 3
            yield pa.StructArray.from_arrays(
                [pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)],
                names=["n_tokens", "n_top", "top_base", "top_shared", "class_score"])

    return F.arrow_udf(score, _SCORED).asNondeterministic()


def _rare_words(sent, keys: list[str]):
    """Rows (keys, token, n) of the words without a sent count, and one row without a token for each text."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(sent.value[1])
        for batch in batches:
            at, words, counts = [], [], []
            for i, value in enumerate(texts_of(batch.column("text"))):
                own = Counter(filterfalse(known.__contains__, tokens(value)))
                at += [i] * (len(own) + 1)
                words += [None, *own]
                counts += [1, *own.values()]
                if len(at) > HELD_WORDS:
                    yield _rows(batch, keys, at, words, counts)
                    at, words, counts = [], [], []
            yield _rows(batch, keys, at, words, counts)

    return rare


def _rows(batch: pa.RecordBatch, keys: list[str], at: list, words: list, counts: list) -> pa.RecordBatch:
    where = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays(
        [*[batch.column(k).take(where) for k in keys], pa.array(words, pa.binary()), pa.array(counts, pa.int64())],
        names=[*keys, "token", "n"])


def score(docs: DataFrame, learns: Column, text: str = "text", top: int = TOP_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with a struct ``lm``: n_tokens, n_known, train_tokens, base_score, score (both log10).

    Words and end marks of the rows for which ``learns`` is true are counted
    and train the model; all rows are scored, each whole. The probability of a
    word is that of its class after the classes before it, normalised over all
    classes, times its share of the class with ``ADD`` added to each count. A
    null or empty text is one end mark. Without training tokens each word has
    the share of an unseen one and the classes are as likely as at the start.

    Counts are combined before they are shuffled. The most frequent words, at
    most ``top``, are sent to all tasks; other words meet their counts in a
    join on the word, which stands for a text by a 128-bit hash, so that copies
    are one key.
    """
    own = docs.filter(learns).select(F.col(text).alias("text"))
    counts = stored(word_counts(own), "word-counts")
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = whole["n"] or 0, whole["v"]
    known = top_words(counts, top)
    if END not in known and (ends := counts.filter(F.octet_length("token") == 0).first()):
        known[END] = ends["n"]
    # the end mark is class 0, then come the most frequent words
    order = [END, *sorted(set(known) - {END}, key=lambda w: (-known[w], w))]
    sizes, members = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(shared_class_of(F.col("token")).alias("c")).agg(
            F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        sizes[r["c"]], members[r["c"]] = r["n"], r["v"]
    for i, w in enumerate(order[:SINGLE]):
        sizes[i] = known.get(w, 0)
        if w in known:
            sizes[shared_class(w)] -= known[w]
            members[shared_class(w)] -= 1
    noise = (sizes + 1) / (sizes + 1).sum()
    model = train(own, order[:SINGLE], noise, rounds=rounds)
    class_logs = np.where(np.arange(CLASSES) < SINGLE, 0.0, np.log10(sizes + ADD * (members + 1)))
    # -10 marks an end mark that no training text has
    logs = np.array([np.log10(known[w] + ADD) if w in known else -10.0 for w in order])
    sent = docs.sparkSession.sparkContext.broadcast((model, order, logs, class_logs))

    keyed = docs.withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit("second"), F.col(text))})
    rare = keyed.select("_k1", "_k2", F.col(text).alias("text")).mapInArrow(
        _rare_words(sent, ["_k1", "_k2"]), "_k1 long, _k2 long, token binary, n long")
    count = F.coalesce(F.col("c"), F.lit(0))
    met = rare.join(counts.select("token", F.col("n").alias("c")), "token", "left").groupBy("_k1", "_k2").agg(
        F.sum(F.when(F.col("token").isNull(), F.col("n"))).alias("_copies"),
        F.sum(F.when(F.col("token").isNotNull(), F.col("n") * F.log10(count + ADD))).alias("_rare"),
        F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("_rare_known"),
    ).select("_k1", "_k2", (F.coalesce("_rare", F.lit(0.0)) / F.col("_copies")).alias("_rare"),
             (F.col("_rare_known") / F.col("_copies")).cast("long").alias("_rare_known"))
    placed = keyed.withColumn("_s", _score_in_place(sent)(F.col(text))).join(met, ["_k1", "_k2"], "left")
    s = F.col("_s")
    base = s["top_base"] + F.col("_rare") - s["n_tokens"] * F.log10(F.lit(total + ADD * (kinds + 1)))
    return placed.withColumn("lm", F.struct(
        s["n_tokens"].alias("n_tokens"), (s["n_top"] + F.col("_rare_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (s["class_score"] + s["top_shared"] + F.col("_rare")).alias("score"),
    )).select(*[F.col(f"`{c}`") for c in docs.columns], "lm")
