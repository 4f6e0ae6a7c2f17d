"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from residua.llm.texts import hash_bound, texts_of

UNKNOWN = "und"
ORDERS = 3
BUCKETS = 1 << 15
# labelled texts of each language that the model is fitted on: the bound of the training sample
SAMPLE_PER_LANGUAGE = 400
# more labels than this are a wrong column, and an error
MOST_LANGUAGES = 1_000
# one in so many sampled texts sets the temperature instead of the weights
CALIBRATE_ONE_IN = 5
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_counts(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the 1- to 3-grams of the lower-cased text; None if it has no letter.

    What is not a letter counts as a blank, and runs of blanks as one.
    """
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    known = letters[codes]
    if not known.any():
        return None
    codes = np.where(known, codes, np.uint32(32))
    keep = known.copy()
    keep[1:] |= known[:-1]
    codes = np.concatenate([np.array([32], np.uint32), codes[keep], np.array([32], np.uint32)])
    total = np.zeros(BUCKETS, np.int64)
    rolling = np.zeros(len(codes), np.uint32)
    for order in range(ORDERS):
        rolling = (rolling[:len(codes) - order] ^ codes[order:]) * _FACTORS[order] + np.uint32(order)
        total += np.bincount((rolling ^ (rolling >> np.uint32(15))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        rolling = rolling[:-1]
    at = np.flatnonzero(total)
    return at, total[at]


def weighed(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic term frequency by inverse document frequency, of length one."""
    values = (1 + np.log(counts)) * idf[at]
    return values / max(1e-12, float(np.sqrt((values * values).sum())))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


class Ftrl:
    """Follow the regularised leader, with both penalties, per class and coordinate."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.z = np.zeros((BUCKETS + 1, classes))
        self.n = np.zeros((BUCKETS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, BUCKETS), np.append(values, 1.0)  # the last row is the intercept
        w = self.weights(at)
        error = softmax(values @ w)
        error[label] -= 1
        g = values[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def best_temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The divisor of the logits under which held-back labels are likeliest."""
    if not logits:
        return 1.0
    table, truth = np.array(logits), np.array(labels)

    def loss(t: float) -> float:
        x = table / t
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(truth)), truth]).mean())

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 60))
    return float(grid[np.argmin([loss(t) for t in grid])])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = letter_table()
    for batch in batches:
        out: dict[str, list] = {"h": [], "lang": [], "at": [], "counts": []}
        for i, text in enumerate(texts_of(batch.column("text"))):
            made = ngram_counts(text, letters)
            if made is not None:
                for name, value in zip(out, (batch.column("h")[i].as_py(), batch.column("lang")[i].as_py(), *made)):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["h"], pa.int64()), pa.array(out["lang"], pa.string()),
             pa.array(out["at"], pa.list_(pa.int32())), pa.array(out["counts"], pa.list_(pa.int64()))],
            names=list(out))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE,
        epochs: int = 4) -> dict:
    """Model from labelled texts: {langs, idf, weights, temperature}.

    Fitted on at most ``per_language`` different texts of each language, whole
    texts chosen by hash of their content, copies once; null labels, null texts and texts without
    letters teach nothing. The number of labels is counted over all rows.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null").withColumn(
        "h", F.xxhash64("text"))
    different = rows.groupBy("lang", "h").agg(F.max(F.col("text").isNotNull()).alias("known"))
    counted = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(
        F.count_if("known").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different labels")
    if not counted:
        return {"langs": [], "idf": np.zeros(BUCKETS), "weights": np.zeros((BUCKETS + 1, 0)), "temperature": 1.0}
    # copies count once in the bound and take one place, so that a language of few texts has all of them
    bounds = F.create_map(*[x for k, n in counted.items() for x in (
        F.lit(k), F.lit(hash_bound(4 * per_language, n)).cast("long"))])
    some = rows.filter(F.col("text").isNotNull() & (F.col("h") <= bounds[F.col("lang")])).dropDuplicates(["lang", "h"])
    first = some.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("_n") <= per_language)
    table = first.select("h", "lang", "text").mapInArrow(_vectors, "h long, lang string, at array<int>, counts array<long>")
    sample = sorted(table.toArrow().to_pylist(), key=lambda r: (r["h"], r["lang"]))
    langs = sorted({r["lang"] for r in sample})
    present = np.zeros(BUCKETS)
    for r in sample:
        present[r["at"]] += 1
    idf = np.log((1 + len(sample)) / (1 + present)) + 1
    data = [(np.array(r["at"]), weighed(np.array(r["at"]), np.array(r["counts"], float), idf), langs.index(r["lang"])) for r in sample]
    held = [d for i, d in enumerate(data) if i % CALIBRATE_ONE_IN == 0 and len(data) > 4 * CALIBRATE_ONE_IN]
    used = [d for i, d in enumerate(data) if i % CALIBRATE_ONE_IN or len(data) <= 4 * CALIBRATE_ONE_IN]
    model = Ftrl(len(langs))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(used)).tolist():
            model.learn(*used[i])
    weights = model.weights(slice(None))
    logits = [x @ weights[at] + weights[BUCKETS] for at, x, _ in held]
    return {"langs": langs, "idf": idf, "weights": weights.astype(np.float32),
            "temperature": best_temperature(logits, [y for _, _, y in held])}


def predict(model: dict, text: str | None, letters: np.ndarray) -> tuple[str, float]:
    made = ngram_counts(text, letters)
    if made is None or not model["langs"]:
        return UNKNOWN, 0.0
    at, counts = made
    weights = model["weights"]
    chances = softmax((weighed(at, counts, model["idf"]) @ weights[at] + weights[BUCKETS]) / model["temperature"])
    best = int(chances.argmax())
    return model["langs"][best], float(min(1.0, chances[best]))


def identify(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """A struct (lang, score) of the text: the likeliest language and its calibrated probability.

    A null text, one without letters, and any text under a model that has
    learned nothing is ``und`` with score 0. Whole texts are read in place.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size for each language

    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, known = letter_table(), sent.value
        for texts in batches:
            found = [predict(known, t, letters) for t in texts_of(texts)]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["lang", "score"])

    return F.arrow_udf(look, "lang string, score double").asNondeterministic()(F.col(text))
