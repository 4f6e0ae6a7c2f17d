"""Language model, language identification, chat collapse, packing."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.llm import chat, langid, lm, packing
from residua.llm.texts import id_remainder


def scored(spark, rows, learns=None, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k1 int")
    learns = F.coalesce(id_remainder(F.col("doc_id"), 10), F.lit(0)) != 0 if learns is None else learns
    return lm.score(docs, learns, rounds=1, **kw)


@pytest.mark.parametrize("top", [5, lm.TOP_WORDS])
def test_base_scores_equal_brute_force(spark, small, top):
    rows = [(r.doc_id, r.text, 0) for r in spark.read.parquet(f"{small}/documents.parquet").collect()][:60]
    rows += [(1001, None, 0), (1002, "", 0), (None, "never seen words", 0), rows[3], rows[3], (1003, "İ \u0000 é", 0)]
    counts = Counter()
    for i, t, _ in rows:
        if i is not None and crc32(str(i).encode()) % 10:
            counts.update(lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    found = scored(spark, rows, top=top).collect()
    assert len(found) == len(rows)
    for r in found:
        words = lm.tokens(r.text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert r.lm.n_tokens == len(words) and r.lm.n_known == sum(counts[w] > 0 for w in words) and r.lm.train_tokens == n
        assert math.isclose(r.lm.base_score, base, rel_tol=1e-9) and -1e6 < r.lm.score < 0


def test_probabilities_sum_to_one():
    dice = np.random.default_rng(1)
    model = {k: dice.normal(size=v.shape) for k, v in lm.start_model(np.full(lm.CLASSES, 1 / lm.CLASSES)).items()}
    before = np.tile(dice.integers(0, lm.CLASSES, (1, lm.CONTEXT)), (lm.CLASSES, 1))
    logs = lm.class_log10(model, before, np.arange(lm.CLASSES))
    assert abs((10.0**logs).sum() - 1) < 1e-4


def test_contexts_stay_inside_a_text():
    ids, place = np.array([5, 6, 0, 7, 0]), np.array([0, 1, 2, 0, 1])
    assert lm.contexts(ids, place, 0)[:, :2].tolist() == [[0, 0], [5, 0], [6, 5], [0, 0], [7, 0]]


def test_codes():
    codes = lm.Codes([lm.END, *[b"w%d" % i for i in range(lm.SINGLE + 3)]])
    found = np.array(codes.of([lm.END, b"w5", b"w%d" % (lm.SINGLE + 1), b"new", b"new"]))
    assert found.tolist()[:3] == [0, 6, lm.SINGLE + 2] and found[3] == found[4] < 0
    wanted = [0, 6, lm.shared_class(b"w%d" % (lm.SINGLE + 1)), lm.shared_class(b"new"), lm.shared_class(b"new")]
    assert codes.classes(found).tolist() == wanted


def test_noise_contrast_learns_a_sequence():
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    trainer = lm.Trainer(lm.start_model(noise), noise, 0, rate=0.3)
    ids = np.arange(4000) % 7
    before = lm.contexts(ids, np.arange(4000), 0)
    first = lm.class_log10(trainer.model, before, ids).mean()
    for _ in range(60):
        for i in (0, 2000):
            trainer.step(before[i:i + 2000], ids[i:i + 2000])
    assert lm.class_log10(trainer.model, before, ids).mean() > first + 1


def test_model_beats_base_on_held_out_texts(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    found = lm.score(docs, id_remainder(F.col("doc_id"), 10) != 0).filter(id_remainder(F.col("doc_id"), 10) == 0)
    row = found.agg(F.sum("lm.score").alias("model"), F.sum("lm.base_score").alias("base")).first()
    assert row.model > row.base


def test_scores_without_training_texts(spark, edge_docs):
    found = lm.score(edge_docs, F.lit(False), rounds=1)
    assert found.columns == [*edge_docs.columns, "lm"] and found.count() == edge_docs.count()
    assert found.filter("lm.n_known > 0 or lm.train_tokens > 0 or lm.base_score <> 0").isEmpty()
    assert lm.score(edge_docs.limit(0), F.lit(True), rounds=1).isEmpty()


# language ----------------------------------------------------------------------


def test_held_out_languages(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text", "lang")
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.filter(~held))
    found = docs.filter(held).select("lang", langid.identify(docs, model).alias("found")).collect()
    right = sum(r.lang == r.found.lang for r in found) / len(found)
    assert right > 0.98 and abs(np.mean([r.found.score for r in found]) - right) < 0.03
    assert (langid.Ftrl(2).weights(slice(None)) == 0).all() and 0 < (model["weights"] != 0).mean() < 1


def test_language_edges(spark, edge_docs):
    model = langid.fit(edge_docs.withColumn("lang", F.when(F.col("doc_id") == 8, "xx").otherwise(F.col("lang"))))
    rows = {r.doc_id: r.found for r in edge_docs.select("doc_id", langid.identify(edge_docs, model).alias("found")).collect()}
    assert model["langs"] == ["en", "xx"] and rows[1].lang == "en"
    assert all(rows[i].lang == "und" and rows[i].score == 0 for i in (3, 4, 5)) and all(0 <= r.score <= 1 for r in rows.values())
    nothing = langid.fit(edge_docs.limit(0))
    assert all(r.found.lang == "und" for r in edge_docs.select(langid.identify(edge_docs, nothing).alias("found")).collect())


def test_copies_take_one_place_in_the_sample(spark):
    import xxhash

    # in signed order of Spark's hash: the copied text comes first, the few texts of the second language last
    order = sorted((f"some words {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)),
                   key=lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)))
    rows = [(order[0], "aa")] * 40 + [(t, "aa") for t in order[1:40]] + [(t, "bb") for t in order[-3:]] * 200
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=10)
    assert model["langs"] == ["aa", "bb"]
    assert round(float(np.exp(model["idf"].max() - 1))) - 1 == 13  # ten and three texts


def test_temperature_calibrates():
    dice = np.random.default_rng(2)
    truth = dice.integers(0, 2, 2000)
    sure = np.where(dice.random(2000) < 0.75, truth, 1 - truth)
    logits = [np.array([5.0, 0.0]) if s == 0 else np.array([0.0, 5.0]) for s in sure]
    t = langid.best_temperature(logits, truth.tolist())
    assert abs(langid.softmax(np.array([5.0, 0.0]) / t)[0] - 0.75) < 0.03


# chat --------------------------------------------------------------------------

TALKS = {
    1: [("user", "hi"), ("assistant", "hello")], 2: [("user", "hi"), ("assistant", "hello"), ("user", "bye")],
    3: [("user", "hi"), ("assistant", "hello"), ("user", "bye")], 4: [("user", "hi"), ("assistant", "other")], 5: [("user", "hi")],
    6: [(None, None), ("user", None)], 7: [(None, None)], 8: [("user", "")], 9: [("", "user")],
}


def talk_rows():
    rows = [(c, i, role, text) for c, turns in TALKS.items() for i, (role, text) in enumerate(turns)]
    return [*rows, rows[0], (None, 0, "user", "hi"), (10, None, "user", "first"), (10, 1, "user", "second")]


@pytest.mark.parametrize("part_turns", [1, 2, chat.PART_TURNS])
def test_collapse(spark, part_turns):
    turns = spark.createDataFrame(talk_rows(), "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    kept = {r.conv_id for r in chat.collapse(turns, part_turns=part_turns).filter("kept").collect()}
    talks = TALKS | {10: [("user", "first"), ("user", "second")]}
    slow = {a for a, x in talks.items() if not any(y[:len(x)] == x and (len(y) > len(x) or b < a) for b, y in talks.items() if a != b)}
    assert kept == slow == {2, 4, 6, 8, 9, 10}
    parts = defaultdict(dict)
    for r in chat.render(turns, part_turns=part_turns).collect():
        parts[r.conv_id][r.part] = r.rendered
    texts = {c: "".join(p[k] for k in sorted(p)) for c, p in parts.items()}
    assert texts == {c: "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in talks[c]) for c in slow}
    assert chat.render(turns.limit(0)).isEmpty()


@pytest.mark.parametrize("part_turns", [3, 7, chat.PART_TURNS])
def test_parts_follow_places(spark, part_turns):
    """Large, negative, repeated and null turn numbers make no parts of their own."""
    numbers = [None, None, -5, 0, 49_999, 50_000, 50_000, 1_700_000_000_000]
    rows = [(1, n, "user", f"t{i}") for i, n in enumerate(numbers)]
    rows += [(2, i, "user", f"t{i}") for i in range(5)] + [(3, 10**12 * i, "user", f"t{i}") for i in range(9)]
    turns = spark.createDataFrame(rows + rows, "conv_id long, turn long, role string, text string").repartition(7)
    kept = {r.conv_id: r.kept for r in chat.collapse(turns, part_turns=part_turns).collect()}
    assert kept == {1: False, 2: False, 3: True}
    found = sorted(chat.render(turns, part_turns=part_turns).collect())
    assert [(r.conv_id, r.part) for r in found] == [(3, p) for p in range(-(-9 // part_turns))]
    assert {r.n_turns for r in found} == {9}
    assert "".join(r.rendered for r in found) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(9))


# packing -----------------------------------------------------------------------


def pack_slowly(items, capacity):
    """Best fit by looking at every bin, for (size, source, cluster) in the given order."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [b for b in bins if b["room"] >= size and (source is None or source not in b["sources"]) and (cluster is None or cluster not in b["clusters"])]
        if not fits:
            bins.append({"room": capacity, "sources": set(), "clusters": set(), "n": len(bins)})
            fits = bins[-1:]
        best = min(fits, key=lambda b: (b["room"], b["n"]))
        out.append((best["n"], capacity - best["room"]))
        best["room"] -= size
        best["sources"].add(source)
        best["clusters"].add(cluster)
    return out


def test_bins_equal_slow_search():
    dice = np.random.default_rng(3)
    items = sorted(((int(s), None if a == 0 else int(a), None if c == 0 else int(c)) for s, a, c in zip(
        dice.integers(1, 101, 400), dice.integers(0, 5, 400), dice.integers(0, 30, 400))), key=lambda i: -i[0])
    bins = packing.Bins(100)
    assert [bins.place(s, 1 << a if a else 0, 1 << c if c else 0) for s, a, c in items] == pack_slowly(items, 100)


def check_packing(rows, sizes, capacity):
    covered, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.n_tokens <= capacity and 0 <= r.offset and r.offset + r.n_tokens <= capacity
        covered[r.doc_id].append((r.start_token, r.n_tokens))
        if r.bin is not None:
            bins[r.shard, r.bin].append(r)
        else:
            assert r.n_tokens == capacity and r.offset == 0
    for own in bins.values():
        spans = sorted((r.offset, r.offset + r.n_tokens) for r in own)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
        for field in ("source", "cluster"):
            values = [getattr(r, field) for r in own if getattr(r, field) is not None]
            assert len(values) == len(set(values))
    for doc, copies in sizes.items():
        assert sum(n for _, n in covered[doc]) == sum(copies)
    assert set(covered) == set(sizes)


def test_packing(spark):
    dice = np.random.default_rng(4)
    rows = [(i, int(dice.integers(1, 400)), None if i % 7 == 0 else "hot" if i % 3 == 0 else f"s{i % 9}", int(i % 50) if i % 2 else None) for i in range(500)]
    rows += [(600, 100, "s", 1), (601, 250, "s", 1), (602, 0, "s", 1), (603, None, "s", 1), (604, -4, None, None), (5, 90, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long").withColumn("bin", F.lit(0))
    sizes = defaultdict(list)
    for i, n, *_ in rows:
        if n and n > 0:
            sizes[i].append(n)
    one = packing.pack(docs, capacity=100)
    check_packing(one.collect(), sizes, 100)
    check_packing(packing.pack(docs, capacity=100, shard_rows=40).collect(), sizes, 100)
    assert packing.pack(docs.limit(0)).isEmpty()


def test_token_counts(spark, edge_docs):
    rows = {r.doc_id: r.n for r in edge_docs.select("doc_id", packing.count_tokens("text").alias("n")).collect()}
    assert rows[3] == rows[4] == rows[5] == 1 and rows[6] == 2 and rows[7] == 60_001
