"""SimHash near-duplicates and shared passages against brute force."""

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from residua.llm import passages, simhash
from residua.llm.texts import plain_words


def fingerprint_slowly(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_slowly(values, ids, near):
    """The smallest id that each place reaches over near values."""
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            label[root(i)] = root(j)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[root(i)] = min(least.get(root(i), own), own)
    return [least.get(root(i)) for i in range(len(values))]


def test_fingerprints():
    for text in (None, "", " \n", "a", "A b C", "a b c d", "a b c d e", "É ü x y z w", "x " * 300, "the of and to in " * 40):
        assert simhash.fingerprint(text) == fingerprint_slowly(text)


def test_tree_finds_all_within_radius():
    dice = np.random.default_rng(2)
    base = [int(x) for x in dice.integers(0, 2**63, 6)]
    values = [b ^ sum(1 << int(p) for p in dice.choice(64, dice.integers(0, 9), replace=False)) for b in base for _ in range(40)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.near(v, 4)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 4]


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_masks_miss_no_pair(blocks):
    dice = np.random.default_rng(blocks)
    wanted = simhash.masks(blocks, 4)
    for _ in range(300):
        difference = sum(1 << int(p) for p in dice.choice(64, 4, replace=False))
        assert any(difference & m == 0 for m in wanted)


def test_more_rows_make_more_blocks():
    assert simhash.blocks_for(1000, 4) == 5 and simhash.blocks_for(10**8, 4) > 5
    assert all(n / 2 ** (64 * (b - 4) / b) <= simhash.SHARD_FILL for n in (10**6, 10**9, 10**11) for b in [simhash.blocks_for(n, 4)])


def near_texts(seed=0, n=12):
    dice = np.random.default_rng(seed)
    word = lambda: "".join(dice.choice(list("abcdefghij"), 5))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(250)]
        for edits in (0, 0, 1, 2, 5, 20):
            own = list(base)
            for at in dice.choice(250, edits, replace=False):
                own[at] = word()
            rows.append(" ".join(own))
    return rows


@pytest.mark.parametrize("tree_size", [2, simhash.TREE_SIZE])
def test_components_equal_brute_force(spark, tree_size):
    texts = [*near_texts(), None, "", "  ", "a b", "A  b"]
    ids = [3 * i + 7 for i in range(len(texts))]
    dice = np.random.default_rng(9)
    order = dice.permutation(len(texts)).tolist()
    rows = [(ids[i], texts[j]) for i, j in enumerate(order)] + [(ids[0], texts[order[0]]), (None, texts[order[1]]), (None, "alone and nameless")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    values = [fingerprint_slowly(t) for _, t in rows]
    expected = groups_slowly(values, [i for i, _ in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    found = simhash.near_duplicates(docs, tree_size=tree_size).collect()
    as_rows = lambda x: sorted(x, key=repr)
    assert as_rows((r.doc_id, r.fp & (2**64 - 1), r.component) for r in found) == as_rows(
        (i, v, c) for (i, _), v, c in zip(rows, values, expected))


def test_components_over_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    values = [fingerprint_slowly(t) for _, t in rows]
    expected = groups_slowly(values, [i for i, _ in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    found = {r.doc_id: r.component for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: c for (i, _), c in zip(rows, expected)}


def test_similar_documents_keep_one(spark, edge_docs):
    texts = near_texts(4, 8)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    for start in range(0, len(texts), 6):  # up to two of 250 words changed: a similarity of 0.92 or more
        assert start in kept and not kept & set(range(start + 1, start + 4))
        assert start + 5 in kept  # twenty changed: below 0.5
    assert len(kept & set(range(4, len(texts), 6))) <= 2  # five changed: 0.815, just above the limit
    out = simhash.keep_one(edge_docs)
    assert out.columns == edge_docs.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    ids = [i for i, _ in rows]
    # 1 and 2 are equal, 3, 4 and 5 have no words
    assert sorted(i for i in ids if i is not None) == [-9, 1, 3, 6, 7, 8]
    assert simhash.keep_one(edge_docs.limit(0)).isEmpty()


def test_repeated_ids_and_nameless_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l m"), (None, "n o p q r s"), (None, "n o p q r s"), (None, "a b c d e f")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([rows[0], rows[2], rows[3]], key=repr)


def test_wide_groups_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    full = lambda p: ((p[0] & (2**64 - 1)) << 64) | (p[1] & (2**64 - 1))
    values = [full(simhash.wide_fingerprint(t)) for _, t in rows]
    radius = simhash.wide_radius()
    expected = groups_slowly(values, [i for i, _ in rows], lambda a, b: (a ^ b).bit_count() <= radius)
    found = {r.doc_id: r.component for r in simhash.similar_documents(docs).collect()}
    assert sum(found[i] == c for (i, _), c in zip(rows, expected)) >= 0.99 * len(rows)


# passages --------------------------------------------------------------------


def test_long_equal_runs_share_a_seed():
    dice = np.random.default_rng(6)
    for _ in range(200):
        shared = dice.integers(0, 2**62, passages.SEED_WORDS + passages.WINNOW - 1).astype(np.uint64)
        texts = [np.concatenate([dice.integers(0, 2**62, int(dice.integers(0, 60))).astype(np.uint64), shared,
                                 dice.integers(0, 2**62, int(dice.integers(0, 60))).astype(np.uint64)]) for _ in range(2)]
        a, b = (set(passages.seeds_of(t)[0].tolist()) for t in texts)
        assert a & b


def test_chain_scores_equal_slow_recursion():
    dice = np.random.default_rng(7)
    for _ in range(30):
        n = 40
        y = sorted(dice.choice(300, n, replace=False).tolist())
        x = dice.integers(0, 300, n).tolist()
        best = []
        for i in range(n):
            gains = [best[j] - passages.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best.append(passages.SEED_WORDS + max([0.0, *gains]))
        made = passages.chains(x, y, most_gap=10**6)
        assert sorted(p for c in made for p in c) == sorted(zip(x, y))
        assert all(a[0] < b[0] and a[1] < b[1] for c in made for a, b in zip(c, c[1:]))
        score = lambda c: passages.SEED_WORDS * len(c) - passages.GAP_COST * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1])
        assert abs(max(map(score, made)) - max(best)) < 1e-9


def test_edit_matches():
    assert passages.edit_matches([1, 2, 3, 4], [1, 3, 4]) == (3, 4)
    assert passages.edit_matches([], [5]) == (0, 1) and passages.edit_matches([7], [7]) == (1, 1)


def words_of(dice, n):
    return ["".join(dice.choice(list("abcdefghij"), 6)) for _ in range(n)]


def test_fuzzy_passages(spark):
    dice = np.random.default_rng(11)
    passage = words_of(dice, 90)
    changed = list(passage)
    del changed[30]
    changed[60] = "other"
    changed.insert(75, "added")
    rows = [
        (1, " ".join(words_of(dice, 40) + passage + words_of(dice, 40))), (2, " ".join(words_of(dice, 200))),
        (3, " ".join(words_of(dice, 10) + changed + words_of(dice, 10))), (4, " ".join(words_of(dice, 60) + passage[:51])),
        (5, " ".join(passage[:40])), (6, None), (7, ""), (None, " ".join(passage)), (8, " ".join(passage).upper()), (8, " ".join(passage).upper()),
        (9, "ha " * 60), (10, "ha " * 30), (11, "ha ho " + "ha " * 55),
    ]
    found = {(r.doc_id, r.ref_doc_id): r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {(3, 1), (4, 1), (8, 1), (11, 9)}
    fuzzy = found[3, 1]
    assert (fuzzy.ref_start_word, fuzzy.ref_end_word) == (40, 130) and (fuzzy.start_word, fuzzy.end_word) == (10, 100)
    assert 0.95 < fuzzy.identity < 1
    assert (found[4, 1].start_word, found[4, 1].end_word, found[4, 1].identity) == (60, 111, 1.0)


def test_all_repeated_runs_are_found(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id for r in passages.repeated_passages(docs).select("doc_id").distinct().collect()}
    seen, wanted = {}, set()
    for r in docs.orderBy("doc_id").collect():
        words = plain_words(r.text)
        own = {tuple(words[i:i + 50]) for i in range(len(words) - 49)}
        if any(w in seen for w in own):
            wanted.add(r.doc_id)
        seen.update(dict.fromkeys(own))
    assert wanted and wanted <= found


def test_passage_edges(spark, edge_docs):
    found = passages.repeated_passages(edge_docs.unionByName(edge_docs), least_words=15)
    assert {(r.doc_id, r.ref_doc_id) for r in found.collect()} == {(2, 1)}
    assert passages.repeated_passages(edge_docs.limit(0)).isEmpty()


def test_repeated_seeds_stand_apart():
    line = np.arange(9, dtype=np.uint64)
    h, at = passages.seeds_of(np.tile(line, 60))
    for value in set(h.tolist()):
        places = sorted(at[h == value].tolist())
        assert all(b - a >= passages.FLANK for a, b in zip(places, places[1:]))
        assert max(b - a for a, b in zip(places, places[1:])) < 2 * passages.FLANK


@pytest.mark.parametrize("gap", [28, 30, 40, 60])
def test_exact_passages_around_own_words(spark, gap):
    dice = np.random.default_rng(gap)
    a, b = words_of(dice, 55), words_of(dice, 55)
    rows = [(i, " ".join(words_of(dice, 20) + a + words_of(dice, gap) + b + words_of(dice, 20))) for i in (1, 2)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.start_word, r.end_word, r.ref_start_word, r.identity) for r in found) == [
        (20, 75, 20, 1.0), (75 + gap, 130 + gap, 75 + gap, 1.0)]


def test_pieces_equal_brute_force():
    dice = np.random.default_rng(3)
    for _ in range(60):
        equal = np.repeat(dice.random(12) < 0.75, dice.integers(1, 9, 12))
        columns = np.stack([equal, np.ones(len(equal), bool), equal | (dice.random(len(equal)) < 0.7)], 1).astype(np.int64)
        good = lambda i, j: (columns[i, 0] and columns[j - 1, 0] and columns[i:j, 0].sum() >= 0.8 * (j - i) - 1e-9
                             and columns[i:j, 2].sum() >= 10)
        wanted = {c for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if good(i, j) for c in range(i, j)}
        made = passages.pieces(columns, 10, 0.8)
        assert all(good(i, j) for i, j in made)
        assert {c for i, j in made for c in range(i, j)} == wanted


@pytest.mark.parametrize("length, copies, held", [(55, 6, 1), (50, 5, 1), (63, 4, 1), (30, 5, 2), (9, 20, 6)])
def test_passages_back_to_back_are_covered(spark, length, copies, held):
    dice = np.random.default_rng(length)
    line = words_of(dice, length)
    rows = [(1, " ".join(words_of(dice, 30) + line * held + words_of(dice, 30))),
            (2, " ".join(words_of(dice, 30) + line * copies + words_of(dice, 30)))]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {w for r in found for w in range(r.start_word, r.end_word)}
    assert covered == set(range(30, 30 + length * copies))


def test_run_meets_a_document_that_holds_it_whole(spark):
    dice = np.random.default_rng(21)
    own = lambda n=30: words_of(dice, n)
    p, q = words_of(dice, 60), words_of(dice, 50)
    r = words_of(dice, 20) + ["ha"] * 25 + words_of(dice, 20)
    rows = [own() + p[:40] + own(), own() + p[24:] + own(), own() + q[:30] + own() + q[20:] + own() + q + own(),
            own() + r[:45] + own(), own() + r[20:] + own()]
    rows += [own(40) + t + own() for t in (p, p, q, r, r)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    found = {(x.doc_id, x.ref_doc_id): (x.start_word, x.end_word, x.identity) for x in passages.repeated_passages(docs).collect()}
    assert found == {(6, 5): (40, 100, 1.0), (7, 2): (40, 90, 1.0), (9, 8): (40, 105, 1.0)}
