"""Decontamination, quality rules, personal data, URL filters."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.llm import boosting, decontaminate, pii, quality, urls


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def hits_slowly(text, items, window=13):
    words, hit, found = plain(text), set(), set()
    for item_id, item in items:
        own = plain(item)
        size = min(window, len(own))
        wanted = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in wanted:
                hit.update(range(i, i + size))
                if item_id is not None:
                    found.add(item_id)
    return len(words), len(hit), sorted(found)


ITEMS = [
    (10, " ".join(f"w{i}" for i in range(20))), (11, "Short item!"), (11, "another text of the same id"), (12, None), (13, "..."),
    (None, "nameless thing here"), (14, " ".join(f"w{i}" for i in range(5, 19))), (15, "straße é-x"),
]
TEXTS = [
    "a " + " ".join(f"W{i}" for i in range(20)) + " b", "w3 w4 w5 w6", "x short, ITEM short item", "nameless thing here.", None, "", "!!",
    " ".join(f"w{i}" for i in range(4, 18)), "Straße É-x straße é x", "short item " * 50, "short item " + "pad " * 45,
]


@pytest.mark.parametrize("set_bytes", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, set_bytes):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])], "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.scan(docs, benchmark, set_bytes=set_bytes).collect()
    assert len(found) == len(TEXTS) + 1
    for r in found:
        assert (r.scan.n_words, r.scan.n_hit, r.scan.items) == hits_slowly(r.text, ITEMS)


def test_decontamination_removes(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = {r.doc_id for r in decontaminate.remove_documents(docs, benchmark).collect()}
    expected = set()
    for i, t in enumerate(TEXTS):
        n, hit, _ = hits_slowly(t, ITEMS)
        if not (hit > 0 and 20 * hit >= n):
            expected.add(i)
    assert kept == expected and 10 in kept and 9 not in kept
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, benchmark).collect()}
    assert cut[0] == "a  b" and cut[1] == TEXTS[1] and cut[3] == "." and cut[4] is None and cut[5] == ""
    assert all(hits_slowly(t, ITEMS)[1] == 0 for t in cut.values())


def test_decontamination_edges(spark, edge_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.scan(edge_docs, nothing)
    assert found.count() == edge_docs.count() and found.filter("scan.n_hit > 0").isEmpty()
    assert decontaminate.remove_documents(edge_docs, nothing).columns == edge_docs.columns
    assert decontaminate.scan(edge_docs.limit(0), nothing).isEmpty()
    with pytest.raises(ValueError):
        decontaminate.scan(edge_docs, nothing, into="Part")


def test_line_rules():
    fault = lambda s: quality.line_fault(s.encode(), s.encode().split())
    assert fault("Home | News | About | Contact") == "navigation"
    assert fault("thr*** onth$$$ ing%%% thr###") == "symbols"
    assert fault("a, b; (c) - d. e! ? f: / g") == "punctuation"
    assert fault("Licensed under CC BY-NC 4.0.") == "boilerplate"
    assert fault("WIN BIG PRIZES TODAY") == "shouting"
    assert fault("spam " * 12) == "repetition"
    assert fault("An ordinary sentence, with a comma and an end.") is None
    assert fault("") is None


def test_repeated_words_slowly():
    dice = np.random.default_rng(1)
    for n in (0, 4, 5, 6, 40, 300):
        words = [bytes([97 + x]) for x in dice.integers(0, 3, n)]
        windows = [tuple(words[i:i + 5]) for i in range(n - 4)]
        counts = Counter(windows)
        slow = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
        assert quality.repeated_words(words, 5) == len(slow)


def test_quality_edges(spark, edge_docs):
    found = quality.assess(edge_docs, clean=True)
    rows = {r.doc_id: r.quality for r in found.collect()}
    assert found.count() == edge_docs.count()
    assert rows[1].kept and not rows[3].kept and not rows[4].kept and not rows[5].kept and not rows[-9].kept
    assert rows[3].n_words == rows[3].word_chars == 0 and rows[3].clean_text is None
    assert rows[7].kept and rows[7].n_words == 60_000 and rows[8].n_dup_lines == 2
    kept = quality.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns and quality.keep_good(edge_docs.limit(0)).isEmpty()


def test_quality_removes_lines(spark):
    text = "A first sentence that says something of use to people.\nHome | News | About | Help\nAnd a second one, which follows it at once."
    row = quality.keep_good(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.text == text.replace("Home | News | About | Help\n", "")


def test_quality_agrees_with_labels(spark, medium):
    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.assess(docs.select("doc_id", "text"), into="found").join(labels, "doc_id").filter("not found.base_failed")
    kept = F.avg(F.col("found.kept").cast("int"))
    shares = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg(kept.alias("kept")).collect()}
    assert shares[1] > 0.97 and shares.get(0, 0) < 0.35


def strict_slowly(text):
    """The patterns as they are, leftmost and non-overlapping for each kind."""
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    out = [(m.start(), m.end(), k) for k, p, good in kinds for m in re.finditer(p, text) if good(m[0])]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


PII = [
    "mail a.b+c@x-y.example.com, or a@b@c.de. x@y no", "@x.com a@.com a@b..c a@b.c.", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.4 9999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111", "+1 (017) 555-7713 +49 30 1234567- +1 +12345678901234567 ++44 20 7946 0958",
    "1" * 500, "é😀 tel +33 1 23 45 67 89 é", "a" * 3000 + "@", "4111111111111111 4111111111111111", "", None, "٣٤٥ ١.٢.٣.٤ +٣٤٥",
    "a@b.c@d.e x@y.z", "card\n4111\n1111", "0.0.0.0.0.0.0.0",
]


def test_strict_spans():
    for text in PII:
        assert pii.strict_spans(text) == strict_slowly(text)
    dice = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(dice.choice(list("aB1204.@+- ()%é"), 40))
        assert pii.strict_spans(text) == strict_slowly(text), text


def test_strict_spans_over_table(spark, medium):
    for r in spark.read.parquet(f"{medium}/documents.parquet").select("text").collect():
        assert pii.strict_spans(r.text) == strict_slowly(r.text)


def test_trees_learn_an_interaction():
    dice = np.random.default_rng(5)
    x = dice.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    trees = boosting.Boosted().fit(x[:3000], y[:3000])
    p = boosting.boosted_scores(vars(trees), x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.95 and 0 <= p.min() and p.max() <= 1


def test_thresholds_reach_precision():
    scores, truth = np.array([0.9, 0.8, 0.7, 0.6, 0.55]), np.array([1, 1, 0, 1, 0.0])
    found = pii.thresholds(np.zeros(5), scores, truth, 0.9)
    assert found["email"] == 0.8 and found["card"] > 1


def test_pii_model_adds_and_masks(spark, edge_docs):
    dice = np.random.default_rng(8)
    rows = []
    for i in range(300):
        card = "4" + "".join(map(str, dice.integers(0, 10, 14)))
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        phone = f"+1 ({dice.integers(200, 999)}) 555-{dice.integers(1000, 9999)}"
        rows.append((i, f"call {phone} or pay with {card} now; order {dice.integers(10**15, 10**16)} of v{i}.2.3 token a{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    assert len(model["features"])
    probe = spark.createDataFrame([(1, "pay with 4111.1111.1111.1111 now"), (2, "plain words, version 1.2.3"), (3, None), (4, "a@b.cd")], "doc_id long, text string")
    found = {r.doc_id: r.pii for r in pii.find(probe, model).collect()}
    assert [s.kind for s in found[1].spans] == ["card"] and not found[1].base and not found[2].spans and not found[3].spans
    masked = {r.doc_id: r.text for r in pii.redact(probe, model).collect()}
    assert masked == {1: "pay with [CARD] now", 2: "plain words, version 1.2.3", 3: None, 4: "[EMAIL]"}
    untaught = pii.fit(edge_docs)
    out = pii.redact(edge_docs, untaught)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    assert pii.redact(docs.limit(0)).isEmpty()


def test_pii_learns_beside_a_large_group_of_copies(spark):
    dice = np.random.default_rng(18)
    texts = [f"call +1 ({dice.integers(200, 999)}) 555-{dice.integers(1000, 9999)} now; order {dice.integers(10**15, 10**16)} "
             f"of v{i}.2.3 or 20{i % 90 + 10}.1.2.{i}" for i in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts + ["copied 1"] * 60_000], "text string")
    assert len(pii.fit(docs, sample_docs=60)["features"])


def _letters(i):
    return "".join("abcdefghij"[int(c)] for c in str(i))


def test_pii_learns_from_every_text(spark):
    dice = np.random.default_rng(28)
    texts = [f"call +1 ({dice.integers(200, 999)}) 555-{dice.integers(1000, 9999)} or v{i}.2.3, 20{i % 90 + 10}.1.2.{i}" for i in range(60)]
    # no digit and no @, yet candidates; more texts than any sample held
    texts += [f"we met at {_letters(i)}.{_letters(i * 7)} today" for i in range(4_500)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:100], None, ""]], "text string").repartition(8)
    rows = [(tuple(x), y) for t in texts for x, y in pii.training_rows(t)]
    found = pii.candidates(docs).collect()
    assert sorted((tuple(r.x), r.y) for r in found) == sorted(rows) and len(rows) > 4_500
    one, many = pii.fit(docs), pii.fit(docs, block_rows=25)
    assert len(one["features"]) and one["thresholds"] == many["thresholds"]
    assert all(np.array_equal(one[k], many[k]) for k in ("start", "features", "borders", "leaves"))


def test_thresholds_count_equal_candidates_at_once():
    kinds, scores, truth = np.zeros(6), np.array([0.9, 0.9, 0.8, 0.7, 0.7, 0.6]), np.array([1, 0, 1, 1, 1, 0.0])
    once = pii.thresholds(np.zeros(4), np.array([0.6, 0.7, 0.8, 0.9]), np.array([0, 2, 1, 1.0]), 0.75, count=np.array([1, 2, 1, 2.0]))
    assert once == pii.thresholds(kinds, scores, truth, 0.75)


URLS = [
    "http://a.org/x", "http://ORG", "https://www.example.org/es/1?x#y", "https://m.example.org/en/12", "https://example.org/en/2",
    "http://x.com/fr/1", "http://x.com/de/1", "http://notorg/", "http://a.b.org?x/y", "ftp://casino.net/a", "http://mycasino.net/",
    "http://x.net/?u=http://casino.net/", "http://x.net/affiliate/1/redirect", "http://x.net/affiliates/redirect", None, "", "no scheme",
    "://", "http://user@Free-Bets.example.net:80/p", "http://x.net/a\nb?c",
]


def test_url_judgements(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = {r.url: r.judged for r in urls.judge(pages).collect()}
    assert len(rows) == len(URLS)
    assert rows["http://ORG"].rule is None and rows["http://ORG"].host == "org" and rows["http://a.org/x"].rule == "org/"
    assert rows["https://www.example.org/es/1?x#y"].rule == "example.org/es/" and rows["https://www.example.org/es/1?x#y"].verdict == "block"
    assert rows["https://m.example.org/en/12"].verdict == "block" and rows["https://example.org/en/2"].rule == "org/"
    assert rows["http://x.com/fr/1"].verdict == "allow" and rows["http://x.com/de/1"].verdict == "block"
    assert rows["http://notorg/"].rule is None and rows["http://a.b.org?x/y"].path == ""
    assert rows["ftp://casino.net/a"].pattern == "host:casino" and rows["http://mycasino.net/"].verdict == "allow"
    assert rows["http://x.net/?u=http://casino.net/"].verdict == "allow"
    assert rows["http://x.net/affiliate/1/redirect"].verdict == "block"
    assert rows[None].host == rows[""].path == rows["no scheme"].host == "" and rows[None].verdict == "allow"
    assert rows["http://user@Free-Bets.example.net:80/p"].pattern == "host:free-bets" and rows["http://x.net/a\nb?c"].path == "/a\nb"
    assert urls.judge(pages.limit(0)).isEmpty()


def test_rule_index_runs_only_fetched_rules():
    patterns = [("host", "free-bets"), ("host", "casino"), ("path", "*tracker*")]
    index = urls.RuleIndex(patterns, {"free": 100, "bets": 2, "casino": 1})
    assert index.by_token == {"bets": [0], "casino": [1]} and index.rest == [2]
    for u in filter(None, URLS):
        slow = next((":".join(p) for p in patterns if re.search(urls.to_regex(*p), u.lower().partition("://")[2], re.S)), None)
        assert index.first_match(u) == slow


def test_covered_places_equal_all_comparisons():
    draw = random.Random(8)
    for _ in range(300):
        spans = [(a := draw.randrange(60), a + draw.randrange(1, 9), "ip") for _ in range(draw.randrange(8))]
        covered, apart, own = pii.Covered(spans), pii.Covered(), []
        for _ in range(30):
            start = draw.randrange(70)
            end = start + draw.randrange(1, 9)
            assert covered.touches(start, end) == any(a < end and start < b for a, b, _ in spans)
            slow = any(a < end and start < b for a, b in own)
            assert apart.touches(start, end) == slow
            if not slow:
                apart.add(start, end)
                own.append((start, end))


def test_a_text_of_numbers_takes_time_in_proportion():
    """Two megabytes of addresses and phone-like numbers, more than 10^10 comparisons of pairs."""
    text = "10.0.0.1 or 4929 555 0100 or +1 212 555 0199, " * 50_000
    model = {"start": 5.0, "features": np.zeros((1, 7), int), "borders": np.zeros((1, 7)), "leaves": np.zeros((1, 8)),
             "thresholds": dict.fromkeys(pii.KINDS, 0.5)}
    begin = time.process_time()
    strict, spans = pii.all_spans(model, text)
    assert len(strict) == 100_000 and len(spans) > len(strict)
    assert len({s[:2] for s in spans}) == len(spans) and time.process_time() - begin < 60
