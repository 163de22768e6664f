"""Near-duplicates by Jaccard similarity against all pairs, and on odd input."""

import random

import brute
import numpy as np
from corpus_fixtures import none, odd, small  # noqa: F401

from chronoplane.llm import similar
from chronoplane.llm.common import table


def near_copies(docs, seed=1):
    rng = random.Random(seed)
    vocab = [w for t in docs[:50] for w in t.split()]
    texts = {}
    for t in docs:
        w = t.split()
        texts[len(texts)] = t
        for share in rng.sample((0.002, 0.005, 0.01, 0.015, 0.02, 0.03), 2):
            e = list(w)
            for _ in range(max(1, int(len(w) * share))):
                e[rng.randrange(len(e))] = rng.choice(vocab)
            texts[len(texts)] = " ".join(e)
    return texts


def test_recall_and_precision_against_all_pairs(spark, small):
    docs = [r["text"] for r in table(spark, small.replace("0.001", "0.01"), "documents").where("n_chars BETWEEN 300 AND 5000").collect()][:260]
    texts = near_copies(docs)
    got = {r["key"]: r["group"] for r in similar.similar_groups(spark.createDataFrame(list(texts.items()), "key long, text string")).collect()}
    want = brute.similar(texts)
    together = lambda g: {(a, b) for a in texts for b in range(a // 3 * 3, a) if g[a] == g[b]}
    true, found = together(want), together(got)
    assert len(true) > 300 and len(true & found) >= 0.97 * len(true) and not found - true
    # No group holds texts that all pairs keep apart.
    assert all(want[d] == want[g] for d, g in got.items())


def test_hot_groups_and_slices(spark, monkeypatch):
    """Thousands of copies and near copies of one text, and a bucket that is worked off in slices."""
    rng = random.Random(2)
    base = [f"word{i}" for i in range(200)]
    texts = {}
    for i in range(600):
        e = list(base)
        if i % 3:
            e[rng.randrange(200)] = f"other{rng.randrange(50)}"
        texts[i] = " ".join(e)
    texts[600] = "an unrelated text of some words that no other text has at all"
    frame = spark.createDataFrame(list(texts.items()), "key long, text string")
    want = {d: 0 for d in range(600)} | {600: 600}
    assert {r["key"]: r["group"] for r in similar.similar_groups(frame).collect()} == want
    assert sorted(r["key"] for r in similar.firsts(frame).collect()) == [0, 600]


def test_slices_find_the_same_links(spark):
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, (300, 2), dtype=np.int64)
    near = prints.copy()
    for row in near:
        for b in rng.choice(128, 8, replace=False):
            row[b // 64] ^= np.int64(-(1 << 63)) if b % 64 == 63 else np.int64(1 << int(b % 64))
    frame = spark.createDataFrame([tuple(map(int, r)) for r in np.concatenate([prints, near])], "f0 long, f1 long").distinct()
    want = {frozenset([tuple(a), tuple(b)]) for a, b in zip(prints.tolist(), near.tolist())}
    got = {frozenset([(r["a0"], r["a1"]), (r["b0"], r["b1"])]) for r in similar.candidates(frame, 600, 37).collect()}
    many = {frozenset([(r["a0"], r["a1"]), (r["b0"], r["b1"])]) for r in similar.candidates(frame, 1 << 18, 37).collect()}
    # Of four segments that differ by eight bits in all, one differs by two or fewer.
    assert got == want == many


def test_groups_on_odd_input(spark, odd, none):
    docs, _ = odd
    given = docs.selectExpr("coalesce(doc_id, 100 + length(coalesce(text, ''))) AS key", "text", "lang")
    got = {(r["key"], r["group"]) for r in similar.similar_groups(given).collect()}
    texts = {r["key"]: r["text"] for r in given.collect()}
    assert got == set(brute.similar(texts).items())
    assert similar.similar_groups(none.selectExpr("doc_id AS key", "text")).count() == 0


def test_copies_below_the_limit_are_few_candidates(spark, monkeypatch):
    """500 twins, all made from one text, so that twins are alike and all others have a similarity of about 0.65."""
    rng = random.Random(7)
    base = [f"word{i}" for i in range(300)]
    texts = {}
    for i in range(0, 1_000, 2):
        e = list(base)
        for at in rng.sample(range(300), 7):
            e[at] = f"other{rng.randrange(10_000)}"
        texts[i] = " ".join(e)
        e[rng.randrange(300)] = "twin"
        texts[i + 1] = " ".join(e)
    asked = []
    confirmed = similar.confirmed
    monkeypatch.setattr(similar, "confirmed", lambda pairs, *more: asked.append(pairs.count()) or confirmed(pairs, *more))
    got = {r["key"]: r["group"] for r in similar.similar_groups(spark.createDataFrame(list(texts.items()), "key long, text string")).collect()}
    want = brute.similar(texts)
    assert all(want[d] == want[g] for d, g in got.items())
    assert sum(got[i] == got[i + 1] for i in range(0, 1_000, 2)) == 500
    assert asked[0] < 30_000  # by fingerprints alone 83,709


def test_sketches_leave_out_only_the_unlike(spark):
    """Of texts at a similarity of 0.8 none or few are left out, of those at 0.6 most; short sets have no sketch."""
    rng = np.random.default_rng(8)

    def pair(alike, size=400):
        both = round(size * 2 * alike / (1 + alike))
        mine = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64)
        out = np.zeros((2, 3 + similar.SKETCH), np.uint64)
        for row, part in zip(out, (mine[:size], mine[size - both :]), strict=True):
            row[:2] = similar.wide_fingerprint(np.stack([part, part * np.uint64(0x9E3779B97F4A7C15) ^ (part >> np.uint64(29))], 1))
            row[3:] = similar.sketch(np.sort(part))
        return out

    one, other = np.array([0]), np.array([1])
    share = lambda alike: np.mean([similar._alike(pair(alike), one, other, 128, 126)[0] for _ in range(400)])
    assert share(0.8) > 0.99 and share(0.6) < 0.1
    rows = pair(0.3)
    rows[1, 3:] = 0
    assert similar._alike(rows, one, other, 128, 126)[0]


def test_pairs_grow_with_the_texts_and_not_with_their_square(spark, monkeypatch):
    """Texts made from one by three new words each: nearly all pairs are candidates at 0.82, and one component."""
    rng = random.Random(11)
    base = [f"word{i}" for i in range(300)]
    asked, most = [], {}
    confirmed = similar.confirmed
    monkeypatch.setattr(similar, "confirmed", lambda pairs, *more: asked.append(pairs.count()) or confirmed(pairs, *more))
    for n in (100, 400):
        texts = {}
        for i in range(n):
            e = list(base)
            for at in rng.sample(range(300), 3):
                e[at] = f"other{rng.randrange(10_000)}"
            texts[i] = " ".join(e)
        asked.clear()
        got = {r["key"]: r["group"] for r in similar.similar_groups(spark.createDataFrame(list(texts.items()), "key long, text string")).collect()}
        assert got == brute.similar(texts)
        most[n] = sum(asked)
    assert most[400] < 4 * 400 and most[400] < 6 * most[100]


def test_links_between_components_are_found_by_the_last_round(spark, monkeypatch):
    """Without rounds of nearest candidates, and with them, the components are those of all pairs."""
    rng = random.Random(12)
    texts = {}
    for c in range(6):
        e = [f"c{c}w{i}" for i in range(150)]
        for i in range(25):  # A chain: each is like the one before, the ends are not alike.
            e[rng.randrange(150)] = f"other{rng.randrange(10_000)}"
            texts[len(texts)] = " ".join(e)
    want = brute.similar(texts)
    frame = spark.createDataFrame(list(texts.items()), "key long, text string")
    for rounds in (0, similar.ROUNDS):
        monkeypatch.setattr(similar, "ROUNDS", rounds)
        assert {r["key"]: r["group"] for r in similar.similar_groups(frame).collect()} == want
