"""Language identification, spelling variants and phrases against plain versions, and on odd input."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from corpus_fixtures import none, odd, small  # noqa: F401
from pyspark.sql import functions as F

from check import norm
from chronoplane.llm import langid, phrases, queries, spelling
from chronoplane.llm.common import table

# -- language identification -----------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, small):
    got = queries.QUERIES["op11_langid"](spark, small.replace("0.001", "0.01"))
    docs = table(spark, small.replace("0.001", "0.01"), "documents").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and sum(x["share"] for x in r["langs"]) == pytest.approx(1) for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, small):
    docs = table(spark, small, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    key = lambda df: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in df.collect())
    assert key(langid.language_id(docs)) == key(langid.language_id(other))


def test_mixtures(spark, small):
    docs = table(spark, small.replace("0.001", "0.01"), "documents")
    model = langid.learn(docs.select("lang", "text"))
    texts = {}
    for r in docs.where("n_chars > 1500 AND text NOT LIKE '%License%'").collect():
        texts.setdefault(r["lang"], []).append(" ".join(r["text"].split()[:150]))
    mixed, rng = [], random.Random(5)
    for i in range(40):
        a, b = rng.sample(sorted(texts), 2)
        x, y = rng.choice(texts[a]).split(), rng.choice(texts[b]).split()
        n = rng.choice((50, 75, 120))
        mixed.append((i, " ".join(x[:150] + y[:n]), a, b, n / (150 + n)))
    frame = spark.createDataFrame([(m[0], m[1]) for m in mixed], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    good = 0
    for i, _, a, b, share in mixed:
        found = {x["lang"]: x["share"] for x in got[i]["langs"]}
        assert got[i]["lang_pred"] == a
        good += {a, b} <= set(found) and abs(found[b] - share) < 0.1
    assert good >= 36


def test_em_finds_the_most_likely_shares():
    rng = np.random.default_rng(2)
    likely = np.log(rng.random((60, 3)))
    starts = np.array([0, 20, 21])
    pi, value = langid.shares(likely, starts, np.ones((3, 3), bool), langid.Mixture(rounds=2000, close=1e-9))
    grid = [(a / 50, b / 50, (50 - a - b) / 50) for a in range(51) for b in range(51 - a)]
    for t, (a, b) in enumerate(zip(starts, [20, 21, 60])):
        p = np.exp(likely[a:b])
        best = max(np.log(np.maximum(p @ np.array(g), 1e-300)).sum() for g in grid)
        assert value[t] >= best - 1e-6 and value[t] == pytest.approx(np.log(p @ pi[t]).sum(), abs=1e-6)


def test_language_id_on_odd_input(spark, odd, none):
    docs, clash = odd
    got = langid.language_id(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["lang_pred"] in {"en", "de", "xx", "und"} and (r["doc_id"] not in (4, 5, 6) or (r["lang_pred"], r["score"]) == ("und", 0.0))
        assert r["doc_id"] is not None or r["held_out"]
    key = lambda df: sorted(map(repr, df.drop("langs").collect()))
    assert key(langid.language_id(docs)) == key(langid.language_id(clash))
    assert langid.language_id(none).count() == 0
    unlabelled = langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_long_texts_and_words_are_read_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "en", "one two three " * 900), (2, "de", "x" * 5_000 + " eins zwei"), (3, "de", "eins zwei drei " * 50)], "doc_id long, lang string, text string")
    whole = langid.learn(docs.select("lang", "text"))
    texts = [r["text"] for r in docs.collect()]
    block = langid.Block(texts)
    once = whole.words(block)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.allclose(whole.words(block), once) and len(once) == sum(len(t.split()) for t in texts)


# -- spelling variants -----------------------------------------------------------------------------------------------------------


def plain_variants(rows, rules):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % rules.noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= rules.least_chars and n >= rules.least_count}
    letters = sorted(set("".join(words)))

    def near(w):
        found = {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters}
        found |= {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in ["", *letters]}
        return [x for x in found - {w} if x in words]

    form, count = {}, {}
    for w in words:
        count[w] = len(found := near(w))
        if found and words[best := min(found, key=lambda x: (-words[x], x))] >= rules.ratio * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, count[w], words.get(form.get(w))) for w, n in words.items()}


def variants(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


@pytest.mark.parametrize("crowded", [20_000, 2])
def test_variants(spark, small, crowded):
    docs = table(spark, small, "documents")
    rules = spelling.Spelling(crowded=crowded)
    want = plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()], rules)
    got = spelling.spelling_variants(docs, rules)
    assert variants(got) == want and got.count() == len(want) and any(x[4] > 2 for x in want) and any(x[2] != x[1] for x in want if x[1])


@pytest.mark.parametrize("crowded", [20_000, 3])
def test_variants_of_dense_and_repeating_words(spark, crowded, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 50)
    rng = random.Random(9)
    words = ["".join(rng.choices("aé", k=rng.randint(5, 8))) for _ in range(600)] + ["a" * k for k in range(4, 12)] * 3
    rows = [(i, " ".join(rng.choices(words, k=200))) for i in range(30)]
    rules = spelling.Spelling(crowded=crowded, noise=13)
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), rules)
    assert variants(got) == plain_variants(rows, rules)


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted({"".join(random.Random(i).choices("abc", k=i % 5 + 1)) for i in range(300)})
    acceptor = spelling.Acceptor()
    root = acceptor.add(words)
    seen, todo = [], [(root, "")]
    while todo:
        s, w = todo.pop()
        if acceptor.final[s]:
            seen.append(w)
        todo.extend((t, w + a) for a, t in acceptor.arcs[s])
    assert sorted(seen) == words and acceptor.size[root] == len(words)
    right = set()
    for s in range(len(acceptor.size)):
        found, todo = [], [(s, "")]
        while todo:
            t, w = todo.pop()
            if acceptor.final[t]:
                found.append(w)
            todo.extend((u, w + a) for a, u in acceptor.arcs[t])
        right.add(tuple(sorted(found)))
    assert len(right) == len(acceptor.size)


def test_variants_on_odd_input(spark, odd, none):
    docs, clash = odd
    rules = spelling.Spelling(least_count=1)
    want = plain_variants([(r["doc_id"], r["text"]) for r in docs.collect()], rules)
    assert variants(spelling.spelling_variants(docs, rules)) == want == variants(spelling.spelling_variants(clash, rules))
    assert spelling.spelling_variants(none).count() == 0
    long = spark.createDataFrame([(i, "y" * 20_000 + " " + "y" * 19_999 + "z") for i in range(3)], "doc_id long, text string")
    got = spelling.spelling_variants(long, spelling.Spelling(noise=1 << 40)).collect()
    assert [(len(r["word"]), r["n"], r["n_near"], r["form"]) for r in got] == [(20_000, 3, 1, None)] * 2


# -- phrases ---------------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, rules):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for i in range(len(w)):
                for j in range(i + 1, min(i + rules.longest, len(w)) + 1):
                    f[lang, tuple(w[i:j])] += 1
    kept = {}
    cand = {k: a for k, a in f.items() if a >= rules.least and len(k[1]) > 1}
    for (lang, p), a in cand.items():
        score, k = min((rules.scale * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if not any(x == lang and len(q) > len(p) and 100 * b >= rules.contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in cand.items()):
            kept.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = set()
    for lang, found in kept.items():
        for i, (s, a, p, left, right) in enumerate(sorted(found)[: rules.first]):
            out.add((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return out


def phrase_rows(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.mark.parametrize("ranked, tile", [(4_096, 512), (64, 8), (8, 8)])
def test_phrases(spark, ranked, tile, monkeypatch):
    """With few ranks and small tiles, all of dense tiles, sparse tiles and coordinates occur. Tasks read the defaults."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["über", "\x00odd"]
    weights = [1 / (i + 1) for i in range(len(words))]
    common = ["w1 w2 w3 w4 w5 w6", "w9 w8 w7", "the same phrase here"]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.2 else rng.choices(words, weights)[0] + rng.choice(["", "", "", ",", "\n", "!", "\t"]) for _ in range(60))
    rows = [(rng.choice(["en", "en", "en", None, "und", "de"]), text()) for _ in range(120)] + [("en", None), ("en", ""), (None, None)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    rules = phrases.Phrases(least=8, first=60)
    want = plain_phrases(rows, rules)
    assert phrase_rows(phrases.collocations(docs, rules)) == want and any(len(x[2].split()) == 5 for x in want)
    # The counting itself, at this size of tiles.
    monkeypatch.setattr(phrases, "RANKED", ranked)
    monkeypatch.setattr(phrases, "TILE", tile)
    ids = np.array([rng.choices(range(1, 43), weights)[0] for _ in range(5_000)], np.uint64)
    top = [w for w, _ in Counter(ids.tolist()).most_common(ranked)]
    known = phrases.Level(np.full(1 << 20, ~np.uint64(0)), np.array(top, np.uint64).reshape(-1, 1))
    items = ids.reshape(-1, 1)
    rank = known.rank(items, phrases._mixed(items))
    places = np.lib.stride_tricks.sliding_window_view(ids, 2)
    found, n = phrases._counted(places, np.stack([rank[:-1], rank[1:]], 1), known)
    assert dict(zip(map(tuple, found.tolist()), n.tolist(), strict=True)) == Counter(map(tuple, places.tolist()))


def test_phrases_equal_sql_at_low_limits(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    sql = phrases.PHRASES_SQL.replace(">= 100\n", ">= 6\n")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    want = sorted(tuple(norm(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
    got = phrases.collocations(table(spark, small, "documents"), phrases.Phrases(least=6))
    assert sorted(tuple(norm(r[c]) for c in names) for r in got.collect()) == want and len(want) > 500


def test_scores_beyond_64_bits(spark):
    counts = spark.createDataFrame([([1], 10**13), ([2], 10**13), ([1, 2], 9 * 10**12)], "ids array<long>, f long")
    words = spark.createDataFrame([("en", "x", 10**13, 1), ("en", "y", 10**13, 2), ("en", "z", 3 * 10**15 + 7, 3)], "lang string, word string, f long, id long")
    got = phrases.scored(counts, words, phrases.Phrases()).collect()
    assert [int(r["score"]) for r in got] == [1000 * 9 * 10**12 * (2 * 10**13 + 3 * 10**15 + 7) // 10**26]


def test_phrases_on_odd_input(spark, odd, none):
    docs, clash = odd
    rules = phrases.Phrases(least=2)
    want = plain_phrases([(r["lang"], r["text"]) for r in docs.where("doc_id IS NULL OR doc_id NOT IN (7, 8)").collect()], rules)
    short = lambda df: df.where("doc_id IS NULL OR doc_id NOT IN (7, 8)")
    assert phrase_rows(phrases.collocations(short(docs), rules)) == want == phrase_rows(phrases.collocations(short(clash), rules))
    assert phrases.collocations(docs, rules).count() > len(want) and phrases.collocations(none).count() == 0


def test_rare_phrases_of_frequent_words_stay_in_their_tasks(spark):
    """All words are frequent and all pairs but three rare: only the cells of the three are full."""
    rng = random.Random(5)
    rows = [("en", f"{rng.randrange(300)} {rng.randrange(300)}. both come {'often' if i % 2 else 'seldom'}{'' if i % 50 else ' again'}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    docs = docs.select("lang", F.col("text").cast("binary").alias("text"))
    words, salt = phrases.vocabulary(docs)
    known = phrases.level(words.where("f >= 10").select(F.col("id").alias("w0"), "f"), 1)
    runs = phrases.encoded(docs, known, salt).localCheckpoint()
    f = Counter()
    for _, text in rows:
        for piece in text.split("."):
            w = piece.split()
            f.update(zip(w, w[1:], strict=False))
    want = {p: n for p, n in f.items() if n >= 1_500}
    assert len(want) == 3 and len(f) > 5_000
    shared = spark.sparkContext.broadcast(known)
    full = phrases.full_cells(runs, 2, shared, 16, 1_500)
    assert int(np.bitwise_count(full).sum()) == 3
    # Tasks' counts, none of which is enough alone, fill a cell together; the limit doesn't fit a byte.
    got = phrases.phrase_counts(runs, 2, known, 30_000, 1_500).collect()
    name = {r["id"]: r["word"] for r in words.collect()}
    assert {(name[r["w0"]], name[r["w1"]]): r["f"] for r in got} == want


def test_the_driver_gets_no_object_for_each_word_of_the_sieve(spark):
    """200,000 frequent items set bits of about as many words of the sieve; as rows these took over 100 MB of the driver's Python."""
    found = spark.range(200_000).select(F.xxhash64("id").alias("w0"), F.xxhash64("id", F.lit(1)).alias("w1"), (100 + F.col("id") % 1000).alias("f"))
    rows = [(*np.array([r["w0"], r["w1"]]).view(np.uint64).tolist(), r["f"]) for r in found.collect()]
    arrow = "spark.sql.execution.arrow.pyspark.enabled"  # off unless a session sets it
    was = spark.conf.get(arrow)
    spark.conf.set(arrow, "false")
    tracemalloc.start()
    try:
        known = phrases.level(found, 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set(arrow, was)
    assert peak < 40 << 20  # 8 MB of them the sieve, 2 MB the slots of ranks
    items = np.array([r[:2] for r in rows], np.uint64)
    bit = phrases._mixed(items) & np.uint64((1 << phrases.SIEVE_BITS) - 1)
    assert known.frequent(phrases._mixed(items)).all() and int(np.bitwise_count(known.sieve).sum()) == len(np.unique(bit))
    top = sorted(rows, key=lambda r: (-r[2], *np.array(r[:2], np.uint64).view(np.int64).tolist()))[: phrases.RANKED]
    ranked = phrases.Level(known.sieve, np.array([r[:2] for r in top], np.uint64)).items
    assert (known.items == ranked).all() and len(ranked) > 4_000


def test_colliding_ids_get_another_salt(spark, monkeypatch):
    docs = spark.createDataFrame([("en", b"one two three")], "lang string, text binary")
    real = phrases.with_ids
    salts = []

    def collide(counts, salt):
        salts.append(salt)
        out = real(counts, salt)
        return out.withColumn("id", F.lit(5).cast("long")) if salt == 0 else out

    monkeypatch.setattr(phrases, "with_ids", collide)
    found, salt = phrases.vocabulary(docs)
    assert salts == [0, 1] and salt == 1 and found.select("id").distinct().count() == 3
