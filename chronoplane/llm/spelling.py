"""Spelling variants: words one edit apart, by composing a vocabulary acceptor with a one-edit transducer and itself."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.common import drop_stored, store

#: Runs of letters from A to Z and from U+00C0 to U+00FF, in lower-cased UTF-8.
RUN = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
#: Different words that a task counts before it passes them on.
COUNTED = 200_000
#: Words that a task composes at once; a chunk ends where an initial state ends.
CHUNK = 40_000
#: Rows of initial states for each task, on average.
PER_TASK = 60_000
NEAR = "word string, n_near long, best_n long, best string"
#: Stands for the replaced or inserted letter in the key of a crowded initial state; no word holds it.
GAP = "\x00"


@dataclass(frozen=True)
class Spelling:
    """least_chars, least_count: words that are shorter or rarer are left out. ratio: a form is so many times as frequent.

    noise: where it divides the unsigned crc32 of `<id>:<run>`, the run loses one code point. crowded: an initial state
    with more words is not composed in one task but letter by letter, through a join.
    """

    least_chars: int = 5
    least_count: int = 3
    ratio: int = 2
    noise: int = 97
    crowded: int = 20_000


def vocabulary(docs: DataFrame, rules: Spelling, id_col: str, text_col: str) -> DataFrame:
    """(word, n): counted in each task first, so that a frequent word meets as a row per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in seen], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, n in Counter(RUN.findall((text.as_py() or b"").lower())).items():
                    if (h := zlib.crc32(run, start)) % rules.noise == 0:
                        whole = run.decode()
                        at = h % len(whole)
                        run = (whole[:at] + whole[at + 1 :]).encode()
                    if len(run) >= rules.least_chars:
                        seen[run] += n
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    given = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counts = given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.length("word") >= rules.least_chars) & (F.col("n") >= rules.least_count))


class Acceptor:
    """The minimal acceptor of sorted words, state by state; children have smaller numbers than their parents.

    final[s]: a word ends in s. arcs[s]: (letter, state) in order. size[s]: words that s accepts. Words of a state are
    numbered in order: the one that ends there first, then those of each arc.
    """

    def __init__(self) -> None:
        self.final: list[bool] = []
        self.arcs: list[tuple] = []
        self.size: list[int] = []
        self.known: dict[tuple, int] = {}

    def _state(self, final: bool, arcs: list) -> int:
        key = (final, *arcs)
        s = self.known.get(key)
        if s is None:
            s = self.known[key] = len(self.size)
            self.final.append(final)
            self.arcs.append(key[1:])
            self.size.append(final + sum(self.size[t] for _, t in arcs))
        return s

    def add(self, words: list[str]) -> int:
        """The initial state of these words, which are sorted and distinct. States are shared with words added before."""
        path: list[list] = [[False, []]]
        last = ""
        for w in words:
            same, most = 0, min(len(w), len(last))
            while same < most and w[same] == last[same]:
                same += 1
            for k in range(len(last), same, -1):
                final, arcs = path.pop()
                path[-1][1].append((last[k - 1], self._state(final, arcs)))
            path.extend([False, []] for _ in range(len(w) - same))
            path[-1][0] = True
            last = w
        for k in range(len(last), 0, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[k - 1], self._state(final, arcs)))
        return self._state(*path[0])

    def _places(self, s: int) -> list[tuple[str, int, int]]:
        """(letter, state, number of the first word) of each arc."""
        out, at = [], int(self.final[s])
        for a, t in self.arcs[s]:
            out.append((a, t, at))
            at += self.size[t]
        return out

    def _both(self, s: int, t: int, x: int, y: int, out: list[tuple[int, int]]) -> None:
        """Adds the numbers of the words that both states accept, counted from x and y."""
        todo = [(s, t, x, y)]
        while todo:
            s, t, x, y = todo.pop()
            if s == t:
                out.extend((x + i, y + i) for i in range(self.size[s]))
                continue
            if self.final[s] and self.final[t]:
                out.append((x, y))
            if not self.arcs[s] or not self.arcs[t]:
                continue
            other = {a: (u, at) for a, u, at in self._places(t)}
            for a, u, at in self._places(s):
                if a in other:
                    v, there = other[a]
                    todo.append((u, v, x + at, y + there))

    def edits(self) -> list[list[tuple[int, int]]]:
        """For each state the pairs of its words of which one becomes the other by an edit of the next letter.

        That is the composition with the transducer, which takes its edit here: a letter is replaced (two arcs), or
        deleted (an arc, and the state itself). What follows is accepted on both sides. In a run of equal letters the
        last one counts as the deleted one, so that each pair comes up once.
        """
        found = []
        for s in range(len(self.size)):
            out: list[tuple[int, int]] = []
            arcs = self._places(s)
            for i, (a, t, x) in enumerate(arcs):
                for _, u, y in arcs[i + 1 :]:
                    self._both(t, u, x, y, out)
                if self.final[s] and self.final[t]:
                    out.append((x, 0))
                if self.arcs[t]:
                    beyond = {b: (u, at) for b, u, at in self._places(t)}
                    for b, u, y in arcs:
                        if b != a and b in beyond:
                            v, at = beyond[b]
                            self._both(v, u, x + at, y, out)
            found.append(out)
        return found


def near_numbers(groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of words of a group that are one edit apart, as numbers of words over all groups; words are sorted."""
    acceptor = Acceptor()
    roots = [acceptor.add(g) for g in groups]
    direct = acceptor.edits()
    holds = []
    for s, d in enumerate(direct):
        holds.append(bool(d) or any(holds[t] for _, t in acceptor.arcs[s]))
    xs: list[int] = []
    ys: list[int] = []
    start = 0
    for g, root in zip(groups, roots, strict=True):
        todo = [(root, start)] if holds[root] else []
        while todo:
            s, base = todo.pop()
            if direct[s]:
                xs.extend([base + x for x, _ in direct[s]])
                ys.extend([base + y for _, y in direct[s]])
            todo.extend((t, base + at) for _, t, at in acceptor._places(s) if holds[t])
        start += len(g)
    return np.array(xs, np.int64), np.array(ys, np.int64)


def _composed(keys: list[str], rests: list[str], ns: list[int]) -> pa.RecordBatch:
    """The near words of a chunk of whole initial states. A key holds the class, the direction and the first letters."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    x, y = near_numbers([rests[a:b] for a, b in zip(cuts, cuts[1:])])
    heads = [k.split(" ", 2) for k in keys]
    shorter = np.array([int(h[0]) for h in heads])
    back = np.array([h[1] == "1" for h in heads])
    words = [h[2] + r for h, r in zip(heads, rests, strict=True)]
    words = [w[::-1] if b else w for w, b in zip(words, back.tolist(), strict=True)]
    length = np.array([len(w) for w in words])
    # Two words of the longer length come up in their own class as well; pairs that share the first half too come up there.
    keep = (length[x] == shorter[x]) | (length[y] == shorter[y])
    halves: dict[str, int] = {}
    half = np.array([halves.setdefault(w[: c // 2], len(halves)) for w, c in zip(words, shorter.tolist(), strict=True)])
    keep &= ~back[x] | (half[x] != half[y])
    x, y = x[keep], y[keep]
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    n = np.array(ns, np.int64)
    order = np.lexsort((place[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    count = np.diff(np.append(first, len(x)))
    a, b = x[first].tolist(), y[first].tolist()
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in a], pa.string()), pa.array(count, pa.int64()), pa.array(n[y[first]], pa.int64()), pa.array([words[i] for i in b], pa.string())], names=["word", "n_near", "best_n", "best"])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by key and rest, and composes chunks that end with an initial state."""
    keys: list[str] = []
    rests: list[str] = []
    ns: list[int] = []
    for batch in batches:
        keys += batch.column(0).to_pylist()
        rests += batch.column(1).to_pylist()
        ns += batch.column(2).to_pylist()
        if len(keys) > CHUNK:
            end = len(keys) - 1
            while end and keys[end - 1] == keys[-1]:
                end -= 1
            if end:
                yield _composed(keys[:end], rests[:end], ns[:end])
                keys, rests, ns = keys[end:], rests[end:], ns[end:]
    if keys:
        yield _composed(keys, rests, ns)


def initial_states(words: DataFrame, least_chars: int) -> DataFrame:
    """(key, rest, n): each word below the initial states that it passes.

    Of two words one edit apart, the shorter of c letters, the first c // 2 letters are equal or the last c // 2 are. So a
    word stands in the classes c of its own length and of one less, read forwards and backwards, in the initial state
    that the first c // 2 letters lead to.
    """
    states = []
    for less in (0, 1):
        for back in (0, 1):
            c = F.length("word") - less
            read = F.reverse("word") if back else F.col("word")
            half = F.floor(c / 2).cast("int")
            key = F.concat_ws(" ", c.cast("string"), F.lit(str(back)), F.substring(read, F.lit(1), half))
            state = F.struct(key.alias("key"), F.substring(read, half + 1, F.length("word")).alias("rest"), F.col("n"))
            states.append(state if not less else F.when(c >= least_chars, state))
    return words.select(F.inline(F.filter(F.array(*states), lambda s: s.isNotNull())))


def _by_letter(crowded: DataFrame) -> DataFrame:
    """Near words of crowded initial states: the transducer's edit is taken at each letter, its two sides are the join key.

    A key has as many words as there are letters at most, and the word without one.
    """
    c = F.split_part("key", F.lit(" "), F.lit(1)).cast("int")
    m = F.length("rest")
    spot = lambda i, skip: F.concat(F.substring("rest", F.lit(1), i), F.lit(GAP), F.substring("rest", i + 1 + skip, m))
    # A letter before an equal one isn't the deleted one; as a replaced one any letter counts.
    gone = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(spot(i, 1).alias("key2"), F.substring("rest", i + 1, F.lit(1)).alias("letter")))
    kept = F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(spot(i, 0).alias("key2"), F.lit("").alias("letter")))
    own = F.length(F.split_part("key", F.lit(" "), F.lit(3))) + m == c
    spots = F.when(own, F.concat(F.when(m > 0, gone).otherwise(F.array().cast("array<struct<key2:string,letter:string>>")), kept)).otherwise(gone)
    rows = crowded.withColumn("own", own).select("key", "rest", "n", "own", F.inline(spots))
    sides = rows.groupBy("key", "key2").agg(F.collect_list(F.struct("letter", "own", "n", "rest")).alias("all")).where(F.size("all") > 1)
    follows = F.substring_index("key2", GAP, -1)

    def near(me: Column, you: Column) -> Column:
        replaced = me["own"] & you["own"] & (me["letter"] != "") & (you["letter"] != "") & (me["letter"] != you["letter"])
        dropped = lambda a, b: (b["letter"] == "") & ~a["own"] & (a["letter"] != "") & (a["letter"] != F.substring(follows, 1, 1))
        return replaced | dropped(me, you) | dropped(you, me)

    mine = sides.select("key", "all", follows.alias("f"), "key2", F.explode("all").alias("me"))
    pairs = F.filter("all", lambda y: near(F.col("me"), y))
    found = mine.select("key", F.col("me.rest").alias("rest"), pairs.alias("near")).where(F.size("near") > 0)
    return found


def _crowded_near(crowded: DataFrame) -> DataFrame:
    """`_by_letter` as rows of whole words, pairs that the first half's states give left to these."""
    c = F.split_part("key", F.lit(" "), F.lit(1)).cast("int")
    back = F.split_part("key", F.lit(" "), F.lit(2)) == "1"
    head = F.split_part("key", F.lit(" "), F.lit(3))
    whole = lambda rest: F.when(back, F.reverse(F.concat(head, rest))).otherwise(F.concat(head, rest))
    half = F.floor(c / 2).cast("int")
    found = _by_letter(crowded).select("key", whole(F.col("rest")).alias("word"), F.transform("near", lambda y: F.struct((-y["n"]).alias("less"), whole(y["rest"]).alias("word"))).alias("near"))
    apart = F.filter("near", lambda y: ~back | (F.substring(y["word"], F.lit(1), half) != F.substring("word", F.lit(1), half)))
    found = found.select("word", apart.alias("near")).where(F.size("near") > 0)
    best = F.array_min("near")
    return found.select("word", F.size("near").cast("long").alias("n_near"), (-best["less"]).alias("best_n"), best["word"].alias("best"))


def near_words(words: DataFrame, count: int, rules: Spelling) -> DataFrame:
    """(word, n_near, best_n, best): the number of near words, and the most frequent one. words: (word, n), `count` of them."""
    states = initial_states(words, rules.least_chars)
    sizes = states.groupBy("key").count().where(F.col("count") > rules.crowded).select(F.col("key").alias("k"))
    marked = states.join(sizes, states.key == sizes.k, "left")
    tasks = max(1, -(-4 * count // PER_TASK))
    calm = marked.where("k IS NULL").select("key", "rest", "n").repartition(tasks, "key").sortWithinPartitions("key", "rest").mapInArrow(_compose, NEAR)
    found = calm.unionByName(_crowded_near(marked.where("k IS NOT NULL").select("key", "rest", "n")))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the form's form and so on, twice as far in each round."""
    spark = forms.sparkSession
    now, path = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = now.join(ahead, now.root == ahead.at, "left")
        if moved.where("next IS NOT NULL").isEmpty():
            return now
        after, path_after = store(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")
        drop_stored(spark, path)
        now, path = after, path_after


def spelling_variants(docs: DataFrame, rules: Spelling = Spelling(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the documents.

    Words are runs of letters from A to Z and from U+00C0 to U+00FF, A-Z lower-cased, after the noise of `Spelling`. Two
    are near if one insertion, deletion or replacement of a code point turns one into the other. The form of a word is
    its most frequent near word (ties: the first in code-point order) if that is `ratio` times as frequent, else null; the
    root is where forms lead, the word itself if it has none.

    The vocabulary is split by initial states (`initial_states`); a task builds the minimal acceptor of its states' words
    and composes it with the one-edit transducer and itself, so pairs arise once per state and not once per word. It
    returns a row per word, not per pair. An initial state with more than `crowded` words is taken apart by the position
    of the edit and joined, so no state is too large for a task.

    A null id counts as empty; a null text has no words. Equal rows count as often as they occur. No words give no rows.
    Other columns aren't read.
    """
    words, _ = store(vocabulary(docs, rules, id_col, text_col), "spelling-words")
    near, _ = store(near_words(words, words.count(), rules), "spelling-near")
    known = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= rules.ratio * F.col("n"), F.lit(False)))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n"))
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
