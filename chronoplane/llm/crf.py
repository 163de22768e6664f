"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.dom import Block, blocks

#: Pages whose html a task turns to objects at once.
PAGES_AT_ONCE = 64


def block_features(page: list[Block]) -> list[set[str]]:
    """Observation features of each block: ancestors' tags and names, own tag, text, and place relative to the main container."""
    container = next((m for m in ("in:article", "in:main", "named:main") if any(m in b.marks for b in page)), None)
    out = []
    for i, b in enumerate(page):
        n = b.text.count(" ") + 1
        found = set(b.marks)
        found.add(f"tag:{b.tag}" if b.tag in ("p", "h1", "h2", "h3", "h4", "li", "td", "div", "pre", "blockquote", "figcaption", "dt", "dd") else "tag:other")
        found.add("words:1-3" if n < 4 else "words:4-9" if n < 10 else "words:10-29" if n < 30 else "words:30")
        found.add("linked" if b.linked > 0.5 else "some links" if b.linked > 0.1 else "no links")
        found.add("sentence" if b.text[-1] in ".!?…\"'”»:。" else "no sentence")
        if "©" in b.text or "(c)" in b.text[:4]:
            found.add("copyright")
        if any(m.startswith("named:") and m != "named:main" for m in b.marks):
            found.add("named otherwise")
        found.add("no container" if container is None else "inside" if container in b.marks else "outside")
        found.add("first" if not i else "last" if i == len(page) - 1 else "between")
        out.append(found)
    return out


@dataclass(frozen=True)
class Crf:
    """Weights: of each feature for the label main; of label pairs, for neighbours in one parent and in different ones."""

    weights: dict[str, float]
    pairs: tuple[tuple[tuple[float, float], tuple[float, float]], ...]
    start: tuple[float, float]

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not page:
            return []
        weight, back = self.weights.get, []
        scores = [sum(weight(f, 0.0) for f in found) for found in block_features(page)]
        a, b = self.start[0], self.start[1] + scores[0]
        for i in range(1, len(page)):
            t = self.pairs[page[i].parent == page[i - 1].parent]
            a0, a1, b0, b1 = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
            back.append((a1 > a0, b1 > b0))
            a, b = max(a0, a1), max(b0, b1) + scores[i]
        label, out = b > a, []
        for step in reversed(back):
            out.append(label)
            label = step[label]
        return [*out, label][::-1]


def train(pages: list[list[Block]], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood with a ridge: forward-backward over all pages at once, steps by Adam."""
    pages = [p for p in pages if p]
    if not pages:
        raise ValueError("there are no labelled pages to train on")
    found = [block_features(p) for p in pages]
    names = sorted({f for page in found for block in page for f in block})
    place = {f: i for i, f in enumerate(names)}
    size, longest = len(pages), max(map(len, pages))
    x = np.zeros((size, longest, len(names)), np.float32)
    y, mask, same = np.zeros((size, longest), int), np.zeros((size, longest), bool), np.zeros((size, longest), int)
    for i, (page, feats) in enumerate(zip(pages, found, strict=True)):
        for j, (block, own) in enumerate(zip(page, feats, strict=True)):
            x[i, j, [place[f] for f in own]] = 1
            y[i, j], mask[i, j] = block.main, True
            same[i, j] = j > 0 and block.parent == page[j - 1].parent
    k = len(names)
    theta, m, v = np.zeros(k + 10), np.zeros(k + 10), np.zeros(k + 10)
    rows = np.arange(size)
    lengths = mask.sum(1)
    total = lengths.sum()

    def add(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    for step in range(1, rounds + 1):
        w, pairs, start = theta[:k], theta[k : k + 8].reshape(2, 2, 2), theta[k + 8 :]
        unary = np.zeros((size, longest, 2))
        unary[:, :, 1] = x @ w
        ahead, behind = np.zeros((size, longest, 2)), np.zeros((size, longest, 2))
        ahead[:, 0] = start + unary[:, 0]
        for j in range(1, longest):
            new = add(ahead[:, j - 1, :, None] + pairs[same[:, j]], 1) + unary[:, j]
            ahead[:, j] = np.where(mask[:, j, None], new, ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = add((unary[:, j + 1] + behind[:, j + 1])[:, None, :] + pairs[same[:, j + 1]], 2)
            behind[:, j] = np.where(mask[:, j + 1, None], new, 0)
        norm = add(ahead[rows, lengths - 1], 1)
        single = np.exp(ahead + behind - norm[:, None, None]) * mask[:, :, None]
        slope = np.zeros_like(theta)
        slope[:k] = np.einsum("ijk,ij->k", x, (y - single[:, :, 1]) * mask)
        for j in range(1, longest):
            live = mask[:, j]
            both = np.exp(ahead[live, j - 1, :, None] + pairs[same[live, j]] + (unary[live, j] + behind[live, j])[:, None, :] - norm[live, None, None])
            for s in (0, 1):
                pick = same[live, j] == s
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[live, j - 1][pick], y[live, j][pick]), 1)
                slope[k + 4 * s : k + 4 * s + 4] += (seen - both[pick].sum(0)).ravel()
        slope[k + 8 :] = np.bincount(y[:, 0], minlength=2) - single[:, 0].sum(0)
        slope = slope / total - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    pairs = theta[k : k + 8].reshape(2, 2, 2).tolist()
    return Crf(dict(zip(names, theta[:k].tolist(), strict=True)), tuple(tuple(map(tuple, p)) for p in pairs), tuple(theta[k + 8 :].tolist()))


def labelled_pages(count: int = 400, seed: int = 3) -> list[str]:
    """`count` pages in many layouts; elements with the attribute data-main hold the main text.

    Zones (menus, headers, footers, sidebars, notices, adverts, forms, comments) and the article's container vary in tags,
    names, order and length; texts are invented words. Pages labelled by hand can take their place.
    """
    rng = random.Random(seed)
    syllables = "al be con de er fi ga ho in ja ko lu me no or pa qui re sa ti un ve wo xi ya zu".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a, b: words(a, b).capitalize() + rng.choice(["."] * 6 + ["!", "?"])
    named = lambda tag, names: f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice(names.split())}">' if rng.random() < 0.75 or tag == "div" else f"<{tag}>"

    def zone(tags: str, names: str, inner: str) -> str:
        tag = rng.choice(tags.split())
        return f"{named(tag, names)}{inner}</{tag}>"

    links = lambda a, b, size=3: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, size)}</a></li>' for _ in range(rng.randint(a, b))) + "</ul>"
    para = lambda: f"<p>{' '.join(sentence(3, 18) for _ in range(rng.randint(1, 6)))}</p>"

    def broken() -> str:
        return f"<p><b>{sentence(2, 9)}<br><p>{sentence(4, 20)}</p>"

    def main() -> str:
        parts = [f"<h1>{words(2, 10)}</h1>"] * (rng.random() < 0.85)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = rng.random()
            parts.append(para() if kind < 0.7 else broken() if kind < 0.78 else f"<h2>{words(1, 6)}</h2>" if kind < 0.85 else f"<p>{words(1, 3)}</p>" if kind < 0.9 else f"<ul>{''.join(f'<li>{sentence(2, 12)}</li>' for _ in range(rng.randint(2, 5)))}</ul>" if kind < 0.95 else f"<blockquote>{sentence(4, 20)}</blockquote>")
        body = f"<div data-main>{''.join(parts)}</div>" if rng.random() < 0.2 else "".join(parts)
        inner = ""
        if rng.random() < 0.25:
            inner += zone("div p", "byline meta author date", words(2, 5))
        if rng.random() < 0.15:
            inner += zone("div aside", "ad related promo", sentence(4, 12))
        tag, names = rng.choice([("article", "post entry story"), ("article", "article"), ("main", "content"), ("div", "content article post-body entry-content story-text main"), ("section", "article content"), ("td", "content main")])
        opened = named(tag, names)
        whole = f"{opened[:-1]} data-main>{body}</{tag}>" if not inner else f"{opened}{inner}<div data-main>{body}</div></{tag}>"
        return f"<table><tr>{whole}</tr></table>" if tag == "td" else whole

    def comments() -> str:
        one = lambda: f'<{(t := rng.choice(["li", "div", "p"]))} class="{rng.choice(["comment", "reply", "comment-body"])}">{words(1, 2)}: {" ".join(sentence(3, 15) for _ in range(rng.randint(1, 3)))}</{t}>'
        return zone("section div", "comments discussion replies responses", f"<h3>{words(1, 2)}</h3>" + "".join(one() for _ in range(rng.randint(1, 6))))

    out = []
    for _ in range(count):
        before, after = [], []
        if rng.random() < 0.6:
            before.append(zone("header div", "header masthead topbar", f"<div>{words(1, 3)}</div>" + links(0, 4)))
        if rng.random() < 0.85:
            before.append(zone("nav nav div ul", "menu nav navigation breadcrumbs", links(2, 9)))
        if rng.random() < 0.35:
            rng.choice([before, after]).append(zone("div div section", "cookie-notice consent alert popup notice", f"<p>{sentence(5, 22)}</p><button>{word()}</button>"))
        if rng.random() < 0.6:
            rng.choice([before, after]).append(zone("div div aside", "ad ads banner sponsored advert promo", sentence(3, 16)))
        if rng.random() < 0.3:
            rng.choice([before, after]).append(f"<form>{words(1, 4)} <label>{word()}</label><input><button>{word()}</button></form>")
        if rng.random() < 0.5:
            rng.choice([before, after]).append(zone("aside aside div", "sidebar widget related trending", f"<h3>{words(1, 3)}</h3>" + (links(2, 7, 7) if rng.random() < 0.6 else para())))
        if rng.random() < 0.4:
            after.append(comments())
        if rng.random() < 0.3:
            after.append(zone("div ul", "share social follow", f"<a href='#'>{word()}</a> <a href='#'>{word()}</a>"))
        if rng.random() < 0.9:
            after.append(zone("footer footer div", "footer copyright legal", f"{rng.choice(['&copy; ', '&copy; ', ''])}{word()}.example &middot; {sentence(2, 12)}"))
        rng.shuffle(before)
        foot = after[-1:] if rng.random() < 0.9 else []
        rest = after[: len(after) - len(foot)]
        rng.shuffle(rest)
        out.append(f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{main()}{''.join(rest)}{''.join(foot)}" + "</body></html>" * (rng.random() < 0.9))
    return out


def train_on(pages: list[str], most: int = 2_000) -> Crf:
    """Trains on labelled pages, the first `most` of them."""
    return train([blocks(p) for p in pages[:most]])


def extract(pages: DataFrame, model: Crf, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each whole page, its blocks in page order joined by two line feeds.

    Every page is parsed and decoded on its own where it lies; nothing is shuffled. Null and empty pages, and pages
    without a main block, have an empty text. Null ids and urls stay. Equal rows give equal results. No rows give no
    rows. Other columns aren't read.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                part, texts = batch.slice(start, PAGES_AT_ONCE), []
                for html in part.column(2):
                    page = blocks(html.as_py())
                    texts.append("\n\n".join(b.text for b, main in zip(page, model.decode(page), strict=True) if main))
                sizes = pa.array(map(len, texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
