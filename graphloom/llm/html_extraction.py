"""HTML extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. Each has a vector: the mean of learned vectors of its tag path's parts (hashed), the
mean of learned vectors of its hashed words, and a few numbers on its length, links and place. A bidirectional LSTM in
numpy reads the sequence, so every block is classified with the whole page as context. It is trained here, on PAGES
generated pages whose blocks are known; the generator composes layouts from names that sites use for their parts.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.html_blocks import Block, Element, blocks
from graphloom.llm.symbols import word_hashes, words

#: Generated pages that the labeller learns from.
PAGES = 900
EPOCHS = 6
PATHS, WORDS, WIDTH, HIDDEN, NUMBERS = 1024, 256, 16, 20, 7

#: Names that sites give to parts of a page, and words in these parts.
MAIN = "content main post entry story article text body page-content post-body entry-content article-body".split()
PARTS = {
    "menu": (("nav", "ul", "div", "div"), "menu nav navbar navigation main-menu top-nav breadcrumb breadcrumbs links tabs pagination pager toc".split(), "Home About Contact News Products Services Blog Archive Sitemap Help Next Previous Login".split()),
    "header": (("header", "div"), "header site-header masthead top banner logo branding topbar".split(), "Welcome to our site Your daily source Official page Search Sign in".split()),
    "footer": (("footer", "div"), "footer site-footer bottom copyright colophon legal footer-links".split(), "Copyright All rights reserved Privacy policy Terms Imprint Contact Powered by".split()),
    "side": (("aside", "div"), "sidebar side aside widget related recommended popular trending recent-posts archive tags tag-cloud more".split(), "Related articles Most read Popular Recent posts You may also like Archives Categories Tags".split()),
    "notice": (("div", "section", "div"), "cookie cookies cookie-notice consent gdpr notice alert banner popup modal overlay message warning announcement paywall".split(), "We use cookies to improve your experience Accept all Decline Settings Dismiss Please enable JavaScript Notice".split()),
    "advert": (("div", "aside", "div", "ins"), "ad ads advert advertisement sponsored sponsor promo promotion banner-ad adsbygoogle ad-slot".split(), "Advertisement Sponsored Buy now Limited offer Sale Save Order today Promoted".split()),
    "form": (("form", "form", "div form"), "form search search-form newsletter subscribe signup login contact-form".split(), "Your name Email address Password Subscribe Sign up Send Search Submit Message Remember me".split()),
    "comments": (("section", "div", "ol", "ul"), "comments comment-list comment responses replies discussion disqus reviews comment-body thread".split(), "Comments Reply says Great post Thanks for sharing I agree Leave a comment Report Like".split()),
    "share": (("div", "ul"), "share social sharing social-links share-buttons follow meta author-box".split(), "Share Tweet Facebook Email Print Follow us Like Pin".split()),
}


def page(rng: random.Random) -> tuple[str, list[bool]]:
    """A generated page and, for each of its blocks in order, whether it is main text."""
    syllables = [rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouéäöü") + rng.choice(["", "n", "r", "s", "t", "ch", "nd", "tion"]) for _ in range(40)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    wrong: list[bool] = []
    bare = rng.random() < 0.5  # parts of the page use ordinary words

    def say(n: int, of: list[str] = ()) -> str:
        out = [rng.choice(of) if of and not bare and rng.random() < 0.7 else word() for _ in range(max(1, n))]
        text = " ".join(out).capitalize()
        if n > 6:
            text = ". ".join(t.strip().capitalize() for t in text.split(" " + out[n // 2] + " ", 1))
        return text + rng.choice([".", ".", "", "!", "?"] if n > 4 else ["", "", "."])

    def put(text: str, main: bool) -> str:
        wrong.append(main)
        return text

    def inline(text: str) -> str:
        if rng.random() < 0.3:
            a, _, b = text.partition(" ")
            t = rng.choice(["b", "i", "em", "strong", "a href='/x'", "span"])
            return f"{a} <{t}>{b}" + ("" if rng.random() < 0.2 and t in "bi" else f"</{t.split()[0]}>")
        return text.replace(" ", rng.choice([" ", "<br>", "\n"]), 1)

    def start(tag: str, names: list[str], likely: float = 0.85) -> str:
        if rng.random() < likely:
            name = " ".join(rng.sample(names, rng.choice([1, 1, 2])))
            return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">'
        return f"<{tag}>"

    def part(kind: str) -> str:
        tags, names, said = PARTS[kind]
        tag = rng.choice(tags).split()[-1]
        out = [start(tag, names, 0.5 if tag in ("nav", "header", "footer", "aside", "form") else 1.0)]
        short = lambda: put(say(rng.randint(1, 4), said), False)
        if kind == "menu" or kind == "share" or (kind in ("footer", "side") and rng.random() < 0.5):
            items = [f"<li><a href='/{word()}'>{short()}</a></li>" for _ in range(rng.randint(2, 8))]
            out.append("".join(items) if tag in ("ul", "ol") else "<ul>" + "".join(items) + "</ul>")
        elif kind == "form":
            out += [f"<label>{put(say(2, said), False)}</label><input name='a'>" if rng.random() < 0.5 else f"<p>{put(say(3, said), False)}</p><input>" for _ in range(rng.randint(1, 3))]
            out.append(f"<div><button>{put(say(1, said), False)}</button></div>")
        elif kind == "comments":
            wrap = "li" if tag in ("ul", "ol") else rng.choice(["div", "article", "div"])
            for _ in range(rng.randint(1, 5)):
                out.append(start(wrap, ["comment", "reply", "comment-body", "review"], 0.6) + f"<p>{put(say(rng.randint(3, 50), said), False)}</p></{wrap}>")
        elif kind in ("side", "footer", "header"):
            if kind == "header" and rng.random() < 0.4:
                out.append(f"<h1>{put(say(rng.randint(1, 4), said), False)}</h1>")
            else:
                out.append(f"<{(h := rng.choice(['h2', 'h3', 'h4', 'p', 'div']))}>{put(say(rng.randint(1, 6), said), False)}</{h}>")
            if rng.random() < 0.6:
                out.append(f"<p>{put(say(rng.randint(3, 25), said), False)}</p>")
        else:
            t = put(say(rng.randint(3, 30), said), False)
            out.append(rng.choice([t, f"<p>{t}</p>", f"<div>{t}</div>", f"<a href='/ad'>{t}</a>"]))
        return "".join(out) + f"</{tag}>"

    def content() -> str:
        roll = rng.random()
        size = rng.choice([2, 6, 12, 30, 60, 120])
        if roll < 0.72:
            return f"<p>{inline(put(say(size), True))}" + ("</p>" if rng.random() < 0.85 else "")
        if roll < 0.82:
            h = rng.choice(["h2", "h3", "h4"])
            return f"<{h}>{put(say(rng.randint(1, 7)), True)}</{h}>"
        if roll < 0.9:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{inline(put(say(rng.randint(1, 25)), True))}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if roll < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{put(say(rng.randint(1, 4)), True)}</td>" for _ in range(2)) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        tag = rng.choice(["blockquote", "pre", "div", "figcaption"])
        return f"<{tag}>{put(say(size), True)}</{tag}>"

    top, foot = [], []
    out = ["<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>"]
    for kind in ("header", "menu", "notice", "advert", "form", "side"):
        if rng.random() < {"menu": 0.85, "header": 0.5, "advert": 0.5}.get(kind, 0.25):
            top.append(kind)
    rng.shuffle(top)
    out += [part(k) for k in top]
    wrap = rng.choice(["article", "article", "article", "main", "div", "div", "section", "main article", "div article", ""]).split()
    for k, tag in enumerate(wrap):
        out.append(start(tag, MAIN, 0.95 if tag in ("div", "section") else 0.3))
    if rng.random() < 0.85:
        title = f"<h1>{put(say(rng.randint(2, 10)), True)}</h1>"
        out.append(f"<header>{title}</header>" if wrap and rng.random() < 0.1 else title)
    for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20])):
        out.append(content())
        if rng.random() < 0.06:
            out.append(part(rng.choice(["advert", "share", "side", "form", "notice"])))
    if rng.random() < 0.25:
        out.append(part(rng.choice(["share", "comments", "side", "form"])))
    if rng.random() < 0.9:
        out += [f"</{t}>" for t in reversed(wrap)]
        for kind in ("comments", "side", "advert", "form", "notice", "footer"):
            if rng.random() < {"footer": 0.85, "comments": 0.35}.get(kind, 0.2):
                foot.append(kind)
        out += [part(k) for k in foot]
        if rng.random() < 0.8:
            out.append("</body></html>")
    return "".join(out), wrong


def bucket(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) % PATHS


def own_parts(label: str) -> list[int]:
    """Hashed parts of an element: its tag and its names."""
    tag, *names = label.split()
    return [bucket(p) for p in (tag, *(f".{n}" for n in names))]


def last_parts(labels: list[str]) -> list[int]:
    """Hashed parts of the last elements of a path: their tags together, and those of the last two with their place."""
    tags = [e.split()[0] for e in labels[-3:]]
    return [bucket(p) for p in ("/".join(tags), *(f"{k}:{t}" for k, t in enumerate(reversed(tags[-2:]))))]


def path_parts(path: tuple[str, ...]) -> list[int]:
    return [*last_parts(list(path)), *(p for e in path for p in own_parts(e))]


class Paths:
    """Mean vectors of paths; a sum is carried along from an element to those inside it, so each element counts once."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.sums: dict[int, tuple[np.ndarray, int]] = {}  # by the element's identity: sum of own parts on the way, and how many
        self.labels: dict[str, tuple[np.ndarray, int]] = {}

    def __call__(self, element: Element | None) -> np.ndarray:
        todo, e = [], element
        while e is not None and id(e) not in self.sums:
            todo.append(e)
            e = e.parent
        total, n = self.sums[id(e)] if e is not None else (np.zeros(self.table.shape[1], np.float32), 0)
        for e in reversed(todo):
            if e.label not in self.labels:
                parts = own_parts(e.label)
                self.labels[e.label] = (self.table[parts].sum(0), len(parts))
            more, k = self.labels[e.label]
            total, n = total + more, n + k
            self.sums[id(e)] = (total, n)
        near: list[str] = []
        e = element
        while e is not None and len(near) < 3:
            near.insert(0, e.label)
            e = e.parent
        last = last_parts(near)
        return (total + self.table[last].sum(0)) / (n + len(last))


def numbers(page_blocks: list[Block]) -> np.ndarray:
    n = len(page_blocks)
    size = np.array([len(b.text) for b in page_blocks], dtype=np.float32)
    out = np.zeros((n, NUMBERS), np.float32)
    out[:, 0] = np.log1p(size) / 5
    out[:, 1] = [b.linked / len(b.text) for b in page_blocks]
    out[:, 2] = np.arange(n) / max(1, n)
    out[:, 3] = [b.text[-1] in ".!?…:;\"'”" for b in page_blocks]
    out[:, 4] = np.log1p(n) / 5
    out[:, 5] = size / max(1.0, float(size.max()))
    out[:, 6] = [b.depth / 10 for b in page_blocks]
    return out


class Labeller:
    """Parameters and passes of the network. Sequences are padded to (time, page)."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = 2 * WIDTH + NUMBERS
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"paths": normal(PATHS, WIDTH, scale=0.1), "words": normal(WORDS, WIDTH, scale=0.1), "out": normal(2 * HIDDEN, scale=0.2), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": normal(d, 4 * HIDDEN, scale=0.2), f"h{way}": normal(HIDDEN, 4 * HIDDEN, scale=0.2), f"c{way}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}

    def scan(self, x: np.ndarray, way: str, keep: bool):
        """Hidden states (time, page, HIDDEN) and, to be kept for training only, what the way back needs."""
        p, (t, b, _) = self.p, x.shape
        pre = x @ p[f"x{way}"] + p[f"c{way}"]
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        states, kept = np.empty((t, b, HIDDEN), np.float32), []
        for k in range(t):
            z = pre[k] + h @ p[f"h{way}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, last = c, h
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            states[k] = h
            if keep:
                kept.append((last, before, i, f, o, g, s))
        return states, kept

    def unscan(self, x: np.ndarray, way: str, kept, d_states: np.ndarray, grad: dict) -> np.ndarray:
        p, (t, b, _) = self.p, x.shape
        dz_all = np.empty((t, b, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        gh = np.zeros_like(p[f"h{way}"])
        for k in range(t - 1, -1, -1):
            last, before, i, f, o, g, s = kept[k]
            dh = dh + d_states[k]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            gh += last.T @ dz
            dh, dc = dz @ p[f"h{way}"].T, dc * f
            dz_all[k] = dz
        flat = dz_all.reshape(t * b, -1)
        grad[f"h{way}"], grad[f"x{way}"], grad[f"c{way}"] = gh, x.reshape(t * b, -1).T @ flat, flat.sum(0)
        return dz_all @ p[f"x{way}"].T

    def logits(self, x: np.ndarray, back: np.ndarray, keep: bool = False):
        """back: for each (time, page) the time it has in the page read from its end; padding stays in place."""
        cols = np.arange(x.shape[1])[None, :]
        forward, kept_f = self.scan(x, "f", keep)
        turned = x[back, cols]
        backward, kept_b = self.scan(turned, "b", keep)
        both = np.concatenate([forward, backward[back, cols]], axis=2)
        return both @ self.p["out"] + self.p["bias"], (turned, kept_f, kept_b, both, cols)


def bags(of: list[list[int]], table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(of), table.shape[1]), np.float32)
    for i, ids in enumerate(of):
        if ids:
            out[i] = table[ids].mean(0)
    return out


def word_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of the texts and n + 1 offsets."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    starts, ends, places = words(data, offsets)
    return ((word_hashes(data, starts, ends, lower=True) >> np.uint64(40)) % np.uint64(WORDS)).astype(np.int64), places


def mean_words(buckets: np.ndarray, places: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Every word counts: each text's histogram of buckets times the table."""
    n = np.diff(places)
    counts = np.bincount(np.repeat(np.arange(len(n)), n) * WORDS + buckets, minlength=len(n) * WORDS).reshape(len(n), WORDS)
    return (counts @ table / np.maximum(n, 1)[:, None]).astype(np.float32)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = max(len(r) for r in rows)
    x = np.zeros((t, len(rows), rows[0].shape[1]), np.float32)
    back = np.repeat(np.arange(t)[:, None], len(rows), axis=1)
    mask = np.zeros((t, len(rows)), bool)
    for b, r in enumerate(rows):
        x[: len(r), b] = r
        back[: len(r), b] = np.arange(len(r))[::-1]
        mask[: len(r), b] = True
    return x, back, mask


@cache
def trained() -> Labeller:
    """The labeller with the parameters above, fitted once in a process."""
    return train()


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    """A labeller fitted to generated pages by Adam."""
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        source, main = page(rng)
        found = blocks(source)
        if len(found) == len(main) and found:
            buckets, places = word_buckets([b.text for b in found])
            data.append(([path_parts(b.path) for b in found], [buckets[a:b].tolist() for a, b in zip(places[:-1], places[1:], strict=True)], numbers(found), np.array(main, np.float32)))
    model = Labeller()
    first, second, step = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2)), None, 0
    first, second = first
    for epoch in range(epochs):
        order = sorted(range(len(data)), key=lambda i: (len(data[i][3]) // 6, rng.random()))
        groups = [order[k : k + 16] for k in range(0, len(order), 16)]
        rng.shuffle(groups)
        for group in groups:
            part = [data[i] for i in group]
            rows = [np.concatenate([bags(a, model.p["paths"]), bags(w, model.p["words"]), n], axis=1) for a, w, n, _ in part]
            x, back, mask = padded(rows)
            z, (turned, kept_f, kept_b, both, cols) = model.logits(x, back, True)
            y = np.zeros(z.shape, np.float32)
            for b, (_, _, _, main) in enumerate(part):
                y[: len(main), b] = main
            d = (1 / (1 + np.exp(-z)) - y) * mask / mask.sum()
            grad = {"out": np.einsum("tb,tbh->h", d, both), "bias": np.array([d.sum()], np.float32)}
            d_both = d[:, :, None] * model.p["out"]
            dx = model.unscan(x, "f", kept_f, d_both[:, :, :HIDDEN], grad)
            dx += model.unscan(turned, "b", kept_b, d_both[back, cols][:, :, HIDDEN:], grad)[back, cols]
            for name, k in (("paths", 0), ("words", 1)):
                g = np.zeros_like(model.p[name])
                for b, row in enumerate(part):
                    for t, ids in enumerate(row[k]):
                        if ids:
                            np.add.at(g, ids, dx[t, b, k * WIDTH : (k + 1) * WIDTH] / len(ids))
                grad[name] = g
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.p[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, which of its blocks are main text."""
    every = [b for p in pages for b in p]
    if not every:
        return [np.zeros(0, bool) for _ in pages]
    path = Paths(model.p["paths"])
    known: dict[int, np.ndarray] = {}
    for b in every:
        if id(b.element) not in known:
            known[id(b.element)] = path(b.element)
    paths = np.array([known[id(b.element)] for b in every])
    said = np.concatenate([mean_words(*word_buckets([b.text for b in every[k : k + 2000]]), model.p["words"]) for k in range(0, len(every), 2000)])
    x = np.concatenate([paths, said, np.concatenate([numbers(p) for p in pages if p])], axis=1).astype(np.float32)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = [i for i in np.argsort(np.diff(offsets), kind="stable") if len(pages[i])]
    k = 0
    while k < len(order):
        group = order[k : k + max(1, min(256, 40_000 // len(pages[order[min(k + 255, len(order) - 1)]])))]
        z, _ = model.logits(*padded([x[offsets[i] : offsets[i + 1]] for i in group])[:2])
        for b, i in enumerate(group):
            out[i] = z[: len(pages[i]), b] > 0
        k += len(group)
    return out


def extract(model: Labeller):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some pages at a time, by their size.
            lo, n = 0, batch.num_rows
            pages = batch.column(2)
            while lo < n:
                hi, size, parsed = lo, 0, []
                while hi < n and size < 4_000_000:
                    source = pages[hi].as_py() or ""
                    size += len(source)
                    parsed.append(blocks(source))
                    hi += 1
                texts = [" ".join(b.text for b, k in zip(p, main, strict=True) if k) for p, main in zip(parsed, label(model, parsed), strict=True)]
                clean = [t.encode("utf-8", "replace").decode() for t in texts]
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(clean, pa.string()), pa.array([len(t) for t in clean], pa.int64()), pa.array([len(p) for p in parsed], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_blocks"])
                lo = hi

    return run


def extract_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars, n_blocks (all blocks of the page).

    text: the main text's blocks in page order, joined by one space; '' for a null or empty page or one without main
    text. Repeated rows get the same result; null ids and urls pass through. No rows in, no rows out; columns other than
    page_id, url and html are ignored.
    """
    model = model or trained()
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(extract(model), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks int")
