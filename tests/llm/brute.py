"""Plain versions of the operators over lists of rows, each with an algorithm of its own."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def repeats(sequences, window):
    """Of (order, sequence of symbols) rows, for each a list of which symbols are covered by windows that start earlier."""
    first, out = {}, {}
    for order, symbols in sorted(sequences, key=lambda x: x[0]):
        gone = [False] * len(symbols)
        for i in range(len(symbols) - window + 1):
            key = tuple(symbols[i : i + window]) if isinstance(symbols, list) else symbols[i : i + window]
            if first.setdefault(key, (order, i)) != (order, i):
                gone[i : i + window] = [True] * window
        out[order] = gone
    return out


def substring_dedup(rows, window=20):
    texts = {d: WORD.findall((t or "").encode()) for d, t in rows}
    gone = repeats(list(texts.items()), window)
    return {d: (len(w), sum(gone[d]), hashlib.sha256(b" ".join(x for x, g in zip(w, gone[d], strict=True) if not g)).hexdigest()) for d, w in texts.items()}


def suffix_dedup(rows, window=100):
    texts = {d: (t or "").encode() for d, t in rows}
    gone, out = repeats(list(texts.items()), window), {}
    for d, raw in texts.items():
        g = gone[d]
        runs = sum(g[i] and (i == 0 or not g[i - 1]) for i in range(len(g)))
        out[d] = (len(raw), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(raw, g, strict=True) if not x)).hexdigest())
    return out


def shingles(text, size):
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_duplicates(rows, size=4, least=80):
    sets = {d: shingles(t, size) for d, t in rows}
    lists, root = {}, {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        met = set()
        for x in s:
            met.update(lists.setdefault(x, []))
            lists[x].append(d)
        for other in met:
            both = len(s & sets[other])
            if 100 * both >= least * (len(s) + len(sets[other]) - both):
                a, b = sorted((find(d), find(other)))
                root[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}
