"""The operators once more in plain Python, without Spark, blocks or indexes."""

import hashlib
import math
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import xxhash

from tessella.llm import bpe, decontaminate, paragraphs, quality, secrets
from tessella.llm.words import M1, Words, mix

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def secret_spans(text, model):
    """(start, kind, end) of base spans, and of all."""
    t = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    base += [(m.start(), k, m.end()) for k, p, n in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)) for m in re.finditer(p, t) if len(m[0]) >= n]
    more = []
    for m in re.finditer(secrets.CANDIDATE, t):
        whole = [(0, len(m[0]))] if secrets.ratio(m[0], model) > secrets.MARGIN else secrets.stretches(m[0], model)
        more += [(m.start() + a, 3, m.start() + b) for a, b in whole]
    return sorted(base), sorted(base + [x for x in more if not any(s <= x[0] and x[2] <= e for s, _, e in base)])


def redacted(text, spans):
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def quality_draws(docs, labels):
    """doc_id -> (log weight, draw less its noise), and the number taken; ``labels`` have one row a document."""
    known = {i: int(q == 1 and t == 0) for i, q, t in labels}
    grams = {}
    for i, text in docs:
        h = [int(x) for x in Words(quality.pa.array([text])).hashes]
        two = mix(np.array([(a * int(M1) + b) % 2**64 for a, b in zip([0, *h], h)], np.uint64))
        grams[i] = [x % quality.BUCKETS for x in h], [int(x) % quality.BUCKETS for x in two]
    return known, grams


def log_weights(grams, target):
    """Of each document the log-likelihood ratio of the model of ``target`` documents over that of all."""
    raw = [Counter(), Counter()]
    good = [Counter(), Counter()]
    for i, both in grams.items():
        for k in (0, 1):
            raw[k].update(both[k])
            if i in target:
                good[k].update(both[k])
    share = sum(good[0].values()) / max(sum(raw[0].values()), 1)
    one = lambda k, x: math.log((good[k][x] + quality.PRIORS[k]) / (raw[k][x] * share + quality.PRIORS[k]))
    return {i: sum(one(k, x) for k in (0, 1) for x in both[k]) for i, both in grams.items()}


def alignments(docs, bench):
    """(doc_id, item_id) -> (score, first, last) by aligning every text with every item."""
    fold = lambda t: re.sub(r"[^\w\s]|_", " ", t.lower(), flags=re.A if t.isascii() else 0).split()
    out = {}
    items = [(i, fold(t)) for i, t in bench]
    for d, t in docs:
        words = fold(t)
        for i, item in items:
            number = {x: n for n, x in enumerate(dict.fromkeys(item))}
            s, f, e = decontaminate.smith_waterman([number[x] for x in item], [number.get(x, -1) for x in words])
            if s >= decontaminate.SHARE * decontaminate.MATCH * len(item):
                out[d, i] = s / (decontaminate.MATCH * len(item)), f, e
    return out


def encoding(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def library(name):
    import public_tokenizers

    return bpe._library(public_tokenizers.path(name))


def lines(text):
    """(first, last, words) of the lines with a whole shingle."""
    at = 0
    for line in text.split("\n"):
        words = line.encode().lower().split()
        if len(words) >= paragraphs.LEAST_LINE:
            yield at, at + len(line), words
        at += len(line) + 1


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


class Text(HTMLParser):
    """Visible words of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style", "template", "noscript")
        self.out.append("\n" if tag in ("p", "div", "br", "li", "ul", "h1", "title", "head", "body", "article", "nav", "footer", "html") else "")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style", "template", "noscript") and self.depth > 0
        self.out.append("\n" if tag in ("p", "div", "li", "ul", "h1", "title", "head", "body", "article", "nav", "footer", "html") else "")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)
