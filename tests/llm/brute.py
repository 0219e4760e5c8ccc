"""Plain single-process versions of the training-data operators, for small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def stats(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    twice = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(docs, n=4, percent=85):
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets = {k: shingles(t, n) for k, t in docs.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def without_repeats(docs, window=20):
    """doc_id -> (words, removed words, sha256 of the kept text)."""
    seen, out = set(), {}
    for k in sorted(docs):
        w = WORD.findall(docs[k] or "")
        gone = set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.add(g)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def within_one_edit(a, b):
    """An insertion, a deletion, another letter, or two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < len(b):
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    differ = [i for i in range(len(a)) if a[i] != b[i]]
    return len(differ) <= 1 or (len(differ) == 2 and differ[1] == differ[0] + 1 and a[differ[0]] == b[differ[1]] and a[differ[1]] == b[differ[0]])


def sigmoid(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def toxicity(text, model, seen):
    """Score of one text from a fitted model, word by word against the whole lexicon; ``seen`` keeps what words gave."""
    from tessel.llm import toxicity as tox

    def hit(word):
        if word in model.terms:
            return model.terms[word], 0
        stems = [s for s in model.stems if word.startswith(s)]
        if stems:
            return model.stems[max(stems, key=len)], 1
        near = [t for t in model.terms if len(word) >= 4 and within_one_edit(word, t) and (len(t) >= 5 or (len(t) == 4 and sorted(t) == sorted(word)))]
        return (model.terms[min(near)], 2) if near else None

    words = WORD.findall(text or "")
    sums, strongest, hits, reported = [0.0] * 4, 0.0, 0, 0
    for i, w in enumerate(words):
        bare = w.lower().strip(tox.TRIM)
        if bare not in seen:
            seen[bare] = hit(bare) if bare else None
        if seen[bare]:
            odds, kind = seen[bare]
            inside = tox.quoted(words, i)
            around = words[max(0, i - tox.WINDOW) : i + tox.WINDOW + 1]
            sums[3 if inside else kind] += odds
            reported += inside and any(x.lower().strip(tox.TRIM) in tox.REPORTING for x in around)
            strongest = max(strongest, odds if kind < 2 and not inside else 0.0)
            hits += 1
    x = [*map(math.log1p, sums), strongest, hits / max(1, len(words)), math.log1p(reported)]
    return sigmoid(sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.scale)) + model.bias)


def word_shapes(word, piece=12):
    kinds = ["0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in word]
    s = "".join(k if k in "0Aa" else k * min(3, len(list(run))) for k, run in itertools.groupby(kinds))
    if len(s) <= piece:
        return [s]
    return [p[i : i + piece] for p in re.findall("[0Aa]*[^0Aa]+|[0Aa]+", s) for i in range(0, len(p), piece)]


def quality(text, model, bits=18):
    """Score of one text from a fitted model: its set of hashed n-grams, one by one."""

    def mix(x):
        x = (x ^ x >> 31) * 0x9E3779B97F4A7C15 % 2**64
        return x ^ x >> 29

    words = WORD.findall(text or "")
    h = [(zlib.crc32(p.encode()) + 1) * 2 + (i > 0 and words[i - 1] == w) for i, w in enumerate(words) for p in word_shapes(w)]
    places = set() if h else {0}
    for i in range(len(h)):
        gram = 0
        for k in range(min(3, len(h) - i)):
            gram = mix((gram + h[i + k] + (k << 40)) % 2**64)
            places.add(gram % 2**bits)
    at = np.array(sorted(places))
    ratio, weight = model.ratio[at], model.weights[at]
    m = float(weight @ ratio) / max(1e-9, math.sqrt(float(ratio @ ratio))) + model.bias
    return sigmoid(model.slope * m + model.shift)
