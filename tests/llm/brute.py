"""Plain versions of the operators, by definition and without regard to cost, for tests on small tables."""

import hashlib
import math
import re

import numpy as np
import xxhash

MASK = (1 << 64) - 1
MIX, KIND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def features(text, bits=18):
    """The distinct numbers of a text's n-grams, one by one."""
    from loomline.llm.quality import shape

    words = [w[i : i + 80] for w in text.split() for i in range(0, len(w), 80)]
    if not words:
        return set()
    h = lambda s: xxhash.xxh64_intdigest(s)
    w, s = [h(x.lower().strip(".,;:!?\"'()")) for x in words], [h("/" + shape(x)) for x in words]
    grams = [*w, *s]
    for i in range(len(words) - 1):
        grams += [(w[i] * MIX + w[i + 1] + KIND) & MASK, (s[i] * MIX + s[i + 1]) & MASK]
    for i in range(len(words) - 2):
        grams.append((((s[i] * MIX + s[i + 1]) & MASK) * MIX + s[i + 2]) & MASK)
    lines = text.count("\n") + 1
    grams += [h(f"len{len(words).bit_length()}"), h(f"line{(len(words) // lines).bit_length()}"), h(f"distinct{len(set(words)) * 8 // len(words)}")]
    return {((g * MIX & MASK) >> 40) & ((1 << bits) - 1) for g in grams}


def score(model, text):
    own = features(text)
    margin = model.bias + (sum(float(model.weights[f]) for f in own) / math.sqrt(len(own)) if own else 0.0)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * margin + model.shift))))


def kept_lines(docs, min_chars=40, min_docs=5):
    """Texts of (doc_id, text) rows without their common lines."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    low = lambda d: (d is not None, d or 0)
    gone = {k: max(own, key=low) for k, own in holders.items() if len(own) >= min_docs}
    return ["\n".join(line for line in (text or "").split("\n") if key(line) not in gone or gone[key(line)] == d) for d, text in docs]


def grams(text, n=5):
    words = re.findall(r"\w+", text.lower()) or text.lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes(texts, similarity=0.8):
    """Of each text the first one that links reach: all pairs."""
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-9:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(texts))]


def topic(text):
    low = text.lower()
    return "licensing" if "licens" in low else "contact" if "@" in text or "http" in low else "tabular" if " | " in text else "code" if "{" in text or " = " in text else "prose"


def mixed(docs, keep=0.7, powers=(0.5, 0.7, 0.8), seed="mix-1"):
    """(weight, probability, selected) of rows (doc_id, text, lang, source), raking cell by cell in dictionaries."""
    cell = [(s or "", lang or "", topic(t or "")) for _, t, lang, s in docs]
    tokens = [len(re.findall(r"\S+", t or "")) for _, t, _, _ in docs]
    held = {}
    for c, n in zip(cell, tokens):
        held[c] = held.get(c, 0.0) + n
    total = sum(held.values())
    mass, targets = {c: n / total for c, n in held.items()}, []
    for k, power in enumerate(powers):
        sums = {}
        for c, n in held.items():
            sums[c[k]] = sums.get(c[k], 0.0) + n
        raised = {x: n**power if n > 0 else 0.0 for x, n in sums.items()}
        targets.append({x: v / sum(raised.values()) for x, v in raised.items()})
    for _ in range(400):
        for k, target in enumerate(targets):
            now = {}
            for c, m in mass.items():
                now[c[k]] = now.get(c[k], 0.0) + m
            mass = {c: m * (target[c[k]] / now[c[k]] if now[c[k]] > 0 else 1.0) for c, m in mass.items()}
    weight = {c: mass[c] * total / n if n > 0 else 0.0 for c, n in held.items()}
    low, high = 0.0, 1e9
    for _ in range(300):
        s = (low + high) / 2
        low, high = (s, high) if sum(min(1.0, s * weight[c]) * n for c, n in held.items()) < keep * total else (low, s)
    unit = lambda d: int(hashlib.md5(f"{seed}|{'' if d is None else d}".encode()).hexdigest()[:13], 16) / 2**52
    p = {c: min(1.0, high * w) for c, w in weight.items()}
    return [(weight[c], p[c], unit(d) < p[c]) for c, (d, *_) in zip(cell, docs)]


def is_optimal(rows, labels, weights, bias, dim, c=1.0, smooth=1.0):
    """How far (w, b) is from the one point where w and b are what the hinge losses at (w, b) make of the rows."""
    y = np.where(labels == 1, 1.0, -1.0)
    n = [int((labels == k).sum()) for k in (0, 1)]
    counts = [np.full(dim, smooth), np.full(dim, smooth)]
    for r, k in zip(rows, labels):
        counts[k][r] += 1
    ratio = np.log(counts[1] / (n[1] + 2 * smooth)) - np.log(counts[0] / (n[0] + 2 * smooth))
    x = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(len(r))
    w = np.divide(weights, ratio, out=np.zeros(dim), where=ratio != 0)
    cost = np.where(y > 0, len(rows) / (2 * n[1]), len(rows) / (2 * n[0])) * c
    a = 2 * cost * np.maximum(0, 1 - y * (x @ w + bias))
    return max(np.abs(x.T @ (a * y) - w)[ratio != 0].max(), abs((a * y).sum() - bias))
