"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def line_dedup(rows, least):
    """{id: (lines, dropped, kept)} of (id, text)."""
    key = lambda line: line.strip(WHITE).translate(LOWER)
    found = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")} if k)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or found[key(x)] < least]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contamination(rows, items, window=10):
    """{id: (words, hit places, items)}."""
    grams: dict = {}
    for name, text in items:
        own = TOKEN.findall((text or "").translate(LOWER))
        for k in range(max(1, len(own) - window + 1) if own else 0):
            grams.setdefault(tuple(own[k : k + window]), set()).add("null" if name is None else str(name))
    out = {}
    for i, text in rows:
        own = TOKEN.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(own) - n + 1):
                if (g := tuple(own[k : k + n])) in grams:
                    hit.update(range(k, k + n))
                    names |= grams[g]
        out[i] = (len(own), hit, sorted(names))
    return out


def decontaminated(text, hit):
    """The text without each run of hit words and what stands between them."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, last, k = [], 0, 0
    while k < len(at):
        if k in hit:
            end = k
            while end + 1 in hit:
                end += 1
            out.append(text[last : at[k][0]])
            last, k = at[end][1], end
        k += 1
    return "".join([*out, text[last:]])


def counts(text):
    """(words, characters in words, symbols, repeated lines, words in repeated windows)."""
    own = words(text)
    windows = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered)


def shingles(text, k=5):
    own = words((text or "").translate(LOWER))
    return {tuple(own[i : i + k]) for i in range(max(1, len(own) - k + 1))} if own else set()


def components(rows, percent):
    """{id: (shingles, least id reachable)}."""
    sets = {i: shingles(t) for i, t in rows}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        for j, common in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def mix(rows, weights=(5, 2, 1), cap=3.0, seed=8):
    """[(id, size, source size, target, copies)] of (id, text, source); excess is reshared round by round."""
    sizes = [len(words(t)) for _, t, _ in rows]
    total: dict = {}
    for (_, _, source), size in zip(rows, sizes, strict=True):
        total[source] = total.get(source, 0) + size
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, budget, free = dict.fromkeys(order, 0.0), float(sum(sizes)), [s for s in order if total[s]]
    while budget > 1e-9 and free:
        share = budget / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > cap * total[s]]
        if not over:
            for s in free:
                target[s] = share * weight[s]
            break
        for s in over:
            target[s] = cap * total[s]
            budget -= target[s]
            free.remove(s)
    out = []
    for (i, text, source), size in zip(rows, sizes, strict=True):
        key = str(i) if i is not None else hashlib.md5((text or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / (1 << 52)
        rate = target[source] / total[source] if total[source] else 0.0
        out.append((i, size, total[source], target[source], int(rate) + (draw < rate - int(rate))))
    return out


def shards(rows, n=8):
    """[(id, size, shard, slot)] of (id, text): equal texts side by side, cut by bytes."""
    keyed = sorted(((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), i is not None, i or 0, len((t or "").encode()) + 1, i) for i, t in rows), key=lambda x: x[:3])
    total, before, out, seen = sum(x[3] for x in keyed), 0, [], Counter()
    for *_, size, i in keyed:
        shard = before * n // total
        out.append((i, size, shard, seen[shard]))
        seen[shard] += 1
        before += size
    return out
