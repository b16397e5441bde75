"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from math import log10

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text: str | None) -> tuple:
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    count, marked = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i, k in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if count[k] > 1:
            marked |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)


def shingles(text: str | None) -> set:
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """(size of the set, least id of the group) by id."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for k in s:
            where[k].append(i)
    common = Counter((a, b) for v in where.values() for n, a in enumerate(v) for b in v[n + 1 :])
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def leak_words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def leaks(texts: dict, items: list[tuple]) -> dict:
    """(words, hit word numbers, items) by id."""
    windows = defaultdict(set)
    for item, text in items:
        w = leak_words(text)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + 10])].add(str(item))
    out = {}
    for i, text in texts.items():
        w, hit, found = leak_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out[i] = (len(w), hit, sorted(found))
    return out


def base_scores(texts: dict) -> dict:
    """(held out, tokens, known, train tokens, base score) by id."""
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(x for i, w in tokens.items() if not held[i] for x in w)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in tokens.items()}


def template_key(line: str) -> tuple:
    return tuple(None if re.search("[0-9]", w) else w for w in words(line))


def kept_lines(texts: dict, order, similarity: float = 0.75) -> dict:
    """The texts without recurring lines. order gives a line's place among the lines of its leaf."""
    leaf: dict = defaultdict(dict)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if len(k := template_key(x)) >= 3:
                e = leaf[(len(k), k[:3])].setdefault(k, [i, i])
                e[0], e[1] = min(e[0], i), max(e[1], i)
    first = {}
    for v in leaf.values():
        found: list = []
        for k in sorted(v, key=order):
            near = next((ks for centre, ks in found if sum(a == b for a, b in zip(centre, k, strict=True)) >= similarity * len(k)), None)
            if near is not None:
                near.append(k)
            else:
                found.append((k, [k]))
        for _, ks in found:
            lo, hi = min(v[k][0] for k in ks), max(v[k][1] for k in ks)
            if lo < hi:
                first |= dict.fromkeys(ks, lo)
    return {i: t if t is None else "\n".join(x for x in t.split("\n") if not i > first.get(template_key(x), i)) for i, t in texts.items()}
