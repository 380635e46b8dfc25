"""Plain versions of the operators, one row at a time."""

from __future__ import annotations

import hashlib
import math
import re

ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def entropy_spans(text, classes, allowed, base):
    """Windows counted anew at every place."""
    text = (text or "").replace("\x01", "\x03")
    out = list(base)
    for rank, (_, pattern, width, least) in enumerate(classes, 3):
        for m in re.finditer(pattern, text):
            s = m.group()
            if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or any(re.search(p, s) for p in allowed):
                continue
            if any(a < m.end() and m.start() < b for a, _, b in out):
                continue
            best = max(-sum(c / width * math.log2(c / width) for c in map(s[i : i + width].count, set(s[i : i + width]))) for i in range(len(s) - width + 1))
            if best >= least:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(size, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(docs, size):
    """docs: (doc_id, text)."""
    sets: dict = {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingles(t, size))
    ids = sorted(sets)
    links = []
    holders: dict = {}
    for d in ids:
        for s in sets[d]:
            for x in s:
                holders.setdefault(x, set()).add(d)
    for d in ids:
        for s in sets[d]:
            near = {o for x in s for o in holders[x] if o < d}
            for o in near:
                for t in sets[o]:
                    both = len(s & t)
                    if both and 100 * both >= 80 * (len(s) + len(t) - both):
                        links.append((o, d))
    return components(links, ids)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contamination(docs, items):
    """docs: (doc_id, text), items: (item_id, text): (doc_id, n_words, n_hit, n_items, items_sha256)."""
    windows: dict = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    lengths = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                held = windows.get(tuple(w[a : a + n]))
                if held:
                    hit |= set(range(a, a + n))
                    found |= held
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return out


def dedup_lines(docs, ratio=0.005, least=3):
    """docs: (doc_id, source, text): (doc_id, text)."""
    held = [(s or "", frozenset(x.strip(" ") for x in (t or "").split("\n")) - {""}) for _, s, t in docs]
    pages: dict = {}
    seen: dict = {}
    for s, lines in held:
        pages[s] = pages.get(s, 0) + 1
        for line in lines:
            seen.setdefault((s, line), []).append(lines)
    enough = lambda n, s: n > pages[s] * ratio and n >= max(2, min(least, pages[s]))
    frequent = {k for k, around in seen.items() if enough(len(around), k[0])}
    drop = {(s, x) for s, x in frequent if enough(len({frozenset(y for y in lines if (s, y) not in frequent) for lines in seen[s, x]}), s)}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") == "" or (s or "", x.strip(" ")) not in drop)) for d, s, t in docs]
