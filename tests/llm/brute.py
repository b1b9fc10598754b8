"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def rules(text):
    w, text = words(text), text or ""
    lines = [line for line in text.split("\n") if words(line)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def repeats(docs):
    """docs: (id, text) rows. For each row: bytes, removed bytes, spans, SHA-256 of the rest."""
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(b[p : p + 400] for b in data for p in range(len(b) - 399))
    out = []
    for (i, _), b in zip(docs, data, strict=True):
        cover = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                cover[p] += 1
                cover[p + 400] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def judge(url, rule_list, default="allow"):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host, path = (found[1].translate(upper), found[2]) if found else ("", "")
    fits = [
        ((len(h) + len(p), len(h), v), h + p, v)
        for v, h, p in rule_list
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(None, None, default))
    return host, path, best[1], best[2]


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_duplicates(docs):
    """docs: (id, text) rows with different ids, in the order of ids. For each: set size and component."""
    sets = [shingles(t) for _, t in docs]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                links.append((i, j))
    part = groups(len(docs), links)
    return [(i, len(s), docs[part[k]][0]) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))]


def line_dedup(docs):
    """docs: (id, text) rows in the order of ids. The texts without lines that match an earlier line."""
    holders, sets, out = defaultdict(list), [], []
    for _, text in docs:
        keep = []
        for line in text.split("\n"):
            own = frozenset(words(line))
            shared = Counter(j for w in own for j in holders[w])
            if not any(5 * c >= 4 * (len(own) + len(sets[j]) - c) for j, c in shared.items()):
                keep.append(line)
            if own:
                for w in own:
                    holders[w].append(len(sets))
                sets.append(own)
        out.append("\n".join(keep))
    return out
