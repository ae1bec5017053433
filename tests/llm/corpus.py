"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words(text)
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def near_classes(texts, least=0.8):
    """Least index of each text's component, and its number of links."""
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], links


def repeated_words(texts, n):
    """For each text the places of the words inside windows that occur elsewhere."""
    seen = Counter()
    split = [words(t) for t in texts]
    for w in split:
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone |= set(range(i, i + n))
        out.append(gone)
    return split, out


def removal_row(w, gone):
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def base_measures(text):
    w = words(text)
    gone = repeated_words([text], 8)[1][0]
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(gone) > 30 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(gone), failed
