"""Plain Python statements of the semantics, used as brute-force checks on small fixtures."""

import itertools
import math
import re

WORD = re.compile("[a-zàáâãäçéêèíïóôõòúûü]+")
TABLE = str.maketrans("áàâãäåéêèëíîìïóôõòöúûùüçñ", "aaaaaaeeeeiiiiooooouuuucn")


def prefix(a, b):
    return len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b))))


def span(lists):
    if len(lists) < 2:
        return 0
    return min(max(c) - min(c) for c in itertools.product(*lists))


def coverage(terms, weights, words):
    kept, mass = [], 0.0
    for term, weight in zip(terms, weights):
        depths = [prefix(term, w) for w in words]
        best = max(depths, default=0)
        if best == len(term) or best >= 3:
            kept.append([i for i, d in enumerate(depths) if d == best])
            mass += weight
    total = sum(weights)
    return (mass / total if total > 0 else len(kept) / len(terms)), span(kept)


def idf(n, df):
    return math.log((n + 1) / df)


def cut_text(text, size):
    """Offsets and texts of the pieces of one text: the longest beginning that ends before a blank, again and again."""
    out, rest = [], text
    while rest:
        short = rest[:size].rpartition(" ")[0]
        taken = rest if len(rest) <= size else short or rest[:size]
        if taken.strip():
            out.append((len(text) - len(rest) + len(taken) - len(taken.lstrip()), taken.strip()))
        rest = rest.removeprefix(taken)
    return out
