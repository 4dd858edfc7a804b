"""A slow model of the segmentation rules, straight from their wording, to compare the library with."""

from __future__ import annotations

import math

ALNUM = set("#%&+-./0123456789:=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ\\_abcdefghijklmnopqrstuvwxyz")


def run_end(text, i):
    while i < len(text) and text[i] in ALNUM:
        i += 1
    return i


def forward(text, words):
    out, i = [], 0
    while i < len(text):
        j = run_end(text, i)
        if j == i:
            j = max((k for k in range(i + 2, len(text) + 1) if text[i:k] in words), default=i + 1)
        out.append((i, j))
        i = j
    return out


def backward(text, words):
    n = len(text)
    return [(n - b, n - a) for a, b in forward(text[::-1], {w[::-1] for w in words})][::-1]


def full(text, words):
    out, i, last = [], 0, -1
    while i < len(text):
        j = run_end(text, i)
        if j > i:
            out.append((i, j))
            i = j
            continue
        for k in range(i + 2, len(text) + 1):
            if text[i:k] in words:
                out.append((i, k))
                last = k
        if last <= i:
            out.append((i, i + 1))
        i += 1
    return out


def unigram(text, freq, total):
    at, i = [0], 0
    while i < len(text):
        i = max(run_end(text, i), i + 1)
        at.append(i)
    best = {0: (0.0, None)}
    for a in range(len(at) - 1):
        for b in range(a + 1, len(at)):
            f = freq.get(text[at[a] : at[b]])
            if f is None and b > a + 1:
                continue
            c = best[a][0] - math.log(((1 if f is None else f) + 1) / (total + 1))
            if b not in best or c < best[b][0]:
                best[b] = (c, a)
    out, k = [], len(at) - 1
    while k:
        a = best[k][1]
        out.append((at[a], at[k]))
        k = a
    return out[::-1]


def chunks(text, split_len=60, max_len=890):
    """Each cut by a search for it: the first character from byte `least` on before which more than max_len bytes have
    gathered, or else that is a delimiter, which is then a piece of its own."""
    at = [len(text[:i].encode()) for i in range(len(text) + 1)]
    too_long = lambda i: at[i] - at[start] > max_len
    out, start, least = [], 0, split_len
    while (cut := next((i for i in range(len(text)) if at[i] >= least and (too_long(i) or text[i] in "。， \n\t")), None)) is not None:
        out += [(start, cut, False)] * (cut > start)
        least = at[cut + 1] + split_len
        if too_long(cut):
            start = cut
        else:
            out.append((cut, cut + 1, True))
            start = cut + 1
    return out + [(start, len(text), False)] * (start < len(text))


def viterbi(words, emissions, moves, sums, total, prior):
    """Cheapest tags by trying all paths; of equal costs the one whose tags, read from the end, come first."""
    paths = [[]]
    for w in words:
        paths = [[*p, x] for p in paths for x in (sorted(emissions.get(w, {}).items()) or prior)]

    def cost(p):
        c = -math.log((p[0][1] + 1) / (total + 10))
        for (a, _), (b, f) in zip(p, p[1:]):
            c += -math.log((moves.get((a, b), 0) + 1) / (sums.get(a, 0) + 10)) - math.log((f + 1) / (sums.get(b, 0) + 10))
        return c

    return min(map(cost, paths))
