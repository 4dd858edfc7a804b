"""Segmentation of one text, as plain functions for Arrow workers.

Positions are character positions here; spans_to_bytes() turns them into byte offsets at the end. A lexicon is a dict
of word to frequency, None for words without frequency information.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import accumulate, count
from operator import add

import numpy as np

from tokenloom.functions import tags
from tokenloom.functions.chars import ALNUM, ENGLISH, NUMBER, NUMERALS, TIME_UNITS

DELIMITERS = "。， \n\t"
_RUN = re.compile(f"{ALNUM}+")
_ATOM = re.compile(f"(?s){ALNUM}+|.")
_NUMBER, _ENGLISH, _NUMERAL = (re.compile(f"{c}+") for c in (NUMBER, ENGLISH, f"[{NUMERALS}]"))


@dataclass
class Lexicon:
    """Words, with what the segmenters look up quickly: the longest word for each first character."""

    words: dict[str, int | None]
    total: int | None = None
    reach: dict[str, int] = field(init=False)
    costs: dict[str, float] = field(init=False)
    turned: Lexicon | None = field(init=False, default=None, repr=False)
    #: The pairs of characters that words have, where they are few; None for all.
    pairs: frozenset | None = field(init=False, default=None, repr=False)

    def __post_init__(self):
        self.reach = {}
        for w in self.words:
            if w:
                self.reach[w[0]] = max(self.reach.get(w[0], 0), len(w))
        if self.total is None:
            self.total = sum(f for f in self.words.values() if f)
        self.costs = {w: cost(f, self.total) for w, f in self.words.items() if f is not None}
        self.single = cost(1, self.total)
        self.start, self.first = beginnings(self.reach)

    def __reduce__(self):
        return Lexicon, (self.words, self.total)  # what the words give is worked out again by each worker

    def reversed(self) -> Lexicon:
        if self.turned is None:
            self.turned = Lexicon({w[::-1]: f for w, f in self.words.items()}, self.total)
        return self.turned


def beginnings(characters) -> tuple[re.Pattern, re.Pattern]:
    """What finds characters that words begin with: outside alnum runs, and all."""
    outside = "".join(c for c in characters if not _RUN.match(c))
    found = lambda x: re.compile(f"[{re.escape(x)}]") if x else re.compile(r"(?!)")
    return found(outside), found("".join(characters))


def byte_offsets(text: str) -> np.ndarray:
    """Byte offset of each character, and the length in bytes at the end."""
    if text.isascii():
        return np.arange(len(text) + 1)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate(([0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))))


def chunks(text: str, split_len: int = 60, max_len: int = 890, delimiters: str = DELIMITERS) -> list[tuple[int, int, bool]]:
    """(start, end, is delimiter) pieces in order. A cut is made at the first delimiter that is split_len bytes or more
    beyond the last one, and without a delimiter once more than max_len bytes have gathered."""
    n = len(text)
    plain = text.isascii()
    off = range(n + 1) if plain else byte_offsets(text).tolist()
    marks = [m.start() for m in re.finditer(f"[{re.escape(delimiters)}]", text)] if delimiters else []
    marks.append(n)
    out, begin, cur, k = [], 0, split_len, 0
    while True:
        i = min(cur, n) if plain else bisect_left(off, cur, 0, n)
        if i >= n:
            break
        k = bisect_left(marks, i, k)
        mark = marks[k]
        hard = off[begin] + max_len + 1 if plain else bisect_right(off, off[begin] + max_len, 0, n)
        hard = max(i, hard)
        at = min(hard, mark)
        if at >= n:
            break
        width = off[at + 1] - off[at]
        if at > begin:
            out.append((begin, at, False))
        if hard <= mark:
            begin = at
        else:
            out.append((at, at + 1, True))
            begin = at + 1
        cur = off[at] + split_len + width
    if begin < n:
        out.append((begin, n, False))
    return out


def forward(text: str, lexicon: Lexicon) -> list[str]:
    """Longest word of two characters or more from the left; else an alnum run or a single character."""
    out, i, n, words, reach = [], 0, len(text), lexicon.words, lexicon.reach
    for m in lexicon.start.finditer(text):
        p = m.start()
        if p < i:
            continue
        j = min(n, p + reach[text[p]])
        while j > p + 1 and text[p:j] not in words:
            j -= 1
        if j > p + 1:
            out += _ATOM.findall(text, i, p)
            out.append(text[p:j])
            i = j
    return out + _ATOM.findall(text, i) if i else _ATOM.findall(text)


def backward(text: str, backwards: Lexicon) -> list[str]:
    """The same from the right; backwards is the reversed lexicon."""
    return [w[::-1] for w in reversed(forward(text[::-1], backwards))]


def full(text: str, lexicon: Lexicon) -> list[tuple[int, int]]:
    """Every word of two characters or more from every start, runs, and single characters that the last hit does not cover."""
    out, i, n, last = [], 0, len(text), -1
    words, reach = lexicon.words, lexicon.reach
    while i < n:
        if m := _RUN.match(text, i):
            out.append((i, m.end()))
            i = m.end()
            continue
        for j in range(i + 2, min(n, i + reach.get(text[i], 0)) + 1):
            if text[i:j] in words:
                out.append((i, j))
                last = j
        if last <= i:
            out.append((i, i + 1))
        i += 1
    return out


def lattice(text: str, lexicon: Lexicon) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Atom positions, and edges (i, j, frequency) between them in order."""
    at = [m.start() for m in _ATOM.finditer(text)]
    at.append(len(text))
    words, reach, edges, n = lexicon.words, lexicon.reach, [], len(at) - 1
    for i in range(n):
        longest = reach.get(text[at[i]], 0)
        single = words.get(text[at[i] : at[i + 1]])
        edges.append((i, i + 1, 1 if single is None else single))
        for j in range(i + 2, n + 1):
            if at[j] - at[i] > longest:
                break
            if (f := words.get(text[at[i] : at[j]])) is not None:
                edges.append((i, j, f))
    return at, edges


#: Costs are multiples of 1 / GRID, so that sums of them are exact, equal paths cost the same in whatever order they are
#: added, and both engines choose alike among them.
GRID = 2.0**36


def rounded(x: float) -> float:
    return math.floor(x * GRID + 0.5) / GRID


def cost(frequency: int, total: int) -> float:
    return rounded(-math.log((frequency + 1) / (total + 1)))


def unigram(text: str, lexicon: Lexicon) -> tuple[list[str], float]:
    """Words of the cheapest path, and its cost; of equal paths the one through the earliest start."""
    atoms = _ATOM.findall(text)
    if not lexicon.first.search(text):
        return atoms, len(atoms) * lexicon.single
    n, costs, single, reach, pairs = len(atoms), lexicon.costs, lexicon.single, lexicon.reach, lexicon.pairs
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for i, atom in enumerate(atoms):
        here = best[i]
        c = here + costs.get(atom, single)
        if c < best[i + 1]:
            best[i + 1], back[i + 1] = c, i
        longest = reach.get(atom[0], 0)
        if longest > len(atom):
            word = atom
            for j in range(i + 1, n):
                if pairs is not None and word[-1] + atoms[j][0] not in pairs:
                    break
                word += atoms[j]
                if len(word) > longest:
                    break
                c = costs.get(word)
                if c is not None and here + c < best[j + 1]:
                    best[j + 1], back[j + 1] = here + c, i
    out, j = [], n
    while j:
        i = back[j]
        out.append(atoms[i] if j == i + 1 else "".join(atoms[i:j]))
        j = i
    return out[::-1], best[n]


def _stops(chain) -> tuple[int, ...]:
    """Where the steps of a chain of (chain before, from, to), single steps from one to the other, end."""
    parts = []
    while chain:
        chain, a, b = chain
        parts.append(range(a + 1, b + 1) if a >= 0 else (b,))
    return tuple(j for part in reversed(parts) for j in part)


def _n_cheapest(text: str, lexicon: Lexicon, n: int) -> tuple[list[int], list[tuple[float, tuple[int, ...]]]]:
    """Atom positions, and (cost, ends of the steps in atoms) of the n cheapest paths. A path is a chain, and atoms that no
    longer word begins or ends at are one link of it; steps are compared only where costs are equal."""
    atoms = _ATOM.findall(text)
    at = [0, *accumulate(map(len, atoms))]
    costs, single, reach, size = lexicon.costs, lexicon.single, lexicon.reach, len(atoms)
    ones, into, begins = [costs.get(a, single) for a in atoms], {}, set()
    for i, atom in enumerate(atoms):
        longest, word = reach.get(atom[0], 0), atom
        for j in range(i + 1, size):
            word += atoms[j]
            if len(word) > longest:
                break
            if (c := costs.get(word)) is not None:
                into.setdefault(j + 1, []).append((i, c))
                begins.add(i)
    stops = sorted({*into, *begins, size} - {0})
    kept, here = {0: [(0.0, None)]}, 0
    for j in stops:
        run = sum(ones[here:j])
        paths = [(c + run, (chain, here, j)) for c, chain in kept[here]] if j > here else kept[here]
        if j in into:
            for i, c in into[j]:
                paths += [(x + c, (chain, -1, j)) for x, chain in kept[i]]
            paths.sort(key=lambda p: p[0])
            if any(paths[k][0] == paths[k + 1][0] for k in range(min(n, len(paths) - 1))):
                paths.sort(key=lambda p: (p[0], _stops(p[1])))
            paths = paths[:n]
        kept[j], here = paths, j
    return at, [(c, _stops(chain)) for c, chain in kept[size]]


def n_best(text: str, lexicon: Lexicon, n: int = 6) -> list[tuple[float, list[tuple[int, int]]]]:
    """The n cheapest paths, cheapest first, then by where they step."""
    at, paths = _n_cheapest(text, lexicon, n)
    return [(x, [(at[a], at[b]) for a, b in zip((0, *p), p)]) for x, p in paths]


def n_best_text(text: str, lexicon: Lexicon, n: int = 6, split_len=60, max_len=890) -> list[tuple[float, list[int]]]:
    """The n cheapest paths of a whole text in chunks as segment() cuts it: (cost, ends of the tokens in characters),
    cheapest first, then by where they step. Delimiters cost nothing. Chunks are independent, so the n cheapest of the
    whole are among the sums of those of its chunks; a path is a chain, so that none is copied from chunk to chunk."""
    state = [(0.0, 0, None)]  # cost, place among the kept paths by their steps, chain
    for a, b, delimiter in chunks(text, split_len, max_len):
        piece = text[a:b]
        if delimiter:
            found = [(0.0, (b,))]
        elif lexicon.first.search(piece):
            at, paths = _n_cheapest(piece, lexicon, n)
            found = [(c, tuple([a + at[j] for j in p])) for c, p in paths]
        else:
            ends = list(accumulate(map(len, _ATOM.findall(piece)), initial=a))[1:]
            found = [(len(ends) * lexicon.single, tuple(ends))]
        if len(found) == 1:  # the same steps after all leave their order
            ((x, steps),) = found
            state = [(c + x, r, (chain, steps)) for c, r, chain in state]
            continue
        grown = sorted(((c + x, r, steps, chain) for c, r, chain in state for x, steps in found), key=lambda g: g[:3])[:n]
        places = {k: r for r, k in enumerate(sorted(range(len(grown)), key=lambda k: grown[k][1:3]))}
        state = [(c, places[k], (chain, steps)) for k, (c, _, steps, chain) in enumerate(grown)]
    out = []
    for c, _, chain in state:
        parts = []
        while chain:
            chain, steps = chain
            parts.append(steps)
        out.append((c, [j for steps in reversed(parts) for j in steps]))
    return out


def number_tag(t: str, following: str | None) -> int:
    """The tag of a token of the number class."""
    n = len(t)
    if n == 11 and t[0] == "1" and "3" <= t[1] <= "8":
        return tags.MP
    if n == 12 and (t[3] == "-" or t[4] == "-"):
        return tags.MP
    if n == 10 and t[4] == t[7] == "-" and t[5] <= "1" and t[8] <= "3":
        return tags.T
    if n == 9 and t[4] == "-" and (t[6] == "-" and t[7] <= "3" or t[7] == "-" and t[5] <= "3"):
        return tags.T
    if n <= 4 and following in TIME_UNITS:
        return tags.T
    return tags.MA


_CLOCK = re.compile(r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?|[0-9]{4}/[01][0-9]/[0-3][0-9]")


def type_of(t: str, following: str | None = None, extended_time: bool = False) -> int:
    """Tag by form, or NONE."""
    if _NUMBER.fullmatch(t):
        return number_tag(t, following)
    if extended_time and _CLOCK.fullmatch(t):
        return tags.T
    if _ENGLISH.fullmatch(t):
        url = len(t) > 5 and (t.startswith(("http:/", "www.", "mail.", "ftp://")) or t.endswith((".com", ".net", ".cn", ".org")))
        return tags.URL if url else tags.NX
    return tags.MC if _NUMERAL.fullmatch(t) else tags.NONE


class _Kinds(dict):
    """Word to tag by form; a number that the next token may turn into a time is LOOK."""

    def __init__(self, extended_time: bool):
        self.extended_time = extended_time

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        kind = type_of(word, None, self.extended_time)
        if kind == tags.MA and number_tag(word, TIME_UNITS[0]) == tags.T:
            kind = LOOK
        self[word] = kind
        return kind


LOOK = -2
_KINDS = {False: _Kinds(False), True: _Kinds(True)}


def mark(words: list[str], spans: list[tuple[int, int]] | None, pos: list[int], compat: bool = False, extended_time: bool = False):
    """(words, spans, tags) typed by form, runs of equal MC or MA merged. Without spans the words tile the text. With
    compat, a merged or moved MC or MA token has the tag of the input token at its new place, as the model
    implementation does."""
    kinds = list(map(_KINDS[extended_time].__getitem__, words))
    distinct = set(kinds)
    if LOOK in distinct:
        for k, x in enumerate(kinds):
            if x == LOOK:
                kinds[k] = tags.T if k + 1 < len(words) and words[k + 1] in TIME_UNITS else tags.MA
        distinct = set(kinds)
    typed = [p if k == tags.NONE else k for k, p in zip(kinds, pos)] if distinct != {tags.NONE} else pos
    if tags.MA not in distinct and tags.MC not in distinct:
        return words, spans, typed
    out_words, out_spans, out_tags, last = [], [], [], None
    for k, (w, p) in enumerate(zip(words, typed)):
        if p == last and p in (tags.MA, tags.MC):
            out_words[-1] = w if spans else out_words[-1] + w
            if spans:
                out_spans[-1] = (out_spans[-1][0], spans[k][1])
        else:
            out_tags.append(typed[len(out_words)] if compat and p in (tags.MA, tags.MC) else p)
            out_words.append(w)
            if spans:
                out_spans.append(spans[k])
        last = p
    return out_words, out_spans if spans else None, out_tags


@dataclass
class HiddenModel:
    """Counts for tagging: of each word by tag, from tag to tag, of each tag, and in all. Costs are worked out once."""

    emissions: dict[str, dict[int, int]]
    moves: dict[tuple[int, int], int]
    sums: dict[int, int]
    total: int
    prior: list[tuple[int, int]]  # (tag, weight) of unknown words
    def __reduce__(self):
        return HiddenModel, (self.emissions, self.moves, self.sums, self.total, self.prior)

    _seen: dict = field(default_factory=dict, repr=False)
    _steps: dict = field(default_factory=dict, repr=False)
    _memory: dict = field(default_factory=dict, repr=False)

    _states: dict = field(default_factory=dict, repr=False)
    _shapes: dict = field(default_factory=dict, repr=False)
    _numbers: count = field(default_factory=count, repr=False)

    def state(self, tags: tuple, costs: tuple) -> tuple:
        """(number, tags, costs), the same one for the same tags and costs as long as it is kept."""
        if (out := self._states.get((tags, costs))) is None:
            if len(self._states) > 100_000:
                self._states.clear()
            out = self._states[tags, costs] = next(self._numbers), tags, costs
        return out

    def candidates(self, word: str):
        """Tags of a word in ascending order, their costs at the start of a text and elsewhere."""
        known = self.emissions.get(word)
        key = word if known else None
        if (out := self._seen.get(key)) is None:
            out = self._seen[key] = self.costs_of(sorted(known.items()) if known else self.prior)
        return out

    def costs_of(self, pairs):
        """Of (tag, count) by tag: the tags, their costs at the start of a text and elsewhere."""
        first = [rounded(-math.log((f + 1) / (self.total + 10))) for _, f in pairs]
        later = [rounded(-math.log((f + 1) / (self.sums.get(t, 0) + 10))) for t, f in pairs]
        out = tuple(t for t, _ in pairs), tuple(first), tuple(later)
        if len(self._shapes) > 100_000:
            self._shapes.clear()
        return self._shapes.setdefault(out, out)  # the same one for the same costs, by which steps are kept

    def steps(self, before: tuple[int, ...], after: tuple[int, ...]) -> list[list[float]]:
        """For each tag after, the costs from each tag before."""
        if (out := self._steps.get((before, after))) is None:
            cost = lambda a, b: rounded(-math.log((self.moves.get((a, b), 0) + 1) / (self.sums.get(a, 0) + 10)))
            out = self._steps[before, after] = [[cost(a, b) for a in before] for b in after]
        return out


def viterbi(words: list[str], model: HiddenModel) -> tuple[list[int], float]:
    """The tag of each word on the cheapest path, and its cost; of equal costs the lower candidate wins."""
    if not words:
        return [], 0.0
    cands = [model.candidates(w) for w in words]
    before, delta, _ = cands[0]
    # costs are kept as what they are above their least one, so that the same step from the same costs is met again and
    # again; on the grid that changes no sum and no tie
    base = min(delta)
    state = model.state(before, tuple([x - base for x in delta]))
    back, memory = [], model._memory
    for cand in cands[1:]:
        if (hit := memory.get(key := (state[0], id(cand)))) is None or hit[3] is not cand:
            _, before, delta = state
            after, _, emit = cand
            row, ptr = [], []
            for costs, e in zip(model.steps(before, after), emit):
                options = list(map(add, costs, delta))
                best = min(options)
                row.append(best + e)
                ptr.append(options.index(best))
            if len(memory) > 100_000:
                memory.clear()
            least = min(row)
            hit = memory[key] = model.state(after, tuple([x - least for x in row])), ptr, least, cand
        state, ptr, least, _ = hit
        base += least
        back.append(ptr)
    delta = state[2]
    best = min(delta)
    k = delta.index(best)
    path = [k]
    for ptr in reversed(back):
        path.append(k := ptr[k])
    path.reverse()
    return [c[0][k] for c, k in zip(cands, path)], base + best


def recognize(tokens: list[tuple[int, int, int]], roles: list[str], kind: int, max_len: int = 100, offsets=None) -> list[tuple[int, int, int]]:
    """Tokens with the role runs B C* D of less than max_len bytes joined, and S tokens, as entities of that kind."""
    at = (lambda x: int(offsets[x])) if offsets is not None else (lambda x: x)
    out, i = [], 0
    while i < len(tokens):
        end = None
        if roles[i] == "B":
            j = i + 1
            while j < len(tokens) and roles[j] == "C":
                j += 1
            if j < len(tokens) and roles[j] == "D" and at(tokens[j][1]) - at(tokens[i][0]) < max_len:
                end = j
        if end is not None:
            out.append((tokens[i][0], tokens[end][1], kind))
            i = end + 1
        else:
            out.append((*tokens[i][:2], kind) if roles[i] == "S" else tokens[i])
            i += 1
    return out


METHODS = ("forward", "backward", "full", "unigram")


def segment(text: str, method: str, lexicon: Lexicon, backwards: Lexicon | None = None, model: HiddenModel | None = None, compat=False, extended_time=False, split_len=60, max_len=890):
    """(words, spans, tags) of a whole text: chunks, segmentation, tags if a model is given, typing. Spans are in
    characters; they are None where the words tile the text, as they do for all methods but full."""
    words: list[str] = []
    pos: list[int] = []
    spans: list[tuple[int, int]] | None = [] if method == "full" else None
    for a, b, delimiter in chunks(text, split_len, max_len):
        piece = text[a:b]
        if delimiter:
            words.append(piece)
            pos.append(tags.W)
            if spans is not None:
                spans.append((a, b))
            continue
        if method == "forward":
            found = forward(piece, lexicon)
        elif method == "backward":
            found = backward(piece, backwards or lexicon.reversed())
        elif method == "full":
            at = full(piece, lexicon)
            found = [piece[i:j] for i, j in at]
            spans += [(a + i, a + j) for i, j in at]
        else:
            found = unigram(piece, lexicon)[0]
        words += found
        pos += viterbi(found, model)[0] if model else [tags.NONE] * len(found)
    words, spans, pos = mark(words, spans, pos, compat, extended_time)
    if spans is not None:
        words = [text[a:b] for a, b in spans]
    return words, spans, pos


def token_bytes(text: str, words: list[str], spans) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the tokens start and end."""
    if spans is None:
        ends = np.cumsum(np.fromiter(map(len, words if text.isascii() else map(str.encode, words)), np.int64, len(words)))
        return np.concatenate(([0], ends[:-1])) if len(words) else ends, ends
    off = byte_offsets(text)
    at = np.array(spans, np.int64).reshape(-1, 2)
    return off[at[:, 0]], off[at[:, 1]]
