import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tests import model
from tokenloom.functions import tags
from tokenloom.operators import kernels as k

ALPHABET = "中华人民共和国结婚的尚未é ,。，a1.O二十年"
texts = st.text(ALPHABET, max_size=60)
lexicons = st.dictionaries(st.text(ALPHABET, min_size=1, max_size=5), st.one_of(st.none(), st.integers(0, 50)), max_size=40)


def spans(words):
    out, at = [], 0
    for w in words:
        out.append((at, at + len(w)))
        at += len(w)
    return out


@settings(max_examples=400, deadline=None)
@given(texts, lexicons)
def test_segmenters_equal_the_model(text, words):
    lexicon = k.Lexicon(words)
    assert spans(k.forward(text, lexicon)) == model.forward(text, words)
    assert spans(k.backward(text, lexicon.reversed())) == model.backward(text, words)
    assert k.full(text, lexicon) == model.full(text, words)
    freq = {w: f for w, f in words.items() if f is not None}
    found, cost = k.unigram(text, lexicon)
    assert spans(found) == model.unigram(text, freq, lexicon.total)
    if text:
        best = k.n_best(text, lexicon, 3)
        assert abs(best[0][0] - cost) < 1e-9


def test_chunks_equal_the_model():
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(rng.choice([ALPHABET, "ab", "é中", "x y"])) for _ in range(rng.choice([0, 3, 70, 400, 2500])))
        assert k.chunks(text) == model.chunks(text)
    assert [c for c in k.chunks("x" * 2000) if not c[2]][0] == (0, 891, False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=5), st.integers(0, 10_000))
def test_viterbi_equals_all_paths(words, seed):
    rng = random.Random(seed)
    emissions = {w: {t: rng.randint(0, 9) for t in rng.sample(range(1, 6), rng.randint(1, 3))} for w in "abc"}
    moves = {(a, b): rng.randint(0, 9) for a in range(1, 6) for b in range(1, 6) if rng.random() < 0.6}
    sums = {a: sum(f for (x, _), f in moves.items() if x == a) for a in range(1, 6)}
    prior = [(1, 500), (4, 300)]
    found, cost = k.viterbi(words, k.HiddenModel(emissions, moves, sums, 40, prior))
    assert len(found) == len(words)
    if words:
        assert abs(cost - model.viterbi(words, emissions, moves, sums, 40, prior)) < 1e-9


def test_types():
    cases = {
        "13812345678": tags.MP, "010-12345678": tags.MP, "2015-03-17": tags.T, "2015-3-17": tags.T, "2015-12-1": tags.T, "2015/03/17": tags.NONE, "18:21:19": tags.NONE, "3.14": tags.MA,
        ".": tags.MA, "二十": tags.MC, "http://a.com": tags.URL, "www.sina.com.cn": tags.URL, "www.163.com": tags.NONE, "abc": tags.NX, "C++": tags.NX,
    }
    for word, tag in cases.items():
        assert k.type_of(word) == tag, word
    assert k.type_of("2015", "年") == tags.T and k.type_of("12345", "年") == tags.MA
    assert k.type_of("18:21:19", extended_time=True) == tags.T


def test_merging_and_its_compatible_tags():
    words = ["二", "十", "三", "个", "3", "2015", "年"]
    assert k.mark(words, None, [-1] * 7)[0] == ["二十三", "个", "3", "2015", "年"]
    assert k.mark(words, None, [-1] * 7)[2] == [tags.MC, -1, tags.MA, tags.T, -1]
    assert k.mark(words, None, [-1] * 7, compat=True)[2] == [tags.MC, -1, tags.MC, tags.T, -1]


def test_names():
    tokens = [(0, 1, -1), (1, 2, -1), (2, 3, -1), (3, 4, -1)]
    assert k.recognize(tokens, list("BCDO"), 108) == [(0, 3, 108), (3, 4, -1)]
    assert k.recognize(tokens, list("BBDS"), 108) == [(0, 1, -1), (1, 3, 108), (3, 4, 108)]
    assert k.recognize(tokens, list("BCDO"), 108, max_len=3) == tokens


@settings(max_examples=200, deadline=None)
@given(st.text("中华人民共é ,。a1", max_size=14), st.dictionaries(st.text("中华人民共é1", min_size=1, max_size=3), st.integers(0, 50), max_size=12), st.sampled_from([3, 9, 60]))
def test_n_best_of_a_whole_text_equals_all_paths(text, words, split_len):
    lexicon, paths = k.Lexicon(words), [(0.0, [])]
    for a, b, delimiter in k.chunks(text, split_len, 890):
        at, edges = ([0, b - a], [(0, 1, None)]) if delimiter else k.lattice(text[a:b], lexicon)
        ways = {0: [(0.0, [])]}
        for i, j, f in sorted(edges):
            ways.setdefault(j, []).extend((c + (0.0 if delimiter else k.cost(f, lexicon.total)), [*p, a + at[j]]) for c, p in ways[i])
        paths = [(c + x, [*p, *q]) for c, p in paths for x, q in ways[len(at) - 1]]
    got, all_costs = k.n_best_text(text, lexicon, 6, split_len), {tuple(p): c for c, p in paths}
    assert len({tuple(p) for _, p in got}) == len(got) == min(6, len(paths))
    assert all(abs(c - all_costs[tuple(p)]) < 1e-9 for c, p in got)
    assert all(abs(c - w) < 1e-9 for (c, _), w in zip(got, sorted(all_costs.values())))


def test_n_best_of_a_long_text_and_ties():
    lexicon = k.Lexicon({"中华": 1, "华人": 1, "人民": 1})
    (one, *_), text = k.n_best_text("中华人民。", lexicon), "中华人民。" * 20_000
    got = k.n_best_text(text, lexicon)
    assert len(got) == 6 and one[1] == [2, 4, 5] and got[0][1][-1] == len(text) and got == sorted(got)
    assert k.n_best_text("", lexicon) == [(0.0, [])]


def test_n_best_does_not_walk_atoms_without_words(monkeypatch):
    """Atoms between words are one link of a path, and all that one chunk has to choose leaves the order of the others."""
    text = "。".join(["x y " * 10 + "中国人"] * 30)
    lexicon = k.Lexicon({"中国": 3, "国人": 3, "中国人": 1, "y x": 2})
    joined = k._stops
    links = []

    def counted(chain):
        n, c = 0, chain
        while c:
            n, c = n + 1, c[0]
        links.append(n)
        return joined(chain)

    monkeypatch.setattr(k, "_stops", counted)
    plain = k.Lexicon({"中国": 3, "国人": 3, "中国人": 1})
    at, paths = k._n_cheapest("a b " * 50 + "中国人", plain, 6)
    assert max(links) <= 5 and len(paths[0][1]) > 100
    assert len(k.n_best_text(text, lexicon, 6)) == 6
