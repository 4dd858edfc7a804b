"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "er"]) for _ in range(n))


def rows(seed: int = 1):
    rng = random.Random(seed)
    base = sentence(rng, 120)
    cut = base.split()
    near = " ".join([*cut[:60], "changed", *cut[61:]])
    out = [(i, "\n".join(sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(1, 6)))) for i in range(20)]
    out += [(30, base), (31, base), (32, near), (33, base.upper()), (34, "  " + base.replace(" ", "\n")), (20, None), (21, ""), (22, " \t\n"), (23, "one two"), (24, "Two words"), (25, "two words")]
    out += [(26, "x" * 9000 + " y"), (27, "日本語 テキスト é à ü " * 40), (None, "a row without id, of some length, that is like no other"), (5, out[5][1])]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, same string, n long, w string, at int, __same string, h long, node string"


def documents(spark, seed: int = 1):
    data = [(i, t, ("en", None, "xx", "de")[k % 4] if k > 8 else "en", ("a", "A", None, "b.example.com")[k % 4], len(t or ""), k, "s", 1, "w", 2, "x", 3, "y") for k, (i, t) in enumerate(rows(seed))]
    return spark.createDataFrame(data, SCHEMA)
