"""Quality rules from compression bands.

A text that zstandard shrinks far more than texts of its length do is repetitive; one that it hardly shrinks is noise.
Short texts have little to refer back to and shrink less, so the limits depend on the length. Besides the whole text,
fixed chunks of CHUNK bytes are compressed one by one: a text is rejected when more than BAD_CHUNKS of its bytes lie in
chunks outside the band for a chunk's length, which finds a bad half that the whole text's ratio hides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm.common import SPACES, table

CHUNK = 4096
BAD_CHUNKS = 0.5
LEVEL = 3
#: (from this many bytes, least ratio, greatest ratio) of compressed to original bytes at LEVEL. From 2,048 bytes on the least
#: ratios are 0.95 of the lowest hundredth that labelled good prose has at the length (labels of sf0.1, 3,330 texts), below
#: that lower, as short texts of few words vary more; the greatest leave room for scripts of several bytes a letter. Below
#: 64 bytes the format's own overhead decides, so that only the least ratio counts.
BANDS = (
    (0, 0.70, 9.9), (64, 0.65, 1.40), (128, 0.54, 1.15), (256, 0.50, 0.95), (512, 0.46, 0.90), (1024, 0.45, 0.85), (2048, 0.435, 0.80), (4096, 0.41, 0.75), (8192, 0.395, 0.72),
    (16_384, 0.385, 0.70), (65_536, 0.36, 0.65),
)
SYMBOLS = "#*$%&|<>"
#: The base rule: at least so many words, and at most so many in 100 in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

FIELDS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"),
    ("ratio", "double"), ("bad_chunk_share", "double"), ("verdict", "string"),
]
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    kinds, keys = len(number), ids[:n]
    if kinds == len(words):
        return 0
    for k in range(1, window):  # exact: keys are renumbered whenever the next word's number might not fit
        if (int(keys.max()) + 1) * kinds >= 1 << 62:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * kinds + ids[k : n + k]
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()  # for bytes, the six ASCII spaces
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line in seen:
            lines += bool(line.strip(SPACES))
        seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), lines, repeated_words(words)


def band(n: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if n >= least)


def compression(data: bytes, compress, chunk: int = CHUNK) -> tuple[float | None, float, str]:
    """Ratio of the whole, share of bytes in chunks outside their band, and the verdict."""
    n = len(data)
    if not n:
        return None, 0.0, "empty"
    ratio = len(compress(data)) / n
    low, high = band(n)
    bad = 0
    if n > chunk:
        for at in range(0, n, chunk):
            part = data[at : at + chunk]
            least, most = band(len(part))
            bad += 0 if least <= len(compress(part)) / len(part) <= most else len(part)
    verdict = "repetitive" if ratio < low else "incompressible" if ratio > high else "bad chunks" if bad > BAD_CHUNKS * n else "ok"
    return ratio, bad / n, verdict


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for b in batches:
        rows = []
        for x in b.column("text"):
            text = x.as_py()
            n, chars, symbols, lines, repeats = base_counts(text)
            ratio, bad, verdict = compression((text or "").encode(), compress)
            failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
            rows.append((n, chars, symbols, lines, repeats, failed, not failed and verdict == "ok", ratio, bad, verdict))
        cols = [pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(FIELDS)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *(n for n, _ in FIELDS)])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): the base rule's counts, base_failed, kept, ratio, bad_chunk_share, verdict.

    Null texts have no words, like empty ones: they fail the base rule, their ratio is null and their verdict "empty".
    Repeated rows each give a row, null doc_ids are returned, an empty table gives no rows, other columns are ignored.
    """
    fields = ", ".join(f"{n} {t}" for n, t in [("doc_id", docs.schema["doc_id"].dataType.simpleString()), *FIELDS])
    return docs.select("doc_id", "text").mapInArrow(_measure, fields)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op4_quality_rules": op4_quality_rules}
