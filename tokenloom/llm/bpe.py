"""Byte-level BPE encoding and decoding over overlapping chunks.

Texts are cut into chunks of CHUNK characters, each with the first OVERLAP characters of what follows. Chunks are
pre-tokenised one by one; two neighbours are stitched at the first pre-token boundary that both have in the overlap,
from where they must agree, since a match depends only on what follows it. Where no boundary resynchronises (a run
longer than the overlap), the text is pre-tokenised again from the last sure boundary. The pieces are then encoded;
decoding concatenates the raw bytes of the ids. The chunks of a text from SPREAD characters on are larger and
pre-tokenised by as many tasks, so that no task waits for one long text; those of others are in one task, without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK, OVERLAP = 1_024, 64
#: Texts of so many characters are spread over tasks, by chunks of so many characters with so long an overlap.
SPREAD, SPREAD_CHUNK, SPREAD_OVERLAP = 262_144, 65_536, 2_048
#: No alternative of the pattern but the unbounded runs looks further ahead than this many characters.
LOOKAHEAD = 4
#: Pieces remembered by a worker; the memory is emptied when full.
REMEMBERED = 100_000


@lru_cache(maxsize=4)
def _tools(vocabulary: str):
    import public_tokenizers
    import regex
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(public_tokenizers.PATTERN), encoding._encode_single_piece, {i: b for b, i in ranks.items()}


class _Remember(dict):
    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, piece):
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = out = self.make(piece)
        return out


@lru_cache(maxsize=4)
def _codec(vocabulary: str):
    """(pieces of a text, ids of a piece, ids of a piece as text, bytes of a piece's ids)."""
    pattern, encode, raw = _tools(vocabulary)
    ids = _Remember(encode)
    return (
        pattern,
        ids,
        _Remember(lambda piece: ",".join(map(str, encode(piece)))),
        _Remember(lambda piece: b"".join([raw[i] for i in encode(piece)])),
    )


def boundaries(text: str, pattern, at: int = 0, end: int | None = None) -> list[int]:
    """Starts of the pre-tokens from at on; with end, no start at or beyond it is looked for."""
    out = []
    for m in pattern.finditer(text, at):
        if end is not None and m.start() >= end:
            break
        out.append(m.start())
    return out


def stitch(cores: list[str], starts: list[list[int]], pattern, overlap: int) -> list[int]:
    """Starts of the pre-tokens of the whole text, from each chunk's core and its own starts (relative to it)."""
    text, offsets = "".join(cores), list(accumulate(map(len, cores), initial=0))
    sure = list(starts[0])
    for i in range(1, len(cores)):
        begin, here = offsets[i], starts[i]
        window = min(len(text), begin + overlap)
        limit = window - LOOKAHEAD if window < len(text) else window
        while sure and sure[-1] > limit:  # what the cut may have made
            sure.pop()
        heads = {begin + s for s in here[: bisect_right(here, overlap)]}
        common = next((j for j in range(bisect_left(sure, begin), len(sure)) if sure[j] in heads), None)
        if common is not None:
            joint = sure[common] - begin
            del sure[common:]
            sure += [begin + s for s in here[bisect_left(here, joint) :]]
        else:  # nothing resynchronised: once more from the last sure boundary, to where this chunk's own window ends
            after = sure.pop() if sure else 0
            reach = min(len(text), offsets[i + 1] + overlap)
            sure += boundaries(text, pattern, after, None if reach == len(text) else reach)
    return sure


def chunked_pieces(text: str, pattern, chunk: int, overlap: int) -> list[str]:
    """Pre-tokens of a text by way of its chunks."""
    if len(text) <= chunk:
        return pattern.findall(text)
    cores = [text[i : i + chunk] for i in range(0, len(text), chunk)]
    starts = [list(accumulate(map(len, pattern.findall(text[i : i + chunk + overlap])[:-1]), initial=0)) for i in range(0, len(text), chunk)]
    at = stitch(cores, starts, pattern, overlap)
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


def _digest(texts, pieces_of, csv, raw):
    for t in texts:
        pieces = pieces_of(t or "")
        ids = ",".join(map(csv.__getitem__, pieces))
        data = hashlib.sha256(b"".join(map(raw.__getitem__, pieces))).hexdigest()
        yield ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), data


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGEST_TYPES = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]


def _columns(kind: str):
    return _DIGEST_TYPES if kind == "digest" else [("ids", pa.list_(pa.int32()))]


def _rows(kind: str, vocabulary: str, texts, pieces_of):
    _, ids, csv, raw = _codec(vocabulary)
    if kind == "digest":
        yield from _digest(texts, pieces_of, csv, raw)
    else:
        for t in texts:
            yield ([i for p in pieces_of(t or "") for i in ids[p]],)


def _encode_whole(kind: str, vocabulary: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _codec(vocabulary)[0]
        find = lambda text: chunked_pieces(text, pattern, chunk, overlap)
        for b in batches:
            rows = list(_rows(kind, vocabulary, (x.as_py() for x in b.column("text")), find))
            cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _columns(kind))] if rows else [pa.array([], t) for _, t in _columns(kind)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *(n for n, _ in _columns(kind))])

    return run


def _chunk_starts(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _codec(vocabulary)[0]
        for b in batches:
            starts = [boundaries(w.as_py(), pattern) for w in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("same"), b.column("doc_id"), b.column("at"), b.column("core"), pa.array(starts, pa.list_(pa.int32()))],
                ["same", "doc_id", "at", "core", "starts"],
            )

    return run


def _stitched(kind: str, vocabulary: str, overlap: int):
    def run(group: pa.Table) -> pa.Table:
        pattern = _codec(vocabulary)[0]
        # equal rows come together: each chunk is there once for each of them
        parts = {at: x for at, *x in zip(*(group[c].to_pylist() for c in ("at", "core", "starts")))}
        equal = group["at"].to_pylist().count(0)
        cores, starts = zip(*(parts[i] for i in sorted(parts)))
        text, at = "".join(cores), stitch(cores, starts, pattern, overlap)
        pieces = [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
        (row,) = _rows(kind, vocabulary, [text], lambda _: pieces)
        doc_ids = pa.array(group["doc_id"].slice(0, 1).to_pylist() * equal, group["doc_id"].type)
        return pa.table([doc_ids, *(pa.array([v] * equal, t) for v, (_, t) in zip(row, _columns(kind)))], ["doc_id", *(n for n, _ in _columns(kind))])

    return run


def bpe_encode(docs: DataFrame, kind: str = "ids", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id with ids array<int>, or for kind "digest" n_tokens, ids_sha256
    and decoded_sha256.

    Each match of the pattern is encoded by itself, without special tokens. Null and empty texts give no ids; the
    digests are then those of nothing. Repeated rows each give a row, null doc_ids are returned as they are, an empty
    table gives no rows, and other columns are ignored. A text of any length is encoded whole; one task stitches it.
    """
    assert chunk > overlap > LOOKAHEAD
    wide, lap = max(chunk, SPREAD_CHUNK), max(overlap, SPREAD_OVERLAP)
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + (DIGEST if kind == "digest" else "ids array<int>")
    docs = docs.select("doc_id", "text")
    whole = F.coalesce(F.char_length("text") < spread, F.lit(True))
    short = docs.where(whole).mapInArrow(_encode_whole(kind, vocabulary, chunk, overlap), out)
    cores = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{wide}}}"), F.lit(0))
    parts = F.transform("cores", lambda c, i: F.struct(c.alias("core"), F.concat(c, F.left(F.coalesce(F.get("cores", i + 1), F.lit("")), F.lit(lap))).alias("text")))
    long = (
        docs.where(~whole)
        .select(F.xxhash64("doc_id", "text").alias("same"), "doc_id", cores.alias("cores"))
        .select("same", "doc_id", F.posexplode(parts).alias("at", "part"))
        .select("same", "doc_id", "at", "part.core", "part.text")
        .repartition("same", "at")
        .mapInArrow(_chunk_starts(vocabulary), f"same long, {out.split(',')[0]}, at int, core string, starts array<int>")
        .groupBy("same", "doc_id")
        .applyInArrow(_stitched(kind, vocabulary, lap), out)
    )
    return short.unionByName(long)


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, data binary: the raw bytes of ids, one after another; null ids give no bytes."""

    def run(batches):
        raw = _tools(vocabulary)[2]
        for b in batches:
            data = [b"".join([raw[i] for i in x.as_py() or ()]) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), "digest")


QUERIES = {"op10_bpe": op10_bpe}
