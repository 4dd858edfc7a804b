"""Segmentation and tagging over DataFrames.

Two engines with one contract. "arrow" runs the kernels in Arrow batches over a lexicon that every worker holds; its
size is checked first. "native" joins candidate spans with the lexicon in Spark, folds the choice per chunk and types and
merges over rows; it has no limit on the lexicon, and tokenize() turns to it beyond the check.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import tags
from tokenloom.functions.chars import ALNUM, atoms
from tokenloom.operators import kernels, packed
from tokenloom.operators import lexicon as lex

TOKENS = "array<struct<start:int,end:int,pos:int,word:string>>"
LexiconTooLarge = lex.LexiconTooLarge
_TOKENS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pos", pa.int32()), ("word", pa.string())]))


@dataclass(frozen=True)
class Options:
    """split_len and max_len: the chunker's bytes. compat: repeat the model implementation's tag shift after merging.
    extended_time: also type clock times and slash dates."""

    split_len: int = 60
    max_len: int = 890
    compat: bool = False
    extended_time: bool = False
    total: int | None = None


#: Bytes of text whose tokens are worked out before they are sent on.
TEXT_AT_ONCE = 1 << 20
#: Bytes of input that a task has at most, as Spark estimates them, and in all up to which one task will do.
SPREAD_BYTES, LEAST_BYTES = 8 << 20, 256 << 10
#: Bytes from which an estimate says nothing.
UNKNOWN_BYTES = 1 << 44


def spread(df: DataFrame) -> DataFrame:
    """df dealt over twice as many tasks as there are cores, or as many more as keep a task small: a file is often one row
    group, and so one task, however large it is."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(2 * cores, -(-size // SPREAD_BYTES))) if LEAST_BYTES < size < UNKNOWN_BYTES else df


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts with at most so many bytes of a text column, or items of a list column, unless one row
    has more: what Python makes of a part does not grow with the batch."""
    held = batch.column(column)
    if not len(held):
        yield batch
        return
    sizes = (pc.binary_length(held) if pa.types.is_string(held.type) or pa.types.is_large_string(held.type) else pc.list_value_length(held)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < len(held):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def load(lexicon: DataFrame, limit: int = lex.BROADCAST_CHARS, total: int | None = None) -> kernels.Lexicon:
    """The lexicon as an object for workers; its size is checked before it is gathered."""
    return kernels.Lexicon({w: f for w, f in lex.gathered(lex.word_frequency(lexicon), limit=limit)}, total)


def known_moves(transitions: DataFrame, ids: dict) -> list:
    """(prev, next, freq) between the tags of ids: as many rows as there are pairs of them, at most."""
    return transitions.where(F.col("prev").isin(*ids) & F.col("next").isin(*ids)).groupBy("prev", "next").agg(F.sum("freq")).collect()


def moves_of(transitions: DataFrame, ids: dict) -> tuple[dict, dict]:
    """Counts by (tag id, next tag id), and by tag id."""
    moves = {(ids[a], ids[b]): f for a, b, f in known_moves(transitions, ids)}
    sums: dict[int, int] = {}
    for (a, _), f in moves.items():
        sums[a] = sums.get(a, 0) + f
    return moves, sums


def hidden_model(lexicon: DataFrame, transitions: DataFrame, corpus_total: int | None = None, prior_tags=("n", "a", "v", "c", "u", "p"), limit: int = lex.BROADCAST_CHARS) -> kernels.HiddenModel:
    """Tagging counts from a lexicon with tags and transitions (prev, next, freq); the size is checked before they are
    gathered. Unknown words get the prior tags, weighted by their share of outgoing transitions."""
    ids = tags.TAG_IDS
    emissions: dict[str, dict[int, int]] = {}
    for w, t, f in lex.gathered(lexicon.where(F.col("tag").isin(*ids)).groupBy("word", "tag").agg(F.sum("freq")), limit=limit):
        emissions.setdefault(w, {})[ids[t]] = f
    moves, sums = moves_of(transitions, ids)
    total = sum(f for e in emissions.values() for f in e.values()) if corpus_total is None else corpus_total
    return kernels.HiddenModel(emissions, moves, sums, total, prior(sums, prior_tags))


def packed_model(lexicon: DataFrame, transitions: DataFrame | None, total: int | None = None):
    """(lexicon, model) for workers, as load() and hidden_model() give them, of a larger lexicon whose rows are distinct by
    word and tag."""
    held = packed.load(lexicon, tags.TAG_IDS, total)
    if transitions is None:
        return held, None
    moves, sums = moves_of(transitions, tags.TAG_IDS)
    return held, packed.PackedModel(held.table, moves, sums, int(np.asarray(held.table.counts).sum()), prior(sums, ("n", "a", "v", "c", "u", "p")))


def prior(sums: dict[int, int], names) -> list[tuple[int, int]]:
    """(tag id, weight) by id: thousandths of (transitions + 1)."""
    ids = sorted(tags.TAG_IDS[t] for t in names)
    whole = sum(sums.get(i, 0) + 1 for i in ids)
    return [(i, (sums.get(i, 0) + 1) * 1000 // whole) for i in ids]


def _digest(begin, end, pos) -> str:
    return hashlib.sha256(np.column_stack([np.asarray(c) for c in (begin, end, pos)]).astype("<i4").tobytes()).hexdigest()


def _run(method: str, held, options: Options, column: str, digest: bool = False):
    """held is a broadcast variable of the lexicon and the model, which is None where there are no tags."""
    sent = held

    def texts(batch):
        held, found_by = sent.value
        backwards = held.reversed() if method == "backward" else None
        for x in batch.column(column):
            text = x.as_py()
            if text is None:
                yield None
                continue
            found, spans, pos = kernels.segment(text, method, held, backwards, found_by, options.compat, options.extended_time, options.split_len, options.max_len)
            yield (*kernels.token_bytes(text, found, spans), pos, found)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, sums = [], []
            for x in texts(b):
                sizes.append(None if x is None else len(x[2]))
                sums.append(None if x is None else _digest(*x[:3]))
            keep = [n for n in b.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], [*keep, "n_tokens", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, column, TEXT_AT_ONCE)):
            ends, starts, stops, kinds, words, valid = [0], [], [], [], [], []
            for x in texts(b):
                valid.append(x is not None)
                if x is not None:
                    begin, end, pos, found = x
                    starts.append(begin)
                    stops.append(end)
                    kinds += pos
                    words += found
                ends.append(len(words))
            starts, stops = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32) for x in (starts, stops))
            structs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(kinds, pa.int32()), pa.array(words, pa.string())], ["start", "end", "pos", "word"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, mask=pa.array([not v for v in valid], pa.bool_()) if valid else None)
            yield pa.RecordBatch.from_arrays([*b.columns, lists.cast(_TOKENS)], [*b.schema.names, "tokens"])

    return digests if digest else run


def _split(df: DataFrame, column: str, method: str, lexicon: DataFrame, options: Options, transitions: DataFrame | None = None, engine: str = "arrow", digest: bool = False) -> DataFrame:
    """engine: arrow, native, or auto, which is arrow unless the lexicon is too large for it."""
    from tokenloom.operators import native

    if engine == "native":
        return native.split(df, column, method, lexicon, options, transitions)
    entries = lexicon.groupBy("word", "tag").agg(F.sum("freq").alias("freq")).persist()  # evaluated once
    try:
        try:
            held = load(entries, total=options.total), None if transitions is None else hidden_model(entries, transitions)
        except lex.LexiconTooLarge:
            if not digest:
                raise
            held = packed_model(entries, transitions, options.total)
    except lex.LexiconTooLarge:
        if not digest and engine != "auto" or df.isStreaming:
            raise
        found = native.split(df, column, method, lexicon, options, transitions)
        return digested(found, column) if digest else found
    finally:
        entries.unpersist()
    run = _run(method, df.sparkSession.sparkContext.broadcast(held), options, column, digest)
    names = [f for f in df.schema.fields if f.name not in (("tokens", "n_tokens", "digest", column) if digest else ("tokens",))]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in names), "n_tokens long, digest string" if digest else f"tokens {TOKENS}"])
    return spread(df.drop("tokens", *(("n_tokens", "digest") if digest else ()))).mapInArrow(run, fields)


def forward_split(df, column, lexicon, options=Options(), engine="arrow"):
    """df with tokens: forward maximum match, typed and merged. Null texts give null tokens."""
    return _split(df, column, "forward", lexicon, options, engine=engine)


def backward_split(df, column, lexicon, options=Options(), engine="arrow"):
    return _split(df, column, "backward", lexicon, options, engine=engine)


def full_split(df, column, lexicon, options=Options(), engine="arrow"):
    return _split(df, column, "full", lexicon, options, engine=engine)


def smart_split(df, column, lexicon, options=Options(), engine="arrow"):
    return _split(df, column, "unigram", lexicon, options, engine=engine)


def tagging(df, column, lexicon, transitions, options=Options(), engine="arrow"):
    """smart_split with a part of speech for each token; forms (numbers, addresses, ...) override it."""
    return _split(df, column, "unigram", lexicon, options, transitions, engine)


#: Methods by name; other names mean full.
BY_NAME = {"FORWARD": "forward", "BACKWARD": "backward", "SMART": "unigram", "TAGGING": "unigram"}


def _by_name(df, method: str, transitions):
    name = method.upper()
    if name == "TAGGING" and transitions is None:
        transitions = df.sparkSession.createDataFrame([], "prev string, next string, freq long")
    return BY_NAME.get(name, "full"), transitions if name == "TAGGING" else None


def tokenize(df, column, lexicon, method: str = "full", transitions: DataFrame | None = None, options=Options(), engine="auto"):
    """By name: FORWARD, BACKWARD, SMART, TAGGING or FULL in any case; unknown names mean FULL. Beyond the size of a lexicon
    that workers may hold, by the native engine."""
    name, moves = _by_name(df, method, transitions)
    return _split(df, column, name, lexicon, options, moves, engine)


def digests(df, column, lexicon, method: str = "full", transitions: DataFrame | None = None, options=Options()):
    """df without the text, with n_tokens and digest: what tokenize gives, as sha256 of (start, end, pos) of all tokens as
    little-endian 32-bit numbers, worked out where the tokens are."""
    name, moves = _by_name(df, method, transitions)
    return _split(df, column, name, lexicon, options, moves, digest=True)


def digested(found: DataFrame, column: str) -> DataFrame:
    """df with tokens as digests() gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [None if x is None else [x[n] for n in ("start", "end", "pos")] for x in b.column("tokens").to_pylist()]
            sizes, sums = [None if x is None else len(x[0]) for x in lists], [None if x is None else _digest(*x) for x in lists]
            keep = [n for n in b.schema.names if n != "tokens"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], [*keep, "n_tokens", "digest"])

    rows = found.drop(column, "n_tokens", "digest").withColumn("tokens", F.when(F.col("tokens").isNotNull(), F.struct(*(F.col(f"tokens.{n}").alias(n) for n in ("start", "end", "pos")))))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "tokens"), "n_tokens long, digest string"])
    return rows.mapInArrow(run, fields)


def explode_tokens(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode("tokens").alias("k", "t")).select(*keep, "k", "t.*")


def token_stream(tokens: DataFrame, *keep: str) -> DataFrame:
    """Rows for a search index: term, start, end, nature, position increment."""
    names = F.create_map(*[F.lit(x) for name, i in tags.TAG_IDS.items() for x in (i, name)])
    return explode_tokens(tokens, *keep).select(
        *keep, "k", F.col("word").alias("term"), "start", "end", F.coalesce(F.try_element_at(names, F.col("pos")), F.lit("word")).alias("nature"), F.lit(1).alias("increment")
    )


def words_of(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["word"])


def java_offsets(tokens: Column) -> Column:
    """Cumulative code-point offsets, right only where tokens tile the text; for compatibility."""
    step = lambda s, t: F.array_append(s, F.struct((F.coalesce(F.try_element_at(s, F.lit(-1))["end"], F.lit(0))).alias("start"), (F.coalesce(F.try_element_at(s, F.lit(-1))["end"], F.lit(0)) + F.char_length(t["word"])).alias("end")))
    return F.aggregate(tokens, F.array().cast("array<struct<start:int,end:int>>"), step)


def tagged_text(tokens: Column) -> Column:
    """'word/tag word/tag ', with the id where the tag has no name."""
    names = F.create_map(*[F.lit(x) for name, i in tags.TAG_IDS.items() for x in (i, name)])
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["word"], F.lit("/"), F.coalesce(F.try_element_at(names, t["pos"]), t["pos"].cast("string")))), " ")


__all__ = ["ALNUM", "Options", "atoms", "backward_split", "explode_tokens", "forward_split", "full_split", "smart_split", "tagging", "token_stream", "tokenize"]
