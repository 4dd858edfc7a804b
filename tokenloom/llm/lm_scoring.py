"""Language-model scores from a hidden Markov model trained by Baum-Welch.

Symbols: the OWN most frequent words have one each; the other words share SHARED symbols by crc32, within which a word
has the probability (c + 0.1) / (n + 0.1 * (v + 1)) of its counts, unknown words counting as one more; the end of a
text has its own. The model's size is therefore fixed, while the word counts behind it cover the whole corpus and stay
distributed: only the FREQUENT most frequent words travel to the executors, the rest meet their counts by a join.

Each Baum-Welch round runs the scaled forward and backward recursions over all training texts, packed by time step so
that one array operation advances all texts of a pack, and adds the expected counts up across partitions by symbol.
The forward recursion's scales then give the exact log likelihood of each whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import materialize, most_frequent, small_batches, table

OWN, SHARED, FREQUENT = 4096, 1024, 65_536
STATES, ROUNDS, SEED = 6, 4, 7
END = OWN + SHARED
ALPHA = 0.1
#: Tokens packed together; bounds a worker's memory (one text longer than this is a pack of its own).
PACK = 1_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # for bytes, these are the ASCII letters and the six ASCII spaces


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c: Counter = Counter()
        for t in b.column("text"):
            c.update(words(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])


class _Shared(dict):
    """Words that are not frequent to their shared symbol; forgets all when full."""

    def __init__(self, own: int, shared: int):
        self.own, self.shared = own, shared

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = s = self.own + crc32(word) % self.shared
        return s


def _encode(frequent, own, shared, totals, end_log):
    """totals: for each shared symbol log10 of its whole mass."""

    def run(batches):
        rank = {w: i for i, (w, _) in enumerate(frequent)}
        symbol = np.array([i if i < own else own + crc32(w) % shared for i, (w, _) in enumerate(frequent)] + [0], np.int32)
        logs = np.log10(np.array([c for _, c in frequent] + [1.0 - ALPHA]) + ALPHA)  # 0 for rank -1, which adds nothing
        tail = _Shared(own, shared)
        mass = np.concatenate((np.zeros(own), totals))
        for b in batches:
            out = []
            for t in b.column("text"):
                ws = words(t.as_py())
                ranks = np.fromiter(map(rank.get, ws, repeat(-1)), np.int32, len(ws))
                ids, at = symbol[ranks], np.flatnonzero(ranks < 0)
                rare = [ws[i] for i in at.tolist()]
                ids[at] = [tail[w] for w in rare]
                log = logs[ranks]
                within = float(log[ids >= own].sum() - mass[ids].sum())
                out.append((np.append(ids, own + shared).astype("<u2").tobytes(), len(ws) + 1, len(ws) - len(rare), float(log.sum()) + end_log, within, rare))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("held_out"), *cols], ENCODED)

    return run


ENCODED = ["row", "doc_id", "held_out", "symbols", "n_tokens", "n_frequent", "base", "within", "rare"]


class Pack:
    """Sequences ordered by falling length and laid out step by step: step t has the first n[t] sequences."""

    def __init__(self, seqs: list[np.ndarray]):
        lengths = np.array([len(s) for s in seqs])
        self.order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max())
        self.n = len(seqs) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
        self.base = np.concatenate(([0], np.cumsum(self.n)))
        self.flat = np.empty(int(lengths.sum()), np.int32)
        for i, k in enumerate(self.order):
            self.flat[self.base[: lengths[k]] + i] = seqs[k]


def forward(pack: Pack, start, move, emit_t, keep: bool):
    """Log likelihood of each sequence in the given order; with keep, the scaled forward vectors and the scales."""
    n, base, flat = pack.n.tolist(), pack.base.tolist(), pack.flat
    logs = np.zeros(n[0])
    alphas, scales = (np.empty((len(flat), len(start))), np.empty(len(flat))) if keep else (None, None)
    a = start
    for t, m in enumerate(n):
        a = (a[:m] @ move if t else np.broadcast_to(start, (m, len(start)))) * emit_t[flat[base[t] : base[t + 1]]]
        c = a.sum(1)
        a /= c[:, None]
        logs[:m] += np.log(c)
        if keep:
            alphas[base[t] : base[t + 1]], scales[base[t] : base[t + 1]] = a, c
    out = np.empty_like(logs)
    out[pack.order] = logs
    return out, alphas, scales


def expected(pack: Pack, start, move, emit_t):
    """Baum-Welch counts of a pack: starts (K), moves (K, K), emissions (V, K), and its log likelihood."""
    logs, alphas, scales = forward(pack, start, move, emit_t, True)
    n, base, flat = pack.n.tolist(), pack.base.tolist(), pack.flat
    moves = np.zeros_like(move)
    back = np.ascontiguousarray(move.T)
    beta = np.ones((n[-1], len(start)))
    gamma = alphas  # overwritten from the end
    for t in range(len(n) - 1, 0, -1):
        here = slice(base[t], base[t + 1])
        x = beta * emit_t[flat[here]] / scales[here][:, None]
        moves += alphas[base[t - 1] : base[t - 1] + n[t]].T @ x
        gamma[here] *= beta
        beta = np.ones((n[t - 1], len(start)))
        beta[: n[t]] = x @ back
    gamma[: base[1]] *= beta
    emits = np.stack([np.bincount(flat, gamma[:, k], len(emit_t)) for k in range(len(start))], 1)
    return gamma[: base[1]].sum(0), moves * move, emits, float(logs.sum())


def _packs(batches, size: int):
    """(batch columns, sequences) in packs of about size tokens; texts of one Arrow batch may fall into several."""
    for b in batches:
        seqs, begin, total = [], 0, 0
        for i, x in enumerate(b.column("symbols")):
            seqs.append(np.frombuffer(x.as_py(), "<u2"))
            total += len(seqs[-1])
            if total >= size:
                yield b.slice(begin, len(seqs)), seqs
                seqs, begin, total = [], i + 1, 0
        if seqs:
            yield b.slice(begin, len(seqs)), seqs


def _expectation(model, size):
    start, move, emit = model

    def run(batches):
        emit_t, k = np.ascontiguousarray(emit.T), len(start)
        sums = None
        for _, seqs in _packs(batches, size):
            one = expected(Pack(seqs), start, move, emit_t)
            sums = one if sums is None else [a + b for a, b in zip(sums, one)]
        if sums is not None:
            # rows -1: starts, -2 - i: moves from state i, -2 - K: log likelihood; others: a symbol's emissions
            seen = np.flatnonzero(sums[2].any(1))
            keys = np.concatenate((seen, [-1], -2 - np.arange(k), [-2 - k]))
            values = np.vstack((sums[2][seen], sums[0][None], sums[1], np.full((1, k), sums[3])))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *(pa.array(v) for v in values.T)], ["key", *(f"s{i}" for i in range(k))])

    return run


def first_model(unigram: np.ndarray, states: int, seed: int):
    """Unigram emissions, disturbed so that states can differ, and states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = unigram * rng.uniform(0.5, 1.5, (states, len(unigram)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True)


def next_model(starts, moves, emits, unigram, states):
    """Maximisation, with a little of the unigram in each state so that nothing has probability 0."""
    emit = emits.T + unigram
    move = moves + 0.1
    start = starts + 0.1
    return start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)


def train(encoded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED, pack: int = PACK):
    """Model (start, move, emit) from all rows of encoded that are not held out, and each round's log likelihood."""
    model, curve = first_model(unigram, states, seed), []
    names = [f"s{i}" for i in range(states)]
    fields = ", ".join(["key int", *(f"{s} double" for s in names)])
    for _ in range(rounds):
        sums = encoded.where("NOT held_out").select("symbols").mapInArrow(_expectation(model, pack), fields)
        with small_batches(encoded.sparkSession):
            rows = sums.groupBy("key").agg(*(F.sum(s).alias(s) for s in names)).collect()  # at most a row a symbol and state
        got = {r[0]: np.array(r[1:]) for r in rows}
        if not got:
            break
        emits = np.zeros((len(unigram), states))
        for key, v in got.items():
            if key >= 0:
                emits[key] = v
        model = next_model(got[-1], np.stack([got[-2 - i] for i in range(states)]), emits, unigram, states)
        curve.append(float(got[-2 - states][0]))
    return model, curve


def _likelihood(model, size):
    start, move, emit = model

    def run(batches):
        emit_t = np.ascontiguousarray(emit.T)
        for b, seqs in _packs(batches, size):
            logs = forward(Pack(seqs), start, move, emit_t, False)[0] / math.log(10)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in SUMMED), pa.array(logs)], [*SUMMED, "hidden"])

    return run


SUMMED = ["row", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "within"]


def lm_scores(docs: DataFrame, own: int = OWN, shared: int = SHARED, frequent: int = FREQUENT, states: int = STATES, rounds: int = ROUNDS, pack: int = PACK) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of doc_id (as text; null counts as "") divided by 10 leaves 0 are held out; the others train.
    Null and empty texts have one token, the end. Without training rows all probabilities come from the smoothing.
    Repeated rows are trained on and scored as often as they occur. An empty table gives no rows; other columns are
    ignored. Texts are scored whole, a long one as a pack of its own.
    """
    assert own <= frequent and own + shared < 65_535
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    training = rows.where("NOT held_out")
    counts = materialize(training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    ends = training.count()
    top = [(bytes(w), c) for w, c in most_frequent(counts, "word", "c", frequent)]
    shares = counts.groupBy((F.crc32("word") % shared).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(shared), np.zeros(shared)
    for k, n, v in shares:
        mass[k], kinds[k] = n, v
    total, vocabulary = int(mass.sum()) + ends, int(kinds.sum()) + (ends > 0)
    for w, c in top[:own]:
        k = crc32(w) % shared
        mass[k] -= c
        kinds[k] -= 1
    within = mass + ALPHA * (kinds + 1)
    denominator = math.log10(total + ALPHA * (vocabulary + 1))
    unigram = np.concatenate(([c for _, c in top[:own]], np.zeros(own - len(top[:own])), mass, [ends])) + ALPHA
    unigram /= unigram.sum()
    fields = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_frequent long, base double, within double"
    encoded = materialize(
        rows.mapInArrow(
            _encode(top, own, shared, np.log10(within), math.log10(ends + ALPHA)),
            fields.replace("n_tokens", "symbols binary, n_tokens") + ", rare array<binary>",
        )
    )
    model, _ = train(encoded, unigram, states, rounds, pack=pack)
    hidden = encoded.select(*SUMMED, "symbols").mapInArrow(_likelihood(model, pack), f"{fields}, hidden double")
    rare = (
        encoded.select("row", F.explode("rare").alias("word"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("rest"), F.count("c").alias("known"))
    )
    rest = F.coalesce("rest", F.lit(0.0))
    return hidden.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("hidden") + F.col("within") + rest).alias("score"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}

ORACLE: dict[str, str] = {}
