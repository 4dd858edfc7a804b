"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent, w ~ p ** a. The exponent is found by bisection (here into SECTIONS
parts at once, each round one aggregate over the table of sources, which stays distributed) so that the weights' entropy
reaches a target, or that no source repeats more often than a limit relative to the least repeated one. The weights are
then realised: a source's documents are dealt into blocks by hash, every pass over a source visits its blocks in an
order of its own and a block's documents in another, and the source's token budget is spent along that order. The
least repeated source is passed through once, so no document is lost; at the end of a budget the last block is spent
document by document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import materialize, table

#: Blocks of each source, at least, and rows a block; a block is the largest piece that one task orders.
BLOCKS, BLOCK_ROWS = 1024, 20_000
SECTIONS, ROUNDS = 16, 9
REPETITION = 2.0
#: The limit beside an entropy target, so that it can't repeat a small source without end.
MOST_REPETITION = 100.0


def token_counts(docs: DataFrame) -> DataFrame:
    """row (all of docs as one value, so that no name can clash), doc_id, text, __tokens (white-space words) and __source
    ('' for null)."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, "doc_id", "text", tokens.alias("__tokens"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"))


def bisect(low: float, high: float, rises, target: float) -> float:
    """The point of [low, high] where rises(points) reaches target; rises is non-decreasing and answers many points at once."""
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        at = next((i for i, v in enumerate(rises(points)) if v >= target), SECTIONS + 1)
        if at == 0 or at > SECTIONS:
            return points[0] if at == 0 else points[-1]
        low, high = points[at - 1], points[at]
    return high


def entropies(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy (nats) of p ** a, normalised, for each a."""
    sums = []
    for a in exponents:
        x = F.exp(F.lit(a) * F.log("p"))
        sums += [F.sum(x), F.sum(x * F.lit(a) * F.log("p"))]
    row = shares.agg(*sums).first()
    return [math.log(row[2 * i]) - row[2 * i + 1] / row[2 * i] for i in range(len(exponents))]


def source_weights(counted: DataFrame, entropy: float | None = None, repetition: float | None = None) -> DataFrame:
    """__source, tokens, p, weight, exponent and passes (budget as a multiple of the source's tokens) of each source with tokens.

    The least exponent from [0, 1] at which no source repeats more than repetition times (by default REPETITION, with an
    entropy MOST_REPETITION); with entropy, the largest one whose entropy reaches it, but none below that. A target that no exponent meets gives the
    nearest end of [0, 1].
    """
    shares = materialize(counted.groupBy("__source").agg(F.sum("__tokens").alias("tokens")).where("tokens > 0"))
    total, least, most = shares.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    shares = shares.withColumn("p", F.col("tokens") / F.lit(total))
    if total is None:
        exponent = 1.0
    else:
        # a source repeats w / p ~ p ** (a - 1) times, the smallest one most often
        most_repeated = repetition or (REPETITION if entropy is None else MOST_REPETITION)
        exponent = bisect(0.0, 1.0, lambda xs: [-((least / most) ** (a - 1)) for a in xs], -most_repeated * (1 + 1e-12))
        if entropy is not None:
            exponent = max(exponent, 1 - bisect(0.0, 1.0, lambda xs: entropies(shares, [1 - x for x in xs]), entropy))
    w = F.exp(F.lit(exponent) * F.log("p"))
    norm, scale = (shares.agg(F.sum(w), F.min(w / F.col("p"))).first()) if total is not None else (1.0, 1.0)
    return shares.select("__source", "tokens", "p", (w / F.lit(norm)).alias("weight"), F.lit(exponent).alias("exponent"), (w / F.col("p") / F.lit(scale)).alias("passes"))


def mixed(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, blocks: int | None = None) -> DataFrame:
    """docs once for each time that a document is used, with pass_no, block (in order) and weight, exponent of its source added.

    Rows without tokens, and their sources if all rows are such, are used once, at weight 0 if the source has none. A
    null source counts as the empty one. Ties in the order within a block are broken by doc_id, then
    text; repeated rows are used one by one. Null texts have no tokens. An empty table gives no rows; all columns of
    docs are kept, and columns named like an added one are replaced.
    """
    added = ["pass_no", "block", "weight", "exponent"]
    docs = docs.drop(*added)
    if blocks is None:
        blocks = max(BLOCKS, -(-docs.count() // BLOCK_ROWS))
    counted = token_counts(docs).withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    sizes = materialize(counted.select("doc_id", "__source", "__bucket", "__tokens"))
    weights = materialize(source_weights(sizes, entropy, repetition))
    # blocks of each pass in its own order, with the tokens before them: blocks * passes rows a source
    sums = sizes.groupBy("__source", "__bucket").agg(F.sum("__tokens").alias("n"))
    passes = weights.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("passes") - 1e-9).cast("int") - 1, F.lit(0)))).alias("pass_no"))
    plan = sums.join(passes, "__source")
    order = Window.partitionBy("__source", "pass_no").orderBy(F.xxhash64("__bucket", "pass_no"), "__bucket")
    plan = plan.withColumn("block", F.row_number().over(order) - 1).withColumn("before", F.sum("n").over(order) - F.col("n"))
    left = F.round((F.col("passes") - F.col("pass_no")) * F.col("tokens")).cast("long") - F.col("before")
    plan = plan.withColumn("left", F.when(F.col("pass_no") == 0, F.col("n")).otherwise(F.least("n", left))).where("left > 0 OR pass_no = 0")
    plan = materialize(plan.select("__source", "__bucket", "pass_no", "block", "n", "left", "weight", "exponent"))
    used = counted.join(plan, ["__source", "__bucket"], "left").withColumn("pass_no", F.coalesce("pass_no", F.lit(0)))
    whole = used.where("n IS NULL OR left >= n")
    # the last block of a budget, one task each: documents until the budget is spent
    inside = Window.partitionBy("__source", "__bucket", "pass_no").orderBy(F.xxhash64("doc_id", "pass_no"), "doc_id", F.xxhash64("text"))
    part = used.where("left < n").withColumn("__before", F.sum("__tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__tokens"))
    part = part.where("__before < left AND __tokens > 0").drop("__before")
    out = whole.where("pass_no = 0 OR __tokens > 0").unionByName(part)
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns), "pass_no", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("exponent", F.lit(1.0)).alias("exponent"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs).select("doc_id", "source", "pass_no", "block", "weight", "exponent")


QUERIES = {"op3_mixing": op3_mixing}
