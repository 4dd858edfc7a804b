"""Precision, recall and F1 of segmentations, accuracy of taggers, and throughput."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.chars import is_punctuation

TINY = 1e-7


def bag_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n: how often a row occurs in both."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    return count(a, "x").join(count(b, "y"), keys).select(*keys, F.least("x", "y").alias("n"))


def bag_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def bag_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def segmentation_scores(pred: DataFrame, gold: DataFrame, key: str = "line_id") -> DataFrame:
    """precision, recall, f1 over (key, word) rows: matches are multiset intersections by line, punctuation left out."""
    words = lambda df: df.where(~is_punctuation(F.col("word"))).select(key, "word")
    p, g = words(pred), words(gold)
    hits = bag_intersection(p, g, [key, "word"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    counts = hits.crossJoin(p.agg(F.count("*").alias("n_pred"))).crossJoin(g.agg(F.count("*").alias("n_gold")))  # one row each
    precision, recall = F.col("hits") / (F.col("n_pred") + TINY), F.col("hits") / (F.col("n_gold") + TINY)
    scored = counts.withColumn("precision", precision).withColumn("recall", recall)
    return scored.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + TINY))


def tagger_scores(pred: DataFrame, gold: DataFrame, keys=("line_id", "k")) -> DataFrame:
    """Positional accuracy over (keys, tag) rows; precision and recall are the same."""
    both = pred.select(*keys, F.col("tag").alias("p")).join(gold.select(*keys, F.col("tag").alias("g")), list(keys))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("g")).alias("hits")).withColumn("accuracy", F.col("hits") / (F.col("n") + TINY))


def throughput(make, texts: DataFrame, column: str = "text") -> dict[str, float]:
    """Seconds, MB/s and tokens/s of make(texts) -> DataFrame with tokens."""
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    began = time.time()
    tokens = make(texts).agg(F.sum(F.size("tokens"))).first()[0] or 0
    took = time.time() - began
    return {"seconds": took, "mb_per_s": size / 1024 / 1024 / took, "tokens_per_s": tokens / took}
