"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without white space is cut where its content says so (after sentence punctuation, 512 to 4,096 characters
apart), so that equal texts have equal chunks. Chunks are deduplicated to identifiers: the contents behind each 64-bit
hash are gathered as a set, partially on the map side, and a hash with several contents gets one identifier for each.
Documents are then compared by their ordered lists of identifiers, eight bytes a chunk; no document crosses the
network whole, and repeated chunks cross it once a map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import SPACES, dealt_join, hot_keys, materialize, table

#: A chunk ends after sentence punctuation once it has MIN_CHUNK characters, or at MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 512, 4096
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[.!?;:,])|.{{1,{MAX_CHUNK}}}"


def normalized(text: Column) -> Column:
    """text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def exact_dedup(docs: DataFrame, hash_of=F.xxhash64) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical without white space. Of equal texts the row with the most code points stays, then
    the smallest doc_id; of rows equal in both, or with null ids, each reports the same keep_id and the first by row
    number is kept. Null texts count as empty, and all empty texts form one group. An empty table gives no rows; other
    columns are ignored. hash_of may be replaced by a poor hash to test collisions.
    """
    norm = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.char_length(F.coalesce("text", F.lit(""))).alias("n"), normalized(F.col("text")).alias("norm")
    )
    cut = norm.select("row", "doc_id", "n", "norm", chunks(F.col("norm")).alias("parts"))
    recipes = materialize(
        cut.select("row", "doc_id", "n", F.sha2("norm", 256).alias("sha"), F.transform("parts", lambda x: hash_of(x)).alias("recipe"))
    )
    occurrences = docs.select(F.explode(chunks(normalized(F.col("text")))).alias("part"))
    shared = materialize(
        occurrences.groupBy(hash_of(F.col("part")).alias("h"))
        .agg(F.collect_set("part").alias("parts"))
        .where(F.size("parts") > 1)
        .select("h", F.posexplode(F.array_sort("parts")).alias("sub", "part"))
    )
    if not shared.isEmpty():  # else every hash is verified to stand for one content
        subs = (
            cut.select(F.sha2("norm", 256).alias("sha"), F.posexplode("parts").alias("at", "part"))
            .withColumn("h", hash_of(F.col("part")))
            .join(shared, ["h", "part"])
            .groupBy("sha", "at")
            .agg(F.min("sub").alias("sub"))
            .groupBy("sha")
            .agg(F.map_from_entries(F.collect_list(F.struct("at", "sub"))).alias("subs"))
        )
        empty = F.create_map().cast("map<int,int>")
        recipes = (
            recipes.join(subs, "sha", "left")
            .withColumn("subs", F.coalesce("subs", empty))
            .withColumn("subs", F.transform("recipe", lambda h, i: F.coalesce(F.try_element_at("subs", i), F.lit(0)).cast("long")))
            .withColumn("recipe", F.concat("recipe", "subs"))
            .drop("subs")
        )
    recipes = recipes.withColumn("h", F.xxhash64("recipe"))
    best = recipes.groupBy("h", "recipe").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"), F.count("*").alias("group_size")
    )
    return dealt_join(recipes, best, "h", "row", hot_keys(recipes, "h"), also=("recipe",)).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"),
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


QUERIES = {"op7_exact_dedup": op7_exact_dedup}

ORACLE = {
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)"""
}
