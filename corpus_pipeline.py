"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to the shared folder and reads it
again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.bpe import bpe_encode
from tokenloom.llm.common import fresh, materialize, table
from tokenloom.llm.jaccard_join import jaccard_components
from tokenloom.llm.language_id import OTHER, document_rows, language_id
from tokenloom.llm.line_dedup import drop_documents, line_dedup
from tokenloom.llm.mixing import mixed


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is not told, null and empty ones among them; lang becomes the language found,
    and stays where the document declares one that too few do. An empty table gives no rows."""
    found = language_id(document_rows(docs)).where("kept")
    id_, same, told = fresh(docs, "__id"), fresh(docs, "__same"), fresh(docs, "__told")
    found = found.groupBy(F.col("id").alias(id_), F.col("same").alias(same)).agg(F.max("predicted").alias(told))  # repeated rows have one decision
    out = docs.join(found, (F.xxhash64(docs["doc_id"], docs["text"]) == found[same]) & docs["doc_id"].eqNullSafe(found[id_]))
    return out.withColumn("lang", F.when(F.col(told) == OTHER, F.col("lang")).otherwise(F.col(told))).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines, however short, that recur from documents with smaller ids, or from earlier rows with that id or
    without one; documents of which little stays go. Rows equal in id and text are left to the next stage."""
    return drop_documents(line_dedup(docs)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the least doc_id (null ids last), then the least hash
    of its text, then the first by all its columns. Documents without words are in no group and all stay."""
    id_, hash_ = fresh(docs, "__id"), fresh(docs, "__hash")
    groups = jaccard_components(docs).where("first IS NOT NULL").select("text_hash", F.col("doc_id").alias(id_), "first")
    stays = F.col(id_).eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.seen"))
    # what goes, and the few rows that come first more than once
    found = groups.groupBy(id_, F.col("text_hash").alias(hash_)).agg(F.max(stays).alias("stays"), F.count("*").alias("rows")).where("NOT stays OR rows > 1")
    found = materialize(found.select(id_, hash_, "stays"))
    again = found.where("stays").select(id_, hash_)
    same = lambda x: docs["doc_id"].eqNullSafe(x[id_]) & (F.xxhash64(docs["text"]) == x[hash_])
    out = docs.join(found.select(id_, hash_), same(found), "left_anti")
    if again.isEmpty():
        return out
    rows = docs.join(again, same(again), "left_semi").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = rows.groupBy(F.col("row.doc_id").alias(id_), F.xxhash64("row.text").alias(hash_)).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.unionAll(one.select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each use; no source loses a document, and none is used more than twice. Null and empty texts
    are used once, a null source counts as the empty one. An empty table gives no rows."""
    return mixed(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes, for each use of a document. Null and empty
    texts have no tokens, null ids are returned as they are. An empty table gives no rows."""
    return bpe_encode(docs, "digest")


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", token_stage),
]

#: Shingle classes, learnt models and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
