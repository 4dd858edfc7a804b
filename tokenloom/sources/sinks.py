"""Writers: dictionaries, responses, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import tags
from tokenloom.operators import segment


def save_dictionary(path: str, name: str = "core", mode: str = "overwrite", **tables: DataFrame) -> None:
    """Each table (lexicon, transition, stats, ...) as Parquet below path/name."""
    for table, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}/{table}")


def open_dictionary(spark: SparkSession, path: str, *tables: str, name: str = "core") -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{name}/{t}") for t in tables]


def responses(requests: DataFrame, lexicon: DataFrame, column: str = "data") -> DataFrame:
    """requests with response: one word a line by backward maximum match; empty where there are no data."""
    out = segment.backward_split(requests, column, lexicon)
    return out.withColumn("response", F.coalesce(F.array_join(segment.words_of(F.col("tokens")), "\n"), F.lit("")))


def access_log(requests: DataFrame, seconds: str = "seconds") -> DataFrame:
    """value: time, seconds used, address and -, tab-separated."""
    return requests.select(F.concat_ws("\t", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"), F.format_string("%f", F.col(seconds)), F.coalesce("ip", F.lit("")), F.lit("-")).alias("value"))


def formatted_tokens(tokens):
    """(start,end,pos,0) of each token, as text."""
    return F.array_join(F.transform(tokens, lambda t: F.format_string("(%d,%d,%d,0)", t["start"], t["end"], t["pos"])), "")


def token_text(tokens):
    """(start,end,word/nature) of each token, as an array of texts; without nature where a token has no named one."""
    names = F.create_map(*[F.lit(x) for name, i in tags.TAG_IDS.items() for x in (i, name)])
    nature = lambda t: F.coalesce(F.concat(F.lit("/"), F.try_element_at(names, t["pos"])), F.lit(""))
    return F.transform(tokens, lambda t: F.format_string("(%d,%d,%s%s)", t["start"], t["end"], t["word"], nature(t)))


def token_lengths(tokens):
    """Bytes of each token."""
    return F.transform(tokens, lambda t: t["end"] - t["start"])


def name_dictionary(path: str, spark: SparkSession, name: str, title: str, after: int = 0) -> DataFrame:
    """Writes and returns the metadata of a saved dictionary: name, title, path, words and the greatest word id, ids
    being numbered after `after`."""
    (words,) = open_dictionary(spark, path, "lexicon", name=name)
    n = F.count_distinct("word")
    out = words.agg(n.alias("words"), (n + after).alias("max_word_id")).select(F.lit(name).alias("name"), F.lit(title).alias("title"), F.lit(path).alias("path"), "words", "max_word_id")
    save_dictionary(path, name, metadata=out)
    return open_dictionary(spark, path, "metadata", name=name)[0]
