"""From a folder of annotated lines and word lists to dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.chars import SEED_DELIMITERS
from tokenloom.operators import lexicon as lex
from tokenloom.operators import training
from tokenloom.sources import sinks
from tokenloom.sources import text as sources

#: Tables of the core dictionary and of the one for names.
CORE, PERSON = ("lexicon", "transition", "stats", "errors"), ("person_role", "person_transition", "name_shape")


def build_lines(lines: DataFrame, lists: dict[str, DataFrame] | None = None, delimiters: str = SEED_DELIMITERS, column: str = "line") -> dict[str, DataFrame]:
    """All tables from annotated lines (line_id and the column): what train() gives, with delimiters as w, and lists (word) by tag.

    Of a list under UDF only words count that the corpus or delimiters have; names of a list under nr count as roles
    too. inverse has the words turned round. The totals are those of the corpus and the delimiters.
    """
    spark, out = lines.sparkSession, training.train(lines, column)
    seed = sources.delimiter_seed(spark, delimiters)
    lexicon = lex.union(out["lexicon"], seed)
    for tag, words in (lists or {}).items():
        lexicon = sources.load_word_list(lexicon, words, tag)
        if tag == "nr":
            roles = out["person_role"].unionByName(training.listed_roles(words))
            out["person_role"] = roles.groupBy("unit", "role").agg(F.sum("freq").alias("freq"))
    out["lexicon"] = lex.union(lexicon)
    out["inverse"] = out["lexicon"].groupBy(F.reverse("word").alias("word")).agg(F.sum("freq").alias("freq"))
    out["stats"] = out["stats"].select(*((F.col(c) + len(delimiters)).alias(c) for c in out["stats"].columns))
    return out


def build(spark: SparkSession, corpus: str, lists: dict[str, str] | None = None, save_to: str | None = None, delimiters: str = SEED_DELIMITERS) -> dict[str, DataFrame]:
    """build_lines() of the *.txt files of a folder and of files of words by tag; with save_to, the core, person and inverse
    dictionaries as Parquet below it, and the tables as read from there."""
    words = {tag: sources.read_lines(spark, path).select(F.col("value").alias("word")) for tag, path in (lists or {}).items()}
    tables = build_lines(sources.read_corpus(spark, corpus), words, delimiters, "value")
    if save_to is None:
        return tables
    sinks.save_dictionary(save_to, "core", **{k: tables[k] for k in CORE})
    sinks.save_dictionary(save_to, "person", **{k: tables[k] for k in PERSON})
    sinks.save_dictionary(save_to, "inverse", lexicon=tables["inverse"])
    names = {"core": CORE, "person": PERSON}
    saved = {t: df for name, kinds in names.items() for t, df in zip(kinds, sinks.open_dictionary(spark, save_to, *kinds, name=name))}
    return saved | {"inverse": sinks.open_dictionary(spark, save_to, "lexicon", name="inverse")[0]}
