"""Lexicon tables and their operators.

A lexicon is a DataFrame (word string, tag string, freq long); a null tag and freq is a word without frequency
information. Words, ids, attributes and totals are plain tables, so every operator is a join or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "word string, tag string, freq long"
#: Ranges that with_ids numbers one by one.
RANGES = 256
#: Most characters of words that may be sent to the executors as one table.
BROADCAST_CHARS = 8_000_000


class LexiconTooLarge(ValueError):
    """The lexicon is beyond what may be sent to the workers."""


def gathered(table: DataFrame, word: str = "word", limit: int = BROADCAST_CHARS) -> list:
    """The rows of a lexicon table, evaluated once; their size is checked before they are gathered."""
    held = table.persist()
    try:
        size = held.agg(F.coalesce(F.sum(F.char_length(word) + 16), F.lit(0))).first()[0]
        if size > limit:
            raise LexiconTooLarge(f"the lexicon has {size} characters, more than {limit}: use engine='native'")
        return held.collect()
    finally:
        held.unpersist()


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def union(*lexicons: DataFrame) -> DataFrame:
    """All entries, frequencies of equal (word, tag) added; a word keeps an entry without frequency only if it has no other."""
    out = lexicons[0].select("word", "tag", "freq")
    for x in lexicons[1:]:
        out = out.unionByName(x.select("word", "tag", "freq"))
    return out.groupBy("word", "tag").agg(F.sum("freq").alias("freq"))


def with_ids(lexicon: DataFrame, order_by: str, after: int = 0) -> DataFrame:
    """(word, word_id) with ids after `after` by first occurrence of order_by; numbered by ranges, not in one task.

    The ranges are of the values themselves, cut where the first evaluation finds them, so that another evaluation of
    the lexicon gives the same ids.
    """
    first = lexicon.groupBy("word").agg(F.min(order_by).alias("__at"))
    at = F.struct("__at", "word")
    cuts = [tuple(r[0]) for r in first.sample(0.1, 7).select(F.struct("__at", "word")).orderBy(F.xxhash64("word")).limit(RANGES).collect()]  # RANGES rows
    kind = first.select(at.alias("x")).schema["x"].dataType.simpleString()
    bounds = F.array_sort(F.array(*(F.struct(F.lit(a).alias("__at"), F.lit(w).alias("word")) for a, w in cuts)).cast(f"array<{kind}>")) if cuts else None
    part = F.size(F.filter(bounds, lambda x: x < at)) if cuts else F.lit(0)
    parts = first.withColumn("__part", part)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")  # RANGES + 1 rows
    inside = Window.partitionBy("__part").orderBy("__at", "word")
    return parts.withColumn("__k", F.row_number().over(inside)).join(F.broadcast(before), "__part").select("word", (F.col("__before") + F.col("__k") + after).alias("word_id"))


def lookup_ids(words: DataFrame, ids: DataFrame) -> DataFrame:
    return words.join(ids, "word", "left").withColumn("word_id", F.coalesce("word_id", F.lit(-1)))


def exist(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    return words.join(lexicon.select("word"), "word", "left_semi")


def add_if_absent(lexicon: DataFrame, new: DataFrame) -> DataFrame:
    """lexicon with the words of new that it does not have; of a word given twice, the first by tag (none last) and frequency."""
    absent = new.select("word", "tag", "freq").join(lexicon.select("word"), "word", "left_anti")
    best = absent.groupBy("word").agg(F.min_by(F.struct("tag", "freq"), F.struct(F.col("tag").isNull(), F.col("tag"), F.col("freq"))).alias("x"))
    return lexicon.select("word", "tag", "freq").unionByName(best.select("word", "x.tag", "x.freq"))


def remove(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    return lexicon.join(words.select("word"), "word", "left_anti")


def add_attribute(lexicon: DataFrame, more: DataFrame) -> DataFrame:
    """lexicon with the frequencies of more added where the word is known."""
    return union(lexicon, more.join(lexicon.select("word"), "word", "left_semi"))


def set_attribute(lexicon: DataFrame, more: DataFrame) -> DataFrame:
    """lexicon with the frequencies of more (word, tag, freq) in place of its own, where the word is known."""
    more = union(more.join(lexicon.select("word"), "word", "left_semi"))
    return lexicon.select("word", "tag", "freq").join(more.select("word", "tag"), ["word", "tag"], "left_anti").unionByName(more)


def remove_attribute(lexicon: DataFrame, which: DataFrame) -> DataFrame:
    """lexicon without the entries of which (word, tag); a word that loses its last one stays without frequency information."""
    left = lexicon.select("word", "tag", "freq").join(which.select("word", "tag"), ["word", "tag"], "left_anti")
    bare = lexicon.select("word").distinct().join(left.select("word"), "word", "left_anti")
    return left.unionByName(bare.select("word", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("long").alias("freq")))


def attribute_frequency(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (word, tag) with freq, 0 where absent."""
    return words.join(lexicon.groupBy("word", "tag").agg(F.sum("freq").alias("freq")), ["word", "tag"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


def word_frequency(lexicon: DataFrame) -> DataFrame:
    """(word, freq) over all tags; null without frequency information."""
    return lexicon.groupBy("word").agg(F.sum("freq").alias("freq"))


def compat_frequency(lexicon: DataFrame, transitions: DataFrame) -> DataFrame:
    """(word, freq) as the model implementation has it, which keeps words and tags in one table: the frequency of a word
    that is the name of a tag includes the transitions from that tag."""
    moves = transitions.groupBy(F.col("prev").alias("word")).agg(F.sum("freq").alias("freq"))
    return word_frequency(lexicon).unionByName(moves).groupBy("word").agg(F.sum("freq").alias("freq"))


def frequency_map(lexicon: DataFrame) -> DataFrame:
    """(word, info map<tag, freq>) without zero frequencies; null without frequency information."""
    entries = F.collect_list(F.when(F.col("tag").isNotNull() & (F.col("freq") != 0), F.struct("tag", "freq")))
    known = F.count("tag") > 0
    return union(lexicon).groupBy("word").agg(F.when(known, F.map_from_entries(F.array_sort(entries))).alias("info"))


def merge_info(a, b):
    """Sum of two frequency maps."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def prefixes(lexicon: DataFrame) -> DataFrame:
    return lexicon.select(F.explode(F.transform(F.sequence(F.lit(0), F.char_length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("prefix")).distinct()


def has_prefix(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Of words (word), those that begin a word of the lexicon; the empty one always does."""
    return words.join(prefixes(lexicon), words["word"] == F.col("prefix"), "left_semi")


def totals(lexicon: DataFrame) -> DataFrame:
    return lexicon.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"))


def lookup(lexicon: DataFrame, word: str, reverse: bool = False) -> DataFrame:
    """One row a tag of a word: word, total, tag, freq."""
    out = lexicon.where(F.col("word") == (word[::-1] if reverse else word)).groupBy("word", "tag").agg(F.sum("freq").alias("freq"))
    return out.withColumn("total", F.sum("freq").over(Window.partitionBy("word"))).select("word", "total", "tag", "freq")


def lookup_text(lexicon: DataFrame, ids: DataFrame, words: DataFrame, reverse: bool = False) -> DataFrame:
    """words (word) with answer: `word(id=1, total=2) tag:freq tag:freq `, null for frequencies where a word has none, and
    what is said of unknown words."""
    asked = words.select(F.col("word").alias("__asked"), (F.reverse("word") if reverse else F.col("word")).alias("word"))
    known = frequency_map(lexicon).join(ids, "word")
    total = F.aggregate(F.coalesce(F.map_values("info"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.concat_ws(":", e["key"], e["value"])), " ")
    said = F.concat(F.format_string("%s(id=%d, total=%d) ", "word", "word_id", total), F.coalesce(F.concat(entries, F.lit(" ")), F.lit("null")))
    return asked.join(known, "word", "left").select(F.col("__asked").alias("word"), F.coalesce(F.when(F.col("word_id").isNotNull(), said), F.lit("not found in dict")).alias("answer"))


def derived(texts: DataFrame, least: int = 2) -> DataFrame:
    """A lexicon of what a text column repeats: 2 to 4 characters from a non-ASCII one on, found so many times; tag n."""
    texts = texts.where(F.octet_length("text") > F.char_length("text"))  # without others no word begins
    chars = texts.select(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)).alias("c")).where(F.size("c") > 1)
    starts = F.filter(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.octet_length(F.get("c", i - 1)) > 1)
    spots = chars.select("c", F.explode(starts).alias("i"))
    lengths = F.filter(F.array(*map(F.lit, (2, 3, 4))), lambda k: F.col("i") + k - 1 <= F.size("c"))
    words = spots.select(F.explode(F.transform(lengths, lambda k: F.array_join(F.slice("c", F.col("i"), k), ""))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= least).select("word", F.lit("n").alias("tag"), "freq")
