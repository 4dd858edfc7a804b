"""Readers: lines, annotated corpora, user dictionaries, tag tables, settings and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.chars import TRIMMED


def trimmed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Without surrounding blanks and without blank lines."""
    return lines.withColumn(column, F.btrim(column, F.lit(TRIMMED))).where(F.length(column) > 0)


def read_lines(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(file, value) of the lines of a file or folder that are not blank."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return trimmed_lines(reader.text(path).select(F.col("_metadata.file_path").alias("file"), "value"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, file, value): the lines of the *.txt files of a folder, ready for training."""
    return read_lines(spark, path, glob="*.txt").select(F.monotonically_increasing_id().alias("line_id"), "file", "value")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file as one text."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def user_entries(lines: DataFrame, column: str = "value", reverse: bool = False) -> DataFrame:
    """(word, tag, freq) of `word[\\tfreq[\\ttag]]` lines: the frequency defaults to 1, the tag counts only as the third of
    three fields; an entry without tag has no frequency information."""
    parts = F.split(column, "\t")
    word = parts[0]
    freq = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.lit("1")), r"^\s*([+-]?\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    tag = F.when(F.size(parts) == 3, F.nullif(parts[2], F.lit("")))
    out = lines.select((F.reverse(word) if reverse else word).alias("word"), tag.alias("tag"), freq.alias("freq"))
    return out.select("word", "tag", F.when(F.col("tag").isNotNull(), F.col("freq")).alias("freq")).where("word <> ''")


def load_user_dictionary(lexicon: DataFrame, entries: DataFrame) -> DataFrame:
    """lexicon with the user's words that it does not have; of a word given twice, the first by tag and frequency."""
    new = entries.join(lexicon.select("word"), "word", "left_anti")
    best = new.groupBy("word").agg(F.min_by(F.struct("tag", "freq"), F.struct(F.col("tag").isNull(), F.col("tag"), F.col("freq"))).alias("x"))
    return lexicon.unionByName(best.select("word", "x.tag", "x.freq"))


def load_word_list(lexicon: DataFrame, words: DataFrame, tag: str) -> DataFrame:
    """lexicon with a list of words under one tag; under UDF only those that it already has."""
    listed = words.select("word").groupBy("word").agg(F.count("*").alias("freq")).withColumn("tag", F.lit(tag))
    if tag == "UDF":
        listed = listed.join(lexicon.select("word"), "word", "left_semi")
    return lexicon.unionByName(listed.select("word", "tag", "freq"))


def tag_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """(tag, tag_id) of `tag id` lines; # begins a comment."""
    parts = F.split(F.btrim(column, F.lit(TRIMMED)), " +")
    return lines.where(~F.startswith(F.col(column), F.lit("#"))).where(F.size(parts) >= 2).select(parts[0].alias("tag"), parts[1].cast("int").alias("tag_id"))


def delimiter_seed(spark: SparkSession, delimiters: str, freq: int = 10_000) -> DataFrame:
    """(word, tag, freq): each character as w; a repeated one adds again."""
    return spark.createDataFrame([(c, "w", freq) for c in delimiters], "word string, tag string, freq long").groupBy("word", "tag").agg(F.sum("freq").alias("freq"))


def settings(lines: DataFrame, column: str = "value", order_by: str | None = None) -> DataFrame:
    """(key, value) of `key = value` lines; # begins a comment, of a repeated key the last by order_by holds."""
    at = F.instr(column, "=")
    rows = trimmed_lines(lines, column).where(~F.startswith(F.col(column), F.lit("#"))).where(at > 0)
    key, value = F.btrim(F.substring(column, F.lit(1), at - 1), F.lit(TRIMMED)), F.btrim(F.substring(column, at + 1, F.length(column)), F.lit(TRIMMED))
    rank = F.col(order_by) if order_by else F.monotonically_increasing_id()
    return rows.select(key.alias("key"), value.alias("value"), rank.alias("__at")).groupBy("key").agg(F.max_by("value", "__at").alias("value"))


def setting_bool(value: Column) -> Column:
    return value.isin("true", "TRUE")


def requests(raw: DataFrame, column: str = "raw") -> DataFrame:
    """raw with method, path, ip, key, referer, data: an HTTP request's first line, query, header and body. Only a POST has data."""
    c = F.col(column)
    method = F.nullif(F.regexp_extract(c, r"^(GET|POST) ", 1), F.lit(""))
    query = lambda name: F.nullif(F.try_url_decode(F.regexp_extract(c, rf"^\S+ [^? ]*\?(?:[^ ]*&)?{name}=([^& ]*)", 1)), F.lit(""))
    body = F.regexp_extract(c, r"(?s)\r\n\r\n(?:.*&)?data=([^&]*)", 1)
    return raw.withColumns({
        "method": method, "path": F.nullif(F.regexp_extract(c, r"^\S+ ([^? ]*)", 1), F.lit("")), "ip": query("ip"), "key": query("key"),
        "referer": F.nullif(F.regexp_extract(c, r"(?i)\r\nReferer: *([^\r\n]*)", 1), F.lit("")),
        "data": F.when(method == "POST", F.nullif(F.try_url_decode(body), F.lit(""))),
    })


def with_parameter(requests: DataFrame, *names: str) -> DataFrame:
    """The requests in which each of the parameters is there and not empty."""
    for name in names:
        requests = requests.where(F.coalesce(F.length(name), F.lit(0)) > 0)
    return requests
