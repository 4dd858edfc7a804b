"""The same stateless functions over streams: append mode, no watermark, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import segment


def read_texts(spark: SparkSession, path: str, schema: str = "doc_id long, text string", fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def segment_stream(texts: DataFrame, column: str, lexicon: DataFrame, method: str = "forward", options=segment.Options()) -> DataFrame:
    """A stream of texts with tokens; the lexicon is read once, when the query is made."""
    return segment.tokenize(texts, column, lexicon, method, options=options)


def word_counts(tokens: DataFrame, event_time: str | None = None, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of words, in windows with a watermark where there is an event time."""
    rows = tokens.select(*([event_time] if event_time else []), F.explode("tokens.word").alias("word"))
    if event_time:
        return rows.withWatermark(event_time, late).groupBy(F.window(event_time, window), "word").count()
    return rows.groupBy("word").count()


def write_tokens(tokens: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True):
    out = tokens.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()
