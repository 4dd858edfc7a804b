"""The façade: a Segmenter over a lexicon, and its functions for SQL."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import tags
from tokenloom.operators import kernels, segment, tagging
from tokenloom.sources import config, sinks
from tokenloom.sources import text as sources
from tokenloom.sources.config import Config

#: What analyse() does beside splitting.
NONE, POS, NER = 0, 1, 2


@dataclass
class Segmenter:
    """The five operations of the library on any DataFrame with a text column."""

    lexicon: DataFrame
    transitions: DataFrame | None = None
    options: segment.Options = field(default_factory=segment.Options)
    roles: DataFrame | None = None
    role_transitions: DataFrame | None = None

    def forward_split(self, df: DataFrame, column: str = "text") -> DataFrame:
        return segment.forward_split(df, column, self.lexicon, self.options)

    def backward_split(self, df: DataFrame, column: str = "text") -> DataFrame:
        return segment.backward_split(df, column, self.lexicon, self.options)

    def smart_split(self, df: DataFrame, column: str = "text") -> DataFrame:
        return segment.smart_split(df, column, self.lexicon, self.options)

    def full_split(self, df: DataFrame, column: str = "text") -> DataFrame:
        return segment.full_split(df, column, self.lexicon, self.options)

    def tagging(self, df: DataFrame, column: str = "text") -> DataFrame:
        return segment.tokenize(df, column, self.lexicon, "tagging", self.transitions, self.options)

    def tokenize(self, df: DataFrame, column: str = "text", method: str = "full") -> DataFrame:
        return segment.tokenize(df, column, self.lexicon, method, self.transitions, self.options)

    def recognize(self, df: DataFrame, column: str = "text", kind: str = "nr") -> DataFrame:
        """df with tokens and the names found in them, by the roles of the dictionary for names."""
        if self.roles is None or self.role_transitions is None:
            raise ValueError("names need roles and role_transitions, as train() and build() give them")
        return tagging.recognize(df, column, self.lexicon, self.roles, self.role_transitions, kind, options=self.options)

    def analyse(self, df: DataFrame, column: str = "text", flags: int = 0) -> DataFrame:
        """smart_split, with the parts of speech where flags have POS, and with names where they have NER."""
        if flags & NER:
            return self.recognize(df, column)
        return self.tagging(df, column) if flags & POS else self.smart_split(df, column)

    def register(self, spark: SparkSession) -> None:
        """SQL functions forward_split, backward_split, smart_split, full_split and tagging: text to array of tokens."""
        held = segment.load(self.lexicon, total=self.options.total)
        model = segment.hidden_model(self.lexicon, self.transitions) if self.transitions is not None else None
        o = self.options
        for name, method, tagged in (("forward_split", "forward", False), ("backward_split", "backward", False), ("smart_split", "unigram", False), ("full_split", "full", False), ("tagging", "unigram", True)):
            backwards = held.reversed() if method == "backward" else None

            def split(texts, method=method, backwards=backwards, found_by=model if tagged else None):
                import pandas as pd

                out = []
                for t in texts:
                    if t is None:
                        out.append(None)
                        continue
                    words, spans, pos = kernels.segment(t, method, held, backwards, found_by, o.compat, o.extended_time, o.split_len, o.max_len)
                    starts, ends = kernels.token_bytes(t, words, spans)
                    out.append([{"start": a, "end": z, "pos": p, "word": w} for a, z, p, w in zip(starts.tolist(), ends.tolist(), pos, words)])
                return pd.Series(out)

            split.__annotations__ = {}
            spark.udf.register(name, F.pandas_udf(split, T._parse_datatype_string(segment.TOKENS), F.PandasUDFType.SCALAR))


def tag_name(tag_id: int) -> str | None:
    return next((name for name, i in tags.TAG_IDS.items() if i == tag_id), None)


def open_segmenter(spark: SparkSession, settings: Config | None = None) -> Segmenter:
    """A segmenter over the dictionaries below DICT_ROOT, with the user's words of the *.txt files in USER_DICT_DIR."""
    settings = settings or config.load(spark)
    root = settings.text("DICT_ROOT")
    lexicon, transitions, stats = sinks.open_dictionary(spark, root, "lexicon", "transition", "stats", name=settings.text("CORE_DICT_NAME"))
    roles, role_transitions = sinks.open_dictionary(spark, root, "person_role", "person_transition", name=settings.text("PERSON_DICT_NAME"))
    if settings.text("USER_DICT_DIR"):
        lines = sources.read_lines(spark, settings.text("USER_DICT_DIR"), glob="*.txt")
        lexicon = sources.load_user_dictionary(lexicon, sources.user_entries(lines))
    options = settings.options()
    if options.total is None:
        options = replace(options, total=stats.first()["words_total"])
    return Segmenter(lexicon, transitions, options, roles, role_transitions)
