"""Dictionary training from annotated corpora: word/tag lines with [composites]tag.

Parsing runs per line in Arrow batches; all counts are grouped aggregates over the parsed rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.chars import PUNCTUATION
from tokenloom.operators.segment import slices, spread

_ALPHA = re.compile("[A-Za-z]*")
#: Bytes of lines that are parsed before they are sent on: an entity takes some 500 bytes in Python.
TEXT_AT_ONCE = 256 << 10


class ParseError(ValueError):
    """A token or line that breaks the corpus format."""


def parse_entity(token: str) -> tuple[str, str, bool, bool, str]:
    """word, tag, begins a composite, ends one, tag of the composite."""
    at = token.rfind("/") if "http://" in token else token.find("/")
    if at < 0:
        raise ParseError(f"no tag: {token}")
    word, pos = token[:at], token[at + 1 :]
    if not word and not pos:
        raise ParseError("empty token")
    if not word and pos == "/w":
        return "/", "w", False, False, ""
    if not word and pos == "w":
        return " ", "w", False, False, ""
    begins = word.startswith("[") and len(word) > 1
    word = word[1:] if begins else word
    whole, ends = "", "]" in pos
    if ends:
        pos, _, whole = pos.partition("]")
        whole = whole[1:] if whole.startswith("/") else whole
    if "/" in pos:
        first, _, second = pos.partition("/")
        if _ALPHA.fullmatch(first):
            pos = first
        elif _ALPHA.fullmatch(second):
            word, pos = f"{word}/{first}", second
    data = word.encode()
    if len(data) > 3 and any(x.decode(errors="replace") in PUNCTUATION for x in (data[:3], data[:1], data[-1:])):
        raise ParseError(f"punctuation in {word}")
    return word, pos, begins, ends, whole


def parse_line(line: str) -> list[tuple[str, str, list[tuple[str, str]]]]:
    """(word, tag, parts) of each entity; parts are (word, tag) of a composite's tokens, else empty."""
    out: list[tuple[str, str, list[tuple[str, str]]]] = []
    parts: list[tuple[str, str]] | None = None
    for token in line.split():
        word, pos, begins, ends, whole = parse_entity(token)
        if begins:
            if parts is not None:
                raise ParseError("nested composite")
            parts = []
        if ends and parts is None:
            raise ParseError("composite ends before it begins")
        if parts is None:
            out.append((word, pos, []))
            continue
        parts.append((word, pos))
        if ends:
            out.append(("".join(w for w, _ in parts), whole, parts))
            parts = None
    if parts is not None:
        raise ParseError("composite does not end")
    return merge_names(out)


def merge_names(entities: list) -> list:
    """Pairs of nr, nr from the left, a surname of 3 bytes and a given name of up to 6, as one composite nr."""
    out, i = [], 0
    while i < len(entities):
        if i + 1 < len(entities):
            (a, x, p), (b, y, q) = entities[i], entities[i + 1]
            if x == y == "nr" and not p and not q and len(a.encode()) == 3 and len(b.encode()) <= 6:
                out.append((a + b, "nr", [(a, "nr"), (b, "nr")]))
                i += 2
                continue
        out.append(entities[i])
        i += 1
    return out


ENTITIES = "array<struct<word:string,pos:string,parts:array<struct<word:string,pos:string>>>>"
_PART = pa.struct([("word", pa.string()), ("pos", pa.string())])
_ENTITY = pa.struct([("word", pa.string()), ("pos", pa.string()), ("parts", pa.list_(_PART))])


def _parse(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, column, TEXT_AT_ONCE)):
            lists, errors = [], []
            for x in b.column(column):
                try:
                    found = parse_line(x.as_py() or "")
                    lists.append([{"word": w, "pos": p, "parts": [{"word": a, "pos": t} for a, t in parts]} for w, p, parts in found])
                    errors.append(None)
                except ParseError as e:
                    lists.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(_ENTITY)), pa.array(errors, pa.string())], [*b.schema.names, "entities", "parse_error"])

    return run


def parse_corpus(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with entities, and parse_error where the whole line is to be dropped."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return spread(lines).mapInArrow(_parse(column), f"{fields}, entities {ENTITIES}, parse_error string")


def entities(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    """(key, k, word, pos, parts) of the lines that parse."""
    return parsed.where("parse_error IS NULL").select(key, F.posexplode("entities").alias("k", "e")).select(key, "k", "e.*")


def word_tags(found: DataFrame) -> DataFrame:
    """(word, tag, freq): each entity, and each part of a composite."""
    each = F.concat(F.array(F.struct("word", "pos")), "parts")
    return found.select(F.explode(each).alias("x")).groupBy(F.col("x.word").alias("word"), F.col("x.pos").alias("tag")).agg(F.count("*").alias("freq"))


def tag_bigrams(found: DataFrame, key: str = "line_id") -> DataFrame:
    """(prev, next, freq) along each line, through the parts of composites; those within a last composite do not count."""
    inside = F.when(F.size("parts") > 0, F.transform("parts", lambda p: p["pos"])).otherwise(F.array("pos"))
    line = Window.partitionBy(key)
    flat = found.withColumn("is_last", F.col("k") == F.max("k").over(line)).select(key, "k", "is_last", F.posexplode(inside).alias("i", "tag"))
    order = line.orderBy("k", "i")
    pairs = flat.withColumn("prev", F.lag("tag").over(order)).where(F.col("prev").isNotNull() & ~(F.col("is_last") & (F.col("i") > 0)))
    return pairs.groupBy("prev", F.col("tag").alias("next")).agg(F.count("*").alias("freq"))


def corpus_totals(found: DataFrame) -> DataFrame:
    """words_total and pos_total, which are equal: entities and parts."""
    return found.agg(F.coalesce(F.sum(1 + F.size("parts")), F.lit(0)).alias("words_total")).withColumn("pos_total", F.col("words_total"))


def inverse_words(found: DataFrame) -> DataFrame:
    """(word, freq) with the characters turned round."""
    return word_tags(found).groupBy(F.reverse("word").alias("word")).agg(F.sum("freq").alias("freq"))


def _characters(word):
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def name_roles(words: DataFrame) -> DataFrame:
    """(unit, role) of each character of names (word): B the first, also where it is the only one, D the last, C between."""
    chars = words.select(_characters(F.col("word")).alias("c"))
    role = lambda c, i: F.struct(c.alias("unit"), F.when(i == 0, "B").when(i == F.size("c") - 1, "D").otherwise("C").alias("role"))
    return chars.select(F.explode(F.transform("c", role)).alias("x")).select("x.*")


def word_roles(found: DataFrame, key: str = "line_id") -> DataFrame:
    """found with role: S a name, E what follows one, O else; and prev_role."""
    order = Window.partitionBy(key).orderBy("k")
    after = F.coalesce(F.lag("pos").over(order) == "nr", F.lit(False))
    roles = found.withColumn("role", F.when(F.col("pos") == "nr", "S").when(after, "E").otherwise("O"))
    return roles.withColumn("prev_role", F.lag("role").over(order))


def person_roles(found: DataFrame, key: str = "line_id") -> DataFrame:
    """(unit, role, freq): roles of words and of the characters of names."""
    words = word_roles(found, key).select(F.col("word").alias("unit"), "role")
    return words.unionByName(name_roles(found.where("pos = 'nr'"))).groupBy("unit", "role").agg(F.count("*").alias("freq"))


def role_bigrams(found: DataFrame, key: str = "line_id") -> DataFrame:
    """(prev, next, freq): of word roles, into B of each name, within names, and all that follows a name from D too."""
    roles = word_roles(found, key).where("prev_role IS NOT NULL")
    pairs = roles.select(F.col("prev_role").alias("prev"), F.explode(F.when(F.col("pos") == "nr", F.array("role", F.lit("B"))).otherwise(F.array("role"))).alias("next"))
    after = pairs.where("prev = 'S'").select(F.lit("D").alias("prev"), "next")
    n = F.char_length("word")
    names = found.where(F.col("pos") == "nr").where(n > 1)
    inner = F.when(n == 2, F.array(F.lit("BD"))).otherwise(F.concat(F.array(F.lit("BC")), F.array_repeat(F.lit("CC"), (n - 3).cast("int")), F.array(F.lit("CD"))))
    within = names.select(F.explode(inner).alias("x")).select(F.substring("x", 1, 1).alias("prev"), F.substring("x", 2, 1).alias("next"))
    return pairs.unionByName(after).unionByName(within).groupBy("prev", "next").agg(F.count("*").alias("freq"))


def name_shapes(found: DataFrame) -> DataFrame:
    """(shape, freq): BD for names of two characters, else BCD."""
    return found.where("pos = 'nr'").groupBy(F.when(F.char_length("word") == 2, "BD").otherwise("BCD").alias("shape")).agg(F.count("*").alias("freq"))


def listed_roles(names: DataFrame) -> DataFrame:
    """(unit, role, freq) of a list of names (word): each name itself as nr, and its characters."""
    whole = names.select(F.col("word").alias("unit"), F.lit("nr").alias("role"))
    return whole.unionByName(name_roles(names)).groupBy("unit", "role").agg(F.count("*").alias("freq"))


def gold_sentences(found: DataFrame, key: str = "line_id") -> DataFrame:
    """(key, sentence, words, tagged_words, tags) of parsed lines: the words that a segmenter should find, composites whole,
    and what a tagger should, composites by their parts."""
    parts = F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array(F.struct("word", "pos")))
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "word", parts.alias("parts")))).alias("e"))  # a line's entities
    words, each = F.transform("e", lambda x: x["word"]), F.flatten(F.transform("e", lambda x: x["parts"]))
    return lists.select(key, F.array_join(words, "").alias("sentence"), words.alias("words"), F.transform(each, lambda x: x["word"]).alias("tagged_words"), F.transform(each, lambda x: x["pos"]).alias("tags"))


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("n_lines"), F.count("parse_error").alias("n_errors"))


def train(lines: DataFrame, column: str = "line", key: str = "line_id") -> dict[str, DataFrame]:
    """All tables of a dictionary from (key, column) lines."""
    parsed = parse_corpus(lines.select(key, column), column)
    found = entities(parsed, key)
    return {
        "lexicon": word_tags(found), "transition": tag_bigrams(found, key), "stats": corpus_totals(found), "person_role": person_roles(found, key),
        "person_transition": role_bigrams(found, key), "name_shape": name_shapes(found), "errors": parse_errors(parsed),
    }
