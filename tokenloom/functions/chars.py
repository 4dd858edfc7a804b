"""Character classes and string functions, as column expressions.

Offsets are UTF-8 byte offsets unless a name says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes that runs are made of, as regular-expression classes.
ALNUM = r"[#%&+\-./0-9:=>?@A-Z\\_a-z]"
NUMBER = r"[+\-.0-9]"
ENGLISH = r"[#%&+\-./:=>?@A-Z\\_a-z]"
NUMERALS = "〇一二三四五六七八九十零壹贰叁肆伍陆柒捌玖拾佰仟万百千亿兆"
TIME_UNITS = ("年", "月", "日", "时", "分", "秒", "点")
PUNCTUATION = ("(", ")", "（", "）", "《", "》", "【", "】", "，", "、", "！", ",", "。", "!", "；", "：")
TRIMMED = " \n\t\r"
SEED_DELIMITERS = ",.?<>[]()（），。？；：’”“‘【】《》！、|·~;'\"@$^&=-+{}! \r\n\t"

#: An alnum run, or any other single character.
ATOM = f"(?s){ALNUM}+|."


def atoms(text: Column) -> Column:
    """array<string> of alnum runs and single characters, which tile the text."""
    return F.regexp_extract_all(text, F.lit(ATOM), F.lit(0))


def char_bytes(c: Column) -> Column:
    return F.octet_length(c)


def code_points(text: Column, start: Column | int, end: Column | int) -> Column:
    """Code points between the 0-based character positions start and end."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.char_length(F.substring(text, start + 1, end - start))


def byte_offset(text: Column, k: Column) -> Column:
    """Byte offset of the k-th character (0-based)."""
    return F.octet_length(F.substring(text, F.lit(1), k))


def reverse_text(text: Column) -> Column:
    return F.reverse(text)


def english_run(text: Column) -> Column:
    return F.regexp_extract(text, f"^{ENGLISH}*", 0)


def number_run(text: Column) -> Column:
    return F.regexp_extract(text, f"^{NUMBER}*", 0)


def alnum_run(text: Column) -> Column:
    return F.regexp_extract(text, f"^{ALNUM}*", 0)


def run_kind(text: Column) -> Column:
    """'MA' where text starts with a number run, 'NX' with an English one, else null."""
    return F.when(text.rlike(f"^{NUMBER}"), "MA").when(text.rlike(f"^{ENGLISH}"), "NX")


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def split_any(text: Column, separators: str) -> Column:
    """Parts between any of the separators without empty ones; the empty text gives one empty part."""
    inside = "".join("\\" + c if c in r"\]^-[&" else c for c in separators)
    parts = F.filter(F.split(text, f"[{inside}]+"), lambda x: x != "")
    return F.when(text == "", F.array(F.lit(""))).otherwise(parts)


def starts_with(text: Column, prefix: Column, offset: Column | int = 0) -> Column:
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.substring(text, offset + 1, F.char_length(prefix)) == prefix


def ends_with(text: Column, suffix: Column) -> Column:
    return F.endswith(text, suffix)


def is_prefix_token(pattern: Column, token: Column) -> Column:
    """Whether the token is a prefix of the pattern."""
    return F.startswith(pattern, token)


def is_punctuation(token: Column) -> Column:
    return token.isin(*PUNCTUATION)


def is_alphabetic(token: Column) -> Column:
    """Whether a tag is letters only; true for the empty one."""
    return token.rlike("^[A-Za-z]*$")


def is_numeral(token: Column) -> Column:
    return token.rlike(f"^[{NUMERALS}]+$")


def url_decode(text: Column) -> Column:
    """+ as space and %XX as bytes; null where that is malformed."""
    return F.try_url_decode(text)


def inner_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def ensure_dir(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))


def combine_path(folder: Column, name: Column) -> Column:
    return F.concat(ensure_dir(inner_path(folder)), name)


def split_mark(text: Column, mark: str, most: int = -1) -> Column:
    """array<string> of what lies between marks of one or more characters, a leading empty piece too; with most, the last of
    so many pieces holds the rest."""
    return F.split(text, re.escape(mark), most)


def truncated(text: Column, size: int) -> Column:
    """The longest beginning of at most so many bytes; no character is cut."""
    state = "struct<bytes:int,chars:int>"
    zero = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")).cast(state)

    def step(x, c):
        after = x["bytes"] + F.octet_length(c)
        more = F.struct(after.alias("bytes"), F.when(after <= size, x["chars"] + 1).otherwise(x["chars"]).alias("chars")).cast(state)
        return F.when(x["bytes"] > size, x).otherwise(more)

    return F.substring(text, F.lit(1), F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), zero, step, lambda x: x["chars"]))


def upcase(text: Column) -> Column:
    """ASCII letters in upper case, all else as it is."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def is_whitespace(text: Column) -> Column:
    """Whether a text is white space of ASCII only, and not empty."""
    return text.rlike(r"^[\x20\x09-\x0D]+$")
