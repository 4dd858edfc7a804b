"""Token typing and merging as column expressions over rows (key, k, word)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import tags
from tokenloom.functions.chars import ENGLISH, NUMBER, NUMERALS, TIME_UNITS


def number_tag(w: Column, following: Column) -> Column:
    c = lambda i: F.substring(w, i + 1, 1)
    n = F.octet_length(w)
    phone = ((n == 11) & (c(0) == "1") & c(1).between("3", "8")) | ((n == 12) & ((c(3) == "-") | (c(4) == "-")))
    ten = (n == 10) & (c(4) == "-") & (c(7) == "-") & (c(5) <= "1") & (c(8) <= "3")
    nine = (n == 9) & (c(4) == "-") & (((c(6) == "-") & (c(7) <= "3")) | ((c(7) == "-") & (c(5) <= "3")))
    unit = (n <= 4) & F.coalesce(following.isin(*TIME_UNITS), F.lit(False))
    return F.when(phone, tags.MP).when(ten | nine | unit, tags.T).otherwise(tags.MA)


CLOCK = r"^([0-9]{1,2}:[0-9]{2}(:[0-9]{2})?|[0-9]{4}/[01][0-9]/[0-3][0-9])$"


def type_of(w: Column, following: Column | None = None, extended_time: bool = False) -> Column:
    """Tag by form, NONE for other words; with extended_time, clock times and slash dates too."""
    following = F.lit(None).cast("string") if following is None else following
    url = (F.octet_length(w) > 5) & w.rlike(r"^(http:/|www\.|mail\.|ftp://)|\.(com|net|cn|org)$")
    return (
        F.when(w.rlike(f"^{NUMBER}+$"), number_tag(w, following))
        .when(F.lit(extended_time) & w.rlike(CLOCK), tags.T)
        .when(w.rlike(f"^{ENGLISH}+$"), F.when(url, tags.URL).otherwise(tags.NX))
        .when(w.rlike(f"^[{NUMERALS}]+$"), tags.MC)
        .otherwise(tags.NONE)
    )


def typed(rows: DataFrame, key: str = "key", extended_time: bool = False) -> DataFrame:
    """rows (key, k, word) with pos; the next token is looked at within a key. A pos that rows have stays where no form is told."""
    form = type_of(F.col("word"), F.lead("word").over(Window.partitionBy(key).orderBy("k")), extended_time)
    return rows.withColumn("pos", F.when(form == tags.NONE, F.col("pos")).otherwise(form) if "pos" in rows.columns else form)


def merged(rows: DataFrame, key: str = "key", compat: bool = False) -> DataFrame:
    """Typed rows with runs of equal MA or MC tokens as one: key, k (of the first), word, pos, and start and end where rows
    have them. With those, tokens may overlap, and the word is what lies between its ends (char_start, char_end tell how
    they do). compat: a merged or moved MA or MC token has the tag of the input token at its new place, as the model
    implementation does."""
    order = Window.partitionBy(key).orderBy("k")
    number = F.col("pos").isin(tags.MA, tags.MC)
    joins = F.coalesce(number & (F.col("pos") == F.lag("pos").over(order)), F.lit(False))
    island = F.sum(F.when(joins, 0).otherwise(1)).over(order)
    spans = "start" in rows.columns
    ends = ["start", "end", "char_start", "char_end"] if spans else []
    runs = rows.withColumn("island", island).groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("k", "word", "pos", *ends))).alias("run"))
    first, last = F.get("run", F.lit(0)), F.element_at("run", -1)
    if spans:  # what is known of the text from the run's start on, cut at its end
        longer = lambda w, x: F.concat(w, F.substring(x["word"], F.char_length(w) - (x["char_start"] - first["char_start"]) + 1, F.char_length(x["word"])))
        reach = lambda w, x: F.when(x["char_end"] - first["char_start"] > F.char_length(w), longer(w, x)).otherwise(w)
        word = F.substring(F.aggregate("run", F.lit(""), reach), F.lit(1), last["char_end"] - first["char_start"])
        word = F.when(F.size("run") == 1, first["word"]).otherwise(word)
    else:
        word = F.array_join(F.transform("run", lambda x: x["word"]), "")
    both = [first["start"].alias("start"), last["end"].alias("end")] if spans else []
    out = runs.select(key, "island", first["k"].alias("k"), word.alias("word"), first["pos"].alias("pos"), *both)
    if compat:  # islands are numbered from 1, tokens from 0
        there = rows.select(key, (F.row_number().over(order)).alias("island"), F.col("pos").alias("__there"))
        out = out.join(there, [key, "island"], "left").withColumn("pos", F.when(number, F.col("__there")).otherwise(F.col("pos"))).drop("__there")
    return out.drop("island")
