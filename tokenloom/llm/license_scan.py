"""Licence scans by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of a text are joined to the places of the same k-grams in the templates, a fixed table of
a few hundred rows: 2-grams of the phrases, 3-grams of the notices, whose leading 2-gram is what is hashed. The join
compares the words themselves too. Each hit votes for its diagonal, the difference of the two places. Neighbouring
diagonals are merged: from each diagonal on, those up to a template's gap further make a span. Spans are verified: a
phrase needs all of its 2-grams on one diagonal; a notice needs LEAST of its words, a short one all, in 3-grams whose
places in text and template rise together. As the diagonals of a span differ by the gap at most, so does its extent from
the template's.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import LOWER, UPPER, materialize, table

#: What is no word: ASCII but for digits and letters.
SEPARATORS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())
#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed public notices and their labels; found where most of their words stand in order, though some were changed.
NOTICES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "mit-released": "released under the mit license",
    "all-rights-reserved": "all rights reserved",
}
#: Words in a k-gram of a phrase and of a notice; the share of a notice's words that must be found; the diagonals that are
#: merged, at most and one for each so many words of the notice.
PHRASE_GRAM, NOTICE_GRAM = 2, 3
LEAST, GAP, WORDS_PER_GAP = 0.8, 3, 8
#: Notices of fewer words must be found whole: one word makes another licence of them.
WHOLE_BELOW = 16


def words_of(text):
    """Words of text, lower-case A-Z; null counts as empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _sources() -> list[tuple[int, str, bool, list[str]]]:
    """Number, label, whether it is a base phrase, and words of each template."""
    texts = [(label, True, text) for text, label in PHRASES.items()] + [(label, False, text) for label, text in NOTICES.items()]
    return [(i, label, base, text.split()) for i, (label, base, text) in enumerate(texts)]


def _gap(words: int) -> int:
    return min(GAP, words // WORDS_PER_GAP)


def _needed(words: int) -> int:
    return words if words < WHOLE_BELOW else math.ceil(LEAST * words)


def templates(spark: SparkSession) -> DataFrame:
    """template, label, base, words, needed, gap, place, tx, ty, tz (null in a 2-gram): some 250 rows, and one that each text meets."""
    rows = [(-1, "", False, 0, 0, 0, 0, None, None, None)]
    for i, label, base, w in _sources():
        k = PHRASE_GRAM if base else NOTICE_GRAM
        rows += [(i, label, base, len(w), _needed(len(w)), _gap(len(w)), at, w[at], w[at + 1], None if base else w[at + 2]) for at in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, words int, needed int, gap int, place int, tx string, ty string, tz string")


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    and spans: array of (label, first_word, last_word, share) of verified spans, phrases and notices.

    n_base counts all places of the phrases, first_word and last_word are their least and greatest starts (null if
    none). score is the greatest share of a template's words found. Of overlapping spans of one notice the one with the
    greatest share counts, then the first. Null and empty texts have 0 words, no labels and score 0. Repeated rows each
    give a row, null doc_ids are returned, an empty table gives no rows, other columns are ignored. Texts of any length
    are scanned whole.
    """
    same = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("b"))
    texts = docs.select("doc_id", same.alias("same"), words_of(F.col("text")).alias("w"))
    # one more word in front, so that each text has a row that meets the templates' own, and is read once only
    words = F.concat(F.array(F.lit("")), F.col("w"))
    grams = F.arrays_zip(words.alias("x"), F.col("w").alias("y"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("z"))
    grams = texts.select("doc_id", "same", F.size("w").alias("n"), F.posexplode_outer(grams).alias("at", "g")).select("doc_id", "same", "n", "at", "g.*")
    grams = grams.toDF("doc_id", "same", "n", "at", "x", "y", "z").where("y IS NOT NULL OR at = 0")
    grams = grams.withColumn("h", F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("x", "y")))
    places = templates(docs.sparkSession).withColumn("h", F.when(F.col("template") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("tx", "ty")))
    differs = F.coalesce(F.col("x") != F.col("tx"), F.lit(False)) | F.coalesce(F.col("y") != F.col("ty"), F.lit(False)) | ~F.coalesce(F.col("z") == F.col("tz"), F.col("tz").isNull())
    hits = grams.join(F.broadcast(places), "h").where(~differs & ((F.col("at") == 0) == (F.col("template") < 0)))  # fixed size
    hits = materialize(hits.select("doc_id", "same", "n", "template", "label", "base", "words", "needed", "gap", "place", (F.col("at") - 1).alias("at")))
    return _scanned(hits)


def _covered(votes):
    """Words of the template in 3-grams whose places rise together. votes: (place, at), the least at of each place, in order."""
    state = "struct<reach:int,last:int,words:int>"
    zero = F.struct(F.lit(-1).alias("reach"), F.lit(-NOTICE_GRAM).alias("last"), F.lit(0).alias("words")).cast(state)

    def step(x, v):
        rises = v["at"] > x["reach"]
        more = F.least(F.lit(NOTICE_GRAM), v["place"] - x["last"])
        return F.struct(
            F.greatest(x["reach"], v["at"]).alias("reach"), F.when(rises, v["place"]).otherwise(x["last"]).alias("last"), F.when(rises, x["words"] + more).otherwise(x["words"]).alias("words")
        ).cast(state)

    return F.aggregate(votes, zero, step, lambda x: x["words"])


def _scanned(hits: DataFrame) -> DataFrame:
    # copies of a row vote once: the votes are distinct places
    votes = hits.where("template >= 0").select("same", "template", "label", "base", "words", "needed", "gap", (F.col("at") - F.col("place")).alias("diagonal"), "place", "at").distinct()
    exact = (
        votes.where("base").groupBy("same", "label", "base", "words", "diagonal").agg(F.count("*").alias("votes")).where(F.col("votes") == F.col("words") - PHRASE_GRAM + 1)
        .select("same", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("words") - 1).alias("last"), F.lit(1.0).alias("share"))
    )
    by = ("same", "template", "label", "base", "words", "needed", "gap", "start")
    merged = (
        votes.where("NOT base")
        .withColumn("start", F.explode(F.sequence(F.col("diagonal") - F.col("gap"), "diagonal")))
        .groupBy(*by, "place").agg(F.min("at").alias("at"))
        .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "at"))).alias("votes"), F.min(F.col("at") - F.col("place")).alias("least"), F.min("at").alias("first"), F.max("at").alias("last"))
        .where("least = start")  # from a diagonal with votes on
        .withColumn("covered", _covered(F.col("votes")))
        .where("covered >= needed")
        .withColumn("share", F.col("covered") / F.col("words"))
    )
    near = Window.partitionBy("same", "template").orderBy("start")
    merged = merged.withColumn("new", F.coalesce(F.col("start") - F.lag("start").over(near) > F.col("gap"), F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(near))
    best = F.max_by(F.struct("first", (F.col("last") + NOTICE_GRAM - 1).alias("last"), "share"), F.struct("share", -F.col("start")))
    merged = merged.groupBy("same", "template", "label", "base", "span").agg(best.alias("b")).select("same", "label", "base", "b.first", "b.last", "b.share")
    label = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    found = exact.union(merged).groupBy("same").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        label(F.col("base")).alias("base_labels"),
        label(F.lit(True)).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct(F.col("first").alias("first_word"), F.col("last").alias("last_word"), "label", "share"))).alias("spans"),
    )
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    out = hits.where("template < 0").select("doc_id", "same", F.col("n").cast("long").alias("n_words")).join(found, "same", "left")
    return out.select("doc_id", "n_words", *(F.coalesce(c, none[c]).alias(c) if c in none else F.col(c) for c in found.columns if c != "same"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op9_license_scan": op9_license_scan}

_VALUES = ", ".join(f"({i}, '{label}', {base}, {[str(x) for x in w]}, {_needed(len(w))}, {_gap(len(w))})" for i, label, base, w in _sources())
_RE2 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE = {
    "op9_license_scan": rf"""
WITH templates(template, label, base, t, needed, gap) AS (VALUES {_VALUES}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_RE2}') AS w FROM documents),
-- phrases: a slice of the text that is the phrase
phrases AS (
  SELECT doc_id, label, i - 1 AS start FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words)
  JOIN (SELECT * FROM templates WHERE base) p ON p.t[1] = w[i] AND w[i:i + len(t) - 1] = t
),
-- notices: for each offset of the text against the notice, where each of its 3-grams is found first from there on
grams AS (SELECT template, label, t, needed, gap, unnest(range(1, len(t) - 1)) AS p FROM templates WHERE NOT base),
known AS (SELECT DISTINCT t[p] AS a, t[p + 1] AS b, t[p + 2] AS c FROM grams),
spots AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
few AS (SELECT spots.* FROM spots SEMI JOIN known USING (a, b, c)),
met AS (SELECT doc_id, template, label, len(t) AS n, needed, gap, p, i, i - p AS d FROM few JOIN grams ON t[p] = a AND t[p + 1] = b AND t[p + 2] = c),
offsets AS (SELECT DISTINCT doc_id, template, d AS s FROM met),
firsts AS (SELECT m.doc_id, m.template, label, n, needed, gap, s, p, min(i) AS i FROM met m JOIN offsets o ON o.doc_id = m.doc_id AND o.template = m.template AND d BETWEEN s AND s + gap GROUP BY ALL),
rising AS (SELECT * FROM (SELECT *, max(i) OVER (PARTITION BY doc_id, template, s ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM firsts)
           WHERE before IS NULL OR i > before),
-- words of the notice that such 3-grams hold
counts AS (SELECT doc_id, template, label, n, needed, s, count(DISTINCT p + k) AS c FROM rising, range(3) r(k) GROUP BY doc_id, template, label, n, needed, s),
held AS (SELECT doc_id, label, c / n AS share FROM counts WHERE c >= needed),
spans AS (
  SELECT doc_id, label, true AS base, start, 1.0::DOUBLE AS share FROM phrases
  UNION ALL SELECT doc_id, label, false, NULL, share FROM held
), found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM spans GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN found USING (doc_id)"""
}
