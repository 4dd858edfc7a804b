"""Line dedup by a log-template tree, in DataFrame functions only.

Each line is parsed at a fixed depth: its number of tokens, then its LEAD leading tokens. Tokens with a digit are the
variable field <*>, where enough other tokens stand beside them to tell the line. Below that path a line has its template
and, from SPLIT_FROM tokens on, BANDS leaves, each of which keeps one band of the tokens and leaves the others open. A
leaf is known by its first line, in the order of the documents; a line that comes to a leaf is grouped with its first line
when at least EQUAL of all positions hold the same token, so that the fields that differ are variable and the rest is the
evidence. No line waits for another, so the tree needs neither order nor a driver: a template or leaf is a 128-bit key,
and what is known of it is one row. A line is dropped where its template, or a line that it is grouped with, occurs in an
earlier document, so that each recurring passage stays once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import HOT_ROWS, SPREAD, bit_filter, dealt_join, discard, hot_keys, materialize, split_by, table

#: Leading tokens on the path to a leaf; lines without a further token have their tokens as they are for a template.
LEAD = 3
#: Lines of so many tokens have leaves; into so many bands their tokens are cut; the share of equal positions in a group.
SPLIT_FROM, BANDS, EQUAL = 10, 3, 0.8
#: At least this share of a line's tokens must stay when fields are made variable, else the fields stay as they are.
CONSTANT = 0.5
#: Documents that keep less than this share of their bytes are dropped by drop_documents.
LEAST_KEPT = 0.2
FIELD = "<*>"
#: The white space of [\x20\x09-\x0D] but for the space and the end of a line.
OTHER_SPACES = "\t\x0b\x0c\r"


def template_lines(docs: DataFrame) -> DataFrame:
    """For rows (doc_id, text, same): doc_id, same, at (line from 0), tokens (fields as FIELD), of each line with tokens."""
    plain = F.when(F.col("text").rlike(r"[\t\x0B\f\r]"), F.translate("text", OTHER_SPACES, " " * len(OTHER_SPACES))).otherwise(F.col("text"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "same", F.split(plain, "\n").alias("lines"))
    # outer, and blank lines told by themselves, as a filter on an array would have it worked out twice; no text has no line
    lines = texts.select("doc_id", "same", F.posexplode_outer("lines").alias("at", "line")).where(F.trim("line") != "")
    lines = lines.withColumn("w", F.array_remove(F.split("line", " "), ""))
    field = F.transform("w", lambda x: F.when(x.rlike("[0-9]"), F.lit(FIELD)).otherwise(x))
    lines = lines.withColumn("g", F.when((F.size("w") > LEAD) & F.col("line").rlike("[0-9]"), field))
    general = F.size(F.array_remove("g", FIELD)) >= CONSTANT * F.size("w")
    return lines.select("doc_id", "same", "at", F.when(general, F.col("g")).otherwise(F.col("w")).alias("tokens"))


def _kinds(lines: DataFrame) -> DataFrame:
    """lines once for each kind of key: 0 is a line's template, the others are the leaves of its bands."""
    kinds = F.when(F.size("tokens") >= SPLIT_FROM, F.array(*map(F.lit, range(BANDS + 1)))).otherwise(F.array(F.lit(0)))
    return lines.select("doc_id", "same", "at", "tokens", F.explode_outer(kinds).alias("kind"))


def _key(*before) -> Column:
    """A 64-bit hash of what makes a key; with something before it, another one."""
    n, kind = F.size("tokens"), F.col("kind")
    cut = lambda k: F.floor(k * n / F.lit(BANDS)).cast("int")
    begin, end = F.when(kind == 0, 0).otherwise(cut(kind - 1)), F.when(kind == 0, n).otherwise(cut(kind))
    return F.xxhash64(*before, kind, n, F.slice("tokens", 1, F.when(kind == 0, 0).otherwise(LEAD)), F.slice("tokens", begin + 1, end - begin))


def _drops(lines: DataFrame) -> DataFrame:
    """doc_id, same, at of the lines to drop, some of them more than once."""
    each = _kinds(lines).withColumn("a", _key())
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "same")
    first = each.select("doc_id", "same", "at", "a", _key(F.lit(1)).alias("b")).groupBy("a", "b")
    first = materialize(first.agg(F.min(F.struct(place.alias("place"), "at")).alias("first"), F.count("*").alias("c")).where("c > 1"))
    least = max(HOT_ROWS, lines.count() // SPREAD)
    hot = [(r["a"], math.ceil(r["c"] / least)) for r in first.where(F.col("c") > least).groupBy("a").agg(F.max("c").alias("c")).collect()]  # (BANDS + 1) * SPREAD at most
    several, _ = split_by(each, "a", bit_filter(first, "a"))  # most lines have no key that another one has
    several = several.select("doc_id", "same", "at", "kind", "a", _key(F.lit(1)).alias("b"))
    again = dealt_join(several, first.drop("c"), "a", "same", hot, also=("b",)).where(F.col("first.place") < place)
    its = F.struct(F.col("first.place.same").alias("same"), F.col("first.at").alias("at"))
    again = materialize(again.select("doc_id", F.struct("same", "at").alias("line"), "kind", its.alias("its")))
    discard(first)
    exact = again.where("kind = 0").select("doc_id", "line")
    grouped = materialize(again.where("kind > 0").join(exact.select("line"), "line", "left_anti").select("doc_id", "line", "its").distinct())
    needed = grouped.select(F.explode(F.array("line", "its")).alias("line")).distinct().withColumn("h", F.xxhash64("line"))
    tokens, _ = split_by(lines.withColumn("line", F.struct("same", "at")).withColumn("h", F.xxhash64("line")), "h", bit_filter(needed, "h"))
    tokens = materialize(tokens.join(needed.select("line"), "line", "left_semi").groupBy("line").agg(F.any_value("tokens").alias("tokens")))
    pairs = grouped.join(tokens, "line")
    pairs = dealt_join(pairs, tokens.select(F.col("line").alias("its"), F.col("tokens").alias("others")), "its", "line", hot_keys(grouped, "its"))
    equal = F.size(F.filter(F.zip_with("tokens", "others", lambda a, b: a == b), lambda x: x))
    alike = pairs.where(equal >= EQUAL * F.size("tokens")).select("doc_id", "line")
    out = materialize(exact.unionAll(alike).select("doc_id", "line.*"))
    for x in (again, grouped, tokens):
        discard(x)
    return out


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with text reduced to the lines that stay, and n_lines, n_dropped, kept_share added.

    A line is dropped when an earlier document has its template, or an earlier document's line is the first of a leaf of
    it and equal in EQUAL of all positions. Documents are in order of their ids, those without id last, then of a hash of
    id and text: rows with one id or without one count as documents of their own, but rows equal in both are left as they
    are, and so are lines repeated within one document. Lines of white space only stay. kept_share is the share of bytes
    that stay. Null texts stay null and empty ones empty, with 0 or 1 lines. An empty table gives no rows; all other
    columns are kept as they are, and columns named like an added one are replaced. Texts and lines may be of any length.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_share")
    columns = docs.columns
    # the row as one value, so that no name of its columns can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("same"))
    lines = materialize(template_lines(rows))
    drops = _drops(lines)
    discard(lines)
    # only texts that may lose a line are moved to their drops
    moved, stay = split_by(rows, "same", bit_filter(drops, "same"))
    drops = drops.groupBy("doc_id", "same").agg(F.array_sort(F.collect_set("at")).alias("drops")).toDF("its_id", "its_same", "drops")  # at most the lines of a document
    moved = moved.join(drops, (F.col("same") == F.col("its_same")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left").drop("its_id", "its_same")
    out = moved.unionByName(stay.withColumn("drops", F.lit(None).cast("array<int>")))
    out = out.withColumn("drops", F.coalesce("drops", F.array().cast("array<int>")))
    breaks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("drops", i)), "\n")
    out = out.select(
        "row", "text", F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"),
        F.when(F.size("drops") == 0, F.col("text")).otherwise(left).alias("stay"),
    )
    share = F.when(F.col("n_dropped") == 0, 1.0).otherwise(F.octet_length("stay") / F.octet_length("text"))
    return out.select(*(F.col("stay").alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in columns), "n_lines", "n_dropped", share.alias("kept_share"))


def drop_documents(deduped: DataFrame, least: float = LEAST_KEPT) -> DataFrame:
    """Without the documents of which too little stayed, and without the added columns; n_chars, if any, is renewed."""
    out = deduped.where(F.col("kept_share") >= least)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.drop("n_lines", "n_dropped", "kept_share")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_dropped", (F.col("kept_share") >= LEAST_KEPT).alias("kept"))


QUERIES = {"op2_line_dedup": op2_line_dedup}

# lines compared word by word: equal ones of earlier documents, and those equal in EQUAL of all places to the earliest line
# with the same number of words, the same leading words and the same words in one third
_WORDS_SQL = r"[^\x20\x09-\x0D]+"
DEDUPED_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL
), raw AS (
  SELECT doc_id, line, ln, regexp_extract_all(line, '{_WORDS_SQL}') AS w FROM lines
), masked AS (
  SELECT *, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) AS g FROM raw
), words AS (
  SELECT doc_id, ln, CASE WHEN len(w) > {LEAD} AND 2 * len(list_filter(g, lambda x: x <> '{FIELD}')) >= len(w) THEN g ELSE w END AS t FROM masked WHERE len(w) > 0
), equal AS (
  SELECT a.doc_id, a.ln FROM words a JOIN (SELECT t, min(doc_id) AS first FROM words GROUP BY t) b ON a.t = b.t AND b.first < a.doc_id
), thirds AS (
  SELECT doc_id, ln, t, len(t) AS n, t[1:{LEAD}] AS lead, k, t[len(t) * k // {BANDS} + 1:len(t) * (k + 1) // {BANDS}] AS third FROM words, range({BANDS}) r(k) WHERE len(t) >= {SPLIT_FROM}
), heads AS (
  SELECT n, lead, k, third, arg_min(t, (doc_id, ln)) AS head, min(doc_id) AS first FROM thirds GROUP BY n, lead, k, third
), alike AS (
  SELECT doc_id, ln FROM thirds JOIN heads USING (n, lead, k, third)
  WHERE first < doc_id AND len(list_filter(list_zip(t, head), lambda p: p[1] = p[2])) >= {EQUAL} * n
), drops AS (SELECT * FROM equal UNION SELECT * FROM alike),
parts AS (
  SELECT doc_id, count(*) AS n_lines, count(drops.ln) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (drops.ln IS NULL), '') AS text
  FROM lines LEFT JOIN drops USING (doc_id, ln) GROUP BY doc_id
)"""

ORACLE = {
    "op2_line_dedup": DEDUPED_SQL
    + f"""
SELECT doc_id, parts.text, n_lines, n_dropped, n_dropped = 0 OR strlen(parts.text) / strlen(documents.text) >= {LEAST_KEPT} AS kept FROM parts JOIN documents USING (doc_id)"""
}
