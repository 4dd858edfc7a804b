"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under hashed byte-trigram models (tempered, as neighbouring
trigrams are not independent), the declared language's likelihood given each language, the address suffix's likelihood
given each language, and a prior of the host. The latter three come from grouped counts of the text-only decisions over
all rows; a host's prior is smoothed towards its domain's, and that towards the whole corpus's. A uniform model stands
for text of no language. The languages are those that enough rows declare; a row that declares another is left to itself,
as its language has no model that it could be told by.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import materialize, table

OTHER = "und"
#: A declared value is a language if so many rows with text declare it, and it is among so many most declared ones.
LEAST_ROWS, MOST_LANGUAGES = 50, 128
#: Labelled rows that the text models are fitted on, expected for each language; the rows are chosen by a hash of their id.
SAMPLE = 2_000
BUCKETS = 4096
#: Trigrams that count in full; the evidence of a longer text is scaled down to so many, a third each.
EVIDENCE = 600
#: What the uniform model loses a trigram, so that only clear noise is taken for no language.
HANDICAP = 0.5
#: Rows that a domain's or the corpus's shares weigh in a host's prior.
STRENGTH = 20.0
LEAST_PROBABILITY = 0.5
#: Rows without texts in a file between two passes: some 4 MB for four languages.
ROWS_A_FILE = 100_000


#: ASCII letters in lower case, other bytes of UTF-8 as they are, and a space for everything else.
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def trigram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams with at most one space: digits, signs and addresses are no evidence."""
    a = np.frombuffer((" " + (text or "") + " ").encode().translate(_LETTERS), np.uint8).astype(np.uint32)
    space = (a == 32).astype(np.int8)
    h = (a[:-2] * 9973 + a[1:-1] * 263 + a[2:]) % BUCKETS
    return h[space[:-2] + space[1:-1] + space[2:] < 2].astype(np.int64)


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for t, lang in zip(b.column("text"), b.column("declared").to_pylist()):
            sums[lang] = sums.get(lang, 0) + np.bincount(trigram_buckets(t.as_py()), minlength=BUCKETS)
    for lang, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["declared", "bucket", "n"])


def declared_code(declared):
    """The primary subtag of a declared language in lower case; null where there is none."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(declared.cast("string"), r"^[^_-]*", 0))), F.lit(""))


def declared_languages(rows: DataFrame) -> dict[str, int]:
    """Rows of each language that enough rows (declared, text) declare, most declared first, then by name."""
    counts = rows.where("text RLIKE '\\\\p{L}' AND declared IS NOT NULL").groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    return dict(map(tuple, counts.orderBy(F.desc("n"), "declared").limit(MOST_LANGUAGES).collect()))


def text_models(rows: DataFrame, sizes: dict[str, int], sample: int = SAMPLE) -> np.ndarray:
    """log P(bucket | language), one column for each of sizes and a uniform one last, from a bounded sample of declared rows."""
    languages = list(sizes)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    chosen = [(F.col("declared") == k) & (share < sample / n) for k, n in sizes.items()]
    counts = np.zeros((BUCKETS, len(languages)))
    if chosen:
        got = rows.where(F.col("text").isNotNull() & reduce(lambda a, b: a | b, chosen)).select("text", "declared").mapInArrow(_count, "declared string, bucket int, n long")
        for lang, bucket, n in got.groupBy("declared", "bucket").agg(F.sum("n")).collect():  # BUCKETS rows a language at most
            counts[bucket, languages.index(lang)] = n
    p = (counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)
    return np.hstack((np.log(p), np.full((BUCKETS, 1), -math.log(BUCKETS) - HANDICAP)))


def _likelihoods(model: np.ndarray):
    def run(batches):
        keep = ["id", "same", "declared", "host"]
        for b in batches:
            logs, sizes = [], []
            for t in b.column("text"):
                at = trigram_buckets(t.as_py())
                x = (np.bincount(at, minlength=BUCKETS) @ model) if len(at) > 200 else model[at].sum(0)
                logs.append(x / 3 * min(1.0, EVIDENCE / max(1, len(at))))
                sizes.append(sum(map(str.isalpha, (t.as_py() or "")[:64])) or sum(map(str.isalpha, t.as_py() or "")))
            cols = pa.array([x.tolist() for x in logs], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), cols, pa.array(sizes, pa.int64())], [*keep, "logs", "letters"])

    return run


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def language_id(rows: DataFrame, languages=None, sample: int = SAMPLE) -> DataFrame:
    """One row per row of rows (id, text, declared, host): id, same, declared, predicted, probability, kept.

    languages are those told apart, by default the declared ones (declared_languages); declared is returned as its
    primary subtag in lower case. same is xxhash64 of id and text, for joining the decisions back together with id. Null
    hosts, suffixes and declared languages are values like others, so they carry the evidence that the counts give them.
    A text without letters (null and empty ones too) is "und" with probability 1 and is not kept. A text with letters
    whose declared language is none of languages is "und" too, but kept, with a null probability, as is every text with
    letters where there are no languages. Of the others, those whose best language is "und" or has less than
    LEAST_PROBABILITY are not kept. Ties go to the language named first. Texts are judged whole, however long. Repeated
    rows each give a row, an empty table gives no rows, other columns are ignored.
    """
    rows = rows.withColumn("declared", declared_code(F.col("declared")))
    sizes = declared_languages(rows)
    if languages is not None:
        found = rows.where(F.col("declared").isin(*languages)).groupBy("declared").count()
        sizes = dict.fromkeys(languages, 1) | dict(map(tuple, found.collect()))
    names, k = [*sizes, OTHER], len(sizes) + 1
    model = text_models(rows, sizes, sample)
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.select("id", F.xxhash64("id", "text").alias("same"), F.coalesce("declared", F.lit("")).alias("declared"), F.coalesce("host", F.lit("")).alias("host"), "text").mapInArrow(
        _likelihoods(model), f"id {kind}, same long, declared string, host string, logs array<double>, letters long"
    )
    # Written to files by the number of rows, as a split's rows are few bytes without their texts and a shuffle partition's
    # may be fewer; on a local file system an executor starts a process for each file that it makes.
    files = math.ceil(rows.count() / ROWS_A_FILE) or 1
    scored = materialize(scored.repartition(files))
    domain = F.substring_index("host", ".", -2)
    suffix = F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -1)).otherwise("")
    scored = scored.withColumn("domain", domain).withColumn("suffix", suffix)
    best = lambda c: F.array_position(c, F.array_max(c)).cast("int") - 1
    groups = scored.where("letters > 0").withColumn("guess", best(F.col("logs"))).groupBy("host", "domain", "suffix", "declared", "guess").agg(F.count("*").alias("n"))
    groups = materialize(groups.coalesce(files))
    by = lambda *keys: groups.groupBy(*keys).agg(F.array(*(F.sum(F.when(F.col("guess") == i, F.col("n")).otherwise(0)) for i in range(k))).alias("c"))
    whole = by().first()["c"]
    whole = [float(x or 0) for x in whole]
    top = [(x + 1) / (sum(whole) + k) for x in whole]
    smooth = lambda c, prior: F.transform(c, lambda x, i: (x + STRENGTH * F.get(prior, i)) / (F.aggregate(c, F.lit(0).cast("long"), lambda a, y: a + y) + STRENGTH))
    constants = F.array(*map(F.lit, top))
    domains = by("domain").select("domain", smooth(F.col("c"), constants).alias("shares"))
    hosts = by("host", "domain").join(domains, "domain").select("host", smooth(F.col("c"), F.col("shares")).alias("prior"))

    def given(key):
        """log P(value | language), smoothed, of each value of key."""
        distinct = groups.select(key).distinct().count() + 1
        return by(key).select(key, F.transform("c", lambda x, i: F.log((x + 1) / (F.get(F.array(*map(F.lit, whole)), i) + distinct))).alias(f"by_{key}"))

    out = scored.join(hosts, "host", "left").join(given("declared"), "declared", "left").join(given("suffix"), "suffix", "left")
    zero = F.array(*[F.lit(0.0)] * k)
    prior = F.coalesce("prior", constants)
    declared, ending = F.coalesce("by_declared", zero), F.coalesce("by_suffix", zero)
    out = out.withColumn("logs", F.transform("logs", lambda x, i: x + F.log(F.get(prior, i)) + F.get(declared, i) + F.get(ending, i)))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logs")))
    letters, declares = F.col("letters") > 0, F.col("declared") != ""
    strange = letters & ((declares & ~F.col("declared").isin(names[:-1])) | F.lit(k == 1))
    out = out.withColumn("probability", F.when(strange, None).when(letters, 1 / mass).otherwise(1.0))
    out = out.withColumn("predicted", F.when(letters & ~strange, F.get(F.array(*map(F.lit, names)), best(F.col("logs")))).otherwise(OTHER))
    kept = strange | ((F.col("predicted") != OTHER) & (F.col("probability") >= LEAST_PROBABILITY))
    return out.select("id", "same", F.nullif("declared", F.lit("")).alias("declared"), "predicted", "probability", kept.alias("kept"))


def document_rows(docs: DataFrame) -> DataFrame:
    """documents as rows for language_id: lang is what is declared, source the host."""
    return docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.lower("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """pages as rows for language_id: the text between tags, the html element's lang, and the address's host."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)), F.lit(""))
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), declared.alias("declared"), F.nullif(host_of(F.col("url")), F.lit("")).alias("host"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(document_rows(table(spark, sf_dir, "documents"))).drop("same").withColumnRenamed("id", "doc_id")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, where all four kinds of evidence exist."""
    return language_id(page_rows(table(spark, sf_dir, "pages"))).drop("same").withColumnRenamed("id", "page_id")


QUERIES = {"op1_language_id": op1_language_id, "pages_language_id": pages_language_id}
