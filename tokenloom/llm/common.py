"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of whole texts that the JVM sends to a Python worker at once.
ROWS_AT_ONCE = "1000"
#: A key with more than one in SPREAD of a join's rows, and at least HOT_ROWS, is dealt over several tasks.
SPREAD, HOT_ROWS = 512, 2048
_written: dict[str, tuple] = {}
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches have fewer rows than by default: a row is a whole text here, and the JVM and the worker
    each hold batches several times over. A setting of one's own stays, and the session's is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if before == "10000":
        spark.conf.set(key, ROWS_AT_ONCE)
    try:
        yield
    finally:
        if before == "10000":
            spark.conf.unset(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share. Where it is unset, one of our own if the session
    runs on this machine alone, else an error: executors would each write to a disk of their own."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tokenloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors. The files go with
    discard(), release(), or the end of the JVM, whichever comes first."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tokenloom-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    _written[path] = files, at
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    files.deleteOnExit(at)  # also where the session has been stopped before
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _delete(path: str) -> None:
    if found := _written.pop(path, None):
        with contextlib.suppress(Exception):
            found[0].delete(found[1], True)


def discard(df: DataFrame | None) -> None:
    """Deletes the files of a table that materialize() gave, once nothing reads it any more."""
    if df is not None and (path := _paths.pop(df, None)):
        _delete(path)


def same_files(df: DataFrame, written: DataFrame) -> DataFrame:
    """df, which reads what materialize() gave as written, for discard()."""
    if path := _paths.get(written):
        _paths[df] = path
    return df


@atexit.register
def release() -> None:
    """Deletes all that materialize() has written and that is not discarded yet; for use when the results have been read."""
    for path in list(_written):
        _delete(path)


def hot_keys(df: DataFrame, key: str, rows: int | None = None) -> list[tuple]:
    """(key, parts) of the keys that a join of df, of so many rows, should deal over several tasks: at most SPREAD."""
    rows = df.count() if rows is None else rows
    if rows <= HOT_ROWS:
        return []
    return hot_counts(df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("c")), rows)


def hot_counts(counts: DataFrame, rows: int) -> list[tuple]:
    """hot_keys() where the rows of each key are counted already: (k, c)."""
    least = max(HOT_ROWS, rows // SPREAD)
    return [(r["k"], math.ceil(r["c"] / least)) for r in counts.where(F.col("c") > least).collect()]


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, hot: list[tuple], how: str = "inner", also: tuple = ()) -> DataFrame:
    """left.join(right, [key, *also], how) for a right that has each key once: rows of the hot keys are dealt over as many tasks as
    hot says, by a hash of the column by, and right's row of such a key goes to each of them."""
    if not hot:
        return left.join(right, [key, *also], how)
    spark, kind = left.sparkSession, left.schema[key].dataType.simpleString()
    parts = F.broadcast(spark.createDataFrame(hot, f"{key} {kind}, __parts int"))  # at most SPREAD rows
    n = F.coalesce("__parts", F.lit(1))
    left = left.join(parts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), n).cast("int")).drop("__parts")
    right = right.join(parts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
    return left.join(right, [key, *also, "__salt"], how).drop("__salt")


#: Bits of a filter; a full one lets all rows through.
FILTER_BITS = 1 << 23


def bit_filter(df: DataFrame, h: str) -> DataFrame:
    """(__word, __bits): which values of a 64-bit hash df has; FILTER_BITS / 64 rows at most, for split_by."""
    return df.groupBy(F.pmod(F.shiftright(h, 6), F.lit(FILTER_BITS // 64)).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{h}` & 63 AS int))")).alias("__bits"))


def split_by(df: DataFrame, h: str, filter_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose hash the filter may have, and those whose it has not, without a shuffle."""
    word = F.pmod(F.shiftright(h, 6), F.lit(FILTER_BITS // 64))
    met = F.coalesce(F.col("__bits").bitwiseAND(F.expr(f"shiftleft(1L, cast(`{h}` & 63 AS int))")) != 0, F.lit(False))
    held = df.withColumn("__word", word).join(F.broadcast(filter_), "__word", "left")
    return held.where(met).drop("__word", "__bits"), held.where(~met).drop("__word", "__bits")


def most_frequent(counts: DataFrame, key: str, n: str, limit: int) -> list[tuple]:
    """(key, n) of the most frequent keys, most frequent first, then by key: at most limit.

    Counts are taken by classes (sixteenths of a doubling), so that what reaches the driver is bounded by limit and not,
    as with a sort and limit, by limit times the partitions. Of the first class that does not fit, the keys come that a
    hash draws, so that a flat distribution gives some limit keys too.
    """
    kind, most = F.floor(F.log2(F.col(n)) * 16), 1 << 20
    sizes = sorted(map(tuple, counts.groupBy(kind.alias("k")).agg(F.count("*")).collect()), reverse=True)  # some 1,000 at most
    total, at, share = 0, None, 0
    for at, size in sizes:
        share = min(most, (limit - total) * most // size)
        total += size
        if total >= limit:
            break
    if at is None:
        return []
    drawn = F.pmod(F.xxhash64(key), F.lit(most)) < share
    rows = [(r[0], r[1]) for r in counts.where((kind > at) | ((kind == at) & drawn)).select(key, n).collect()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:limit]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
