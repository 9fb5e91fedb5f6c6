"""What the operators of this subpackage share: checkpoints, folds, slot numbers and text slices."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: What is broadcast has at most so many bytes by its rows' width.
BROADCAST_BYTES = 8 << 20
#: glibc's names of two settings: from how many bytes on an allocation is given back when freed, and a heap's free top.
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3


#: Texts go to Python in batches of about so many bytes (see bounded()).
BATCH_BYTES = 2 << 20
#: A partition of a table of numbers holds so many rows or more, as far as there are as many partitions as cores.
PARTITION_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None, **metrics: Column) -> DataFrame:
    """Reliable checkpoint in the folder of spark.checkpoint.dir, whose rows are counted as they are written (see seen()).

    rows, the number of rows that it is made from, is given for tables of numbers: their partitions then follow it,
    so that a small one isn't written as thousands of files, whatever the number of shuffle partitions is.
    Where none is set a local session gets a temporary folder; on a cluster, whose machines don't share one, that is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir: a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS)))
    watch = Observation()
    out = df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in metrics.items()]).checkpoint(eager=True)
    out.__dict__["_seen"] = watch.get
    return out


def seen(df: DataFrame) -> dict:
    """`rows` and the metrics of a table that cut() has written."""
    return df.__dict__["_seen"]


def small(df: DataFrame, row_bytes: int = 8) -> DataFrame:
    """For a join: broadcast if its rows, counted, take at most BROADCAST_BYTES at `row_bytes` each; else as it is, so that the join shuffles."""
    if "_seen" not in df.__dict__:
        return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
    return F.broadcast(df.coalesce(1)) if seen(df)["rows"] * row_bytes <= BROADCAST_BYTES else df


def unused(docs: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as make it no column's name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def nested(docs: DataFrame) -> DataFrame:
    """One column `row` with all columns of docs, so that no helper column has a name of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def nested_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs from the column `row` of what came from nested(docs)."""
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def row_hash(docs: DataFrame) -> Column:
    """A hash of the column `row` of what came from nested(docs), maps and variants aside."""
    names = [f.name for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(F.lit(len(names)), *[F.col("row").getField(c) for c in names])


@functools.cache
def _libc():
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_MMAP_THRESHOLD, 4 << 20)
        libc.mallopt(_TRIM_THRESHOLD, 8 << 20)
        return libc
    except (OSError, AttributeError):  # another C library
        return None


def release() -> None:
    """Give freed memory back to the system: Spark reuses a Python worker in later stages, which would else add what it keeps to theirs."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


#: What kept() has made, by module and name.
_KEPT: dict[tuple[str, str], Callable] = {}


def kept(most: int) -> Callable[[Callable], Callable]:
    """A cache of up to `most` results that a Python worker keeps over its tasks, until one begins that doesn't use it (see lean())."""

    def decorate(make: Callable) -> Callable:
        _KEPT[make.__module__, make.__qualname__] = cached = functools.lru_cache(most)(make)
        return cached

    return decorate


def forget(uses: tuple[Callable, ...] = ()) -> None:
    """Empty the caches made by kept() but those in `uses`."""
    for cached in _KEPT.values():
        if not any(cached is own for own in uses):
            cached.cache_clear()


def lean(run: Callable | None = None, uses: tuple[Callable, ...] = ()) -> Callable:
    """A mapInArrow function that gives its memory back when its task ends, and what the worker keeps from other operators' tasks when it begins.

    uses: the caches, made by kept(), that it uses itself.
    """
    if run is None:
        return functools.partial(lean, uses=uses)

    @functools.wraps(run)
    def wrapped(batches):
        _libc()
        forget(uses)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def bounded(df: DataFrame) -> DataFrame:
    """df, on whose rows mapInArrow follows: they go to Python in batches of about BATCH_BYTES.

    Spark's own bound is 10,000 rows, which are as large as their texts, in the JVM and again in Python. This is a setting of the session;
    spark.sql.execution.arrow.maxBytesPerBatch stands as it is where it has been set.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's text, modulo the number of folds; 0 (never learned from) for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)), F.lit(0)).cast("int")


def hash_below(key: Column, rate: float | Column, seed: int) -> Column:
    """True for about `rate` of the keys, the same ones on every run; exact to 2**-53 of the rate, however small it is."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    # 63 bits of a hash against the rate's share of them
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1)
    return (rate >= 1) | (bits.cast("double") < rate * F.lit(float(1 << 63)))


def with_slots(df: DataFrame, groups: list[str], order: list[Column], bucket_key: Column, buckets: int, slot: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, a group never meeting in one task.

    Rows go to hash buckets; a bucket's rows are numbered by `order`, and start at the
    number of rows of the group in earlier buckets. `bucket_key` should tell the group's
    rows apart, so that they spread over the buckets.
    """
    buckets = max(1, int(buckets))
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(bucket_key), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_bucket").alias("_b2"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    same = F.col("_bucket") == F.col("_b2")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    return (
        b.withColumn("_rn", F.row_number().over(within) - 1)
        .join(starts, same, "left")
        .withColumn(slot, (F.col("_start") + F.col("_rn")).cast("long"))
        .drop("_rn", "_bucket", "_b2", "_start", *[f"_g{i}" for i in range(len(groups))])
    )


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that memory does not follow text length."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // most
        starts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [n]))
        for a, b in zip(starts[:-1], starts[1:]):
            yield batch.slice(int(a), int(b - a))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
