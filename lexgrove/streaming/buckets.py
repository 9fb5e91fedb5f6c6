"""A keyed table in buckets: an increment rewrites the buckets of its changed keys alone, and compares digests, not bodies."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: What says which folder holds a bucket in a version of the table.
MANIFEST = "version int, bucket int, folder int, rows long, buckets int"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digest(body: Column) -> Column:
    """Digest of a body; a null body is not an empty one."""
    return F.sha2(F.concat(F.when(body.isNull(), "n").otherwise("b"), F.coalesce(body.cast("string"), F.lit(""))).cast("binary"), 256)


def _manifest(spark: SparkSession, path: str) -> list[Row]:
    """The rows of the newest version: one a bucket, so the driver holds as many as there are buckets. None before the first load."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    newest = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == newest).collect() if newest is not None else []


def _folders(manifest: list[Row], path: str, buckets: set[int] | None = None) -> list[str]:
    return [f"{path}/data/v{r.folder}/_bucket={r.bucket}" for r in sorted(manifest, key=lambda r: r.bucket) if r.rows and (buckets is None or r.bucket in buckets)]


def version(spark: SparkSession, path: str) -> int:
    """The table's version; 0 is the empty table."""
    return max((r.version for r in _manifest(spark, path)), default=0)


def read(spark: SparkSession, path: str, shape: str, keys: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The table's rows; with keys, the buckets of those alone (their rows of other keys included)."""
    manifest = _manifest(spark, path)
    wanted = None
    if keys is not None and manifest:
        wanted = {r[0] for r in keys.select(bucket_of(F.col(key), manifest[0].buckets)).distinct().collect()}
    folders = _folders(manifest, path, wanted)
    return spark.read.schema(shape).parquet(*folders) if folders else spark.createDataFrame([], shape)


def merge(spark: SparkSession, path: str, new: DataFrame, key: str, body: str, buckets: int = 256) -> int:
    """Put an increment (one row a key; null keys are left out) into the table at `path`; the version that holds then.

    Keys and digests of the touched buckets are read and compared; rows that are as they were change nothing, and an increment of such rows alone
    writes nothing. Else the buckets of the changed keys are written to the new version's folder, and then the
    manifest, in which the others keep their folders: a run lost before that leaves the old version whole, and is done again over the same folder.
    The number of buckets is that of the first load; it follows the table's size, so that a bucket is a task's work.
    """
    manifest = _manifest(spark, path)
    many = manifest[0].buckets if manifest else buckets
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
    stored_shape = f"{shape}, _digest string"
    placed = new.where(F.col(key).isNotNull()).withColumns({"_digest": digest(F.col(body)), "_bucket": bucket_of(F.col(key), many)})
    number = max((r.version for r in manifest), default=0) + 1
    if manifest:
        touched = {r[0] for r in placed.select("_bucket").distinct().collect()}
        near = _folders(manifest, path, touched)
        known = spark.read.schema(stored_shape).parquet(*near).select(key, "_digest") if near else None
        changed = placed.join(known, [key, "_digest"], "left_anti").select(*placed.columns) if known is not None else placed
        touched = {r[0] for r in changed.select("_bucket").distinct().collect()}
        if not touched:
            return number - 1
        near = _folders(manifest, path, touched)
        rows = changed
        if near:
            old = spark.read.schema(stored_shape).parquet(*near)
            rows = old.join(changed.select(key), key, "left_anti").select(*old.columns).withColumn("_bucket", bucket_of(F.col(key), many)).select(*placed.columns).unionByName(changed)
    else:
        touched, rows = set(range(many)), placed
    rows.repartition(min(len(touched), many), "_bucket").sortWithinPartitions("_bucket", key).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v{number}")
    counts = {r[0]: r[1] for r in spark.read.parquet(f"{path}/data/v{number}").groupBy("_bucket").count().collect()}
    kept = [(number, r.bucket, r.folder, r.rows, many) for r in manifest if r.bucket not in touched]
    made = [(number, b, number, counts.get(b, 0), many) for b in sorted(touched)]
    spark.createDataFrame(kept + made, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return number
