"""A stored inverted index of two levels: words with blocks of sorted document numbers, in segments that are added and merged."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import fold_width

#: Documents of a block: a word's list in one row is never longer.
BLOCK = 1 << 16
#: White space as Unicode has it, and as (?U)\\s does in a column's pattern.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Levels, the better first.
METADATA, BODY = 1, 2
SHAPE = "segment int, level int, word string, block long, places array<int>"


def words(text: Column) -> Column:
    """The different stretches between white space, widths folded. A search term has no white space, so it stands in a text if and only if it stands in one of them."""
    return F.array_distinct(F.filter(F.split(fold_width(text), r"(?U)\s+"), lambda w: w != ""))


def terms(sought: str) -> list[str]:
    """Search terms as functions.text.has_all_terms takes them."""
    folded = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in sought)
    return sorted({t for t in re.split(SPACE, re.sub(f"^({SPACE}|\ufeff)+|({SPACE}|\ufeff)+$", "", folded)) if t})


def _keys(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("segment int, base boolean, id long").parquet(f"{path}/keys")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def segments(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the segments that count: the last one that holds everything, and those after it. One is there once its keys are."""
    keys = _keys(spark, path)
    found = {r.segment: r.base for r in keys.groupBy("segment").agg(F.max("base").alias("base")).collect()} if keys is not None else {}
    first = max((s for s, base in found.items() if base), default=0)
    return sorted(s for s in found if s >= first)


def _written(rows: DataFrame, keys: DataFrame, path: str, number: int, base: bool) -> None:
    placed = rows.groupBy("level", "word", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.array_sort(F.collect_set(F.pmod("id", F.lit(BLOCK)).cast("int"))).alias("places"))
    # sorted by word, so that a search for the start of one, or for one alone, skips most row groups
    placed.select(F.lit(number).alias("segment"), "level", "word", "block", "places").sortWithinPartitions("level", "word", "block").write.mode("overwrite").parquet(f"{path}/postings/of={number}")
    keys.select(F.lit(number).alias("segment"), F.lit(base).alias("base"), "id").write.mode("overwrite").parquet(f"{path}/keys/of={number}")


def add(docs: DataFrame, path: str, key: str = "doc_id", metadata: str | None = None, body: str | None = "text", base: bool = False) -> int:
    """Add docs as the next segment of the index at `path`; its number.

    key is a whole number of 0 or more; rows without one are left out. Of a document that stands in several segments the newest counts, so that an
    increment is a segment of the changed documents alone, and a deleted one is a row without texts. A list of
    a common word is cut into blocks by document number: no group and no row is longer than BLOCK.
    """
    spark = docs.sparkSession
    number = max(segments(spark, path), default=0) + 1
    held = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *[F.col(c).alias(n) for c, n in ((metadata, "_1"), (body, "_2")) if c])
    fields = [F.struct(F.lit(level).alias("level"), words(F.col(f"_{level}")).alias("words")) for level in (METADATA, BODY) if f"_{level}" in held.columns]
    rows = held.select("id", F.explode(F.array(*fields)).alias("f")).select("id", "f.level", F.explode("f.words").alias("word"))
    _written(rows, held.select("id").distinct(), path, number, base)
    return number


def _numbers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.explode(F.transform("places", lambda p: F.col("block") * BLOCK + p))).drop("places", "block")


def _current(rows: DataFrame, keys: DataFrame, counted: list[int]) -> DataFrame:
    """Of rows (segment, id, more) those of each id's newest segment."""
    if len(counted) < 2:
        return rows
    newest = keys.where(F.col("segment").isin(counted)).groupBy("id").agg(F.max("segment").alias("segment"))
    return rows.join(newest, ["id", "segment"], "left_semi")


def merge(spark: SparkSession, path: str) -> int:
    """All that counts as one segment, which replaces the others for searches; its number."""
    counted, keys = segments(spark, path), _keys(spark, path)
    rows = _numbers(spark.read.schema(SHAPE).parquet(f"{path}/postings").where(F.col("segment").isin(counted)))
    number = max(counted) + 1
    _written(_current(rows, keys, counted), keys.where(F.col("segment").isin(counted)).select("id").distinct(), path, number, True)
    return number


def search(spark: SparkSession, path: str, sought: str) -> DataFrame:
    """id and level of the documents that have all terms of `sought` in their metadata (level 1) or else in their body (2); none without terms.

    Only the index is read: the words that hold a term, each once, then the lists of those. A document's terms
    are gathered as bits, summed where they are read, so a common word brings one row a document to the shuffle.
    """
    wanted, counted = terms(sought), segments(spark, path)
    if not wanted or not counted:
        return spark.createDataFrame([], "id long, level int")
    if len(wanted) > 63:
        raise ValueError("more than 63 terms")
    bits = sum((F.when(F.contains("word", F.lit(t)), F.lit(1 << i)).otherwise(0) for i, t in enumerate(wanted)), F.lit(0).cast("long"))
    lists = spark.read.schema(SHAPE).parquet(f"{path}/postings").where(F.col("segment").isin(counted)).withColumn("bits", bits).where("bits > 0")
    held = _numbers(lists).groupBy("segment", "id", "level").agg(F.bit_or("bits").alias("bits")).where(F.col("bits") == (1 << len(wanted)) - 1)
    return _current(held, _keys(spark, path), counted).groupBy("id").agg(F.min("level").alias("level"))
