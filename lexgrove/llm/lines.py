"""Line dedup: distinct-site spread of lines by HyperLogLog sketches, exact counts near the threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import cut, documents, nested, seen, small


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def widespread_lines(lines: DataFrame, min_sites: int, log2_registers: int = 12) -> DataFrame:
    """Lines (by hash `h`) found on at least `min_sites` distinct sites, with their first place.

    Sketches of sites per line hash merge by aggregation. An estimate within four standard
    errors of min_sites, and always within 1, is settled by the exact number of distinct sites.
    """
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(2**log2_registers) * min_sites))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log2_registers))).alias("sites"), F.min(F.struct("id", "pos")).alias("first"))
    likely = cut(spread.where(F.col("sites") >= min_sites - band))
    n = seen(likely)["rows"]
    near = cut(likely.where(F.col("sites") <= min_sites + band).select("h"), n)
    exact = lines.join(small(near), "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    sure = likely.where(F.col("sites") > min_sites + band)
    settled = likely.join(exact.select("h"), "h", "left_semi")
    return cut(sure.unionByName(settled).select("h", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos")), n)


def _deduplicated(docs: DataFrame, min_sites: int, log2_registers: int, key: str, text: str, site: str, keep_first: bool) -> DataFrame:
    """row (all columns of docs but the text), text, n_lines and n_removed."""
    keyed = nested(docs).select(
        F.col("row").dropFields(text).alias("row"), F.col("row").getField(key).alias("id"), F.col("row").getField(site).alias("site"), F.col("row").getField(text).alias("text")
    ).withColumn("_row", F.xxhash64("id", "text"))
    lines = (
        keyed.select("_row", "id", F.coalesce("site", F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(~_blank(F.col("line")))
        .select("_row", "id", "site", "pos", F.xxhash64(F.trim("line")).alias("h"))
    )
    common = widespread_lines(lines.select("id", "site", "pos", "h"), min_sites, log2_registers)
    first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))
    gone = lines.select("_row", "id", "pos", "h").join(small(common, 24), "h")
    gone = (gone.where(~first) if keep_first else gone).groupBy("_row").agg(F.collect_set("pos").alias("gone"))
    parts = F.col("parts")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")), lambda i: F.get(parts, i))
    body = F.array_join(F.when(F.col("gone").isNull(), parts).otherwise(kept), "\n").alias("text")
    # the lines instead of the text go through the join, so that a text is split once
    split = keyed.select("row", "_row", F.split("text", "\n").alias("parts")).join(gone, "_row", "left")
    return split.select("row", body, F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, log2_registers: int = 12, key: str = "doc_id", text: str = "text", site: str = "source", keep_first: bool = True) -> DataFrame:
    """Columns of `docs`, the text without cross-site boilerplate, then n_lines and n_removed.

    A line (what newlines part, spaces at its ends aside) is boilerplate if it occurs on at
    least min_sites distinct sites; a null site is one site. With keep_first its first
    occurrence, by key and then place, stays. Blank lines are never removed. A null text
    stays null and has 0 lines; an empty one has 1. Repeated rows lose the same lines;
    columns named like a result are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    done = _deduplicated(docs, min_sites, log2_registers, key, text, site, keep_first)
    own = [F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*own, "n_lines", "n_removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_removed")


OP5_SQL = """
WITH parts AS (SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, site, unnest(p) AS line, generate_subscripts(p, 1) - 1 AS pos FROM parts),
common AS (
  SELECT trim(line) AS body, min(struct_pack(d := doc_id, p := pos)) AS f FROM lines
  WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.body IS NOT NULL AND NOT (c.f.d = l.doc_id AND c.f.p = l.pos) AS gone
  FROM lines l LEFT JOIN common c ON c.body = trim(l.line)),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
    count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY 1)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def line_stage(docs: DataFrame) -> DataFrame:
    """Documents without boilerplate lines; those of which nothing but blank lines is left go. All other columns come back as they were."""
    done = _deduplicated(docs, 10, 12, "doc_id", "text", "source", True)
    own = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(*own)
