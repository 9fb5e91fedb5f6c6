"""Mixing sources to target weights: exact length counts and a bounded-knapsack fit of the remaining budget."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexgrove.llm.common import cut, documents, nested, nested_columns, row_hash, seen, with_slots

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, source: str = "source") -> DataFrame:
    """A row per source: source, source_size, weight, target.

    Sources stand by code point, null last, and take `weights` in turn. Targets share
    `share` of all sizes by weight, stop at `most` times the source's size, and what is over
    is shared again by weight. So a target is min(level * weight, most * size) for one level,
    found in rounds of two sums over the sources; a round fixes the sources that are full.
    """
    order = Window.orderBy(F.col(source).isNull(), F.col(source).cast("binary"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = cut(
        sizes.groupBy(source)
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("full_at", F.col("source_size") * F.lit(float(most)))
    )
    whole = per.agg(F.sum("source_size").alias("a")).first()["a"] or 0
    budget = min(whole * share, whole * most)
    level = 0.0
    while True:
        full = F.col("full_at") <= F.col("weight") * F.lit(level)
        got = per.agg(F.sum(F.when(full, F.col("full_at"))).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        raised = (budget - (got["fixed"] or 0.0)) / got["open"]
        if raised <= level * (1 + 1e-12) + 1e-300:
            break
        level = raised
    return per.select(source, "source_size", "weight", F.least(F.col("full_at"), F.col("weight") * F.lit(level)).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: float, window: int = 16_384) -> np.ndarray:
    """How many documents of each length to take so that their sum comes near the budget: nearer than the shortest length left, or as near as any sum.

    Every length first gives its proportional share, rounded down, so that the mix keeps the lengths as they are. Longer lengths then fill
    up while more than `window` words are missing: it bounds the table of sums, not what is taken. The rest is a bounded knapsack, solved
    exactly by a table of reachable sums (counts split into powers of two).
    """
    lengths = lengths.astype(np.int64)
    counts = np.where(lengths > 0, counts, 0).astype(np.int64)  # without words, nothing to take
    total = int((lengths * counts).sum())
    goal = int(round(max(0.0, min(budget, total))))
    if not total or not goal:
        return np.zeros_like(counts)
    if goal == total:
        return counts.copy()
    take = (counts * (goal / total)).astype(np.int64)
    left = goal - int((take * lengths).sum())
    while left < 0:  # a rounded-up product
        i = int(np.argmax(take * lengths))
        take[i] -= 1
        left += int(lengths[i])
    free = counts - take
    for i in np.argsort(-lengths, kind="stable"):
        if left <= window:
            break
        if not free[i]:
            continue
        k = min(int(free[i]), (left - window) // int(lengths[i]) + ((left - window) % int(lengths[i]) > 0), left // int(lengths[i]))
        take[i] += k
        free[i] -= k
        left -= k * int(lengths[i])
    # a shortest document may overshoot, and may then be nearer than any sum below
    shortest = int(lengths[free > 0].min()) if (free > 0).any() else 0
    reach, steps, mask = 1, [], (1 << (left + shortest + 1)) - 1
    for i in np.flatnonzero(free)[np.argsort(lengths[free > 0], kind="stable")]:
        n, unit = min(int(free[i]), (left + shortest) // int(lengths[i])), 1
        while n > 0:
            k = min(unit, n)
            steps.append((int(i), k, reach))
            reach |= (reach << (k * int(lengths[i]))) & mask
            n, unit = n - k, unit * 2
        if reach >> left & 1:
            break
    below, above = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1, reach >> (left + 1)
    over = left + 1 + ((above & -above).bit_length() - 1) if above else None
    at = over if over is not None and over - left < left - below else below
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = int(target // size) if size else 0
    pdf = pdf.sort_values("size", kind="stable")
    extra = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), target - whole * size) if size else np.zeros(len(pdf), np.int64)
    return pdf[["source_key", "size", "source_size", "target"]].assign(whole=np.int64(whole), extra=extra)


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0, seed: int = 7, text: str = "text", source: str = "source", key: str = "doc_id", rows_per_bucket: int = 20_000) -> DataFrame:
    """A row per document: key, source, h (its seeded hash), size, source_size, target and taken; other columns are left out.

    size counts the words of the text (null: 0). Each source takes its documents as often as
    its target holds its size whole, and once more for the documents that `fit_counts` picks;
    which of the documents of one length is decided by a seeded hash of key and text, so reruns agree.
    taken is size times the number of takes, at most `most` (a whole number) times size. A document without words
    takes 0; a null source is a source, the last one; an empty table gives no rows.
    """
    if most != math.floor(most) or most < 1:
        raise ValueError("most: a whole number from 1")
    light = docs.select(F.col(key).alias("k"), F.col(source).alias(source), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("h"))
    light = cut(light)
    n = seen(light)["rows"]
    targets = cut(source_targets(light, weights, share, most, source).withColumn("source_key", F.xxhash64(F.col(source).isNull(), F.col(source))), n)
    counts = light.groupBy(source, "size").agg(F.count(F.lit(1)).alias("n"))
    known = targets.select(F.col(source).alias("_s"), "source_key", "source_size", "target")
    histogram = counts.join(known, counts[source].eqNullSafe(known["_s"])).select("source_key", "size", "n", "source_size", "target")
    plan = cut(histogram.groupBy("source_key").applyInPandas(_fit_source, "source_key long, size long, source_size long, target double, whole long, extra long"), n)
    rows = light.withColumn("source_key", F.xxhash64(F.col(source).isNull(), F.col(source)))
    buckets = 1 + n // rows_per_bucket
    # numbered before the plan is joined, so that no source and no length has to meet in one task
    placed = with_slots(rows, ["source_key", "size"], [F.col("h"), F.col("k")], F.struct(F.lit(seed), F.col("h")), buckets, "slot").join(plan, ["source_key", "size"])
    takes = F.col("whole") + F.when(F.col("slot") < F.col("extra"), 1).otherwise(0)
    return placed.select(F.col("k").alias(key), F.col(source), "h", "size", "source_size", "target", (takes * F.col("size")).cast("long").alias("taken"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_stage(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them; those it does not take go.

    Rows alike in doc_id and text share their takes out evenly, what doesn't divide by the hash of all their
    columns. All columns come back as they were; doc_id, text and source are needed.
    """
    taken = mix(docs.select("doc_id", "text", "source"), **options).select("h", "doc_id", F.expr("if(size > 0, taken div size, 0)").alias("times"))
    per = taken.groupBy("h", "doc_id").agg(F.sum("times").alias("sum"), F.count(F.lit(1)).alias("rows")).where("sum > 0")
    key = [F.xxhash64(F.lit(options.get("seed", 7)), "row.doc_id", "row.text").alias("h"), F.col("row.doc_id").alias("id")]
    rows = nested(docs).select("row", *key)
    each = per.select(F.col("h").alias("_h"), F.col("doc_id").alias("_id"), F.expr("sum div rows").alias("all"), F.expr("sum % rows").alias("rest"))
    joined = rows.join(each, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")))
    # only where takes don't divide do rows alike meet
    apart = F.when(F.col("rest") == 0, F.monotonically_increasing_id())
    turn = Window.partitionBy("h", "id", "apart").orderBy(row_hash(docs))
    times = F.expr("cast(all + if(turn <= rest, 1, 0) as int)")
    counted = joined.withColumn("apart", apart).withColumn("turn", F.row_number().over(turn)).withColumn("times", times).where("times > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*nested_columns(docs))
