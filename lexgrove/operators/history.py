"""Revision histories: newest rows, as-of selection, incremental upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(revisions: DataFrame, n: Column | int | None, key: str, order: list[Column]) -> DataFrame:
    """revisions with ord (from 1) and total, the first n of each key in `order`; all if n is null or not above 0."""
    n = n if hasattr(n, "isNull") else F.lit(n).cast("int")
    by = Window.partitionBy(key)
    rows = revisions.withColumn("total", F.count(F.lit(1)).over(by)).withColumn("ord", F.row_number().over(by.orderBy(*order)).cast("long"))
    return rows.where(n.isNull() | (n <= 0) | (F.col("ord") <= n))


def as_of(revisions: DataFrame, at: Column, key: str, date: str, tie: str) -> DataFrame:
    """key and `revision`: the last of each key's rows not after `at`, of equal dates the one with the greatest tie. Keys without one have no row."""
    return revisions.where(F.col(date) <= at).groupBy(key).agg(F.max_by(F.struct(*[c for c in revisions.columns if c != key]), F.struct(date, tie)).alias("revision"))


def as_of_each(requests: DataFrame, revisions: DataFrame, key: str, at: str, date: str, order: list[Column], value: Column) -> DataFrame:
    """Different pairs (key, at) of requests with `revision`: value of the key's last revision not after `at`, the last in `order` of equal dates; null if there is none.

    Both sides are put in one sequence by key and date, and the last value is carried forward: a sort, not a meeting of every request with every
    revision of its key. A key has at most as many rows here as there are dates, however many requests name it. Null keys and dates have no row.
    """
    pairs = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_at")).distinct()
    known = revisions.where(F.col(date).isNotNull()).select(F.col(key).alias("_k"), F.col(date).alias("_at"), F.lit(0).alias("_side"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"), F.struct(value.alias("v")).alias("_v"))
    none = {c: F.lit(None).cast(known.schema[c].dataType) for c in ("_o", "_v")}
    merged = known.unionByName(pairs.withColumns({"_side": F.lit(1), **none}))
    before = Window.partitionBy("_k").orderBy("_at", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = merged.withColumn("_last", F.last("_v", ignorenulls=True).over(before))
    return carried.where("_side = 1").select(F.col("_k").alias(key), F.col("_at").alias(at), F.col("_last.v").alias("revision"))


def changed(old: DataFrame, new: DataFrame, key: str, body: str) -> DataFrame:
    """Rows of new whose key and body digest are not in old: nothing to do for the others."""
    digest = lambda df: df.withColumn("_digest", F.sha2(F.coalesce(F.col(body), F.lit("")).cast("binary"), 256))
    return digest(new).join(digest(old).select(key, "_digest"), [key, "_digest"], "left_anti").drop("_digest").select(*new.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def status_label(current: Column, repeal: Column, in_force: Column) -> Column:
    """One label of the two status axes: repealed (in force still or not), not yet in force, superseded, in force."""
    return (
        F.when(repeal.isNotNull() & (repeal != "None") & in_force, "repealed, still in force")
        .when(repeal.isNotNull() & (repeal != "None"), "repealed")
        .when(current == "UnEnforced", "not yet in force")
        .when(current == "PreviousEnforced", "superseded")
        .otherwise("in force")
    )


def staleness(synced: Column, today: Column, fresh_days: int = 1, stale_days: int = 90) -> Column:
    """fresh, aging or stale by days since the last sync; `never` for null."""
    days = F.datediff(today, synced)
    return F.when(synced.isNull(), "never").when(days <= fresh_days, "fresh").when(days <= stale_days, "aging").otherwise("stale")
