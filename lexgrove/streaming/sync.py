"""Daily increments into a Parquet table: what did not change is left alone, the rest replaces its keys."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexgrove.operators.history import changed, upsert


def apply_increment(spark: SparkSession, path: str, version: int, new: DataFrame, key: str, body: str) -> int:
    """Write version + 1 of the table below `path` from its version and the increment; the version that holds now.

    Versions are folders, so a lost run leaves the old one whole. An increment that changes
    nothing writes nothing. Version 0 is the empty table.
    """
    if version == 0:
        new.write.mode("overwrite").parquet(f"{path}/v1")
        return 1
    old = spark.read.parquet(f"{path}/v{version}")
    news = changed(old, new, key, body)
    if not news.take(1):
        return version
    upsert(old, news, key).write.mode("overwrite").parquet(f"{path}/v{version + 1}")
    return version + 1


STATE = "version int, through date, rows_in long, full boolean"


def newest(updates: DataFrame, key: str, date: str) -> DataFrame:
    """Of each key's updates the one of the greatest date, ties to the greatest row; rows without a key go."""
    rest = [c for c in updates.columns if c != key]
    best = updates.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(date).alias("_at"), F.struct(*rest).alias("_row"))).alias("_best"))
    return best.select(key, "_best._row.*").select(*updates.columns)


def sync_state(spark: SparkSession, path: str) -> Row | None:
    """The last row of the table's state: version, the day it holds through, rows of the step, whether it was a full load. None before the first."""
    try:
        rows = spark.read.schema(STATE).parquet(f"{path}/sync_state")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.desc("through"), F.desc("version")).first()


def needs_full(through: dt.date | None, today: dt.date, days: int = 90) -> bool:
    """Increments reach back `days` (about three months): before the first load and beyond them all is loaded anew."""
    return through is None or (today - through).days > days


def catch_up(
    spark: SparkSession, path: str, today: dt.date, read_days: Callable[[dt.date, dt.date], DataFrame], read_all: Callable[[], DataFrame], key: str, body: str, date: str = "update_date", days: int = 90
) -> Row:
    """Bring the table below `path` up to `today`; the state that holds then.

    read_days(first, last) gives the updates of those days, with `date`; of a key's several updates the newest counts, so that
    the missed days are one increment and the table is written once. Days in the future or caught up already do nothing. The state's row
    follows its version: a run lost between the two is done again, over the same version.
    """
    state = sync_state(spark, path)
    if state and state.through >= today:
        return state
    full = needs_full(state and state.through, today, days)
    news = newest(read_all() if full else read_days(state.through + dt.timedelta(days=1), today), key, date)
    if full:
        version = (state.version if state else 0) + 1
        news.write.mode("overwrite").parquet(f"{path}/v{version}")
    else:
        version = apply_increment(spark, path, state.version, news, key, body)
    done = spark.createDataFrame([(version, today, news.count(), full)], STATE)
    done.coalesce(1).write.mode("append").parquet(f"{path}/sync_state")
    return done.first()
