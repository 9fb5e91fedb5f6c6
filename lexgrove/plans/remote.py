"""Requests over a law API: names, revisions and documents are looked up for the rows that ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import trim_wide
from lexgrove.operators.errors import http_error
from lexgrove.plans.requests import Corpus
from lexgrove.session import stored
from lexgrove.sources import law_api
from lexgrove.sources.aliases import aliases
from lexgrove.sources.law_types import law_types


def documents(base: str, concurrency: int | None = None, delay: float = law_api.DELAY):
    """Corpus.fetch: the API's document at each pair (law_id, at), of a failure its error."""

    def fetch(asked: DataFrame) -> DataFrame:
        got = law_api.fetched(asked, base, "law_data", concurrency, delay)
        doc = F.concat_ws("@", "law_id", "at")
        return got.select("law_id", "at", doc.alias("doc_id"), F.get_json_object("body", "$.law_full_text").alias("body"), F.when(F.col("body").isNull(), http_error(F.col("status"), F.col("url"), F.col("cause"))).alias("error"))

    return fetch


def corpus(spark: SparkSession, requests: DataFrame, base: str, name: str = "law_name", concurrency: int | None = None, delay: float = law_api.DELAY) -> Corpus:
    """The corpus that answers `requests`: the laws that the API lists for their names (as searched: an alias's formal name), each name asked for once.

    Bodies are fetched by the requests themselves, for the laws that they resolve to; histories for all the laws listed.
    """
    known = aliases(spark)
    named = requests.select(trim_wide(F.col(name)).alias("_n")).distinct().join(known.select(F.col("abbr").alias("_a"), "formal"), F.col("_n") == F.col("_a"), "left")
    titles = named.select(F.coalesce("formal", "_n").alias("law_id"), F.lit(None).cast("string").alias("at")).where("law_id <> ''")
    listed = law_api.as_laws(law_api.fetched(titles, base, "laws", concurrency, delay))
    laws = stored(listed.groupBy("law_id").agg(F.min_by(F.struct("law_title", "law_num", "law_type", "promulgation_date", "src_ord"), "src_ord").alias("l")).select("law_id", "l.*"))
    past = law_api.as_revisions(law_api.fetched(laws.select("law_id", F.lit(None).cast("string").alias("at")), base, "law_revisions", concurrency, delay))
    revisions = past.withColumns({"enforcement_date": F.expr("try_to_date(amendment_enforcement_date)"), "api_ord": F.monotonically_increasing_id()})
    return Corpus(laws, revisions, None, known, law_types(spark), fetch=documents(base, concurrency, delay))
