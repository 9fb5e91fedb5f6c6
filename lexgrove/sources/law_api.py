"""Reader of a law API (lists, documents, revisions) as a Spark data source."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull, StringContains

#: Attempts after the first, the first delay in seconds, the time limit, and requests at a time.
RETRIES, DELAY, TIMEOUT, CONCURRENCY = 3, 0.5, 30.0, 4

#: The fields of the API's answers that become columns.
LAW_INFO = "law_id string, law_type string, law_num string, promulgation_date string"
REVISION = (
    "law_revision_id string, law_title string, law_title_kana string, abbrev string, category string, updated string, "
    "amendment_promulgate_date string, amendment_enforcement_date string, amendment_law_id string, amendment_law_title string, "
    "amendment_law_num string, repeal_status string, remain_in_force boolean, current_revision_status string"
)


class HttpFailure(Exception):
    """status 0 is a time-out."""

    def __init__(self, status: int, url: str, message: str) -> None:
        super().__init__(message)
        self.status, self.url = status, url


def fetch_json(url: str, retries: int = RETRIES, delay: float = DELAY, timeout: float = TIMEOUT) -> object:
    """The JSON at a URL. 429, 5xx and network failures are tried again, each time after twice the delay; a time-out is not."""
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if not (e.code == 429 or e.code >= 500) or attempt == retries:
                raise HttpFailure(e.code, url, f"the law API returned {e.code}") from e
        except (TimeoutError, urllib.error.URLError) as e:
            if isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError):
                raise HttpFailure(0, url, f"request timed out: {url}") from e
            if attempt == retries:
                raise
        time.sleep(delay * 2**attempt)
    raise AssertionError


def list_url(base: str, **filters: object) -> str:
    """URL of the list with the filters that are set; 0 counts as set."""
    query = urllib.parse.urlencode({k: v for k, v in filters.items() if v is not None and v != ""})
    return f"{base}/laws" + (f"?{query}" if query else "")


def positive(setting: str | None, default: int) -> int:
    """A setting as a number above 0; blank, malformed, 0 and below give the default (as functions.text.positive_int for columns)."""
    try:
        return value if (value := int(setting or "")) > 0 else default
    except ValueError:
        return default


class _Urls(InputPartition):
    def __init__(self, urls: list[tuple[str, str]]) -> None:
        super().__init__(urls)
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[_Urls]:
        o = self.options
        base, kind = o["base"].rstrip("/"), o.get("kind", "laws")
        if kind == "laws":
            urls = [("", list_url(base, law_title=o.get("law_title"), law_type=o.get("law_type"), law_num=o.get("law_num"), limit=o.get("limit"), offset=o.get("offset")))]
        else:
            at = f"?asof={urllib.parse.quote(o['at'])}" if kind == "law_data" and o.get("at") else ""
            urls = [(i, f"{base}/{kind}/{urllib.parse.quote(i)}{at}") for i in json.loads(o["ids"])]
        n = max(1, min(positive(o.get("concurrency") or os.environ.get("LEXGROVE_CONCURRENCY"), CONCURRENCY), len(urls)))
        return [_Urls(urls[i::n]) for i in range(n)]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        delay = float(self.options.get("delay", DELAY))
        for law_id, url in partition.urls:
            try:
                yield law_id, json.dumps(fetch_json(url, delay=delay), ensure_ascii=False), None, url, None
            except HttpFailure as e:
                yield law_id, None, e.status, url, str(e)
            except OSError as e:
                yield law_id, None, None, url, str(e)


class _ListReader(DataSourceReader):
    """Pages of the list as law rows; filters that the API can answer become its parameters."""

    def __init__(self, options: dict[str, str], columns: list[str]) -> None:
        self.options, self.columns, self.asked = {k.lower(): v for k, v in options.items()}, columns, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A part of the title and the type are left to the API; a number is asked for and looked at again, as the API finds parts of it; the rest is Spark's."""
        for one in filters:
            name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            value = getattr(one, "value", None)
            free = isinstance(value, str) and value != "" and name not in self.asked
            if free and ((isinstance(one, StringContains) and name == "law_title") or (isinstance(one, EqualTo) and name == "law_type")):
                self.asked[name] = value
                continue
            if free and isinstance(one, EqualTo) and name == "law_num":
                self.asked[name] = value
            if not (isinstance(one, IsNotNull) and name in ("law_title", "law_type")):
                yield one

    def url(self, offset: int) -> str:
        o = self.options
        limit = positive(o.get("page"), 100)
        return list_url(o["base"].rstrip("/"), **{c: self.asked.get(c, o.get(c)) for c in ("law_title", "law_type", "law_num")}, limit=limit, offset=offset or None)

    def partitions(self) -> list[_Urls]:
        return [_Urls([("", self.url(0))])]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        # pages follow one another: only an answer says how many there are
        delay, seen = float(self.options.get("delay", DELAY)), 0
        while True:
            answer = fetch_json(self.url(seen), delay=delay)
            laws = answer.get("laws") or []
            for law in laws:
                seen += 1
                known = {**(law.get("revision_info") or {}), **(law.get("law_info") or {}), "src_ord": seen}
                yield tuple(known.get(c) for c in self.columns)
            if not laws or seen >= (answer.get("total_count") or 0):
                return


class LawList(DataSource):
    """The list as law rows, page by page. Options: base, page, and the filters' law_title, law_type, law_num where they aren't pushed down
    (spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "law_list"

    def schema(self) -> str:
        return f"{LAW_INFO}, {REVISION}, src_ord long"

    def reader(self, schema) -> _ListReader:
        return _ListReader(self.options, schema.fieldNames())


class LawApi(DataSource):
    """Options: base, kind (laws, law_data, law_revisions), filters or ids (a JSON list), at, concurrency.

    A row per request: law_id, body (JSON), and for a failure status, url and cause instead of body.
    Requests at a time are the number of partitions.
    """

    @classmethod
    def name(cls) -> str:
        return "law_api"

    def schema(self) -> str:
        return "law_id string, body string, status int, url string, cause string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LawApi)
    spark.dataSource.register(LawList)


def _answered(answers: DataFrame, schema: str) -> DataFrame:
    """The answers whose body is there, read by a schema; a body that isn't such JSON has null fields."""
    return answers.where("body is not null").select(F.col("law_id").alias("_asked"), "body", F.from_json("body", schema).alias("a"))


def as_laws(answers: DataFrame) -> DataFrame:
    """A row per law of list answers, in their order: the law's and its revision's fields, src_ord from 1 and the answer's total_count."""
    read = _answered(answers, f"total_count long, laws array<struct<law_info: struct<{LAW_INFO}>, revision_info: struct<{REVISION}>>>")
    rows = read.select("a.total_count", F.posexplode("a.laws").alias("_n", "law"))
    return rows.select("law.law_info.*", "law.revision_info.*", (F.col("_n") + 1).cast("long").alias("src_ord"), "total_count")


def as_documents(answers: DataFrame) -> DataFrame:
    """A row per document answer: law_id, the law's and its revision's other fields, and `body`, the tree as JSON, for `nodes.shred(..., "law_id")`."""
    read = _answered(answers, f"law_info struct<{LAW_INFO}>, revision_info struct<{REVISION}>")
    known = [F.col(f"a.law_info.{f.split()[0]}") for f in LAW_INFO.split(", ")[1:]]
    return read.select(F.coalesce("a.law_info.law_id", "_asked").alias("law_id"), *known, "a.revision_info.*", F.get_json_object("body", "$.law_full_text").alias("body"))


def as_revisions(answers: DataFrame) -> DataFrame:
    """A row per revision of history answers, with its law's law_id and law_num."""
    read = _answered(answers, f"law_info struct<{LAW_INFO}>, revisions array<struct<{REVISION}>>")
    return read.select(F.coalesce("a.law_info.law_id", "_asked").alias("law_id"), F.col("a.law_info.law_num").alias("law_num"), F.explode("a.revisions").alias("r")).select("law_id", "law_num", "r.*")


def fetched(asked: DataFrame, base: str, kind: str = "law_data", concurrency: int | None = None, delay: float = DELAY) -> DataFrame:
    """law_id, at, body, status, url and cause of each different pair of asked (law_id, at: null for now; kind laws: law_id is a title's part).

    A lookup that depends on rows: they may come from any plan. Each pair is asked for once, in tasks, of which there are as many as
    requests may run at a time; a failure is a row. Null ids are left out.
    """
    base = base.rstrip("/")
    tasks = concurrency or positive(os.environ.get("LEXGROVE_CONCURRENCY"), CONCURRENCY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for law_id, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if kind == "laws":
                    url = list_url(base, law_title=law_id, limit=5)
                else:
                    url = f"{base}/{kind}/{urllib.parse.quote(law_id)}" + (f"?asof={urllib.parse.quote(at)}" if at and kind == "law_data" else "")
                try:
                    rows.append((law_id, at, json.dumps(fetch_json(url, delay=delay), ensure_ascii=False), None, url, None))
                except HttpFailure as e:
                    rows.append((law_id, at, None, e.status, url, str(e)))
                except OSError as e:
                    rows.append((law_id, at, None, None, url, str(e)))
            names, types = ["law_id", "at", "body", "status", "url", "cause"], [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names)

    pairs = asked.where(F.col("law_id").isNotNull()).select("law_id", "at").distinct().repartition(tasks)
    return pairs.mapInArrow(run, "law_id string, at string, body string, status int, url string, cause string")
