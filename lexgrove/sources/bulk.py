"""Reader of bulk archives as a Spark data source: zips of one XML file a law, with a list of the laws as CSV."""

from __future__ import annotations

import csv
import datetime as dt
import glob
import io
import json
import os
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexgrove.functions.text import era_date

#: The list's columns in their order, and its name in an archive.
LIST = (
    "law_type", "law_num", "law_title", "law_title_kana", "old_title", "promulgated", "amendment_law_title",
    "amendment_law_num", "amendment_promulgated", "enforced", "enforcement_comment", "law_id", "url", "pending",
)
LIST_NAME = "all_law_list.csv"
#: The mark of a law that isn't in force yet, and the amending law of a law that none amended.
PENDING, UNAMENDED = "未施行", "0" * 15
#: The categories by number from 1; an archive of one is named after its number.
CATEGORIES = (
    "憲法 刑事 財務通則 水産業 観光 国会 警察 国有財産 鉱業 郵務 行政組織 消防 国税 工業 電気通信 国家公務員 国土開発 事業 商業 労働 行政手続 "
    "土地 国債 金融・保険 環境保全 統計 都市計画 教育 外国為替・貿易 厚生 地方自治 道路 文化 陸運 社会福祉 地方財政 河川 産業通則 海運 社会保険 司法 災害対策"
).split()


def xml_tree(element: ET.Element) -> dict:
    """An element as the tree that nodes.shred reads: tag, attr, children; white space between elements goes."""
    children: list = []

    def text(x: str | None) -> None:
        if x and x.strip(" \t\r\n"):
            children.append(x)

    text(element.text)
    for child in element:
        children.append(xml_tree(child))
        text(child.tail)
    return {"tag": element.tag, "attr": dict(element.attrib), "children": children}


def _named(member: str) -> tuple[str, dt.date | None, str | None]:
    """law_id, enforcement date and amending law by a file's name."""
    parts = member.rpartition("/")[2].removesuffix(".xml").split("_")
    day, amendment = (parts + [""] * 2)[1:3]
    try:
        enforced = dt.datetime.strptime(day, "%Y%m%d").date()
    except ValueError:
        enforced = None
    return parts[0], enforced, None if amendment in ("", UNAMENDED) else amendment


def _is_list(member: str) -> bool:
    return member.rpartition("/")[2] == LIST_NAME


def _list_rows(file: IO[bytes]) -> Iterator[tuple]:
    rows = csv.reader(io.TextIOWrapper(file, "utf-8-sig", newline=""))
    next(rows, None)
    yield from (tuple((row + [""] * len(LIST))[: len(LIST)]) for row in rows if row)


def _law_row(archive: str, member: str, file: IO[bytes]) -> tuple:
    category = re.fullmatch(r"(\d+)_xml\.zip", archive.rpartition("/")[2])
    try:
        body, cause = json.dumps(xml_tree(ET.parse(file).getroot()), ensure_ascii=False), None
    except ET.ParseError as e:
        body, cause = None, str(e)
    return *_named(member), int(category[1]) if category else None, member, body, cause


LIST_ROWS = ", ".join(f"{c} string" for c in LIST)
LAW_ROWS = "law_id string, enforcement_date date, amendment_law_id string, category int, member string, body string, cause string"


class _Members(InputPartition):
    def __init__(self, archive: str, first: int, last: int) -> None:
        super().__init__((archive, first, last))
        self.archive, self.first, self.last = archive, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.list = self.options.get("kind") == "list"

    def _of_kind(self, archive: zipfile.ZipFile) -> list[str]:
        return sorted(n for n in archive.namelist() if (_is_list(n) if self.list else n.endswith(".xml")))

    def partitions(self) -> list[_Members]:
        path, step = self.options["path"], max(1, int(self.options.get("members", 200)))
        found = sorted(glob.glob(os.path.join(path, "*.zip"))) if os.path.isdir(path) else [path]
        parts = []
        for name in found:
            with zipfile.ZipFile(name) as archive:
                n = len(self._of_kind(archive))
            parts += [_Members(name, a, min(a + step, n)) for a in range(0, n, step)]
        return parts or [_Members("", 0, 0)]

    def read(self, partition: _Members) -> Iterator[tuple]:
        if not partition.archive:
            return
        with zipfile.ZipFile(partition.archive) as archive:
            for member in self._of_kind(archive)[partition.first : partition.last]:
                with archive.open(member) as file:
                    yield from _list_rows(file) if self.list else [_law_row(partition.archive, member, file)]


class LawBulk(DataSource):
    """Options: path (a zip or a folder of zips, open to the driver and all executors), kind (laws, list), members (files a partition).

    laws: law_id, enforcement_date, amendment_law_id (null: none), category (by the archive's name, null for other names), member, body (the
    tree as JSON) or, for a file that is no XML, cause. list: LIST as text. A task opens its archive and reads its own files
    alone; the driver reads the archives' directories.
    """

    @classmethod
    def name(cls) -> str:
        return "law_bulk"

    def schema(self) -> str:
        return LIST_ROWS if self.options.get("kind") == "list" else LAW_ROWS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LawBulk)


def read_archives(spark: SparkSession, path: str, kind: str = "laws", glob_filter: str = "*.zip") -> DataFrame:
    """As the law_bulk source, from archives on any file system that Spark reads: a zip, a folder of them or a pattern.

    An archive (of up to 2 GB, what Spark's binary files hold) is cut into its members by its directory without being unpacked, in one task; the members, still packed, are
    dealt to all tasks, which unpack and parse them. An archive that is no zip, or a member packed in another way than stored or deflated, is a row with its cause.
    """
    listed = kind == "list"

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "member", "method", "packed"]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data, rows = content.as_buffer(), []
                try:
                    with zipfile.ZipFile(pa.BufferReader(data)) as archive:
                        held = sorted((i for i in archive.infolist() if (_is_list(i.filename) if listed else i.filename.endswith(".xml"))), key=lambda i: i.filename)
                except zipfile.BadZipFile as e:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([str(e)]), pa.array([-1], pa.int32()), pa.array([b""])], names)
                    continue
                view = memoryview(data)
                for info in held:
                    # a local header: 30 bytes, the lengths of name and further fields among its last four
                    at = info.header_offset + 30 + int.from_bytes(view[info.header_offset + 26 : info.header_offset + 28], "little") + int.from_bytes(view[info.header_offset + 28 : info.header_offset + 30], "little")
                    rows.append((name.as_py(), info.filename, info.compress_type, bytes(view[at : at + info.compress_size])))
                for a in range(0, len(rows), 200):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 200]), (pa.string(), pa.string(), pa.int32(), pa.binary()))], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in (LIST_ROWS if listed else LAW_ROWS).split(", ")]
        kinds = [pa.string()] * len(names) if listed else [pa.string(), pa.date32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for archive, member, method, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    rows = [] if listed else [(None, None, None, None, None if method < 0 else member, None, member if method < 0 else f"packed by method {method}")]
                else:
                    file = io.BytesIO(packed if method == zipfile.ZIP_STORED else zlib.decompress(packed, -15))
                    rows = list(_list_rows(file)) if listed else [_law_row(archive, member, file)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob_filter).load(path).select("path", "content")
    packed = files.mapInArrow(members, "archive string, member string, method int, packed binary")
    dealt = packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("archive", "member"))
    return dealt.mapInArrow(parse, LIST_ROWS if listed else LAW_ROWS)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The list from a CSV file that stands by itself (byte order mark, CRLF): LIST as text, null for what is empty."""
    return spark.read.csv(path, schema=", ".join(f"{c} string" for c in LIST), header=True, encoding="UTF-8", escape='"')


def as_laws(rows: DataFrame) -> DataFrame:
    """A list's rows with null for what is empty, era dates as dates, pending as a boolean, and src_ord, the order of law_id."""
    dates = {"promulgated": "promulgation_date", "amendment_promulgated": "amendment_promulgate_date", "enforced": "enforcement_date"}
    shown = [era_date(F.col(c)).alias(dates[c]) if c in dates else F.nullif(F.col(c), F.lit("")).alias(c) for c in LIST if c != "pending"]
    return rows.select(*shown, F.coalesce(F.col("pending") == PENDING, F.lit(False)).alias("pending"), F.col("law_id").alias("src_ord"))


def categories(spark: SparkSession) -> DataFrame:
    """category and its name."""
    return spark.createDataFrame(list(enumerate(CATEGORIES, 1)), "category int, name string")


def write_by_category(laws: DataFrame, path: str) -> None:
    """Parquet in a folder a category, so that a category's readers list and read it alone; a law of several stands in each, one of none under the null folder."""
    laws.write.mode("overwrite").partitionBy("category").parquet(path)
