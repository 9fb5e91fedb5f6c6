"""Writer of answers as files, one a request, all of a job's or none."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own below a hidden one. The commit removes those of lost attempts and shows the rest by one renaming; an abort removes all."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.batch = path, overwrite, uuid.uuid4().hex
        self.hidden = os.path.join(path, f".{self.batch}")

    def write(self, rows: Iterator[Row]) -> Written:
        own, files = uuid.uuid4().hex[:12], 0
        folder = os.path.join(self.hidden, f"part-{own}")
        os.makedirs(folder)
        for row in rows:
            if not row.name or re.search(r"[/\\\0]|^\.", row.name):
                raise ValueError(f"no name for a file: {row.name!r}")
            with open(os.path.join(folder, row.name), "x", encoding="utf-8", newline="") as file:
                file.write(row.text or "")
            files += 1
        return Written(os.path.basename(folder), files)

    def commit(self, messages: list[Written | None]) -> None:
        whole = {m.folder for m in messages if m is not None}
        os.makedirs(self.hidden, exist_ok=True)
        for name in os.listdir(self.hidden):
            if name not in whole:
                shutil.rmtree(os.path.join(self.hidden, name))
        earlier = [n for n in os.listdir(self.path) if n.startswith("batch-")]
        os.rename(self.hidden, os.path.join(self.path, f"batch-{self.batch}"))
        for name in earlier if self.overwrite else []:
            shutil.rmtree(os.path.join(self.path, name))

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class AnswerFiles(DataSource):
    """Rows (name, text) as files in the folder of the option path, which all machines share: path/batch-*/part-*/name. Readers of whole texts find them as `path/*/*`.

    Names are unique within a task's rows and hold no separators. Append adds a batch, overwrite replaces the batches before.
    """

    @classmethod
    def name(cls) -> str:
        return "answer_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if schema.fieldNames() != ["name", "text"]:
            raise ValueError("columns: name and text")
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AnswerFiles)


def files(answers: DataFrame) -> DataFrame:
    """name and text of answers (req_id, error and more): Markdown where there is some, else the answer without its id, or its error, as JSON without nulls."""
    rest = [c for c in answers.columns if c not in ("req_id", "error", "markdown")]
    said = F.col("markdown") if "markdown" in answers.columns else F.lit(None).cast("string")
    text = F.when(F.col("error").isNotNull(), F.to_json("error")).when(said.isNotNull(), said).otherwise(F.to_json(F.struct(*rest)))
    kind = F.when(F.col("error").isNull() & said.isNotNull(), ".md").otherwise(".json")
    return answers.select(F.concat(F.col("req_id").cast("string"), kind).alias("name"), text.alias("text"))
