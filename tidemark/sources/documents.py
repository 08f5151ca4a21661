"""One ordered JSON document of any size, written by all tasks.

Rows are dealt by ranges of the order and sorted within each, so part i holds what comes before part i + 1. The document
is the parts in order of their names, with small frames between them that are written when all parts are whole: `cat`
of the folder gives it, and join_parts() makes one file of it a buffer at a time. No task and no process holds it.
"""

from __future__ import annotations

import os
import shutil
import sys
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: The frame of a collection of features.
HEAD, TAIL = '{"type": "FeatureCollection", "features": [\n', "\n]}\n"


@dataclass
class _Part(WriterCommitMessage):
    number: int
    file: str
    rows: int


class Collection(DataSource):
    """df.write.format("feature_collection").mode("append").save(folder), of one text column that holds features."""

    @classmethod
    def name(cls) -> str:
        return "feature_collection"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Parts(self.options["path"], overwrite)


class _Parts(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.work = path, overwrite, f"{path}/.work-{uuid.uuid4().hex}"

    def write(self, rows) -> _Part:
        """Each attempt of a task has a file of its own; the commit takes that of the attempt that counts."""
        number = TaskContext.get().partitionId()
        os.makedirs(self.work, exist_ok=True)
        file, n = f"{self.work}/{number}-{uuid.uuid4().hex}", 0
        with open(file, "w", encoding="utf-8") as f:
            for row in rows:
                f.write(",\n" * (n > 0) + row[0])
                n += 1
        return _Part(number, file, n)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        if self.overwrite:
            for old in Path(self.path).glob("*.json"):
                old.unlink()
        os.makedirs(self.path, exist_ok=True)
        for i, m in enumerate(parts):
            os.replace(m.file, f"{self.path}/{i:08d}-b.json")
            Path(f"{self.path}/{i:08d}-a.json").write_text(",\n" if i else HEAD)
        if not parts:
            Path(f"{self.path}/{0:08d}-a.json").write_text(HEAD)
        Path(f"{self.path}/{len(parts):08d}-c.json").write_text(TAIL)  # the last one: a folder without it is not whole
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


def write_collection(features: DataFrame, path: str, order: list, column: str = "feature", *, parts: int | None = None) -> None:
    """Writes the features (JSON texts, no nulls) as one FeatureCollection below `path`, in `order`, in place of what is there.

    A folder that is on all machines. An empty frame gives an empty collection."""
    spark = features.sparkSession
    spark.dataSource.register(Collection)
    n = [parts] if parts else []
    rows = features.where(features[column].isNotNull()).repartitionByRange(*n, *order).sortWithinPartitions(*order).select(column)
    rows.write.format("feature_collection").mode("overwrite").save(path)


def join_parts(path: str, file: str) -> None:
    """One file of the parts, copied a buffer at a time; it appears when it is whole."""
    names = sorted(p for p in os.listdir(path) if p.endswith(".json"))
    if not names or not names[-1].endswith("-c.json"):
        raise ValueError(f"{path} holds no whole document")
    part = f"{file}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        for name in names:
            with open(f"{path}/{name}", "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
    os.replace(part, file)


# tasks get this module's code with their functions, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
