"""Keyed merges that read and write only the partitions that a batch touches.

A table is a folder of Hive-style partitions, written by Spark below a folder for each merge, and one small map for each
version, which says for each partition where its files are; versions share the files of all partitions that a merge does
not touch. A version's map is created under its number or not at all, so of two merges that began from one version the
second is refused, and a crash leaves the last whole version in place. A batch that was merged before is not merged again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.joins import first_per_key, merged

#: Versions that stay for readers that began before, and partitions that one batch may touch: their names go to the driver.
KEPT, MOST_TOUCHED = 3, 10_000


class ConcurrentMerge(RuntimeError):
    """Another merge made the next version first; run this one again."""


@dataclass
class Version:
    number: int = -1
    #: Folder of a merge for each partition path, such as day=2024-01-01.
    places: dict[str, str] = field(default_factory=dict)
    #: The last batch of each stream.
    batches: dict[str, int] = field(default_factory=dict)
    #: The table's schema as JSON.
    schema: str = ""


class PartitionTable:
    """A table at `path` with natural `keys`, in partitions by `by`: named expressions over key columns alone, so that a
    key never moves from one partition to another."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], by: dict[str, Column]):
        self.spark, self.path, self.keys, self.by = spark, path.rstrip("/"), keys, by
        jvm = spark._jvm
        self._to = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        self.fs = self._to().getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self.fs.exists(self._to("versions")):
            return []
        return sorted(int(n.removesuffix(".json")) for s in self.fs.listStatus(self._to("versions")) if (n := s.getPath().getName()).endswith(".json") and n[0] != ".")

    def _load(self, number: int) -> Version | None:
        """The version, or None if its map was cut short by a crash."""
        lines = self.spark.read.text(str(self._to("versions", f"{number:012d}.json").toString())).collect()  # one small file
        try:
            v = Version(**json.loads(lines[0][0]))
            return v if v.number == number else None
        except (ValueError, IndexError, TypeError):
            return None

    def current(self) -> Version:
        for n in reversed(self._numbers()):
            if v := self._load(n):
                return v
        return Version()

    def _files(self, places: dict[str, str], schema: str) -> DataFrame | None:
        if not places:
            return None
        paths = sorted(f"{self.path}/data/merge={m}/{p}" for p, m in places.items())
        schema = StructType.fromJson(json.loads(schema)).add("merge", "string")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).drop("merge")

    def read(self) -> DataFrame | None:
        """The newest version; filters on partition columns decide which folders are read."""
        v = self.current()
        return self._files(v.places, v.schema)

    def merge(self, new: DataFrame, *, order: list | None = None, keep_old_if_null: tuple[str, ...] = (), guard: Column | None = None, batch: tuple[str, int] | None = None) -> int:
        """Upsert by key into the touched partitions; how many those were. Of new rows with one key the first in `order` counts.

        `batch` is a stream's name and number: a batch that this or a later version has seen changes nothing. Rows whose
        partition is null go to Hive's default partition, as Spark writes it; a null key is an error. Raises ConcurrentMerge where
        another merge was first."""
        base = self.current()
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return 0
        new = first_per_key(new, self.keys, order or [F.xxhash64(*new.columns)])
        new = new.withColumns({k: F.coalesce(k, F.raise_error(F.lit(f"null in key {k}")).cast(new.schema[k].dataType)) for k in self.keys}).withColumns(self.by)
        name, parts = uuid.uuid4().hex, list(self.by)
        # the batch is written first and read again: it is computed once, and its folders name what it touches
        new.write.partitionBy(*parts).parquet(f"{self.path}/data/merge={name}n")
        touched = self._partitions(f"{name}n")
        if len(touched) > MOST_TOUCHED:
            raise ValueError(f"a batch touches {len(touched)} partitions, more than {MOST_TOUCHED}")
        shared = {p: m for p, m in base.places.items() if p in touched}
        if old := self._files(shared, base.schema):
            fresh = self._files({p: f"{name}n" for p in touched}, new.schema.json())
            both = merged(old.select(*fresh.columns), fresh, self.keys, keep_old_if_null=keep_old_if_null, guard=guard)
            both.write.partitionBy(*parts).parquet(f"{self.path}/data/merge={name}")
            self.fs.delete(self._to("data", f"merge={name}n"), True)
        else:
            name = f"{name}n"
        after = Version(base.number + 1, base.places | dict.fromkeys(touched, name), base.batches | (dict([batch]) if batch else {}), base.schema or new.schema.json())
        self._commit(after)
        return len(touched)

    def _partitions(self, merge: str) -> list[str]:
        """Paths of the partitions below a merge's folder."""
        found = [""]
        for _ in self.by:
            found = [f"{f}/{s.getPath().getName()}".lstrip("/") for f in found for s in self.fs.listStatus(self._to("data", f"merge={merge}", *([f] if f else []))) if "=" in s.getPath().getName()]
        return sorted(found)

    def _commit(self, v: Version) -> None:
        at = self._to("versions", f"{v.number:012d}.json")
        if self.fs.exists(at) and self._load(v.number) is None:
            self.fs.delete(at, False)  # the rest of a crashed commit
        try:
            out = self.fs.create(at, False)
        except Exception as e:
            if self.fs.exists(at):
                raise ConcurrentMerge(f"version {v.number} of {self.path} is there already") from e
            raise
        out.write(bytearray((json.dumps(v.__dict__) + "\n").encode()))
        out.close()
        self._clean()

    def _clean(self) -> None:
        """Removes maps beyond the kept ones, and the folders of partitions that none of those has and that an older one had."""
        numbers = self._numbers()
        old, kept = [self._load(n) for n in numbers[:-KEPT]], [self._load(n) for n in numbers[-KEPT:]]
        used = {(p, m) for v in kept if v for p, m in v.places.items()}
        for v in old:
            for p, m in v.places.items() if v else ():
                if (p, m) not in used:
                    self.fs.delete(self._to("data", f"merge={m}", p), True)
        for n in numbers[:-KEPT]:
            self.fs.delete(self._to("versions", f"{n:012d}.json"), False)
