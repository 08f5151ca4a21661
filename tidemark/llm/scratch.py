"""Tables and lineage cuts in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only if unset on a local master (tests)."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries in this block remove their shuffle files when they end; a lost one is computed anew."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)


class Scratch:
    """Intermediate tables of one operator call, written as Parquet; removed one by one, or when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        deploy(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.root}/{self.n}", self.n + 1
        with shuffles_removed(self.spark):  # a table is computed once, so nothing reads its shuffles again
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        release(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._remove(t.scratch_path)

    def _remove(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may be gone at exit
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deploy(spark: SparkSession) -> None:
    """Sends this package's code to the executors' Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_sent", False):
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as d:
        with zipfile.ZipFile(at := f"{d}/tidemark-llm.zip", "w") as z:
            z.writestr("tidemark/__init__.py", "")
            for p in package.rglob("*.py"):
                z.write(p, f"tidemark/llm/{p.relative_to(package)}")
        sc.addPyFile(keep := shutil.copy(at, tempfile.mkdtemp()))
    atexit.register(shutil.rmtree, str(Path(keep).parent), True)
    sc._tidemark_sent = True
