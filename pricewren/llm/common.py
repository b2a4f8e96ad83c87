"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if all runs on one machine
    (tests), else an error: executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pricewren-shared-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a write's shuffle files when the write is done. Else they stay until the driver happens to collect its garbage,
    which large inputs don't hasten, and the shuffles of all steps add up on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Written:
    """Tables of one run in the shared folder: writing cuts the lineage and survives the loss of any executor, so the shuffles before it go with
    it; what no later step reads is deleted with drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, shared_root(spark), {}

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.root}/{tag}-{uuid.uuid4().hex}"
        with brief_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no plan reads any more."""
        for table in tables:
            _, path = self.paths.pop(id(table))
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back."""
    return Written(df.sparkSession)(df, tag)


def quoted(name: str) -> str:
    """A column's name as it stands in an expression, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df but for those of the given names, in any case of letters: for results that add columns of these names."""
    gone = {n.lower() for n in names}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5 = 0. A null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def unit_hash(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the columns' values and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)).cast("double") / float(1 << 40)


def frugal(of: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back when its partition is done: Spark reuses Python workers, and allocators would keep the
    largest partition's memory beside the next stage's."""

    @functools.wraps(of)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return run
