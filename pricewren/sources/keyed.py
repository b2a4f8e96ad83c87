"""Tables of keyed rows whose batches can be repeated.

A table is a folder: `data/batch=N/bucket=B` holds the rows of a bucket of keys as batch N left them, `ledger/batch=N` names the buckets that the batch wrote, and is written last. A
table's rows are those of the newest batch of each bucket. A batch rewrites the buckets that its keys fall into and no other; a batch that is in the ledger changes nothing when it comes
again, and one that was cut off before its ledger leaves files that nobody reads and that its repeat overwrites. Batches have growing numbers and one writer at a time. What comes to the driver is
the ledger's newest batch of each bucket: `buckets` numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.shared import exists

BUCKETS = 32
_LEDGER = "bucket int, buckets int, batch long"


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_LEDGER).parquet(f"{folder}/ledger") if exists(spark, f"{folder}/ledger") else spark.createDataFrame([], _LEDGER)


def applied(spark: SparkSession, folder: str, batch: int) -> bool:
    return exists(spark, f"{folder}/ledger/batch={batch}/_SUCCESS")


def read(spark: SparkSession, folder: str, schema: str, only: list[int] | None = None) -> DataFrame:
    """Rows of the table, or of some of its buckets."""
    rows = _ledger(spark, folder).where("bucket >= 0")
    rows = rows if only is None else rows.where(F.col("bucket").isin(only))
    paths = [f"{folder}/data/batch={r['batch']}/bucket={r['bucket']}" for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()]
    return spark.read.schema(schema).parquet(*sorted(paths)) if paths else spark.createDataFrame([], schema)


def bucket_of(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def put(spark: SparkSession, folder: str, rows: DataFrame, schema: str, keys: tuple[str, ...], batch: int, buckets: int = BUCKETS) -> bool:
    """Replace or add rows by their keys, whether this batch had not been applied before. rows hold each key once; null keys are equal to each other."""
    if applied(spark, folder, batch):
        return False
    newest = _ledger(spark, folder).agg(F.max("batch").alias("batch"), F.max("buckets").alias("buckets")).first()
    if newest["batch"] is not None and (newest["batch"] >= batch or newest["buckets"] != buckets):
        raise ValueError(f"batch {batch} with {buckets} buckets after batch {newest['batch']} with {newest['buckets']}")
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    fresh = rows.select(*names).withColumn("bucket", bucket_of(keys, buckets))
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
    old = read(spark, folder, schema, touched).withColumn("bucket", bucket_of(keys, buckets)).alias("old")
    same = [F.col("old.bucket") == F.col("new.bucket"), *[F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]]
    kept = old.join(fresh.select("bucket", *keys).alias("new"), same, "left_anti")
    # Rows of a bucket are dealt to a few tasks, for a bucket may be larger than a task should be.
    kept.unionByName(fresh).repartition("bucket", F.pmod(F.hash(*keys), F.lit(4))).write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/data/batch={batch}")
    spark.createDataFrame([(b, buckets) for b in touched or [-1]], "bucket int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/batch={batch}")
    return True
