"""Where intermediate tables go, and how they are written."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only a local session without that setting gets a temporary folder; on a
    cluster a folder of one machine would lose rows, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="sablecloth-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here,
    and lost executors cost at most their current tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def written_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written(), with files by hash of a key: joins by that key needn't shuffle the rows."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    df.write.format("parquet").option("path", path).bucketBy(parts(spark), key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more.

    Spark drops shuffle files once the driver has collected the plans that made
    them, so the plans of earlier steps are collected too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def give_back_heap(spark: SparkSession) -> None:
    """Has every executor collect its garbage, after which a JVM returns heap that it doesn't need.

    A JVM keeps all heap that a stage made it take, and the Python workers of the next
    stage come on top of that.  One small task a core, so every executor gets some."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
