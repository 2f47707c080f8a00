"""Storage that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session may have none: a temporary
    folder stands in for it then, as in tests. On a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meshweave-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/meshweave-{sc.applicationId}"


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there. The folder is the
    session's own; ``discard`` removes one table of it, ``clear`` all."""
    path = new_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def stored_by(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """The same as a table in ``buckets`` buckets of a column: joins and windows by that column read it where
    it lies, without a shuffle. Written from tasks that have a bucket each, every bucket is one file."""
    spark = df.sparkSession
    path = new_path(spark, what)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    back = spark.table(name)
    back.stored_at, back.stored_as = path, name
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of any store that Spark reaches; none there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Removes what ``stored`` wrote, once nothing reads it any more."""
    if name := getattr(df, "stored_as", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path := getattr(df, "stored_at", None):
        remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Removes all that the session has stored; its tables cannot be read afterwards."""
    remove(spark, shared_dir(spark))
