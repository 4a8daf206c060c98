"""Reading the test tables, and the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, a single file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    It is read from the session. Only where it is unset (tests, a laptop) a folder under the
    session's warehouse directory stands in for it, which is not lost with a single executor.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/")
    return f"{base}/_shared"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass

    atexit.register(remove)
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it is so small that a scan would leave most of them without work.

    Spark does not cut files below `spark.sql.files.openCostInBytes`. Fewer files than cores, below that size
    for each core, are dealt out row by row before an expensive function; what is shuffled is bounded by
    that size. Larger tables stay as they are scanned.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    cost = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    small = cores > 1 and size < cost * cores and len(df.inputFiles()) < cores
    return df.repartition(cores) if small else df
