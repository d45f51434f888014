"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


#: Bytes of an Arrow batch to Python: with long texts the default of 10,000 rows or 64 MB is too much beside a batch's results.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on, this session's Arrow batches to Python hold BATCH bytes at most (or one row); a lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH if spark.conf.get(key).rstrip("b").isdigit() else True:
        spark.conf.set(key, str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs in one process (tests, a laptop) a temporary folder
    is made and set; on a cluster that is an error, as no other machine sees such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here.

    The files survive the loss of any executor; drop() removes them early.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quern_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more, and let Spark clear old shuffles."""
    for df in tables:
        spark, path = df.sparkSession, df._quern_path
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that made them; ask for it between phases."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores (one large row group, say), dealt out to all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
