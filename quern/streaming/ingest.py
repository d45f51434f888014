"""Continuous ingest: each micro-batch of source documents is taken into a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.config import Settings
from quern.operators.index import Index
from quern.sources import documents as sources


def ingest(raw: DataFrame, path: str, checkpoint: str, settings: Settings | None = None, once: bool = True) -> StreamingQuery:
    """A stream of RAW rows into `path`, a new generation of tables a batch; the pointer file moves last.

    A batch that is run again after a failure writes the same generation again, and documents it
    already holds are unchanged by checksum, so every document counts once.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        docs, _ = sources.parse(batch)
        now = current(spark, path, before=number)
        if now is None:
            docs = docs.groupBy("external_id").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "external_id"]), "checksum").alias("r")).select("external_id", "r.*")
            index = Index.build(docs, settings)
        else:
            index = Index.load(spark, f"{path}/{now}", settings).upsert(docs)[0]
        index.save(f"{path}/{number}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/done/number={number}")

    writer = raw.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def current(spark, path: str, before: int | None = None) -> int | None:
    """The newest generation that was written whole."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    numbers = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p)]
    return max((n for n in numbers if before is None or n < before), default=None)
