"""What the training-data operators share: the library's shared folder and tables, and columns that an operator doesn't know."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.storage import cut, drop, release, shared_dir, small_batches
from quern.storage import table as _table

__all__ = ["cut", "drop", "numbered", "release", "row_ids", "shared_dir", "small_batches", "stowed", "table"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return _table(spark, sf_dir, name)


def numbered(df: DataFrame) -> DataFrame:
    """df with `_file` and `_row`, two longs that together tell its rows apart, the same whenever it is read again.

    Rows of files are known by their file (a hash of its path) and their place in it, whatever the
    splits. Anything else than a selection from one file source is written once with its numbers.
    """
    small_batches(df.sparkSession)
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation":
        try:
            return df.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        except AnalysisException:  # a source whose files have no such columns
            pass
    return cut(df.select("*", F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_row")), "numbered")


def row_ids(df: DataFrame) -> DataFrame:
    """df with `_row`, one long that tells its rows apart, the same whenever it is read again (see numbered()).

    Files are numbered by the order of their hashes: 16 bytes a file, which the driver's own list of
    the files exceeds many times.
    """
    rows = numbered(df)
    files = sorted(r[0] for r in rows.select("_file").distinct().collect())
    of = df.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file long, _k long")
    return rows.join(F.broadcast(of), "_file").withColumn("_row", F.shiftleft("_k", 40) + F.col("_row")).drop("_file", "_k")


def stowed(*parameters: str) -> Callable:
    """For operators on a DataFrame, `parameters` naming those of their arguments that hold column names.

    All other columns get neutral names on the way in and their own on the way out, so that any
    name goes through: those the operator uses for itself, names with dots or blanks, names equal
    but for case. Where a result has a column's name, the result replaces it.
    """

    def wrap(fn):
        signature = inspect.signature(fn)

        @functools.wraps(fn)
        def run(docs: DataFrame, *args, **kw) -> DataFrame:
            bound = signature.bind(docs, *args, **kw)
            bound.apply_defaults()
            given = [bound.arguments[p] for p in parameters]
            used = {x for g in given for x in ([g] if isinstance(g, str) else g)}
            held = [c if c in used else f"own_{k}" for k, c in enumerate(docs.columns)]
            own = dict(zip(held, docs.columns, strict=True))
            out = fn(docs.toDF(*held), *args, **kw)
            new = [c for c in out.columns if c not in own]
            taken = {c.lower() for c in new}
            return out.select(*[F.col(c).alias(own[c]) for c in out.columns if c in own and own[c].lower() not in taken], *new)

        return run

    return wrap
