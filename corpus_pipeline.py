"""A training corpus from `documents` in five stages, each written as Parquet and read again.

Toxic documents go, one document of each group of near duplicates stays, documents with benchmark
windows go, sources are repeated or thinned to their weights, and what is left is shuffled
uniformly into shards of equal size. Every stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import cut, table
from quern.llm.decontamination import stage_decontamination
from quern.llm.mixing import stage_mixing
from quern.llm.neardup import stage_simhash
from quern.llm.sharding import stage_sharding
from quern.llm.toxicity import stage_toxicity

STAGES = [
    ("toxicity", stage_toxicity),
    ("simhash", stage_simhash),
    ("decontamination", stage_decontamination),
    ("mixing", stage_mixing),
    ("sharding", stage_sharding),
]
#: SQL cannot express the first, second and last stage; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
