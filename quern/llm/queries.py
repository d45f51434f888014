"""The operators' queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontamination, licenses, mixing, neighbours, pii, recompression, sharding, simhash, suffixes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffixes": suffixes.op1_suffixes,
        "op2_pii": pii.op2_pii,
        "op3_sharding": sharding.op3_sharding,
        "op4_mixing": mixing.op4_mixing,
        "op5_simhash": simhash.op5_simhash,
        "op6_licenses": licenses.op6_licenses,
        "op7_neighbours": neighbours.op7_neighbours,
        "op8_recompression": recompression.op8_recompression,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_decontamination": decontamination.op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.OP4_SQL,
        "op6_licenses": licenses.OP6_SQL,
        "op10_decontamination": decontamination.OP10_SQL,
    }
