"""Exact-size uniform sharding by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from quern.llm.common import cut, numbered, stowed, table

SHARDS = 16
#: Logical partitions of the exchange matrix: one for ROWS rows, within these bounds. With SHARDS they bound what the driver holds.
PARTITIONS, MOST, ROWS = 1024, 16_384, 2_000_000


def _stirling_rest(n: int) -> float:
    """log n! less Stirling's main terms: (n + 1/2) log n - n + log sqrt(2 pi)."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    x = 1 / (n * n)
    return (1 / 12 - x * (1 / 360 - x * (1 / 1260 - x / 1680))) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where they are near."""
    d = x - mean
    if abs(d) < 0.1 * (x + mean):
        # log(x / mean) = 2 artanh(v)
        v = d / (x + mean)
        total, term, k = d * v, 2 * x * v, 1
        while True:
            term *= v * v
            new = total + term / (2 * k + 1)
            if new == total:
                return total
            total, k = new, k + 1
    return x * math.log(x / mean) + mean - x if x else mean


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """log of the binomial probability, to about 1e-15 of its size whatever n: errors of log n! never enter."""
    if n == 0 or x == 0 or x == n:
        return n * math.log1p(-p if q >= 0.5 else q - 1) if x == 0 else n * math.log(p)
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x)
    return rest - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_probability(good: int, bad: int, draws: int, x: int) -> float:
    """log P(x good ones among draws items taken without replacement): a quotient of binomial probabilities."""
    total = good + bad
    p, q = draws / total, (total - draws) / total
    return _log_binomial(x, good, p, q) + _log_binomial(draws - x, bad, p, q) - _log_binomial(draws, total, p, q)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One exact draw: how many of `draws` items taken without replacement are good.

    Inversion outward from the mode, so the work is about the standard deviation, at any size. What
    is beyond the places where probabilities vanish (about 1e-13 of the mass, with rounding) is drawn anew.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(log_probability(good, bad, draws, mode))
    while True:
        left = rng.random() - at_mode
        if left <= 0:
            return mode
        up, down, p_up, p_down = mode, mode, at_mode, at_mode
        while p_up + p_down > 1e-25:
            p_up = p_up * (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)) if up < high else 0.0
            up += 1
            left -= p_up
            if left <= 0:
                return up
            p_down = p_down * down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)) if down > low else 0.0
            down -= 1
            left -= p_down
            if left <= 0:
                return down


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows: partitions; columns: shards. Row sums are `counts`; column sums differ by one at most.

    Drawn as a uniform random permutation of all rows would give it: partition by partition, each
    row multivariate hypergeometric over the capacity that is left.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng, out = random.Random(seed), []
    for n in counts:
        row, rest, left = [], sum(room), n
        for s in range(shards):
            rest -= room[s]
            x = hypergeometric(rng, room[s], rest, left)
            row.append(x)
            left -= x
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def _mix(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def placed(slim: DataFrame, identity: list[str], shards: int = SHARDS, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """Numbered rows (`_file`, `_row` and the identity columns; a table) with `shard` and `slot`.

    Each row has a home among the logical partitions, by its identity and its place in its file, so
    that rows of equal identity are spread. An exact matrix of partition-to-shard counts is drawn on
    the driver (partitions x shards numbers), rows are permuted in their home, exchanged by that
    matrix, and permuted again in the shard.
    """
    spark = slim.sparkSession
    if partitions is None:
        partitions = min(MOST, max(PARTITIONS, 1 << (slim.count() // ROWS).bit_length()))
    ids = [F.col(c) for c in (*identity, "_row")]
    out = slim.withColumn("_home", F.pmod(_mix(seed, *ids), F.lit(partitions)).cast("int")).withColumn("_at", _mix(seed + 1, *ids))
    counts = {r["_home"]: r["n"] for r in out.groupBy("_home").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a partition
    matrix = communication_matrix([counts.get(p, 0) for p in range(partitions)], shards, seed)
    ends = [(p, list(accumulate(row))) for p, row in enumerate(matrix)]
    plan = spark.createDataFrame(ends, T.StructType([T.StructField("_home", T.IntegerType()), T.StructField("_ends", T.ArrayType(T.LongType()))]))
    local = W.partitionBy("_home").orderBy("_at", *[F.col(c).asc_nulls_last() for c in identity], "_row", "_file")
    out = out.withColumn("_rank", F.row_number().over(local)).join(F.broadcast(plan), "_home")
    # the first shard whose end reaches the rank
    out = out.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))))
    out = out.withColumn("_again", F.xxhash64(F.lit(seed + 2), "shard", "_home", "_rank"))
    # the second permutation: ranges of that hash are units, so that no task holds a shard
    bits = max(4, (partitions // shards).bit_length() + 1)
    out = out.withColumn("_range", F.shiftrightunsigned("_again", 64 - bits).cast("int"))
    within = W.partitionBy("shard", "_range").orderBy("_again", "_home", "_rank")
    out = out.withColumn("_in", F.row_number().over(within))
    starts = out.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # about 4 x partitions rows at most
    out = out.join(F.broadcast(starts), ["shard", "_range"])
    return out.withColumn("slot", (F.col("_start") + F.col("_in") - 1).cast("long")).drop("_home", "_at", "_rank", "_ends", "_again", "_range", "_in", "_start")


@stowed("identity")
def shard(df: DataFrame, identity: list[str], shards: int = SHARDS, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """Add `shard` (0 to shards-1) and `slot` (gapless from 0 in its shard): a uniform random shuffle of all rows.

    Law `rows`: shard sizes differ by one at most. Only row numbers and `identity` (columns that say
    what a row is; the order is by their hash and the row's place in its file, so reruns over the
    same files agree) are permuted and exchanged; the rows themselves move once, to meet their slot.
    Nulls are hashed as nulls, repeated rows are rows of their own, an empty table gives an empty
    result, and other columns go through untouched (existing `shard` and `slot` columns are replaced).
    """
    rows = numbered(df.drop("shard", "slot"))
    slim = cut(rows.select("_file", "_row", *identity), "sharding")
    slots = cut(placed(slim, identity, shards, seed, partitions).select("_file", "_row", "shard", "slot"), "slots")
    return rows.join(slots.hint("merge"), ["_file", "_row"]).drop("_file", "_row")  # a slot a row: too many to broadcast at any size that matters


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `rows`; text null counts as no bytes and crc32 of the empty text."""
    text = F.coalesce("text", F.lit(""))
    slim = numbered(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "_file",
        "_row",
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    slim = cut(slim, "sharding")  # ids and sizes only; the exchange and its counts read this, not the texts again
    out = placed(slim, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; copies of a document are rows of their own."""
    name = "_" + "".join(docs.columns)  # no column has it
    return shard(docs.withColumn(name, F.xxhash64("doc_id", "text")), [name]).select(*docs.columns, "shard", "slot")
