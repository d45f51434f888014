"""Mixing sources to target weights: repetition rates and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quern.llm.common import cut, stowed, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Percent of all words that the mix holds, and how often a source may be repeated.
SHARE, MOST = 150, 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weighted shares of SHARE % of all sizes.

    A target stops at MOST times its source; the excess is shared anew by weight until none is
    above. That fixpoint is a water level: with sources in the order of cap / weight, the first k
    are full and the rest get (total - their caps) * weight / (weights left). Windows here run over
    one row a source. Null is a source of its own, the last.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("_w", w.cast("long")).withColumn("_cap", F.col("source_size") * MOST)
    by = W.orderBy(F.col("_cap").cast("double") / F.col("_w"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = s.withColumn("_total", F.sum("source_size").over(every) * F.lit(SHARE / 100.0))
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(upto), F.lit(0)))
    s = s.withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0)))
    s = s.withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_left"))
    # the level holds from the first source that it doesn't fill
    s = s.withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    s = s.withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_left") * -1, "_level"))).over(every)["_level"])
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


@stowed("text", "source", "ident")
def with_copies(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Each document with `_words`, `_source_size`, `_target` and `_copies`: floor(rate) plus one more where its hash falls under the fraction.

    The rate is target / source words. A null or blank text has no words; a source without words
    has rate 0. The draw is from md5(seed, id), or the text where the id is null, so reruns agree
    and repeated rows get equal draws.
    """
    d = docs.withColumn("_words", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    sizes = d.groupBy(F.col(source).alias("source")).agg(F.sum("_words").alias("source_size"))
    t = targets(sizes).select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    t = cut(t, "targets")  # of known size: below the broadcast threshold the texts are not shuffled
    d = d.join(t, d[source].eqNullSafe(t["_s"])).drop("_s")
    key = F.coalesce(F.col(ident).cast("string"), F.md5(F.col(text)), F.lit(""))
    return d.withColumn("_copies", copies(F.col("_target"), F.col("_source_size"), key, seed).cast("int"))


@stowed("text", "source", "ident")
def mix(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    out = with_copies(docs, text, source, ident, seed)
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.greatest("_copies", F.lit(1))))).where("_copies > 0").select(*docs.columns)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # word counts once: the sums and the draws read (id, source, words), not the texts again
    slim = docs.select("doc_id", "source", F.when(F.col("doc_id").isNull(), F.md5("text")).alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    slim = cut(slim, "mixing")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = cut(targets(sizes).withColumnRenamed("source", "_s"), "targets")
    d = slim.join(t, slim["source"].eqNullSafe(t["_s"]))
    return d.select("doc_id", "size", "source_size", "target", (copies(F.col("target"), F.col("source_size"), F.coalesce(F.col("doc_id").cast("string"), "text_key", F.lit(""))) * F.col("size")).alias("taken"))


def copies(target: Column, source_size: Column, key: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more where the draw from md5(seed, key) is under the fraction."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(text), '') AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM d GROUP BY source),
c AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w FROM s),
o AS (
  SELECT *, (total - coalesce(sum(cap) OVER win, 0)::DOUBLE) / (all_w - coalesce(sum(w) OVER win, 0))::DOUBLE AS lv
  FROM c WINDOW win AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, first_value(CASE WHEN lv * w <= cap THEN lv END IGNORE NULLS) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lf FROM o),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(lf * w, cap::DOUBLE)) AS target FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1|' || d.k), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + (draw < rate - floor(rate))::INT) * size)::BIGINT AS taken FROM r
"""
