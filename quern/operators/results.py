"""What follows matching: top hits, date order, facets, suggestions, search logs, statistics."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.index import Index

LOG = "query string, normalised_query string, filters string, hit_count long, took_us long, created_at timestamp"


# ---- hits


def top(matched: DataFrame, offset: int, size: int) -> DataFrame:
    """Best score first, ties to the smaller id."""
    return matched.orderBy(F.desc("score"), "doc_id").offset(offset).limit(size)


def summary(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("total"), F.max("score").alias("max_score"))


def by_date(matched: DataFrame, documents: DataFrame, newest: bool, offset: int, size: int) -> DataFrame:
    """newest: dates descending, undated last; oldest: ascending, undated first. Scores are 0."""
    rows = documents.select("doc_id", "published_at").join(matched.select("doc_id"), "doc_id", "left_semi")
    order = [F.desc_nulls_last("published_at"), F.desc("doc_id")] if newest else [F.asc_nulls_first("published_at"), F.asc("doc_id")]
    return rows.orderBy(*order).offset(offset).limit(size).select("doc_id", F.lit(0.0).alias("score"), "published_at")


def sort_name(name: str | None) -> str:
    n = (name or "").lower()
    return "newest" if n in ("newest", "date", "date_desc") else "oldest" if n in ("oldest", "date_asc") else "relevance"


# ---- facets


def facet(documents: DataFrame, column: str, limit: int, matched: DataFrame | None = None) -> DataFrame:
    """(value, count) of a column or of an array's elements, over matched documents; most frequent first."""
    rows = documents if matched is None else documents.join(matched.select("doc_id"), "doc_id", "left_semi")
    value = F.explode(F.array_distinct(column)) if dict(documents.dtypes)[column].startswith("array") else F.col(column)
    rows = rows.select(value.alias("value")).where(F.col("value").isNotNull())
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def published_range(documents: DataFrame) -> DataFrame:
    return documents.agg(F.min("published_at").alias("earliest"), F.max("published_at").alias("latest"))


# ---- search logs


def normalise_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(query), r"(?U)\s+", " "))


def log_entry(spark: SparkSession, query: str, filters: str | None, hits: int, micros: int) -> DataFrame:
    row = spark.createDataFrame([(query[:512], None, filters, hits, micros, datetime.now(UTC).replace(tzinfo=None))], LOG)
    return row.withColumn("normalised_query", F.substring(normalise_query(F.col("query")), 1, 191)).select(*[c.split()[0] for c in LOG.split(", ")])


def popular(logs: DataFrame, limit: int = 10, prefix: str | None = None) -> DataFrame:
    """(query, searches) of queries that found something, perhaps of those that start with a prefix."""
    rows = logs.where("hit_count > 0")
    if prefix:
        rows = rows.where(F.col("normalised_query").startswith(" ".join(prefix.lower().split())))
    return rows.groupBy(F.col("normalised_query").alias("query")).agg(F.count(F.lit(1)).alias("searches")).orderBy(F.desc("searches"), "query").limit(max(1, limit))


def log_statistics(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.coalesce(F.avg("took_us"), F.lit(0.0)) / 1000, 3).alias("average_ms"),
        F.round(F.coalesce(F.max("took_us"), F.lit(0)) / 1000, 3).alias("slowest_ms"),
        F.coalesce(F.sum(F.when(F.col("hit_count") == 0, 1).otherwise(0)), F.lit(0)).alias("empty_results"),
    )


def recent(logs: DataFrame, limit: int = 20) -> DataFrame:
    return logs.orderBy(F.desc("created_at")).limit(max(1, limit)).select("query", "hit_count", "took_us", "created_at")


# ---- suggestions and statistics


def suggest(index: Index, typed: str, prefix: str, size: int = 8) -> DataFrame:
    """(term, documents, query): completions of the last typed word, the words before it kept."""
    before = typed.split()[:-1]
    rows = index.expansions(F.col("term").startswith(prefix), min(size, 25))
    return rows.select("term", F.col("document_frequency").alias("documents"), F.concat_ws(" ", *[F.lit(w) for w in before], "term").alias("query"))


def field_statistics(index: Index) -> DataFrame:
    """(field_id, documents, average_length)."""
    return index.lengths.groupBy("field_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("length"), 2).alias("average_length"))


def index_statistics(index: Index) -> DataFrame:
    """One row: documents, terms, postings, tokens, tokens_per_posting."""
    d = index.documents.agg(F.count(F.lit(1)).alias("documents"))
    t = index.terms.where("document_frequency > 0").agg(F.count(F.lit(1)).alias("terms"))
    p = index.postings.agg(F.count(F.lit(1)).alias("postings"))
    n = index.lengths.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    one = d.crossJoin(t).crossJoin(p).crossJoin(n)  # four tables of one row
    return one.withColumn("tokens_per_posting", F.when(F.col("postings") > 0, F.round(F.col("tokens") / F.col("postings"), 2)))
