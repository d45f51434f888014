"""Source documents of several media types to one table of parsed documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X
from quern.operators.index import DOCUMENT, checksum
from quern.sources import parsers

RAW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("external_id", "media_type", "content", "title", "url", "author", "category")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("published_at", T.TimestampType())]
)
_ALIASES = {"text": "text/plain", "txt": "text/plain", "plain": "text/plain", "html": "text/html", "htm": "text/html", "json": "application/json", "markdown": "text/markdown", "md": "text/markdown", "": "text/plain"}
_PARSED = "title string, own_title boolean, body string, author string, category string, url string, tags array<string>, published_at timestamp, error string"


class InvalidDocument(ValueError):
    """A payload that can't be a document."""


def media_type(value: Column) -> Column:
    """Lower case, without parameters, short names written out."""
    t = F.lower(F.trim(F.split_part(F.coalesce(value, F.lit("")), F.lit(";"), F.lit(1))))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _ALIASES.items() for x in kv]), t), t)


# ---- sources


def _optional(payload: Mapping, key: str) -> str | None:
    v = payload.get(key)
    if v is not None and (isinstance(v, bool) or not isinstance(v, str | int | float)):
        raise InvalidDocument(f"{key} must be text")
    return (str(v).strip() or None) if v is not None else None


def record(payload: Mapping) -> dict:
    """A payload checked and brought to the columns of RAW."""
    import json

    ident = str(payload.get("id", payload.get("external_id", "")) or "").strip()
    if not ident or len(ident) > 191:
        raise InvalidDocument("id is missing" if not ident else "id has over 191 characters")
    content = payload.get("content", payload.get("body"))
    if isinstance(content, dict | list):
        content = json.dumps(content, ensure_ascii=False)
    if not isinstance(content, str) or not content.strip():
        raise InvalidDocument("content is missing")
    tags = payload.get("tags") or []
    tags = tags.split(",") if isinstance(tags, str) else tags
    if not isinstance(tags, list | tuple):
        raise InvalidDocument("tags must be a list or text")
    when = payload.get("published_at") or None
    if when is not None and not isinstance(when, datetime):
        try:
            when = datetime.fromisoformat(str(when))
        except ValueError as e:
            raise InvalidDocument("published_at is no date") from e
    return {"external_id": ident, "media_type": str(payload.get("media_type", payload.get("type", "text/plain"))), "content": content, "tags": [str(t).strip() for t in tags], "published_at": when.replace(tzinfo=None) if when else None} | {k: _optional(payload, k) for k in ("title", "url", "author", "category")}


def from_payloads(spark: SparkSession, payloads: Iterable[Mapping]) -> DataFrame:
    return spark.createDataFrame([record(p) for p in payloads], RAW)


def from_json_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents, or one object a line."""
    df = spark.read.option("multiLine", True).json(path)
    has = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(None).cast("string"))
    tags = F.lit(None).cast("array<string>") if "tags" not in df.columns else F.col("tags") if dict(df.dtypes)["tags"].startswith("array") else F.split("tags", ",")
    content = has("content", "body") if not dict(df.dtypes).get("content", "").startswith("struct") else F.to_json("content")
    return df.select(has("id", "external_id").alias("external_id"), has("media_type", "type").alias("media_type"), content.alias("content"), *[has(n).alias(n) for n in ("title", "url", "author", "category")], tags.alias("tags"), F.try_to_timestamp(has("published_at")).alias("published_at"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: the name is the id, the extension the media type."""
    df = spark.read.text(path, wholetext=True).withColumn("_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    blank = {n: F.lit(None).cast("string") for n in ("title", "url", "author", "category")}
    return df.select(F.col("_name").alias("external_id"), F.element_at(F.split("_name", r"\."), -1).alias("media_type"), F.col("value").alias("content"), *[v.alias(n) for n, v in blank.items()], F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("timestamp").alias("published_at"))


# ---- parsing


def clean_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), X.trim), lambda t: t != ""))


def _plain(raw: DataFrame) -> DataFrame:
    """Text and markdown, by expressions alone: the first line is the title unless one is given."""
    raw = raw.select("*", F.explode(F.array(X.normalise_whitespace(F.col("content")))).alias("_c"))  # a generator: else each use below is computed anew
    heading = X.truncate(F.ltrim(X.first_line(F.col("_c")), F.lit("# ")), 120)
    own = F.col("title").isNull()
    body = F.when(own, X.let(X.without_first_line(F.col("_c")), lambda rest: F.when(rest != "", rest).otherwise(F.col("_c")))).otherwise(F.col("_c"))
    error = F.when(F.coalesce("_c", F.lit("")) == "", F.lit("the document has no text"))
    return raw.select(*[c for c in raw.columns if c not in ("_c", "title")], F.coalesce("title", heading).alias("title"), body.alias("body"), error.alias("error"))


def _python(parse: Callable[[str], dict]) -> Callable[[DataFrame], DataFrame]:
    names = [x.split()[0] for x in _PARSED.split(", ")]

    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append({n: None for n in names} | parse(c or ""))
            except parsers.ParseError as e:
                rows.append({n: None for n in names} | {"error": str(e)})
        return pd.DataFrame(rows, columns=names)

    def over(raw: DataFrame) -> DataFrame:
        raw = raw.withColumn("_p", F.pandas_udf(run, _PARSED)("content"))
        either = lambda n: F.coalesce(F.col(n), F.col(f"_p.{n}")).alias(n)  # noqa: E731  given metadata wins
        tags = F.when(F.size(clean_tags(F.col("tags"))) > 0, F.col("tags")).otherwise(F.col("_p.tags"))
        return raw.select("external_id", "media_type", "content", *[either(n) for n in ("title", "url", "author", "category", "published_at")], tags.alias("tags"), F.col("_p.body").alias("body"), F.col("_p.error").alias("error"))

    return over


_html = _python(parsers.parse_html)
#: Media type to parser; add to it to take in more.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "text/plain": _plain,
    "text/markdown": _plain,
    "text/html": _html,
    "application/xhtml+xml": _html,
    "application/json": _python(parsers.parse_json),
}


def checked(raw: DataFrame) -> DataFrame:
    """All RAW rows of known media types, parsed, with their checksums; `error` says why a row can't be a document."""
    parts = []
    for parser in dict.fromkeys(REGISTRY.values()):
        own = [m for m, p in REGISTRY.items() if p is parser]
        parts.append(parser(raw.withColumn("media_type", media_type(F.col("media_type"))).where(F.col("media_type").isin(own))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("tags", clean_tags(F.col("tags"))).select("*", checksum(*DOCUMENT).alias("checksum"))


def parse(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RAW rows to documents, and to (external_id, media_type, error) of those that can't be taken."""
    every, raw = checked(raw), raw.withColumn("media_type", media_type(F.col("media_type")))
    strange = raw.where(~F.col("media_type").isin(list(REGISTRY))).select("external_id", "media_type", F.lit(f"unknown media type; known: {', '.join(REGISTRY)}").alias("error"))
    bad = every.where("error is not null").select("external_id", "media_type", "error").unionByName(strange)
    return every.where("error is null").select(F.xxhash64("external_id").alias("doc_id"), *DOCUMENT, "checksum"), bad
