"""The inverted index as ordinary tables: built, looked up, updated, stored."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Settings
from quern.operators.invert import chunks
from quern.storage import shared_dir

#: Term frequency and field length are held to this in a posting; totals are not.
MOST = 65535
#: Rows of a page of stored chunks: what a term's scan reads of a segment at least.
PAGE = 2000
#: Columns of a document that are searched, stored or filtered.
DOCUMENT = ("external_id", "media_type", "title", "body", "url", "author", "category", "tags", "published_at")


def postings_from(chunks: DataFrame) -> DataFrame:
    """(term, field_id, doc_id, tf, field_length, positions, occurrences)."""
    rows = chunks.where("term is not null").select("term", "field_id", F.posexplode("ids").alias("_k", "doc_id"), "tfs", "lengths", "starts", "places")
    tf, held = F.get("tfs", F.col("_k")), lambda c: F.least(c, F.lit(MOST))
    return rows.select("term", "field_id", "doc_id", held(tf).alias("tf"), held(F.get("lengths", F.col("_k"))).alias("field_length"), F.slice("places", F.get("starts", F.col("_k")) + 1, tf).alias("positions"), tf.cast("long").alias("occurrences"))


def lengths_from(chunks: DataFrame) -> DataFrame:
    """(doc_id, field_id, length) of every field with text, fields of stop words alone at length 0."""
    return chunks.where("term is null").select("field_id", F.posexplode("ids").alias("_k", "doc_id"), "lengths").select("doc_id", "field_id", F.get("lengths", F.col("_k")).alias("length"))


def terms_from(chunks: DataFrame) -> DataFrame:
    """(term, document_frequency, total_frequency): term_statistics() without a row for each document."""
    return chunks.where("term is not null").groupBy("term").agg(F.sum("documents").alias("document_frequency"), F.sum("occurrences").alias("total_frequency"))


def postings_of(docs: DataFrame, settings: Settings) -> DataFrame:
    return postings_from(chunks(docs, settings))


def merged(postings: DataFrame) -> DataFrame:
    """Postings of rows that share a doc_id made one."""
    rows = postings.groupBy("term", "field_id", "doc_id").agg(F.sum("occurrences").alias("occurrences"), F.first("field_length").alias("field_length"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.count("positions").alias("n"))
    return rows.select("term", "field_id", "doc_id", F.least("occurrences", F.lit(MOST)).cast("int").alias("tf"), "field_length", F.when(F.col("n") > 0, F.col("positions")).alias("positions"), "occurrences")


def term_statistics(postings: DataFrame) -> DataFrame:
    """(term, document_frequency, total_frequency): documents of all fields together, and all occurrences."""
    by_doc = postings.groupBy("term", "doc_id").agg(F.sum("occurrences").alias("n"))
    return by_doc.groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"), F.sum("n").alias("total_frequency"))


def checksum(*columns: str) -> Column:
    """Changes when a document does: compared with earlier values of ours only."""
    return F.sha1(F.to_json(F.struct(*columns)))


@dataclass
class Statistics:
    documents: int
    average: dict[int, float]
    field_documents: dict[int, int]
    tokens: int


class Index:
    """documents, postings, terms and lengths of one corpus, with their settings."""

    def __init__(self, documents: DataFrame, postings: DataFrame, terms: DataFrame, lengths: DataFrame, settings: Settings):
        self.documents, self.postings, self.terms, self.lengths, self.settings = documents, postings, terms, lengths, settings
        self.chunks: DataFrame | None = None  # of an index as built: what its tables come from

    # ---- building

    @classmethod
    def build(cls, documents: DataFrame, settings: Settings | None = None) -> Index:
        """A lazy index of (doc_id, title, tags, body, ...) rows; save() it (or settled()) before many queries."""
        settings = settings or Settings()
        parts = chunks(documents, settings)
        index = cls(documents, postings_from(parts), terms_from(parts), lengths_from(parts), settings)
        if documents.groupBy("doc_id").count().where("count > 1").isEmpty():
            index.chunks = parts
        else:  # rows with one id: their postings are one document's
            index.postings = merged(index.postings)
            index.terms = term_statistics(index.postings)
        return index

    def settled(self) -> Index:
        """The same as tables in the folder that all executors share: short plans, and nothing to recompute if one is lost."""
        spark, path = self.documents.sparkSession, f"{shared_dir(self.documents.sparkSession)}/quern-index-{uuid.uuid4().hex}"
        if not hasattr(self.documents, "_quern_path"):
            return self.save(path)
        self._write(path, "overwrite")  # documents that cut() wrote are there already
        return self._read(spark, path, self.settings, self.documents)

    def save(self, path: str, mode: str = "overwrite") -> Index:
        """Parquet tables. Of a built index, chunks are written as they come, a segment of documents after the other and
        each sorted by term; terms and lengths are read from there. Other postings, and all terms, are ranged and sorted by
        term. So a term's scan skips all pages but its own, and of chunks only those of its terms become postings.
        """
        self.documents.write.mode(mode).parquet(f"{path}/documents")
        self._write(path, mode)
        return Index.load(self.documents.sparkSession, path, self.settings)

    def _write(self, path: str, mode: str) -> None:
        """All but the documents."""
        spark, postings = self.documents.sparkSession, f"{path}/postings"
        if self.chunks is not None:
            self.chunks.write.mode(mode).option("compression", "zstd").option("parquet.page.row.count.limit", PAGE).parquet(postings)
            parts = spark.read.parquet(postings)
            lengths, terms = lengths_from(parts), terms_from(parts)
        else:
            self.postings.repartitionByRange("term", "field_id", "doc_id").sortWithinPartitions("term", "field_id", "doc_id").write.mode(mode).parquet(postings)
            lengths, terms = self.lengths, term_statistics(spark.read.parquet(postings))
        lengths.write.mode(mode).parquet(f"{path}/lengths")
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode(mode).parquet(f"{path}/terms")

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: Settings | None = None) -> Index:
        return cls._read(spark, path, settings, spark.read.parquet(f"{path}/documents"))

    @classmethod
    def _read(cls, spark: SparkSession, path: str, settings: Settings | None, documents: DataFrame) -> Index:
        read = lambda t: spark.read.parquet(f"{path}/{t}")
        stored = read("postings")
        parts = stored if "ids" in stored.columns else None
        index = cls(documents, stored if parts is None else postings_from(parts), read("terms"), read("lengths"), settings or Settings())
        index.chunks = parts
        return index

    # ---- looking up

    @cached_property
    def statistics(self) -> Statistics:
        by = self.lengths.groupBy("field_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("s")).collect()  # a row a field
        return Statistics(
            self.documents.count(),
            {r["field_id"]: (r["s"] or 0) / r["n"] for r in by},
            {r["field_id"]: r["n"] for r in by},
            sum(r["s"] or 0 for r in by),
        )

    def frequencies(self, terms: Iterable[str]) -> dict[str, int]:
        """Document frequencies of a query's terms; unknown terms are missing."""
        terms = list(terms)
        if not terms:
            return {}
        got = self.terms.where(F.col("term").isin(terms) & (F.col("document_frequency") > 0)).select("term", "document_frequency").collect()
        return {r[0]: r[1] for r in got}

    def expansions(self, condition: Column, limit: int) -> DataFrame:
        """Dictionary terms by document frequency, then term."""
        return self.terms.where(condition & (F.col("document_frequency") > 0)).orderBy(F.desc("document_frequency"), "term").limit(limit)

    def expand_prefix(self, prefix: str, limit: int) -> list[tuple[str, int]]:
        return [(r["term"], r["document_frequency"]) for r in self.expansions(F.col("term").startswith(prefix), limit).collect()]

    def expand_wildcard(self, pattern: str, limit: int) -> list[tuple[str, int]]:
        return [(r["term"], r["document_frequency"]) for r in self.expansions(wildcard(pattern), limit).collect()]

    # ---- changing

    def upsert(self, batch: DataFrame, force: bool = False) -> tuple[Index, DataFrame]:
        """The index with a batch of documents (by external_id) taken in, and (external_id, status) of the batch.

        Status is created, updated, or unchanged where the checksum is the stored one (then nothing
        is written, unless forced). Old postings of changed documents go by an anti join, new ones
        are added, and term statistics are merged from the deltas of both. Of rows with one id in
        a batch, the last by checksum counts.
        """
        known = self.documents.select("external_id", F.col("doc_id").alias("_old"), F.col("checksum").alias("_sum"))
        batch = batch.withColumn("checksum", checksum(*[c for c in DOCUMENT if c in batch.columns]))
        sums = batch.groupBy("external_id").agg(F.max("checksum").alias("checksum"))  # statuses need no texts
        batch = batch.groupBy("external_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "external_id"]), "checksum").alias("r")).select("external_id", "r.*")
        same = F.col("_sum").eqNullSafe(F.col("checksum")) & F.lit(not force)
        told = lambda rows: rows.join(known, "external_id", "left").withColumn("status", F.when(F.col("_old").isNull(), "created").when(same, "unchanged").otherwise("updated"))
        changed = told(batch).where("status <> 'unchanged'").withColumn("doc_id", F.coalesce("_old", F.xxhash64("external_id")))
        new_docs = changed.select(*self.documents.columns)
        gone = changed.select("doc_id")
        parts = chunks(new_docs, self.settings)
        new = postings_from(parts)
        if self.chunks is not None:  # what a built index holds of a document comes from it again, without a row for each posting
            old = negative(terms_from(chunks(self.documents.join(gone, "doc_id", "left_semi"), self.settings)))
        else:
            old = deltas(self.postings.join(gone, "doc_id", "left_semi"))
        index = Index(
            self.documents.join(gone, "doc_id", "left_anti").select(*new_docs.columns).unionByName(new_docs),
            self.postings.join(gone, "doc_id", "left_anti").select(*new.columns).unionByName(new),
            merge(self.terms, terms_from(parts).unionByName(old)),
            self.lengths.join(gone, "doc_id", "left_anti").unionByName(lengths_from(parts)),
            self.settings,
        )
        return index, told(sums).select("external_id", "status")

    def delete(self, external_ids: list[str]) -> Index:
        """Without the given documents; their terms stay with frequency 0 until prune()."""
        gone = self.documents.where(F.col("external_id").isin(external_ids)).select("doc_id")
        old = self.postings.join(gone, "doc_id", "left_semi")
        rest = lambda t: t.join(gone, "doc_id", "left_anti").select(*t.columns)
        return Index(rest(self.documents), rest(self.postings), merge(self.terms, deltas(old)), rest(self.lengths), self.settings)

    def prune(self) -> Index:
        return Index(self.documents, self.postings, self.terms.where("document_frequency > 0"), self.lengths, self.settings)

    def clear(self) -> Index:
        """No postings, but the documents stay."""
        none = lambda t: t.where(F.lit(False))
        return Index(self.documents, none(self.postings), none(self.terms), none(self.lengths), self.settings)

    def reindex(self) -> Index:
        """Everything anew from the stored documents."""
        return Index.build(self.documents, self.settings)


def deltas(postings: DataFrame) -> DataFrame:
    """What goes with these postings."""
    return negative(term_statistics(postings))


def negative(terms: DataFrame) -> DataFrame:
    return terms.select("term", (-F.col("document_frequency")).alias("document_frequency"), (-F.col("total_frequency")).alias("total_frequency"))


def merge(terms: DataFrame, changes: DataFrame) -> DataFrame:
    return terms.unionByName(changes).groupBy("term").agg(F.sum("document_frequency").alias("document_frequency"), F.sum("total_frequency").alias("total_frequency"))


def wildcard(pattern: str) -> Column:
    """`*` any characters, `?` one; the literal head goes in as startswith, which reaches the scan."""
    literal = set("\\.[]{}()+^$|")
    body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in literal else c for c in pattern)
    head = pattern[: min([pattern.find(c) for c in "*?" if c in pattern] or [len(pattern)])]
    fits = F.col("term").rlike(f"^(?s:{body})$")
    return F.col("term").startswith(head) & fits if head else fits
