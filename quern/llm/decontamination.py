"""Benchmark decontamination: exact occurrences of item windows, by a prefix-filtered set join.

1. Items become windows, and windows shingles of GRAM words (a shorter window is one shingle).
2. Shingles of any window are counted in all documents, which orders them by rarity. A window that
   occurs has all its shingles in a document, so its rarest one is the prefix that must be there.
3. Places of prefix shingles in documents are joined with the windows by that shingle; the shingle's
   place in the window and the window's length say which words must stand about the place
   (position and length bounds), and those are compared word by word.

Both sides are tables of any size. What every task gets is a bit map of the shingles to look for, of
MAP bits at most: it lets all of them through, and others the more, the more it holds; the joins are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, numbered, stowed, table
from quern.llm.recompression import word_names
from quern.llm.repeats import Hashes, mix
from quern.llm.words import LETTERS, letter_words, slices, text_bytes

#: Words of a window, and of a shingle.
WINDOW, GRAM = 10, 3
#: Bits of a bit map at most (32 MB), bits that are set for a shingle, and bits of the map for each.
MAP, PROBES, ROOM = 1 << 28, 3, 32


def shingles(names: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each `gram` consecutive words, by the words' names."""
    return mix(Hashes(names).every(gram) + np.uint64(gram)) if len(names) >= gram else np.empty(0, np.uint64)


def _windows(window: int):
    """Items (item, text) to (item, w, length, grams): window text, words, and its shingles' hashes."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            out: list[list] = [[], [], [], []]
            for item, t in zip(b.column(0).to_pylist(), text_bytes(b, "text"), strict=True):
                words, names = letter_words(t), word_names(t.translate(LETTERS))
                n = min(window, len(words))
                found = shingles(names, min(GRAM, n)).view(np.int64) if n else None
                for k in range(len(words) - n + 1 if n else 0):
                    for o, v in zip(out, (item, b" ".join(words[k : k + n]).decode(), n, found[k : k + n - min(GRAM, n) + 1]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))], ["item", "w", "length", "grams"])

    return run


class BitMap:
    """A set of 64-bit hashes that says yes to all it holds and, seldom, to others."""

    def __init__(self, count: int):
        bits = 1 << 16
        while bits < min(MAP, count * ROOM):
            bits *= 2
        self.mask, self.bits = np.uint64(bits - 1), np.zeros(bits // 8, np.uint8)

    def _places(self, x: np.ndarray):
        for k in range(PROBES):
            at = mix(x + np.uint64(k + 1)) & self.mask
            yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def add(self, x: np.ndarray) -> None:
        for byte, bit in self._places(x):
            np.bitwise_or.at(self.bits, byte, bit)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places in x of hashes that may be held."""
        at = np.arange(len(x))
        for k in range(PROBES):
            h = mix(x[at] + np.uint64(k + 1)) & self.mask
            at = at[(self.bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
        return at


def _bit_map(hashes: DataFrame) -> BitMap:
    """Of a table's one column; the driver takes it batch by batch and holds the map alone."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary())], ["packed"])

    out = BitMap(hashes.count())
    for r in hashes.mapInArrow(pack, "packed binary").toLocalIterator():
        out.add(np.frombuffer(r["packed"], np.uint64))
    return out


def _counts(held, lengths: list[int]):
    """(text) to (gram, n): how often a batch has each shingle that the map lets through."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [np.empty(0, np.uint64)]
            for part in slices([b]):
                for t in text_bytes(part, "text"):
                    names = word_names(t.translate(LETTERS))
                    for n in lengths:
                        g = shingles(names, n)
                        found.append(g[held.value.find(g)])
            g, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    return run


def _places(held, lengths: list[int], window: int):
    """(file, row, text) to (file, row, n_words, gram, lead, about): a row a text, and one for each place of a shingle with the words about it."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            take: list[int] = []
            out: list[list] = [[], [], [], []]
            for k, t in enumerate(text_bytes(b, "text")):
                plain = t.translate(LETTERS)
                names = word_names(plain)
                take.append(k)
                for o, v in zip(out, (len(names), None, None, None), strict=True):
                    o.append(v)
                words = None
                for n in lengths:
                    g = shingles(names, n)
                    for p in held.value.find(g).tolist():
                        words = words if words is not None else plain.split()
                        a = max(0, p - window + 1)
                        take.append(k)
                        for o, v in zip(out, (None, int(g[p].view(np.int64)), p - a, (p, b" ".join(words[a : p + window]).decode())), strict=True):
                            o.append(v)
            take = pa.array(take, pa.int64())
            place = pa.array([v and v[0] for v in out[3]], pa.int64())
            about = pa.array([v and v[1] for v in out[3]], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), place, about], ["file", "row", "n_words", "gram", "lead", "place", "about"])

    return run


def _merged(spans: Column) -> Column:
    """Sorted (start, end) spans to a flat array start, end, start, end ... of their union."""
    put = lambda a, x: F.concat(a, F.array(x["start"], x["end"]))
    widen = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.greatest(F.element_at(a, -1), x["end"])))
    joins = lambda a, x: (F.size(a) > 0) & (x["start"] <= F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)))
    return F.aggregate(spans, F.array().cast("array<bigint>"), lambda a, x: F.when(joins(a, x), widen(a, x)).otherwise(put(a, x)))


def search(rows: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Numbered rows to (file, row, n_words), a row each, and (file, row, hit_spans, item_ids) of those that hold windows."""
    spark = rows.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    windows = cut(items.mapInArrow(_windows(window), "item string, w string, length int, grams array<long>").distinct(), "windows")
    texts = rows.select(F.col("_file").alias("file"), F.col("_row").alias("row"), F.col(text).alias("text"))
    grams = cut(windows.select(F.explode("grams").alias("gram")).distinct(), "grams")
    lengths = sorted(r[0] for r in windows.select(F.least("length", F.lit(GRAM))).distinct().collect())  # GRAM numbers at most
    held = spark.sparkContext.broadcast(_bit_map(grams))
    often = texts.select("text").mapInArrow(_counts(held, lengths), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    often = cut(often.join(grams, "gram", "left_semi"), "often")
    each = windows.groupBy("w", "length").agg(F.first("grams").alias("grams")).select("w", "length", F.size("grams").alias("of"), F.posexplode("grams").alias("at", "gram"))
    # a window one of whose shingles no document has does not occur; the rarest shingle of the others is their prefix
    able = each.join(often, "gram").groupBy("w", "length", "of").agg(F.count(F.lit(1)).alias("have"), F.min(F.struct("n", "gram", "at")).alias("m")).where("have = of")
    able = cut(able.select("w", "length", F.col("m.gram").alias("gram"), F.col("m.at").alias("at")), "prefixes")
    prefix = spark.sparkContext.broadcast(_bit_map(able.select("gram").distinct()))
    places = cut(texts.mapInArrow(_places(prefix, lengths, window), "file long, row long, n_words long, gram long, lead int, place long, about string"), "places")
    start = F.col("lead") - F.col("at")
    same = (start >= 0) & (F.array_join(F.slice(F.split("about", " "), F.greatest(start, F.lit(0)) + 1, F.col("length")), " ") == F.col("w"))
    hits = places.where("gram is not null").join(able, "gram").where(same).select("file", "row", (F.col("place") - F.col("at")).alias("start"), "length", "w")
    hits = cut(hits, "hits")
    spans = hits.groupBy("file", "row").agg(_merged(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))).alias("hit_spans"))
    named = hits.select("file", "row", "w").distinct().join(windows.select("w", "item"), "w").groupBy("file", "row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    return places.where("n_words is not null").select("file", "row", "n_words"), cut(spans.join(named, ["file", "row"]), "contaminated")


@stowed("text")
def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, hit_spans (flat word spans start, end, start, end ... merged) and item_ids (sorted) of benchmark windows.

    A window is `window` consecutive words of an item, or all words of a shorter one. Null texts
    and items have no words, hence no hits; a null item id is written "null"; repeated items count
    once; repeated documents are rows of their own. Existing columns named like the results are
    replaced, others go through.
    """
    rows = numbered(docs.drop("n_words", "hit_spans", "item_ids"))
    counts, found = search(rows, benchmark, text, item_id, item_text, window)
    key = [F.col("file").alias("_file"), F.col("row").alias("_row")]
    out = rows.join(counts.select(*key, "n_words"), ["_file", "_row"]).join(found.select(*key, "hit_spans", "item_ids"), ["_file", "_row"], "left").drop("_file", "_row")
    none = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    return out.withColumn("hit_spans", F.coalesce("hit_spans", none[0])).withColumn("item_ids", F.coalesce("item_ids", none[1]))


@stowed("text")
def without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no benchmark window, as they are."""
    rows = numbered(docs)
    _, found = search(rows, benchmark, text, item_id, item_text, window)
    return rows.join(found.select(F.col("file").alias("_file"), F.col("row").alias("_row")), ["_file", "_row"], "left_anti").drop("_file", "_row")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_items(docs, table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: x - a)  # alternating sum: ends less starts
    return out.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents free of benchmark windows."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
p AS (
  SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM i) WHERE len(w) >= l),
h AS (
  SELECT doc_id, k, i.l, item_id FROM p JOIN i ON p.l = i.l AND array_to_string(w[k:k + p.l - 1], ' ') = i.s),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS x FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(x, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
