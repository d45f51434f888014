"""Near duplicates by SimHash: bit-sliced comparison in blocks that min-hashes make, verified by exact Jaccard similarity.

1. Each text gives the set of its word shingles (64-bit hashes), of that a wide fingerprint and
   BANDS keys of ROWS min-hashes each. Texts of equal words become one.
2. Texts that share a key are a bucket, and its fingerprints are compared bit-sliced. What is near
   forms a group; a set of texts that several keys bring together is one group.
3. The shingle sets of a group's texts are compared exactly. Only such pairs are links.
4. A document of each connected component stays.

The number of keys does not depend on the number of texts. A bucket of over BLOCK texts is dealt
out in blocks, each with the bucket's least text in it, so that a large group of copies becomes one
component without its pairs being formed; only texts that are not in a bucket's main component
then go to all of its blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, numbered, stowed
from quern.llm.components import components
from quern.llm.recompression import word_names
from quern.llm.repeats import Hashes, mix
from quern.llm.simhash import block_starts, labels_of, majority, pairs_in_blocks, whole_blocks
from quern.llm.words import LOWER, slices, text_bytes

#: Words of a shingle and the Jaccard similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Keys of a text and the min-hashes that each is made of: two sets of similarity 0.8 share no key with a chance of
#: (1 - 0.8^3)^12 = 0.00018, of 0.9 with 0.000000002; sets of 0.3 share one with 0.28, of 0.1 with 0.012.
BANDS, ROWS = 12, 3
#: Fingerprints have WORDS x 64 bits. Large sets of similarity 0.8 stand at 39 bits, give or take 6; sets of four and five
#: shingles, the worst case, at 48, give or take 6. RADIUS leaves four deviations to the latter.
WORDS, RADIUS = 4, 72
#: Texts that are compared as one block, and shingles that are verified at once.
BLOCK, LOAD = 1024, 1 << 20
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLY, _ADD = _SEEDS[: BANDS * ROWS] | np.uint64(1), _SEEDS[BANDS * ROWS :]


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (of all words if there are fewer; none: empty). Words are lower-cased, A-Z only."""
    names = word_names(text.translate(LOWER))
    if not len(names):
        return names
    h = Hashes(names)
    return np.unique(h.every(shingle) if len(names) >= shingle else h.of(np.array([0]), np.array([len(names)])))


def keys_of(found: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles; an empty set has none."""
    if not len(found):
        return found
    low = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(found), 1 << 13):
        low = np.minimum(low, (found[k : k + (1 << 13), None] * _MULTIPLY + _ADD).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(3) + low[r::ROWS])
    return key


def with_prints(docs: DataFrame, text: str) -> DataFrame:
    """docs without its text, with `same` (128 bits of the words), `size` (shingles), `keys` and f0, f1 ... (the fingerprint)."""
    names = [f"f{k}" for k in range(WORDS)]
    rest = [c for c in docs.columns if c != text]
    docs = docs.select(*rest, text)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in slices(batches):
            texts = text_bytes(b, text)
            sets = [shingles(t) for t in texts]
            same = [xxhash.xxh3_128_digest(b" ".join(t.translate(LOWER).split())) for t in texts]
            keys = [keys_of(x).view(np.int64) for x in sets]
            fps = np.stack([majority(x, WORDS) for x in sets]).view(np.int64) if sets else np.empty((0, WORDS), np.int64)
            new = [pa.array(same, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(fps[:, k]) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*rest, "same", "size", "keys", *names])

    empty = [F.lit(None).cast(t).alias(n) for n, t in (("same", "binary"), ("size", "long"), ("keys", "array<long>"), *((n, "long") for n in names))]
    return docs.mapInArrow(run, docs.select(*rest, *empty).schema)


def with_sets(docs: DataFrame, text: str) -> DataFrame:
    """(id, text) to (id, set): the shingles of each text."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).view(np.int64) for t in text_bytes(b, text)], pa.list_(pa.int64()))], ["id", "set"])

    return docs.select("id", text).mapInArrow(run, "id long, set array<long>")


def _group(radius: int):
    """Blocks, one after the other, from rows (key, c, late, id, f0 ...) sorted by block, to (group, id): texts that near fingerprints join.

    A group's number is a hash of its members, so the same members make the same group in any
    block. Where a block has late rows, only pairs with one of them count.
    """

    def run(batches):
        import pyarrow as pa

        for cols in whole_blocks(batches, 2):
            ids, late = cols[3], cols[2].astype(bool)
            starts = block_starts(cols[:2])
            first = ~np.repeat(np.logical_or.reduceat(late, starts), np.diff(np.append(starts, len(ids))))
            counts = lambda i, j: (late[i] | late[j] | first[i]) & (ids[i] != ids[j])  # noqa: E731, B023
            label = labels_of(len(ids), *pairs_in_blocks(np.stack(cols[4:], 1).view(np.uint64), starts, radius, counts=counts))
            order = np.argsort(label, kind="stable")
            cuts = block_starts([label[order]])
            number = np.add.reduceat(mix(ids.view(np.uint64)[order]), cuts)
            sizes = np.diff(np.append(cuts, len(order)))
            keep = np.repeat(sizes > 1, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number, sizes)[keep].view(np.int64)), pa.array(ids[order][keep])], ["group", "id"])

    return run


def grouped(rows: DataFrame, radius: int) -> DataFrame:
    """(key, c, late, id, f0 ...) to distinct (group, id)."""
    names = [f"f{k}" for k in range(WORDS)]
    d = rows.select("key", "c", "late", "id", *names).repartition("key", "c").sortWithinPartitions("key", "c")
    return d.mapInArrow(_group(radius), "group long, id long").distinct()


def similar_pairs(sets: list[np.ndarray], side: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs whose sets have this Jaccard similarity at least; exact.

    A set's intersections with all others are counted at once. Sets that are joined to all
    others already, and pairs of sizes too different, need no count. Where two blocks stand
    (`side` has two values), only pairs across them are counted; each block has its own turn.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    label = np.arange(n)
    out_i, out_j = [], []
    starts = np.cumsum(sizes) - sizes
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    across = (side != side[0]).any()
    for i in range(n - 1):
        ok = (label != label[i]) & (np.arange(n) > i) & (np.minimum(sizes, sizes[i]) >= similar * np.maximum(sizes, sizes[i]) - 1e-9) & (sizes > 0)
        if across:
            ok &= side != side[i]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        ends = np.cumsum(sizes[at])
        places = np.arange(ends[-1]) + np.repeat(starts[at] - (ends - sizes[at]), sizes[at])
        both = np.add.reduceat(marked[flat[places]].astype(np.int64), ends - sizes[at])
        marked[own] = False
        for j in at[both >= similar * (sizes[i] + sizes[at] - both) - 1e-9].tolist():
            if label[j] != label[i]:
                out_i.append(i)
                out_j.append(j)
                label[label == label[j]] = label[i]
    return np.array(out_i, np.int64), np.array(out_j, np.int64)


def _verify(similar: float):
    """Blocks, one after the other, from rows (group, i, j, c, id, set) that come sorted by block; a block may span batches."""

    def run(batches):
        import pyarrow as pa

        def emit(ids, sides, sets):
            ids = np.array(ids, np.int64)
            i, j = similar_pairs(sets, np.array(sides), similar)
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

        key, ids, sides, sets = None, [], [], []
        for b in batches:
            block = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            side, own, lists = b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)
            for k in range(b.num_rows):
                if block[k] != key:
                    if len(ids) > 1:
                        yield emit(ids, sides, sets)
                    key, ids, sides, sets = block[k], [], [], []
                ids.append(own[k])
                sides.append(side[k])
                sets.append(lists[k].values.to_numpy())
        if len(ids) > 1:
            yield emit(ids, sides, sets)

    return run


def verified(groups: DataFrame, sets: DataFrame, similar: float, block: int = 2 * BLOCK, load: int = LOAD) -> DataFrame:
    """(group, id) and (id, set) to links (a, b): forests of each group's pairs of this similarity. Groups of many shingles are dealt out as pairs of blocks."""
    sized = groups.join(sets.select("id", F.size("set").alias("size")), "id")
    count = sized.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / load)).cast("int").alias("_n"))
    d = groups.join(count, "group").withColumn("_c", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("_n")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("group", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"), "_c", "id")
    d = d.join(sets, "id").select("group", "i", "j", "_c", "id", "set")
    d = d.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return d.mapInArrow(_verify(similar), "a long, b long").distinct()


@stowed("text", "ident")
def dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id", similar: float = SIMILAR, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id (null last; of equal ids one row).

    Near duplicates have sets of word shingles of Jaccard similarity `similar` at least, compared
    exactly on 64-bit hashes of the shingles; groups are what such pairs join. Null and blank
    texts are one group; texts of under SHINGLE words are near their equals only; repeated rows
    are one group; an empty table gives an empty result. Rows go through as they are.
    """
    names = [f"f{k}" for k in range(WORDS)]
    rows = numbered(docs)
    where = F.struct(F.col("doc").isNull().alias("z"), "doc", "file", "row")
    slim = cut(with_prints(rows.select(F.col("_file").alias("file"), F.col("_row").alias("row"), F.col(ident).cast("long").alias("doc"), F.col(text).alias("text")), "text"), "prints")
    one = F.min(F.struct(where.alias("low"), "size", "keys", *names)).alias("m")
    texts = cut(slim.groupBy("same").agg(one).select(F.monotonically_increasing_id().alias("id"), "m.*"), "texts")  # ids hold from here on
    members = texts.select("id", *names, F.explode("keys").alias("key"))
    buckets = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / block).cast("int")
    # the least text of a large bucket stands in all of its blocks
    members = members.join(buckets, "key").withColumn("c", F.pmod(F.xxhash64(F.lit(7), "id"), blocks).cast("int"))
    every = F.when((F.col("id") == F.col("first")) & (blocks > 1), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("c"))
    groups = cut(grouped(members.withColumn("c", F.explode(every)).withColumn("late", F.lit(0)), radius), "groups")
    sets = _sets(rows, text, texts, groups)
    found = cut(verified(groups, sets, similar), "links")
    joined = components(found)
    large = cut(buckets.where(F.col("n") > block), "large")
    if not large.isEmpty():
        # texts of large buckets that are not in the bucket's main component meet all of its blocks
        own = members.where(F.col("n") > block).join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        own = cut(own.select("key", "c", "n", "root", "id", *names), "large")
        main = own.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
        own = own.join(cut(main, "main"), "key")
        late = own.where("root <> main").withColumn("c", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("late", F.lit(1))
        again = cut(grouped(own.withColumn("late", F.lit(0)).unionByName(late), radius), "groups")
        found = cut(found.unionByName(verified(again, _sets(rows, text, texts, again), similar)), "links")
        joined = components(found)
    lows = texts.select("id", "low").join(joined.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("low").alias("low"))
    kept = cut(lows.select(F.col("low.file").alias("_file"), F.col("low.row").alias("_row")), "kept")
    # texts move once, whatever the size: what stays grows with the input, so it is never broadcast
    return rows.join(kept.hint("merge"), ["_file", "_row"], "left_semi").drop("_file", "_row")


def _sets(rows: DataFrame, text: str, texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The shingle sets of the texts that are in any group, as a table."""
    needed = texts.join(groups.select("id").distinct(), "id", "left_semi").select("id", F.col("low.file").alias("_file"), F.col("low.row").alias("_row"))
    whole = rows.select("_file", "_row", F.col(text).alias("text")).join(cut(needed, "needed"), ["_file", "_row"])
    return cut(with_sets(whole, "text"), "sets")


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, texts whole."""
    return dedup(docs)
