"""SimHash near-duplicates: fingerprints, bit-sliced comparison in blocks, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, stowed, table
from quern.llm.components import components
from quern.llm.repeats import mix
from quern.llm.words import slices, spaced_words, text_bytes

#: Members of a bucket that are compared as one block; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024
#: Blocks of fewer members are compared side by side in shared lanes; larger ones have lanes of their own.
FEW = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Bit k is set where over half of the hashes have it. For more than 64 bits, further hashes are mixed from each."""
    ones = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), 1 << 13):  # bounded for very long texts
        h = hashes[k : k + (1 << 13)]
        h = np.stack([h, *(mix(h + np.uint64(0x9E3779B97F4A7C15 * w & (1 << 64) - 1)) for w in range(1, words))], 1)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int) -> np.uint64:
    """The majority of the shingles' XXH64 (seed 42), repeats included. No words in the text: 0."""
    import xxhash

    split = spaced_words(text)
    if not split:
        return np.uint64(0)
    joined = b" ".join(split)
    digest = xxhash.xxh64_intdigest
    if len(split) <= shingle:
        return majority(np.array([digest(joined, 42)], np.uint64))[0]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes + 1) - 1
    starts, stops = (ends - sizes)[: len(split) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return majority(np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, len(starts)))[0]


@stowed("text")
def with_fingerprint(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """docs with a long column f0, the whole text's fingerprint; null and blank texts have 0."""
    docs = docs.drop("f0")

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in text_bytes(b, text)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*b.schema.names, "f0"])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("long").alias("f0")).schema)


def exact_tables(radius: int) -> list[np.ndarray]:
    """Bits of each table for one-word fingerprints, exact: 64 bits in radius + 2 parts, all choices of two.

    Words within the radius differ in `radius` parts at most, so they agree in one choice at least.
    """
    parts = np.array_split(np.arange(64), radius + 2)
    return [np.concatenate(c) for c in combinations(parts, 2)]


def _place(tables: list[np.ndarray], words: int):
    """Fingerprints to their bucket in each table."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.stack([c.to_numpy() for c in b.columns], 1).view(np.uint64)
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little").astype(np.int64) if len(fp) else np.zeros((0, 64 * words), np.int64)
            for t, chosen in enumerate(tables):
                key = bits[:, chosen] @ (1 << np.arange(len(chosen), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(key), *b.columns], ["t", "key", *b.schema.names])

    return run


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of 64-bit words) stood up: plane k holds bit k of every row, 64 rows a lane."""
    n, words = fps.shape
    lanes = -(-n // 64)
    planes = np.zeros((64 * words, lanes * 64), np.uint8)
    planes[:, :n] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little").T
    return np.packbits(planes, axis=1, bitorder="little").view(np.uint64)


def moved(planes: np.ndarray, by: int) -> np.ndarray:
    """Planes in which row i + by stands at row i."""
    q, r = divmod(by, 64)
    out = np.zeros_like(planes)
    out[:, : planes.shape[1] - q] = planes[:, q:] >> np.uint64(r)
    if r:
        out[:, : max(0, planes.shape[1] - q - 1)] |= planes[:, q + 1 :] << np.uint64(64 - r)
    return out


def _full(a, b, c):
    """Full adder of three bit vectors: sum and carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(differ, over: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save counting of differing bits, 64 comparisons a lane. (blocks that are left, their lanes' pairs beyond the radius).

    `over` (blocks, lanes) says what is no pair or beyond already; differ(k, blocks) gives eight
    planes from k on of those blocks' differences. Eight planes go through seven full adders into
    the counters' digits; then the counts are compared with the radius, bit-sliced too, and blocks
    all of whose pairs have passed it are abandoned.
    """
    live = np.arange(len(over))
    digits = [np.zeros_like(over) for _ in range(bits.bit_length())]
    for k in range(0, bits, 8):
        x = differ(k, live)
        s1, c1 = _full(digits[0], x[0], x[1])
        s2, c2 = _full(s1, x[2], x[3])
        s3, c3 = _full(s2, x[4], x[5])
        digits[0], c4 = _full(s3, x[6], x[7])
        t1, d1 = _full(digits[1], c1, c2)
        digits[1], d2 = _full(t1, c3, c4)
        digits[2], carry = _full(digits[2], d1, d2)
        for d in range(3, len(digits)):
            carry, digits[d] = digits[d] & carry, digits[d] ^ carry
        more, same = np.zeros_like(over), np.full_like(over, FULL)
        for d in range(len(digits) - 1, -1, -1):
            if radius >> d & 1:
                same = same & digits[d]
            else:
                more |= same & digits[d]
                same = same & ~digits[d]
        over = over | more
        left = (over != FULL).any(1)
        if not left.all():
            live, over, digits = live[left], over[left], [x[left] for x in digits]
            if not len(live):
                break
    return live, over


def close_pairs(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one block's fingerprints within the radius, 512 rows i at a time: each row against all lanes of the block."""
    n, words = fps.shape
    planes = bit_planes(fps)
    own_bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    none = ~np.packbits(np.arange(planes.shape[1] * 64) < n, bitorder="little").view(np.uint64)
    for r0 in range(0, n, 512):
        own = (own_bits[r0 : r0 + 512].astype(np.uint64) * FULL).T
        differ = lambda k, live: planes[k : k + 8, None, :] ^ own[k : k + 8, live, None]  # noqa: E731, B023
        live, over = within(differ, np.repeat(none[None, :], own.shape[1], 0), 64 * words, radius)
        if len(live):
            i, j = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :n])
            i = live[i] + r0
            yield i[i < j], j[i < j]


def pairs_in_blocks(fps: np.ndarray, starts: np.ndarray, radius: int, few: int = FEW, counts: Callable = lambda i, j: True) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join whatever pairs of rows within the radius and in one block join (blocks stand one after the other), all bit-sliced.

    Only pairs that counts(i, j) takes are looked at. At most 512 x the members of a block and `few`
    x all rows are held as pairs; of a large block a forest goes on. Blocks of `few` rows or more are compared one by one. Smaller ones share lanes: all pairs at
    one distance in the order of rows are compared at once, planes against the same planes moved.
    """
    size = np.diff(np.append(starts, len(fps)))
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s, n in zip(starts[size >= few].tolist(), size[size >= few].tolist(), strict=True):
        star_i, star_j = np.empty(0, np.int64), np.empty(0, np.int64)
        for i, j in close_pairs(fps[s : s + n], radius):
            ok = np.broadcast_to(counts(s + i, s + j), len(i))
            star_i, star_j = forest(n, np.concatenate([star_i, i[ok]]), np.concatenate([star_j, j[ok]]))
        out_i.append(s + star_i)
        out_j.append(s + star_j)
    own, stop = np.repeat(size, size), np.repeat(starts + size, size)
    at, planes = np.arange(len(fps)), None
    step, most = 1, int(size[size < few].max(initial=0))
    while step < most:
        if planes is None or step & (step - 1) == 0:  # rows of blocks that are done with leave their lanes
            at = at[(own[at] > step) & (own[at] < few)]
            planes = bit_planes(fps[at])
        pair = np.zeros(planes.shape[1] * 64, bool)
        pair[: max(0, len(at) - step)] = at[step:] < stop[at[:-step]] if len(at) > step else False
        other = moved(planes, step)
        differ = lambda k, live: (planes[k : k + 8, live] ^ other[k : k + 8, live])[:, :, None]  # noqa: E731, B023
        live, over = within(differ, ~np.packbits(pair, bitorder="little").view(np.uint64)[:, None], 64 * fps.shape[1], radius)
        if len(live):
            lane, bit = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
            i = live[lane] * 64 + bit
            i, j = at[i], at[i + step]
            ok = np.broadcast_to(counts(i, j), len(i))
            out_i.append(i[ok])
            out_j.append(j[ok])
        step += 1
    return np.concatenate(out_i), np.concatenate(out_j)


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members the least member that the pairs join it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the pairs: as many edges as members at most."""
    label = labels_of(n, i, j)
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def node(fps: np.ndarray) -> np.ndarray:
    """A fingerprint's id in the link graph: itself if it is one word, else a 64-bit hash of its words."""
    out = fps[:, 0]
    for k in range(1, fps.shape[1]):
        out = mix(out * np.uint64(5) + fps[:, k])
    return out.view(np.int64)


def whole_blocks(batches, keys: int):
    """Arrow batches of rows sorted by their first `keys` columns to lists of columns as arrays, cut where a block ends."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        differs = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            differs |= c != c[-1]
        differs = np.flatnonzero(differs)
        whole = int(differs[-1]) + 1 if len(differs) else 0  # the last block may go on in the next batch
        if whole:
            yield [c[:whole] for c in cols]
        rest = [c[whole:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def block_starts(keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _compare(radius: int, few: int):
    """Blocks, one after the other, from rows (t, key, i, j, f0 ...) that come sorted by block. Emits a spanning forest of each block's links."""

    def run(batches):
        import pyarrow as pa

        for cols in whole_blocks(batches, 4):
            fps = np.stack(cols[4:], 1).view(np.uint64)
            i, j = forest(len(fps), *pairs_in_blocks(fps, block_starts(cols[:4]), radius, few))
            ids = node(fps)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int, tables: list[np.ndarray], block: int = BLOCK, few: int = FEW) -> DataFrame:
    """Distinct fingerprints (columns f0, f1 ...) to (a, b) node ids: links that join whatever links within the radius join in the buckets.

    Counts by bucket (combined before the shuffle) tell the buckets of over `block` members; such a
    bucket is dealt as pairs of blocks, so that no task gets it whole and each pair of members
    meets in some block pair. The list of large buckets is a table of known size, so fingerprints
    are shuffled once, to where they are compared, unless that list passes the broadcast threshold.
    """
    names = fps.columns
    keyed = fps.mapInArrow(_place(tables, len(names)), "t int, key long, " + ", ".join(f"{x} long" for x in names))
    large = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "large")
    d = keyed.join(large, ["t", "key"], "left").withColumn("_n", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    d = d.withColumn("_c", F.pmod(F.xxhash64(F.lit(7), *names), F.col("_n")).cast("int"))
    others = F.when(F.col("_n") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: x != F.col("_c")))
    d = d.withColumn("_o", F.explode(others)).select("t", "key", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"), *names)
    d = d.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return d.mapInArrow(_compare(radius, few), "a long, b long").distinct()


def near_components(prints: DataFrame, radius: int) -> DataFrame:
    """(doc_id, f0) to the same with component_id: the smallest doc_id that links reach, its own included.

    Equal fingerprints count as linked and are compared once. A null doc_id is the largest; a
    component of nulls alone has a null id.
    """
    me = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id")
    reps = cut(prints.groupBy("f0").agg(F.min(me).alias("low")), "fingerprints")
    roots = components(links(reps.select("f0"), radius, exact_tables(radius)))
    labels = reps.join(roots.withColumnRenamed("node", "f0"), "f0", "left").withColumn("root", F.coalesce("root", "f0"))
    lows = labels.groupBy("root").agg(F.min("low").alias("least"))
    # a row a fingerprint: the join with all documents can be split where one fingerprint has many
    return prints.join(cut(labels.join(lows, "root").select("f0", F.col("least.doc_id").alias("component_id")), "labels"), "f0")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_components(cut(with_fingerprint(docs, "text", 3).select("doc_id", "f0"), "simhash"), 2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
