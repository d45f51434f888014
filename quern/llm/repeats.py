"""Windows that occur more than once: what suffix-array and recompression dedup share.

A window is a fixed number of consecutive symbols (bytes, words) of one text. Each window picks an
anchor inside itself by its content alone, so equal windows pick the same anchor at the same place.
Consecutive windows with one anchor form a run, and runs are all that moves between machines:

1. Each text gives its runs: anchor hash A, hash S of the run's whole span, place and length.
2. Counts by A (combined before the shuffle) drop runs whose anchor is unique: their windows are.
3. Runs with equal A and S are equal window by window. Where an anchor has one S only, that decides.
4. Where it has several, one run of each S sends its span's symbols to the anchor's bucket, and
   the bucket finds which windows are equal. Where there are over SPANS spans, each window goes on
   its own, by anchor, place about it and hash, to sums that are combined before they are shuffled.
5. Removal intervals go back to their texts.

No step has a group of unbounded size in one task: 2 and 3 are aggregates and joins on the key,
4 holds at most SPANS spans of a bucket at once. Work and moved data follow the number of
runs, about one for 80 bytes or 7 words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, drop, release
from quern.llm.words import slices

#: Symbols that are hashed at once, and distinct spans of a bucket above which its windows go one by one.
CHUNK, SPANS = 1 << 18, 2_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashes:
    """Hashes of any stretch of a sequence of well-mixed 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        return mix((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has so many."""
    n, m = len(x), 1
    while 2 * m <= width:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    return np.minimum(x[: n - width + 1], x[width - m : n - m + 1])


@dataclass
class Kind:
    """How texts become symbols, which anchors windows pick, and how a bucket compares windows."""

    window: int
    symbols: Callable[[bytes], np.ndarray]  # of one text: what spans carry
    mixed: Callable[[np.ndarray], np.ndarray]  # symbols to well-mixed 64 bits
    #: (mixed symbols, hashes) to anchor order keys (low 24 bits free, for the place), the first place relative to a window's start, how many places, and anchor names
    anchors: Callable[[np.ndarray, Hashes], tuple[np.ndarray, int, int, np.ndarray]]
    #: (spans, places of anchors in them) to a group number for each window of each span, equal windows alone sharing one
    groups: Callable[[list[np.ndarray], np.ndarray], np.ndarray]
    first_stays: bool  # else all members of a group go
    dtype: type


def _runs_of(kind: Kind, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, place, windows, anchor place, A, S) of the runs. Texts of over CHUNK windows are cut; runs end at the cuts."""
    held, sizes, held_n = [], [], 0
    win = kind.window

    def flush():
        x = kind.mixed(np.concatenate([t for _, _, t in held]))
        h = Hashes(x)
        key, offset, width, names = kind.anchors(x, h)
        n = len(x) - win + 1
        if n <= 0:
            return
        ends = np.repeat(np.cumsum(sizes), sizes)
        valid = np.flatnonzero(np.arange(win, len(x) + 1) <= ends[:n])
        if not len(valid):
            return
        key = (key & ~np.uint64((1 << 24) - 1)) | np.arange(len(key), dtype=np.uint64)
        least = sliding_min(key[offset:], width)
        at = (least[valid] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.append(True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1))
        i0 = valid[new]
        count = np.diff(np.append(np.flatnonzero(new), len(valid)))
        m = at[new]
        span = h.of(i0, i0 + count - 1 + win)
        s = mix(span ^ mix(((m - i0) * 4096 + count).astype(np.uint64)))
        piece = np.searchsorted(np.cumsum(sizes), i0, side="right")
        begin = np.cumsum(sizes) - sizes
        number = np.array([k for k, _, _ in held])[piece]
        place = np.array([a for _, a, _ in held])[piece] + i0 - begin[piece]
        yield number, place, count, m - i0, names[m], s

    for k, t in enumerate(texts):
        for a in range(0, max(1, len(t) - win + 1), CHUNK):
            piece = t[a : a + CHUNK + win - 1]
            if len(piece) < win:
                continue
            if held and held_n + len(piece) > CHUNK:
                yield from flush()
                held, sizes, held_n = [], [], 0
            held.append((k, a, piece))
            sizes.append(len(piece))
            held_n += len(piece)
    if held:
        yield from flush()


def _emit_runs(kind: Kind):
    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            texts = [kind.symbols(t or b"") for t in b.column(2).to_pylist()]
            row, doc = b.column(0), b.column(1)
            for number, place, count, lo, a, s in _runs_of(kind, texts):
                take = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [row.take(take), doc.take(take), pa.array(place.astype(np.int64)), pa.array(count.astype(np.int16)), pa.array(lo.astype(np.int16)), pa.array(a.view(np.int64)), pa.array(s.view(np.int64))],
                    ["row", "doc", "pos", "n", "lo", "a", "s"],
                )

    return run


def _fetch(kind: Kind):
    """Texts (row, doc, text, wanted) to the spans that are wanted of them."""

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary())

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], ["a", "row", "doc", "pos", "lo", "span"])

        out, size = [[] for _ in kinds], 0
        for b in slices(batches):
            for row, doc, text, wanted in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x = kind.symbols(text or b"")
                for w in wanted:
                    raw = x[w["pos"] : w["pos"] + w["n"] + kind.window - 1].tobytes()
                    for o, v in zip(out, (w["a"], row, doc, w["pos"], w["lo"], raw), strict=True):
                        o.append(v)
                    size += len(raw)
                if size > 1 << 22:
                    yield batch(out)
                    out, size = [[] for _ in kinds], 0
        yield batch(out)

    return run


def _each_window(kind: Kind):
    """Texts (row, doc, text, wanted) to a row for each window of the wanted spans: (a, place about the anchor, hash, row, doc, pos)."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 64):
            for k, (text, wanted) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                h = Hashes(kind.mixed(kind.symbols(text or b"")))
                pos, n, lo, a = (np.array([w[c] for w in wanted], np.int64) for c in ("pos", "n", "lo", "a"))
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(pos, n) + step
                take = pa.array(np.full(len(at), k))
                cols = [pa.array(np.repeat(a, n)), pa.array((np.repeat(lo, n) - step).astype(np.int16)), pa.array(h.of(at, at + kind.window).view(np.int64)), b.column(0).take(take), b.column(1).take(take), pa.array(at)]
                yield pa.RecordBatch.from_arrays(cols, ["a", "lo", "h", "row", "doc", "pos"])

    return run


#: Columns of a span that is wanted whole (h is null), and of a window of a hot anchor's span (span is null).
FETCHED = "a long, lo short, h long, row long, doc long, pos long, span binary"


def _fetch_all(kind: Kind):
    """Texts (row, doc, text, wanted, hot) to the spans of wanted anchors, those of hot anchors window by window: one pass over the texts for both."""
    whole, each = _fetch(kind), _each_window(kind)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [c.split()[0] for c in FETCHED.split(", ")]

        def filled(out, name, like):
            got = pa.nulls(out.num_rows, like)
            return pa.RecordBatch.from_arrays([out.column(c) if c != name else got for c in names], names)

        for b in batches:
            hot = b.column(4)
            for out in whole([b.filter(pc.invert(hot)).select([0, 1, 2, 3])]):
                yield filled(out, "h", pa.int64())
            for out in each([b.filter(hot).select([0, 1, 2, 3])]):
                yield filled(out, "span", pa.binary())

    return run


def _buckets(kind: Kind):
    """Spans sorted by anchor to removal intervals. Whole buckets are gathered up to CHUNK windows and compared together."""
    win = kind.window

    def compare(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        spans = [np.frombuffer(r[4], kind.dtype) for r in rows]
        counts = np.array([len(s) - win + 1 for s in spans])
        group = kind.groups(spans, np.array([r[3] for r in rows]))
        owner = np.repeat(np.arange(len(rows)), counts)
        t = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        bucket = np.array([r[5] for r in rows])[owner]
        key = group * (int(bucket.max()) + 1 if len(bucket) else 1) + bucket
        row, pos = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        if kind.first_stays:
            null = np.array([r[1] is None for r in rows])
            doc = np.array([0 if r[1] is None else r[1] for r in rows], np.int64)
            order = np.lexsort((pos[owner] + t, row[owner], doc[owner], null[owner], key))
            gone = np.zeros(len(order), bool)
            gone[order[1:]] = key[order[1:]] == key[order[:-1]]
        else:
            _, inv, n = np.unique(key, return_inverse=True, return_counts=True)
            gone = n[inv] > 1
        owner, t = owner[gone], t[gone]
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (t[1:] != t[:-1] + 1))) if len(owner) else np.empty(0, np.int64)
        last = np.append(new[1:], len(owner)) - 1 if len(owner) else new
        return row[owner[new]], pos[owner[new]] + t[new], pos[owner[new]] + t[last] + win

    def run(batches):
        import pyarrow as pa

        def emit(rows):
            row, start, end = compare(rows)
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["row", "start", "end"])

        held, size, bucket, key = [], 0, -1, None
        for b in batches:
            for a, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if a != key:
                    key, bucket = a, bucket + 1
                    if size > CHUNK:
                        yield emit(held)
                        held, size, bucket = [], 0, 0
                held.append((*rest, bucket))
                size += len(rest[-1]) // np.dtype(kind.dtype).itemsize
        if held:
            yield emit(held)

    return run


def removals(docs: DataFrame, kind: Kind) -> DataFrame:
    """(row, doc, text) to (row, cuts): for each text that loses something, its intervals (start, end) in symbols, not merged.

    `row` tells rows apart and must be the same whenever docs is read again. Windows are judged on
    the input. With kind.first_stays, of equal windows the one with the smallest doc (null last),
    then row, then place stays; else all go.
    """
    runs = cut(docs.select("row", "doc", F.col("text").cast("binary")).mapInArrow(_emit_runs(kind), "row long, doc long, pos long, n short, lo short, a long, s long"), "runs")
    # a table of its own, so that the join has plain exchanges on both sides, and a hot anchor's partition can be split
    often = cut(runs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a"), "often")
    rep = cut(runs.join(often, "a"), "repeated")
    drop(runs, often)
    release(docs.sparkSession)
    me = F.struct(F.col("doc").isNull().alias("z"), "doc", "row", "pos")
    by_s = cut(rep.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c"), F.min(me).alias("first"), F.first("n").alias("n"), F.first("lo").alias("lo")), "spans")
    full = rep.join(by_s.where("c > 1").select("a", "s", "first"), ["a", "s"])
    if kind.first_stays:
        full = full.where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    # each part is a table of its own: a hot key's partition of a plain join can be split, and its shuffle files go before the next
    parts = [cut(full.select("row", F.col("pos").alias("start"), (F.col("pos") + F.col("n") - 1 + kind.window).alias("end")), "copies")]
    drop(rep)
    release(docs.sparkSession)
    several = cut(by_s.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "several")
    wanted = by_s.join(several, "a").select(F.col("first.row").alias("row"), (F.col("k") > SPANS).alias("hot"), F.struct(F.col("first.pos").alias("pos"), "n", "lo", "a").alias("w"))
    wanted = cut(wanted.groupBy("row", "hot").agg(F.collect_list("w").alias("w")), "wanted")  # a text's own anchors
    # the texts move once for both: shuffled texts are the most that is on disk here
    asked = docs.join(wanted, "row").select("row", "doc", F.col("text").cast("binary"), "w", "hot")
    fetched = cut(asked.mapInArrow(_fetch_all(kind), FETCHED), "fetched")
    release(docs.sparkSession)
    spans = fetched.where("span is not null").select("a", "row", "doc", "pos", "lo", "span")
    parts.append(cut(spans.repartition("a").sortWithinPartitions("a").mapInArrow(_buckets(kind), "row long, start long, end long"), "sorted"))
    release(docs.sparkSession)
    if not wanted.where("hot").isEmpty():
        windows = fetched.where("span is null").select("a", "lo", "h", "row", "doc", "pos")
        twice = cut(windows.groupBy("a", "lo", "h").agg(F.count(F.lit(1)).alias("c"), F.min(me).alias("first")).where("c > 1").select("a", "lo", "h", "first"), "twice")
        again = windows.join(twice, ["a", "lo", "h"])
        if kind.first_stays:
            again = again.where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
        parts.append(cut(again.select("row", F.col("pos").alias("start"), (F.col("pos") + kind.window).alias("end")), "again"))
        drop(twice)
        release(docs.sparkSession)
    every = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    out = cut(every, "cuts")
    drop(by_s, several, wanted, fetched, *parts)
    release(docs.sparkSession)
    return out


def merged(cuts: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted((c["start"], c["end"]) for c in cuts or ()):
        if out and c[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], c[1])
        else:
            out.append(list(c))
    return [tuple(x) for x in out]
