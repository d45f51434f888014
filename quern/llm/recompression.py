"""Substring dedup of word sequences by recompression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import row_ids, stowed, table
from quern.llm.repeats import Hashes, Kind, merged, mix, removals

#: Words of a window.
LENGTH = 20
#: Words about an anchor that its name covers.
NAME = 8
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_names(text: bytes) -> np.ndarray:
    """A 64-bit name for each word: its bytes' hash, the same in every text."""
    out = []
    for a, b in _stretches(text):
        x = np.frombuffer(text, np.uint8)[a:b]
        edge = np.diff(np.concatenate([[True], _BLANK[x], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        out.append(Hashes(_BYTE[x]).of(start, end) ^ mix((end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _stretches(text: bytes, size: int = 1 << 18):
    """Pieces of a text that end at blanks, so that long texts are hashed piece by piece."""
    a = 0
    while a < len(text):
        b = min(len(text), a + size)
        while b < len(text) and not _BLANK[text[b]]:
            b += 1
        yield a, b
        a = b


def _coin(names: np.ndarray, level: int) -> np.ndarray:
    """Left (False) or right (True) class of each symbol in a level's pair round."""
    return (mix(names + np.uint64(level * int(_ODD) & (1 << 64) - 1)) >> np.uint64(17)) & np.uint64(1) == 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(3) + mix(b + _ODD))


def _anchors(x: np.ndarray, h: Hashes):
    """Anchors are starts of first-level symbols, the least in order of their and the next symbol's names.

    A start depends on one word to each side, so equal windows have equal starts inside; of two
    neighbouring places one is a start at least, so every window has some. Where words repeat,
    coins are equal and nothing pairs: runs stay single symbols here.
    """
    right = _coin(x, 0)
    joined = np.append(~right[:-1] & right[1:], False)
    start = ~np.append(False, joined[:-1])
    name = np.where(joined, _pair(x, np.append(x[1:], np.uint64(0))), x)
    step = np.where(joined, 2, 1)
    after = name[np.minimum(np.arange(len(x)) + step, len(x) - 1)]
    key = np.where(start, _pair(name, after), np.uint64(0xFFFFFFFFFFFFFFFF))
    every = h.every(NAME) if len(x) >= NAME else np.empty(0, np.uint64)
    names = np.zeros(len(x), np.uint64)
    names[1 : len(every) + 1] = every[: len(x) - 1]
    return key, 1, LENGTH - NAME + 1, names


def signatures(seq: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Recompression signature of each window [left, right): equal for equal windows, and else different but for hash collisions.

    Rounds alternate: runs of a symbol get a name (symbol, length), then neighbours of left and
    right class get the name of their pair. Symbols that could be compressed with something
    outside a window are popped from its ends first (end runs; a right-class first symbol, a
    left-class last one), so what remains is compressed the same way wherever the window stands.
    The popped symbols by level are the signature. All windows of a bucket go through each round
    together; a round leaves about three quarters of the symbols.
    """
    l, r = left.copy(), right.copy()
    sig_l, sig_r = np.zeros(len(l), np.uint64), np.full(len(l), _ODD)
    level = 0

    def pop(sig, where, symbol):
        sig[where] = mix(sig[where] * np.uint64(5) + mix(symbol + np.uint64(level + 1)))

    live = np.flatnonzero(l < r)
    while len(live):
        level += 1
        new = np.append(True, seq[1:] != seq[:-1])
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(seq)))
        end = first + length
        # the first run of each window, then the last of what is left
        stop = np.minimum(end[run[l[live]]], r[live])
        pop(sig_l, live, _pair(seq[l[live]], (stop - l[live]).astype(np.uint64)))
        l[live] = stop
        live = live[l[live] < r[live]]
        begin = np.maximum(first[run[r[live] - 1]], l[live])
        pop(sig_r, live, _pair(seq[r[live] - 1], (r[live] - begin).astype(np.uint64)))
        r[live] = begin
        live = live[l[live] < r[live]]
        if not len(live):
            break
        seq = np.where(length > 1, _pair(seq[first], length.astype(np.uint64) + _ODD), seq[first])
        l[live], r[live] = run[l[live]], run[r[live] - 1] + 1
        coin = _coin(seq, level)
        at = live[coin[l[live]]]
        pop(sig_l, at, seq[l[at]])
        l[at] += 1
        live = live[l[live] < r[live]]
        at = live[~coin[r[live] - 1]]
        pop(sig_r, at, seq[r[at] - 1])
        r[at] -= 1
        live = live[l[live] < r[live]]
        joined = np.append(~coin[:-1] & coin[1:], False)
        keep = ~np.append(False, joined[:-1])
        place = np.cumsum(keep) - 1
        seq = np.where(joined, _pair(seq, np.append(seq[1:], np.uint64(0))), seq)[keep]
        l[live], r[live] = place[l[live]], place[r[live] - 1] + 1
    return mix(sig_l) ^ mix(sig_r + np.uint64(1))


def _groups(spans: list[np.ndarray], _anchor: np.ndarray) -> np.ndarray:
    counts = np.array([len(s) - LENGTH + 1 for s in spans])
    begin = np.cumsum([0, *(len(s) for s in spans)])[:-1]
    left = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return np.unique(signatures(np.concatenate(spans), left, left + LENGTH), return_inverse=True)[1]


WORDS = Kind(
    window=LENGTH,
    symbols=word_names,
    mixed=lambda x: x,
    anchors=_anchors,
    groups=_groups,
    first_stays=True,
    dtype=np.uint64,
)


@stowed("text", "ident")
def dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with `n_words`, `cuts` (start, end pairs in words) and `kept` (the words that remain, one blank between, as bytes).

    Words stand between blanks and controls 09-0D and are compared unchanged. A word goes if a
    window of LENGTH words over it also starts earlier: in a text of smaller id (null ids last;
    among equal ids the row read first), or in the same text before. Null texts have no words;
    texts of under LENGTH words keep all; repeated rows lose all their windows but the first
    row's. Columns named like the
    results are replaced, all others go through.
    """
    docs = row_ids(docs.drop("n_words", "cuts", "kept"))
    gone = removals(docs.select(F.col("_row").alias("row"), F.col(ident).cast("long").alias("doc"), F.col(text).alias("text")), WORDS)
    both = docs.join(gone.select(F.col("row").alias("_row"), F.col("cuts").alias("_cuts")), "_row", "left").drop("_row")
    at = both.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n_out, cuts_out, kept_out = [], [], []
            for t, cuts in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                words, spans = (t or b"").split(), merged(cuts)
                edges = [0, *(x for s in spans for x in s), len(words)]
                n_out.append(len(words))
                cuts_out.append([x for s in spans for x in s])
                kept_out.append(b" ".join(w for i, j in zip(edges[::2], edges[1::2], strict=True) for w in words[i:j]))
            new = [pa.array(n_out, pa.int64()), pa.array(cuts_out, pa.list_(pa.int64())), pa.array(kept_out, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], "n_words", "cuts", "kept"])

    schema = both.drop("_cuts").select("*", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<long>").alias("cuts"), F.lit(None).cast("binary").alias("kept")).schema
    return both.mapInArrow(run, schema)


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, x: x - a)  # alternating sum: ends less starts
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
