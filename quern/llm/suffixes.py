"""Suffix-array dedup of byte strings: anchored suffix buckets, each sorted with difference-cover ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import row_ids, stowed, table
from quern.llm.repeats import Hashes, Kind, merged, mix, removals

#: Bytes of a string that may occur once only.
LENGTH = 200
#: A window's anchor is the least of its ANCHOR-byte strings.
ANCHOR = 41
#: A perfect difference set: any two residues mod PERIOD reach it by one common shift.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SHIFT = np.array([min((d - r) % PERIOD for d in COVER) for r in range(PERIOD)])


def _anchors(x: np.ndarray, h: Hashes):
    names = h.every(ANCHOR) if len(x) >= ANCHOR else np.empty(0, np.uint64)
    return names, 0, LENGTH - ANCHOR + 1, names


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_bucket(spans: list[np.ndarray], anchor: np.ndarray) -> np.ndarray:
    """A number for each window of each span, shared by equal windows of a bucket alone.

    Spans are laid out with their anchors at multiples of PERIOD. Cover samples get ranks by
    doubling, which stays within the sample: 31, 62, 124, 248 bytes. A suffix is then sorted by
    its first 31 bytes and, where those tie, by the rank of the sample one shift ahead, which is
    the shift that suffixes at one residue share; windows of a bucket that are equal stand at one
    distance from their anchor, hence at one residue. Neighbours in that order are equal windows
    if their first LENGTH bytes agree.
    """
    pads = (-anchor) % PERIOD
    starts, total = [], 0
    for s, p in zip(spans, pads.tolist(), strict=True):
        total += -total % PERIOD + p
        starts.append(total)
        total += len(s)
    size = total + 8 * PERIOD + LENGTH + 16
    text = np.zeros(size + 8, np.uint8)
    for s, at in zip(spans, starts, strict=True):
        text[at : at + len(s)] = s
    eight = np.zeros(size, np.uint64)
    for k in range(8):
        eight |= text[k : k + size].astype(np.uint64) << np.uint64(56 - 8 * k)
    sample = np.flatnonzero(np.isin(np.arange(total + 248) % PERIOD, COVER))
    slot = np.zeros(size + 512, np.int64)
    rank = _ranks(eight[sample], eight[sample + 8], eight[sample + 16], eight[sample + 23])
    for depth in (31, 62, 124):
        slot[sample] = rank + 1
        rank = _ranks(rank, slot[sample + depth])
    slot[sample] = rank + 1
    counts = np.array([len(s) - LENGTH + 1 for s in spans])
    at = np.repeat(np.array(starts) - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    residue = at % PERIOD
    order = np.lexsort((slot[at + _SHIFT[residue]], eight[at + 23], eight[at + 16], eight[at + 8], eight[at], residue))
    a = at[order]
    new = np.append(True, residue[order[1:]] != residue[order[:-1]]) if len(order) else np.empty(0, bool)
    for k in range(0, LENGTH - 7, 8):
        new[1:] |= eight[a[1:] + k] != eight[a[:-1] + k]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


BYTES = Kind(
    window=LENGTH,
    symbols=lambda t: np.frombuffer(t, np.uint8),
    mixed=lambda x: _TABLE[x],
    anchors=_anchors,
    groups=sort_bucket,
    first_stays=False,
    dtype=np.uint8,
)


@stowed("text", "ident")
def dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with `cuts` (start, end pairs in UTF-8 bytes) and `kept` (the bytes that remain).

    A byte goes if a LENGTH-byte string over it also starts at any other place, in the same or
    another text, overlaps included; all copies go. Null texts are empty; texts shorter than
    LENGTH keep all; of repeated rows every long enough byte goes, as the other row has it too.
    Columns named like the results
    are replaced, all others go through.
    """
    docs = row_ids(docs.drop("cuts", "kept"))
    gone = removals(docs.select(F.col("_row").alias("row"), F.col(ident).cast("long").alias("doc"), F.col(text).alias("text")), BYTES)
    both = docs.join(gone.select(F.col("row").alias("_row"), F.col("cuts").alias("_cuts")), "_row", "left").drop("_row")
    at = both.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cuts_out, kept_out = [], []
            for t, cuts in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                t, spans = t or b"", merged(cuts)
                edges = [0, *(x for s in spans for x in s), len(t)]
                cuts_out.append([x for s in spans for x in s])
                kept_out.append(b"".join(t[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cuts_out, pa.list_(pa.int64())), pa.array(kept_out, pa.binary())], [*b.schema.names[:-1], "cuts", "kept"])

    return both.mapInArrow(run, both.drop("_cuts").select("*", F.lit(None).cast("array<long>").alias("cuts"), F.lit(None).cast("binary").alias("kept")).schema)


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, x: x - a)  # alternating sum: ends less starts
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        (F.size("cuts") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
