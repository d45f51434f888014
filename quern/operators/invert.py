"""Documents to chunks of postings, one pass over Arrow batches and no shuffle.

Python finds the tokens in a batch's UTF-8 bytes, with the letters and digits of the JVM's regular expressions. Each
distinct token is normalised and stemmed once, by the analyzer that queries use. Batches of a task are gathered into
segments; a sort of a segment's tokens by term then puts postings in place. All fields of a document are in one row,
so no other row adds to its postings, lengths or document frequencies.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import AnalyzerConfig, Settings
from quern.functions import analysis, porter
from quern.storage import small_batches

#: A row a segment, term and field, `first` its first document; documents are counted with a term's first field alone.
#: Arrays have an entry a document: `starts` says where its positions begin in `places`. Rows without a term hold
#: a field's lengths instead. Those come first in a segment, then the others by term and field.
CHUNKS = "term string, field_id int, first long, documents long, occurrences long, ids array<long>, tfs array<int>, lengths array<int>, starts array<int>, places array<int>"
_INTS = pa.list_(pa.int32())
_ARROW = pa.schema([("term", pa.string()), ("field_id", pa.int32()), ("first", pa.int64()), ("documents", pa.int64()), ("occurrences", pa.int64()), ("ids", pa.list_(pa.int64())), ("tfs", _INTS), ("lengths", _INTS), ("starts", _INTS), ("places", _INTS)])
#: Tokens of a segment after which the next begins, and postings of a batch that is put out.
SEGMENT, PUT = 3 << 20, 1 << 18
#: Words whose stems (or tokens whose terms) a worker keeps: as many of late, and those of them that came among as many before.
KEPT = 1 << 18
_TERMS: dict[AnalyzerConfig | str, tuple[dict[str, str | None], dict[str, str | None]]] = {}
LETTER, DIGIT = 1, 2


def chunks(docs: DataFrame, settings: Settings) -> DataFrame:
    """CHUNKS of (doc_id, fields) rows; a doc_id that stands in two rows is taken for two documents."""
    small_batches(docs.sparkSession)
    columns = []
    for f in settings.fields:
        text = F.array_join(F.col(f.name), " ") if dict(docs.dtypes)[f.name].startswith("array") else F.col(f.name)
        columns.append(F.when(text.rlike("[^ \\t\\n\\r\\x00\\x0B]"), text).alias(f"_{f.number}"))
    run = inverter([f.number for f in settings.fields], settings.analyzer, settings.store_positions, kinds(docs.sparkSession))
    return docs.select(F.col("doc_id").cast("long"), *columns).mapInArrow(run, CHUNKS)


def inverter(fields: list[int], config: AnalyzerConfig, positions: bool, packed: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(fields, config, positions, packed)
        for batch in batches:
            if batch.num_rows:
                segment.add(batch)
                if segment.size >= SEGMENT:
                    yield from segment.put()
                    segment = Segment(fields, config, positions, packed)
        yield from segment.put()

    return run


class Segment:
    def __init__(self, fields: list[int], config: AnalyzerConfig, positions: bool, packed: bytes):
        self.fields, self.positions, self.kinds = fields, positions, _unpacked(packed)
        self.analyzer = analysis.Analyzer(config)
        self.size = self.rows = 0
        self.ids: list[np.ndarray] = []
        self.valid: list[list[np.ndarray]] = [[] for _ in fields]
        self.words: list[pa.Array] = []
        self.spots: list[tuple[np.ndarray, ...]] = []  # (field's place in fields, row, place) of words, each field's in their order

    def add(self, batch: pa.RecordBatch) -> None:
        self.ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        for k in range(len(self.fields)):
            texts = batch.column(k + 1)
            self.valid[k].append(self.rows + np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)))
            words, owner = tokens(texts, self.kinds)
            if len(words):
                counts = np.bincount(owner, minlength=batch.num_rows)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                self.words.append(words)
                self.spots.append((np.full(len(owner), k, np.int8), (self.rows + owner).astype(np.int32), place.astype(np.int32)))
                self.size += len(words)
        self.rows += batch.num_rows

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """The place of each word's term among all terms, -1 where it is dropped; a distinct word is looked at once."""
        words = pa.concat_arrays(self.words).dictionary_encode()
        self.words.clear()
        found = terms_of(words.dictionary, self.analyzer).dictionary_encode()
        code = pc.fill_null(found.indices, -1).to_numpy()
        return code[words.indices.to_numpy()], found.dictionary

    def put(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        n, many, ids = self.rows, len(self.fields), np.concatenate(self.ids)
        field, row, place = (np.concatenate(x) for x in zip(*self.spots, strict=True)) if self.words else (np.zeros(0, np.int32) for _ in range(3))
        code, terms = self.codes() if self.words else (field, pa.array([], pa.string()))
        kept = code >= 0
        code, field, row, place = code[kept], field[kept], row[kept], place[kept]
        lengths = np.bincount(field * np.int64(n) + row, minlength=many * n)
        # ---- lengths of fields with text
        for k, f in enumerate(self.fields):
            at = np.concatenate(self.valid[k])
            if len(at):
                yield _rows(pa.nulls(1, pa.string()), [f], ids[at[:1]], [0], [0], [0, len(at)], ids[at], np.zeros(len(at), np.int64), lengths[k * n + at], None)
        if not len(code):
            return
        # ---- by term, then field, document and place, as tokens of a field come in that order
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = np.sort((rank[code] * many + field) << 32 | np.arange(len(code)))
        at, key = key & 0xFFFFFFFF, key >> 32
        row, place = row[at], place[at]
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
        tf = np.diff(np.r_[start, len(key)])
        key, row = key[start], row[start]
        chunk = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        term, field = key[chunk] // many, key[chunk] % many
        new = np.r_[True, term[1:] != term[:-1]]
        pairs = np.sort(key // many * n + row)
        documents = np.where(new, np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]]] // n, minlength=len(terms))[term], 0)
        occurrences, ends = np.add.reduceat(tf, chunk), np.r_[chunk, len(key)]
        length, spots = lengths[key % many * n + row], np.r_[0, np.cumsum(tf)]
        terms, fields = terms.take(pa.array(order[term])), np.array(self.fields)[field]
        a = 0
        while a < len(chunk):  # so many chunks at once, one at least
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + PUT, "right")) - 1)
            p, q = ends[a], ends[b]
            yield _rows(terms[a:b], fields[a:b], ids[row[chunk[a:b]]], documents[a:b], occurrences[a:b], ends[a : b + 1] - p, ids[row[p:q]], tf[p:q], length[p:q], place[spots[p] : spots[q]] if self.positions else None)
            a = b


def _rows(terms: pa.Array, fields, first, documents, occurrences, offsets, ids, tf, lengths, place) -> pa.RecordBatch:
    offsets, ends = np.asarray(offsets), np.r_[0, np.cumsum(tf)]
    at = ends[offsets]  # where each chunk's places begin
    long = lambda x: pa.array(np.asarray(x, np.int64))
    int_ = lambda x: pa.array(np.asarray(x, np.int32))
    lists = lambda values, of=offsets: pa.ListArray.from_arrays(int_(of), values)
    places = pa.nulls(len(terms), _INTS) if place is None else lists(int_(place), at)
    starts = ends[:-1] - np.repeat(at[:-1], np.diff(offsets))
    return pa.RecordBatch.from_arrays([terms, int_(fields), long(first), long(documents), long(occurrences), lists(long(ids)), lists(int_(tf)), lists(int_(lengths)), lists(int_(starts)), places], schema=_ARROW)


# ---- terms


def terms_of(words: pa.Array, analyzer: analysis.Analyzer) -> pa.Array:
    """analyzer.term() of distinct tokens, null where one is dropped: all at once, but tokens with apostrophes.

    Words that end as none of the stemmer's suffixes does are their own stems.
    """
    config, none = analyzer.config, pa.nulls(len(words), pa.string())
    ascii_, marked = pc.string_is_ascii(words), pc.match_substring_regex(words, "['\u2019]")
    out = pc.ascii_lower(words)
    other = pc.and_not(pc.invert(ascii_), marked)
    if pc.any(other).as_py():  # no token holds a newline, and a letter's case never depends on what is beyond one
        out = pc.replace_with_mask(out, other, pa.array(analyzer.normalise_all("\n".join(words.filter(other).to_pylist())).split("\n"), pa.string()))
    size = pc.utf8_length(out)
    kept = pc.and_(pc.greater_equal(size, config.min_length), pc.less_equal(size, config.max_length))
    if stops := analysis.stop_words(config.stop_words):
        kept = pc.and_not(kept, pc.is_in(out, pa.array(sorted(stops))))
    if config.stemmer == "porter":
        able = pc.and_(pc.and_not(kept, marked), pc.and_(pc.greater_equal(size, 3), pc.match_substring_regex(out, porter.STEMMED)))
        out = pc.replace_with_mask(out, able, _each(out.filter(able), porter.stem.__wrapped__, "stems"))
    out = pc.if_else(kept, out, none)
    return pc.replace_with_mask(out, marked, _each(words.filter(marked), analyzer.term, config))


def _each(words: pa.Array, run: Callable[[str], str | None], name: AnalyzerConfig | str) -> pa.Array:
    """run() of each word; a worker keeps what it gave under a name."""
    late, before = _TERMS.get(name, ({}, {}))
    if len(late) > KEPT:
        late, before = {}, late
    _TERMS[name] = late, before
    out = []
    for w in words.to_pylist():
        term = late.get(w, "")
        if term == "":
            term = before.get(w, "")
            term = late[w] = run(w) if term == "" else term
        out.append(term)
    return pa.array(out, pa.string())


# ---- tokens


@cache
def _kinds(app: str) -> bytes:
    points = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    kept = lambda p: np.frombuffer(SparkSession.active()._jvm.java.util.regex.Pattern.compile(f"[^{p}]").matcher(points).replaceAll(" ").encode("utf-32-le"), np.uint32) != 32
    return zlib.compress(np.where(kept("\\p{N}"), DIGIT, np.where(kept("\\p{L}"), LETTER, 0)).astype(np.uint8).tobytes())


def kinds(spark: SparkSession) -> bytes:
    """What each code point is in the JVM's regular expressions, LETTER, DIGIT or 0, packed for the workers."""
    return _kinds(spark.sparkContext.applicationId)


@cache
def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def tokens(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts as analysis.TOKEN finds them, in order, and the row of each."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    got = _spans(texts, kinds)
    if got is None:  # bytes that are no UTF-8 part tokens
        texts = pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
        got = _spans(texts, kinds)
    begin, end, owner = got
    if not len(begin):
        return pa.array([], pa.string()), owner
    edges = np.empty(2 * len(begin), np.int32)
    edges[::2], edges[1::2] = begin, end
    pieces = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), texts.buffers()[2])  # tokens, and what is between them
    return pieces.take(pa.array(np.arange(0, len(edges), 2))), owner


def _spans(texts: pa.Array, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(begin, end, row) of tokens, bytes of the array's buffer; None if it isn't UTF-8.

    Runs of letters and digits, joined where the expression goes on: a number by a point or comma to the digits that
    a run begins with, a word by an apostrophe to a whole run.
    """
    none = np.zeros(0, np.int64)
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    low = edges[0]
    if edges[-1] == low:
        return none, none, none
    data, edges = np.frombuffer(texts.buffers()[2], np.uint8)[low : edges[-1]], edges - low
    kind = np.r_[kinds[:128], np.zeros(128, np.uint8)][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.int32)
        b, more = padded[lead], [padded[lead + k] for k in (1, 2, 3)]
        three, four = b >= 0xE0, b >= 0xF0
        inner = [(m & 0xC0) == 0x80 for m in more]
        c1, c2, c3 = (m & 0x3F for m in more)
        point = np.where(four, (b & 7) << 18 | c1 << 12 | c2 << 6 | c3, np.where(three, (b & 15) << 12 | c1 << 6 | c2, (b & 31) << 6 | c1))
        least = np.where(four, 0x10000, np.where(three, 0x800, 0x80))
        if not (inner[0] & (inner[1] | ~three) & (inner[2] | ~four) & (point >= least) & (point <= 0x10FFFF) & (b < 0xF8)).all():
            return None
        of = kinds[point]
        kind[lead] = kind[lead + 1] = of
        kind[lead[three] + 2], kind[lead[four] + 3] = of[three], of[four]
    part = np.zeros(len(data) + 1, bool)  # where a text begins
    part[edges] = True
    able = kind > 0
    begin = np.flatnonzero(able & (np.r_[True, ~able[:-1]] | part[:-1]))
    end = np.flatnonzero(able & (np.r_[~able[1:], True] | part[1:])) + 1
    if not len(begin):
        return none, none, none
    owner = np.searchsorted(edges, begin, "right") - 1
    # ---- the digits that a run begins with
    turns = np.r_[np.flatnonzero((kind[:-1] == DIGIT) & (kind[1:] == LETTER)) + 1, len(data)]
    number = kind[begin] == DIGIT
    digits = begin.copy()
    digits[number] = np.minimum(turns[np.searchsorted(turns, begin[number], "right")], end[number]) if len(turns) else end[number]
    whole = number & (digits == end)
    # ---- what stands between a run and the one before
    gap = np.r_[0, begin[1:] - end[:-1]] * np.r_[False, owner[1:] == owner[:-1]]
    before = np.r_[0, end[:-1]]
    one = data[np.minimum(before, len(data) - 1)]
    apostrophe = (gap == 1) & (one == 0x27)
    wide = np.flatnonzero((gap == 3) & (one == 0xE2))
    apostrophe[wide] = (data[before[wide] + 1] == 0x80) & (data[before[wide] + 2] == 0x99)
    # ---- a run ends in a number only if it is all digits, unless a word goes on with it
    sure = ~(whole & apostrophe)
    word = ~whole[np.maximum.accumulate(np.where(sure, np.arange(len(begin)), 0))]
    last = np.r_[False, word[:-1]]
    joined = apostrophe & last
    parted = number & ~whole & ~joined
    on = joined | ((gap == 1) & ((one == 0x2E) | (one == 0x2C)) & ~last & number)
    starts = np.sort(np.r_[begin[~on], digits[parted]])
    ends = np.sort(np.r_[end[np.r_[~on[1:], True]], digits[parted]])
    return starts + low, ends + low, np.searchsorted(edges, starts, "right") - 1
