"""Marked passages of hits. Works on UTF-8 bytes, as token offsets are bytes; runs on result pages only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quern.config import HighlightOptions
from quern.functions.analysis import Analyzer


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    term: str
    phrase: bool = False

    @property
    def weight(self) -> float:
        return 3.0 if self.phrase else 1.0


def locate(analyzer: Analyzer, text: str, terms: list[str], phrases: list[tuple[str, ...]]) -> list[Span]:
    """Spans of wanted terms and of adjacent phrase words, by place; of overlapping ones the longer stays."""
    tokens = analyzer.analyse(text)
    at = {t.position: t for t in tokens}
    wanted = set(terms)
    spans = [Span(t.start, t.end, t.term) for t in tokens if t.term in wanted]
    for phrase in phrases:
        for t in tokens:
            row = [at.get(t.position + k) for k in range(len(phrase))]
            if all(x is not None and x.term == w for x, w in zip(row, phrase, strict=True)):
                spans.append(Span(t.start, row[-1].end, " ".join(phrase), True))
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: s.start):
        if out and s.start < out[-1].end and out[-1].start < s.end:
            if s.end - s.start > out[-1].end - out[-1].start:
                out[-1] = s
        else:
            out.append(s)
    return out


_EDGE = b" \n\t"
_SNAP = 40


def _aligned(raw: bytes, k: int) -> int:
    while 0 < k < len(raw) and raw[k] & 0xC0 == 0x80:
        k -= 1
    return k


def _begin(raw: bytes, k: int) -> int:
    if k <= 0:
        return 0
    return next((i for i in range(k, max(0, k - _SNAP), -1) if raw[i - 1] in _EDGE), _aligned(raw, k))


def _finish(raw: bytes, k: int) -> int:
    if k >= len(raw):
        return len(raw)
    return next((i for i in range(k, min(len(raw), k + _SNAP)) if raw[i] in _EDGE), _aligned(raw, k))


def passages(raw: bytes, spans: list[Span], o: HighlightOptions) -> list[tuple[int, int, list[Span]]]:
    """Windows about the spans, from a third of a fragment before one; the best by distinct terms and weights, in text order."""
    found, k = [], 0
    while k < len(spans) and len(found) < 2 * o.fragments:
        start = _begin(raw, max(0, spans[k].start - o.fragment_size // 3))
        end = _finish(raw, min(len(raw), start + o.fragment_size))
        inside = []
        while k < len(spans) and spans[k].end <= end:
            inside.append(spans[k])
            k += 1
        if not inside:
            inside, end = [spans[k]], min(len(raw), spans[k].end + 1)
            k += 1
        found.append((start, end, inside))
    worth = lambda p: 2.0 * len({s.term for s in p[2]}) + sum(s.weight for s in p[2]) - p[0] / 100000
    return sorted(sorted(found, key=worth, reverse=True)[: o.fragments], key=lambda p: p[0])


def _escape(raw: bytes) -> str:
    text = raw.decode(errors="replace")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = text.replace(a, b)
    return text


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def marked(raw: bytes, start: int, end: int, spans: list[Span], o: HighlightOptions) -> str:
    out, at = [f"{o.ellipsis} " if start > 0 else ""], start
    for s in spans:
        if s.start >= at:
            out += [_escape(raw[at : s.start]), o.pre, _escape(raw[s.start : s.end]), o.post]
            at = s.end
    out.append(_escape(raw[at : max(at, end)]))
    if end < len(raw):
        out.append(f" {o.ellipsis}")
    return _squeeze("".join(out))


def excerpt(raw: bytes, o: HighlightOptions) -> str:
    """The start of a text, cut at its last blank if that is past half."""
    head = raw[: o.fragment_size]
    if len(raw) <= o.fragment_size:
        return _squeeze(_escape(head))
    at = head.rfind(b" ")
    return _squeeze(_escape(head[:at] if at > o.fragment_size / 2 else head)) + f" {o.ellipsis}"


def highlight(analyzer: Analyzer, texts: dict[str, str | None], terms: list[str], phrases: list[tuple[str, ...]], o: HighlightOptions) -> dict[str, list[str]]:
    """Field to marked fragments; a body without a match gives its start."""
    out: dict[str, list[str]] = {}
    for name in o.fields:
        text = texts.get(name) or ""
        raw = text.encode()
        if not text.strip():
            continue
        spans = locate(analyzer, text, terms, phrases) if terms or phrases else []
        if spans and len(raw) <= o.fragment_size:
            out[name] = [marked(raw, 0, len(raw), spans, o)]
        elif spans:
            out[name] = [marked(raw, *p, o) for p in passages(raw, spans, o)]
        elif name == "body":
            out[name] = [excerpt(raw, o)]
    return out


def highlighted(hits, analyzer: Analyzer, terms: list[str], phrases: list[tuple[str, ...]], options: HighlightOptions):
    """hits (doc_id, title, body, ...) with a `highlights` column of JSON, a batch of rows at a time."""
    import json

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    config = analyzer.config

    def run(frames):
        own = Analyzer(config)
        for pdf in frames:
            pdf["highlights"] = [json.dumps(highlight(own, {"title": t, "body": b}, terms, phrases, options), ensure_ascii=False) for t, b in zip(pdf["title"], pdf["body"], strict=True)]
            yield pdf

    return hits.mapInPandas(run, T.StructType([*hits.withColumn("highlights", F.lit("")).schema]))
