"""License scans: phrases, and an exact set-similarity join of text windows with license templates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import stowed, table

#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Template sentences and their labels. A window matches that has at least this share of a template's distinct words, so of four words or fewer all.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved"),
)
THRESHOLD = 0.8
_OTHER = r"\x00-\x09\x0B-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F"  # neither word nor blank nor newline


def spaced(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text, one blank between; lines stay apart by newlines.

    lower() changes other letters to letters of the same kind, so words and their places stay;
    the one sign beyond ASCII whose lower case is in A-Z (the Kelvin sign) is put out of its reach.
    Single blanks, the common case, are left alone by the pattern.
    """
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5")))
    return F.regexp_replace(low, rf" *[{_OTHER}][ {_OTHER}]*|  +", " ")


def count_words(words: Column) -> Column:
    """Words of a string of words with blanks and newlines between, at its ends too perhaps."""
    t = F.trim(words)
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word and base_labels (an array) of the phrases' places.

    No phrase starts with the end of another, so places never overlap, and one regular expression
    finds them all; gaps between matches give the positions in words.
    """
    assert not any(a.split()[-k:] == b.split()[:k] for a in PHRASES for b in PHRASES for k in range(1, min(len(a.split()), len(b.split())) + 1) if (a, k) != (b, len(b.split())))
    flat = F.regexp_replace("_spaced", " *\n[ \n]*", " ")
    pattern = "(?<![^ ])(?:" + "|".join(PHRASES) + ")(?![^ ])"
    docs = docs.withColumn("_flat", flat).withColumn("n_words", count_words(F.col("_flat")))
    any_of = reduce(lambda a, b: a | b, [F.col("_flat").contains(p) for p in PHRASES])
    docs = docs.withColumn("_found", F.when(any_of, F.regexp_extract_all("_flat", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("_flat", pattern, -1)))
    last = F.element_at("_found", -1)
    return docs.select(
        "*",
        F.size("_found").cast("long").alias("n_base"),
        F.when(F.size("_found") > 0, count_words(F.element_at("_gaps", 1))).alias("first_word"),
        F.when(F.size("_found") > 0, F.col("n_words") - count_words(F.element_at("_gaps", -1)) - count_words(last)).alias("last_word"),
        F.transform(F.array_distinct("_found"), lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv]), p)).alias("base_labels"),
    ).drop("_flat", "_found", "_gaps")


def token_counts(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many of all texts each template word occurs: as many numbers as the templates have words."""
    flat = F.split(F.regexp_replace("_spaced", "\n", " "), " ")
    words = F.explode(F.array_intersect(flat, F.array(*[F.lit(w) for w in vocabulary])))
    got = texts.select(words.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["w"]: r["n"] for r in got}


def prefixes(templates: list[tuple[str, list[str]]], often: dict[str, int], threshold: float) -> list[tuple[str, list[str], int, int]]:
    """(label, distinct words rarest first, how many of them a window needs, words of a window), for templates that some text can match.

    A window has as many words as the template, widened by the share that may be missing, so
    that words put in between are borne like words left out.
    """
    out = []
    for label, words in templates:
        order = sorted(set(words), key=lambda w: (often.get(w, 0), w))
        need = max(1, math.ceil(threshold * len(order) - 1e-9))
        if sum(often.get(w, 0) > 0 for w in order) >= need:  # words that no text has cannot be shared
            out.append((label, order, need, math.ceil(len(words) / threshold - 1e-9)))
    return out


def _let(value: Column, fn) -> Column:
    """fn of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _best(hits: Column, t: Column) -> Column:
    """The most distinct words of a template in one of its windows, 0 if under its need.

    A best window starts with a template word, so those are the starts; `need` template words must
    stand in it (length), that is, the need-th from the start on must stand before its end (position).
    """
    at = lambda h, j: F.element_at(h, j)["at"]
    inside = lambda h, j: F.filter(F.slice(h, j, t["span"]), lambda x: x["at"] < at(h, j) + t["span"])
    starts = lambda h: F.filter(F.sequence(F.lit(1), F.size(h) - t["need"] + 1), lambda j: at(h, j + t["need"] - 1) < at(h, j) + t["span"])
    shared = lambda h: F.array_max(F.transform(starts(h), lambda j: F.size(F.array_distinct(F.transform(inside(h, j), lambda x: x["word"])))))
    own = F.filter(hits, lambda x: F.array_contains(t["words"], x["word"]))
    return _let(own, lambda h: F.when(F.size(h) >= t["need"], F.coalesce(shared(h), F.lit(0))).otherwise(F.lit(0)))


def matches(docs: DataFrame, templates: list[tuple[str, list[str], int, int]], often: dict[str, int]) -> DataFrame:
    """docs (with _spaced) with _m, an array of (label, share) for each template that some window of the text holds to its threshold; exact.

    Template words stand in one global order, rarest first. Where `need` of n words must be in a
    window, one of the first n - need + 1 must be (the prefix), and the whole text must have
    `need` of them; only texts that pass are gone through by position. The templates are one
    array beside the text, so the plan does not grow with them.
    """
    array = lambda ws: F.array(*[F.lit(w) for w in ws])
    all_of = F.array(*[F.struct(F.lit(label).alias("label"), array(o).alias("words"), array(o[: len(o) - need + 1]).alias("prefix"), F.lit(need).alias("need"), F.lit(span).alias("span")) for label, o, need, span in templates])
    rare = sorted({w for _, o, need, _ in templates for w in o[: len(o) - need + 1] if often.get(w)})
    vocabulary = array(sorted({w for _, o, _, _ in templates for w in o}))
    words = F.split(F.regexp_replace("_spaced", " *\n[ \n]*", " "), " ")
    docs = docs.withColumn("_own", F.when(reduce(lambda a, b: a | b, [F.col("_spaced").contains(w) for w in rare]), F.array_intersect(words, vocabulary)))
    docs = docs.withColumn("_able", F.when(F.size("_own") > 0, F.filter(all_of, lambda t: F.arrays_overlap(t["prefix"], "_own") & (F.size(F.array_intersect(t["words"], "_own")) >= t["need"]))))
    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    docs = docs.withColumn("_hits", F.when(F.size("_able") > 0, F.filter(placed, lambda x: F.array_contains("_own", x["word"]))))
    found = F.transform("_able", lambda t: _let(_best(F.col("_hits"), t), lambda n: F.struct(t["label"].alias("label"), F.when(n >= t["need"], n / F.size(t["words"]).cast("double")).alias("share"))))
    found = F.filter(found, lambda x: x["share"].isNotNull())
    none = F.array().cast("array<struct<label:string,share:double>>")
    return docs.withColumn("_m", F.when(F.size("_able") > 0, found).otherwise(none)).drop("_own", "_able", "_hits")


@stowed("text")
def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted) and score.

    Blocks are all windows of a template's size in words, wherever lines end. The score is the
    largest containment of a template in a window that meets the threshold (1 with a base phrase;
    0 with nothing). Null texts are empty: no words, no labels. Repeated rows are rows of their own, and columns named like the results are replaced.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    docs = docs.drop(*names).withColumn("_spaced", spaced(F.coalesce(F.col(text), F.lit(""))))
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    often = token_counts(docs, vocabulary)
    able = prefixes([(a, t.split()) for a, t in templates], often, threshold)
    docs = with_base(docs, text)
    docs = matches(docs, able, often) if able else docs.withColumn("_m", F.array().cast("array<struct<label:string,share:double>>"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("_m.label"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("_m.share"), F.lit(0.0)))
    return docs.withColumn("labels", labels).withColumn("base_labels", F.array_sort("base_labels")).withColumn("score", score).drop("_m", "_spaced")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _op6_sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, k, '{label}' AS label FROM p WHERE " + " AND ".join(f"w[k + {i}] = '{x}'" for i, x in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    values = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {math.ceil(len(t.split()) / THRESHOLD - 1e-9)})" for label, t in TEMPLATES)
    longest = max(math.ceil(len(t.split()) / THRESHOLD - 1e-9) for _, t in TEMPLATES)
    return rf"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w),
h AS ({phrases}),
g AS (SELECT doc_id, count(*) AS n, min(k) - 1 AS a, max(k) - 1 AS b, list(DISTINCT label) AS ls FROM h GROUP BY doc_id),
t(label, ws, span) AS (VALUES {values}),
l AS (
  SELECT doc_id, w[k:k + {longest - 1}] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w) WHERE w[k] IN (SELECT unnest(ws) FROM t)),
m AS (SELECT doc_id, label, len(list_distinct(list_intersect(x[1:span], t.ws))) / len(t.ws)::DOUBLE AS share FROM l JOIN t ON list_contains(t.ws, x[1])),
s AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS ls FROM m WHERE share >= {THRESHOLD} - 1e-9 GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(g.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(g.ls, []), coalesce(s.ls, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP6_SQL = _op6_sql()
