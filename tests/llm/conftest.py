"""Small tables with awkward rows, and the driver's smallest tables."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
EXTRA = pa.schema([*DOCUMENTS, ("_row", pa.int64()), ("cuts", pa.string()), ("Shard", pa.string()), ("a.b", pa.string()), ("score", pa.string()), ("f0", pa.string())])


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'er', 'ing', 'o'])}" for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in any column, empty and blank texts, copies, near copies, repeated rows, shared passages, runs, a long text."""
    a, b, passage = prose(120, 1), prose(150, 2), prose(70, 3)
    mail = "Write to a.b@c.example.org or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.300 or 10.0.0.30."
    license_line = "All rights reserved.\nThis work is licensed under a Creative Commons Attribution 4.0 International License (CC BY).\nGNU General Public License"
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, a), (5, a), (5, a), (6, a + " tail"), (7, a.replace(a.split()[60], "changed", 1)), (None, b), (None, None), (8, passage + " " + prose(60, 4)),
        (9, prose(60, 5) + " " + passage), (10, prose(30, 6) + " " + passage + " " + prose(30, 7) + " " + passage), (11, "x" * 700), (12, "ab " * 300), (13, "ÄÖÜ straße ŒUVRE K   ünï " * 20), (14, mail),
        (15, mail + " " + license_line), (16, license_line.upper()), (17, prose(30_000, 8)), (18, "one"), (19, "ONE"), (20, "two words"), (21, "mit license apache license version 2.0"), (22, "\x00\x01 nul \x7f"), (23, "1" * 500), (24, "@" * 300 + "a@b.c" * 50),
    ]
    sources = ["s1", "s1", None, "s2", "s0"]
    return [(i, t, None if k % 5 == 0 else "en", sources[k % len(sources)], None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def write(folder, rows: list[tuple], schema=DOCUMENTS, benchmark: list[tuple] | None = None, labels: list[tuple] | None = None) -> str:
    folder.mkdir(exist_ok=True)
    put = lambda name, schema, rows: pq.write_table(pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema), folder / f"{name}.parquet")
    put("documents", schema, rows)
    put("benchmark", pa.schema([("item_id", pa.int64()), ("text", pa.string())]), benchmark if benchmark is not None else [(1, prose(70, 3)[:200]), (2, "one"), (3, None), (4, ""), (5, "absent words here"), (None, "two words"), (2, "one")])
    put("labels", pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]), labels if labels is not None else [(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)])
    return str(folder)


@pytest.fixture(scope="session")
def small(tmp_path_factory) -> str:
    return write(tmp_path_factory.mktemp("small"), awkward())


@pytest.fixture(scope="session")
def empty(tmp_path_factory) -> str:
    return write(tmp_path_factory.mktemp("empty"), [], benchmark=[], labels=[])


@pytest.fixture(scope="session")
def extra(tmp_path_factory) -> str:
    """The same with columns whose names clash with results and with what operators use inside."""
    return write(tmp_path_factory.mktemp("extra"), [(*r, k, "own", "own", "dot", "own", "own") for k, r in enumerate(awkward())], EXTRA)


def read(folder: str) -> list[tuple]:
    """(doc_id, text) of a folder's documents."""
    t = pq.read_table(f"{folder}/documents.parquet")
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def in_sql(folder: str, sql: str) -> list[dict]:
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def bag(rows, *columns: str) -> list[str]:
    """Rows as sorted strings: a multiset of the chosen columns."""
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted("|".join(show(r[c]) for c in columns) for r in rows)
