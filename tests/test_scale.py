"""Odd inputs and repeated documents: the queries against their SQL, and the index pass against plain expressions."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quern import oracles, queries


def tables(path, texts, ids=None):
    """documents and labels in a folder."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en", "fr"] * (n // 2) + ["en"] * (n % 2), "source": [f"src{k % 3}" for k in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), f"{path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids[:3], pa.int64()), "quality": pa.array([1, 0, 1], pa.int64()), "toxic": pa.array([0, 1, 0], pa.int64())}), f"{path}/labels.parquet")
    return str(path)


def wanted(path, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return sorted(map(repr, con.sql(oracles.all_sql()[name]).fetchall()))


def got(spark, path, name):
    return sorted(repr(tuple(r)) for r in queries.queries()[name](spark, path).collect())


TEXTS = ["Heat of the BLE\nheat heats Café's straße", "  ", None, "\n\t\n", "", "ble  thon\r\n\r\n\r\n\r\nérin thanea  heat", "# title here\n\nrelational 8.4 o’clock's"]


def test_checksums_count_every_document(spark, tmp_path):
    path = tables(tmp_path, TEXTS)
    for name in ("checksums", "parse_text_docs"):
        assert got(spark, path, name) == wanted(path, name), name
    (tmp_path / "none").mkdir()
    none = tables(tmp_path / "none", ["x"] * 3)
    pq.write_table(pq.read_table(f"{none}/documents.parquet").slice(0, 0), f"{none}/documents.parquet")
    assert got(spark, none, "checksums") == wanted(none, "checksums") == ["(True, 0)"]


INDEXED = ["postings", "postings_without_positions", "term_dictionary", "term_dictionary_unstemmed", "field_lengths", "index_statistics", "bool_and", "phrase_and_term", "index_after_upsert"]


def test_index_of_odd_texts(spark, tmp_path):
    path = tables(tmp_path, [*TEXTS, "the of and", "heat ble " * 3, "’ … ñandú Ærø Þor SS ﬁ Ⅷ ² 3,5.1 x" + "y" * 45, "erin thanea. heat\tble " + "relational hopping sky " * 2])
    for name in INDEXED:
        assert got(spark, path, name) == wanted(path, name), name


def test_terms_are_those_of_the_expressions(spark):
    """The index's tokens, on the driver's analyzer and as Spark expressions."""
    from pyspark.sql import functions as F

    from quern.config import AnalyzerConfig
    from quern.functions.analysis import Analyzer, tokenize, terms

    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}{c} " for c in points[k : k + 500]) for k in range(0, len(points), 500)] + ["ΟΔΥΣΣΕΥΣ ΑΣ’ΣΑ İstanbul dogs's DOG’S 's x's"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    config, bad = AnalyzerConfig(stemmer="none"), []
    a = Analyzer(config)
    for r in df.select(tokenize(F.col("t")).alias("raw"), terms(F.col("t"), config).alias("terms")).collect():
        want = [(x["term"], x["position"]) for x in r["terms"]]
        mine = [(t, k) for k, t in enumerate(map(a.term, r["raw"])) if t is not None]
        bad += sorted(set(mine) ^ set(want), key=lambda x: x[1])
    assert bad == []


def test_rows_that_share_an_id_are_one_document(spark):
    from quern.operators.index import Index

    docs = spark.createDataFrame([(1, "heat one", ["x"], "heat heat"), (1, "heat", ["x"], "ble"), (2, None, [], "ble")], "doc_id long, title string, tags array<string>, body string")
    ix = Index.build(docs).settled()
    assert sorted(map(tuple, ix.terms.where("term in ('heat', 'ble')").collect())) == [("ble", 2, 2), ("heat", 1, 4)]
    assert [(r["doc_id"], r["field_id"], r["tf"], r["positions"]) for r in ix.postings.where("term = 'heat'").orderBy("field_id").collect()] == [(1, 1, 2, [0, 0]), (1, 3, 2, [0, 1])]


def test_a_built_index_moves_chunks(spark):
    """Fewer rows go through its shuffle than it has postings, and no posting's text is joined with stems."""
    from quern.operators.index import Index

    docs = spark.createDataFrame([(k, None, [], f"heat ble thon w{k % 7}") for k in range(400)], "doc_id long, title string, tags array<string>, body string").coalesce(1)
    ix = Index.build(docs)
    assert ix.chunks.count() == 3 + 7 + 1 and ix.postings.count() == 1600
    plan = ix.postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_chunks_are_of_segments_not_of_batches(spark):
    """Batches of a task go together: a row a term and field, stored by term as it came, without a shuffle."""
    from quern.operators.index import Index

    docs = spark.createDataFrame([(k, None, [], f"heat ble thon w{k % 7}" if k != 60 else None) for k in range(400)], "doc_id long, title string, tags array<string>, body string").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        ix = Index.build(docs).settled()
    finally:
        spark.conf.set(key, before)
    rows = [(r["term"], r["first"], r["documents"]) for r in ix.chunks.collect()]
    assert rows == [(None, 0, 0), ("ble", 0, 399), ("heat", 0, 399), ("thon", 0, 399), *[(f"w{k}", k, len(range(k, 400, 7)) - (k == 60 % 7)) for k in range(7)]]
    assert sorted(r["doc_id"] for r in ix.postings.where("term = 'heat'").collect()) == [k for k in range(400) if k != 60]
    assert "Exchange" not in ix.postings._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_bytes_are_those_of_the_expression():
    import random
    import unicodedata

    import numpy as np
    import regex

    from quern.functions.analysis import TOKEN
    from quern.operators import invert

    kinds = np.array([{"N": invert.DIGIT, "L": invert.LETTER}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)
    rng, finder = random.Random(1), regex.compile(TOKEN)
    for n in range(500):
        texts = pa.array([None if rng.random() < 0.05 else "".join(rng.choices("aZ39.,'’é٣Ⅷ𝟙𐐀 \n-", k=rng.choice([0, 1, 3, 8, 20]))) for _ in range(rng.randint(1, 12))], pa.string()).slice(n % 2)
        words, rows = invert.tokens(texts, kinds)
        assert list(zip(rows.tolist(), words.to_pylist(), strict=True)) == [(k, m[0]) for k, t in enumerate(texts.to_pylist()) for m in finder.finditer(t or "")]
    data = [b"ab\xffcd \xc3", b"\x80x y\xe2\x80", b"z", b"a\xc1\x81b"]  # no UTF-8
    bad = pa.array(data, pa.binary())
    assert invert.tokens(pa.StringArray.from_buffers(4, bad.buffers()[1], bad.buffers()[2]), kinds)[0].to_pylist() == ["ab", "cd", "x", "y", "z", "a", "b"]


def test_upsert_takes_no_row_for_each_posting(spark):
    """Term statistics of changed documents come from them; the same as from their postings."""
    from quern.operators.index import DOCUMENT, Index, checksum

    def docs(texts):
        rows = [(k, str(k), "text/plain", f"heat {k % 3}x", t, None, None, None, ["heat", "ble"]) for k, t in texts.items()]
        df = spark.createDataFrame(rows, "doc_id long, external_id string, media_type string, title string, body string, url string, author string, category string, tags array<string>").selectExpr("*", "timestamp'2024-01-01' AS published_at")
        return df.withColumn("checksum", checksum(*DOCUMENT))

    ix = Index.build(docs({1: "heat heats thon", 2: "ble ble", 3: None})).settled()
    batch = docs({1: "thon inor", 2: "ble ble", 4: "est"}).drop("doc_id", "checksum")
    after, _ = ix.upsert(batch)
    plain = Index(ix.documents, ix.postings, ix.terms, ix.lengths, ix.settings).upsert(batch)[0]
    assert sorted(map(tuple, after.terms.collect())) == sorted(map(tuple, plain.terms.collect()))
    assert ("inor", 1, 1) in map(tuple, after.terms.collect()) and "Generate" not in after.terms._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_many_tokens_are_those_of_each(monkeypatch):
    """As one array, with every kind of letter; the stemmer is asked for words alone that end as a suffix of its does."""
    import random
    import unicodedata

    from quern.config import AnalyzerConfig
    from quern.functions import porter
    from quern.functions.analysis import Analyzer
    from quern.operators import invert

    rng = random.Random(2)
    points = [chr(c) for c in range(1, 0x30000) if unicodedata.category(chr(c))[0] in "LN"]
    words = {"".join(rng.choices("aZySsedinglE39.,'’éΣσİßæﬁ", k=rng.randint(1, 12))) for _ in range(20000)} | {"a" + c + "Σ" for c in points} | set(points) | {"x" * 40, "x" * 41, "é" * 40, "é" * 41, "The", "Heating"}
    words = sorted(words)
    for config in (AnalyzerConfig(), AnalyzerConfig(stemmer="none"), AnalyzerConfig.minimal(), AnalyzerConfig(fold=False), AnalyzerConfig(normalise=False)):
        analyzer = Analyzer(config)
        assert invert.terms_of(pa.array(words), analyzer).to_pylist() == [analyzer.term(w) for w in words]
    asked, plain = [], porter.stem.__wrapped__
    monkeypatch.setattr(porter, "stem", type("", (), {"__wrapped__": staticmethod(lambda w: asked.append(w) or plain(w))}))
    monkeypatch.setattr(invert, "_TERMS", {})
    assert invert.terms_of(pa.array(["Thon", "heating", "the", "ble"]), Analyzer()).to_pylist() == ["thon", "heat", None, "ble"] and asked == ["heating", "ble"]


def test_parsing_computes_each_part_once(spark):
    from pyspark.sql import functions as F

    from quern.functions import text
    from quern.sources import documents

    texts = ["", " ", "a", " a\t", "\x00\x0b", "a\r\nb \n\n\n\n c\u00a0 d", "# ## title of it\nrest", "é" * 121, "x y" * 50 + "\nrest", "ab " * 45 + "\n \nrest  it\n", "#\n", "# # \n\nbody", "a \n b", "a\n\nb", "a\n\n\nb"]
    df = spark.createDataFrame([(str(k), "text", t) for k, t in enumerate(texts)], "external_id string, media_type string, content string")
    for n in ("title", "url", "author", "category"):
        df = df.withColumn(n, F.lit(None).cast("string"))
    docs = documents.checked(df.withColumn("tags", F.lit(None).cast("array<string>")).withColumn("published_at", F.lit(None).cast("timestamp")))
    for r in docs.select(F.col("external_id").cast("int"), "title", "body").collect():
        whole = text.py_normalise(texts[r[0]])
        first, _, rest = whole.partition("\n")
        assert (r["title"], r["body"]) == (text.py_truncate(first.strip(" ").lstrip("# "), 120), rest.strip(" \n") or whole), texts[r[0]]
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("substring_index(") == 1


def test_statuses_of_an_upsert_need_neither_texts_nor_postings(spark, tmp_path):
    import glob

    from quern.storage import shared_dir

    path, before = tables(tmp_path, TEXTS), set(glob.glob(f"{shared_dir(spark)}/quern-index-*"))
    assert got(spark, path, "upsert_status") == wanted(path, "upsert_status")
    assert set(glob.glob(f"{shared_dir(spark)}/quern-index-*")) == before
    assert "max_by" not in queries.queries()["upsert_status"](spark, path)._jdf.queryExecution().optimizedPlan().toString()
