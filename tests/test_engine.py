"""The four-document corpus: matching, ranking, filters, facets, changes, explanations, suggestions."""

import math

import pytest

from quern.config import AnalyzerConfig, Field, FieldRegistry, HighlightOptions, Ranking, Settings
from quern.engine import Request, SearchEngine
from quern.functions import porter
from quern.functions.analysis import Analyzer
from quern.operators import highlight, results
from quern.operators.filters import Filters
from quern.plans.query import QuerySyntaxError
from quern.sources import documents as sources

CORPUS = [
    {"id": "search-basics", "title": "Search engine basics", "content": "An inverted index maps terms to documents. The index is the core of every search engine.", "category": "Guides", "author": "Ada", "tags": "index, basics", "published_at": "2025-01-10"},
    {"id": "ranking-models", "title": "Ranking models compared", "content": "BM25 and TF-IDF rank documents by term frequency and inverse document frequency.", "category": "Ranking", "author": "Bo", "tags": ["ranking", "bm25"], "published_at": "2025-02-14"},
    {"id": "posting-lists", "title": "Posting lists and skipping", "content": "A posting list stores document identifiers in sorted order so that intersection is a merge.", "category": "Guides", "author": "Ada", "tags": ["index", "postings"], "published_at": "2025-03-02"},
    {"id": "tokenizers", "title": "Tokenizers and normalisation", "content": "Tokenization splits text into terms; normalisation lowercases them and folds accents.", "category": "Analysis", "author": "Cy", "tags": ["analysis"], "published_at": "2025-04-20"},
]


@pytest.fixture(scope="module")
def engine(spark):
    return SearchEngine.from_sources(sources.from_payloads(spark, CORPUS))


def ids(engine, query, **kw):
    return [h["external_id"] for h in engine.search(Request(query, facets=False, highlight=False, **kw)).hits]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("ranking AND bm25", {"ranking-models"}),
        ("ranking AND tokenization", set()),
        ('"posting list"', {"posting-lists"}),
        ('"list posting"', set()),
        ("title:ranking", {"ranking-models"}),
        ("title:sorted", set()),
        ("token*", {"tokenizers"}),
        ("to*n", {"tokenizers"}),
        ("kubernetes", set()),
        ("the and of", set()),
        ("index AND the", set()),
        ("-index", set()),
        ("", {d["id"] for d in CORPUS}),
        ("+index rank", {"search-basics", "posting-lists"}),
        ("(ranking OR token*) -bm25", {"tokenizers"}),
    ],
)
def test_matching(engine, query, expected):
    assert set(ids(engine, query)) == expected


def test_ranking_and_rewriting(engine):
    r = engine.search("inverted index")
    assert r.hits[0]["external_id"] == "search-basics"
    assert r.query["rewritten"] == "(invert index)"
    assert not r.query["needs_positions"]
    found = ids(engine, "index -posting")
    assert "search-basics" in found and "posting-lists" not in found


def test_unknown_optional_terms_do_not_dilute(engine):
    score = lambda q: engine.search(Request(q, facets=False)).max_score
    assert score("index kubernetes") == score("index")


def test_dates_and_paging(engine):
    assert ids(engine, "", sort="newest")[0] == "tokenizers"
    assert ids(engine, "", sort="oldest")[0] == "search-basics"
    assert len(ids(engine, "", size=3)) == 3 and len(ids(engine, "", size=3, offset=3)) == 1
    assert Request.of({"q": "x", "size": 1000, "page": 3}).size == 100
    assert Request.of({"size": 5, "page": 3}).offset == 10


@pytest.mark.parametrize(
    ("parameters", "count"),
    [
        ({"category": "Guides"}, 2),
        ({"author": "Ada"}, 2),
        ({"author": "Cy"}, 1),
        ({"tag": "index,ranking"}, 3),
        ({"tag": "index,postings", "match_all_tags": "1"}, 1),
        ({"from_date": "2025-03-01"}, 2),
        ({"to_date": "2025-02-28"}, 2),
        ({"from_date": "2025-02-01", "to_date": "2025-02-28"}, 1),
        ({"from_date": "never"}, 4),
    ],
)
def test_filters(engine, parameters, count):
    assert engine.search(Request("", filters=Filters.of(parameters), highlight=False)).total == count


def test_negation_and_unknown_words_within_a_filter(engine):
    guides = Filters(categories=("Guides",))
    assert ids(engine, "-posting", filters=guides) == ["search-basics"]
    assert set(ids(engine, "kubernetes docker", filters=guides)) == {"search-basics", "posting-lists"}
    assert ids(engine, "kubernetes", filters=guides) == []


def test_facets(engine):
    f = engine.search("index").facets
    assert f["categories"]["Guides"] == 2 and f["authors"]["Ada"] == 2 and f["tags"]["index"] == 2


@pytest.mark.parametrize("query", ["inverted index", '"posting list" index', "+index rank", "token*", "index ranking document", "(index OR rank) AND document"])
@pytest.mark.parametrize("model", ["bm25", "tfidf"])
def test_explanations_add_up(engine, query, model):
    other = SearchEngine(engine.index)
    other.index.settings = other.settings = Settings(ranking=Ranking(model=model))
    for hit in other.search(Request(query, explain=True, facets=False, highlight=False)).hits:
        assert hit["explanation"]["value"] == pytest.approx(hit["score"], abs=1e-4)
    engine.index.settings = engine.settings = Settings()


@pytest.mark.parametrize("query", ["category:Guides", 'open "phrase', "a:b:c", "--x", "+-x", "(index", "index)", "()", "http://x", "x" * 513, "(" * 14 + "a" + ")" * 14])
def test_syntax_errors(engine, query):
    with pytest.raises(QuerySyntaxError):
        engine.plan(query)


def test_score_by_hand(engine):
    """BM25 of one term in one field, from the formula."""
    s = engine.index.statistics
    df = engine.index.frequencies(["sort"])["sort"]
    idf = math.log(1 + (s.documents - df + 0.5) / (df + 0.5))
    length = next(r["length"] for r in engine.index.lengths.collect() if r["field_id"] == 3 and r["doc_id"] == engine.search("sorted").hits[0]["doc_id"])
    want = idf * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * length / s.average[3]))
    assert engine.search("sorted").max_score == pytest.approx(want, abs=1e-6)


def test_changes(spark):
    e = SearchEngine.from_sources(sources.from_payloads(spark, [{"id": "1", "title": "Index", "content": "index index index"}, {"id": "2", "title": "Other", "content": "index once"}]))
    stats = lambda t: {r["term"]: (r["document_frequency"], r["total_frequency"]) for r in e.index.terms.collect()}.get(t, (0, 0))
    assert stats("index") == (2, 5)
    again = e.ingest(sources.from_payloads(spark, [{"id": "2", "title": "Other", "content": "index once"}]))
    assert again == {"created": 0, "updated": 0, "unchanged": 1, "rejected": 0}
    assert e.ingest(sources.from_payloads(spark, [{"id": "2", "title": "Other", "content": "gamma"}, {"id": "3", "content": "alpha beta alpha gamma alpha"}]))["updated"] == 1
    assert stats("index") == (1, 4) and stats("gamma")[0] == 2
    positions = {(r["term"], r["field_id"]): r["positions"] for r in e.index.postings.collect() if r["term"] == "alpha"}
    assert positions["alpha", 3] == [0, 2, 4]
    assert e.delete("1") and not e.delete("1")
    assert stats("index") == (0, 0) and e.index.prune().terms.where("term = 'index'").count() == 0
    assert e.find("3")["external_id"] == "3" and e.reindex()["documents"] == 2


def test_save_load_and_streaming(spark, tmp_path, engine):
    from quern.operators.index import Index
    from quern.streaming import ingest

    engine.index.save(str(tmp_path / "ix"))
    other = SearchEngine(Index.load(spark, str(tmp_path / "ix")), log_path=str(tmp_path / "log"))
    assert other.search("inverted index").total == engine.search("inverted index").total
    other.search("Inverted  INDEX")
    other.search("nothinghere")
    assert other.suggest("inv")["queries"] == [{"query": "inverted index", "searches": 2}]
    assert results.log_statistics(other.logs).first()["empty_results"] == 1
    assert other.statistics()["index"]["documents"] == 4 and other.health()["status"] == "ok"
    raw = sources.from_payloads(spark, CORPUS)
    raw.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")), str(tmp_path / "live"), str(tmp_path / "cp")).awaitTermination()
        sources.from_payloads(spark, [*CORPUS[:1], {"id": "new", "content": "fresh words"}]).write.mode("append").parquet(str(tmp_path / "in"))
    live = Index.load(spark, f"{tmp_path}/live/{ingest.current(spark, f'{tmp_path}/live')}")
    assert live.documents.count() == 5 and live.statistics.documents == 5


def test_suggestions(engine):
    s = engine.suggest("search ind")
    assert s["terms"][0] == {"term": "index", "documents": 2, "query": "search index"}
    assert engine.suggest("i")["terms"] == []


def test_highlighting(engine):
    hit = engine.search("inverted index").hits[0]
    assert "<mark>inverted</mark> <mark>index</mark>" in hit["highlights"]["body"][0]
    a, o = Analyzer(), HighlightOptions(fragment_size=40)
    out = highlight.highlight(a, {"body": "x & <b> " + "filler words here " * 20 + "the posting list at é end"}, ["post", "list"], [("post", "list")], o)
    assert "<mark>posting list</mark>" in out["body"][0] and out["body"][0].startswith("…")
    assert highlight.highlight(a, {"body": "a < b & 'c'"}, ["zzz"], [], o)["body"] == ["a &lt; b &amp; &#039;c&#039;"]
    assert highlight.highlight(a, {"body": " "}, ["x"], [], o) == {}


def test_analysis(spark):
    a = Analyzer()
    assert a.terms("Café DOCUMENTS ranking") == ["cafe", "document", "rank"]
    assert [(t.term, t.position) for t in a.analyse("bed and breakfast")] == [("bed", 0), ("breakfast", 2)]
    assert a.terms("Lucene's codecs e-mail") == ["lucen", "codec", "mail"]
    plain = Analyzer(AnalyzerConfig.minimal())
    assert plain.terms("PHP 8.4 released 2024; 2nd bm25") == ["php", "8.4", "released", "2024", "2", "nd", "bm25"]


# Words and their stems by the published algorithm.
STEMS = {
    "documents": "document",
    "classes": "class",
    "queries": "queri",
    "less": "less",
    "indexing": "index",
    "ranked": "rank",
    "agreed": "agre",
    "stopping": "stop",
    "filing": "file",
    "happy": "happi",
    "relational": "relat",
    "normalization": "normal",
    "effectiveness": "effect",
    "sensibiliti": "sensibl",
    "hopeful": "hope",
    "goodness": "good",
    "cement": "cement",
    "adoption": "adopt",
    "probate": "probat",
    "controll": "control",
    "is": "is",
    "straße": "straße",
    "bm25": "bm25",
}


def test_stems_agree(spark):
    assert {w: porter.stem(w) for w in STEMS} == STEMS
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    more = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).distinct()
    more = more.unionByName(spark.createDataFrame([(w + s,) for w in ("plai", "yell", "hopp", "relat", "abl", "troubl", "y", "sky", "conform") for s in ("ed", "ing", "ational", "iveness", "y", "ies", "ion", "ement", "ll", "e", "s", "yed")], "term string")).distinct()
    bad = [(r["term"], r["stem"]) for r in porter.stems(more).collect() if porter.stem(r["term"]) != r["stem"]]
    assert bad == []


def test_fields():
    with pytest.raises(ValueError):
        FieldRegistry(Field(1, "a"), Field(1, "b"))
    with pytest.raises(ValueError):
        FieldRegistry(Field(256, "a"))


def test_parsers(spark):
    html = "<html><head><title> A  page </title><meta name='author' content='Ada'><meta name='keywords' content='x, y'><style>no</style></head><body><h1>Head</h1><p>One<br>two &amp; three</p><script>bad()</script></body></html>"
    raw = [
        {"id": "h", "media_type": "text/html; charset=utf-8", "content": html},
        {"id": "j", "type": "json", "content": {"headline": "T", "text": "body text", "by": "Bo", "labels": ["p", 2], "date": "2025-01-02"}},
        {"id": "f", "type": "json", "content": {"a": {"b": ["deep", 3]}, "c": True}},
        {"id": "m", "type": "md", "content": "# Heading here\n\nrest  of\tit"},
        {"id": "t", "content": "only line"},
        {"id": "b", "media_type": "application/pdf", "content": "x"},
        {"id": "e", "media_type": "html", "content": "<script>x</script>"},
    ]
    docs, bad = sources.parse(sources.from_payloads(spark, raw))
    d = {r["external_id"]: r for r in docs.collect()}
    assert (d["h"]["title"], d["h"]["author"], d["h"]["tags"], d["h"]["body"]) == ("A page", "Ada", ["x", "y"], "Head\n\nOne\ntwo & three")
    assert (d["j"]["title"], d["j"]["author"], d["j"]["tags"], str(d["j"]["published_at"])) == ("T", "Bo", ["p", "2"], "2025-01-02 00:00:00")
    assert d["f"]["body"] == "deep\n3"
    assert (d["m"]["title"], d["m"]["body"]) == ("Heading here", "rest of it")
    assert (d["t"]["title"], d["t"]["body"]) == ("only line", "only line")
    assert {r["external_id"] for r in bad.collect()} == {"b", "e"}
    for wrong in ({"content": "x"}, {"id": "1"}, {"id": "1", "content": "x", "tags": 3}, {"id": "1", "content": "x", "published_at": "soon"}, {"id": "y" * 192, "content": "x"}):
        with pytest.raises(sources.InvalidDocument):
            sources.record(wrong)
