"""The engine: documents in, ranked answers out."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Settings
from quern.functions.analysis import Analyzer
from quern.operators import highlight, results
from quern.operators.explain import Explainer
from quern.operators.filters import Filters
from quern.operators.index import Index
from quern.operators.matching import Matcher
from quern.plans.planner import Plan, Planner
from quern.plans.query import MatchAll, parse
from quern.sources import documents as sources
from quern.storage import cut


@dataclass(frozen=True)
class Request:
    query: str = ""
    offset: int = 0
    size: int = 10
    sort: str = "relevance"
    filters: Filters = Filters()
    facets: bool = True
    highlight: bool = True
    explain: bool = False

    @classmethod
    def of(cls, parameters: Mapping, most: int = 100) -> Request:
        """From request parameters: q or query, page or from, size (1 to most), sort, flags, filters."""
        flag = lambda k, d: str(parameters.get(k, d)).lower() in ("1", "true", "yes", "on")
        size = min(most, max(1, int(parameters.get("size", 10))))
        offset = max(0, int(parameters["from"])) if "from" in parameters else (max(1, int(parameters.get("page", 1))) - 1) * size
        return cls(
            str(parameters.get("q", parameters.get("query", ""))).strip(), offset, size, results.sort_name(parameters.get("sort")),
            Filters.of(parameters), flag("facets", True), flag("highlight", True), flag("explain", False),
        )


@dataclass
class Response:
    total: int
    max_score: float
    page: int
    size: int
    pages: int
    took_ms: float
    query: dict
    facets: dict = field(default_factory=dict)
    hits: list[dict] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, default=str)


class SearchEngine:
    """Search, suggestions, statistics and changes over an index. Results are exact at any size: no caps on matches, filters or facets."""

    def __init__(self, index: Index, logs: DataFrame | None = None, log_path: str | None = None):
        self.index, self.settings = index, index.settings
        self.spark: SparkSession = index.documents.sparkSession
        self.analyzer = Analyzer(self.settings.analyzer)
        self.log_path = log_path
        self._logs = logs

    @classmethod
    def from_sources(cls, raw: DataFrame, settings: Settings | None = None) -> SearchEngine:
        """Of source documents (quern.sources): parsed, indexed and stored as tables."""
        docs, _ = sources.parse(raw)
        return cls(Index.build(cut(docs, "documents"), settings).settled())

    # ---- search

    def plan(self, query: str) -> Plan:
        node = parse(query, self.settings.default_operator) if query.strip() else MatchAll()
        return Planner(self.index, self.settings).plan(node)

    def matched(self, plan: Plan, filters: Filters = Filters()) -> DataFrame:
        """All (doc_id, score) of a plan; empty where nothing can match."""
        universe = None
        if filters:
            universe = filters.apply(self.index.documents).select("doc_id")
        elif isinstance(plan.rewritten, MatchAll):
            universe = self.index.documents.select("doc_id")
        out = Matcher(self.index, plan, universe).compile()
        return out if out is not None else self.index.documents.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))

    def search(self, request: Request | str) -> Response:
        r = Request(request) if isinstance(request, str) else request
        began = time.perf_counter()
        plan = self.plan(r.query)
        matched = self.matched(plan, r.filters).persist()
        try:
            total = results.summary(matched).first()
            if r.sort == "relevance":
                page = results.top(matched, r.offset, r.size)
            else:
                page = results.by_date(matched, self.index.documents, r.sort == "newest", r.offset, r.size).drop("published_at")
            hits = self.hits(page, plan, r)
            facets = self.facets(matched) if r.facets else {}
        finally:
            matched.unpersist()
        took = time.perf_counter() - began
        response = Response(
            total["total"], round((total["max_score"] or 0.0) if r.sort == "relevance" else 0.0, 6), r.offset // r.size + 1, r.size, -(-total["total"] // r.size), round(took * 1000, 3),
            {"original": str(plan.original), "rewritten": str(plan.rewritten), "terms": plan.terms, "needs_positions": plan.needs_positions, "sort": r.sort}, facets, hits,
        )
        if self.log_path and r.query:
            row = results.log_entry(self.spark, r.query, json.dumps(asdict(r.filters), default=str) if r.filters else None, response.total, int(took * 1e6))
            row.write.mode("append").parquet(self.log_path)
        return response

    def hits(self, page: DataFrame, plan: Plan, r: Request) -> list[dict]:
        """A page (at most max_size rows) with stored columns, fragments and explanations."""
        order = [(x["doc_id"], x["score"]) for x in page.collect()]
        if not order:
            return []
        ids = [d for d, _ in order]
        stored = self.index.documents.where(F.col("doc_id").isin(ids))
        if r.highlight:
            stored = highlight.highlighted(stored, self.analyzer, plan.terms, plan.phrases, self.settings.highlight)
        rows = {x["doc_id"]: x.asDict() for x in stored.collect()}
        why = Explainer(self.index, plan, ids, bool(r.filters) or isinstance(plan.rewritten, MatchAll)) if r.explain else None
        out = []
        for doc, score in order:
            row = rows[doc]
            row.pop("body", None)
            row["score"] = round(score, 6)
            row["highlights"] = json.loads(row.get("highlights") or "{}")
            if why:
                e = why.explain(doc)
                row["explanation"] = e.as_dict() if e else None
            out.append(row)
        return out

    def facets(self, matched: DataFrame) -> dict[str, dict[str, int]]:
        names = {"categories": "category", "tags": "tags", "authors": "author"}
        parts = [results.facet(self.index.documents, c, self.settings.facet_limit, matched).select(F.lit(n).alias("facet"), "value", "count") for n, c in names.items()]
        out: dict[str, dict[str, int]] = {n: {} for n in names}
        for row in sorted(reduce(DataFrame.unionByName, parts).collect(), key=lambda x: (-x["count"], x["value"])):
            out[row["facet"]][row["value"]] = row["count"]
        return out

    # ---- suggestions, logs, statistics

    @property
    def logs(self) -> DataFrame | None:
        if self._logs is not None or not self.log_path:
            return self._logs
        return self.spark.read.schema(results.LOG).parquet(self.log_path)

    def suggest(self, typed: str, size: int = 8) -> dict:
        text = typed.strip()
        if len(text) < 2:
            return {"prefix": text, "terms": [], "queries": []}
        found = results.suggest(self.index, text, self.analyzer.normalise(text.split()[-1]), size)
        popular = results.popular(self.logs, size, text).collect() if self.logs is not None else []
        return {"prefix": text, "terms": [x.asDict() for x in found.collect()], "queries": [x.asDict() for x in popular]}

    def statistics(self) -> dict:
        one = results.index_statistics(self.index).first().asDict()
        by = {x["field_id"]: x for x in results.field_statistics(self.index).collect()}
        fields = {f.name: {"id": f.number, "boost": f.boost, "documents": by[f.number]["documents"] if f.number in by else 0, "average_length": by[f.number]["average_length"] if f.number in by else 0.0} for f in self.settings.fields}
        facet = lambda c, n: {x["value"]: x["count"] for x in results.facet(self.index.documents, c, n).collect()}
        return {
            "index": one, "fields": fields, "analysis": self.analyzer.describe(), "ranking": asdict(self.settings.ranking), "facets": {"categories": facet("category", 50), "tags": facet("tags", 20)},
            "searches": results.log_statistics(self.logs).first().asDict() if self.logs is not None else {},
        }

    def health(self) -> dict:
        """Whether each table can be read."""
        checks = {}
        for name in ("documents", "postings", "terms", "lengths"):
            try:
                getattr(self.index, name).limit(1).count()
                checks[name] = "ok"
            except Exception as e:  # whatever keeps a table from being read is the answer
                checks[name] = str(e).splitlines()[0]
        return {"status": "ok" if set(checks.values()) == {"ok"} else "degraded", "checks": checks}

    # ---- documents

    def ingest(self, raw: DataFrame, force: bool = False) -> dict[str, int]:
        """Take in source documents; counts by status, rejected ones among them."""
        docs, rejected = sources.parse(raw)
        index, status = self.index.upsert(docs, force)
        status = cut(status, "status")
        self.index = index.settled()
        counts = {x["status"]: x["count"] for x in status.groupBy("status").count().collect()}
        return {"created": 0, "updated": 0, "unchanged": 0} | counts | {"rejected": rejected.count()}

    def delete(self, external_id: str) -> bool:
        if self.index.documents.where(F.col("external_id") == external_id).isEmpty():
            return False
        self.index = self.index.delete([external_id]).settled()
        return True

    def find(self, external_id: str) -> dict | None:
        row = self.index.documents.where(F.col("external_id") == external_id).first()
        return row.asDict() if row else None

    def reindex(self) -> dict:
        began = time.perf_counter()
        self.index = self.index.reindex().settled()
        return {"documents": self.index.statistics.documents, "tokens": self.index.statistics.tokens, "took_ms": round((time.perf_counter() - began) * 1000, 3)}
