"""Planned queries to tables of (doc_id, score)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.index import Index
from quern.operators.ranking import Model
from quern.plans.planner import Plan
from quern.plans.query import Boolean, Expanded, MatchAll, Node, Occur, Phrase, Term


@dataclass
class Matcher:
    """Compiles one plan. A node is a DataFrame, or None where it can match nothing."""

    index: Index
    plan: Plan
    universe: DataFrame | None = None  # (doc_id) that `*` and pure negation stand for

    def __post_init__(self):
        self.settings, self.stats = self.index.settings, self.index.statistics
        self.model = Model(self.settings.ranking)

    def compile(self) -> DataFrame | None:
        """(doc_id, score); with a universe, of its documents alone (a semi join)."""
        out = self.node(self.plan.rewritten)
        if out is not None and self.universe is not None:
            out = out.join(self.universe, "doc_id", "left_semi")
        return out

    # ---- leaves

    def number(self, field: str | None) -> int | None:
        return None if field is None else self.settings.fields.number(field)

    def by_field(self, what) -> Column:
        pairs = [F.lit(x) for f in self.settings.fields for x in (f.number, float(what(f.number)))]
        return F.element_at(F.create_map(*pairs), F.col("field_id"))

    def idf(self, term: str) -> float:
        return self.model.idf(self.plan.frequencies[term], self.stats.documents)

    def known(self, term: str) -> bool:
        return term in self.plan.frequencies

    def contributions(self, leaves: list[tuple[int, str, str | None, float]]) -> DataFrame:
        """(doc_id, clause, score) rows of many term clauses from one scan of postings, not yet summed.

        leaves: (clause, term, field, boost). Terms go in as an IN filter, which sorted postings
        answer by row group; idf, averages and boosts are literals.
        """
        terms = sorted({t for _, t, _, _ in leaves})
        rows = self.index.postings.where(F.col("term").isin(terms)).select("term", "field_id", "doc_id", "tf", "field_length")
        clauses = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t"), F.lit(self.number(f)).cast("int").alias("f"), F.lit(self.idf(t)).alias("i"), F.lit(b).alias("b")) for c, t, f, b in leaves])
        if len(leaves) == 1:
            c, _, f, b = leaves[0]
            if f is not None:
                rows = rows.where(F.col("field_id") == self.number(f))
            rows = rows.select("*", F.lit(c).alias("clause"), F.lit(self.idf(terms[0])).alias("i"), F.lit(b).alias("b"))
        else:
            own = F.filter(clauses, lambda x: (x["t"] == F.col("term")) & (x["f"].isNull() | (x["f"] == F.col("field_id"))))
            rows = rows.select("*", F.explode(own).alias("x")).select("*", F.col("x.c").alias("clause"), F.col("x.i").alias("i"), F.col("x.b").alias("b"))
        score = self.model.column(F.col("i"), F.col("tf"), F.col("field_length"), self.by_field(lambda n: self.stats.average.get(n, 0.0)))
        return rows.select("doc_id", "clause", (score * self.by_field(self.settings.fields.boost) * F.col("b")).alias("score"))

    def phrase(self, q: Phrase) -> DataFrame | None:
        """Starts p where every word's position less its offset is p, per field; idf is the words' sum."""
        if not all(self.known(w) for w in q.words):
            return None
        words = sorted(set(q.words))
        rows = self.index.postings.where(F.col("term").isin(words))
        if q.field is not None:
            rows = rows.where(F.col("field_id") == self.number(q.field))
        at = {w: F.max(F.when(F.col("term") == w, F.col("positions"))) for w in words}
        rows = rows.groupBy("doc_id", "field_id").agg(F.max(F.when(F.col("term") == q.words[0], F.col("field_length"))).alias("field_length"), *[at[w].alias(f"p{k}") for k, w in enumerate(words)])
        starts = [F.transform(f"p{words.index(w)}", _less(o)) for w, o in zip(q.words, q.offsets or range(len(q.words)), strict=True)]
        rows = rows.withColumn("tf", F.size(reduce(F.array_intersect, starts))).where("tf > 0")
        idf = sum(self.idf(w) for w in q.words)
        score = self.model.column(F.lit(idf), F.col("tf"), F.col("field_length"), self.by_field(lambda n: self.stats.average.get(n, 0.0)))
        return rows.groupBy("doc_id").agg((F.sum(score * self.by_field(self.settings.fields.boost)) * F.lit(q.boost * self.settings.ranking.phrase_boost)).alias("score"))

    # ---- nodes

    def node(self, q: Node) -> DataFrame | None:
        if isinstance(q, Term):
            return self.total([q], None) if self.known(q.text) else None
        if isinstance(q, Expanded):
            known = [Term(t, q.field) for t in q.terms if self.known(t)]
            return self.total(known, None) if known else None
        if isinstance(q, Phrase):
            return self.phrase(q)
        if isinstance(q, MatchAll):
            return self.everything()
        return self.boolean(q) if isinstance(q, Boolean) else None

    def everything(self) -> DataFrame | None:
        return None if self.universe is None else self.universe.select("doc_id", F.lit(1.0).alias("score"))

    def matches(self, q: Node) -> bool:
        """Whether a node can match at all, as far as the dictionary tells; decides what counts in coordination."""
        if isinstance(q, Term):
            return self.known(q.text)
        if isinstance(q, Phrase):
            return all(self.known(w) for w in q.words)
        if isinstance(q, Expanded):
            return any(self.known(t) for t in q.terms)
        if isinstance(q, MatchAll):
            return self.universe is not None
        if not isinstance(q, Boolean):
            return False
        if any(c.occur is Occur.MUST and not self.matches(c.query) for c in q.clauses):
            return False
        return any(c.occur is not Occur.NOT and self.matches(c.query) for c in q.clauses) or self.universe is not None

    def total(self, nodes: list[Node], having: str | None) -> DataFrame:
        """Sum of the nodes' scores by document. All term nodes share a scan and the one shuffle is by doc_id.

        having "all" keeps documents that every node matches, "share" scales by the share that
        match, None takes sums as they are.
        """
        leaves = [(k, q.text, q.field, q.boost) for k, q in enumerate(nodes) if isinstance(q, Term)]
        parts = [self.contributions(leaves)] if leaves else []
        for k, q in enumerate(nodes):
            if not isinstance(q, Term):
                parts.append(self.node(q).select("doc_id", F.lit(k).alias("clause"), "score"))
        rows = reduce(DataFrame.unionByName, parts)
        if having is None or len(nodes) == 1:
            return rows.groupBy("doc_id").agg(F.sum("score").alias("score"))
        hit = F.bit_count(F.bit_or(F.expr("shiftleft(1L, clause)"))) if len(nodes) < 63 else F.count_distinct("clause")
        rows = rows.groupBy("doc_id").agg(F.sum("score").alias("score"), hit.alias("hits"))
        if having == "all":
            return rows.where(F.col("hits") == len(nodes)).select("doc_id", "score")
        return rows.select("doc_id", (F.col("score") * F.col("hits") / len(nodes)).alias("score"))

    def boolean(self, q: Boolean) -> DataFrame | None:
        part = lambda o: [c.query for c in q.clauses if c.occur is o]
        must, some, never = part(Occur.MUST), [n for n in part(Occur.SHOULD) if self.matches(n)], [n for n in part(Occur.NOT) if self.matches(n)]
        if not all(self.matches(n) for n in must):
            return None
        if must:
            out = self.total(must, "all")
            if some:  # matching optional clauses add their scores, without coordination
                more = self.total(some, None).withColumnRenamed("score", "more")
                out = out.join(more, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        elif some:
            out = self.total(some, "share" if self.settings.ranking.coordination else None)
        else:
            out = self.everything()
        if out is None or not never:
            return out
        return out.join(self.total(never, None).select("doc_id"), "doc_id", "left_anti")


def _less(offset: int):
    return lambda p: p - offset
