"""Personal data: four base kinds, and identifiers that bootstrapped contexts discover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, stowed, table

KINDS = ("email", "ip", "card", "phone")
# Each finds the leftmost non-overlapping matches of the plain form given in the README. Look-behinds
# keep a long run from being tried at each of its places, possessive groups loop without recursion.
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # maximal runs of digits with single separators, of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Seeds beyond the base kinds: access keys of a published form, and values given to a name that says they are secret.
SECRET = "secret"
_SECRETS = (
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?<=(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\x20]?[=:][\x20]?[\x22\x27]?)(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{8,128}"
)
_NAMES = r"AKIA|(?i:passw|secret|token|key)[^\n]{0,8}[=:]"
#: Identifier-like words that contexts may discover.
_CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{5,63}+(?![A-Za-z0-9_-])"
#: A pattern needs so many distinct seeds, and this share of all its occurrences in the texts, to speak; an instance this score to be taken.
SEEDS, CONFIDENT, ROUNDS = 3, 0.5, 3
_SPAN = "array<struct<kind:string,start:int,end:int,value:string,before:string>>"


def let(cols: list[Column], then: Callable[[list[Column]], Column]) -> Column:
    """`then` over values that are computed once a row, whatever lambdas read them."""
    s = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(cols)])
    return F.element_at(F.transform(F.array(s), lambda x: then([x[f"c{k}"] for k in range(len(cols))])), 1)


def prefix_sums(lens: Column, chunk: int = 256) -> Column:
    """Sums of the elements before each; in chunks, so that a text with many matches costs little more than their number."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def outer(c):
        return let([c[0], F.transform(F.sequence(F.lit(0), (F.size(c[0]) / chunk).cast("int")), lambda k: add(F.slice(c[0], k * chunk + 1, chunk)))], inner)

    def inner(c):
        whole = lambda i: (i / chunk).cast("int")
        return F.transform(c[0], lambda x, i: add(F.slice(c[1], 1, whole(i))) + add(F.slice(c[0], whole(i) * chunk + 1, i % chunk)))

    return let([lens], outer)


def found(text: Column, kind: str, pattern: str) -> Column:
    """All matches as (kind, start, end, value, the word before): code points, end exclusive."""

    def spans(c):
        m, g = c
        lens = F.zip_with(m, F.slice(g, 1, F.size(m)), lambda a, b: F.length(a) + F.length(b))
        return let([m, g, prefix_sums(lens)], rows)

    def rows(c):
        m, g, p = c
        return F.transform(
            m,
            lambda x, i: F.struct(
                F.lit(kind).alias("kind"),
                (p[i] + F.length(g[i])).alias("start"),
                (p[i] + F.length(g[i]) + F.length(x)).alias("end"),
                x.alias("value"),
                F.lower(F.regexp_extract(F.substring(g[i], -64, 64), r"(\S+)\s*[^\sA-Za-z0-9]*$", 1)).alias("before"),
            ),
        )

    return let([F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)], spans)


def _luhn(digits: Column) -> Column:
    def one(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + one(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.substring(x, -3, 3).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["value"])


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """The base kinds' spans, by kind and start; matches that fail their kind's test are dropped, without retries."""
    needs = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9]([\x20-]?[0-9]){15}")}
    none = F.array().cast(_SPAN)
    valid = {k: _test(k) for k in KINDS}
    parts = [F.when(needs[k], F.filter(found(text, k, _PATTERNS[k]), valid[k])).otherwise(none) for k in KINDS]
    return F.concat(*parts)


def secrets(text: Column) -> Column:
    return F.when(text.rlike(_NAMES), found(text, SECRET, _SECRETS)).otherwise(F.array().cast(_SPAN))


def candidates(text: Column) -> Column:
    c = F.filter(found(text, "", _CANDIDATE), lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")) >= 4)
    return F.when(text.rlike("[0-9]{2}"), c).otherwise(F.array().cast(_SPAN))


def discover(spans: DataFrame, texts: DataFrame, seeds: int = SEEDS, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind) of identifiers beyond the base: the bootstrapping.

    Instances are values, patterns the word before a value (glued to it or not). Base values and
    secrets are seeds of their kind with score 1. Each round, a pattern's confidence in a kind is
    the sum of its occurrences before scored instances, weighed by their scores, over all its
    occurrences, whatever follows: in texts with copies both sides count every copy. A word that
    mostly precedes ordinary words so never speaks. An instance's score is 1 - prod(1 - confidence)
    over its patterns of `seeds` scored instances at least. Values that reach `confident` in the
    last round are returned. Everything is sums by key over (pattern, value) rows, combined before
    each shuffle.
    """
    rows = spans.select(F.explode(F.concat("base", "seed", "cand")).alias("s")).select(F.lower("s.value").alias("v"), F.col("s.before").alias("p"), F.nullif("s.kind", F.lit("")).alias("kind"))
    edges = rows.where("p <> ''").groupBy("p", "v").agg(F.min("kind").alias("kind"), F.count(F.when(F.col("kind").isNull(), 1)).alias("free"), F.count("kind").alias("taken"))
    # a value that is a candidate where it is a seed too counts once a place
    edges = edges.select("p", "v", "kind", F.greatest("free", "taken").alias("n"))
    able = edges.groupBy("p").agg(F.count(F.lit(1)).alias("values"), F.count("kind").alias("seeded"), F.sum("n").alias("own")).where(F.col("values") >= seeds)
    words = texts.select(F.explode(F.split(F.lower("t"), r"\s+")).alias("p"))
    # counted before the join: a task sends a word once, however often it has it
    total = words.groupBy("p").agg(F.count(F.lit(1)).alias("total"))
    # a confident pattern has at least as many instances as its occurrences' share asks for; a word glued to its values never stands alone
    able = able.join(total, "p", "left").withColumn("total", F.greatest(F.coalesce("total", F.lit(0)), "own"))
    able = cut(able.where(F.col("own") >= F.col("total") * confident).select("p", "total"), "patterns")
    edges = cut(edges.join(able, "p"), "edges")
    base = edges.where("kind is not null").groupBy("v", "kind").agg(F.lit(1.0).alias("score"))
    score = base
    for _ in range(rounds):
        said = edges.select("p", "v", "n", "total").withColumnRenamed("n", "times").join(score, "v").groupBy("p", "kind").agg((F.sum(F.col("score") * F.col("times")) / F.first("total")).alias("conf"), F.count(F.lit(1)).alias("n"))
        said = said.where((F.col("n") >= seeds) & (F.col("conf") > 0)).select("p", "kind", F.least("conf", F.lit(1 - 1e-9)).alias("conf"))
        new = edges.where("kind is null").select("p", "v").join(said, "p").groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        score = cut(base.unionByName(new), "scores")
    new = score.join(base.select("v").distinct(), "v", "left_anti").where(F.col("score") >= confident)
    return new.groupBy("v").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))


@stowed("text")
def scan(docs: DataFrame, text: str = "text", seeds: int = SEEDS, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """docs without its text, with `base` and `spans`: arrays of (kind, start, end), by kind as listed, then start.

    `spans` holds the base spans, and secrets and what contexts discover where no base span lies. Null
    texts are empty: no spans. Repeated rows are rows of their own; columns named like the
    results are replaced. Texts of any length are searched whole.
    """
    keep = [c for c in docs.columns if c not in ("base", "spans", text)]
    t = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), base_spans(t).alias("base"), secrets(t).alias("seed"), candidates(t).alias("cand"))
    held = cut(held, "pii")  # row numbers hold from here on
    values = discover(held, docs.select(t.alias("t")), seeds, confident, rounds)
    cand = held.select("_row", F.explode("cand").alias("s")).withColumn("v", F.lower("s.value"))
    more = cand.join(values, "v").groupBy("_row").agg(F.collect_list(F.struct("kind", "s.start", "s.end")).alias("more"))
    out = held.join(more, "_row", "left")
    slim = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = lambda s: F.array_position(F.array(*[F.lit(k) for k in (*KINDS, SECRET)]), s["kind"])
    beyond = F.concat(slim(F.col("seed")), F.filter(F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda m: ~F.exists("seed", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))
    free = F.filter(beyond, lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    every = F.array_sort(F.transform(F.concat(slim(F.col("base")), free), lambda s: F.struct(order(s).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return out.select(*keep, slim(F.col("base")).alias("base"), slim(F.array_distinct(every)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
