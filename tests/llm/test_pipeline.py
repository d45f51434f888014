"""The pipeline, stage by stage, against what each stage is to do with its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination, mixing, toxicity
from quern.llm.common import table

from .conftest import SF, bag, prose, write
from .test_operators import jaccard

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """Clean documents, exact and near copies, documents with a benchmark passage, and labelled toxic ones."""
    passage = " ".join(prose(40, 4000).split()[5:25])
    clean = [(k, prose(150, k)) for k in range(120)]
    copies = [(1000 + k, clean[k][1]) for k in range(20)] + [(1100 + k, clean[k][1].replace(clean[k][1].split()[75], "changed")) for k in range(20, 40)]
    leaks = [(1200 + k, f"{prose(60, 5000 + k)} {passage} {prose(60, 6000 + k)}") for k in range(10)]
    toxic = [(1300 + k, f"{prose(50, 7000 + k)} scumword viletalk hatenoun {prose(50, 8000 + k)}") for k in range(60)]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t)) for i, t in [*clean, *copies, *leaks, *toxic]]
    labels = [(i, 1, int(1300 <= i)) for i, *_ in rows]
    return write(tmp_path_factory.mktemp("planted"), rows, benchmark=[(7, prose(40, 4000))], labels=labels)


def test_stages_keep_the_clean_and_drop_the_planted(spark, planted):
    docs, seen = table(spark, planted, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, planted), name)
        seen[name] = docs
        assert docs.columns == COLUMNS + (["shard", "slot"] if name == "sharding" else [])
    ids = {n: sorted(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in seen.items()}
    assert [i for i in ids["toxicity"] if i >= 1300] == [] and len([i for i in ids["toxicity"] if i < 1300]) == 170
    assert ids["simhash"] == [*range(120), *range(1200, 1210)]
    assert ids["decontamination"] == list(range(120))
    assert set(ids["mixing"]) <= set(range(120)) and max(Counter(ids["mixing"]).values()) <= 2
    assert ids["sharding"] == ids["mixing"]
    shards = Counter(r["shard"] for r in seen["sharding"].collect())
    assert max(shards.values()) - min(shards.get(k, 0) for k in range(16)) <= 1


def test_stages_on_a_real_table(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    first = corpus_pipeline.cut(corpus_pipeline.STAGES[0][1](spark, docs, SF), "a")
    want = toxicity.scored(docs, model, name="p").where("p < 0.5").drop("p")
    assert bag(first.collect(), *COLUMNS) == bag(want.collect(), *COLUMNS)
    second = corpus_pipeline.cut(corpus_pipeline.STAGES[1][1](spark, first, SF), "b")
    kept = {r["doc_id"]: r["text"] for r in second.collect()}
    for r in first.collect():
        if r["doc_id"] not in kept:  # each that goes leaves a near copy behind
            assert max((jaccard(r["text"] or "", t or "") for t in kept.values()), default=0) > 0.5
    texts = list(kept.values())
    assert not any(jaccard(a, b) >= 0.9 for k, a in enumerate(texts) for b in texts[:k] if a and b)
    third = corpus_pipeline.cut(corpus_pipeline.STAGES[2][1](spark, second, SF), "c")
    hit = decontamination.find_items(second, table(spark, SF, "benchmark")).where(F.size("hit_spans") > 0).count()
    assert third.count() == second.count() - hit and hit > 0
    fourth = corpus_pipeline.STAGES[3][1](spark, third, SF)
    taken = mixing.with_copies(third).agg(F.sum("_copies").alias("n")).first()["n"]
    assert fourth.count() == taken


def test_pipeline_of_odd_and_empty_tables(spark, small, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    out = corpus_pipeline.run(spark, small)
    assert out.columns == [*COLUMNS, "shard", "slot"] and out.count() > 0
    assert bag(out.collect(), *out.columns) == bag(corpus_pipeline.run(spark, small).collect(), *out.columns)
