import corpus_pipeline
import pytest

from duskwatch.llm import decontaminate, packing, qda, rules, simhash
from duskwatch.llm.common import table
from duskwatch.llm.textstats import counts_of

from .plain import plain_groups


def test_stages_against_plain(spark, small):
    """Every stage on what its predecessor kept, held against single-machine code with the same fitted models."""
    docs = table(spark, small, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = table(spark, small, "labels")
    decide, model = rules.fit(docs, labels), qda.fit(docs, labels)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "SimHash near-dedup", "benchmark decontamination", "packing"]
    verdict = {r["doc_id"]: r["kept"] for r in rules.verdicts(docs, decide).collect()}
    kept = [i for i in rows if verdict[i]]
    for i in kept:
        n = counts_of(rows[i]["text"])
        assert n[0] >= 50 and 2 * n[4] <= n[0]
    expected = [kept]
    kept = [i for i in kept if model.score(qda._features([rows[i]["text"]]))[0] >= 0.3]
    expected.append(kept)
    groups = plain_groups([simhash.fingerprint(rows[i]["text"]) for i in kept])
    kept = [min(i for i, h in zip(kept, groups) if h == g) for g in dict.fromkeys(groups)]
    expected.append(kept)
    block = decontaminate.Block.of([tuple(r) for r in table(spark, small, "benchmark").select("item_id", "text").collect()], 5, 0.8)
    kept = [i for i, found in zip(kept, decontaminate.matches([rows[i]["text"] for i in kept], block, 5, 0.8)) if not found]
    expected.append(kept)
    current = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected):
        current = corpus_pipeline.write_once(stage(spark, current, small), "test")
        assert current.columns == docs.columns, name
        assert sorted(r["doc_id"] for r in current.collect()) == sorted(want), name
        assert all(r == rows[r["doc_id"]] for r in current.collect())
    pieces = corpus_pipeline.run(spark, small).collect()
    assert sorted({p["doc_id"] for p in pieces}) == sorted(expected[-1])
    for i in expected[-1]:
        own = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == i)
        assert [n for _, n in own] == packing.lengths(sum(n for _, n in own), 2048)


@pytest.mark.parametrize("which", ["edges", "nothing"])
def test_stages_with_edges(request, spark, small, which):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, small)
        assert name == "packing" or left.columns == docs.columns
        assert left.count() >= 0
