import re
import zlib

import numpy as np
import pytest

from duskwatch.llm import qda, queries, rules
from duskwatch.llm.common import labelled_sample, table
from duskwatch.llm.textstats import COUNTS, MORE, counts_of


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, r in enumerate(runs) if runs.count(r) > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


@pytest.mark.parametrize("text", [None, "", " \n", "a b c a b c", "a a a a", "x\nx\n\n \ny\nx ", "ü|ü #* 　 \x1c\x85", "a b c d a b c", "one\r\none\r\n"])
def test_counts(text):
    assert counts_of(text)[:5] == plain_counts(text)


def test_counts_of_table(spark, small):
    for (text,) in table(spark, small, "documents").select("text").limit(60).collect():
        if len(text or "") < 20_000:
            assert counts_of(text, more=False) == plain_counts(text)


def test_list_learns_and_prunes():
    random = np.random.default_rng(1)
    size = 4000
    x, y, z = random.random(size), random.random(size), random.random(size)
    bad = ((x > 0.8) & (y > 0.5)) | (z < 0.05)
    found = rules.learn({"words": x, "word_length": y, "symbol_share": z}, bad)
    hit = np.zeros(size, dtype=bool)
    for rule in found.rules:
        hit |= rule.covers({"words": x, "word_length": y, "symbol_share": z})
    assert (hit == bad).mean() > 0.98 and 2 <= len(found.rules) <= 8
    assert rules.learn({"words": x}, random.random(size) < 0.3).rules == []  # nothing to learn
    assert rules.learn({"words": x}, np.zeros(size, dtype=bool)).rules == []
    assert rules.learn({"words": x[:0]}, np.zeros(0, dtype=bool)).rules == []


def test_rules_edges(spark, edges, edge_rows, nothing):
    decide = rules.DecisionList([rules.Rule([("words", True, 1000.0), ("distinct_share", False, 0.5)])])
    got = rules.verdicts(edges, decide).collect()
    want = {(r[0], *plain_counts(r[1])[:4]) for r in edge_rows if len(r[1] or "") < 1000}
    assert {tuple(r)[:5] for r in got if r["n_words"] < 1000} == want and len(got) == len(edge_rows)
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    stay = rules.keep(edges, rules.DecisionList([]))
    assert stay.columns == edges.columns and stay.count() == sum(r["kept"] for r in rules.verdicts(edges, rules.DecisionList([])).collect())
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.verdicts(nothing, rules.fit(nothing, empty)).count() == 0 and rules.keep(nothing, decide).count() == 0


def test_op4_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op4_quality_rules(spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    assert list(next(iter(got.values())).asDict()) == ["doc_id", *COUNTS, "base_failed", "kept"]
    for r in got.values():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    unseen = [(got[i]["kept"], q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0 and not got[i]["base_failed"]]
    assert np.mean([k == (q == 1) for k, q in unseen]) > 0.97


def test_discriminant_against_densities():
    random = np.random.default_rng(2)
    a, b = random.normal(size=(500, 3)), random.normal(size=(400, 3)) @ np.array([[2, 0.5, 0], [0, 1, 0], [0, 0, 0.3]]) + 1
    x, good = np.concatenate([a, b]), np.arange(900) >= 500
    model = qda.learn(x, good, to_pooled=0.0, to_unit=0.0)
    z = (x - x.mean(axis=0)) / x.std(axis=0)

    def density(part):
        mean, cov = part.mean(axis=0), np.cov(part.T)
        d = z - mean
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]

    assert np.allclose(model.difference(x), density(z[good]) - density(z[~good]))
    assert ((model.score(x) > 0.5) == good).mean() > 0.85
    assert np.all(qda.learn(x[:0], good[:0]).score(x) == 0.5)
    assert np.all(qda.learn(x, np.ones(900, dtype=bool)).score(x) > 0.9)
    assert np.isfinite(qda.learn(np.ones((5, 3)), np.arange(5) > 3).score(np.ones((2, 3)))).all()


def test_qda_edges(spark, edges, edge_rows, nothing):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, None), (4, None, None), (6, 0, 1), (6, 1, 0), (8, 1, 0), (5, 7, 0)], empty.schema)
    for labels in (empty, odd):
        model = qda.fit(edges, labels)
        got = qda.scores(edges, model).collect()
        assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
        assert qda.keep(edges, model).columns == edges.columns
        assert qda.scores(nothing, model).count() == 0 and qda.keep(nothing, model).count() == 0


def test_op9_query(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op9_quality_classifier(spark, folder).collect()}
    assert len(got) == table(spark, folder, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    unseen = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in table(spark, folder, "labels").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in unseen]) > 0.95


def test_features_are_finite():
    counts = np.array([counts_of(t) for t in (None, "", "a", "A! " * 500, "1 2 3\n" * 40)])
    assert counts.shape[1] == len(COUNTS + MORE) and np.isfinite(qda.transform(counts)).all()


def test_sample_has_one_row_for_each_id(spark):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = [(k, f"text {k} {j}") for k in range(40) for j in range(100 if k == 4 else 3 if k % 3 == 0 else 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    first, again = (sorted(map(tuple, labelled_sample(documents.repartition(n), labels, "toxic", 20).collect())) for n in (2, 7))
    assert first == again and len(first) == len({r[0] for r in first}) == 20
    assert all((i, t) in rows and label == i % 2 for i, t, label in first)
    assert len(labelled_sample(documents, labels, "toxic", 1_000).collect()) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(40))
