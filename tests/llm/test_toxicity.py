import random
import zlib

import numpy as np

from duskwatch.llm import queries, toxicity
from duskwatch.llm.common import table


def plain_segments(scores, first=0):
    """By definition: the best segment, then the same on both sides of it; the shortest of equals."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] or (total == best[2] and b - a < best[1] - best[0] - 1)):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, total = best
    return plain_segments(scores[:a], first) + [(first + a, first + b, total)] + plain_segments(scores[b:], first + b)


def test_maximal_segments():
    dice = random.Random(4)
    for _ in range(400):
        scores = [dice.choice([-3, -2, -1, 1, 2, 4]) + dice.random() / 7 for _ in range(dice.randint(0, 25))]
        got = toxicity.maximal_segments([(k, k + 1, s) for k, s in enumerate(scores)])
        want = plain_segments(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_runs_change_nothing():
    model = toxicity.Model({b"bad": 2.0, b"worse": 3.5}, -0.25, 1.0, 0.01, 1.0, 1.0, 0.0)
    words = b"a bad b c worse d e f g h i j k l m n o p q bad".split()
    scores = [model.words.get(w, model.other) for w in words]
    assert model.segments(words) == toxicity.maximal_segments([(k, k + 1, s) for k, s in enumerate(scores)])
    assert model.score("a bad worse") > model.score("a b c") == model.score("") == model.score(None)


def test_edges(spark, edges, edge_rows, nothing):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (4, 1, None), (6, 0, 1), (6, 1, 0), (8, 1, 1), (5, 1, 0), (3, 1, 0)], empty.schema)
    for labels in (empty, odd):
        model = toxicity.fit(edges, labels)
        got = toxicity.scores(edges, model).collect()
        assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        assert toxicity.scores(nothing, model).count() == 0 and toxicity.passages(nothing, model).count() == 0


def test_only_copies_are_collapsed(spark, monkeypatch):
    used = []
    monkeypatch.setattr(toxicity, "logistic", lambda x, y: used.append(len(y)) or (1.0, 0.0))
    passage = " ".join(f"passage{k}" for k in range(60))
    own = lambda k, n: " ".join(f"own{k}x{j}" for j in range(n))
    texts = [f"{passage} {own(k, 90)}" for k in range(100)]  # share a passage, Jaccard 0.25
    copies = [own("copy", 200) + (f" end{k}" if k % 2 else "") for k in range(100)]
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5][:200]
    documents = spark.createDataFrame(list(zip(ids, texts + copies)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    toxicity.fit(documents, labels)
    assert used == [102]


def test_op3_query(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, folder).collect()}
    assert len(got) == table(spark, folder, "documents").count()
    unseen = [(got[r["doc_id"]], r["toxic"]) for r in table(spark, folder, "labels").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == t for r, t in unseen]) > 0.93
    toxic, clean = ([r for r, t in unseen if t == label] for label in (1, 0))
    assert np.mean([r["predicted"] for r in toxic]) > 0.9 and np.mean([r["predicted"] for r in clean]) < 0.02
    above = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in toxic for b in clean]
    assert np.mean(above) > 0.93
