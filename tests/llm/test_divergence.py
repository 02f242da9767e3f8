import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from duskwatch.llm import divergence, queries

COLUMNS = "doc_id long, text string, lang string, source string, value string, term long, rank int"


def plain(rows, least_docs=10, top=10):
    """Sums over all terms, without blocks or trees."""
    docs = [(lang or "", source or "", divergence.terms((text or "").encode())) for text, lang, source in rows]
    found = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        often = Counter(t for _, _, w in here for t in set(w))
        kept = {t for t, n in often.items() if n >= least_docs}
        counts = {s: Counter(t for _, x, w in here if x == s for t in w if t in kept) for s in {d[1] for d in here}}
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s, c in counts.items():
            pairs = [(-sum(f(share(c, t), share(o, t)) for t in kept), x.encode()) for x, o in counts.items() if x != s]
            found += [(lang, s, "pair", x.decode(), -v, k) for k, (v, x) in enumerate(sorted(pairs), 1)]
            best = [(-f(share(c, t), share(whole, t)), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            found += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(best)[:top], 1)]
    return sorted(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    found = [(None, None, None), ("", "xx", "lonely"), (" \n9 -", "de", "empty"), ("Ä" * 5, "de", "s1"), ("seldom words here", "fr", "s1"), ("x", "fr", None), ("Straße _a_b[c] `d` {e} A9Z É\x7fé\x00null", "de", "s2")]
    for k in range(400):
        words = [rng.choice(["Alpha", "beta", "gamma", "Ünder", "δ", "日本", "tail%s" % chr(97 + k % 26)]) for _ in range(rng.randrange(30))]
        found.append((" ".join(words), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "ß", "𝒮", None])))
    return found + found[-20:] + [("alpha " * 100_000, "en", "s2")]


@pytest.mark.parametrize("shape", [{}, {"block": 3, "tile": 2, "top": 4}, {"least_docs": 1}])
def test_audit(spark, rows, shape):
    documents = spark.createDataFrame([(None, *r, "v", 1, 2) for r in rows], COLUMNS).repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(documents, **shape).collect())
    assert got == plain(rows, shape.get("least_docs", 10), shape.get("top", 10))


def test_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], COLUMNS)).count() == 0


def test_counts_sent_on_early(spark, rows):
    documents = spark.createDataFrame([(None, *r, "v", 1, 2) for r in rows], COLUMNS).repartition(2)
    assert sorted(divergence.term_counts(documents, held=1).collect()) == sorted(divergence.term_counts(documents).collect())


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 64), dtype=np.int64)
    counts[1, 40] = counts[2, 40] = 5
    trees = divergence.Trees(counts)
    assert trees.roots[1] == trees.roots[2] != trees.roots[0]
    assert all(len(low) == 2 for low, _ in trees.children)  # all zero, or with the one count
    steps, left, right = trees.walk(0, 1)
    assert len(left) == 2 and [len(low) for low, _ in steps] == [1, 2, 2, 2, 2, 2]
    assert divergence.priced(steps, trees.counts[left] - trees.counts[right])[0][0] == -5


def test_exact_beyond_64_bits():
    counts = np.array([0, 10**15, divergence._PAD])
    assert divergence.share(counts, 10**15, 7).tolist() == [1 + 2 * 10**9 // (10**15 + 14), 1 + 10**9 * (10**15 + 2) // (10**15 + 14), 0]


def test_op11_query(spark, rows, tmp_path):
    spark.createDataFrame([(None, *r, "v", 1, 2) for r in rows], COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op11_divergence(spark, str(tmp_path)).collect())
    assert got == plain(rows)
    con = duckdb.connect()
    file = next((tmp_path / "documents.parquet").glob("part-*.parquet"))
    con.execute(f"create view documents as select * from '{file}'")
    assert sorted(con.execute(queries.ORACLES["op11_divergence"]).fetchall()) == got
