import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from duskwatch.llm import periodic, queries
from duskwatch.llm.common import table


def plain_runs(words, periods=4, least=6):
    """Every period, from the first word on."""
    found, n = {}, len(words)
    for period in range(1, n // periods + 1):
        k = 0
        while k + period < n:
            start = k
            while k + period < n and words[k] == words[k + period]:
                k += 1
            length = k + period - start
            if k > start and length >= max(least, periods * period):
                found.setdefault((start, length), period)
            k += k == start
    return sorted((start, length, period) for (start, length), period in found.items())


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    dropped = {i for start, length, period in runs for i in range(start + period, start + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)))


words = st.lists(st.integers(0, 2), max_size=70)


@settings(max_examples=300, deadline=None)
@given(words, st.integers(1, 9), st.integers(0, 40), words)
def test_runs_are_all_runs(before, period, length, after):
    text = before + (before[:period] or [7]) * (length // period + 1) + after
    texts = [[b"%d" % w for w in t] for t in (text, before, [], after + after + after + after)]
    assert periodic.runs_of_words(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(words, st.integers(1, 6), st.lists(st.integers(1, 30), min_size=1, max_size=12))
def test_words_appended_in_pieces(text, times, pieces):
    text, catchers, at = text[:12] * times + text, periodic.Catchers(), 0
    for size in pieces * 20:
        catchers.append(np.array(text[at : at + size], dtype=np.int64))
        at = min(at + size, len(text))
        assert [tuple(r) for r in catchers.runs().tolist()] == plain_runs(text[:at])


def test_equal_fingerprints_of_other_words(monkeypatch):
    monkeypatch.setattr(periodic, "_mixed", lambda left, right: np.zeros_like(left))
    text = [b"%d" % (k * k % 11 if k % 50 < 25 else k % 3) for k in range(300)]
    assert periodic.runs_of_words([text]) == [plain_runs(text)]


def test_edges(spark, edges, edge_rows, nothing):
    def full(r):
        return r[0], r[1], [tuple(x) for x in r[2]], r[3]

    got = sorted((full(r) for r in periodic.periodic_runs(edges).collect()), key=repr)
    expected = []
    for doc_id, text, *_ in edge_rows:
        listed = [w for w in (text or "").encode().split()]
        found = [(0, 120_000, 2 * 977 * 13)] if doc_id == 6 else []
        kept = listed[: 2 * 977 * 13] if doc_id == 6 else listed
        expected.append((doc_id, len(listed), found, b" ".join(kept).decode()))
    assert got == sorted(expected, key=repr)
    assert periodic.periodic_runs(nothing).count() == 0
    long = spark.createDataFrame([(1, "x " * 300_000), (2, "a b c " * 50_000 + "d"), (3, "b a a a a a a")], "doc_id long, text string")
    runs = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(long).collect()}
    assert runs == {1: ([(0, 300_000, 1)], "x"), 2: ([(0, 150_000, 3)], "a b c d"), 3: ([(1, 6, 1)], "b a")}


def test_op13_query(spark, small):
    rows = table(spark, small, "documents").select("doc_id", "text").collect()
    expected = sorted(plain_row(*r) for r in rows)
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, small).collect())
    assert got == expected and any(r[1] for r in got)


def test_op13_query_edges(spark, edges, edge_rows, tmp_path):
    edges.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert [r for r in got if r[0] != 6] == sorted((plain_row(i, t) for i, t, *_ in edge_rows if i != 6), key=repr)
    g, n = zlib.crc32(b"6") // 10, 120_000  # the remainder by 10 is 0
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    assert [r[1:6] for r in got if r[0] == 6] == [(1, a, n - a, p, 1000 * (n - a) // p)]
