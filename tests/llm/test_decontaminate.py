import re

from duskwatch.llm import decontaminate, queries
from duskwatch.llm.common import table


def plain_words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def plain_runs(words, n):
    return {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


def plain(docs, items, threshold=0.8):
    asked = [(item, plain_words(question)) for item, question in items]
    asked = [(item, min(5, len(w)), plain_runs(w, min(5, len(w)))) for item, w in asked if w]
    out = []
    for doc, text in docs:
        words = plain_words(text)
        held = {n: plain_runs(words, n) for n in {n for _, n, _ in asked}}
        for item, n, want in asked:
            if len(want & held[n]) >= threshold * len(want) - 1e-9:
                out.append((doc, item, len(want & held[n]), len(want)))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r)[:4] for r in frame.collect()), key=repr)


def words(start, count):
    return " ".join(f"w{k}" for k in range(start, start + count))


def test_against_plain(spark):
    items = [(1, words(0, 30)), (2, words(100, 9)), (2, words(100, 9)), (None, words(200, 40)), (4, "Tiny item"), (5, None), (6, "... !"), (7, ""), (8, words(300, 5))]
    docs = [(k, f"{words(1000 + 50 * k, 200)} {words(0, 30 - k)} {words(5000, 300)}") for k in range(12)]  # ever less of item 1
    docs += [(20, words(100, 9).upper().replace(" ", ",\n")), (21, f"{words(200, 20)} x {words(220, 20)}"), (22, "tiny ITEM!"), (23, "a tiny item"), (23, "tiny"), (27, "item"), (28, "tiny, items"), (24, None), (25, ""), (None, words(300, 5)), (26, words(300, 4)), (26, words(300, 5))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert want and got(decontaminate.contained(d, b)) == want
    assert got(decontaminate.contained(d, b, most_chars=60)) == want  # many blocks
    hit = {r[0] for r in want}
    assert sorted(map(repr, (r["doc_id"] for r in decontaminate.clean(d, b, most_chars=200).collect()))) == sorted(repr(i) for i, t in docs if not plain([(i, t)], items))
    assert None in hit


def test_sketch_never_misses():
    for size in range(1, 400):
        # A document may miss a fifth of the shingles; one of the sketch must be left.
        assert decontaminate.sketch_length(size, 0.8) > size - -(-8 * size // 10)


def test_short_items_inside_long_documents(spark):
    docs = [(1, f"{words(0, 500)} tiny ITEM, and {words(0, 20)}"), (2, "tiny"), (3, f"item {words(0, 9)} tiny"), (4, "one two. Three four!"), (5, "one two three"), (6, "four"), (7, f"tiny item {words(0, 5)} tiny item")]
    items = [(1, "Tiny item"), (2, "one two three four"), (3, "... !"), (4, None), (5, words(0, 5)), (6, "tiny item"), (7, "four")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert {w[:2] for w in want} == {(1, 1), (1, 6), (1, 5), (3, 5), (4, 2), (4, 7), (6, 7), (7, 1), (7, 5), (7, 6)}
    for most in (10, 16_000_000):
        assert got(decontaminate.contained(d, b, most_chars=most)) == want
        assert sorted(r["doc_id"] for r in decontaminate.clean(d, b, most_chars=most).collect()) == [2, 5]


def test_edges(spark, edges, edge_rows, nothing):
    b = spark.createDataFrame([(1, "one two three four five six"), (2, "one"), (None, None)], "item_id long, text string")
    want = plain([r[:2] for r in edge_rows], [(1, "one two three four five six"), (2, "one")])
    assert got(decontaminate.contained(edges, b)) == want
    left = decontaminate.clean(edges, b)
    assert left.columns == edges.columns and left.count() == sum(not plain([r[:2]], [(1, "one two three four five six"), (2, "one")]) for r in edge_rows)
    assert decontaminate.contained(nothing, b).count() == 0 and decontaminate.clean(nothing, b).count() == 0
    assert decontaminate.contained(edges, b.limit(0)).count() == 0 and decontaminate.clean(edges, b.limit(0)).count() == len(edge_rows)


def test_op7_query(spark, small):
    docs = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, small, "benchmark").select("item_id", "text").collect()]
    assert got(queries.op7_decontamination(spark, small)) == plain(docs, items)
