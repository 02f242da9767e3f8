import random
import re

import numpy as np
import pytest
import xxhash

from duskwatch.llm import queries, simhash
from duskwatch.llm.common import table
from duskwatch.llm.components import components

from .plain import plain_groups


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", "A", "a b", "A b C", "Ä b c d", "x " * 700 + "y", "a\x1cb c　d e f g"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def near(dice, base, bits):
    for b in dice.sample(range(64), bits):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_distances(radius):
    dice = random.Random(radius)
    base = dice.getrandbits(64)
    values = np.array([near(dice, base, dice.randint(0, 9)) for _ in range(300)] + [dice.getrandbits(64) for _ in range(100)], dtype=np.uint64)
    other = values ^ np.uint64(base)
    assert (simhash.close_pairs(other, radius, block=64) == (np.bitwise_count(other) <= radius)).all()
    found = dict(simhash.block_matches(values[:70], values, radius, rows=16))
    for k in range(70):
        assert found.get(k, np.array([], dtype=int)).tolist() == np.flatnonzero(np.bitwise_count(values ^ values[k]) <= radius).tolist()


@pytest.mark.parametrize("cell", [2048, 7])
def test_links_span_every_group(spark, cell):
    dice = random.Random(5)
    prints = []
    for _ in range(12):
        chain = [dice.getrandbits(64)]
        for _ in range(dice.randint(0, 60)):
            chain.append(near(dice, dice.choice(chain[-8:]), dice.randint(1, 4)))
        prints += chain
    prints = sorted({*prints, 0, (1 << 64) - 1, 7})
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fingerprint long"), cell=cell).collect()
    assert all((np.uint64(np.int64(r["u"])) ^ np.uint64(np.int64(r["v"]))).bit_count() <= 3 for r in links)
    place = {s[0]: k for k, s in enumerate(signed)}
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for r in links:
        root[find(place[r["u"]])] = find(place[r["v"]])
    want = plain_groups(prints)
    got = [find(k) for k in range(len(prints))]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 50)] + [(100, 101), (101, 100), (5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*chain, *star, (-7, 300)], "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)} | {-7: -7, 300: -7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edges(spark, edges, edge_rows, nothing):
    prints = [plain_fingerprint(r[1]) if len(r[1] or "") < 1000 else simhash.fingerprint(r[1]) for r in edge_rows]
    groups = plain_groups(prints)
    least = {g: min((r[0] for r, h in zip(edge_rows, groups) if h == g and r[0] is not None), default=None) for g in groups}
    want = sorted((repr(r[0]), f"{p:016x}", repr(least[g])) for r, p, g in zip(edge_rows, prints, groups))
    assert sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in simhash.classes(edges).collect()) == want
    stay = simhash.keep_one(edges)
    assert stay.columns == edges.columns
    assert sorted(map(repr, (r["doc_id"] for r in stay.collect()))) == sorted(map(repr, least.values()))
    assert simhash.classes(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_op6_query(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in docs]
    groups = plain_groups(prints)
    least = {g: min(r["doc_id"] for r, h in zip(docs, groups) if h == g) for g in groups}
    assert {tuple(r) for r in queries.op6_simhash(spark, small).collect()} == {(r["doc_id"], f"{p:016x}", least[g]) for r, p, g in zip(docs, prints, groups)}
