"""Audit of how sources of a language differ in their terms, on hash-consed segment trees.

The kept terms of a language are dealt into blocks. In a block the terms have ids in UTF-8 order, and the counts of a group
(a language's source, or the language itself) are the leaves of a segment tree over these ids. Nodes are hash-consed, level by
level: a node is known by its two children, so equal subtrees of any groups are one node, all of them zero for instance.
Two trees are walked at the same time from their roots; every pair of nodes is followed once, however often it occurs, and its
price is the sum (or the greatest) of its leaves' prices.

Everything is exact: shares of a count are whole thousand millionths, and prices are whole numbers below 2^31.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import arrow_map, texts_of, write_once

SCALE = 1_000_000_000
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_PAD = -1  # count of a leaf beyond the last term; its price is 0


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A to Z in lower case, of a UTF-8 text."""
    return text.translate(_LETTERS).split()


def term_counts(documents: DataFrame, held: int = 200_000) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), counted in each task before anything is shuffled.

    A task sends on what it has counted when that is more than ``held`` terms of its groups.
    """

    def batch_of(groups: dict) -> pa.RecordBatch:
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (seen, docs) in groups.items() for term, n in seen.items()]
        lang, source, term, n, d = zip(*rows) if rows else ((),) * 5
        text = pa.array(term, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), text, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for first, last, texts in texts_of(batch, 2):
                langs, sources = (batch.column(k).slice(first, last - first).to_pylist() for k in (0, 1))
                for lang, source, text in zip(langs, sources, texts):
                    words = terms(text)
                    seen, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                    seen.update(words)
                    docs.update(set(words))
                if sum(len(seen) for seen, _ in groups.values()) > held:
                    yield batch_of(groups)
                    groups = {}
        if groups:
            yield batch_of(groups)

    rows = documents.select(_key("lang").alias("lang"), _key("source").alias("source"), _key("text").cast("binary").alias("_text"))
    partial = arrow_map(rows, run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class Trees:
    """Hash-consed segment trees of the rows of a table of counts, whose width is a power of two."""

    def __init__(self, counts: np.ndarray):
        self.width = counts.shape[1]
        self.counts, node = np.unique(counts, return_inverse=True)
        node = node.reshape(counts.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []  # of every node, level by level from the leaves
        many = len(self.counts)
        while node.shape[1] > 1:
            pairs, found = np.unique(node[:, ::2] * many + node[:, 1::2], return_inverse=True)
            self.children.append((pairs // many, pairs % many))
            node, many = found.reshape(len(node), -1), len(pairs)
        self.roots = node[:, 0]

    def walk(self, a: int, b: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Simultaneous traversal of the trees of rows ``a`` and ``b``.

        Returns for every level from the root down the places of each node pair's left and right child pair in the next
        level, and the leaf nodes of both trees; a pair of nodes is there once.
        """
        left, right, steps = np.array([self.roots[a]]), np.array([self.roots[b]]), []
        for lower, upper in reversed(self.children):
            many = len(self.counts) + sum(len(c[0]) for c in self.children)
            both = np.concatenate([lower[left] * many + lower[right], upper[left] * many + upper[right]])
            pairs, place = np.unique(both, return_inverse=True)
            steps.append((place[: len(left)], place[len(left) :]))
            left, right = pairs // many, pairs % many
        return steps, left, right


def priced(steps: list[tuple[np.ndarray, np.ndarray]], leaves: np.ndarray, combine=np.add) -> list[np.ndarray]:
    """Prices of all node pairs of a walk, level by level from the root down."""
    levels = [leaves]
    for low, high in reversed(steps):
        levels.append(combine(levels[-1][low], levels[-1][high]))
    return levels[::-1]


def largest(steps: list[tuple[np.ndarray, np.ndarray]], levels: list[np.ndarray], wanted: int) -> list[tuple[int, int]]:
    """(price, term id) of the ``wanted`` greatest positive leaves, equal ones by id; levels hold the greatest prices."""
    heap, found = [(-int(levels[0][0]), 0, 0, 0)], []
    while heap and len(found) < wanted:
        price, at, level, node = heapq.heappop(heap)
        if price >= 0:
            break
        if level == len(steps):
            found.append((-price, at))
            continue
        half = 1 << (len(steps) - level - 1)
        for place, child in ((at, steps[level][0][node]), (at + half, steps[level][1][node])):
            heapq.heappush(heap, (-int(levels[level + 1][child]), place, level + 1, int(child)))
    return found


def share(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)) of each count, exact; 0 for padding."""
    return np.array([0 if c == _PAD else 1 + SCALE * (c + 2) // (total + 2 * kept) for c in counts.tolist()], dtype=np.int64)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    both = p + q
    return np.where(both > 0, (p - q) ** 2 // np.maximum(both, 1), 0)


def _block(rows: pd.DataFrame, top: int) -> pd.DataFrame:
    """Prices of one block and one pair of tiles: rows without a term name the groups, the others hold their counts."""
    groups = rows[rows["term"].isna()].sort_values("source").reset_index(drop=True)
    cells = rows[rows["term"].notna()]
    kept, size, low, high, lang_total = (int(groups[c].iloc[0]) for c in ("kept", "block_terms", "low", "high", "lang_total"))
    names = sorted(set(cells["term"]), key=str.encode)
    width = 1 << max(0, (max(size, 1) - 1).bit_length())
    counts = np.zeros((len(groups) + 1, width), dtype=np.int64)
    counts[:, size:] = _PAD
    place, row = {t: k for k, t in enumerate(names)}, {s: k for k, s in enumerate(groups["source"])}
    at = cells["term"].map(place).to_numpy(dtype=np.int64)
    counts[cells["source"].map(row).to_numpy(dtype=np.int64), at] = cells["n"]
    counts[-1, at] = cells["lang_n"]
    trees = Trees(counts)
    shares = [share(trees.counts, n, kept) for n in [*groups["total"].tolist(), lang_total]] if kept else []
    found = []
    for a, b in ((a, b) for a in range(len(groups)) for b in range(a)):
        if low != high and groups["tile"][a] == groups["tile"][b]:
            continue
        value = 0
        if kept:
            steps, left, right = trees.walk(a, b)
            value = int(priced(steps, _distance(shares[a][left], shares[b][right]))[0][0])
        found += [(groups["source"][x], "pair", groups["source"][y], value) for x, y in ((a, b), (b, a))]
    for a in range(len(groups)) if low == high and kept else ():
        steps, left, right = trees.walk(a, len(groups))
        p, q = shares[a][left], shares[-1][right]
        wanted = (trees.counts[left] > 0) & (p > q)
        levels = priced(steps, np.where(wanted, _distance(p, q), -1) + 1, np.maximum)
        found += [(groups["source"][a], "term", names[k], value - 1) for value, k in largest(steps, levels, top)]
    out = pd.DataFrame(found, columns=["source", "part", "item", "value"])
    out.insert(0, "lang", groups["lang"].iloc[0])
    return out


def audit(documents: DataFrame, least_docs: int = 10, top: int = 10, block: int = 4096, tile: int = 64) -> DataFrame:
    """How far each source of a language is from the others, and its most outstanding terms.

    lang, source, part, item, value, rank. Part ``pair``: each other source of the language with the summed distance of the
    shares of all kept terms (those in at least ``least_docs`` documents of the language). Part ``term``: up to ``top`` terms
    whose share is above the language's. Null text, lang and source are ''; ids and other columns are not looked at, repeated
    rows count each. A language without a kept term has pairs of value 0 and no terms; an empty table gives no row; a language
    with one source has no pairs.

    Counts are made in each task and shuffled by group and term, so a hot source is as many rows as it has terms. Blocks of
    about ``block`` terms and pairs of tiles of about ``tile`` sources bound what one task holds, and the pairs are as many as
    the result has.
    """
    counts = write_once(term_counts(documents), "term-counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    vocabulary = write_once(vocabulary.select("lang", "term", "lang_n"), "kept-terms")
    cells = write_once(counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")

    groups = documents.select(_key("lang").alias("lang"), _key("source").alias("source")).distinct()
    groups = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = write_once(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    languages = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("total").alias("lang_total"))
    languages = languages.join(vocabulary.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    languages = languages.withColumn("kept", F.coalesce("kept", F.lit(0)))
    languages = languages.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / block))).withColumn("tiles", F.ceil(F.col("sources") / tile))
    languages = write_once(languages, "languages")

    block_of = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    tile_of = F.pmod(F.xxhash64("source"), F.col("tiles"))
    sizes = vocabulary.join(languages, "lang").select("lang", block_of).groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    blocks = languages.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    blocks = blocks.join(sizes, ["lang", "block"], "left").withColumn("block_terms", F.coalesce("block_terms", F.lit(0)))

    def in_tiles(rows: DataFrame) -> DataFrame:
        """A row for every pair of tiles that holds the row's source."""
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
        rows = rows.withColumn("tile", tile_of).select("*", other)
        return rows.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))

    heads = in_tiles(groups.join(blocks, "lang"))
    heads = heads.select("lang", "block", "low", "high", "tile", "source", "total", "lang_total", "kept", "block_terms", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("lang_n"))
    body = in_tiles(cells.join(languages, "lang").select("lang", block_of, "tiles", "source", "term", "n", "lang_n"))
    body = body.select("lang", "block", "low", "high", "tile", "source", "term", "n", "lang_n")
    whole = heads.unionByName(body, allowMissingColumns=True)
    prices = whole.groupBy("lang", "block", "low", "high").applyInPandas(lambda rows: _block(rows, top), "lang string, source string, part string, item string, value long")
    prices = write_once(prices, "prices")

    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = prices.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    outstanding = prices.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(outstanding)
