"""Benchmark decontamination: short test items found inside long documents.

An item and a document are compared by the share of the item's word shingles that the document holds. Items are
partitioned by size, in powers of two. Each partition has its own sketch length, floor((1 - threshold) * largest size) + 1,
and an item's sketch is that many of its smallest hash values (bottom-k MinHash). A document that holds at least
``threshold`` of an item's shingles misses too few of them to miss the whole sketch, so it is always a candidate, however
long it is; documents with fewer shingles than a partition's smallest item needs are no candidates for it. Candidates are
then verified by exact containment of the shingles themselves, not of their hashes. An item of fewer words than a shingle is one
run of that many words; documents are hashed at the lengths of such items too, and what agrees is compared word by word.

Items are taken in blocks of bounded size, each broadcast and held against all documents in one pass without a shuffle, so
neither a passage in very many documents nor a large benchmark piles up anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from duskwatch.llm.common import arrow_map, texts_of

_KEPT = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(128, 256))
_SPLIT = bytes(b if b in _KEPT else 32 for b in range(256))
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8; ASCII characters other than letters and digits part them."""
    return (text or "").lower().encode(errors="replace").translate(_SPLIT).split()


def hashes_of(words: list[bytes], shingle: int) -> np.ndarray:
    """Hash of every run of ``shingle`` words, repeats included."""
    codes = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words)) + np.uint64(1)
    size = max(0, len(words) - shingle + 1)
    total = np.zeros(size, dtype=np.uint64)
    for k in range(shingle):
        total += codes[k : k + size] * _STEPS[k % len(_STEPS)] * np.uint64(2 * (k // len(_STEPS)) + 1)
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def shingles_of(words: list[bytes], shingle: int) -> list[bytes]:
    """Every run of ``shingle`` words."""
    return [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)]


def sketch_length(size: int, threshold: float) -> int:
    """Length of the sketch in the partition of items of this many shingles."""
    largest = (2 << (size.bit_length() - 1)) - 1
    return math.floor((1 - threshold) * largest + 1e-9) + 1


@dataclass
class Block:
    """The items of one pass."""

    ids: list
    shingles: list[set[bytes]]
    sketch: np.ndarray  # sorted hash values of all sketches
    owner: np.ndarray  # the item of each
    every: np.ndarray  # sorted hash values of all shingles
    filter: np.ndarray  # which leading bits a sketch value has
    least: np.ndarray  # words runs that a document needs, by item
    short: dict[int, tuple[np.ndarray, dict[bytes, list]]]  # sorted hash values and item ids by run, by number of words below a shingle

    @classmethod
    def of(cls, items: list[tuple], shingle: int, threshold: float) -> Block:
        ids, sets, sketch, owner, every, least = [], [], [], [], [], []
        runs: dict[int, dict[bytes, list]] = {}
        for item, text in items:
            words = words_of(text)
            if len(words) < shingle:
                if words:
                    runs.setdefault(len(words), {}).setdefault(b" ".join(words), []).append(item)
                continue
            found = set(shingles_of(words, shingle))
            hashes = np.unique(hashes_of(words, shingle))
            small = hashes[: sketch_length(len(found), threshold)]
            every.append(hashes)
            sketch.append(small)
            owner.append(np.full(len(small), len(ids)))
            smallest = 1 << (len(found).bit_length() - 1)
            least.append(math.ceil(threshold * smallest - 1e-9))
            ids.append(item)
            sets.append(found)
        values = np.concatenate(sketch) if sketch else np.zeros(0, dtype=np.uint64)
        order = np.argsort(values, kind="stable")
        leading = np.zeros(1 << _BITS, dtype=bool)
        leading[(values >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        short = {n: (np.unique(np.concatenate([hashes_of(r.split(b" "), n) for r in of])), of) for n, of in runs.items()}
        return cls(ids, sets, values[order], (np.concatenate(owner) if owner else np.zeros(0, dtype=int))[order], np.unique(np.concatenate(every)) if every else values, leading, np.array(least, dtype=int), short)

    def found_in(self, words: list[bytes], hashes: np.ndarray, shingle: int, threshold: float) -> list[tuple[object, int, int]]:
        """(item id, its shingles in the document, its shingles) of every item contained in a document."""
        maybe = hashes[self.filter[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]]
        if not len(maybe):
            return []
        from_, to = np.searchsorted(self.sketch, np.unique(maybe), "left"), np.searchsorted(self.sketch, np.unique(maybe), "right")
        candidates = sorted({int(i) for a, b in zip(from_, to) for i in self.owner[a:b] if self.least[i] <= len(hashes)})
        if not candidates:
            return []
        held = {b" ".join(words[k : k + shingle]) for k in np.flatnonzero(np.isin(hashes, self.every)).tolist()}
        out = []
        for i in candidates:
            both, size = len(self.shingles[i] & held), len(self.shingles[i])
            if both >= threshold * size - 1e-9:
                out.append((self.ids[i], both, size))
        return out


def matches(texts: list[str | None], block: Block, shingle: int, threshold: float) -> list[list[tuple[object, int, int]]]:
    """What of a block each text contains."""
    split = [words_of(t) for t in texts]
    ends = np.cumsum([len(w) for w in split])
    every = [w for words in split for w in words]
    out: list[list[tuple[object, int, int]]] = [[] for _ in texts]
    if block.ids:
        hashes = hashes_of(every, shingle)
        for k, (words, end) in enumerate(zip(split, ends.tolist())):
            if len(words) >= shingle:
                out[k] += block.found_in(words, hashes[end - len(words) : end - shingle + 1], shingle, threshold)
    for length, (values, items) in block.short.items():
        at = np.flatnonzero(np.isin(hashes_of(every, length), values))
        owner = np.searchsorted(ends, at, "right")
        inside = at + length <= ends[owner]
        for k, run in {(k, b" ".join(every[p : p + length])) for p, k in zip(at[inside].tolist(), owner[inside].tolist())}:
            out[k] += [(item, 1, 1) for item in items.get(run, ())]
    return out


def blocks(benchmark: DataFrame, shingle: int, threshold: float, most_chars: int) -> Iterator[Block]:
    """Blocks of items whose texts have about ``most_chars`` characters together, or one item each where it has more."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(chars / most_chars))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield Block.of(sorted(map(tuple, rows), key=repr), shingle, threshold)


def contained(documents: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, most_chars: int = 16_000_000) -> DataFrame:
    """doc_id, item_id, matched, item_shingles, containment: one row for each document row and item found in it.

    Words are lower-case runs of letters and digits. An item of fewer words than a shingle has one shingle, all its words,
    and is found wherever these stand in this order. Null, empty and wordless items and texts match nothing. Repeated
    documents and items are reported each for itself; null ids are reported as null; other columns are not looked at.
    """
    context = documents.sparkSession.sparkContext
    texts = documents.select("doc_id", F.col("text").cast("string").alias("_text"))
    item_kind = benchmark.schema["item_id"].dataType
    arrow_kind = to_arrow_type(item_kind)
    schema = documents.select("doc_id").schema.add("item_id", item_kind).add("matched", "long").add("item_shingles", "long").add("containment", "double")

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for first, last, part in texts_of(batch, 1):
                    rows = [(first + k, *m) for k, found in enumerate(matches(part, block, shingle, threshold)) for m in found]
                    if rows:
                        at, ids, both, size = zip(*rows)
                        docs = batch.column(0).take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([docs, pa.array(ids, arrow_kind), pa.array(both, pa.int64()), pa.array(size, pa.int64()), pa.array([b / s for b, s in zip(both, size)])], names=schema.names)

        return run

    found = None
    for block in blocks(benchmark, shingle, threshold, most_chars):
        part = arrow_map(texts, search(context.broadcast(block)), schema)
        found = part if found is None else found.union(part)
    return found


def clean(documents: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, most_chars: int = 16_000_000) -> DataFrame:
    """The documents, all columns, in which no item of the benchmark is contained."""
    context, place = documents.sparkSession.sparkContext, documents.columns.index("text")

    def pick(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for first, last, part in texts_of(batch, place):
                    stay = [not found for found in matches(part, block, shingle, threshold)]
                    yield batch.slice(first, last - first).filter(pa.array(stay))

        return run

    for block in blocks(benchmark, shingle, threshold, most_chars):
        documents = arrow_map(documents, pick(context.broadcast(block)), documents.schema)
    return documents
