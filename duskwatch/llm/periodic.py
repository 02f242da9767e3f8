"""Periodic runs of words, found online by catchers over dyadic blocks.

Words are appended in pieces. At every level k a catcher stands on each completed block of 2^k words that starts at a
multiple of 2^k. Every appended word ends a suffix of 2^k words; the catcher that watches for a suffix with start i is the one
on the block before the block that holds i, so a suffix is compared with one fingerprint a level. Where they agree, the words
from the block on repeat with a period p between 2^k and 2^(k+1), the start of a square; neighbouring squares of one period
merge into a chain, which is checked word by word and grown to both sides into the maximal run. A run that still reaches the
last word is open and grows first when more words come. A run of 4 periods or more holds two whole blocks that agree with
what stands a period later, so two blocks in a row, or one at the very end, are asked for before anything is checked.

Fingerprints of 2^k words are made from two of half the length, so a word costs a few vector operations a level. A
fingerprint only proposes; equality of words decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from duskwatch.llm.common import arrow_map, texts_of

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(29)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    both = left * _MIX + right
    both ^= both >> _FOLD
    return both


class Catchers:
    """Runs of a growing sequence of whole numbers: smallest period q, at least ``periods`` times q and ``least`` long.

    ``longest_period`` bounds the periods looked for (None: a quarter of any length).
    """

    def __init__(self, periods: int = 4, least: int = 6, longest_period: int | None = None):
        self.periods, self.least, self.longest_period = periods, least, longest_period
        self._held = np.empty(1024, dtype=np.int64)
        self._size = 0
        self._tails: list[np.ndarray] = []  # fingerprints that the next level has not used yet
        self._blocks: list[np.ndarray] = []  # fingerprints of completed blocks, the catchers of a level
        self._open: dict[tuple[int, int], int] = {}  # (start, period) -> end
        self._closed: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        """Let ``words`` follow what was appended before."""
        before, self._size = self._size, self._size + len(words)
        if self._size > len(self._held):
            grown = np.empty(max(self._size, 2 * len(self._held)), dtype=np.int64)
            grown[:before] = self._held[:before]
            self._held = grown
        self._held[before : self._size] = words
        text = self._held[: self._size]
        for (start, period), end in list(self._open.items()):
            del self._open[start, period]
            self._keep(start, end + self._agreeing(text, end, period), period)
        level, prints = 0, words.astype(np.uint64) * _MIX
        prints ^= prints >> _FOLD
        first = before  # start of the first suffix that ends in the new words
        while True:
            width = 1 << level
            if level == len(self._blocks):
                self._blocks.append(np.empty(0, dtype=np.uint64))
                self._tails.append(np.empty(0, dtype=np.uint64))
            self._blocks[level] = np.concatenate([self._blocks[level], prints[(-first) % width :: width]])
            self._catch(text, level, first, prints)
            if self.longest_period is not None and 2 * width > self.longest_period:
                return
            known = np.concatenate([self._tails[level], prints])
            self._tails[level] = known[max(0, len(known) - width) :]
            if len(known) <= width:
                return
            first += len(prints) - len(known)
            prints = _mixed(known[:-width], known[width:])
            level += 1

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) of all runs so far, by start and then period."""
        best: dict[tuple[int, int], int] = {}
        for held in (self._closed, self._open):
            for (start, period), end in held.items():
                if end - start >= max(self.least, self.periods * period):
                    best[start, end] = min(period, best.get((start, end), period))
        return np.array(sorted((start, end - start, period) for (start, end), period in best.items()), dtype=np.int64).reshape(-1, 3)

    def _catch(self, text: np.ndarray, level: int, first: int, prints: np.ndarray) -> None:
        """Compare each new suffix with its catcher and grow what agrees into runs."""
        width = 1 << level
        skipped = max(0, width - first)
        starts = np.arange(first + skipped, first + len(prints), dtype=np.int64)
        blocks = (starts >> level) - 1
        hits = np.flatnonzero(self._blocks[level][blocks] == prints[skipped:])
        if not len(hits):
            return
        block, period = blocks[hits] << level, starts[hits] - (blocks[hits] << level)
        if self.longest_period is not None:
            fits = period <= self.longest_period
            block, period = block[fits], period[fits]
        shorter = sorted((start, end) for held in (self._closed, self._open) for (start, p), end in held.items() if p < width)
        if shorter:  # inside a run of a shorter period everything repeats with multiples of that period
            begin = np.array([s for s, _ in shorter])
            reach = np.maximum.accumulate(np.array([e for _, e in shorter]))
            place = np.searchsorted(begin, block, side="right") - 1
            fresh = (place < 0) | (reach[np.maximum(place, 0)] < block + period + width)
            block, period = block[fresh], period[fresh]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        if not len(block):
            return
        new_chain = np.flatnonzero((np.diff(period) != 0) | (np.diff(block) != width)) + 1
        low, high = np.concatenate([[0], new_chain]), np.concatenate([new_chain, [len(block)]]) - 1
        wanted = (high > low) | (block[high] + period[high] + 2 * width > len(text))
        for a, b, p in zip(block[low][wanted].tolist(), (block[high][wanted] + width).tolist(), period[low][wanted].tolist()):
            same = text[a:b] == text[a + p : b + p]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            for begin, end in zip((a + edges[::2]).tolist(), (a + edges[1::2]).tolist()):
                begin -= self._agreeing_before(text, begin, p)
                if (begin, p) not in self._open and (begin, p) not in self._closed:
                    self._keep(begin, end + p + self._agreeing(text, end + p, p), p)

    def _keep(self, start: int, end: int, period: int) -> None:
        if end == self._size:
            self._open[start, period] = end
        elif end - start >= max(self.least, self.periods * period):
            self._closed[start, period] = end

    @staticmethod
    def _agreeing(text: np.ndarray, end: int, period: int) -> int:
        """Words from ``end`` on that equal the word a period before them."""
        at, step = end, 64
        while at < len(text):
            upto = min(len(text), at + step)
            differs = np.flatnonzero(text[at:upto] != text[at - period : upto - period])
            if len(differs):
                return at + int(differs[0]) - end
            at, step = upto, 2 * step
        return at - end

    @staticmethod
    def _agreeing_before(text: np.ndarray, start: int, period: int) -> int:
        """Words before ``start`` that equal the word a period after them."""
        at, step = start, 64
        while at > 0:
            down = max(0, at - step)
            differs = np.flatnonzero(text[down:at] != text[down + period : at + period])
            if len(differs):
                return start - (down + int(differs[-1]) + 1)
            at, step = down, 2 * step
        return start


def runs_of_words(texts: list[list[bytes]], periods: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words.

    The lists follow each other in one sequence, with a number of its own between any two, which no run can cross.
    """
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(chain(t, (b" ",)) for t in texts)), dtype=np.int64, count=int(first[-1]))
    words[first[1:] - 1] = -1 - np.arange(len(texts))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    longest = int(sizes.max(initial=0)) // periods
    if longest:
        catchers = Catchers(periods, least, longest)
        catchers.append(words)
        got = catchers.runs()
        for text, (start, length, period) in zip((np.searchsorted(first, got[:, 0], side="right") - 1).tolist(), got.tolist()):
            found[text].append((start - int(first[text]), length, period))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return list(compress(words, keep.tolist()))


def periodic_runs(documents: DataFrame, periods: int = 4, least: int = 6, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period by start and period), collapsed (the kept words).

    Words are what stands between the characters U+0020 and U+0009 to U+000D. Null and empty texts have no word, no run and
    the collapsed text ''. Null and repeated ids and repeated rows are kept, an empty table gives no row, other columns are
    not looked at. A text is searched whole, however long, in time of n log n; nothing is shuffled. ``rewrite`` may change a
    document's words before the search.
    """
    schema = documents.select("doc_id").schema.add("n_words", "long").add("runs", ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))).add("collapsed", "string")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in texts_of(batch, 1):
                ids = batch.column(0).slice(first, last - first)
                words = [(t or b"").split() for t in texts]
                if rewrite is not None:
                    words = [rewrite(i, w) for i, w in zip(ids.to_pylist(), words)]
                found = runs_of_words(words, periods, least)
                kept = pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, found)], pa.binary()).cast(pa.string())
                listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found], run_type)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), listed, kept], names=schema.names)

    return arrow_map(documents.select("doc_id", F.col("text").cast("string").cast("binary").alias("_text")), run, schema)
