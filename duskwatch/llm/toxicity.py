"""Toxicity by maximum-scoring segments.

Every word has a score: its log-odds between toxic and clean training documents under a Dirichlet prior that is the corpus
itself, if that is significantly above zero, else one small negative score that makes chance runs lose. A linear-time scan
finds every maximal segment of a text. Segment scores follow an extreme-value law on clean text, whose parameters are
solved and counted from clean training documents, so a segment has an expected number of chance finds in a text of that
length. Significant segments are combined by the law of their summed scores, and one logistic curve turns the evidence
into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import arrow_map, held_out, labelled_sample, texts_of, write_once
from duskwatch.llm.decontaminate import hashes_of, words_of
from duskwatch.llm.qda import logistic

Segment = tuple[int, int, float]
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, 240, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def maximal_segments(items: list[tuple[int, int, float]]) -> list[Segment]:
    """All maximal scoring segments, left to right, of scored stretches (first, past the last, score) that follow each other.

    Each stretch enters a list once and leaves it at most once, so the work is linear.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, past last, sum before, sum at end, nearest with a lesser sum before
    total = 0.0
    for first, last, score in items:
        before, total = total, total + score
        if score <= 0:
            continue
        left, start = before, first
        back = len(found) - 1
        while True:
            while back >= 0 and found[back][2] >= left:
                back = found[back][4]
            if back < 0 or found[back][3] >= total:
                found.append((start, last, left, total, back))
                break
            start, left = found[back][0], found[back][2]
            del found[back:]
            back = len(found) - 1
    return [(first, last, end - begin) for first, last, begin, end, _ in found]


@dataclass
class Model:
    words: dict[bytes, float]
    other: float  # score of every other word, negative
    decay: float  # of the extreme-value law, for one unit of score
    scale: float  # its factor for one word of text
    significant: float  # expected chance finds up to which a segment counts
    slope: float
    shift: float

    def segments(self, words: list[bytes]) -> list[Segment]:
        """Maximal segments of a text as (first word, past the last word, score)."""
        if self.words.keys().isdisjoint(words):
            return []
        scores, at, items = self.words, 0, []
        for k, word in enumerate(words):
            if (score := scores.get(word)) is not None:
                if k > at:
                    items.append((at, k, self.other * (k - at)))  # a run of other words is one stretch
                items.append((k, k + 1, score))
                at = k + 1
        return maximal_segments(items)

    def log_expected(self, score: float, length: int) -> float:
        """Log of the number of chance segments of at least this score in a clean text of so many words."""
        return math.log(self.scale) + math.log(max(length, 1)) - self.decay * score

    def expected(self, score: float, length: int) -> float:
        return math.exp(min(self.log_expected(score, length), 700.0))

    def significant_segments(self, words: list[bytes]) -> list[Segment]:
        return [s for s in self.segments(words) if self.log_expected(s[2], len(words)) <= math.log(self.significant)]

    def evidence(self, words: list[bytes]) -> float:
        """Minus the log probability that clean text of this length has significant segments summing as high; 0 without any."""
        found = self.significant_segments(words)
        if not found:
            return 0.0
        count = len(found)
        total = sum(-self.log_expected(s, len(words)) for _, _, s in found)
        log_p = -total + (count - 1) * math.log(max(total, 1e-9)) - math.lgamma(count + 1) - math.lgamma(count)
        return max(0.0, -log_p)

    def score(self, text: str | None) -> float:
        x = self.slope * math.log1p(self.evidence(words_of(text))) + self.shift
        return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def _decay(words: dict[bytes, float], clean: dict[bytes, float], other: float) -> float:
    """The positive root of sum p * exp(root * score) = 1 over the clean distribution of scores."""
    rate = np.array([clean[w] for w in words])
    score = np.array([words[w] for w in words])
    rest = max(1 - rate.sum(), 1e-9)

    def excess(x: float) -> float:
        return float((rate * np.exp(x * score)).sum() + rest * math.exp(x * other) - 1)

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return (low + high) / 2


def sketch_of(words: list[bytes], bands: int = 20, width: int = 6) -> tuple[list[int], bytes]:
    """Keys of bands of minima of the shingle hashes under different multipliers, and 16 bits of each of all 240 minima.

    Texts of Jaccard similarity J share a key with probability 1 - (1 - J^6)^20: 0.998 at 0.8, 0.005 at 0.25.
    """
    if not words:
        return [0] * bands, bytes(2 * len(_MULTIPLIERS))
    hashes = np.unique(hashes_of(words, min(3, len(words))))
    minima = np.array([(hashes * m).min() for m in _MULTIPLIERS])
    mixed = (minima[: bands * width].reshape(bands, width) * _MULTIPLIERS[:width]).sum(axis=1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64).tolist(), (minima & np.uint64(0xFFFF)).astype("<u2").tobytes()


def without_copies(rows: list[tuple[int, int, list[int], bytes]], alike: float = 0.7) -> list[int]:
    """The ids of (id, label, keys, minima) that are no copies of a lesser id that stays.

    A copy has the same label and a key in common, and the share of equal minima, which estimates the Jaccard similarity
    with a standard error of 0.03, is at least ``alike``. Copies are never compared with, so links do not chain.
    """
    rows = sorted(rows, key=lambda r: r[:2])
    minima = np.frombuffer(b"".join(r[3] for r in rows), dtype="<u2").reshape(len(rows), -1) if rows else None
    held: dict[tuple[int, int, int], list[int]] = {}
    out = []
    for row, (i, label, keys, _) in enumerate(rows):
        places = [(label, place, key) for place, key in enumerate(keys)]
        near = list({other for p in places for other in held.get(p, ())})
        if near and ((minima[near] == minima[row]).mean(axis=1) >= alike).any():
            continue
        out.append(i)
        for p in places:
            held.setdefault(p, []).append(row)
    return out


def fit(documents: DataFrame, labels: DataFrame, rows: int = 20_000, prior: float = 500.0, z: float = 2.5, other: float = -0.25, significant: float = 0.05) -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fifth, copies and near copies once.

    A word counts once for each document. Its counts are summed on the executors; every word of the
    sample that is significant (``z``) and, for each sampled document, one sketch of its shingles and one number pair come to
    the driver, all bounded by the sample. Without both classes every score is the share of toxic rows.
    """

    sample = write_once(labelled_sample(documents, labels, "toxic", rows).select("doc_id", "label", "text"), "toxic")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in texts_of(batch, 2):
                keys, minima = zip(*(sketch_of(words_of(t)) for t in texts))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[:2]), pa.array(keys, pa.list_(pa.int64())), pa.array(minima, pa.binary())], names=["doc_id", "label", "keys", "minima"])

    # One of each group of copies and near copies speaks for all, or their words would look toxic; a shared passage is no copy.
    drawn = arrow_map(sample, sketch, "doc_id long, label int, keys array<long>, minima binary").collect()
    alone = documents.sparkSession.createDataFrame([(i,) for i in without_copies([tuple(r) for r in drawn])], "doc_id long")
    sample = sample.join(F.broadcast(alone), "doc_id").select("doc_id", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(1).to_pylist()
            for first, _, texts in texts_of(batch, 2):
                seen = (Counter(), Counter())
                for k, text in enumerate(texts, first):
                    seen[marks[k]].update(set(words_of(text)))
                names = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array([s[n] for n in names], pa.int64()) for s in seen)], names=["word", "clean", "toxic"])

    counts = arrow_map(sample, count, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = write_once(counts, "words")
    n0, n1 = (x or 0 for x in counts.agg(F.sum("clean"), F.sum("toxic")).first())
    docs = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = math.log((docs.get(1, 0) + 0.5) / (docs.get(0, 0) + 0.5))
    if not n0 or not n1:
        return Model({}, other, 1.0, 1.0, significant, 0.0, base)
    weight = F.lit(0.5) + F.lit(prior) * (F.col("clean") + F.col("toxic")) / (n0 + n1)

    def odds(n: str, size: int):
        y = F.col(n) + weight
        return F.log(y / (size + prior - y))

    delta = odds("toxic", n1) - odds("clean", n0)
    spread = F.sqrt(1 / (F.col("toxic") + weight) + 1 / (F.col("clean") + weight))
    top = counts.select("word", "clean", delta.alias("delta"), (delta / spread).alias("z")).where(F.col("z") >= z).collect()
    words = {bytes(r["word"]): r["delta"] for r in sorted(top, key=lambda r: bytes(r["word"]))}
    tokens = max(n0, 1)
    clean = {bytes(r["word"]): (r["clean"] + 0.5) / tokens for r in top}
    model = Model(words, other, _decay(words, clean, other) if words else 1.0, 1.0, significant, 0.0, base)

    def measure(model: Model, what: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, texts in texts_of(batch, 2):
                    split = [words_of(t) for t in texts]
                    if what == "evidence":
                        found = [(1.0, math.log1p(model.evidence(w))) for w in split]
                    else:
                        found = [(float(len(w)), float(len(model.segments(w)))) for w in split]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "label", "a", "b"])

        return arrow_map(sample, run, "doc_id long, label int, a double, b double")

    # The law's factor: segments of at least the least positive score, counted in clean text, over their expected number.
    size, chance = measure(model, "segments").where("label = 0").agg(F.sum("a"), F.sum("b")).first()
    least = min(words.values(), default=0.0)
    model.scale = ((chance or 0) + 0.5) / max(size or 0, 1.0) * math.exp(min(model.decay * least, 600.0))
    got = measure(model, "evidence").select("doc_id", "label", "b").toPandas().sort_values(["doc_id", "b", "label"])
    model.slope, model.shift = logistic(got["b"].to_numpy(), got["label"].to_numpy(dtype=float))
    model.slope = max(model.slope, 0.0)
    return model


def scores(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages (significant toxic segments) of every document.

    Null, empty and wordless texts have no passage and the score of a text without evidence. Repeated rows and null ids are
    scored each for itself; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in texts_of(batch, 1):
                found = [model.score(t) for t in texts]
                number = [len(model.significant_segments(words_of(t))) if s > model.score("") else 0 for t, s in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(found, pa.float64()), pa.array(number, pa.int64())], names=["doc_id", "score", "n_passages"])

    kind = documents.select("doc_id").schema.add("score", "double").add("n_passages", "long")
    scored = arrow_map(documents.select("doc_id", F.col("text").cast("string").alias("_text")), run, kind)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def passages(documents: DataFrame, model: Model) -> DataFrame:
    """Every significant toxic passage: doc_id, first_word, past_last_word, score, expected (chance finds), text (its words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, texts in texts_of(batch, 1):
                rows = []
                for k, text in enumerate(texts, first):
                    words = words_of(text)
                    rows += [(k, a, b, s, model.expected(s, len(words)), b" ".join(words[a:b]).decode(errors="replace")) for a, b, s in model.significant_segments(words)]
                if rows:
                    at, *columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, columns)], names=schema.names)

    schema = documents.select("doc_id").schema
    for name, kind in (("first_word", "long"), ("past_last_word", "long"), ("score", "double"), ("expected", "double"), ("text", "string")):
        schema = schema.add(name, kind)
    return arrow_map(documents.select("doc_id", F.col("text").cast("string").alias("_text")), run, schema)
