"""Statistics of whole texts, computed in Arrow batches: one pass over the words of a text, none of them shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import arrow_map, texts_of

WHITE = b" \t\n\r\x0b\x0c"  # what separates words: U+0020 and U+0009 to U+000D
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
MARKS = b".,;:!?"
OPEN_MARKS = b"!?"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_shouts", "most_frequent", "squared_counts"]


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window found twice or more, the first find included."""
    runs = list(zip(*(words[k:] for k in range(window))))
    if len(set(runs)) == len(runs):
        return 0
    seen = Counter(runs)
    often = np.fromiter((seen[r] > 1 for r in runs), dtype=bool, count=len(runs))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[k : k + len(runs)] |= often
    return int(covered.sum())


def counts_of(text: str | None, more: bool = True) -> list[int]:
    """The numbers named in COUNTS, and in MORE if wanted; null is the empty text."""
    text = text or ""
    raw = text.encode(errors="replace")

    def count(characters: bytes) -> int:
        return len(raw) - len(raw.translate(None, characters))

    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    found = [len(words), len(text) - count(WHITE), count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)]
    if more:
        seen = Counter(words)
        found += [len(lines), len(seen), count(UPPER), count(LOWER), count(DIGITS), count(MARKS), count(OPEN_MARKS)]
        found += [max(seen.values(), default=0), sum(n * n for n in seen.values())]
    return found


def with_counts(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the counts (longs) of the column ``text``."""
    schema = rows.select(*keep).schema
    for name in COUNTS + MORE:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in texts_of(batch, batch.num_columns - 1):
                found = np.array([counts_of(t) for t in texts], dtype=np.int64)
                kept = [batch.column(k).slice(first, last - first) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(found[:, k])) for k in range(found.shape[1]))], names=schema.names)

    return arrow_map(rows.select(*keep, F.col("text").cast("string").alias("_text")), run, schema)
