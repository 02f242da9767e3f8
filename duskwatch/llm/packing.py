"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are the powers of two of its length's binary form, after as many pieces
of the full length as it holds. Every piece is a sequence of its own, so no sequence crosses documents and none is padded;
pieces of one length form a bucket, from which batches of equal sequences are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.bpe import word_cache
from duskwatch.llm.common import arrow_map, shared_folder, texts_of


def lengths(tokens: int, longest: int) -> list[int]:
    """Piece lengths of so many tokens, longest first; ``longest`` is a power of two."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(documents: DataFrame, vocabulary: str, end: int = 1, longest: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``length`` is the bucket. Null and empty texts are the end id alone, one piece of length 1. Repeated rows are packed each
    for itself, null ids stay null, an empty table has no piece, other columns are not looked at. The sequence id is the
    number of the task's input partition and a count within it: it needs no second pass and a repeated task gives it again.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    schema = documents.select("doc_id").schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        schema = schema.add(name, kind)
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary)
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, last, texts in texts_of(batch, 1):
                owner, start, length, ids, tokens = [], [], [], [], []
                for row, text in enumerate(texts, first):
                    whole = cache.encode(text) + tail
                    count, at = len(whole) // 4, 0
                    for size in lengths(count, longest):
                        owner.append(row)
                        start.append(at)
                        length.append(size)
                        ids.append(whole[4 * at : 4 * (at + size)])
                        tokens.append(count)
                        at += size
                numbers = pa.array(range(sequence, sequence + len(start)), pa.int64())
                sequence += len(start)
                columns = [batch.column(0).take(pa.array(owner)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), numbers, pa.array([0] * len(start), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return arrow_map(documents.select("doc_id", F.col("text").cast("string").alias("_text")), run, schema)


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Write the sequences as Parquet, one folder for each length."""
    pieces.write.partitionBy("length").parquet(folder)


def bucketed(pieces: DataFrame) -> DataFrame:
    """The same sequences, written to the shared scratch folder as one bucket for each length and read back from there."""
    folder = shared_folder(pieces.sparkSession, "buckets")
    write_buckets(pieces, folder)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(folder).select(*pieces.columns)
