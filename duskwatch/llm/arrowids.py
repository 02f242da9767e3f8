"""Token ids as Arrow files with fixed-size-list batches.

All documents in ascending order of doc_id form one stream of ids, each document closed by an end id. A file holds a stretch
of the stream cut into sequences of one length: column ``ids`` is a fixed-size list of the smallest unsigned type that holds
the vocabulary, column ``mask`` a fixed-size list of bits, false on the padding at the end of a file. Every batch but the
last has the same number of rows, so the place of any id follows from its number alone, and a memory-mapped file is read
without a copy. A second Arrow file beside it lists the documents: doc_id, start in the file and number of ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duskwatch.llm.bpe import word_cache
from duskwatch.llm.common import arrow_map, open_folder, shared_folder, texts_of, write_file, write_once

FILES = "part int, ids_file string, docs_file string, documents long, tokens long"


def file_schema(length: int, largest: int) -> pa.Schema:
    kind = pa.uint16() if largest < 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class Sequences:
    """Random access to one written file: ``ids(start, count)`` and whole ``rows``."""

    def __init__(self, folder: str, name: str):
        system, path = open_folder(folder)
        source = pa.memory_map(f"{path}/{name}") if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(f"{path}/{name}")
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches: dict[int, pa.RecordBatch] = {}
        self.rows_per_batch = self._batch(0).num_rows if self.reader.num_record_batches else 1

    def _batch(self, number: int) -> pa.RecordBatch:
        if number not in self.batches:
            while len(self.batches) > 4:
                self.batches.pop(next(iter(self.batches)))
            self.batches[number] = self.reader.get_batch(number)
        return self.batches[number]

    def row(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file where it is mapped) and mask of one sequence."""
        batch, at = self._batch(number // self.rows_per_batch), number % self.rows_per_batch
        part = batch.slice(at, 1)
        return part.column(0).flatten().to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int) -> np.ndarray:
        """So many ids from a place in the file's stream."""
        parts, size = [], self.rows_per_batch * self.length
        while count > 0:
            flat = self._batch(start // size).column(0).flatten().to_numpy()
            part = flat[start % size : start % size + count]
            if not len(part):
                raise ValueError("the file is shorter than its list of documents says")
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, dtype=np.uint32)])

    def tokens(self) -> int:
        """Ids that are no padding: all rows but the last are full."""
        if not self.reader.num_record_batches:
            return 0
        last = self._batch(self.reader.num_record_batches - 1)
        full = (self.reader.num_record_batches - 1) * self.rows_per_batch + last.num_rows - 1
        return full * self.length + int(self.row(full)[1].sum())


def write_sequences(documents: DataFrame, vocabulary: str, folder: str, end: int = 0, length: int = 1024, rows: int = 512, largest: int = 50_256) -> DataFrame:
    """Write the files into ``folder`` and return their list: part, ids_file, docs_file, documents, tokens, start.

    Documents are dealt out by ranges of doc_id and sorted within: null ids come first, ties go by a hash of the text. Null texts are
    empty. Only one batch of ids and the numbers of a file's documents are in a task's memory. The list is written to the
    scratch folder; files of attempts that Spark did not accept are in no list.
    """
    spark = documents.sparkSession
    schema = file_schema(length, largest)
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The ranges are found from samples of the keys, so these are numbers, not texts.
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("_text")]
    ordered = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order, "_text")
    tail = end.to_bytes(4, "little")
    small = schema.field("ids").type.value_type.to_pandas_dtype()
    block = rows * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        ids, starts, counts = [], [], []

        def write_ids(out) -> None:
            with pa.ipc.new_file(out, schema) as writer:
                held, waiting, at = [], 0, 0

                def put(flat: np.ndarray) -> None:
                    mask = np.ones(len(flat) + -len(flat) % length, dtype=bool)
                    mask[len(flat) :] = False
                    padded = np.concatenate([flat, np.full(len(mask) - len(flat), end, dtype=small)]) if len(mask) > len(flat) else flat
                    columns = [pa.FixedSizeListArray.from_arrays(pa.array(padded), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)]
                    writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))

                for batch in (b for source in ([first], batches) for b in source):
                    for begin, past, texts in texts_of(batch, 1):
                        ids.append(batch.column(0).slice(begin, past - begin))
                        for text in texts:
                            found = np.frombuffer(cache.encode(text) + tail, dtype="<u4").astype(small)
                            starts.append(at)
                            counts.append(len(found))
                            at += len(found)
                            waiting += len(found)
                            held.append(found)
                        if waiting >= block:
                            flat = np.concatenate(held)
                            for k in range(0, len(flat) - block + 1, block):
                                put(flat[k : k + block])
                            held = [flat[len(flat) // block * block :]]
                            waiting = len(held[0])
                if waiting:
                    put(np.concatenate(held))

        part = TaskContext.get().partitionId()
        ids_file = write_file(folder, f"part-{part:05d}.arrow", write_ids)
        listed = pa.table([pa.chunked_array(ids), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "start", "n_tokens"])

        def write_docs(out) -> None:
            with pa.ipc.new_file(out, listed.schema) as writer:
                writer.write_table(listed, max_chunksize=65_536)

        docs_file = write_file(folder, f"part-{part:05d}.docs.arrow", write_docs)
        row = [[part], [ids_file], [docs_file], [len(counts)], [sum(counts)]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["part", "ids_file", "docs_file", "documents", "tokens"])

    files = write_once(arrow_map(ordered, run, FILES), "arrow-files")
    # One row for each file: few, whatever the documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_documents(files: DataFrame, folder: str, id_type) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from written files."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sequences = Sequences(folder, row["ids_file"])
                if sequences.tokens() != row["tokens"]:
                    raise ValueError(f"{row['ids_file']} has not the ids that its list says")
                system, path = open_folder(folder)
                with system.open_input_file(f"{path}/{row['docs_file']}") as source:
                    listed = pa.ipc.open_file(source).read_all()
                for docs in listed.to_batches(max_chunksize=1024):
                    starts, counts = docs.column(1).to_pylist(), docs.column(2).to_pylist()
                    ids = [sequences.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts, counts)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array([s + row["start"] for s in starts], pa.int64()), docs.column(2), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    schema = StructType().add("doc_id", id_type).add("start", "long").add("n_tokens", "long").add("ids", "binary")
    return arrow_map(files.repartition(parts, "part"), run, schema)


def documents_in_files(documents: DataFrame, vocabulary: str, folder: str | None = None, **options) -> DataFrame:
    """Write all documents to Arrow files and read them back: doc_id, start, n_tokens, ids.

    Null and empty texts are the end id alone. Repeated rows are written each for itself and null ids come first; an empty
    table writes no file. Other columns are not looked at.
    """
    folder = folder or shared_folder(documents.sparkSession, "arrow")
    files = write_sequences(documents, vocabulary, folder, **options)
    return read_documents(files, folder, documents.schema["doc_id"].dataType)
