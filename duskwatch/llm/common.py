"""Helpers that several text operators share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learnt from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def arrow_map(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver has it, besides wherever the cluster put it."""
    root = str(Path(__file__).resolve().parents[2])
    known = frame.sparkSession.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))
    return frame.mapInArrow(run, schema)


def unused_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``frame`` has that name."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def write_once(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to the shared scratch folder and read it back, so that nothing above runs it again."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def lowest(frame: DataFrame, code: str, rows: int) -> DataFrame:
    """The rows with the ``rows`` smallest values of the hash column ``code``.

    A bound on the hash, from the number of rows, lets through some more than are wanted; only these are ordered, so what
    meets in one place does not grow with the table.
    """
    share = min(1.0, (1.2 * rows + 100) / max(frame.count(), 1))
    bound = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    return frame.where(F.col(code) <= bound).orderBy(*[code, *(c for c in frame.columns if c != code)]).limit(rows)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Columns doc_id, text and label of at most ``rows`` labelled training documents, chosen by a hash of the id.

    Held-out ids, null ids and null labels take no part; an id that is labelled twice has its smallest label, and of several
    rows with one id the text with the least hash stands, picked in each task before its rows are shuffled. The chosen ids
    have a proven bound (``rows``), so they are broadcast and the texts are read in place.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    chosen = lowest(chosen.withColumn("code", F.xxhash64("doc_id")), "code", rows).drop("code")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return found.select("doc_id", "text", "label")


def texts_of(batch: pa.RecordBatch, column: int, lowest: int = 1 << 22) -> Iterator[tuple[int, int, list[str | None]]]:
    """Slices of a batch, each of about ``lowest`` bytes of text or one row: (first row, past the last row, texts)."""
    values = batch.column(column)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist() if batch.num_rows else []
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if row > first and held + size > lowest:
            yield first, row, values.slice(first, row - first).to_pylist()
            first, held = row, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes), values.slice(first).to_pylist()


def shared_folder(spark: SparkSession, label: str) -> str:
    """Address of a new folder that the driver and every executor reach; the first writer makes it."""
    return scratch_path(spark, label)


def open_folder(address: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's address, for code inside tasks."""
    if "://" not in address and not address.startswith("file:"):
        return pafs.LocalFileSystem(), address
    return pafs.FileSystem.from_uri(address if not address.startswith("file:/") or address.startswith("file://") else f"file://{address[5:]}")


def write_file(address: str, name: str, content, same_name: bool = False) -> str:
    """Write one file whole: under a name of this attempt first, then moved. Returns the file's name.

    With ``same_name`` the last attempt's file stays, for contents that every attempt makes alike.

    The name of every attempt is unique and only the attempt that Spark accepts has its name in the list of files, so a
    repeated or speculative task harms nothing.
    """
    system, folder = open_folder(address)
    stem, suffix = os.path.splitext(name)
    mark = uuid.uuid4().hex[:12]
    final = name if same_name else f"{stem}-{mark}{suffix}"
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/.{stem}-{mark}.part") as out:
        content(out)
    system.move(f"{folder}/.{stem}-{mark}.part", f"{folder}/{final}")
    return final
