"""Near-duplicates by SimHash, compared bit-sliced.

Each distinct fingerprint is filed under every pair of the five blocks its bits are cut into: two fingerprints that differ
in at most three bits agree on at least two blocks, so they meet under some key. Whatever meets under a key is compared
with bit planes held vertically: one machine word carries one bit position of 64 comparisons, distances are counted by
carry-save logic, and comparisons are abandoned block by block once all are beyond the radius.

Fingerprints instead of documents are compared, so exact copies cost nothing, and a key that very many fingerprints share
is cut into cells of bounded size, each a task's work of its own. A cell reports a spanning forest of the links in it:
no link between different texts is lost and no group is written out as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import arrow_map, open_folder, shared_folder, texts_of, unused_name, write_file, write_once
from duskwatch.llm.components import components

BITS = 64
_BLOCK = 33  # monotonically_increasing_id: the task above, the row within it below


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text; null and texts without a word have 0. A bit is set if it is in over half the shingle hashes."""
    words = (text or "").encode(errors="replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=seed)
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(BITS, dtype=np.int64), len(words) - shingle + 1
    for first in range(0, total, 1 << 15):  # memory does not grow with the text
        last = min(total, first + (1 << 15))
        runs = zip(*(words[first + k : last + k] for k in range(shingle)))
        hashes = np.fromiter((digest(s, seed) for s in map(b" ".join, runs)), dtype="<u8", count=last - first)
        ones += column_sums(hashes)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def column_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit. Bits of 255 hashes at a time are added as bytes, eight bits to a word."""
    counts = np.zeros(BITS, dtype=np.int64)
    for first in range(0, len(hashes), 255):
        part = hashes[first : first + 255]
        for shift in range(8):
            lanes = (part >> np.uint64(shift)) & np.uint64(0x0101010101010101)
            counts[shift::8] += np.atleast_1d(lanes.sum(dtype=np.uint64)).view(np.uint8)
    return counts


def fingerprints(documents: DataFrame, keep: list[str], shingle: int = 3, seed: int = 42) -> DataFrame:
    """Columns ``keep`` of the documents and their ``fingerprint`` as a long (the same 64 bits, signed)."""
    schema = documents.select(*keep).schema.add("fingerprint", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in texts_of(batch, batch.num_columns - 1):
                found = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(len(keep))), pa.array(found)], names=schema.names)

    return arrow_map(documents.select(*keep, F.col("text").cast("string").alias("_text")), run, schema)


def planes(words: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit words: row b holds bit b of every word, 64 words to one machine word."""
    short = -len(words) % 64
    padded = np.concatenate([words, np.zeros(short, dtype=np.uint64)]) if short else words
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


class Counter:
    """Distances of many comparisons at once, as carry-save bit counters that stop at 2 ** levels."""

    def __init__(self, shape: tuple[int, ...], radius: int):
        self.levels = [np.zeros(shape, dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.beyond = np.zeros(shape, dtype=np.uint64)
        self.radius = radius

    def add(self, differs: np.ndarray) -> None:
        carry = differs
        for k, level in enumerate(self.levels):
            self.levels[k], carry = level ^ carry, level & carry
        self.beyond |= carry

    def within(self) -> np.ndarray:
        """Bit set where the distance is at most the radius."""
        more, equal = np.zeros_like(self.beyond), ~np.zeros_like(self.beyond)
        for k in reversed(range(len(self.levels))):  # counter > radius, from the highest bit
            if self.radius >> k & 1:
                equal &= self.levels[k]
            else:
                more |= equal & self.levels[k]
                equal &= ~self.levels[k]
        return ~(self.beyond | more)

    def keep(self, rows: np.ndarray) -> None:
        self.levels = [level[rows] for level in self.levels]
        self.beyond = self.beyond[rows]


def close_pairs(differences: np.ndarray, radius: int, block: int = 1 << 14) -> np.ndarray:
    """Which XORs of two fingerprints have at most ``radius`` bits: one comparison in each word, abandoned by blocks."""
    found = np.zeros(len(differences), dtype=bool)
    for first in range(0, len(differences), block):
        sliced = planes(differences[first : first + block])
        counter = Counter(sliced.shape[1:], radius)
        alive = np.arange(sliced.shape[1])
        for b in range(BITS):
            counter.add(sliced[b, alive])
            if b % 8 == 7:
                live = ~counter.within() != ~np.uint64(0)
                if not live.all():
                    alive = alive[live]
                    counter.keep(live)
                    if not len(alive):
                        break
        if len(alive):
            near = np.zeros(sliced.shape[1], dtype="<u8")
            near[alive] = counter.within()
            bits = np.unpackbits(near.view(np.uint8), bitorder="little").astype(bool)
            here = len(differences[first : first + block])
            found[first : first + here] = bits[:here]
    return found


def block_matches(queries: np.ndarray, against: np.ndarray, radius: int, rows: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """For each query with a match: its place and the places in ``against`` within the radius, itself included if there."""
    sliced = planes(against)
    full = ~np.uint64(0)
    for first in range(0, len(queries), rows):
        part = queries[first : first + rows]
        counter, alive = Counter((len(part), sliced.shape[1]), radius), np.arange(len(part))
        for b in range(BITS):
            ones = ((part[alive] >> np.uint64(b)) & np.uint64(1)) * full
            counter.add(sliced[b][None, :] ^ ones[:, None])
            if b % 8 == 7:
                live = counter.within().any(axis=1)
                if not live.all():
                    alive = alive[live]
                    counter.keep(live)
                    if not len(alive):
                        break
        for place, row in zip(alive, counter.within() if len(alive) else []):
            hits = np.flatnonzero(np.unpackbits(np.ascontiguousarray(row).view(np.uint8), bitorder="little")[: len(against)])
            if len(hits):
                yield first + int(place), hits


def forest(values: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links of one large cell. ``side`` 1 and 2 are compared with each other, 0 with everything."""
    one, two = (np.flatnonzero(side != 2), np.flatnonzero(side != 1))
    label, links = np.arange(len(values)), []
    for place, hits in block_matches(values[one], values[two], radius):
        own, groups = label[one[place]], np.unique(label[two[hits]])
        other = groups[groups != own]
        if len(other):
            links += [(int(values[own]), int(values[g])) for g in other]
            label[np.isin(label, other)] = own
    return links


def _links(radius: int, large: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(keys: np.ndarray, cells: np.ndarray, values: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
            """Links of whole runs of equal (key, cell)."""
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (cells[1:] != cells[:-1])]))
            ends = np.concatenate([starts[1:], [len(keys)]])
            out, sizes = [], ends - starts
            for s, e in zip(starts[sizes > large], ends[sizes > large]):
                out += [np.array(forest(values[s:e], side[s:e], radius), dtype=np.uint64).reshape(-1, 2)]
            end = np.repeat(np.where(sizes > large, starts, ends), sizes)  # large runs are done
            place = np.arange(len(keys))
            for shift in range(1, int(sizes[sizes <= large].max(initial=0))):
                place = place[place + shift < end[place]]
                if not len(place):
                    break
                near = place[close_pairs(values[place] ^ values[place + shift], radius)]
                near = near[(side[near] == 0) | (side[near] != side[near + shift])]
                out.append(np.stack([values[near], values[near + shift]], axis=1))
            return out

        rest = None
        for batch in batches:
            now = [np.asarray(batch.column(k)) for k in range(4)]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            cut = len(rest[0]) - 1
            while cut > 0 and rest[0][cut] == rest[0][cut - 1] and rest[1][cut] == rest[1][cut - 1]:
                cut -= 1
            if cut <= 0:
                continue
            for found in pairs(rest[0][:cut], rest[1][:cut], rest[2][:cut].view(np.uint64), rest[3][:cut]):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in (0, 1)], names=["u", "v"])
            rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            for found in pairs(rest[0], rest[1], rest[2].view(np.uint64), rest[3]):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in (0, 1)], names=["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = 3, cell: int = 2048) -> DataFrame:
    """Columns u, v: links among distinct fingerprints (column ``fingerprint``) that span every group within the radius.

    ``cell`` bounds how many fingerprints of one key are compared as one piece of work; it changes no result.
    """
    spark = distinct.sparkSession
    width = [BITS // (radius + 2) + (k < BITS % (radius + 2)) for k in range(radius + 2)]
    start = np.concatenate([[0], np.cumsum(width)]).tolist()

    def block(k: int):
        return F.shiftrightunsigned("fingerprint", start[k]).bitwiseAND(F.lit((1 << width[k]) - 1))

    pairs = list(combinations(range(len(width)), 2))
    keys = F.array(*(F.shiftleft(F.lit(n).cast("long"), 56) + F.shiftleft(block(a), 28) + block(b) for n, (a, b) in enumerate(pairs)))
    filed = distinct.select("fingerprint", F.explode(keys).alias("key"))
    crowded = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    crowded = write_once(crowded.select("key", F.ceil(F.col("n") / cell).cast("int").alias("parts")), "crowded")
    # A key of p parts has a cell for each two of its parts and one for each part with itself.
    own = F.pmod(F.xxhash64("fingerprint"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    cut = filed.join(crowded, "key", "left").select("key", "fingerprint", F.coalesce("parts", F.lit(1)).alias("parts"), own.alias("own"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = cut.select("key", "fingerprint", "own", F.explode(other).alias("other")).select(
        "key",
        (F.least("own", "other").cast("long") * 2147483648 + F.greatest("own", "other")).alias("cell"),
        "fingerprint",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(cells.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell"), _links(radius, 48), "u long, v long")


def near_duplicates(rows: DataFrame, id_column: str = "doc_id", radius: int = 3) -> DataFrame:
    """One row for each distinct ``fingerprint`` of ``rows``: fingerprint, root (its group's
    smallest fingerprint) and component_id, the smallest id in the group.

    Null ids are passed over when the smallest is sought; a group of only null ids has a null component_id.
    """
    distinct = write_once(rows.groupBy("fingerprint").agg(F.min(id_column).alias("least")), "fingerprints")
    roots = components(links(distinct, radius))
    rooted = write_once(
        distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"), "rooted"
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fingerprint", "root", "component_id")


def classes(documents: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hex digits), component_id.

    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows stay repeated. An empty
    table gives an empty result; other columns of ``documents`` are not looked at.
    """
    rows = write_once(fingerprints(documents, ["doc_id"], shingle, seed), "simhash")
    found = write_once(near_duplicates(rows, "doc_id", radius), "classes")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return rows.join(found.drop("root"), "fingerprint").select("doc_id", hexed, "component_id")


def _write_marks(rows: DataFrame, folder: str) -> None:
    """One small file for each block of rows (the upper bits of their number): the places within the block, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def save(block: int, places: np.ndarray) -> None:
            bits = np.zeros(int(places.max()) + 1, dtype=bool)
            bits[places] = True
            write_file(folder, f"{block}.bits", lambda out: out.write(np.packbits(bits, bitorder="little").tobytes()), same_name=True)

        rest = np.zeros(0, dtype=np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.asarray(batch.column(0))])
            cuts = np.flatnonzero(np.diff(rest >> _BLOCK)) + 1
            for part in np.split(rest, cuts)[:-1]:
                save(int(part[0] >> _BLOCK), part & ((1 << _BLOCK) - 1))
            rest = rest[cuts[-1] :] if len(cuts) else rest
        if len(rest):
            save(int(rest[0] >> _BLOCK), rest & ((1 << _BLOCK) - 1))
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["row"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("block", F.shiftright("row", _BLOCK)).repartition(parts, "block").sortWithinPartitions("row").select("row")
    arrow_map(dealt, run, "row long").write.format("noop").mode("overwrite").save()


def _marked(batch: pa.RecordBatch, place: int, folder: str, known: dict[int, np.ndarray]) -> pa.Array:
    numbers = np.asarray(batch.column(place))
    stay = np.zeros(len(numbers), dtype=bool)
    for block in np.unique(numbers >> _BLOCK).tolist():
        if block not in known:
            known.clear()
            system, path = open_folder(folder)
            if system.get_file_info(f"{path}/{block}.bits").type == FileType.NotFound:
                known[block] = np.zeros(0, dtype=bool)
            else:
                with system.open_input_stream(f"{path}/{block}.bits") as source:
                    known[block] = np.unpackbits(np.frombuffer(source.read(), dtype=np.uint8), bitorder="little").astype(bool)
        own = np.flatnonzero(numbers >> _BLOCK == block)
        at, bits = numbers[own] & ((1 << _BLOCK) - 1), known[block]
        stay[own[at < len(bits)]] = bits[at[at < len(bits)]]
    return pa.array(stay)


def keep_one(documents: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """The documents with one row of each group of near-duplicates left: that of the smallest doc_id, any one if it repeats.

    Columns stay as they are, whatever their names. Rows get a number first and are written with it, so which of several
    equal rows stays cannot change between two reads. Texts are never shuffled: which rows stay is written as one small
    file of bits for each block of numbers, and the tasks that read the rows read the files they need.
    """
    number = unused_name(documents, "row_number_in_table")
    numbered = write_once(documents.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = write_once(fingerprints(numbered.select(F.col(number).alias("row"), "doc_id", "text"), ["row", "doc_id"], shingle, seed), "simhash")
    # Null ids come after every number, and the row number breaks ties.
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row")
    firsts = rows.groupBy("fingerprint").agg(F.min(order).alias("first"))
    groups = near_duplicates(rows, "doc_id", radius)
    stay = firsts.join(groups, "fingerprint").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    folder, place = shared_folder(documents.sparkSession, "survivors"), len(documents.columns)
    _write_marks(stay, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                stay = batch.filter(_marked(batch, place, folder, known))
                yield pa.RecordBatch.from_arrays(stay.columns[:place], names=stay.schema.names[:place])

    return arrow_map(numbered, run, documents.schema)
