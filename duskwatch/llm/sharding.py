"""Shards of near-equal size from indivisible groups, by Karmarkar-Karp differencing in levels.

A partial partition is a vector with a size for every shard. Differencing takes the two partial partitions of the largest
spread and adds them oppositely ordered, the largest part of one to the smallest of the other, until one is left. Groups of
equal texts are the first partial partitions, each with all of its bytes in one part.

Groups are dealt by hash into blocks, differenced block by block, and the blocks' vectors are differenced in turn, a bounded
number at a time, up to one root. A few heavy groups would spoil that, since blocks that are level by themselves leave nothing
to fill up around them. So heavy groups (more than one in ``heavy`` of all bytes, hence fewer than ``heavy``) are differenced
first, and every block starts from its share of the room they leave: that vector takes part in the block as one more partial
partition and is taken off its result, which then fits beside the heavy groups. The root starts from the heavy groups.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import unused_name, write_once
from duskwatch.session import scratch_path

HEAVY = 16_384


def difference(items: list[tuple[int, ...]], count: int) -> tuple[list[int], list[bytes]]:
    """Karmarkar-Karp differencing of partial partitions, each given as its parts in descending order (zeros may be left out).

    Returns the sizes of the shards in descending order, and for each item the shard of each of its ``count`` parts.
    """
    if not items:
        return [0] * count, []
    sums = [list(parts) + [0] * (count - len(parts)) for parts in items]
    heap = [(s[-1] - s[0], k) for k, s in enumerate(sums)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, list[int]]] = []
    places = range(count)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        added = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(places, key=added.__getitem__, reverse=True)
        parts = [added[k] for k in order]
        merged.append((a, b, order))
        sums[a] = sums[b] = None
        heapq.heapreplace(heap, (parts[-1] - parts[0], len(sums)))
        sums.append(parts)
    shard: list[bytes | None] = [None] * len(sums)
    shard[-1] = bytes(places)
    for k in range(len(merged) - 1, -1, -1):
        a, b, order = merged[k]
        held = bytearray(count)
        for place, label in zip(order, shard[len(items) + k]):
            held[place] = label
        shard[a] = bytes(held)
        shard[b] = bytes(reversed(held))
        shard[len(items) + k] = None
    return sums[-1], shard[: len(items)]


def room_left(heavy: list[int], light: int) -> list[int]:
    """The heavy parts, cut at the level to which ``light`` more bytes fill all shards up."""
    low = sorted(heavy)
    level = low[-1]
    for k in range(1, len(low) + 1):
        level = (sum(low[:k]) + light) // k
        if k == len(low) or level <= low[k]:
            break
    return [min(h, level) for h in heavy]


def _node(rows: pd.DataFrame, count: int, room: list[int], whole: int) -> pd.DataFrame:
    """Difference one block: rows (child, part, bytes) with the block's share of the room, to rows with their shard."""
    rows = rows.sort_values(["bytes", "child", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    children: dict[object, list[int]] = {}
    for k, child in enumerate(rows["child"].tolist()):
        children.setdefault(child, []).append(k)
    sizes = rows["bytes"].tolist()
    own = sum(sizes)
    seed = sorted((h * own // max(whole, 1) for h in room), reverse=True)
    _, shards = difference([tuple(seed), *(tuple(sizes[k] for k in held) for held in children.values())], count)
    where = [0] * len(sizes)
    for held, shard in zip(children.values(), shards[1:]):
        for k, s in zip(held, shard):
            where[k] = s
    # the order of the shards without the seed decides which is part 0 for the level above
    place = np.array(where)
    total = np.zeros(count, dtype=object)
    for s, size in zip(where, sizes):
        total[s] += size
    rank = np.empty(count, dtype=np.int64)
    rank[sorted(range(count), key=lambda s: (-total[s], s))] = np.arange(count)
    rows["shard"] = rank[place]
    return rows[["node", "child", "part", "bytes", "shard"]]


def balance(groups: DataFrame, count: int, heavy: int = HEAVY, block: int = 16_384, fan: int = 1_024) -> DataFrame:
    """Shards of groups: ``groups`` has key (binary, one row each) and bytes (long); returns key and shard.

    At most ``heavy`` rows and ``count`` numbers go to the driver, a task holds about ``block`` groups or ``fan`` blocks. The
    shards are a function of the groups alone.
    """
    spark = groups.sparkSession
    total, many = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    is_heavy = F.col("bytes") > int(total) // heavy
    top = sorted(((r["bytes"], bytes(r["key"])) for r in groups.where(is_heavy).collect()), key=lambda r: (-r[0], r[1]))
    parts, placed = difference([(size,) for size, _ in top], count)
    heavy_shards = spark.createDataFrame([(key, shard[0]) for (_, key), shard in zip(top, placed)], "key binary, shard int")
    light = int(total) - sum(size for size, _ in top)
    room = room_left(parts, light)
    if not light:
        return heavy_shards

    blocks = max(1, -(-int(many) // block))
    level = groups.where(~is_heavy).select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("node"), F.col("key").alias("child"), F.lit(0).alias("part"), "bytes")
    schema = "node long, child {}, part int, bytes long, shard int"
    levels = []
    while True:
        kind = level.schema["child"].dataType.simpleString()
        done = level.groupBy("node").applyInPandas(lambda rows: _node(rows, count, room, light), schema.format(kind))
        levels.append(write_once(done, "differenced"))
        vectors = levels[-1].groupBy("node", "shard").agg(F.sum("bytes").alias("bytes")).where("bytes > 0")
        level = vectors.select(F.floor(F.col("node") / fan).alias("node"), F.col("node").alias("child"), F.col("shard").alias("part"), "bytes")
        if blocks == 1:
            break
        blocks = -(-blocks // fan)
    # the root has one node, whose vector meets the heavy groups
    vector = {r["part"]: r["bytes"] for r in level.collect()}
    sizes = sorted(vector.items(), key=lambda r: (-r[1], r[0]))
    _, (base, rest) = difference([tuple(parts), tuple(size for _, size in sizes)], count)
    last = {part: shard for (part, _), shard in zip(sizes, rest)}
    found = levels[-1].select("child", "part", F.element_at(F.create_map(*[F.lit(x) for pair in last.items() for x in pair]), F.col("shard")).alias("shard"))
    for lower in reversed(levels[:-1]):
        above = found.select(F.col("child").alias("node"), F.col("part").alias("shard"), F.col("shard").alias("final"))
        found = lower.join(above, ["node", "shard"]).select("child", "part", F.col("final").alias("shard"))
    moved = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(base) for x in (k, s)]), F.col("shard"))
    return found.select(F.col("child").alias("key"), "shard").unionByName(heavy_shards.select("key", moved.alias("shard")))


def keyed(documents: DataFrame) -> tuple[DataFrame, str, str]:
    """``documents`` with the SHA-256 of the text and its UTF-8 bytes plus one, and the names of these two columns.

    A null text is the empty text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, size = unused_name(documents, "group_key"), unused_name(documents, "size")
    return documents.withColumn(key, F.unhex(F.sha2(text.cast("binary"), 256))).withColumn(size, F.octet_length(text).cast("long") + 1), key, size


def assign(rows: DataFrame, key: str, size: str, count: int = 16, hot: int = 1_000) -> DataFrame:
    """Every row with two more columns, shard and slot (with underscores in front where a name is taken).

    ``key`` (binary) names a row's group and ``size`` (long) its bytes. Rows of a group share a shard; sizes of shards are as
    near equal as differencing makes them, which the largest group limits. Slots are gapless from 0 in each shard. Null and
    repeated ids and repeated rows are kept, an empty table gives no row, other columns are carried along.

    Groups with more than one in ``hot`` of all rows, fewer than ``hot``, are broadcast, so that no task of the join has more
    than such a share of one group. The rows are written once; slots number them by file, in files of bounded length.
    """
    shard = unused_name(rows, "shard")
    slot = unused_name(rows, "slot")
    sizes = rows.select(F.col(key).alias("key"), F.col(size).alias("size"))
    groups = write_once(sizes.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    many = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    placed = groups.select("key", (F.col("rows") > int(many) // hot).alias("often")).join(balance(groups.select("key", "bytes"), count), "key")
    placed = write_once(placed, "shards")
    busy = F.broadcast(placed.where("often").select(F.col("key").alias(key), F.col("shard").alias(shard)))
    usual = placed.where("not often").select(F.col("key").alias(key), F.col("shard").alias(shard))
    done = rows.join(busy, key).unionByName(rows.join(busy, key, "left_anti").join(usual, key))
    return numbered(done.select(*rows.columns, shard), shard, slot)


def numbered(rows: DataFrame, shard: str, slot: str, most: int = 500_000) -> DataFrame:
    """``rows`` with a gapless number from 0 within each shard, in the order of the files they are written to.

    A file has at most ``most`` rows, so what is numbered within one file and shard is bounded; the sums over files are small.
    """
    path = scratch_path(rows.sparkSession, "sharded")
    rows.write.option("maxRecordsPerFile", most).parquet(path)
    file, place, before = (unused_name(rows, n) for n in ("_file", "_place", "_before"))
    kept = rows.sparkSession.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    held = kept.groupBy(file, shard).agg(F.count("*").alias(before))
    sums = held.withColumn(before, F.sum(before).over(Window.partitionBy(shard).orderBy(file)) - F.col(before))
    within = F.row_number().over(Window.partitionBy(file, shard).orderBy(place)) - 1
    return kept.withColumn(slot, within.cast("long")).join(sums, [file, shard]).withColumn(slot, F.col(slot) + F.col(before)).select(*rows.columns, slot)


def write_shards(documents: DataFrame, folder: str, count: int = 16) -> None:
    """Write ``documents`` as Parquet, one folder for each shard."""
    rows, key, size = keyed(documents)
    done = assign(rows, key, size, count)
    done.drop(key).write.partitionBy(done.columns[-2]).parquet(folder)
