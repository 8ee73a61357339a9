"""Exact dedup by a tree merge of sorted digest runs.

Every partition sorts the digests of its texts to runs with one entry for each digest. Runs are then exchanged in rounds
over nodes numbered in binary: in each round a node exchanges with the nodes whose number differs in the next few bits
only, sending each the entries whose digest carries that node's bits, and merges the runs that it receives into one, again
with one entry for each digest. After the last round a node holds, fully merged, the digests that begin with its number;
so no node holds more than its share, and a group of copies of any size takes one entry of a run at any level.

A run travels in blocks of entries. Blocks of all runs reach a node in the order of their first digests, so a merge holds
one open block of each run, and what lies before the next block's first digest is final. Entries are the same only if
SHA-256 and length are; the smallest (or largest) identifier is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, column_of, frugal, stash

#: Bits of the node number that one round settles: runs of up to eight nodes meet in one merge.
ROUND_BITS = 3
#: Entries (56 bytes each) that one run is sorted from at most, and those of a block.
RUN_ENTRIES, BLOCK_ENTRIES = 1 << 18, 1 << 12
#: SHA-256 and then the length, its first byte first, so that bytes order entries.
_ENTRY = np.dtype([("key", "S40"), ("id", "<i8"), ("n", "<i8")])
_BLOCK = "node int, first binary, entries binary"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(text: Column) -> tuple[Column, Column]:
    """The SHA-256 of a text with A-Z lower-cased (null as empty), and its bytes."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.unhex(F.sha2(plain.cast("binary"), 256)), F.octet_length(plain).cast("long")


def _united(entries: np.ndarray, smallest: bool) -> np.ndarray:
    """Sorted entries, one of each key: the best id and the sum of counts."""
    if not len(entries):
        return entries
    key = entries["key"]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out = entries[at].copy()
    out["id"] = (np.minimum if smallest else np.maximum).reduceat(entries["id"], at)
    out["n"] = np.add.reduceat(entries["n"], at)
    return out


def _merged(runs: list[np.ndarray], smallest: bool) -> np.ndarray:
    """Sorted runs to one: a stable sort joins runs as they stand."""
    every = np.concatenate(runs)
    return _united(every[np.argsort(every["key"], kind="stable")], smallest)


def _heads(entries: np.ndarray) -> np.ndarray:
    """The first 32 bits of each key."""
    return np.ascontiguousarray(entries).view(np.uint8).reshape(len(entries), -1)[:, :4].copy().view(">u4").ravel().astype(np.int64)


def _sent(entries: np.ndarray, node: int, bits: int, low: int) -> Iterator[pa.RecordBatch]:
    """A node's sorted entries as blocks for the nodes that it sends to in the round that settles the bits from low on."""
    mask = ((1 << min(ROUND_BITS, bits - low)) - 1) << low
    to = node & ~mask | _heads(entries) >> 32 - bits & mask
    for t in np.unique(to):
        own = entries[to == t]
        blocks = [own[k : k + BLOCK_ENTRIES].tobytes() for k in range(0, len(own), BLOCK_ENTRIES)]
        yield pa.RecordBatch.from_pydict({"node": pa.array([int(t)] * len(blocks), pa.int32()), "first": pa.array([x[:40] for x in blocks], pa.binary()), "entries": pa.array(blocks, pa.binary())})


def _runs(bits: int, smallest: bool, worst: int):
    """Rows (digest, length, id) to blocks of sorted runs, sent for the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() & (1 << bits) - 1
        held, n = [], 0
        for batch in batches:
            entries = np.zeros(batch.num_rows, _ENTRY)
            raw = entries.view(np.uint8).reshape(batch.num_rows, -1)
            raw[:, :32] = np.frombuffer(b"".join(column_of(batch, "_digest").to_pylist()), np.uint8).reshape(-1, 32)
            raw[:, 32:40] = column_of(batch, "_length").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            entries["id"], entries["n"] = column_of(batch, "id").fill_null(worst).to_numpy(), 1
            held.append(entries)
            n += len(entries)
            if n >= RUN_ENTRIES:
                yield from _sent(_merged(held, smallest), node, bits, 0)
                held, n = [], 0
        if n:
            yield from _sent(_merged(held, smallest), node, bits, 0)

    return run


def _exchanged(bits: int, low: int, smallest: bool, worst: int):
    """Blocks of a partition, sorted by node and first key, merged; sent on for the round from low on, or, after the last
    round, as one row for each digest."""

    def out(entries: np.ndarray, node: int) -> Iterator[pa.RecordBatch]:
        if low < bits:
            yield from _sent(entries, node, bits, low)
            return
        raw = np.ascontiguousarray(entries).view(np.uint8).reshape(len(entries), -1)
        for k in range(0, len(entries), 10_000):
            part, r = entries[k : k + 10_000], raw[k : k + 10_000]
            digests = pa.Array.from_buffers(pa.binary(32), len(part), [None, pa.py_buffer(r[:, :32].tobytes())]).cast(pa.binary())
            lengths = r[:, 32:40].copy().view(">i8").ravel().astype(np.int64)
            yield pa.RecordBatch.from_pydict({"_digest": digests, "_length": pa.array(lengths), "keep_id": pa.array(part["id"], mask=part["id"] == worst), "group_size": pa.array(part["n"])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, pool, n = None, [], 0
        for batch in batches:
            for to, first, blob in zip(column_of(batch, "node").to_pylist(), column_of(batch, "first").to_pylist(), column_of(batch, "entries"), strict=True):
                if to != node and pool:
                    yield from out(_merged(pool, smallest), node)
                    pool, n = [], 0
                node = to
                if n >= 8 * BLOCK_ENTRIES:
                    every = _merged(pool, smallest)
                    cut = int(np.searchsorted(every["key"], np.frombuffer(first, "S40")[0]))
                    if cut:
                        yield from out(every[:cut], node)
                    pool, n = [every[cut:]], 0  # counted anew: what stays open is merged again only after as much has come
                pool.append(np.frombuffer(blob.as_buffer(), _ENTRY))
                n += len(pool[-1])
        if pool:
            yield from out(_merged(pool, smallest), node)

    return run


def groups_of(digests: DataFrame, id_column: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row for each digest of digests (an id, _digest and _length, by digest_of()): _digest, _length, keep_id, group_size."""
    spark, smallest = digests.sparkSession, keep == "smallest"
    worst = 2**63 - 1 if smallest else 1 - 2**63  # stands for a missing id
    bits = max(1, (max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length())
    blocks = digests.select("_digest", "_length", F.col(id_column).cast("long").alias("id")).mapInArrow(frugal(_runs(bits, smallest, worst)), _BLOCK)
    for low in range(ROUND_BITS, bits + ROUND_BITS, ROUND_BITS):
        low = min(low, bits)
        schema = _BLOCK if low < bits else "_digest binary, _length long, keep_id long, group_size long"
        blocks = blocks.repartitionById(1 << bits, F.col("node")).sortWithinPartitions("node", "first")
        blocks = blocks.mapInArrow(frugal(_exchanged(bits, low, smallest, worst)), schema)
    return blocks


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each row of docs: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as the empty text. Of equal texts the row with the
    largest (or smallest) id stays. Rows without an id never stay where another row has one; where none has, keep_id
    is null and all stay. Rows that repeat an id with an equal text are one document and share the decision.
    An empty table gives no rows; further columns are ignored."""
    digest, length = digest_of(F.col(text))
    rows = stash(docs.select(F.col(id_column).cast("long").alias(id_column), digest.alias("_digest"), length.alias("_length")), "digests")
    groups = stash(groups_of(rows, id_column, keep), "groups")
    joined = attach(rows.select(id_column, "_digest"), groups.filter("group_size > 1").drop("_length"), "_digest", rows.count())
    keep_id = F.when(F.col("group_size").isNull(), F.col(id_column)).otherwise(F.col("keep_id"))
    return joined.select(
        id_column,
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col(id_column)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


#: Rows (some 50 bytes each) up to which dropped documents are broadcast to the rows that they are dropped from.
BROADCAST_ROWS = 1_000_000


def without(rows: DataFrame, losers: DataFrame, keys: list[str]) -> DataFrame:
    """rows but for those whose keys are in losers; a broadcast if its size allows, else a shuffle of both."""
    losers = stash(losers, "losers")
    return rows.join(F.broadcast(losers) if losers.count() <= BROADCAST_ROWS else losers, keys, "left_anti")


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that exact_duplicates() keeps, all their columns; rows that repeat an id and text are one."""
    decided = stash(exact_duplicates(docs, id_column, text, keep), "decided")
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), digest_of(F.col(text))[0].alias("_digest"), F.struct("*").alias("_row"))
    digest = F.unhex("text_sha256").alias("_digest")
    out = _anti(rows, decided.filter("NOT kept").select(F.col(id_column).alias("_id"), digest))
    again = decided.filter("kept AND group_size > 1").groupBy(id_column, "text_sha256").count().filter("count > 1")
    if again.take(1):
        out = out.dropDuplicates(["_id", "_digest"])
    return out.select("_row.*")


def _anti(rows: DataFrame, losers: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.hex("_digest")).alias("_key")
    return without(rows.select("*", key), losers.select(key), ["_key"])
