"""Which 64-bit keys occur more than once over all chunks of rows, asked and answered in blobs.

A chunk is a row with an id and its keys packed as little-endian uint64. Each chunk sends every hash bucket its sorted
distinct keys with their counts; a bucket adds up and replies to each chunk with its keys that occur at least twice, and
how often. So a key that stands in a third of all rows is one entry for each chunk, and keys that occur once, the most
by far, are neither rows nor come back. Buckets have about a million keys whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, frugal, give_back

BUCKET_KEYS = 1 << 20


def u64(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def shared_keys(chunks: DataFrame) -> DataFrame:
    """chunks: chunk long, keys binary (read again here, so stored). Returns chunk, shared (binary, uint64) and counts
    (binary, uint32): a chunk's keys that occur at least twice, in several rows."""
    spark = chunks.sparkSession
    total = chunks.agg(F.sum(F.length("keys"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * BUCKET_KEYS)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(column_of(batch, "chunk").to_pylist(), column_of(batch, "keys"), strict=True):
                keys, counts = np.unique(np.frombuffer(blob.as_buffer(), "<u8"), return_counts=True)
                at = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                keys, counts, at = keys[order], counts[order].astype("<u4"), at[order]
                cut = np.searchsorted(at, np.arange(buckets + 1))
                full = np.flatnonzero(cut[1:] > cut[:-1])
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(full, pa.int32()),
                        "chunk": pa.array(np.full(len(full), chunk), pa.int64()),
                        "keys": pa.array([keys[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()),
                        "counts": pa.array([b"" if (c := counts[cut[i] : cut[i + 1]]).max() == 1 else c.tobytes() for i in full], pa.binary()),
                    }
                )

    def reply(table: pa.Table) -> pa.Table:
        blobs = [u64(x) for x in table.column("keys").to_pylist()]
        counts = [np.frombuffer(c, "<u4") if c else np.ones(len(k), "<u4") for c, k in zip(table.column("counts").to_pylist(), blobs, strict=True)]
        keys, n = np.concatenate(blobs), np.concatenate(counts).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], begin), np.diff(np.append(begin, len(keys))))
        out, at = [], 0
        for chunk, k in zip(table.column("chunk").to_pylist(), blobs, strict=True):
            t = total[at : at + len(k)]
            at += len(k)
            if (go := t > 1).any():
                out.append((chunk, k[go].tobytes(), np.minimum(t[go], 2**32 - 1).astype("<u4").tobytes()))
        give_back()
        return pa.Table.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["chunk", "shared", "counts"])

    asked = chunks.select("chunk", "keys").mapInArrow(frugal(ask), "bucket int, chunk long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInArrow(reply, "chunk long, shared binary, counts binary")


def lookup(sorted_keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    """values of wanted among sorted_keys, default for others."""
    if not len(sorted_keys):
        return np.full(len(wanted), default, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, values[at].astype(np.int64), default)


def replies_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All replies to one chunk as sorted keys and their counts."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    keys = np.concatenate([u64(x) for x in table.column("shared").to_pylist()])
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
    order = np.argsort(keys)
    return keys[order], counts[order]
