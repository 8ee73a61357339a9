"""What several operators share: the shared folder, joins on hot keys, and hashing of words in bulk."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the controls 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder and a cluster
    one beside its warehouse, which all machines see."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.startswith("local["):
            at = "file://" + tempfile.mkdtemp(prefix="chronoseg-")
        else:
            at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_chronoseg"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as a table in the shared folder and read it: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chronoseg-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.setdefault(id(spark), (spark, []))[1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def drop(*stashes: DataFrame) -> None:
    """Delete tables of stash() that nothing reads any more."""
    for df in stashes:
        _delete(df.sparkSession, df._stash)


_PATHS: dict[int, tuple[SparkSession, list[str]]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, paths in _PATHS.values():
        for path in paths:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the session may have ended before
                return


def tuned(spark: SparkSession, batch_bytes: int | None = None) -> None:
    """Small Arrow batches: a batch of long texts must fit beside the JVM. With batch_bytes, a batch ends at so many bytes
    too (a longer row is one of its own), and what a batch takes no longer grows with the length of its texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if batch_bytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    else:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of what the driver holds. Made of Arrow columns: rows of Python objects would go through Python workers of
    another kind, which stay on every executor beside those of the functions."""
    return spark.createDataFrame(pa.table(columns))


def attach(rows: DataFrame, groups: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Left join of rows with groups on key, whatever the skew. groups has a unique key and group_size, the number of
    rows of that key; keys may be absent. A group of a thousandth of all rows or more is hot: there are
    at most 1000 such, as sizes add up to n_rows, so these are broadcast and no shuffled key has more rows than that."""
    at = max(2, n_rows // 1000)
    hot = F.broadcast(groups.filter(F.col("group_size") >= at))
    cold = groups.filter(F.col("group_size") < at)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key, "left")
    return rows.join(hot, key).unionByName(rest)


def cells(rows: DataFrame, size: str, item: str, most: int) -> DataFrame:
    """Split groups for work on their pairs: a group of more than `most` rows (its rows are in column size) has its rows
    dealt to blocks by a hash of item, and each pair of blocks is a cell. Adds block, cell_a and cell_b, a row for each
    cell that needs it. A pair is looked at in one cell: two rows of block b in (b, b), of a < b in (a, b)."""
    g = F.greatest(F.ceil(F.col(size) / most), F.lit(1)).cast("int")
    rows = rows.withColumn("_g", g).withColumn("block", F.pmod(F.xxhash64(item), F.col("_g")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return rows.withColumn("cell_a", F.least("block", "_other")).withColumn("cell_b", F.greatest("block", "_other")).drop("_g", "_other")


def hash_sample(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """`most` distinct rows by key and text, those with the smallest hash of the two, with the hash as _h (a table of many
    repeated rows may give fewer). A range of hashes that holds about four times as many is cut out first and only hashes
    are sorted, so no task gets more than that and texts stay where they are."""
    n = rows.count()
    own = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit("")))
    near = rows.withColumn("_h", F.shiftrightunsigned(own, 1))
    if n > 8 * most:
        near = near.filter(F.col("_h") < int(2.0**63 * 4 * most / n))
    last = near.select("_h").distinct().orderBy("_h").limit(most).agg(F.max("_h")).first()[0]
    return near.filter(F.col("_h") <= F.lit(last).cast("long")).dropDuplicates(["_h"])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row begins (one more than rows); null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut rows into ranges of at most `most` bytes, or of one row where that alone is longer."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and where each row's words begin (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    white = WHITE[data]
    inside = ~white
    first, last = inside.copy(), inside.copy()
    first[1:] &= white[:-1]
    last[:-1] &= white[1:]
    full = off[1:] > off[:-1]
    a, b = off[:-1][full], off[1:][full] - 1
    first[a], last[b] = inside[a], inside[b]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, off)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, r in enumerate((_R, _R_INV)):
                x = np.full(max(n, 1 << 20), r, np.uint64)
                x[0] = 1
                _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word data[s:e]; lower: of A-Z lower-cased. A polynomial modulo 2**64 over random byte
    values, by differences of one running sum, then mixed."""
    if not len(s):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[data] * up[: len(data)], out=total[1:])
        return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, whatever row they are in; empty where there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=total[1:])
        k = len(words) - n + 1
        return mix((total[n:] - total[:k]) * down[:k])


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, beside the JVM, and the next stage needs it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library: nothing to trim by


def frugal(run):
    """A function of batches that gives memory back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def crc_mod3(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3))
