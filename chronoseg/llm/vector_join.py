"""Near duplicates among embeddings by p-stable hashing.

Vectors are brought to length 1, so that a cosine c is a Euclidean distance of sqrt(2 - 2c). A hash of a table is k
quantised projections floor((a x + b) / w) with normal a; two vectors of distance d agree on one with a probability that
falls with d / w. k is chosen from the number of vectors, so that a bucket holds few unrelated ones, and the number of
tables so that a pair at the threshold shares a bucket with the wanted probability; nearer pairs do with a larger one.
Pairs in a bucket are checked by their cosine in double precision.

Equal vectors are one vector with a multiplicity. A pair that shares several buckets counts in its first table only,
which is found from the hashes of both, so no pair is a row: buckets send sums of links and the edges of spanning trees.
Buckets are dealt to cells of at most two blocks, so a bucket of any size is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cells, column_of, stash
from .components import components, union_find

#: Width of a quantisation step.
WIDTH = 2.5
#: Wanted probability that a pair at the threshold shares a bucket, and the unrelated vectors that a bucket may hold.
RECALL, STRANGERS = 0.998, 0.05
#: Vectors of a block of a bucket.
BLOCK = 1024


def agreement(distance: float, width: float = WIDTH) -> float:
    """The probability that one quantised projection agrees."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


class Hasher:
    """Hashes of `tables` tables of k projections each, the same in every process."""

    def __init__(self, dim: int, n: int, cosine: float, seed: int = 7):
        near, far = agreement(math.sqrt(2 - 2 * cosine)), agreement(math.sqrt(2.0))
        self.k = max(4, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(far)))
        self.tables = math.ceil(math.log(1 - RECALL) / math.log(1 - near**self.k))
        self.dim, self.seed = dim, seed

    def __getstate__(self):
        return {x: self.__dict__[x] for x in ("k", "tables", "dim", "seed")}

    def keys(self, x: np.ndarray) -> np.ndarray:
        """A 64-bit hash for each row of x (length 1) and table."""
        if "planes" not in self.__dict__:
            rng = np.random.Generator(np.random.PCG64(self.seed))
            self.planes = rng.standard_normal((self.dim, self.tables * self.k)) / WIDTH
            self.shift = rng.random(self.tables * self.k)
            self.factor = rng.integers(1, 2**63, self.k, dtype=np.uint64) | np.uint64(1)
        cell = np.floor(x @ self.planes + self.shift).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            cell = cell.reshape(len(x), self.tables, self.k) * self.factor
            h = cell[:, :, 0].copy()
            for i in range(1, self.k):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cell[:, :, i]
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashes(hasher: Hasher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                part = batch.slice(a, 250)
                keys = hasher.keys(_matrix(column_of(part, "v"), hasher.dim))
                n = part.num_rows
                yield pa.RecordBatch.from_pydict(
                    {"rep": pa.array(np.repeat(column_of(part, "rep").to_numpy(), hasher.tables)), "no": pa.array(np.tile(np.arange(hasher.tables, dtype=np.int32), n)), "h": pa.array(keys.ravel())}
                )

    return run


def _rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])


def _links(hasher: Hasher, cosine: float):
    """Rows sorted by cell (no, h, cell_a, cell_b) to sums of links (a = rep, n) and edges (a, b, n = 0)."""

    def pairs(begin: np.ndarray, size: np.ndarray, x: np.ndarray, apart: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The near pairs of rows of all cells; cells of one size at a time, as many as fit some megabytes."""
        out = [np.zeros((2, 0), np.int64)]
        for m in np.unique(size):
            every = begin[size == m]
            step = max(1, (1 << 21) // int(m * max(m, hasher.dim)))
            for k in range(0, len(every), step):
                rows = every[k : k + step, None] + np.arange(m)
                v = x[rows]
                c, i, j = np.nonzero(np.triu(v @ v.transpose(0, 2, 1) >= cosine, 1))
                i, j = rows[c, i], rows[c, j]
                go = ~apart[i] | (block[i] != block[j])
                out.append(np.stack([i[go], j[go]]))
        return np.concatenate(out, axis=1)

    def counted(i: np.ndarray, j: np.ndarray, no: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Which pairs share no bucket of an earlier table, where they are counted."""
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = np.concatenate([hasher.keys(x[used[a : a + 250]]) for a in range(0, len(used), 250)])
        i, j = at[: len(i)], at[len(i) :]
        first = np.empty(len(i), bool)
        for a in range(0, len(i), 1 << 14):
            part = slice(a, a + (1 << 14))
            first[part] = ~((keys[i[part]] == keys[j[part]]) & (np.arange(hasher.tables) < no[part, None])).any(1)
        return first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if left is not None:
                batch = pa.Table.from_batches([left, batch.cast(left.schema)]).combine_chunks().to_batches()[0]
            yield from whole(batch, False)
            left = batch.slice(whole.cut)
        if left is not None:
            yield from whole(left, True)

    def whole(batch: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
        key = np.stack([column_of(batch, c).to_numpy() for c in ("no", "h", "cell_a", "cell_b")], 1)
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)])) if len(key) else np.zeros(0, int)
        ends = np.append(cut[1:], batch.num_rows)
        if not last:  # the last cell may go on in the next batch
            cut, ends, whole.cut = cut[:-1], ends[:-1], int(cut[-1]) if len(cut) else 0
        cut, ends = cut[ends - cut > 1], ends[ends - cut > 1]
        if not len(cut):
            return
        rep, times, block = (column_of(batch, c).to_numpy() for c in ("rep", "times", "block"))
        x = _matrix(column_of(batch, "v"), hasher.dim)
        i, j = pairs(cut, ends - cut, x, key[:, 2] != key[:, 3], block)
        if not len(i):
            return
        first = counted(i, j, key[i, 0], x)
        i, j = i[first], j[first]
        nodes, at = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
        n = np.bincount(at, np.concatenate([times[j], times[i]]), len(nodes)).astype(np.int64)
        yield from _rows(nodes, np.full(len(nodes), -1, np.int64), n)
        nodes, label = union_find(rep[i], rep[j])
        yield from _rows(nodes[nodes != label], label[nodes != label], np.zeros(int((nodes != label).sum()), np.int64))

    return run


def linked_vectors(vectors: DataFrame, cosine: float = 0.95, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for each row of vectors: the id, n_links, component_id, kept.

    Rows link if the cosine of their vectors is at least `cosine`; none below it link, and pairs at the threshold are
    found with probability RECALL, nearer ones with more. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, nor do those of different dimensions with each other. Rows that repeat an id are rows
    of their own; a row without an id links, and counts for no smallest id. An empty table gives no rows."""
    spark = vectors.sparkSession
    v = F.col(column).cast("array<double>")
    fine = F.col(column).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.when(fine, v).alias("v")).withColumn("h", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)))
    rows = stash(rows, "vectors")
    single = stash(rows.filter("v IS NOT NULL").withColumn("rid", F.monotonically_increasing_id()).groupBy("h").agg(F.min("rid").alias("rep"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("group_size"), F.first("v").alias("v")), "single")
    edges, sums = [], []
    for dim, n in sorted(tuple(r) for r in single.groupBy(F.size("v")).count().collect()):  # one row for each dimension
        hasher = Hasher(dim, n, cosine)
        own = single.filter(F.size("v") == dim).select("rep", F.col("group_size").alias("times"), "v")
        keys = stash(own.select("rep", "v").mapInArrow(_hashes(hasher), "rep long, no int, h long"), "hashes")
        buckets = stash(keys.groupBy("no", "h").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").select(F.struct("no", "h").alias("bucket"), "group_size"), "buckets")
        placed = attach(keys.select("rep", F.struct("no", "h").alias("bucket")), buckets, "bucket", n * hasher.tables).filter("group_size IS NOT NULL")
        placed = cells(placed, "group_size", "rep", BLOCK).join(own, "rep")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
        placed = placed.select("bucket.no", "bucket.h", "cell_a", "cell_b", "block", "rep", "times", "v").repartition(parts, "no", "h", "cell_a", "cell_b").sortWithinPartitions("no", "h", "cell_a", "cell_b")
        found = stash(placed.mapInArrow(_links(hasher, cosine), "a long, b long, n long"), "links")
        sums.append(found.filter("b < 0").groupBy("a").agg(F.sum("n").alias("others")))
        edges.append(found.filter("b >= 0").select("a", "b"))
    out = single.select("h", "rep", "least_id", "group_size")
    if edges:
        all_edges, all_sums = edges[0], sums[0]
        for e, s in zip(edges[1:], sums[1:], strict=True):
            all_edges, all_sums = all_edges.unionByName(e), all_sums.unionByName(s)
        labels = components(all_edges)
        out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(all_sums.withColumnRenamed("a", "rep"), "rep", "left")
    else:
        out = out.withColumns({"label": F.lit(None).cast("long"), "others": F.lit(0).cast("long")})
    out = out.select("h", "least_id", "group_size", F.coalesce("label", "rep").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("group_size") - 1).alias("n_links"))
    least = out.groupBy("root").agg(F.min("least_id").alias("component_id"))
    out = stash(out.join(least, "root").select("h", "group_size", "n_links", "component_id"), "placed")
    joined = attach(rows.select("id", "h"), out, "h", rows.count())
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
