"""Jaccard self-join on sets of word n-grams, exact, and the components of its links.

A set is its sorted 64-bit gram hashes. Two sets that link share at least need(n) = ceil(t n) grams of either, so each
misses at most n - need(n) of its own. Hence, of the first n - need(n) + l grams of each by any common order, a linked
pair shares l (for the smaller l of the two). This gives steps that lose no link:

1. The heads of all sets, by hash, are asked for how often each gram occurs among heads. A set with fewer than l common
   grams in its head links with nothing; most sets end here. Equal sets become one class.
2. The sets that stay are asked for all their grams. One with fewer than need(n) common grams links with nothing. The
   n - need(n) + 1 rarest grams of the others form the index: per gram, a list of sets by size, with the gram's position.
3. Lists are in order of size and position, and read in pairs of blocks: those are skipped whose sizes are out of reach of
   each other, or whose positions leave too few grams for the overlap that both sizes need; of the others, single pairs
   by the same rules, and those whose parity bitmaps (one bit flipped for each gram) differ in more bits than linked sets
   can have grams apart.

Answers of similar sets are reused: in rounds each set is compared with one set only of the lists it stands in. Once it
links with that, its component is known from the answers of that set, and the two are never paired again with what they
have in common. The rounds end when no set finds a link; step 3 is for sets of one list that are in different components
by then. Where few of a list can link still, they are verified as pairs, no more than the list has sets; where many can,
the sets themselves are sent to the list's cell, all overlaps are counted there at once, and only a forest of the links
leaves it. So neither a group of near copies nor one of texts just below the threshold makes a row for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cells, column_of, drop, frugal, give_back, gram_hashes, pieces, small_table, stash, text_buffers, word_hashes, word_spans
from .components import components, union_find
from .shared_keys import lookup, replies_of, shared_keys

#: Rounds, at most, in which sets are compared with one other each, before all that are still apart are.
ROUNDS = 6
#: Rows of a list that a block of a cell has.
LIST_ROWS = 1024
#: Sets of a block of a list, and grams (columns) of which overlaps are counted at once.
BLOCK, COLUMNS = 64, 4096
#: Sets for chunks of the second step, and the number of keys (8 bytes each) up to which a semi-join is broadcast.
CHUNK_SETS, BROADCAST_KEYS = 500, 1_000_000


#: Bits of a set's parity bitmap: two sets differ in at least as many grams as their bitmaps in bits.
BITS = 512


def parity(grams: np.ndarray) -> np.ndarray:
    odd = np.bincount((grams >> np.uint64(7)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Threshold:
    """Jaccard of at least num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def need(self, n):
        return -(-self.num * n // self.den)

    def extra(self, n):
        """l of a set of n grams: rises with n, at least 1, at most need(n)."""
        return np.maximum(1, (self.den - self.num) * np.asarray(n) // self.den)

    def head(self, n):
        """How many grams of a set's head; at most n where a set may miss less than half of its own."""
        return np.minimum(n, n - self.need(n) + self.extra(n))

    def least(self, n):
        """How many grams a linked pair's heads share, seen from a set of n grams: the smallest partner has need(n)."""
        return self.extra(self.need(n))

    def both(self, a, b):
        """How many grams sets of a and b grams must share to link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def linked(self, both, a, b):
        return self.den * both >= self.num * (a + b - both)


def gram_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row, A-Z lower-cased; of fewer words the whole sequence is one gram."""
    s, e, woff = word_spans(data, off)
    words = word_hashes(data, s, e, lower=True)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(woff[:-1], woff[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else grams[:0])
    return out


_CHUNK = "chunk long, rids binary, doc_ids binary, no_id binary, ks binary, sizes binary, signs binary, lengths binary, keys binary"


def _chunk_row(chunk: int, rids, doc_ids, no_id, ks, sizes, signs: list[bytes], heads: list[np.ndarray]) -> pa.RecordBatch:
    blobs = [rids.astype("<i8").tobytes(), doc_ids.astype("<i8").tobytes(), no_id.astype(np.uint8).tobytes(), ks.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), b"".join(signs)]
    blobs += [np.array([len(h) for h in heads], "<i4").tobytes(), b"".join(h.astype("<u8").tobytes() for h in heads)]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)], ["chunk", "rids", "doc_ids", "no_id", "ks", "sizes", "signs", "lengths", "keys"])


def _scan(n: int, t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, ks = column_of(batch, "id"), column_of(batch, "k").to_numpy()
            no_id, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            data, off = text_buffers(column_of(batch, "text"))
            for a, b in pieces(off):
                sets = gram_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
                sizes = np.array([len(x) for x in sets])
                signs = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                for c in range(0, b - a, 4096):  # a row's number within a chunk has 12 bits
                    part = slice(c, c + 4096)
                    rids = (chunk << 12) + np.arange(len(sizes[part]))
                    yield _chunk_row(chunk, rids, ids[a:b][part], no_id[a:b][part], ks[a:b][part], sizes[part], signs[part], [x[:h] for x, h in zip(sets[part], t.head(sizes[part]), strict=True)])
                    chunk += 1

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["rids"]) // 8
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(row["rids"], "<i8")),
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["no_id"], np.uint8) > 0),
                    pa.array(np.frombuffer(row["sizes"], "<i8")),
                    pa.array([row["signs"][16 * i : 16 * i + 16] for i in range(n)], pa.binary()),
                ],
                ["rid", "id", "n", "sign"],
            )


def _survivors(t: Threshold):
    """A chunk and the replies to it: the sets whose heads have enough common grams."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared, counts = replies_of(right)
        kept = []
        for row in left.to_pylist():
            rids, ks, sizes = (np.frombuffer(row[x], "<i8") for x in ("rids", "ks", "sizes"))
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<i4"))])
            total = np.concatenate([[0], np.cumsum(lookup(shared, counts, np.frombuffer(row["keys"], "<u8"), 1) > 1)])
            stay = (sizes > 0) & (total[ends[1:]] - total[ends[:-1]] >= t.least(sizes))
            kept.append((rids[stay], ks[stay]))
        return pa.Table.from_arrays([pa.array(np.concatenate([x[i] for x in kept]) if kept else np.zeros(0, np.int64)) for i in range(2)], ["rid", "k"])

    return run


def _index(t: Threshold):
    """The same for whole sets: the common grams of their prefixes by rarity, with their positions."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared, counts = replies_of(right)
        out, bits = [(np.zeros(0, np.int64),) * 4], [np.zeros((0, BITS // 64), np.int64)]
        for row in left.to_pylist():
            rids = np.frombuffer(row["rids"], "<i8")
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<i4"))])
            keys = np.frombuffer(row["keys"], "<u8")
            often = lookup(shared, counts, keys, 1)
            for i, rid in enumerate(rids):
                grams, rate = keys[ends[i] : ends[i + 1]], often[ends[i] : ends[i + 1]]
                n, need = len(grams), t.need(len(grams))
                alone = int((rate == 1).sum())
                if n - alone < need:
                    continue
                order = np.argsort(rate, kind="stable")[alone : n - need + 1]
                out.append((grams[order].view(np.int64), np.full(len(order), rid), np.full(len(order), n), alone + np.arange(len(order))))
                bits.append(np.repeat(parity(grams)[None], len(order), 0))
        flat = np.concatenate(bits)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * (BITS // 64), pa.int32()), pa.array(flat.ravel()))
        return pa.Table.from_arrays([*(pa.array(np.concatenate([x[i] for x in out])) for i in range(4)), lists], ["gram", "rid", "n", "position", "bits"])

    return run


def _set_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 24
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK_SETS):
            part = batch.slice(a, CHUNK_SETS)
            grams = column_of(part, "grams").to_pylist()
            lengths = np.array([len(x) // 8 for x in grams], "<i4")
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in (column_of(part, "rid").to_numpy().astype("<i8").tobytes(), lengths.tobytes(), b"".join(grams)))], ["chunk", "rids", "lengths", "keys"])
            chunk += 1


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(column_of(batch, "text"))
            rid = column_of(batch, "rid")
            for a, b in pieces(off):
                sets = gram_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], n)
                yield pa.RecordBatch.from_arrays([rid.slice(a, b - a), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], ["rid", "grams"])

    return run


def _verify(t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            go = []
            for x, y in zip(column_of(batch, "x"), column_of(batch, "y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                go.append(t.linked(both, len(x), len(y)))
            yield pa.RecordBatch.from_arrays([column_of(batch, "a"), column_of(batch, "b")], ["a", "b"]).filter(pa.array(go, pa.bool_()))

    return run


def _able(t: Threshold, i: slice, j: slice, n, rest, comp, block, bits) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of two blocks of a list (by size) that can link: by components, cells, sizes, positions, parities."""
    ni, nj = n[i, None], n[None, j]
    need = t.both(ni, nj)
    go = (np.maximum(ni, nj) * t.num <= np.minimum(ni, nj) * t.den) & (np.minimum(rest[i, None], rest[None, j]) >= need) & (comp[i, None] != comp[None, j])
    if block is not None:
        go &= block[i, None] != block[None, j]
    if i == j:
        go = np.triu(go, 1)
    x, y = np.nonzero(go)
    x, y = x + i.start, y + j.start
    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
    near = apart <= n[x] + n[y] - 2 * t.both(n[x], n[y])
    return x[near], y[near]


def _open(t: Threshold):
    """Rows of a bucket of cells (gram, cell_a, cell_b, block, rid, n, position, comp) to what is to be verified of each
    cell's list: of sets in different components that can link, the pairs (a, b), if there are no more than sets in the
    list; else the sets (a) that stand in any, with the cell, to be compared there.

    Lists are in order of size and then position, and cut to blocks. A pair of blocks is skipped by its smallest sizes and
    by its latest positions: a pair need only be found at its first common gram, and what follows there bounds its overlap."""

    def run(table: pa.Table) -> pa.Table:
        gram, ca, cb, block, rid, n, position, comp = (table.column(x).to_numpy() for x in ("gram", "cell_a", "cell_b", "block", "rid", "n", "position", "comp"))
        order = np.lexsort((rid, position, n, cb, ca, gram))
        every_bits = table.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, BITS // 64).view(np.uint64)[order]
        gram, ca, cb, block, rid, n, position, comp = (x[order] for x in (gram, ca, cb, block, rid, n, position, comp))
        cut = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])]))
        pairs, sets = [np.zeros((0, 2), np.int64)], [np.zeros((0, 4), np.int64)]
        for a, b in zip(cut, np.append(cut[1:], len(gram)), strict=True):
            m = b - a
            if m < 2 or (comp[a:b] == comp[a]).all():
                continue
            sizes, rest = n[a:b], n[a:b] - position[a:b]
            begin = np.arange(0, m, BLOCK)
            smallest, largest, most = sizes[begin], sizes[np.minimum(begin + BLOCK, m) - 1], np.maximum.reduceat(rest, begin)
            of = sizes, rest, comp[a:b], block[a:b] if ca[a] != cb[a] else None, every_bits[a:b]
            found, count, open_ = [], 0, np.zeros(m, bool)
            for i in range(len(begin)):
                reached = int(np.searchsorted(smallest, largest[i] * t.den // t.num, "right"))
                for j in i + np.flatnonzero(np.minimum(most[i], most[i:reached]) >= t.both(smallest[i], smallest[i:reached])):
                    x, y = _able(t, slice(begin[i], min(begin[i] + BLOCK, m)), slice(begin[j], min(begin[j] + BLOCK, m)), *of)
                    open_[x] = open_[y] = True
                    count += len(x)
                    if count <= m:
                        found.append(np.stack([rid[a + x], rid[a + y]], 1))
            if count <= m:
                pairs += found
            else:
                at = a + np.flatnonzero(open_)
                sets.append(np.stack([rid[at], gram[at], ca[at], cb[at]], 1))
        pairs, sets = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0), np.concatenate(sets)
        none = pa.nulls(len(sets), pa.int64())
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate([pairs[:, 0], sets[:, 0]])),
                pa.concat_arrays([pa.array(pairs[:, 1]), none]),
                *(pa.array(np.concatenate([np.zeros(len(pairs), np.int64), sets[:, k]])) for k in (1, 2, 3)),
            ],
            ["a", "b", "gram", "cell_a", "cell_b"],
        )

    return run


def _compared(t: Threshold):
    """The sets of one cell (rid, grams) to a forest of their links: overlaps of all by products of 0-1 matrices, some
    columns (grams that stand in two sets or more) at a time."""

    def run(table: pa.Table) -> pa.Table:
        rid, sets = table.column("rid").to_numpy(), [np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()]
        n = np.array([len(x) for x in sets])
        _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(n)), n)[times[gram] > 1]
        column = (np.cumsum(times > 1) - 1)[gram[times[gram] > 1]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(n), len(n)), np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            part = slice(*np.searchsorted(column, [a, a + COLUMNS]))
            x = np.zeros((len(n), COLUMNS), np.float32)
            x[row[part], column[part] - a] = 1
            both += x @ x.T
        i, j = np.nonzero(np.triu(t.linked(both.astype(np.int64), n[:, None], n[None, :]), 1))
        nodes, label = union_find(rid[i], rid[j])
        give_back()
        return pa.Table.from_arrays([pa.array(nodes[nodes != label]), pa.array(label[nodes != label])], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n_shingles, component_id.

    Sets are the distinct n-word grams after lower-casing A-Z (words: runs of other than space and the controls 9 to
    13); shorter texts are one gram, null and blank ones the empty set, which links with nothing. Two rows link if the
    Jaccard similarity of their sets is num / den or more (more than half). component_id is the smallest id that links
    reach, the row's own included; rows without an id take part and count for no smallest. Rows that repeat an id are
    rows of their own. An empty table gives no rows; other columns are ignored. Grams are the same if their 64-bit
    hashes are, sets if 128-bit digests of them are."""
    spark, t = docs.sparkSession, Threshold(num, den)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("k", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    chunks = stash(rows.mapInArrow(frugal(_scan(n, t)), _CHUNK), "heads")
    members = stash(chunks.mapInArrow(frugal(_members), "rid long, id long, n long, sign binary"), "members")

    def asked(chunks: DataFrame, f, schema: str, name: str) -> DataFrame:
        return stash(chunks.groupBy("chunk").cogroup(shared_keys(chunks).groupBy("chunk")).applyInArrow(f, schema), name)

    first = asked(chunks, _survivors(t), "rid long, k long", "survivors")
    drop(chunks)
    classes = stash(members.filter("n > 0").groupBy("sign").agg(F.min("rid").alias("rid"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("group_size")), "classes")
    wanted = stash(first.join(classes.select("rid"), "rid", "left_semi"), "wanted")  # one row of each class
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    # rows that repeat an id and text have the same k and set; a class has one rid
    full = stash(rows.select("k", "text").join(near, "k").dropDuplicates(["rid"]).select("rid", "text").mapInArrow(frugal(_full_sets(n)), "rid long, grams binary"), "sets")
    whole = stash(full.mapInArrow(frugal(_set_chunks), "chunk long, rids binary, lengths binary, keys binary"), "sets")
    every = asked(whole, _index(t), "gram long, rid long, n long, position long, bits array<long>", "index")
    several = every.groupBy("gram").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    index = stash(attach(every, several, "gram", every.count()).filter("group_size > 1"), "index")
    postings = index.count()
    sets = stash(full.join(index.select("rid").distinct(), "rid", "left_semi"), "sets")
    drop(whole, every, full, wanted)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (stored) that link. A set that stands as b in many pairs is repeated, each copy for some of them."""
        many = max(500, pairs.count() // 1000)
        hot = pairs.groupBy("b").count().filter(F.col("count") >= many).select("b", F.ceil(F.col("count") / many).alias("copies"))
        copies, salt = F.coalesce("copies", F.lit(1)), F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).alias("salt")
        x, y = sets.select(F.col("rid").alias("a"), F.col("grams").alias("x")), sets.select(F.col("rid").alias("b"), F.col("grams").alias("y"))
        hot = F.broadcast(hot)  # at most 1000 rows
        y = y.join(hot, "b", "left").select("b", "y", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"))
        both = pairs.join(hot, "b", "left").select("a", "b", salt).join(y, ["b", "salt"]).join(x, "a")
        return both.select("a", "b", "x", "y").mapInArrow(frugal(_verify(t)), "a long, b long")

    none = pa.array([], pa.int64())
    links, labels = small_table(spark, a=none, b=none), small_table(spark, node=none, label=none)

    def by_component() -> DataFrame:
        at = index.join(labels.withColumnRenamed("node", "rid"), "rid", "left")
        return at.select("gram", "rid", "n", "position", "bits", "group_size", F.coalesce("label", "rid").alias("comp"))

    for r in range(ROUNDS):
        at = stash(by_component(), "lists")
        lead = at.groupBy("gram").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.xxhash64("rid", F.lit(r)), F.col("rid").alias("b"), F.col("n").alias("m"), F.col("comp").alias("other"), F.col("bits").alias("bits"))).alias("lead"))
        tried = attach(at.drop("group_size"), lead, "gram", postings).filter("comp <> lead.other")
        tried = tried.filter((F.least("n", "lead.m") * den) >= (F.greatest("n", "lead.m") * num))
        both = F.ceil((F.col("n") + F.col("lead.m")) * num / F.lit(num + den))
        apart = F.aggregate(F.zip_with("bits", "lead.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        tried = tried.filter(apart <= F.col("n") + F.col("lead.m") - 2 * both)
        tried = tried.groupBy(F.col("rid").alias("a"), F.col("lead.b").alias("b")).agg(F.count(F.lit(1)).alias("times"))
        best = stash(tried.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b")), "tried")
        new = stash(verified(best), "links")
        drop(at, best)
        links = links.unionByName(new)
        if not new.take(1):
            break
        labels = components(links)
    lists = stash(by_component(), "lists")
    mixed = lists.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("group_size")).filter("low < high")
    at = attach(lists.drop("group_size"), mixed.select("gram", "group_size"), "gram", postings).filter("group_size IS NOT NULL")
    at = cells(at, "group_size", "rid", LIST_ROWS)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), postings // 200_000)
    at = at.withColumn("bucket", F.pmod(F.xxhash64("gram", "cell_a", "cell_b"), F.lit(buckets)))
    rest = stash(at.groupBy("bucket").applyInArrow(_open(t), "a long, b long, gram long, cell_a long, cell_b long"), "open")
    few = stash(rest.filter("b IS NOT NULL").select("a", "b").distinct(), "tried")
    many = rest.filter("b IS NULL").select(F.col("a").alias("rid"), "gram", "cell_a", "cell_b").join(sets, "rid")
    found = many.groupBy("gram", "cell_a", "cell_b").applyInArrow(_compared(t), "a long, b long")
    labels = components(links.unionByName(stash(verified(few).unionByName(found), "links")))
    drop(index, sets, lists, rest, few)

    roots = classes.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select("sign", "group_size", "least_id", F.coalesce("label", "rid").alias("root"))
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    placed = stash(roots.join(least, "root").select("sign", "group_size", "component_id"), "placed")
    out = attach(members.select("id", "n", "sign"), placed, "sign", members.count())
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
