"""Removing passages that repeat: every word covered by a window of 35 words that also starts elsewhere.

Routing. Each window is anchored at the 12 words in it with the smallest hash, the leftmost of equals, so equal windows
have equal anchors. Consecutive windows with the same anchor are one snippet. Only anchors that occur twice in the
corpus matter; a shard is a set of anchors with all their distinct snippets, so whatever equals a window is in its shard.

Search. Each shard's distinct snippets (twice, if several documents have them) form an FM-index: the Burrows-Wheeler
transform in a wavelet matrix of packed bits. Every snippet streams through backward search, and the spans of 35 words
or more whose interval holds more than one row are reported, and carried back to all documents that have the snippet.

An anchor with more distinct snippets than a shard should have (the edges of a passage that thousands of texts share) has
its snippets cut further, to their windows, and each distinct window is a snippet of its own that its digest routes: so
these are spread evenly over the same shards and searched in the same indexes, whatever the size of the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, column_of, drop, gram_hashes, mix, pieces, stash, text_buffers, word_hashes, word_spans
from .fm_index import repeated_spans
from .shared_keys import lookup, replies_of, shared_keys

WINDOW = 35
ANCHOR = 12
#: Distinct snippets of an anchor beyond which they are cut to windows: about as many as a shard has.
MOST_SNIPPETS = 4096
#: Words of a shard's snippets, about.
SHARD_WORDS = 1 << 19
_CHUNK = "chunk long, docs binary, keys binary, snippets binary, firsts binary, lasts binary, of binary"


def _anchors(words: np.ndarray, woff: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Snippets of the rows of words: row, anchor, first and last window (by word of all rows)."""
    grams = gram_hashes(words, ANCHOR)
    wide = window - ANCHOR + 1
    n = len(words) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, grams[:0], none, none
    best, have = np.arange(len(grams)), 1
    while have * 2 <= wide:  # the leftmost smallest among `have` grams from each on
        a, b = best[: len(best) - have], best[have:]
        best, have = np.where(grams[a] <= grams[b], a, b), have * 2
    if have < wide:
        a, b = best[: len(best) - (wide - have)], best[wide - have :]
        best = np.where(grams[a] <= grams[b], a, b)
    row = np.searchsorted(woff, np.arange(n), "right") - 1
    start = np.flatnonzero(np.arange(n) + window <= woff[row + 1])
    if not len(start):
        return none, grams[:0], none, none
    anchor, row = best[start], row[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], grams[anchor[at]], start[at], start[np.append(at[1:], len(start)) - 1]


def _content(words: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """A digest of the words of each snippet."""
    from .common import _powers

    up, down = _powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix((total[last + window] - total[first]) * down[first] + (last - first).astype(np.uint64))


def _scan(window: int):
    """Rows (k, text) to chunks of snippets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            k = column_of(batch, "k").to_numpy()
            data, off = text_buffers(column_of(batch, "text"))
            for a, b in pieces(off):
                part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                s, e, woff = word_spans(part, at)
                words = word_hashes(part, s, e)
                row, anchor, first, last = _anchors(words, woff, window)
                if len(row):
                    content = _content(words, first, last, window)
                    out = [chunk, k[a:b], anchor, content, first - woff[row], last - woff[row], row]
                    kinds = (None, "<i8", "<u8", "<u8", "<i4", "<i4", "<i4")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk])] + [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(out[1:], kinds[1:], strict=True)],
                        ["chunk", "docs", "keys", "snippets", "firsts", "lasts", "of"],
                    )
                    chunk += 1

    return run


def _occurrences(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk and the replies to it: its snippets whose anchor occurs twice."""
    out = []
    shared, _ = replies_of(right)
    for row in left.to_pylist():
        anchor = np.frombuffer(row["keys"], "<u8")
        go = lookup(shared, np.ones(len(shared), np.int64), anchor, 0) > 0
        of = np.frombuffer(row["of"], "<i4")[go]
        out.append([anchor[go].astype("<i8"), np.frombuffer(row["snippets"], "<u8")[go].astype("<i8"), np.frombuffer(row["docs"], "<i8")[of], np.frombuffer(row["firsts"], "<i4")[go], np.frombuffer(row["lasts"], "<i4")[go]])
    kinds = (np.int64, np.int64, np.int64, np.int32, np.int32)
    return pa.Table.from_arrays([pa.array(np.concatenate([x[i] for x in out]).astype(t) if out else np.zeros(0, t)) for i, t in enumerate(kinds)], ["anchor", "snippet", "k", "first", "last"])


def _cut(window: int):
    """Rows (text, wanted: array of snippets) to the words of each snippet or, if it is to be cut, of each of its windows,
    with the window's offset and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(column_of(batch, "text"))
            wanted = column_of(batch, "wanted").to_pylist()
            for a, b in pieces(off):
                part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                s, e, woff = word_spans(part, at)
                words = word_hashes(part, s, e)
                windows = twice = None
                rows = []
                for i in range(a, b):
                    base = woff[i - a]
                    for w in wanted[i]:
                        f, l = base + w["first"], base + w["last"]
                        if not w["hot"]:
                            rows.append((w["anchor"], w["snippet"], w["n"], words[f : l + window].astype("<u8").tobytes(), None, None, None))
                            continue
                        if windows is None:
                            windows, twice = gram_hashes(words, window).view(np.int64), gram_hashes(mix(words), window).view(np.int64)
                        rows += [(w["anchor"], w["snippet"], w["n"], words[j : j + window].astype("<u8").tobytes(), j - f, int(windows[j]), int(twice[j])) for j in range(f, l + 1)]
                if rows:
                    x = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(x, kinds, strict=True)], ["anchor", "snippet", "n", "words", "offset", "one", "two"])

    return run


def _search(window: int):
    def run(table: pa.Table) -> pa.Table:
        anchors, snippets, n, single = (table.column(x).to_pylist() for x in ("anchor", "snippet", "n", "single"))
        words = [np.frombuffer(x, "<u8") for x in table.column("words").to_pylist()]
        twice = [w for w, k in zip(words, n, strict=True) if k > 1]
        found = repeated_spans(words + twice, window)[: len(words)]
        rows = [(*x, a, b) for *x, spans in zip(anchors, snippets, n, single, found, strict=True) for a, b in spans]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["anchor", "snippet", "n", "single", "a", "b"])

    return run


def repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: k long, text. One row for each span of words [a, b) of a k to remove: k, a, b; spans may overlap."""
    spark = docs.sparkSession
    chunks = stash(docs.select("k", "text").mapInArrow(_scan(window), _CHUNK), "chunks")
    replies = shared_keys(chunks)
    found = stash(chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_occurrences, "anchor long, snippet long, k long, first int, last int"), "snippets")
    drop(chunks)
    distinct = found.groupBy("anchor", "snippet").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "first", "last")).alias("at"))
    distinct = stash(distinct, "distinct")
    total = distinct.count()
    sizes = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("group_size"))
    sizes = sizes.filter("group_size > 1")
    marked = attach(distinct, sizes, "anchor", total).select("anchor", "snippet", "n", "at.*", (F.coalesce("group_size", F.lit(1)) > MOST_SNIPPETS).alias("hot"))
    wanted = marked.groupBy("k").agg(F.collect_list(F.struct("anchor", "snippet", "n", "first", "last", "hot")).alias("wanted"))
    one_each = docs.select("k", "text").join(wanted, "k").dropDuplicates(["k"])  # rows that repeat a k have the same text
    cut = stash(one_each.mapInArrow(_cut(window), "anchor long, snippet long, n long, words binary, offset int, one long, two long"), "cut")
    whole, cut_up = cut.filter("offset IS NULL"), cut.filter("offset IS NOT NULL")
    single = cut_up.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("words").alias("words"), F.greatest(F.count(F.lit(1)), F.lit(2)).alias("group_size"))
    single = stash(single, "windows")
    size = whole.unionByName(single.select("words"), allowMissingColumns=True).agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (8 * SHARD_WORDS)))
    rows = whole.select("anchor", "snippet", "n", "words", F.lit(False).alias("single"))
    rows = rows.unionByName(single.select(F.col("one").alias("anchor"), F.col("two").alias("snippet"), "n", "words", F.lit(True).alias("single")))
    spans = rows.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "*").groupBy("shard").applyInArrow(_search(window), "anchor long, snippet long, n long, single boolean, a int, b int")
    spans = stash(spans, "found")
    # what was found of a window goes back to all snippets that have it
    digest = F.struct("one", "two").alias("digest")
    again = spans.filter("single").select(F.struct(F.col("anchor").alias("one"), F.col("snippet").alias("two")).alias("digest")).join(single.select(digest, "group_size"), "digest")
    again = attach(cut_up.select("anchor", "snippet", "n", "offset", digest), again, "digest", max(1, total)).filter("group_size IS NOT NULL")
    spans = spans.filter("NOT single").select("anchor", "snippet", "n", "a", "b")
    spans = spans.unionByName(again.select("anchor", "snippet", "n", F.col("offset").alias("a"), (F.col("offset") + window).cast("int").alias("b")))
    key = F.struct("anchor", "snippet").alias("key")
    per_snippet = spans.groupBy(key).agg(F.greatest(F.max("n"), F.lit(2)).alias("group_size"), F.collect_set(F.struct("a", "b")).alias("spans"))
    per_snippet = stash(per_snippet, "spans")
    hits = attach(found.select(key, "k", "first"), per_snippet, "key", max(1, found.count())).filter("spans IS NOT NULL")
    hits = hits.select("k", "first", F.explode("spans").alias("span"))
    return hits.select("k", (F.col("first") + F.col("span.a")).cast("int").alias("a"), (F.col("first") + F.col("span.b")).cast("int").alias("b"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i, j in pieces(text_buffers(column_of(whole, "text"))[1]):
            batch = whole.slice(i, j - i)
            n, removed, texts = [], [], []
            for text, cover in zip(column_of(batch, "text").to_pylist(), column_of(batch, "spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n.append(len(words))
                if cover:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for x in cover:
                        gone[x["a"]] += 1
                        gone[x["b"]] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                removed.append(n[-1] - len(words))
                texts.append(b" ".join(words))
            sha = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array([t.decode() for t in texts], pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: the id, n_words, n_removed, kept_sha256 and kept_text (kept words joined by one
    space).

    Words are runs of other than space and the controls 9 to 13. A window is judged on the input: all its occurrences
    go, in whatever document, one that occurs twice in one document too. Null counts as empty; texts shorter than a
    window stay whole; rows that repeat an id and text repeat all their windows; other columns are ignored."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("k", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    spans = repeated_words(rows, window).groupBy("k").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = rows.join(spans, "k", "left").select("id", "text", "spans")
    return joined.mapInArrow(_kept, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("id", id_column)
