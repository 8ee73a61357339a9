"""Language identification by multilingual mixture inference.

Each language has a distribution of character trigrams, hashed to buckets, learned from labelled documents. A document
is a mixture of languages and of an unknown one, whose trigrams are all equally likely; expectation-maximisation finds
the proportions under which its trigrams are likeliest. The language set is the one with the best likelihood less a
penalty for each language: sets are grown along the fitted proportions, and as no set is likelier than the mixture of
all, most documents need no more than the likelihoods of single languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, frugal, mix, pieces, small_table, text_buffers

BUCKETS = 1 << 14
#: Labelled documents of each language that training reads, chosen by a hash of the id.
SAMPLE = 2000
#: Up to so many languages the model is one dense table; beyond, a sparse one of the buckets that each language has.
DENSE_LANGUAGES = 64
#: Characters of which trigrams are counted at once.
WINDOW = 1 << 20
#: Numbers that the tables of the texts fitted at once have about.
CELLS = 1 << 23
#: Languages that a task of training counts at once.
HELD_LANGUAGES = 256
ROUNDS = 40
#: Log-likelihood that each further language of a set must add, times the log of the number of trigrams.
PENALTY = 3.0
_UNKNOWN = ""


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigram buckets of each text, lower-cased, digits and what is no letter as one blank: row, bucket,
    count; and whether each row has a letter. Trigrams of blanks only do not count."""
    flat = pc.utf8_lower(pc.fill_null(texts, ""))
    flat = pc.replace_substring_regex(flat, r"[^\pL\pM]+", " ")
    lettered = np.asarray(pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(flat)), 0))
    joined = " " + "  ".join(flat.to_pylist()) + " "
    ends = np.cumsum(np.asarray(pc.utf8_length(flat)).astype(np.int64) + 2)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(joined) - 2, WINDOW):  # a very long text takes no more than a window's arrays
        code = np.frombuffer(joined[start : start + WINDOW + 2].encode("utf-32-le"), "<u4")
        at = np.arange(start, start + len(code) - 2)
        row, blank = np.searchsorted(ends, at, "right"), code == 32
        with np.errstate(over="ignore"):
            h = code[:-2].astype(np.uint64) * np.uint64(1 << 42) + code[1:-1].astype(np.uint64) * np.uint64(1 << 21) + code[2:]
        good = ~(blank[:-2] & blank[1:-1]) & ~(blank[1:-1] & blank[2:]) & (row == np.searchsorted(ends, at + 2, "right"))
        key, count = np.unique(row[good] * BUCKETS + (mix(h[good]) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
        keys.append(key)
        counts.append(count)
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(which, np.concatenate(counts), len(key)).astype(np.int64)
    return key // BUCKETS, key % BUCKETS, count, lettered


def _slices(batch: pa.RecordBatch, text: str, most: int = 1 << 19) -> Iterator[tuple[int, int, pa.Array]]:
    column = column_of(batch, text)
    _, off = text_buffers(column)
    for a, b in pieces(off, most):
        yield a, b, column.slice(a, b - a)


class _Dense:
    """Texts by the likelihood of each trigram in each language."""

    def __init__(self, like: np.ndarray, at: np.ndarray, count: np.ndarray):
        self.like, self.at, self.count = like, at, count
        self.begin = np.searchsorted(at, np.arange(at[-1] + 1))
        self.total = np.add.reduceat(count, self.begin).astype(float)

    def single(self) -> np.ndarray:
        return np.add.reduceat(np.log(self.like) * self.count[:, None], self.begin)

    def step(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = self.like * w[self.at]
        mixed = share.sum(1)
        value = np.add.reduceat(np.log(mixed) * self.count, self.begin)
        share *= (self.count / mixed)[:, None]
        return value, np.add.reduceat(share, self.begin) / self.total[:, None]

    def of(self, texts: np.ndarray) -> _Dense:
        keep = texts[self.at]
        return _Dense(self.like[keep], (np.cumsum(texts) - 1)[self.at[keep]], self.count[keep])


class _Sparse:
    """The same from base, the likelihood in a language of a bucket that it doesn't have, and, for each trigram and
    language that has its bucket, what it has above base."""

    def __init__(self, base: np.ndarray, at: np.ndarray, count: np.ndarray, nth: np.ndarray, lang: np.ndarray, extra: np.ndarray):
        self.base, self.at, self.count, self.nth, self.lang, self.extra = base, at, count, nth, lang, extra
        self.begin = np.searchsorted(at, np.arange(at[-1] + 1))
        self.total = np.add.reduceat(count, self.begin).astype(float)
        self.cell = at[nth] * len(base) + lang

    def _by_cell(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell, x, len(self.begin) * len(self.base)).reshape(len(self.begin), len(self.base))

    def single(self) -> np.ndarray:
        more = np.log1p(self.extra / self.base[self.lang])
        return self.total[:, None] * np.log(self.base) + self._by_cell(more * self.count[self.nth])

    def step(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (w @ self.base)[self.at] + np.bincount(self.nth, self.extra * w.ravel()[self.cell], len(self.at))
        value = np.add.reduceat(np.log(mixed) * self.count, self.begin)
        part = self.count / mixed
        new = w * (np.add.reduceat(part, self.begin)[:, None] * self.base + self._by_cell(self.extra * part[self.nth]))
        return value, new / self.total[:, None]

    def of(self, texts: np.ndarray) -> _Sparse:
        keep = texts[self.at]
        some = keep[self.nth]
        return _Sparse(self.base, (np.cumsum(texts) - 1)[self.at[keep]], self.count[keep], (np.cumsum(keep) - 1)[self.nth[some]], self.lang[some], self.extra[some])


class Model:
    """Log probabilities of buckets, a row for each language; the last row is the unknown one. The counts are given by
    language (its number), bucket and count; a bucket that a language lacks counts as 0."""

    def __init__(self, languages: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.languages, self.dense = languages, len(languages) <= DENSE_LANGUAGES
        if self.dense:
            smooth = np.zeros((len(languages), BUCKETS))
            smooth[lang, bucket] = n
            smooth += 0.05
            p = smooth / smooth.sum(1, keepdims=True)
            self.p = np.concatenate([p, np.full((1, BUCKETS), 1 / BUCKETS)])
            return
        total = np.bincount(lang, n, len(languages)) + 0.05 * BUCKETS
        self.base = np.append(0.05 / total, 1 / BUCKETS)
        order = np.argsort(bucket, kind="stable")
        self.lang, self.extra = lang[order].astype(np.int32), (n / total[lang])[order]
        self.first = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))

    def _texts(self, at: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> _Dense | _Sparse:
        if self.dense:
            return _Dense(self.p[:, bucket].T, at, count)
        held = self.first[bucket + 1] - self.first[bucket]
        nth = np.repeat(np.arange(len(bucket)), held)
        entry = np.arange(len(nth)) - np.repeat(np.cumsum(held) - held, held) + self.first[bucket][nth]
        return _Sparse(self.base, at, count, nth, self.lang[entry], self.extra[entry])

    def mixtures(self, row: np.ndarray, bucket: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of n texts the proportions of languages, the unknown last, under the best set, and whether it has
        any trigram. Rows must be sorted."""
        k = len(self.languages) + 1
        out = np.zeros((n, k))
        some_trigram = np.zeros(n, bool)
        full, begin = np.unique(row, return_index=True)
        some_trigram[full] = True
        cells = np.full(len(bucket), k) if self.dense else self.first[bucket + 1] - self.first[bucket]
        cells = np.add.reduceat(cells, begin) + (0 if self.dense else k) if len(full) else begin
        part = np.cumsum(cells) // CELLS  # texts are fitted some at a time
        for a, b in zip(*(x := np.flatnonzero(np.diff(part, prepend=-1)), np.append(x[1:], len(full))), strict=True):
            inside = slice(begin[a], begin[b] if b < len(full) else len(row))
            out[full[a:b]] = self._fitted(self._texts(np.searchsorted(full[a:b], row[inside]), bucket[inside], count[inside]), k)
        return out, some_trigram

    def _fitted(self, texts: _Dense | _Sparse, k: int) -> np.ndarray:
        """The proportions of each text under its best set."""
        total, single = texts.total, texts.single()
        rows = np.arange(len(total))

        def fit(texts, w, enough):
            """Proportions from w on and their log-likelihoods. A text is left when no mixture can reach `enough`: the
            likelihood is concave, so its maximum is at most what it is here plus the largest slope less 1, times n."""
            live, value = np.arange(len(w)), np.zeros(len(w))
            for _ in range(ROUNDS):
                value[live], new = texts.step(w[live])
                slope = np.max(new / np.maximum(w[live], 1e-300), axis=1) - 1
                moved = (np.abs(new - w[live]).max(1) > 1e-3) & (value[live] + slope * texts.total > enough[live])
                w[live] = new
                if not moved.any():
                    break
                if moved.mean() < 0.7:  # go on with the texts that still move
                    live, texts = live[moved], texts.of(moved)
            return w, value

        penalty = PENALTY * np.log(total + 1)
        start = np.full((len(total), k), 0.1 / k)
        start[rows, single.argmax(1)] += 0.9
        w, best = fit(texts, start, single.max(1) + penalty)
        chosen = np.zeros((len(total), k))
        chosen[rows, single.argmax(1)] = 1
        value = single.max(1) - penalty
        order = np.argsort(-w, axis=1, kind="stable")
        for size in range(2, k + 1):  # sets along the fitted proportions, while the mixture of all leaves room for one
            room = best - size * penalty > value
            open_ = np.flatnonzero(room)
            if not len(open_):
                break
            allowed = np.zeros((len(open_), k))
            np.put_along_axis(allowed, order[open_, :size], 1.0, axis=1)
            sub_w, sub_best = fit(texts.of(room), allowed / size, np.full(len(open_), -np.inf))
            better = sub_best - size * penalty[open_] > value[open_]
            value[open_[better]] = (sub_best - size * penalty[open_])[better]
            chosen[open_[better]] = sub_w[better]
        return chosen


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", id_column: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from the rows where `learn` holds and text and lang are not null: of each language `sample` documents at
    most, those whose id has the smallest hash, each as a whole text."""
    rows = docs.filter(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_column)).alias("h"), F.col(id_column).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], *np.zeros((3, 0), np.int64))
    # a sample of each language: about twice as many by hash range, then the first of them
    share = [min(1.0, 2.0 * sample / r["count"] + 0.001) for r in counts]
    shares = small_table(docs.sparkSession, lang=pa.array([r["lang"] for r in counts], pa.string()), share=pa.array(share, pa.float64()))
    near = rows.join(F.broadcast(shares), "lang").filter((F.pmod("h", F.lit(1 << 20)) / float(1 << 20)) <= F.col("share"))
    first = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "id")
    chosen = near.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= sample).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, x in total.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(x[at])})
            total.clear()

        for batch in batches:
            names = np.array(column_of(batch, "lang").to_pylist(), object)
            for a, b, part in _slices(batch, "text"):
                row, bucket, n, _ = trigrams(part)
                for name in dict.fromkeys(names[a:b]):
                    own = (names[a:b] == name)[row]
                    total.setdefault(name, np.zeros(BUCKETS, np.int64))
                    total[name] += np.bincount(bucket[own], n[own], BUCKETS).astype(np.int64)
                if len(total) > HELD_LANGUAGES:
                    yield from told()
        yield from told()

    table = chosen.repartition(16).mapInArrow(frugal(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return Model(languages, pd.Index(languages).get_indexer(table["lang"]), table["bucket"].to_numpy(np.int64), table["n"].to_numpy(np.int64))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the share of that language), unknown (that of none) and shares (those of the set).

    lang_pred is a learned language; `und` with score 0 if the text is null or has no letter, or nothing was learned. A
    text without a trigram of letters takes the first language. Ties go to the first language by code point. Rows that
    repeat are rows of their own, with the same answer; columns of these four names are replaced, others carried; an empty
    table gives no rows."""
    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "unknown", "shares")])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the buckets that each language has, of BUCKETS at most
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            best, score, unknown, shares = [], [], [], []
            for a, b, part in _slices(batch, text):
                row, bucket, n, lettered = trigrams(part)
                if not model.languages:
                    lettered = np.zeros(b - a, bool)
                w, _ = model.mixtures(row, bucket, n, b - a) if model.languages else (np.zeros((b - a, 1)), None)
                for x, has in zip(w, lettered, strict=True):
                    known = x[:-1]
                    i = int(known.argmax()) if has else 0
                    best.append(model.languages[i] if has else "und")
                    score.append(min(1.0, float(known[i])) if has else 0.0)
                    unknown.append(min(1.0, float(x[-1])) if has else 1.0)
                    shares.append([(model.languages[j], float(known[j])) for j in np.flatnonzero(known > 0)] if has else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(unknown, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], [*names, "lang_pred", "score", "unknown", "shares"])

    from pyspark.sql import types as T

    more = T.StructType().add("lang_pred", "string").add("score", "double").add("unknown", "double").add("shares", T.MapType(T.StringType(), T.DoubleType()))
    return docs.mapInArrow(frugal(run), T.StructType(docs.schema.fields + more.fields))
