"""Quality by weak labels: overlapping heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or abstains. All documents are counted by their pattern of votes (at most 3 to the power of
the number of labellers rows), and expectation-maximisation over these counts estimates the share of good documents and,
for each labeller, how often it votes what in either class: its accuracy, found without a single true label. The
posterior of a pattern is the label of its documents; a logistic scorer over hashed shapes of the text is trained on
these labels and on what the labellers said, and scores every document, so that documents on which all labellers abstain
get a score too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, gram_hashes, hash_sample, mix, pieces, stash, text_buffers, word_hashes, word_spans

FEATURES = 1 << 14
#: Documents that the scorer is trained on: those whose id has the smallest hash, as whole texts.
SAMPLE = 4000
#: Distinct words are counted in blocks of about so many, and of longer texts also the distinct runs of RUN words.
BLOCK_WORDS, RUN = 1000, 8
LABELLERS = ("symbols", "shouting", "repeated words", "marked words", "word length", "digits")


def _class_table() -> np.ndarray:
    out = np.zeros(256, np.uint8)  # 0: other symbols, each with its own shape below
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 1
    out[[9, 11, 12, 13, 32]], out[10] = 4, 5
    return out


_CLASS = _class_table()
#: The shape of a byte: letters by case, digits and white space by class, symbols as they are.
_SHAPE = np.where(_CLASS > 0, _CLASS, np.arange(256)).astype(np.uint64)


def _distinct(hashes: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """How many distinct hashes each of n groups has."""
    order = np.lexsort((hashes, group))
    h, g = hashes[order], group[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return np.bincount(g[new], minlength=n)


def _fresh(hashes: np.ndarray, row: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """The share of words that are new in their block of equal blocks of BLOCK_WORDS at most or, if that is less, of runs
    of words that are new in the whole text. Does not fall with the length of a text that repeats nothing."""
    n, words = len(woff) - 1, woff[1:] - woff[:-1]
    blocks = np.maximum(1, -(-words // BLOCK_WORDS))
    begin = np.cumsum(blocks) - blocks
    place = np.arange(len(hashes)) - woff[:-1][row]
    block = begin[row] + place * blocks[row] // words[row]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (np.add.reduceat(_distinct(hashes, block, blocks.sum()), begin) if n else np.zeros(0)) / words
    inside = (blocks[row] > 1) & (place + RUN <= words[row])
    if inside.any():
        grams = gram_hashes(hashes, RUN)
        out = np.where(blocks > 1, np.minimum(out, _distinct(grams[inside[: len(grams)]], row[inside], n) / np.maximum(1, words - RUN + 1)), out)
    return out


def votes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row for each text and a column for each labeller: 1 good, -1 bad, 0 abstains (always for blank texts)."""
    n = len(off) - 1
    size = (off[1:] - off[:-1]).astype(float)
    total = np.zeros((6, len(data) + 1), np.int64)
    for k in (0, 1, 2, 3):
        np.cumsum(_CLASS[data] == k, out=total[k, 1:])
    count = (total[:, off[1:]] - total[:, off[:-1]]).astype(float)
    symbols, letters, upper, digits = count[0], count[1] + count[2], count[2], count[3]
    s, e, woff = word_spans(data, off)
    words = (woff[1:] - woff[:-1]).astype(float)
    row = np.repeat(np.arange(n), woff[1:] - woff[:-1])
    hashes = word_hashes(data, s, e, lower=True)
    fresh = _fresh(hashes, row, woff)
    marked = np.bincount(row, (_CLASS[data[e - 1]] == 0) & ~np.isin(data[e - 1], np.frombuffer(b".,;:?'\")", np.uint8)), n) if len(s) else np.zeros(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = [symbols / size, upper / letters, fresh, marked / words, np.bincount(row, e - s, n) / words, digits / size]
    good = [rate[0] < 0.06, rate[1] < 0.2, rate[2] > 0.5, rate[3] < 0.1, (rate[4] > 2.5) & (rate[4] < 15), rate[5] < 0.05]
    bad = [rate[0] > 0.1, rate[1] > 0.5, rate[2] < 0.4, rate[3] > 0.25, (rate[4] < 1.8) | (rate[4] > 25), rate[5] > 0.2]
    # what a short text can't show is no vote
    heard = [words > 0, letters >= 20, words >= 20, words >= 5, words >= 5, words > 0]
    return np.stack([np.where(h, g.astype(np.int8) - b.astype(np.int8), 0) for g, b, h in zip(good, bad, heard, strict=True)], 1).astype(np.int8)


def _pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def _unpack(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def label_model(pattern: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """The share of good documents and P(vote | class, it votes) as [labeller, class, vote + 1], class 1 good; abstaining
    says nothing (1 for either class). Begins with a share of 0.8 and labellers that are right in four of five votes, which
    also settles which class is which."""
    v = _unpack(pattern) + 1
    m = v.shape[1]
    prior, p = 0.8, np.tile(np.array([[0.8, 1.0, 0.2], [0.2, 1.0, 0.8]]), (m, 1, 1))
    for _ in range(rounds):
        post = _posterior(v, prior, p)
        new = np.empty_like(p)
        for vote in (0, 2):
            hit = v == vote
            new[:, 1, vote] = (hit * (post * counts)[:, None]).sum(0)
            new[:, 0, vote] = (hit * ((1 - post) * counts)[:, None]).sum(0)
        new[:, :, 1] = 0
        new[:, :, [0, 2]] += 0.5
        new /= new.sum(2, keepdims=True)
        new[:, :, 1] = 1
        moved = abs(new - p).max()
        prior, p = float(np.clip((post * counts).sum() / max(counts.sum(), 1), 1e-6, 1 - 1e-6)), new
        if moved < 1e-7:
            break
    return prior, p


def _posterior(v: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    log = np.log(p[np.arange(v.shape[1]), :, v])  # pattern x labeller x class
    odds = np.log(prior / (1 - prior)) + (log[:, :, 1] - log[:, :, 0]).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def posterior_of(pattern: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    return _posterior(_unpack(pattern) + 1, prior, p)


def shapes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed shapes of three bytes of each text: row, feature, weight. Weights are square roots of shares, so a text's
    features have length 1."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    shape = _SHAPE[data]
    h = mix(shape[:-2] | shape[1:-1] << np.uint64(8) | shape[2:] << np.uint64(16)) % np.uint64(FEATURES)
    row = np.searchsorted(off, np.arange(len(h)), "right") - 1
    inside = np.arange(len(h)) + 3 <= off[row + 1]
    key, count = np.unique(row[inside] * FEATURES + h[inside].astype(np.int64), return_counts=True)
    row = key // FEATURES
    return row, key % FEATURES, np.sqrt(count / np.bincount(row, count, len(off) - 1)[row])


def features(data: np.ndarray, off: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shapes() and the votes v, hashed into the same features, all votes of a text together of length 1 at most: row,
    feature, weight, in order of rows."""
    row, feature, x = shapes(data, off)
    voter, labeller = np.nonzero(v)
    said = mix((np.uint64(1) << np.uint64(32)) + (2 * labeller + (v[voter, labeller] > 0)).astype(np.uint64)) % np.uint64(FEATURES)
    row, feature, x = np.append(row, voter), np.append(feature, said.astype(np.int64)), np.append(x, np.full(len(voter), len(LABELLERS) ** -0.5))
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], x[order]


def train_linear(row: np.ndarray, feature: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on soft labels y, the bias last, by accelerated gradient steps; classes weigh the
    same."""
    w = ahead = np.zeros(FEATURES + 1)
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight /= weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(row, x * ahead[feature], len(y)) + ahead[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        step = np.append(np.bincount(feature, x * g[row], FEATURES) + ridge * ahead[:-1] / FEATURES, g.sum())
        new = ahead - 1.3 * step  # shapes, votes and the bias have length 1 each, so the curvature is at most 3/4
        ahead, w = new + (t - 1) / (t + 2) * (new - w), new
    return w


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = text_buffers(column_of(batch, text))
    for a, b in pieces(off, 1 << 19):
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]


def score_quality(docs: DataFrame, id_column: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: the id, posterior (of the labellers: the probability of good), score (of the
    trained scorer), keep (score of 0.5 or more) and a column of votes.

    Blank and null texts have no votes, so their posterior is the share of good documents, and are not kept (score 0).
    An empty table gives no rows; other columns are ignored; equal texts get equal scores."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_pattern(votes(part, at)) for _, _, part, at in _slices(batch, "text")]
            yield pa.RecordBatch.from_pydict({"id": column_of(batch, "id"), "pattern": pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))})

    voted = stash(rows.mapInArrow(vote, T.StructType([rows.schema["id"], T.StructField("pattern", T.LongType())])), "votes")
    table = voted.groupBy("pattern").count().orderBy("pattern").toPandas()  # at most 729 rows
    prior, p = label_model(table["pattern"].to_numpy(np.int64), table["count"].to_numpy(float))
    chosen = hash_sample(rows.filter(F.length(F.trim("text")) > 0), "id", "text", sample)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = column_of(batch, "_h").to_numpy()
            for a, b, part, at in _slices(batch, "text"):
                v = votes(part, at)
                row, feature, x = features(part, at, v)
                cut = np.searchsorted(row, np.arange(b - a + 1))
                feature, x = feature.astype("<u2"), x.astype("<f4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": pa.array(h[a:b]),
                        "y": pa.array(posterior_of(_pattern(v), prior, p)),
                        "feature": pa.array([feature[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
                        "x": pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
                    }
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sample's features, at most 6 bytes each of FEATURES a document, in order of their hash."""
        held = pa.Table.from_batches(batches, pa.schema([("h", pa.int64()), ("y", pa.float64()), ("feature", pa.binary()), ("x", pa.binary())])).sort_by("h")
        if held.num_rows:
            feature, x = ([np.frombuffer(b, t) for b in held.column(c).to_pylist()] for c, t in (("feature", "<u2"), ("x", "<f4")))
            row = np.repeat(np.arange(held.num_rows), [len(f) for f in feature])
            w = train_linear(row, np.concatenate(feature).astype(np.int64), np.concatenate(x).astype(float), held.column("y").to_numpy())
            yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary())})

    told = chosen.select("_h", "text").mapInArrow(featured, "h long, y double, feature binary, x binary")
    got = told.repartition(1).mapInArrow(fit, "w binary").collect()
    w = np.frombuffer(got[0]["w"]) if got else np.zeros(FEATURES + 1)
    known = docs.sparkSession.sparkContext.broadcast((prior, p, w))  # FEATURES + 1 weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, p, w = known.value
        for batch in batches:
            out = []
            for a, b, part, at in _slices(batch, "text"):
                v = votes(part, at)
                row, feature, x = features(part, at, v)
                z = np.bincount(row, x * w[feature], b - a) + w[-1]
                s, _, woff = word_spans(part, at)
                out.append((posterior_of(_pattern(v), prior, p), np.where(woff[1:] > woff[:-1], 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0), v))
            if out:
                post, scores, v = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"id": column_of(batch, "id"), "posterior": pa.array(post), "score": pa.array(scores), "keep": pa.array(scores >= 0.5), "votes": pa.array(list(v.astype(np.int32)), pa.list_(pa.int32()))})

    schema = T.StructType([rows.schema["id"], *T.StructType().add("posterior", "double").add("score", "double").add("keep", "boolean").add("votes", T.ArrayType(T.IntegerType())).fields])
    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_column)
