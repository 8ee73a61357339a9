"""Every registered query of the training-data operators on the smallest tables, against SQL or a plain version."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoseg.llm import language_id, quality, secrets
from chronoseg.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def run(spark, name):
    return QUERIES[name][0](spark, DATA).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(QUERIES[name][1])
    names = [c[0] for c in want.description]
    plain = lambda v: round(v, 8) + 0.0 if isinstance(v, float) else v
    rows = [tuple(plain(r[n]) for n in names) for r in run(spark, name)]
    assert sorted(rows) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_op1(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    start, want = 0, {}
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op1_token_store")} == want


def test_op9(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in run(spark, "op9_pieces"):
        ids = sp.encode(texts[r.doc_id])
        assert r.n_pieces == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def auc(score, good):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    return (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_op4_scorer_is_no_worse_than_its_labels(spark):
    data = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op4_quality"][0](spark, data).collect()}
    rows = [(got[r.doc_id], r.quality == 1) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.doc_id in got]
    good = np.array([y for _, y in rows])
    of_scorer, of_labels = (auc(np.array([getattr(r, c) for r, _ in rows]), good) for c in ("score", "posterior"))
    assert of_scorer > 0.99 and of_scorer >= of_labels - 0.002
    assert np.mean([r.keep == y for r, y in rows]) > 0.97


def test_op4_label_model_is_the_plain_one():
    rng = np.random.default_rng(3)
    v = rng.choice([-1, 0, 1], (300, 6), p=[0.2, 0.3, 0.5]) * np.where(rng.random(300) < 0.7, 1, -1)[:, None]
    pattern, counts = np.unique(quality._pattern(v), return_counts=True)
    prior, p = quality.label_model(pattern, counts.astype(float), rounds=30)
    share, right = 0.8, {(k, c, x): 0.8 if (x > 0) == c else 0.2 for k in range(6) for c in (True, False) for x in (-1, 1)}
    for _ in range(30):
        post = []
        for row in v:
            odds = {c: (share if c else 1 - share) * math.prod(right[k, c, x] for k, x in enumerate(row) if x) for c in (True, False)}
            post.append(odds[True] / sum(odds.values()))
        for k, c in itertools.product(range(6), (True, False)):
            mass = {x: 0.5 + sum((q if c else 1 - q) for q, row in zip(post, v, strict=True) if row[k] == x) for x in (-1, 1)}
            right.update({(k, c, x): mass[x] / sum(mass.values()) for x in (-1, 1)})
        share = sum(post) / len(post)
    assert prior == pytest.approx(share, abs=1e-4)
    assert all(p[k, int(c), x + 1] == pytest.approx(q, abs=1e-4) for (k, c, x), q in right.items())


def test_op5(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    table = np.array(secrets.train_pairs(docs)).reshape(94, 94)
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in run(spark, "op5_secrets"):
        t = texts[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        more = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            code = [min(max(ord(c) - 33, 0), 93) for c in m[0]]
            ratio = np.mean([table[a, b] for a, b in itertools.pairwise(code)])
            least = secrets.LEAST_RATIO if re.search("[0-9]", m[0]) else secrets.LEAST_RATIO_LETTERS
            if re.search("[A-Za-z]", m[0]) and ratio >= least and not any(a < m.end() and m.start() < b for a, _, b in base):
                more.append((m.start(), 3, m.end()))
        listed = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.spans == listed(base + more) and r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x[1] for x in base) for k in range(3))


def test_op5_tells_random_strings_from_identifiers(spark):
    """Held out: neither these strings nor their makers are in the training sample."""
    rng = np.random.default_rng(11)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    secret = ["".join(rng.choice(list(kinds[i % 4]), 30 if i % 4 == 1 else 24 + i % 20)) for i in range(400)]
    words = sorted({w for t in docs.collect() for w in re.findall("[A-Za-z]{4,}", t.text or "")})
    pick = lambda: words[rng.integers(len(words))]
    plain = [rng.choice(["_", "-", "/"]).join([pick().lower() for _ in range(5)]) + ("" if i % 2 else f"_v{i}") for i in range(400)]
    plain = [p for p in plain if len(p) >= 20]
    table = spark.createDataFrame([(i, f"x {s} y") for i, s in enumerate(secret + plain)], "doc_id long, text string")
    found = {r.doc_id for r in secrets.digest(secrets.find_secrets(table, ratios=secrets.train_pairs(docs))).filter("spans <> ''").collect()}
    hits = sum(i < len(secret) for i in found)
    assert hits / len(secret) > 0.95 and hits / max(1, len(found)) > 0.98


def test_op6_is_right_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("lang IS NOT NULL").collect()}
    held = [r for r in run(spark, "op6_language_id") if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(held) > 30 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_op6_finds_the_best_set_of_all_subsets():
    rng = np.random.default_rng(0)
    k, size = 3, 400
    lang, bucket = np.repeat(np.arange(k), size), np.concatenate([rng.choice(language_id.BUCKETS, size, replace=False) for _ in range(k)])
    model = language_id.Model(list("abc"), lang, bucket, rng.integers(5, 60, k * size))
    for trial in range(12):
        share = rng.dirichlet(np.full(k, 0.4))
        drawn = np.concatenate([rng.choice(bucket[lang == i], int(300 * s)) for i, s in enumerate(share)])
        own, count = np.unique(drawn, return_counts=True)
        got = model.mixtures(np.zeros(len(own), np.int64), own, count, 1)[0][0]
        p, penalty = model.p[:, own], language_id.PENALTY * math.log(count.sum() + 1)
        best = (-math.inf, None)
        for n in range(1, k + 2):
            for chosen in itertools.combinations(range(k + 1), n):
                w = np.full(n, 1 / n)
                for _ in range(300):
                    part = w[:, None] * p[list(chosen)]
                    w = (part / part.sum(0) * count).sum(1) / count.sum()
                best = max(best, ((np.log(w @ p[list(chosen)]) * count).sum() - penalty * n, chosen))
        assert set(np.flatnonzero(got > 0)) == set(best[1]), (trial, share)


def test_language_answers_replace_columns_and_repeat(spark):
    rows = [(i, "ba be bi " * 20, "aa", "x", 1) for i in range(4)] + [(9, "ku zo xi " * 20, "bb", "x", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    got = language_id.predict(df, language_id.train(df, F.lit(True)))
    assert got.columns.count("lang_pred") == got.columns.count("score") == 1
    assert collections.Counter(r.lang_pred for r in got.collect()) == {"aa": 4, "bb": 3}


def test_trigrams_of_long_texts_are_counted_by_windows(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = pa.array(["".join(rng.choice(list("abé  1."), n)) for n in (0, 1, 50, 3000)] + [None])
    want = language_id.trigrams(texts)
    monkeypatch.setattr(language_id, "WINDOW", 17)
    assert all((a == b).all() for a, b in zip(language_id.trigrams(texts), want, strict=True))
