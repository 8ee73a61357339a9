"""The other operators against brute force on small tables, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoseg.llm import components, exact_dedup, fm_index, language_id, pieces, quality, secrets, set_join, shared_keys, substring_dedup, vector_join
from chronoseg.llm.common import attach, crc_mod3, gram_hashes, text_buffers, word_hashes, word_spans

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, k long, rid long, spans string, grams int, pattern int"


def table(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", 1, 1, "x", 1, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def edited(r, words, n, own):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = own()
    return out


def union(edges, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_words_and_grams():
    import pyarrow as pa

    texts = ["a  Bc\x0b\x0cd", None, "", "bc  x y d", "\x1c"]
    data, off = text_buffers(pa.array(texts))
    s, e, woff = word_spans(data, off)
    got = [[bytes(data[s[i] : e[i]]).decode() for i in range(a, b)] for a, b in itertools.pairwise(woff)]
    assert got == [WORDS.findall(t or "") for t in texts]
    h = word_hashes(data, s, e, lower=True)
    flat = [w.lower() if w.isascii() else w for t in got for w in t]
    same = {(i, j) for i, j in itertools.combinations(range(len(flat)), 2) if flat[i] == flat[j]}
    assert same == {(i, j) for i, j in itertools.combinations(range(len(flat)), 2) if h[i] == h[j]}
    x = np.array([1, 2, 3, 1, 2, 3, 1], np.uint64)
    g = gram_hashes(x, 3)
    assert g[0] == g[3] and g[1] == g[4] and len(set(g.tolist())) == 3 and len(gram_hashes(x, 8)) == 0


def test_attach_hot_and_cold(spark):
    rows = spark.createDataFrame([("a",)] * 500 + [("b",)] * 3 + [("c",)], "key string")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("group_size")).filter("key <> 'c'").withColumn("v", F.upper("key"))
    got = collections.Counter((r.key, r.v) for r in attach(rows, groups, "key", 100_000).collect())
    assert got == {("a", "A"): 500, ("b", "B"): 3, ("c", None): 1}


def test_shared_keys(spark):
    rng = np.random.default_rng(0)
    chunks = [rng.integers(0, 60, 25).astype("<u8") for _ in range(4)]
    df = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(chunks)], "chunk long, keys binary")
    total = collections.Counter(np.concatenate(chunks).tolist())
    got = {}
    for r in shared_keys.shared_keys(df).collect():
        for k, n in zip(np.frombuffer(r.shared, "<u8"), np.frombuffer(r.counts, "<u4"), strict=True):
            got[r.chunk, int(k)] = int(n)
    assert got == {(i, k): total[k] for i, c in enumerate(chunks) for k in set(c.tolist()) if total[k] > 1}


@pytest.mark.parametrize("last", [400_000, 5])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST", last)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 220)]
    want = {n: r for n, r in union(edges, {x for e in edges for x in e}).items() if n != r}
    assert {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fm_index_finds_every_repeat():
    rng = np.random.default_rng(0)
    for _ in range(200):
        least = int(rng.integers(1, 6))
        seqs = [rng.integers(0, rng.integers(1, 6), rng.integers(1, 25)).astype(np.uint64) for _ in range(rng.integers(1, 10))]
        count = collections.Counter(tuple(s[i : i + least]) for s in seqs for i in range(len(s) - least + 1))
        for s, spans in zip(seqs, fm_index.repeated_spans(seqs, least), strict=True):
            want, have = np.zeros(len(s), bool), np.zeros(len(s), bool)
            for i in range(len(s) - least + 1):
                want[i : i + least] |= count[tuple(s[i : i + least])] > 1
            for a, b in spans:
                have[a:b] = True
            assert (want == have).all()


@pytest.mark.parametrize("most", [4096, 1])
def test_substring_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_SNIPPETS", most)  # 1: all snippets are cut to windows
    r = random.Random(4)
    word = lambda: "w%d" % r.randrange(400)
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "one two", "z " * 200, " ".join(passage[:35]), " ".join(passage[:34])]
    for _ in range(40):
        w = [word() for _ in range(r.randrange(10, 120))]
        at = r.randrange(len(w))
        a = r.randrange(30)
        texts.append("\t".join(w[:at] + passage[a : a + r.randrange(20, 60)] + w[at:]))
    texts += [texts[-1], texts[-2]]
    words = [WORDS.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for i, w in enumerate(words):
        gone = {j for s in range(len(w) - 34) if count[tuple(w[s : s + 35])] > 1 for j in range(s, s + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = sorted(tuple(x) for x in substring_dedup.remove_repeats(table(spark, texts)).collect())
    assert got == want and any(x[2] for x in want)
    assert substring_dedup.remove_repeats(table(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize(("list_rows", "rounds", "block"), [(1024, 6, 64), (5, 1, 3), (3, 0, 2)])
def test_set_join(spark, monkeypatch, list_rows, rounds, block):
    monkeypatch.setattr(set_join, "LIST_ROWS", list_rows)
    monkeypatch.setattr(set_join, "ROUNDS", rounds)
    monkeypatch.setattr(set_join, "BLOCK", block)
    r = random.Random(list_rows)
    common = ["zz%d" % i for i in range(12)]
    bases = [["%s%d" % (r.choice("abcdefghij"), r.randrange(60)) for _ in range(n)] for n in (3, 8, 30, 60, 60)]
    texts = [None, "", "one", "ONE", "one two three", " \t"]
    for _ in range(70):
        w = edited(r, r.choice(bases), r.randrange(3), lambda: "x%d" % r.randrange(5))
        texts.append(" ".join(w + (common if r.random() < 0.4 else [])))
    sets = []
    for t in texts:
        w = WORDS.findall((t or "").lower())
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = union(links, range(len(texts)))
    got = sorted(tuple(x) for x in set_join.jaccard_components(table(spark, texts), 4, 85, 100).collect())
    assert got == [(i, len(sets[i]), root[i]) for i in range(len(texts))] and len(links) > 10
    assert set_join.jaccard_components(table(spark, texts).limit(0)).count() == 0


def test_near_copies_below_the_threshold_make_no_rows_of_pairs(spark, monkeypatch):
    r = random.Random(8)
    base = ["b%d" % i for i in range(90)]
    texts = [" ".join(edited(r, base, 4, lambda: "x%d" % r.randrange(3))) for _ in range(400)]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    made = []
    stash = set_join.stash

    def counted(df, name="table"):
        out = stash(df, name)
        if name in ("open", "tried", "links"):
            made.append(out.count())
        return out

    monkeypatch.setattr(set_join, "stash", counted)
    root = union(links, range(len(texts)))
    got = sorted(tuple(x) for x in set_join.jaccard_components(table(spark, texts), 4, 85, 100).collect())
    assert got == [(i, len(sets[i]), root[i]) for i in range(len(texts))]
    assert len(set(root.values())) > 100 and max(made) < 20 * len(texts)


@pytest.mark.parametrize("block", [1024, 4])
def test_vector_join(spark, monkeypatch, block):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in (centres[i % 6] + rng.standard_normal(16) * 0.25).astype(np.float32)]) for i in range(60)]
    rows += [(60, rows[0][1]), (61, [2 * x for x in rows[0][1]]), (62, None), (63, [0.0] * 16), (64, [float("nan")] * 16), (65, [None] + [1.0] * 15), (66, []), (67, [1.0, 2.0]), (68, [2.0, 4.0])]
    fine = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a, b in itertools.combinations(sorted(fine), 2) if len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.95]
    root, n = union(links, [i for i, _ in rows]), collections.Counter(itertools.chain(*links))
    want = [(i, n[i], root[i], root[i] == i) for i, _ in rows]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, h string").repartition(3)
    assert sorted(tuple(x) for x in vector_join.linked_vectors(df).collect()) == want and len(links) > 20
    assert vector_join.linked_vectors(df.limit(0)).count() == 0


def test_vector_recall():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((400, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * side
    hasher = vector_join.Hasher(64, 50_000, 0.95)
    assert (hasher.keys(a) == hasher.keys(b)).any(1).mean() >= 0.97


def test_secrets(spark):
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    random_part = "q7Zp2Lx9Vb4Nd8Rt5Kw1Hy6"
    texts = [
        None, "", "Password = 'abcdefgh' x", "token=key secret:abcdefghij", "api_key:: abcdefghijk", "é😀 SECRET=“ passwd:12345678", "AKIAABCDEFGH1234 AKIAAKIA12345678901", "f" * 31 + " " + "f" * 33 + "g" + "0a" * 16,
        "token=secret:abcdefgh", "x " + random_part + " y", "the_ordinary_identifier_2_of_many_words and somelongordinaryword", "token=" + random_part, "a password=hunter2hunter2 " * 700, "Key tokenſ=abcdefghij",
    ]
    kinds = ("assign", "access", "hex")
    want = []
    for i, t in enumerate(texts):
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
        want.append((i, *(sum(k == x[1] for x in found) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest()))
    common = ["the quick brown identifiers stand in ordinary sentences of several words"] * 5
    rows = secrets.digest(secrets.find_secrets(table(spark, texts + common))).orderBy("doc_id").collect()
    assert [tuple(r)[:5] for r in rows[: len(texts)]] == want
    spans = [r.spans for r in rows]
    assert spans[9] == f"markov:2:{2 + len(random_part)}" and "markov" not in spans[10] + spans[11] + "".join(spans[14:])
    assert secrets.find_secrets(table(spark, texts).limit(0)).count() == 0


def test_random_letters_are_secrets(spark):
    ratios = secrets.train_pairs(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    texts = ["x qZpXLxjVbWNdGRtFKwJHycU y", "", "somelongordinaryword quick/brown/identifiers_stand", "-" * 40 + " " + "1" * 30]
    rows = secrets.digest(secrets.find_secrets(table(spark, texts), ratios=ratios)).orderBy("doc_id").collect()
    assert rows[0].spans == "markov:2:25" and not any(r.spans for r in rows[2:])


def test_language_mixture(spark):
    r = random.Random(0)
    syllables = {"aa": ["ba", "be", "bi", "bo"], "bb": ["ku", "zo", "xi", "qa"], "cc": ["mé", "né", "lé", "ré"]}
    say = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    texts = [(i, say(lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    texts += [(900, None, "aa"), (901, "", None), (902, "12 34 !", "bb"), (903, say("aa", 60) + " " + say("bb", 30), None), (904, "щъё" * 40, None), (905, "x", None), (906, say("cc", 9000), None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language_id.train(df, F.coalesce(crc_mod3() != 1, F.lit(False)))
    got = {x.doc_id: x for x in language_id.predict(df, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in texts[:90])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert got[903].lang_pred == "aa" and set(got[903].shares) == {"aa", "bb"} and got[903].shares["bb"] == pytest.approx(1 / 3, abs=0.05)
    assert got[904].unknown > 0.5 and got[905].lang_pred in syllables and got[906].lang_pred == "cc"
    nothing = language_id.train(df.limit(0), F.lit(True))
    assert {x.lang_pred for x in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_every_label_is_learned(spark):
    import corpus_pipeline

    r = random.Random(1)
    say = lambda i: "".join(r.choice([chr(0x4E00 + 8 * i + j) for j in range(3)]) for _ in range(60))
    rows = [(1000 * c + i, say(i), f"l{i:03}") for c in range(2) for i in range(450)]
    rows += [(3000 + i, say(i) + say(i), None) for i in range(440, 450)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True))
    assert len(model.languages) == 450 and not model.dense
    got = {x.doc_id: x for x in language_id.predict(df, model).collect()}
    assert all(got[i].lang_pred == f"l{i % 1000:03}" and got[i].unknown < 0.5 for i, _, _ in rows)
    assert corpus_pipeline.identify_language(spark, df, "").count() == len(rows)


def test_sparse_model_is_the_dense_one(monkeypatch):
    r = np.random.default_rng(2)
    counts = r.integers(0, 40, (6, language_id.BUCKETS)) * (r.random((6, language_id.BUCKETS)) < 0.2)
    lang, bucket = np.nonzero(counts)
    key = np.unique(np.concatenate([t * language_id.BUCKETS + r.choice(bucket[np.isin(lang, own)], 400) for t, own in enumerate([[0], [1, 2], [3], [4, 5], [0, 3, 5]])]))
    texts = key // language_id.BUCKETS, key % language_id.BUCKETS, r.integers(1, 5, len(key)), 6
    names = list("abcdef")
    want, has = language_id.Model(names, lang, bucket, counts[lang, bucket]).mixtures(*texts)
    monkeypatch.setattr(language_id, "DENSE_LANGUAGES", 0)
    sparse = language_id.Model(names, lang, bucket, counts[lang, bucket])
    assert not sparse.dense and has.tolist() == [True] * 5 + [False]
    assert np.allclose(sparse.mixtures(*texts)[0], want, atol=1e-9)
    monkeypatch.setattr(language_id, "CELLS", 1000)  # a text at a time
    assert np.allclose(sparse.mixtures(*texts)[0], want, atol=2e-3)


def test_pieces_are_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    m = pieces.PieceModel(path)
    r = random.Random(1)
    for letters in ("the in\n▁éß漢😀  ab", "aab  \t.,-=01", "eotainshr ", "абвгде ж", "e", " "):
        for _ in range(200):
            text = "".join(r.choice(letters) for _ in range(r.randrange(30)))
            ids = m.encode(text)
            assert ids == (m._alone(" " + text.replace("▁", " ")) if text else []) == sp.encode(text) and m.decode(ids) == sp.decode(ids) == text.replace("▁", " ")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for x in pieces.encode_pieces(docs, path).select("text", "piece_ids", "round_trip").collect():
        assert x.piece_ids == (None if x.text is None else sp.encode(x.text)) and x.round_trip is not False


def test_scores_decide_where_any_piece_may_follow():
    import public_tokenizers

    m = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))
    m.merges = None
    score = {m.raw[i].decode(): s for i, s in zip(m.ids, m.scores, strict=True)}
    r = random.Random(1)
    for _ in range(40):
        text = "".join(r.choice("the in\n▁éß漢😀  ab") for _ in range(r.randrange(14)))
        marked = text and " " + text.replace("▁", " ")
        best = [0.0] + [-math.inf] * len(marked)
        for i in range(1, len(marked) + 1):
            best[i] = best[i - 1] + m.byte_score * len(marked[i - 1].encode())
            for j in range(max(0, i - 40), i):
                best[i] = max(best[i], best[j] + score.get(marked[j:i], -math.inf))
        ids = m.encode(text)
        assert sum(m.byte_score if i in m.byte else score[m.raw[i].decode()] for i in ids) == pytest.approx(best[-1])
        assert m.segment([marked])[0].tolist() == ids and m.decode(ids) == text.replace("▁", " ")


def test_pieces_of_odd_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", " ", "a  b ", "line\nline\ttab", "The the " * 4000, "漢字😀", "a  b ", "x" * 70_000, None]
    encoded = pieces.encode_pieces(table(spark, texts).withColumns({"n_pieces": F.lit(1), "decoded": F.lit("x")}), path)
    back = pieces.decode_pieces(encoded, path).orderBy("doc_id").collect()
    assert [x.decoded for x in back] == texts and [x.round_trip for x in back] == [t and True if t is None else True for t in texts]
    assert [x.n_pieces for x in back][:2] == [0, 0] and pieces.summary(encoded).count() == len(texts)
    assert back[3].piece_ids == back[7].piece_ids and back[3].rid == 1
    assert pieces.encode_pieces(table(spark, texts).limit(0), path).count() == 0


def test_repetition_is_seen_in_long_texts():
    r = random.Random(4)
    line = lambda n: " ".join("w%d" % r.randrange(10**6) for _ in range(n))
    texts = [line(8) + " "] * 1 + [line(600)]
    texts = [texts[0] * 3000, (texts[1] + " ") * 30, (line(2500) + " ") * 4, line(6000), line(300), "", texts[0] * 5]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t) for t in texts])
    assert quality.votes(data, off)[:, quality.LABELLERS.index("repeated words")].tolist() == [-1, -1, -1, 1, 1, 0, -1]


def test_quality(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    good = [" ".join(word() for _ in range(r.randrange(40, 120))) + "." for _ in range(120)]
    bad = [" ".join([word() + r.choice(["***", "%%%", "###"]) for _ in range(12)] * 5) for _ in range(20)] + [" ".join([word().upper() + "!!"] * 3 * 20) for _ in range(20)]
    texts = [*good, *bad, None, "", "Short text here.", good[0], good[0]]
    got = quality.score_quality(table(spark, texts)).orderBy("doc_id").collect()
    assert all(x.keep for x in got[:120]) and not any(x.keep for x in got[120:162])
    assert got[162].keep and got[160].score == 0 and got[163].score == got[164].score == got[0].score
    assert quality.score_quality(table(spark, texts).limit(0)).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.6, 0.85, 0.75])
    v = np.where(rng.random((4000, 6)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    v[rng.random((4000, 6)) < 0.3] = 0
    pattern, counts = np.unique(quality._pattern(v), return_counts=True)
    prior, p = quality.label_model(pattern, counts.astype(float))
    assert prior == pytest.approx(0.7, abs=0.03)
    assert (p[:, 1, 2] / (p[:, 1, 2] + p[:, 1, 0])) == pytest.approx(right, abs=0.05)


def test_drop_duplicates_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a"), (2, "A"), (2, "A"), (None, "a"), (None, "b"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(map(repr, map(tuple, exact_dedup.drop_duplicates(df).collect())))
    assert got == sorted(map(repr, [(2, "A"), (None, "b"), (4, "")]))


def test_pipeline(spark):
    import corpus_pipeline

    r = random.Random(3)
    word = lambda lang: "".join(r.choice(lang) for _ in range(3))
    en, fr = ["th", "er", "in", "on"], ["é", "eau", "ou", "qu"]
    base = [word(en) for _ in range(200)]
    texts = [(i, " ".join(word(en if i % 2 else fr) for _ in range(80)), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(40)]
    texts += [(100, " ".join(base), "en", "s0"), (101, " ".join(base).upper(), "en", "s0"), (102, " ".join(base[:-2] + ["xx", "yy"]), "en", "s1"), (103, None, "en", "s0"), (104, "123", "en", "s1"), (105, "щъё" * 60, None, "s2")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    out = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, "")
        ids = {x.doc_id for x in out.collect()}
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            assert ids == {t[0] for t in texts} - {103, 104, 105}
        if k == 1:
            assert {100, 101} & ids == {101}
        if k == 2:
            assert {100, 101, 102} & ids == {101} and len(ids) == 41
    assert all(x.round_trip for x in out.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_pipeline_starts_no_other_workers_and_bounds_batches_by_bytes(spark, monkeypatch, tmp_path):
    import corpus_pipeline
    import pyarrow as pa

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "en", f"s{i % 2}") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    made, make = [], type(spark).createDataFrame
    # rows of Python objects would pass through Python workers of their own on every executor
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (made.append(data), make(self, data, *a, **b))[1])
    assert corpus_pipeline.identify_language(spark, docs, "").count() == corpus_pipeline.drop_near_copies(spark, docs, "").count() == 8
    assert made and all(isinstance(x, pa.Table) for x in made)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

    long = spark.range(0, 700, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    got = long.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(x.rows for x in got) == 700 and max(x.bytes for x in got) <= corpus_pipeline.BATCH_BYTES + 50_000
