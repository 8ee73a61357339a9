"""Token store, exact dedup and mixing on small hand-made tables."""

import hashlib
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from chronoseg.llm import exact_dedup, mixing, token_store  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node int"
ROWS = [
    (5, "Hello  world\tit's 12 ok", "en", "b", 1, 9, 1),
    (1, None, None, None, None, None, None),
    (7, "", "en", "a", 0, 9, 1),
    (3, "hello  WORLD\tit's 12 ok", "en", "b", 1, 9, 1),
    (9, "Él se fue\x1cñ <|endoftext|> éx " * 400, "es", "a", 1, 9, 1),
    (9, "Él se fue\x1cñ <|endoftext|> éx " * 400, "es", "a", 1, 9, 1),
    (None, "no id", "en", "a", 1, 9, 1),
    (2, "ÀB", "en", "c", 1, 9, 1),
    (4, "àb", "en", "c", 1, 9, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_dac_reads_any_token():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        code = token_store.Dac(token_store.dac_encode(ids))
        assert len(code) == n and (code.all() == ids).all()
        at = rng.integers(0, max(n, 1), 200) if n else []
        assert (code.get(at) == ids[np.asarray(at, int)]).all()
    with pytest.raises(IndexError):
        code.get([5000])
    with pytest.raises(ValueError):
        token_store.dac_encode(np.array([2**16]), (1, 1))


def test_word_encoder_forgets_and_agrees():
    enc = token_store.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=3)
    texts = ["a b c d e f", "", "g h i", "a a a b", "it's 'tis don't!'s '' A1b22 É² x<|endoftext|>y THEY'LL ñ'd ß'sß µm ×3 ÷ \x1f áb Ünü 'Re''ve1's Straße,\x0bñu0308o", "漢字 ＡＢ İx"]
    ids, counts = enc.encode(texts)
    assert enc.encode(texts[:1])[0].tolist() == enc.encode(texts[:1])[0].tolist()
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_token_store(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_store.read_documents(token_store.write_tokens(docs, path)).collect()}
    want, start = {}, 0
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], start] = len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert got == want
    assert token_store.read_documents(token_store.write_tokens(docs.limit(0), path)).count() == 0


def test_exact_duplicates(spark, docs):
    for keep, best in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_duplicates(docs, keep=keep).collect()
        groups = {}
        for r in ROWS:
            groups.setdefault((r[1] or "").encode().lower(), []).append(r[0])
        want = []
        for t, ids in groups.items():
            stays = best([i for i in ids if i is not None], default=None)
            want += [(i, stays, len(ids), i == stays, hashlib.sha256(t).hexdigest()) for i in ids]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(ROWS)
    sizes = {r.source: r.source_size for r in got}
    by = {s: sum(r.taken for r in got if r.source == s) for s in sizes}
    assert sum(by.values()) == pytest.approx(sum(sizes.values()), abs=3)
    assert all(r.taken <= 3 * r.size and abs(by[r.source] - r.target) <= 1 for r in got)
    assert all(0 <= r.position <= 1 for r in got)
    # a takes weight 1, b 2, c 3, null 1: b and c and null stop at 3 times their size
    assert {s: round(t) for s, t in {r.source: r.target for r in got}.items()}[None] == 0
    assert by["b"] == 3 * sizes["b"] and by["c"] == 3 * sizes["c"]
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    order = [r.position for r in mixing.training_order(mixing.mix_documents(docs)).collect()]
    assert order == sorted(order)


def test_op10_gives_the_training_order(spark):
    from chronoseg.llm.queries import QUERIES

    data = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{data}/documents.parquet")
    whole = mixing.by_position(mixing.mix_documents(table)).collect()
    assert len(whole) == table.count() and any(r.taken == 0 for r in whole)
    assert [r.position for r in whole] == sorted(r.position for r in whole)
    for r in whole:
        assert len(r.copy_positions) == (-(-r.taken // r.size) if r.size else 0)
        assert list(r.copy_positions) == sorted(r.copy_positions) and all(0 <= p <= 1 for p in r.copy_positions)
        assert not r.taken or r.copy_positions[0] == r.position
    mixed = QUERIES["op10_mixing"][0](spark, data)
    assert [tuple(r)[:5] for r in mixed.collect()] == [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in whole]  # in the same order
    assert "Sort [position" in mixed._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_an_id_are_spread_by_their_text(spark):
    rows = [(None, f"w{i} x", "s") for i in range(50)] + [(i, "y z", "s") for i in range(50)] + [(None, "w1 x", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    first, again = (sorted(map(tuple, mixing.mix_documents(df).select("doc_id", "size", "taken", "position").collect()), key=repr) for _ in range(2))
    assert first == again and len({p for i, _, _, p in first if i is None}) > 40


def test_inverse_demand(spark):
    from pyspark.sql import functions as F

    values = (0.5, 1.0, 0.0)
    col = mixing._inverse_demand(F.col("s"), F.lit(0), [values])
    for s, t in spark.createDataFrame([(x / 20,) for x in range(21)], "s double").select("s", col).collect():
        fine = np.linspace(0, t, 20001)
        area = np.trapezoid(np.interp(fine, [0, 0.5, 1], values), fine) / np.trapezoid(values, [0, 0.5, 1])
        assert area == pytest.approx(s, abs=1e-6)
