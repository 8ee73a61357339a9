"""The registered queries of these operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, mixing, pieces, quality, secrets, set_join, substring_dedup, token_store, vector_join
from .common import crc_mod3, tuned


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_store.read_documents(token_store.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the training order, with its position."""
    mixed = mixing.mix_documents(_table(spark, sf_dir, "documents"), (1, 2, 3))
    return mixing.by_position(mixed).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


def _position_sql() -> str:
    """Where the demand of a schedule of three values, scaled to the target, reaches what was taken before."""
    cases = []
    for k, (a, b, c) in enumerate(mixing.SCHEDULES):
        mid, end = (a + b) / 4, (a + b) / 4 + (b + c) / 4
        root = lambda u, v, y: f"CASE WHEN {y} > 0 THEN least(2 * {y} / ({u} + sqrt(greatest({u * u} + {4 * (v - u)} * {y}, 0.0))), 0.5) ELSE 0.0 END"  # noqa: E731
        x = f"(share * {end})"
        cases.append(f"WHEN rk % 3 = {k} THEN CASE WHEN {x} <= {mid} THEN {root(a, b, x)} WHEN {x} <= {end} THEN 0.5 + {root(b, c, f'({x} - {mid})')} ELSE 1.0 END")
    return "CASE " + " ".join(cases) + " END"


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '#' || coalesce(text, ''))) AS h,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk
      FROM d GROUP BY source),
w AS (SELECT *, CAST(rk % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
m AS (SELECT min(CASE WHEN lv * weight <= cap THEN cap / weight END) AS open_at,
             arg_min(lv, cap / weight) FILTER (WHERE lv * weight <= cap) AS lv FROM l),
t AS (SELECT l.source, l.source_size, l.rk,
             CASE WHEN m.open_at IS NULL OR cap / weight < m.open_at THEN cap ELSE least(cap, m.lv * weight) END AS target FROM l, m),
g AS (SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS goal,
             CASE WHEN source_size > 0 THEN least(CAST(round(target) AS BIGINT), 3 * source_size) // source_size ELSE 0 END AS passes FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, passes, goal, rk, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, CASE WHEN target > 0 THEN least(before / target, 1.0) ELSE 0.0 END AS share FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(passes * size + greatest(0, least(size, goal - passes * source_size - before)) AS BIGINT) AS taken,
       round({_position_sql()}, 9) AS position
FROM p
"""


def op3_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.linked_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents")).drop("votes")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod3() == 1, F.lit(False))
    model = language_id.train(docs, ~held_out)
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.summary(pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM d),
x AS (SELECT r, unnest(g) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s u ON u.r = a JOIN s v ON v.r = b WHERE 100 * k >= 85 * (len(u.g) + len(v.g) - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
c AS (SELECT t.a, min(doc_id) AS least FROM t JOIN s ON s.r = t.b GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, c.least) AS component_id FROM s LEFT JOIN c ON c.a = s.r
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=35).drop("kept_text")


OP8_SQL = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i+34], ' ') AS win FROM t, unnest(range(1, len(w) - 33)) AS x(i) WHERE len(w) >= 35),
rep AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + o AS p FROM g JOIN rep USING (win), unnest(range(0, 35)) AS y(o)),
per AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
k AS (SELECT t.doc_id, t.w, coalesce(len(ps), 0) AS n_removed,
             CASE WHEN ps IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p))) END AS kept
      FROM t LEFT JOIN per USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


QUERIES = {
    "op4_quality": (op4_quality, None),
    "op5_secrets": (op5_secrets, None),
    "op3_vector_join": (op3_vector_join, OP3_SQL),
    "op6_language_id": (op6_language_id, None),
    "op9_pieces": (op9_pieces, None),
    "op7_set_join": (op7_set_join, OP7_SQL),
    "op8_substring_dedup": (op8_substring_dedup, OP8_SQL),
    "op1_token_store": (op1_token_store, None),
    "op2_exact_dedup": (op2_exact_dedup, OP2_SQL),
    "op10_mixing": (op10_mixing, OP10_SQL),
}


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
