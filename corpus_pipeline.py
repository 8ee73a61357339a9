"""The corpus pipeline: each stage works on all that the one before it kept.

Language ID drops what is in no learned language; exact dedup keeps the row with the largest id of equal texts; the
n-gram Jaccard join keeps the smallest id of each group of near copies (five words, 0.8); the mix takes documents by
source, whole, some of them several times, in the order of the curriculum; the last stage encodes them as pieces.

Stages carry whatever columns there are, those that operators add under the same names too. An empty table gives no rows
in any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoseg.llm import exact_dedup, language_id, mixing, pieces, set_join
from chronoseg.llm.common import stash, tuned

#: A document is rejected if more of it is in no learned language than this.
MOST_UNKNOWN = 0.5
#: Bytes that an Arrow batch has about: what the stages leave behind on an executor adds up.
BATCH_BYTES = 2 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null, has no letter, or is mostly in no learned language. Without any labelled
    document nothing can be learned, and only the first two go. Rows that repeat share their fate; texts are read whole."""
    tuned(spark, BATCH_BYTES)
    model = language_id.train(docs, F.lit(True))
    rows = docs.select(F.struct("*").alias("row"), "text")
    if not model.languages:
        return rows.filter(F.col("text").rlike(r"\p{L}")).select("row.*")
    told = language_id.predict(rows, model)
    return told.filter((F.col("lang_pred") != "und") & (F.col("unknown") <= MOST_UNKNOWN)).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of texts that are equal after lower-casing A-Z; a null text counts as empty, rows
    without an id go where another row of the text has one (else all stay), rows that repeat id and text are one."""
    tuned(spark, BATCH_BYTES)
    return exact_dedup.drop_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group that links of near copies connect; rows without an id stay, as do null and empty
    texts, which link with nothing; rows that repeat an id stay or go together."""
    tuned(spark, BATCH_BYTES)
    groups = set_join.jaccard_components(docs, n=5, num=80, den=100)
    return exact_dedup.without(docs, groups.filter("component_id <> doc_id").select("doc_id").distinct(), ["doc_id"]).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass, in training order. Null and empty texts have no words and are
    not taken; a null source is a source; ties of position come in any order."""
    tuned(spark, BATCH_BYTES)
    return mixing.training_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, sources, pieces, their number, and whether they decode to the text. A null text has null pieces,
    an empty one none; repeated rows are rows of their own."""
    tuned(spark, BATCH_BYTES)
    return pieces.encode_pieces(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: The model of the first stage and the pieces of the last can't be expressed in SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stash(docs, f"stage{k}") if k < len(STAGES) - 1 else docs
    return docs
