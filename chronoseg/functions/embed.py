"""Embeddings of texts, as functions of a column, which operators take as a parameter.

A model's embeddings come as a column of a table (lambda text: F.col("its_vector")) or from any function of a column, a
pandas UDF too; hashed_ngrams() needs no model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import once

TextEmbedding = Callable[[Column], Column]


def hashed_ngrams(dim: int = 64, n: int = 3) -> TextEmbedding:
    """How often each hash of n characters, lower-cased, occurs; a shorter text is one gram, null and empty have none. The
    hash is the first 32 bits of md5, modulo dim."""

    def grams(chars: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(1)))
        return F.filter(F.transform(begins, lambda i: F.array_join(F.slice(chars, i, n), "")), lambda g: g != "")

    def counted(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda b: F.size(F.filter(at, lambda x: x == b)).cast("double"))

    def embed(text: Column) -> Column:
        chars = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != "")
        hashed = F.transform(once(chars, grams), lambda g: F.pmod(F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)))
        return once(hashed, counted)

    return embed
