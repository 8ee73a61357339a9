"""Secrets in texts: patterns, and character Markov models of random strings and of ordinary identifiers.

Everything here is DataFrame functions. Positions of matches are running sums of the lengths of the matches and of what
stands between them (regexp_extract_all and split by the same pattern), made in blocks so that a text with very many
matches costs no square. A run of identifier characters that no pattern covers is scored by the mean log-likelihood
ratio of its character pairs under two first-order Markov models, trained here from labelled samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

#: The kinds in the order in which spans that begin together are listed; patterns with the group that has a least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)(password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs of fewer characters fail, and no other match begins in them
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
#: Matches that one block of a running sum has.
BLOCK = 256
#: Least mean log-likelihood ratio, in nats a character pair, of a random string.
LEAST_RATIO = 1.0
#: The same of one without a digit: names in capitals or of joined words stay below.
LEAST_RATIO_LETTERS = 2.5
#: Labelled samples: random strings made by rule, and documents (those whose id has the smallest hash) whose words are
#: the ordinary identifiers.
RANDOM_STRINGS, ORDINARY_DOCUMENTS = 3000, 500
#: Weight, in pairs, of the frequency of single characters in what follows a character.
BACKOFF = 5.0
_FIRST, _WIDE = 33, 94


def _starts(text: Column, pattern: str, matches: Column) -> Column:
    """Where each match begins, in characters."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    lengths = F.transform(matches, lambda m: F.length(m))
    steps = F.zip_with(F.slice(gaps, 1, F.size(lengths)), lengths, lambda g, m: g + m)
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    zero = F.array().cast("array<int>")

    def running(values: Column, first: Column) -> Column:
        """[first, first + values[0], ...], one longer than values."""
        return F.aggregate(values, F.array(first), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    part = F.transform(blocks, lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(part, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v))
    before = running(sums, F.lit(0))
    inside = F.flatten(F.zip_with(part, F.slice(before, 1, F.size(part)), lambda p, s: F.slice(running(p, s), 1, F.size(p))))
    starts = F.zip_with(inside, F.slice(gaps, 1, F.size(lengths)), lambda at, g: at + g)
    return F.when(F.size(matches) > 0, starts).otherwise(zero)


def _spans(text: Column, kind: int, pattern: str, hint: Column, value_group: int | None = None, least: int = 0) -> Column:
    """Spans (start, kind, end, value) of a pattern's matches; empty where the hint fails."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    zipped = F.arrays_zip(_starts(text, pattern, matches).alias("s"), matches.alias("m"), values.alias("v"))
    spans = F.transform(zipped, lambda z: F.struct(z["s"].alias("start"), F.lit(kind).alias("kind"), (z["s"] + F.length(z["m"])).alias("end"), z["v"].alias("value")))
    spans = F.filter(spans, lambda x: F.length(x["value"]) >= least)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(hint, spans).otherwise(empty)


def _pairs(text: Column) -> Column:
    """The number of each character pair; characters outside of ! to ~ count as the nearest. Cut to characters once, so the
    work is linear in the text."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.greatest(F.lit(0), F.least(F.lit(_WIDE - 1), F.ascii(c) - _FIRST)))
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * _WIDE + b)


def train_pairs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> list[float]:
    """The log-likelihood ratio, random over ordinary, of every character pair, given the first character."""
    spark = docs.sparkSession
    seed = F.sha2(F.col("id").cast("string"), 256)
    n = spark.range(RANDOM_STRINGS)
    shapes = [F.base64(F.unhex(seed)), F.translate(F.base64(F.unhex(F.sha2(seed, 256))), "+/=", ""), F.translate(F.base64(F.unhex(F.sha2(F.concat(seed, F.lit("u")), 256))), "+/", "-_"), F.substring(F.sha2(F.concat(seed, F.lit("h")), 256), 1, 40), F.upper(F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(seed, F.lit("k")), 256))), "+/=", ""), 1, 24))]
    random = n.select(F.explode(F.array(*shapes)).alias("token"), F.lit(1).alias("label"))
    few = hash_sample(docs.filter(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.col(text).alias("text")), "id", "text", ORDINARY_DOCUMENTS)
    words = few.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/_=-]{3,}"), F.lit(0))).alias("w")).filter(~F.col("w").rlike("[0-9]"))
    # the words as they are, and joined as identifiers are
    styles = F.array(F.col("w"), F.concat(F.lower("w"), F.lit("_"), F.lower("w")), F.concat(F.lower("w"), F.initcap("w")), F.upper("w"), F.concat(F.lower("w"), F.lit("-"), F.lower("w"), F.lit("/"), F.lower("w")), F.concat(F.lower("w"), F.lit("2="), F.lower("w"), F.lit("_10")))
    ordinary = words.select(F.explode(styles).alias("token"), F.lit(0).alias("label"))
    pairs = random.unionByName(ordinary).filter(F.length("token") >= 2).select("label", F.explode(_pairs(F.col("token"))).alias("pair"))
    rows = pairs.groupBy("label", "pair").count().collect()  # two for each pair at most
    counts = np.full((2, _WIDE, _WIDE), 0.0)
    for r in rows:
        counts[r["label"], r["pair"] // _WIDE, r["pair"] % _WIDE] += r["count"]
    single = counts.sum(1) + 0.5  # what follows a character that was not seen is as frequent as it is anywhere
    single /= single.sum(1, keepdims=True)
    p = (counts + BACKOFF * single[:, None, :]) / (counts.sum(2, keepdims=True) + BACKOFF)
    return np.log(p[1] / p[0]).ravel().round(6).tolist()


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """One row for each row of docs: the id, spans (array of start, kind, end, value by start and kind; code points, end
    exclusive).

    kind is a position in KINDS. Patterns match leftmost and without overlap for each kind; matches whose value is too
    short are dropped after that. A markov span is a run of 20 or more identifier characters with a letter, likelier
    random than ordinary by LEAST_RATIO a pair (LEAST_RATIO_LETTERS without a digit), that meets no other span. Null counts as empty and has no
    spans; an empty table gives no rows; rows that repeat are rows of their own; other columns are ignored."""
    ratios = ratios if ratios is not None else train_pairs(docs, id_column, text)
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    base = F.concat(
        _spans(t, 0, ASSIGN, t.rlike(ASSIGN_HINT), 2, 8),
        _spans(t, 1, ACCESS, t.contains("AKIA")),
        _spans(t, 2, HEX, t.rlike(HEX)),
    )
    rows = rows.withColumn("base", base).withColumn("runs", _spans(t, 3, CANDIDATE, t.rlike(CANDIDATE)))
    table = F.array(*[F.lit(float(x)) for x in ratios])

    def mean_ratio(v: Column) -> Column:
        return F.aggregate(_pairs(v), F.lit(0.0), lambda acc, i: acc + F.get(table, i)) / (F.length(v) - 1)

    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    least = lambda v: F.when(v.rlike("[0-9]"), F.lit(LEAST_RATIO)).otherwise(F.lit(LEAST_RATIO_LETTERS))
    lettered = F.filter("runs", lambda x: x["value"].rlike("[A-Za-z]"))
    found = F.filter(F.filter(lettered, free), lambda x: mean_ratio(x["value"]) >= least(x["value"]))
    spans = F.array_sort(F.concat("base", F.when(F.size("runs") > 0, found).otherwise(F.col("runs"))))
    return rows.select(F.col("id").alias(id_column), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of the pattern kinds, a digest of their spans, and all spans."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        id_column, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
