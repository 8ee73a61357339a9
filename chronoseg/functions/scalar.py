"""Sets, intervals, times and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import cosine, once

#: Words that are no keywords.
STOP_WORDS = ["的", "了", "是", "在", "有", "就", "这", "那", "也", "还", "都", "我", "你", "他", "她", "它", "们", "个", "什么", "这个", "那个", "一个", "没有", "不是", "因为", "所以", "但是"]
WORD = r"[\p{L}\p{N}_]{2,}"


def rounded(value, digits: int) -> Column:
    """Half away from zero of the scaled double, as DuckDB rounds; F.round goes by the shortest decimal that gives the double."""
    scaled = _c(value) * 10.0**digits
    near = F.rint(scaled)
    return F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / 10.0**digits


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def jaccard(a, b, both_empty: float = 0.5, one_empty: float = 0.0) -> Column:
    """Of two arrays as sets; null counts as empty."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(_c(a), empty), F.coalesce(_c(b), empty)
    none_a, none_b = F.size(a) == 0, F.size(b) == 0
    rate = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when(none_a & none_b, both_empty).when(none_a | none_b, one_empty).otherwise(rate)


def overlap_coefficient(a, b) -> Column:
    """Common elements over the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(_c(a))), F.size(F.array_distinct(_c(b))))
    return F.when(least > 0, F.size(F.array_intersect(_c(a), _c(b))) / least).otherwise(0.0)


def overlap(start_a, end_a, start_b, end_b) -> Column:
    """Common length of two intervals, 0 if they only touch."""
    both = F.least(_c(end_a), _c(end_b)) - F.greatest(_c(start_a), _c(start_b))
    return F.greatest(both, F.lit(0).cast("double"))


def seconds_to_frame(seconds, fps) -> Column:
    """Half away from zero."""
    return F.round(_c(seconds) * fps).cast("long")


def seconds_to_frame_even(seconds, fps) -> Column:
    """Half to even."""
    return F.rint(_c(seconds) * fps).cast("long")


def frame_start_ms(frame, fps, duration=None, total=None) -> Column:
    """By duration over total where both are known, else by fps."""
    per = F.lit(1000.0) / fps
    if duration is not None:
        per = F.when((_c(total) > 0) & (_c(duration) > 0), _c(duration) * 1000.0 / _c(total)).otherwise(per)
    return _c(frame) * per


def frame_to_sample(frame, duration, rate, total, fallback_fps: float = 24.0) -> Column:
    known = (_c(total) > 0) & (_c(duration) > 0)
    return F.when(known, (_c(frame) * _c(duration) * rate / _c(total)).cast("long")).otherwise((_c(frame) / fallback_fps * rate).cast("long"))


def rational(text, default: float = 24.0) -> Column:
    """a/b or a number; the default if it is neither or b is 0."""
    a, b = F.split_part(_c(text), F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(_c(text), F.lit("/"), F.lit(2))
    value = F.when(b == "", a).when(b.try_cast("double") > 0, F.try_divide(a, b.try_cast("double")))
    return F.coalesce(F.when(value > 0, value), F.lit(default))


def keywords(text, k: int = 5, stop: list[str] | None = None) -> Column:
    """The k most frequent words of two characters or more, stop words apart; of equals, the first to appear."""
    stop = STOP_WORDS if stop is None else stop
    words = F.filter(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(stop))
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def ranked(rows: Column) -> Column:
        """Words sorted by word and place: where each word's run begins, and how long it is."""
        begins = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | (F.get(rows, i)["w"] != F.get(rows, i - 1)["w"]))
        runs = once(begins, lambda at: F.transform(at, lambda h, j: F.struct((h - F.coalesce(F.get(at, j + 1), F.size(rows))).alias("n"), F.get(rows, h)["i"].alias("i"), F.get(rows, h)["w"].alias("w"))))
        return F.transform(F.slice(F.array_sort(runs), 1, k), lambda x: x["w"])

    empty = F.array().cast("array<string>")
    return F.when(F.size(placed) > 0, once(placed, ranked)).otherwise(empty)


def trim_to_sentence(text) -> Column:
    """Up to the last full stop, unless that is the first character or there is none; trimmed."""
    text = F.trim(_c(text))
    cut = F.regexp_extract(text, r"(?s)^(.+[。.])", 1)
    return F.trim(F.when(cut != "", cut).otherwise(text))


def json_object(text, schema: str) -> Column:
    """The object from the first brace to the last, by a schema; null fields where it is malformed or absent."""
    return F.from_json(F.regexp_extract(_c(text), r"(?s)\{.*\}", 0), schema)


def scene_id(n) -> Column:
    return F.format_string("sc_%03d", _c(n))


def base_name(path) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def valid_utf8(raw) -> Column:
    return F.is_valid_utf8(_c(raw))


def decide(a: Column, b: Column, mode: str = "and") -> Column:
    """Whether to merge by two conditions: both, or either."""
    return a & b if mode == "and" else a | b


def profile_or_fallback(text, schema: str, has_image) -> Column:
    """A model's answer as a profile: its JSON object; without an image one that says so; with an answer that is no
    object, its first 100 characters in _raw."""
    parsed = json_object(text, schema)
    failed = F.struct(*[(F.substring(_c(text), 1, 100) if c.split()[0] == "_raw" else F.lit(None).cast("string")).alias(c.split()[0]) for c in schema.split(", ")])
    none = F.struct(*[(F.lit("no picture") if c.split()[0] == "visual_summary" else F.lit(None).cast("string")).alias(c.split()[0]) for c in schema.split(", ")])
    found = F.regexp_extract(_c(text), r"(?s)\{.*\}", 0) != ""
    good = found & F.exists(F.array(*[parsed[c.split()[0]] for c in schema.split(", ")]), lambda x: x.isNotNull())
    return F.when(~has_image, none).when(good, parsed).otherwise(failed)


def rerank_keywords(words, text_vec, word_vecs, hints, least: float = 0.1, most: int = 8, k: int = 5) -> Column:
    """Keywords by cosine to the text (above `least`, the `most` best), of them those that contain a hint, else all; the
    first k. word_vecs holds a vector for each word."""
    scored = F.zip_with(_c(words), _c(word_vecs), lambda w, v: F.struct((-cosine(v, _c(text_vec))).alias("s"), w.alias("w")))
    best = F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["s"] < -least)), 1, most), lambda x: x["w"])
    hinted = F.filter(best, lambda w: F.exists(_c(hints), lambda h: F.contains(w, h)))
    return F.slice(F.when(F.size(hinted) > 0, hinted).otherwise(best), 1, k)
