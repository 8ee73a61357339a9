"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton of all pieces reads a text once. At each position the output links name every piece that ends there, and
each relaxes the best score of its end from that of its begin; the best segmentation is read off backward.

In a vocabulary of merges a piece may follow another only if merging the two together ends in the two: then merging any
prefix of a text ends in one piece only, the one that may follow what it extends, and the Viterbi gives the ids that
merging gives. Whether two pieces may meet is found by undoing their merges from the last to the first. In a unigram
vocabulary any piece may follow any other, and the scores decide.

Texts are cut first between characters that stand side by side in no piece, and the distinct parts of some hundred texts
are segmented at once. Spaces and word marks are the same character all through.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, frugal, text_buffers
from .common import pieces as row_ranges

MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Characters up to which parts are segmented together, and pairs of pieces that are remembered for longer ones.
LONG, PAIRS = 64, 100_000
#: Bytes of texts that are encoded at once.
RANGE = 1 << 19
_PROBES = ("", " ", "a  b ", "\ta\nB", "ﬁ é é Ⅷ", "漢字 ▁x", "12,345.67", "😀\x01")


class Automaton:
    """Aho-Corasick over strings, in flat arrays: goto links by state and character, failure links, and for each state its
    own pattern and the nearest shorter suffix that is one (the output link)."""

    def __init__(self, patterns: list[str]):
        go: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i, p in enumerate(patterns):
            state = 0
            for c in p:
                state = go.setdefault(state << 21 | ord(c), len(go) + 1)
            if p:
                ends[state] = i
        children: list[list[tuple[int, int]]] = [[] for _ in range(len(go) + 1)]
        for key, child in go.items():
            children[key >> 21].append((key & (1 << 21) - 1, child))
        pattern, fail, output = [ends.get(s, -1) for s in range(len(go) + 1)], [0] * (len(go) + 1), [-1] * (len(go) + 1)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for c, child in children[state]:
                back = fail[state]
                while back and back << 21 | c not in go:
                    back = fail[back]
                fail[child] = go.get(back << 21 | c, 0) if state else 0
                output[child] = fail[child] if pattern[fail[child]] >= 0 else output[fail[child]]
                queue.append(child)
        self.go = Table(np.array(list(go), np.int64), np.array(list(go.values()), np.int64))
        self.pattern, self.fail, self.output = np.array(pattern), np.array(fail, np.int64), np.array(output, np.int64)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after one more character each: along failure links until one has a goto link for it."""
        out = self.go.get(state << 21 | c).astype(np.int64)
        rest = np.flatnonzero((out < 0) & (state > 0))
        back = self.fail[state[rest]]
        while len(rest):
            out[rest] = to = self.go.get(back << 21 | c[rest])
            on = (to < 0) & (back > 0)
            rest, back = rest[on], self.fail[back[on]]
        return np.maximum(out, 0)


class Table:
    """Numbers by key, both from 0 on, in open addressing: many looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.values[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], at[~here] + 1 & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if it has none."""
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            at = at[rest] + 1 & self.mask if len(at) == len(keys) else at + 1 & self.mask
            held = self.keys[at]
            out[rest] = np.where(held == keys[rest], self.values[at], -1)
            on = (held != keys[rest]) & (held >= 0)
            rest, at = rest[on], at[on]
        return out


class Merges:
    """The merges of a vocabulary: which neighbours become one piece, and of which two each piece was made."""

    def __init__(self, pieces: list[str], scores: list[float]):
        self.size = len(pieces)
        at = {p: i for i, p in enumerate(pieces)}
        #: When a piece is made, earlier ones first; single characters stand there from the begin.
        self.rank = np.array([-score if len(p) > 1 else -np.inf for p, score in zip(pieces, scores, strict=True)])
        join = {}
        for i, p in enumerate(pieces):
            for k in range(1, len(p)):
                a, b = at.get(p[:k]), at.get(p[k:])
                if a is not None and b is not None:
                    join[a * self.size + b] = i
        parts = [self._last_merge(join, [at.get(c, -1) for c in p]) if len(p) > 1 else (i, i) for i, p in enumerate(pieces)]
        self.made = np.array([p is not None for p in parts], bool)
        self.left, self.right = (np.array([p[k] if p else -1 for p in parts]) for k in (0, 1))
        self.join = Table(np.array(list(join), np.int64), np.array(list(join.values()), np.int64))

    def _last_merge(self, join: dict[int, int], row: list[int]) -> tuple[int, int] | None:
        """The two pieces that merging a row joins last; None if it doesn't become one piece."""
        last = None
        while len(row) > 1:
            made = [join.get(a * self.size + b, -1) for a, b in pairwise(row)]
            able = [k for k, p in enumerate(made) if p >= 0]
            if not able or -1 in row:
                return None
            k = min(able, key=lambda k: self.rank[made[k]])
            last, row = (row[k], row[k + 1]), [*row[:k], made[k], *row[k + 2 :]]
        return last

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a and b together ends in a, b: as their merges are undone, the last first, no two pieces
        beside the border would have been joined before either was taken in on its own side."""
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        next_a, next_b = np.full(len(a), np.inf), np.full(len(a), np.inf)  # when the left, the right piece is taken in
        while len(live):
            over = self.join.get(a * self.size + b)
            r = np.where(over < 0, np.inf, self.rank[over])
            joined = (r < next_a) & (r <= next_b) & (over >= 0)  # of equal merges the left one comes first
            out[live[joined]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~joined & (np.maximum(ra, rb) > -np.inf)
            undo_a = ra > rb
            next_a, next_b = np.where(undo_a, ra, next_a)[go], np.where(undo_a, next_b, rb)[go]
            a, b, live = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go], live[go]
        return out


class PieceModel:
    """Pieces with scores; characters that no piece covers fall back to the pieces of their UTF-8 bytes. Whole scores are
    the ranks of merges, any others log probabilities. Models that change texts other than by a mark for each space and
    one before the text are refused."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(sp.get_piece_size())
        byte = {int(_BYTE.fullmatch(sp.id_to_piece(i))[1], 16): i for i in every if sp.is_byte(i)}
        self.byte = np.array([byte.get(b, sp.unk_id()) for b in range(256)])
        ids = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        texts = [sp.id_to_piece(i).replace(MARK, " ") for i in ids]
        scores = [sp.get_score(i) for i in ids]
        self.raw = [b""] * len(every)
        for i, text in zip([*byte.values(), *ids], [*(bytes([b]) for b in byte), *(t.encode() for t in texts)], strict=True):
            self.raw[i] = text
        self.merges = Merges(texts, scores) if all(float(s).is_integer() for s in scores) else None
        own = [k for k in range(len(ids)) if self.merges is None or self.merges.made[k]]
        self.automaton = Automaton([texts[k] for k in own])
        #: Of each state the piece that it spells, -1 for none.
        self.piece = np.append(own, -1)[self.automaton.pattern]
        self.ids, self.scores, self.lengths = np.array(ids, np.int32), np.array(scores), np.array([len(t) for t in texts])
        self.single = np.array(sorted(ord(t) for t in texts if len(t) == 1))
        #: Worse than any piece, so that bytes are used only where no piece fits.
        self.byte_score = min(scores) - 10.0
        pairs = np.array(sorted({ord(a) << 21 | ord(b) for k in own for a, b in pairwise(texts[k])}), np.int64)
        self.pairs = Table(pairs, np.zeros(len(pairs), np.int64))
        self._held: tuple = ()
        if any(self.encode(t) != sp.encode(t) for t in _PROBES):
            raise ValueError(f"{model_file} normalises texts in its own way")

    def _relaxed(self, state: np.ndarray, i: np.ndarray | int, best: Callable, last: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best score, last piece and its begin for texts that reach `state` at position i, from those of shorter
        prefixes, given by functions of which texts and positions; no piece is -1."""
        top, piece, begin = np.full(len(state), -np.inf), np.full(len(state), -1), np.zeros(len(state), np.int64)
        at = np.where(self.piece[state] >= 0, state, self.automaton.output[state])
        live = np.flatnonzero(at > 0)
        while len(live):
            p = self.piece[at[live]]
            a = i - self.lengths[p]
            fits = np.ones(len(live), bool)
            if self.merges:
                before = last(live, a)
                some = np.flatnonzero(before >= 0)
                fits[some] = self.merges.meet(before[some], p[some])
            score = best(live, a) + self.scores[p]
            better = fits & (score > top[live])
            to = live[better]
            top[to], piece[to], begin[to] = score[better], p[better], a[better]
            at[live] = self.automaton.output[at[live]]
            live = live[(at[live] > 0) & ~(fits & bool(self.merges))]  # by merges no other piece may follow
        return top, piece, begin

    def segment(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts (with spaces for marks) in one array, and where each one's begin (one more than parts): of
        the segmentations in which every piece may follow the one before, the one with the best sum of scores; of equals
        the one whose last pieces are the longest. All parts advance together by one character at a time, but for those
        longer than LONG, which go alone."""
        long = {k: np.array(self._alone(p), np.int32) for k, p in enumerate(parts) if len(p) > LONG}
        ids, at = self._together([p if len(p) <= LONG else "" for p in parts])
        if long:
            size = np.diff(at)
            size[list(long)] = [len(x) for x in long.values()]
            ids = np.concatenate([long[k] if k in long else ids[at[k] : at[k + 1]] for k in range(len(parts))])
            at = np.concatenate([[0], np.cumsum(size)])
        return ids, at

    def _spelled(self, c: int) -> list[int]:
        return self.byte[list(chr(c).encode("utf-8", "replace"))].tolist()

    def _alone(self, text: str) -> list[int]:
        """One text by plain loops; links and pairs that were met are remembered."""
        if not self._held:
            of, piece, own = self.automaton, self.piece.tolist(), set(self.single.tolist())
            self._held = (dict(zip(of.go.keys.tolist(), of.go.values.tolist(), strict=True)), of.fail.tolist(), of.output.tolist(), piece, self.lengths.tolist(), self.scores.tolist(), own, {})
        go, fail, output, pieces, lengths, scores, single, pairs = self._held
        best, begin, last, state = [0.0], [0], [-1], 0
        for i, c in enumerate(map(ord, text), 1):
            while (to := go.get(state << 21 | c)) is None and state:
                state = fail[state]
            state = at = to or 0
            top, way, piece = -np.inf, i - 1, -1
            if pieces[at] < 0:
                at = output[at]
            while at > 0:
                p = pieces[at]
                a = i - lengths[p]
                fits, before = True, last[a]
                if self.merges and before >= 0:
                    if (fits := pairs.get((before, p))) is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[before, p] = bool(self.merges.meet(np.array([before]), np.array([p]))[0])
                if fits and best[a] + scores[p] > top:
                    top, way, piece = best[a] + scores[p], a, p
                if fits and self.merges:
                    break
                at = output[at]
            if c not in single and (score := best[i - 1] + self.byte_score * len(self._spelled(c))) > top:
                top, way, piece = score, i - 1, -1
            best.append(top)
            begin.append(way)
            last.append(piece)
        out: list[list[int]] = []
        end = len(text)
        while end:
            out.append([int(self.ids[last[end]])] if last[end] >= 0 else self._spelled(ord(text[end - 1])))
            end = begin[end]
        return [i for ids in reversed(out) for i in ids]

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(-sizes, kind="stable")
        code = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        first = (np.cumsum(sizes) - sizes)[order]
        longest, n = int(sizes.max(initial=0)), len(parts)
        state, best = np.zeros(n, np.int64), np.zeros((longest + 1, n))
        last, begin = np.full((longest + 1, n), -1, np.int32), np.zeros((longest + 1, n), np.int32)
        size = sizes[order]
        for i in range(1, longest + 1):
            k = int(np.searchsorted(-size, -i, "right"))  # parts that have a character here
            c = code[first[:k] + i - 1]
            state = self.automaton.step(state[:k], c)
            top, piece, at = self._relaxed(state, i, lambda w, a: best[a, w], lambda w, a: last[a, w])
            bare = self.single[np.minimum(np.searchsorted(self.single, c), len(self.single) - 1)] != c  # else its piece is better than its bytes
            score = best[i - 1, :k] + self.byte_score * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
            bare &= score > top
            best[i, :k], last[i, :k], begin[i, :k] = np.where(bare, score, top), np.where(bare, -1, piece), np.where(bare, i - 1, at)
        # read off backward: the lane, its number from the end, and the id or, below 0, the character to spell in bytes
        lane, end = np.flatnonzero(size > 0), size[size > 0]
        lanes, values = [lane[:0]], [lane[:0]]
        while len(lane):
            piece = last[end, lane]
            lanes.append(lane)
            values.append(np.where(piece >= 0, self.ids[piece], -1 - code[first[lane] + end - 1]))
            end = begin[end, lane]
            lane, end = lane[end > 0], end[end > 0]
        lanes, values = np.concatenate(lanes)[::-1], np.concatenate(values)[::-1]
        by_part = np.argsort(order[lanes], kind="stable")
        part, values = order[lanes][by_part], values[by_part]
        spelled = np.flatnonzero(values < 0)
        raw = [self._spelled(-1 - v) for v in values[spelled].tolist()]
        wide = np.ones(len(values), np.int64)
        wide[spelled] = [len(r) for r in raw]
        out = np.repeat(values, wide).astype(np.int32)
        for at, r in zip((np.cumsum(wide) - wide)[spelled], raw, strict=True):
            out[at : at + len(r)] = r
        return out, np.concatenate([[0], np.cumsum(np.bincount(part, wide, n))]).astype(np.int64)

    def _cuts(self, text: str) -> np.ndarray:
        """Where no piece runs on, as a mask of positions: where a character stands beside the one before in no piece."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        out = np.ones(len(code) + 1, bool)
        out[1:-1] = self.pairs.get(code[:-1] << 21 | code[1:]) < 0
        return out

    def encode_rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin (one more than texts)."""
        marked = [" " + t.replace(MARK, " ") if t else "" for t in texts]
        row = np.cumsum([0, *map(len, marked)])
        flat = "".join(marked)
        cut = self._cuts(flat)
        cut[row] = True
        cuts = np.flatnonzero(cut)
        number: dict[str, int] = {}
        which = np.array([number.setdefault(flat[a:b], len(number)) for a, b in pairwise(cuts.tolist())], np.int64)
        parts = list(number)
        ids, at = self.segment(parts)
        size = at[which + 1] - at[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(at[which] - ends[:-1], size) + np.arange(ends[-1])], ends[np.searchsorted(cuts, row)]

    def encode(self, text: str) -> list[int]:
        """Spaces become word marks and one stands before the text; an empty text has no ids."""
        return self.encode_rows([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, path: str, text: str = "text", check: bool = True) -> DataFrame:
    """docs with piece_ids (array of int), n_pieces, and, with check, round_trip: whether decoding gives the text again.

    The model is read here and sent to the tasks (a few times the size of its file). A word mark in a text is a space
    after the round trip, so such a text has round_trip false. Null has null ids, no pieces and round_trip null; an empty
    text has no pieces. Rows that repeat are rows of their own, of the same pieces. Columns of these three names are
    replaced, others carried. An empty table gives no rows. Rows of a batch are encoded some at a time, by their bytes."""
    names = [c for c in docs.columns if c not in ("piece_ids", "n_pieces", "round_trip")]
    docs = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b in row_ranges(text_buffers(column_of(batch, text))[1], RANGE):
                part = batch.slice(a, b - a)
                texts = column_of(part, text).to_pylist()
                ids, at = m.encode_rows(texts)
                none = np.array([t is None for t in texts], bool)
                more = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids), mask=pa.array(none)), pa.array(np.diff(at))]
                if check:
                    flat, at = ids.tolist(), at.tolist()
                    more.append(pa.array([None if t is None else m.decode(flat[i:j]) == t for t, i, j in zip(texts, at, at[1:], strict=False)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*names, "piece_ids", "n_pieces", *["round_trip"] * check])

    added = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())] + [T.StructField("round_trip", T.BooleanType())] * check
    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, *added]))


def decode_pieces(encoded: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """encoded with decoded, the text of its ids; null ids give null, no ids the empty text. A column of that name is
    replaced, others are carried; repeated rows stay; an empty table gives no rows."""
    names = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(*names)
    shared = encoded.sparkSession.sparkContext.broadcast(model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [None if not x.is_valid else m.decode(x.values.to_numpy().tolist()) for x in column_of(batch, ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(frugal(run), T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def summary(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document the number of pieces, a digest of the ids and whether they decode to the text."""
    joined = F.concat_ws(",", F.col("piece_ids").cast("array<string>"))
    return encoded.select(id_column, "n_pieces", F.sha2(joined, 256).alias("ids_sha256"), "round_trip")
