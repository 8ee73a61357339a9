"""Token ids as directly addressable codes.

An id is split into chunks of fixed widths, lowest first. Level k holds chunk k of the ids that have one, in order, and
a bitmap of which of them continue on level k + 1, with a rank directory: the number of set bits before each block of
512. The chunk of an id on the next level stands at the rank of its bit, so any token is read with one look-up for
each of its chunks and without decoding a block.

A segment (a run of whole documents, in the order of the file) is one such code:

    magic "DAC1", uint8 levels, uint64 tokens, then for each level: uint8 width in bytes, uint64 chunks,
    the chunks (little endian), the bitmap (bit i of byte i // 8; not on the last level), the directory (uint32)

Files are Parquet with one row for each segment, in a column `dac`, beside its documents' ids and token counts, so
that Spark's commit protocol covers lost executors.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_of, stash

BLOCK = 512
WIDTHS = (1, 1, 2)
#: A segment is closed when it has so many tokens; a longer document is one segment.
SEGMENT = 1 << 18
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_KIND = {1: "<u1", 2: "<u2", 4: "<u4"}


def dac_encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """ids: unsigned, below 256 to the power of the sum of widths."""
    rest, out = np.asarray(ids, np.uint64), []
    if len(rest) and int(rest.max()) >> (8 * sum(widths)):
        raise ValueError("an id needs more bytes than the levels have")
    for k, width in enumerate(widths):
        shift = np.uint64(8 * width)
        out.append(struct.pack("<BQ", width, len(rest)) + (rest & np.uint64((1 << (8 * width)) - 1)).astype(_KIND[width]).tobytes())
        rest = rest >> shift
        more = rest > 0
        if k == len(widths) - 1 or not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        counts = _POP[bits].reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        rank = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
        out[-1] += bits.tobytes() + rank.tobytes()
        rest = rest[more]
    return struct.pack("<4sBQ", b"DAC1", len(out), len(ids)) + b"".join(out)


class Dac:
    """Reads a code: len(), get() of any positions, all()."""

    def __init__(self, raw: bytes):
        magic, levels, self.n = struct.unpack_from("<4sBQ", raw)
        if magic != b"DAC1":
            raise ValueError("not a token segment")
        at, self.levels = 13, []
        for k in range(levels):
            width, n = struct.unpack_from("<BQ", raw, at)
            at += 9
            chunks = np.frombuffer(raw, _KIND[width], n, at)
            at += n * width
            bits = rank = None
            if k < levels - 1:
                blocks = -(-n // BLOCK)
                bits = np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at)
                at += len(bits)
                rank = np.frombuffer(raw, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((8 * width, chunks, bits, rank))

    def __len__(self) -> int:
        return self.n

    def get(self, positions) -> np.ndarray:
        """The ids at positions, by rank from level to level."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position out of range")
        out, who, shift = np.zeros(len(at), np.uint64), np.arange(len(at)), 0
        for width, chunks, bits, rank in self.levels:
            out[who] |= chunks[at].astype(np.uint64) << np.uint64(shift)
            shift += width
            if bits is None:
                break
            byte = at >> 3
            go = (bits[byte] >> (at & 7).astype(np.uint8)) & 1 > 0
            at, who, byte = at[go], who[go], byte[go]
            inside = byte[:, None] // 64 * 64 + np.arange(64) if len(at) else np.zeros((0, 64), np.int64)
            before = np.where(inside < byte[:, None], _POP[bits[inside]], 0).sum(1, dtype=np.int64)
            part = _POP[bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]
            at = rank[at // BLOCK].astype(np.int64) + before + part
        return out.astype(np.uint32)

    def all(self) -> np.ndarray:
        out, who, shift = np.zeros(self.n, np.uint32), slice(None), 0
        for width, chunks, bits, _ in self.levels:
            out[who] |= chunks.astype(np.uint32) << np.uint32(shift)
            shift += width
            if bits is not None:
                go = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
                who = go if isinstance(who, slice) else who[go]
        return out


#: Texts of these characters only are cut here as the tokenizer does it: contractions, letters, single digits, other runs.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ \t\n\r\x0b\x0c]*")
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\\s]+")
#: Pieces that one call of the tokenizer gets, joined by spaces.
JOINED = 64


#: Texts that tell whether a tokenizer cuts texts to words as above.
PROBES = (
    "", " ", "Hello  World\tit's 12,345.67 don't WE'LL they'd", "a--b ... (c) [d] {e} <f>", "É é naïve ß Ø ÿ × ÷ ſ", "x1y2 3z 0x1F a_b c/d", "'s 't 'S' ''s o'clock",
    "line\nline\r\n\x0b\x0c end", "漢字 かな 한국어 عربي हिन्दी", "ﬁ Ⅷ ½ ² e\u0301 I\u0307 İ", "<|startoftext|> <|endoftext|> <|x", "😀👍🏽 \u200d \u00a0 \u2003 x", "the the The THE thethe", "$ € £ 100% #tag @you a.b@c.de http://x.y/z?q=1",
)


class WordEncoder:
    """Encodes texts with a lower-casing tokenizer that drops white space and marks the last token of each word, by
    encoding each distinct word once. Texts of Latin letters are cut as the tokenizer's pre-tokenizer cuts them, others at
    ASCII white space. Remembered words have a bound; beyond it the first half stays, as frequent words are met early.
    Any other tokenizer, one without marks or that gives other ids for some of PROBES, gets whole texts."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.slots: dict[str, int] = {}
        self.tokens, self.used = np.zeros(1 << 20, np.uint32), 0
        self.begin, self.count = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)
        self.by_words = self.last.any()
        self.by_words = bool(self.by_words) and all(self.encode([t])[0].tolist() == ids for t, ids in zip(PROBES, self._library(list(PROBES)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each."""
        if not self.by_words:
            ids = self._library(texts)
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        split = [_CUT.findall(t.lower()) if _PLAIN.fullmatch(t) and "<|" not in t else ["\0" + w.decode() for w in t.encode().split()] for t in texts]
        words = list(chain.from_iterable(split))
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        slots = np.fromiter(map(self.slots.get, words, repeat(-1)), np.int64, len(words))
        if (slots < 0).any():
            new = list(dict.fromkeys(words[i] for i in np.flatnonzero(slots < 0)))
            if len(self.slots) + len(new) > self.most:
                self._forget()
                new = list(dict.fromkeys(w for w in words if w not in self.slots))
                if len(self.slots) + len(new) > self.most:  # more distinct words than the bound in one batch
                    if len(texts) > 1:
                        half = len(texts) // 2
                        a, b = self.encode(texts[:half]), self.encode(texts[half:])
                        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
                    more = np.zeros(len(self.slots) + len(new) + 1 - len(self.begin), np.int64)
                    self.begin, self.count = np.concatenate([self.begin, more]), np.concatenate([self.count, more])
            self._learn(new)
            slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        count = self.count[slots]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = self.tokens[np.arange(ends[-1]) + np.repeat(self.begin[slots] - ends[:-1], count)]
        doc = np.concatenate([[0], np.cumsum(per_text)])
        return out, ends[doc[1:]] - ends[doc[:-1]]

    def _forget(self) -> None:
        half = min(self.most // 2, len(self.slots))
        self.slots = dict(islice(self.slots.items(), half))
        self.used = int(self.begin[half - 1] + self.count[half - 1]) if half else 0
        self.begin, self.count = self.begin[: self.most + 1], self.count[: self.most + 1]

    def _learn(self, new: list[str]) -> None:
        for k in range(0, len(new), 64 * JOINED):
            part = new[k : k + 64 * JOINED]
            plain = [w for w in part if w[0] != "\0"]
            other = [w[1:] for w in part if w[0] == "\0"]
            flat, count = self._encode_plain(plain)
            whole = self._library(other)
            self._add(plain, flat, count)
            self._add(["\0" + w for w in other], np.fromiter(chain.from_iterable(whole), np.uint32), np.fromiter(map(len, whole), np.int64, len(whole)))

    def _add(self, words: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        if self.used + len(flat) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros(len(self.tokens) + len(flat), np.uint32)])
        self.tokens[self.used : self.used + len(flat)] = flat
        slot = len(self.slots)
        self.count[slot : slot + len(words)] = count
        self.begin[slot : slot + len(words)] = self.used + np.cumsum(count) - count
        self.used += len(flat)
        self.slots.update(zip(words, range(slot, slot + len(words)), strict=True))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Several words in one call; the marks of last tokens tell them apart."""
        ids = self._library([" ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)])
        flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(words):  # a tokenizer that marks no ends
            ids = self._library(words)
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        return flat, np.diff(ends, prepend=0)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


SEGMENTS = "part int, seq int, tokens long, documents long, ids binary, no_id binary, counts binary, dac binary"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text (null: empty), append end_id, and write segments in ascending id order (rows without an
    id first); returns the table of segments as read from its files, ordered by (part, seq).

    Rows that repeat an id are documents of their own, ordered by text. An empty table gives no segments; other columns
    are ignored."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(max(1, rows.rdd.getNumPartitions()), "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, held, n = encoder(tokenizer), TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            ids, missing, counts, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [[part], [seq], [len(tokens)], [len(ids)], [ids.astype("<i8").tobytes()], [np.packbits(missing, bitorder="little").tobytes()], [counts.astype("<u4").tobytes()], [dac_encode(tokens)]]
            return pa.RecordBatch.from_pydict({f.name: pa.array(v, f.type) for f, v in zip(_SEGMENT_TYPE, row, strict=True)})

        for batch in batches:
            texts, column = [t or "" for t in column_of(batch, "text").to_pylist()], column_of(batch, "id")
            ids, missing = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            for a in range(0, batch.num_rows, 128):
                b = min(a + 128, batch.num_rows)
                tokens, counts = enc.encode(texts[a:b])
                tokens = np.insert(tokens, np.cumsum(counts), end_id)
                held.append((ids[a:b], missing[a:b], counts + 1, tokens))
                n += len(tokens)
                if n >= SEGMENT:
                    yield close()
                    held, n, seq = [], 0, seq + 1
        if held:
            yield close()

    return stash(ordered.mapInArrow(run, SEGMENTS), "tokens")


_SEGMENT_TYPE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("tokens", pa.int64()), ("documents", pa.int64()), ("ids", pa.binary()), ("no_id", pa.binary()), ("counts", pa.binary()), ("dac", pa.binary())])


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document of a table of segments: doc_id, start (tokens before it), n_tokens, ids_crc32 (of its ids as little
    endian uint32)."""
    parts = segments.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition written
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("seq_start"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("seq_start") + F.col("part_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = Dac(row["dac"]).all().astype("<u4")
                counts = np.frombuffer(row["counts"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                missing = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(counts), bitorder="little") > 0
                crc = [zlib.crc32(tokens[e - c : e]) for c, e in zip(counts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(np.frombuffer(row["ids"], "<i8"), mask=missing),
                        "start": pa.array(row["start"] + ends - counts),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    n = segments.agg(F.count(F.lit(1))).first()[0]
    starts = F.broadcast(starts) if n <= 1_000_000 else starts  # 16 bytes for each segment
    return segments.join(starts, ["part", "seq"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
