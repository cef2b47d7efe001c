"""Token ids as directly addressable codes.

Each id is cut into chunks of CHUNK_BITS bits, least first. Level 0 holds the first chunk of every id, level l + 1 the
next chunk of those ids of level l that go on; a bitmap per level says which do, and a rank directory (ones before each
block of 512 bits) finds an id's place on the next level with one popcount. So any token is read from a few bytes of
each level, without decoding what stands before it.

Segment file format, little-endian: magic "DAC1", uint32 bits per chunk, uint32 levels, uint64 documents, uint64 tokens,
documents x int64 doc_id, (documents + 1) x uint64 token offsets; then per level uint64 entries, the chunks as bytes or
16-bit words, the bitmap padded to 64-bit words, and the directory as uint32 per 512 bits.

A file is one segment: a run of documents in ascending doc_id order, of at most SEGMENT_TOKENS tokens beyond its last
document. Spark writes segments as rows of a Parquet table in the shared folder, with the part and number that order
them, so that lost tasks are simply run again.

Ids are those of the library's own call without added special tokens; a special token within a text is its one id. Null
texts are encoded as empty; each document ends with end_id. Null doc_ids come first and are kept as null. Repeated
rows stay, in a row. An empty table gives an empty result. A text of any length is one document of one segment.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.llm.common import written

CHUNK_BITS = 8
SEGMENT_TOKENS = 1 << 20
RANK_BITS = 512
#: Texts cut and encoded at a time.
HELD = 1024
NULL_ID = -(1 << 63)
SEGMENT = "part int, segment int, docs long, tokens long, file binary"

#: Texts that can't be cut before each space and each newline, in RE2's syntax: with other white space, control characters
#: that only some call white space, or runs of white space, which the tokeniser keeps together but for their last
#: character. Two newlines within a text are no such run.
ODD = r"[\x{9}\x{b}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n |\n\n\n|\n\n\z"
#: Safe places to cut these, in Python's syntax: a run of white space but for its last character, then that character with
#: what follows; and characters whose class is in doubt, whose texts are encoded whole.
PIECES = re.compile(r"\s?\S+|\s+(?=\s\S)|\s+\Z")
DOUBTFUL = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Stands before the first word of a text, which has no space before it.
FIRST = "\x1f"


class Encoder:
    """Encodes texts with a public tokenizer file; remembers the ids of words up to a bound.

    A byte-level tokenizer cuts texts at white space first, so a word with the one white space before it has the same ids
    wherever it stands. A batch is cut and its distinct words are told by Arrow; the library encodes those not yet known,
    many in a row. Texts with a special token, and all texts for other tokenizers, are encoded whole.
    """

    MEMO, IN_A_ROW = 1_000_000, 1000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), {}
        said = json.loads(self.tokenizer.to_str())
        cut = said["pre_tokenizer"] or {}
        self.by_word = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex"), said["normalizer"], said["model"].get("dropout")) == ("ByteLevel", False, True, None, None)
        #: The library looks for these before it cuts a text.
        self.whole = (*DOUBTFUL, *[t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        #: Ids of tokens that begin with a space or a newline, as this kind of tokenizer spells them.
        vocab = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith(("\u0120", "\u010a"))]] = True

    def _fresh(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with a white space and have no other, encoded in rows; tokens never go across words."""
        out = []
        for k in range(0, len(words), self.IN_A_ROW):
            own = words[k : k + self.IN_A_ROW]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, "<u4")
            at = (4 * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
            if len(at) != len(own) + 1 or at[0]:
                raise RuntimeError("a tokenizer that joins words")
            data = ids.tobytes()
            out += [data[lo:hi] for lo, hi in zip(at, at[1:])]
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of each of these distinct words; those that aren't remembered are encoded first."""
        got = list(map(self.memo.get, words))
        if None in got:
            if len(self.memo) > self.MEMO:  # the commonest came first
                for late in list(self.memo)[self.MEMO // 2 :]:
                    del self.memo[late]
            new = [w for w, x in zip(words, got) if x is None]
            inner = [w for w in new if w and not w.startswith(FIRST)]
            fresh = dict(zip(inner, self._fresh_words([w if w[0] == "\n" else " " + w for w in inner])))
            others = [w for w in new if w not in fresh]
            fresh |= zip(others, self._fresh([w[1:] if w else " " for w in others]))
            self.memo |= fresh
            got = [fresh[w] if x is None else x for w, x in zip(words, got)]
        return got

    def __call__(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        for t in self.whole if self.by_word else ():
            odd |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            own = texts.take(pa.array(plain)) if odd.any() else texts
            lists = pc.split_pattern(pc.binary_join_element_wise(FIRST, pc.replace_substring(own, "\n", " \n"), ""), " ")
            words = lists.flatten().dictionary_encode()
            ids = self._known(words.dictionary.to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            index = words.indices.to_numpy()
            blob = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes // 4)]).astype(np.int32), pa.array(np.frombuffer(b"".join(ids), "<u4")))
            flat = blob.take(words.indices).flatten().to_numpy().tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes[index])])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
            for i, lo, hi in zip(plain.tolist(), ends, ends[1:]):
                out[i] = flat[lo:hi]
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            pieces = [text] if not self.by_word or any(map(text.__contains__, self.whole)) else PIECES.findall(text)
            distinct = list(set(pieces))
            known = dict(zip(distinct, self._fresh(distinct)))
            out[i] = b"".join(map(known.__getitem__, pieces))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: what a task has learned serves the worker's next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bits: int = CHUNK_BITS) -> bytes:
    """The segment file of these documents."""
    chunk = np.uint8 if bits == 8 else np.uint16
    body, levels, rest = [], 0, ids.astype(np.uint32)
    while levels == 0 or len(rest):
        more = rest >> np.uint32(bits) > 0
        words = -(-len(rest) // 64)
        bitmap = np.zeros(words * 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bitmap[: len(packed)] = packed
        ones = np.bitwise_count(bitmap).reshape(-1, 8).sum(1, dtype=np.int64)
        per_block = np.add.reduceat(ones, np.arange(0, words, RANK_BITS // 64)) if words else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4") if words else np.zeros(0, "<u4")
        body += [struct.pack("<Q", len(rest)), (rest & np.uint32((1 << bits) - 1)).astype(chunk).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest = rest[more] >> np.uint32(bits)
        levels += 1
    head = struct.pack("<4sIIQQ", b"DAC1", bits, levels, len(doc_ids), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), offsets.astype("<u8").tobytes(), *body])


class Segment:
    """Random access into a segment file."""

    def __init__(self, data: bytes):
        magic, self.bits, levels, docs, self.tokens = struct.unpack_from("<4sIIQQ", data)
        if magic != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        at = struct.calcsize("<4sIIQQ")
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.offsets = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8 if self.bits == 8 else "<u2", n, at)
            at += chunks.nbytes
            bitmap = np.frombuffer(data, np.uint8, -(-n // 64) * 8, at)
            at += bitmap.nbytes
            ranks = np.frombuffer(data, "<u4", -(-n // RANK_BITS), at)
            at += ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    def rank(self, level: int, i: int) -> int:
        """Continuing entries before entry i of the level: directory, whole bytes, and the rest of one byte."""
        _, bitmap, ranks = self.levels[level]
        block = i // RANK_BITS
        whole = bitmap[block * (RANK_BITS // 8) : i // 8]
        last = int(bitmap[i // 8]) & ((1 << i % 8) - 1)
        return int(ranks[block]) + int(np.bitwise_count(whole).sum()) + last.bit_count()

    def token(self, i: int) -> int:
        """The i-th id of the segment."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self.rank(level, i), shift + self.bits
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi, level by level: the same walk for a run of places."""
        out, places, where = np.zeros(hi - lo, "<u4"), np.arange(lo, hi), np.arange(hi - lo)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if not len(places):
                break
            out[where] |= chunks[places].astype(np.uint32) << np.uint32(level * self.bits)
            more = (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
            if not more.any():
                break
            first = self.rank(level, int(places[0]))
            where = where[more]
            places = first + np.arange(len(where))  # continuing entries of a run are a run on the next level
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.offsets[k]), int(self.offsets[k + 1]))


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, part_of) -> Iterator[pa.RecordBatch]:
    encode, part, number = encoder(path), part_of(), 0
    end = np.array([end_id], "<u4").tobytes()
    docs, ids, size = [], [], 0

    def flush() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
        file = pack(np.array([NULL_ID if d is None else d for d in docs], np.int64), offsets, np.frombuffer(b"".join(ids), "<u4"))
        columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(docs)], pa.int64()), pa.array([size], pa.int64()), pa.array([file], pa.binary())]
        return pa.record_batch(columns, names=["part", "segment", "docs", "tokens", "file"])

    for batch in batches:
        names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for k in range(0, len(texts), HELD):
            for d, x in zip(names[k : k + HELD], encode(texts.slice(k, HELD))):
                docs.append(d)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= SEGMENT_TOKENS:
                    yield flush()
                    docs, ids, size, number = [], [], 0, number + 1
    if docs:
        yield flush()


def write_codes(docs: DataFrame, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes the texts in ascending doc_id order and writes the segment files; returns the written table."""

    def part_of() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId()

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # rows of one id, or without any, are dealt by their texts
    ordered = base.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(lambda b: _segments(b, tokenizer_path, end_id, part_of), SEGMENT))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, segment, file in zip(batch.column("part"), batch.column("segment"), batch.column("file")):
            s = Segment(file.as_py())
            n = len(s.doc_ids)
            ids = memoryview(s.slice(0, s.tokens)).cast("B")  # one walk over the levels for all its documents
            cuts = (4 * s.offsets).tolist()
            sums = [zlib.crc32(ids[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
            columns = [
                pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == NULL_ID), pa.array([part.as_py()] * n, pa.int32()), pa.array([segment.as_py()] * n, pa.int32()),
                pa.array(range(n), pa.int32()), pa.array(s.offsets[:-1], pa.int64()), pa.array(np.diff(s.offsets), pa.int64()), pa.array(sums, pa.int64()),
            ]
            yield pa.record_batch(columns, names=["doc_id", "part", "segment", "place", "at", "n_tokens", "ids_crc32"])


def read_index(codes: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files; start counts all ids before."""
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = codes.select("part", "segment", "tokens")
    before_part = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    # one row for each part: a prefix sum over the parts, then one over the segments of a part
    before_part = before_part.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = sizes.join(before_part, "part").select("part", "segment", (F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("base"))
    rows = codes.select("part", "segment", "file").mapInArrow(_index, "doc_id long, part int, segment int, place int, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
