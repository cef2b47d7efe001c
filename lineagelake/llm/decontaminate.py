"""Benchmark decontamination: a BM25 index of the test items, searched with every training passage by block-max WAND.

Test items of up to ENTRY_WORDS words are an entry; longer ones are cut into entries of just ENTRY_WORDS words, spread
evenly and overlapping, so that the last holds the item's last words. An entry's BM25 weights are divided by its score against
itself, so one threshold holds for all. Every training text is cut into overlapping passages that are long enough to
hold a whole entry. For a passage

1. terms so common that all of them together can't lift an entry by more than `slack` are set aside (the pivot test of
   WAND): a passage whose other terms can't reach threshold - slack even at their maxima is skipped; running sums test
   all passages of a text at once;
2. for the rest, the maxima of the terms' posting blocks are added up by block, and blocks below the threshold skipped;
3. entries in the blocks left are scored exactly, and all at or above the threshold are retrieved;
4. question and answer are verified: the share of the question's word trigrams, and of the answer's words, that occur
   in the passage. The last sentence of an item is its answer; an item of one sentence is a question alone. An item of
   several entries is verified whole, against the passage and the words around it where the item's others would stand.

Words are ASCII lower-cased runs without white space and ASCII punctuation. An index of up to MAX_BROADCAST bytes goes
to each executor whole; a longer one is cut into shards that are searched one after the other with all passages, each
index being given up when its result is written, with term statistics of all items either way.

Null or empty texts and null ids match nothing, as do items without words. Repeated rows give their document's result
once, repeated items each give theirs. Of passages with equal scores the one that covers more, then the first, is told.
Columns with other names are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagelake.llm.common import unused, written

ENTRY_WORDS = 64
STRIDE = 64
K1, B = 1.2, 0.75
THRESHOLD = 0.6
SLACK = 0.25
BLOCK_ENTRIES = 32
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.5, 0.5
MAX_BROADCAST = 64 << 20
RESULT = "doc_id long, item_id long, entry int, score double, question_overlap double, answer_overlap double, first_word long"

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE = bytes(32 if bytes([c]) in [_PUNCTUATION[i : i + 1] for i in range(len(_PUNCTUATION))] else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SENTENCE_END = re.compile(r"(?<=[.?!])\s+|\n+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def placed_entries(text: str | None) -> list[tuple[list[bytes], int, int, int]]:
    """(words, words of the question, first word, words of the item's question) for each entry of an item."""
    if not text:
        return []
    parts = [w for s in _SENTENCE_END.split(text) if (w := words(s))]
    flat = [w for p in parts for w in p]
    asked = len(flat) - (len(parts[-1]) if len(parts) > 1 else 0)
    n = -(-len(flat) // ENTRY_WORDS)
    out = []
    for k in range(n):
        at = k * (len(flat) - ENTRY_WORDS) // (n - 1) if n > 1 else 0
        piece = flat[at : at + ENTRY_WORDS]
        q = min(max(0, asked - at), len(piece))
        out.append((piece, q or len(piece), at, asked))
    return out


def entries_of(text: str | None) -> list[tuple[list[bytes], int]]:
    """(words, words of the question) for each entry of an item."""
    return [(w, q) for w, q, _, _ in placed_entries(text)]


def _trigrams(ws: list) -> set:
    k = min(3, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if k else set()


@dataclass
class Index:
    vocab: dict[bytes, int]
    starts: np.ndarray  # of each term's postings
    entry: np.ndarray
    weight: np.ndarray
    block_starts: np.ndarray  # of each term's blocks
    block: np.ndarray
    block_max: np.ndarray
    essential: np.ndarray  # a term's maximum, 0 if it is set aside
    slack: float
    meta: list[tuple[int, int, list[bytes], int]]  # item, entry number, words, question words
    whole: list[tuple[list[bytes], int, int]]  # all words of the entry's item, its question words, the entry's first word


def build(rows: list, df: dict[bytes, int], n: int, mean_len: float, slack: float = SLACK) -> Index:
    """rows: (item_id, entry, words, question words), with the first word and the item's question words where it has several
    entries; these are in a row."""
    meta = [(r[0], r[1], list(r[2]), r[3]) for r in rows]
    whole, item = [], []
    for (_, number, ws, q), r in zip(meta, rows):
        at, asked = r[4:] or (0, q)
        if number == 0:
            item = []
        item += ws[len(item) - at :]
        whole.append((item, asked, at))
    vocab: dict[bytes, int] = {}
    term, entry, weight = [], [], []
    for e, (_, _, ws, _) in enumerate(meta):
        own = []
        for w, tf in Counter(ws).items():
            idf = np.log1p((n - df[w] + 0.5) / (df[w] + 0.5))
            own.append((vocab.setdefault(w, len(vocab)), idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean_len))))
        total = sum(x for _, x in own)
        for t, x in own:
            term.append(t)
            entry.append(e)
            weight.append(x / total)
    term, entry, weight = np.array(term, np.int64), np.array(entry, np.int64), np.array(weight, float)
    order = np.lexsort((entry, term))
    term, entry, weight = term[order], entry[order], weight[order]
    starts = np.searchsorted(term, np.arange(len(vocab) + 1))
    key = term * (len(meta) // BLOCK_ENTRIES + 1) + entry // BLOCK_ENTRIES
    first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    block_max = np.maximum.reduceat(weight, first) if len(key) else weight
    tops = np.maximum.reduceat(weight, starts[:-1]) if len(vocab) else np.zeros(0)
    # set terms aside from the commonest on, while no entry gets more than slack from all of them
    gained, essential = np.zeros(len(meta)), tops.copy()
    for t in np.argsort(-np.diff(starts), kind="stable"):
        own = slice(starts[t], starts[t + 1])
        gained[entry[own]] += weight[own]
        if gained[entry[own]].max() > slack:
            break
        essential[t] = 0
    return Index(vocab, starts, entry, weight, np.searchsorted(term[first], np.arange(len(vocab) + 1)), entry[first] // BLOCK_ENTRIES, block_max, essential, slack, meta, whole)


def _gather(starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    lo, n = starts[terms], starts[terms + 1] - starts[terms]
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def retrieve(index: Index, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose score for these distinct terms reaches the threshold, and the scores."""
    at = _gather(index.block_starts, terms)
    bound = np.bincount(index.block[at], index.block_max[at])
    open_ = bound >= threshold - 1e-9
    if not open_.any():
        return np.zeros(0, np.int64), np.zeros(0)
    at = _gather(index.starts, terms)
    at = at[open_[index.entry[at] // BLOCK_ENTRIES]]
    score = np.bincount(index.entry[at], index.weight[at])
    hit = np.flatnonzero(score >= threshold - 1e-9)
    return hit, score[hit]


def search(index: Index, text: str, threshold: float) -> dict[int, tuple[float, float, float, int]]:
    """entry -> (score, question overlap, answer overlap, first word) of its best verified passage."""
    ws = words(text)
    terms = np.fromiter(map(index.vocab.get, ws, repeat(-1)), np.int64, len(ws))
    known = np.flatnonzero(terms >= 0)
    if not len(known):
        return {}
    top = np.zeros(len(ws) + 1)
    top[known + 1] = index.essential[terms[known]]
    running = np.cumsum(top)
    lo = np.arange(0, max(1, len(ws) - ENTRY_WORDS), STRIDE) if len(ws) > ENTRY_WORDS else np.zeros(1, np.int64)
    hi = np.minimum(lo + ENTRY_WORDS + STRIDE, len(ws))
    found: dict[int, tuple[float, float, float, int]] = {}
    for a, b in zip(*(x[running[hi] - running[lo] >= threshold - index.slack - 1e-9] for x in (lo, hi))):
        own = np.unique(terms[a:b])
        hits, scores = retrieve(index, own[own >= 0], threshold)
        if not len(hits):
            continue
        near = None
        for e, score in zip(hits.tolist(), scores.tolist()):
            item, q, at = index.whole[e]
            lo_, hi_ = max(0, a - at), b + len(item) - at - len(index.meta[e][2])
            if near != (lo_, hi_):
                near, passage, grams = (lo_, hi_), set(ws[lo_:hi_]), _trigrams(ws[lo_:hi_])
            question, answer = _trigrams(item[:q]), set(item[q:])
            if len(item[:q]) < 3:
                asked = len(set(item[:q]) & passage) / max(1, len(set(item[:q])))
            else:
                asked = len(question & grams) / len(question)
            given = len(answer & passage) / len(answer) if answer else 1.0
            if asked >= QUESTION_OVERLAP and given >= ANSWER_OVERLAP and (e not in found or score > found[e][0]):
                found[e] = (score, asked, given, int(a))
    return found


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, item_id, entry, score, question_overlap, answer_overlap, first_word), a row for each document and entry."""
    spark = docs.sparkSession

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(i, x, k, *e) for i, t, x in zip(pdf["i"], pdf["t"], pdf["x"]) for k, e in enumerate(placed_entries(t))]
            yield pd.DataFrame(rows, columns=["item_id", "item_text", "entry", "words", "question", "at", "asked"])

    entries = written(items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null").distinct().withColumn("x", F.md5("t")).mapInPandas(cut, "item_id long, item_text string, entry int, words array<binary>, question int, at int, asked int"))
    count, mean_len, size = entries.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.expr("aggregate(words, 0L, (a, w) -> a + length(w) + 64)"))).first()
    df = written(entries.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null and text is not null")
    shards, found = max(1, -(-(size or 0) // max_broadcast)), []
    for shard in range(shards):
        mine = entries.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(shards)) == shard)
        known = mine.select(F.explode("words").alias("w")).distinct().join(df, "w")
        index = build([(r.item_id, r.entry, [bytes(w) for w in r.words], r.question, r.at, r.asked) for r in mine.orderBy("item_id", "item_text", "entry").collect()], {bytes(r.w): r.n for r in known.collect()}, count, mean_len or 1.0)
        sent = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                rows = []
                for d, t in zip(batch.column("doc_id"), batch.column("text")):
                    for e, (score, asked, given, at) in search(index, t.as_py(), threshold).items():
                        rows.append((d.as_py(), index.meta[e][0], index.meta[e][1], score, asked, given, at))
                yield pa.RecordBatch.from_pydict(
                    {n: [r[k] for r in rows] for k, n in enumerate(("doc_id", "item_id", "entry", "score", "question_overlap", "answer_overlap", "first_word"))},
                    schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("entry", pa.int32()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())]),
                )

        if shards == 1:
            found.append(base.mapInArrow(scan, RESULT))
        else:  # one index at a time
            found.append(written(base.mapInArrow(scan, RESULT)))
            sent.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap", (-F.col("first_word")).alias("m"))).alias("s")
    return out.groupBy("doc_id", "item_id", "entry").agg(best).select("doc_id", "item_id", "entry", "s.score", "s.question_overlap", "s.answer_overlap", (-F.col("s.m")).alias("first_word"))


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """docs without the documents that hold a test item; null ids stay."""
    own = unused("leaked", docs)
    leaked = find_leaks(docs, items, doc_id=doc_id, **how).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaked, docs[doc_id].cast("long") == leaked[own], "left_anti")
