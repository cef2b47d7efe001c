"""Spelling variant grouping: words one edit apart, by a positional q-gram index with a count filter.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Let c be the shorter one's
length. The edit lies in the first or in the second half of c places, so the words agree outside that half: such a half
is a hole, and the letters outside it are one long positional gram that both words have. A word has a key (c, hole, letters
outside) for each half as the shorter word, and again as the longer one.

1. Words are dealt by key. Where more than SPLIT words share one, the hole is halved and they are dealt again, until a
   hole is one place wide: words that agree outside a single place are near to each other, so no group stays large for
   words that aren't. No pair is lost: at each step the edit is in one of the halves.
2. Within a key, the bigrams of what the hole holds are posted with their places, sorted; a bigram looks up the lists of
   its own and the two next places. The lists of a word are merged (a sort of the lists in a row, which merges sorted
   runs; a heap gives the same counts slower), each entry counting a bigram in common. Words of r and s letters in the
   hole, r <= s <= r + 1, have at least s - 1 bigrams in common if they are near: one edit breaks two of s + 1 (both ends
   are padded). Lengths apart by two, and two words that are both the longer, are left out.
3. Pairs above the bound are verified by their common beginning and end. A pair is given once, by the hole that its first
   difference lies in.
4. Each word's near words are counted, and the most frequent one kept, by map-side sums. It is the word's form if it is
   `ratio` times as frequent. Frequencies grow along forms, so these chains are short and without circles; roots follow by
   pointer doubling.

Words are distinct and not empty; null words are left out, repeated ones have their counts summed. Words of any length and
any code points are handled; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.llm.common import ascii_lower, forget, written

#: A form is at least so many times as frequent.
RATIO = 10
#: Words that share a key before its hole is halved.
SPLIT = 4096
#: Words read before a task's whole groups are compared; entries of lists merged at a time.
CHUNK_WORDS, MERGED = 100_000, 4_000_000

NEAR = "word string, near string, near_n long"
NEAR_ARROW = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def runs_of(text: Column, letters: str, least: int) -> Column:
    """The maximal runs of at least so many letters, A-Z lower-cased. letters: a character class without brackets."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(f"([{letters}]{{{least},}})"), F.lit(1))


def _key() -> Column:
    """Names the hole and the letters outside."""
    return F.expr("xxhash64(c, a, b, substr(word, 1, a), if(c > b, right(word, c - b), ''))").alias("key")


def _dealt(words: DataFrame) -> DataFrame:
    """(word, n, c, a, b, key): c is the shorter word's length, the hole has the places from a to b."""
    halves = "flatten(transform(filter(array(l, l - 1), c -> c > 0), c -> filter(array(named_struct('c', c, 'a', 0, 'b', c div 2), named_struct('c', c, 'a', c div 2, 'b', c)), h -> h.b > h.a)))"
    rows = words.withColumn("l", F.length("word")).select("word", "n", F.inline(F.expr(halves)))
    return rows.select("word", "n", *[F.col(x).cast("int").alias(x) for x in "cab"], _key())


def _halved(rows: DataFrame) -> DataFrame:
    halves = "array(named_struct('c', c, 'a', a, 'b', (a + b) div 2), named_struct('c', c, 'a', (a + b) div 2, 'b', b))"
    rows = rows.select("word", "n", F.inline(F.expr(halves)))
    return rows.select("word", "n", *[F.col(x).cast("int").alias(x) for x in "cab"], _key())


def _grown(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths in a row: each entry's run, and its place in it."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


class Group:
    """Words with their keys: finds the near pairs within each key."""

    def __init__(self, words: list[str], keys: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length
        self.group = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        self.c, self.a, self.b = c.astype(np.int64), a.astype(np.int64), b.astype(np.int64)
        self.hole = self.length - self.a - (self.c - self.b)
        self.longer = self.length > self.c

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, list and place) of each bigram, by word; a hole of one letter has one more list, as its letter may differ."""
        word, place = _grown(self.hole + 1)
        at = self.start[word] + self.a[word] + place
        padded = np.append(self.letters, 0)
        before, after = np.where(place == 0, 0, padded[at - 1]), np.where(place == self.hole[word], 0, padded[np.minimum(at, len(self.letters))])
        ones = np.flatnonzero(self.hole == 1)
        word, place = np.concatenate([word, ones]), np.concatenate([place, np.zeros(len(ones), np.int64)])
        zeros = np.zeros(len(ones), np.int64)
        bigram = (self.group[word] << 42) | (np.concatenate([before, zeros]) << 21) | np.concatenate([after, zeros])
        order = np.argsort(word, kind="stable")
        lists = np.unique(bigram[order], return_inverse=True)[1].astype(np.int64)
        return word[order], lists * (place.max() + 3) + place[order]

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs with enough bigrams in common, in blocks of words."""
        word, post = self.postings()
        order = np.argsort(post, kind="stable")
        sorted_post, sorted_word = post[order], word[order]
        low, high = np.searchsorted(sorted_post, post - 1, "left"), np.searchsorted(sorted_post, post + 1, "right")
        ends = np.append(np.flatnonzero(word[1:] != word[:-1]) + 1, len(word))
        done, cum = 0, np.cumsum(high - low)
        while done < len(word):
            before = cum[done - 1] if done else 0
            k = np.searchsorted(cum[ends - 1], before + MERGED, "right")
            end = max(ends[min(k, len(ends)) - 1] if k else 0, ends[np.searchsorted(ends, done, "right")])
            entry, step = _grown(high[done:end] - low[done:end])
            x, y = word[done:end][entry], sorted_word[low[done:end][entry] + step]
            keep = (y > x) & ~(self.longer[x] & self.longer[y])
            merged = np.sort(x[keep] * len(self.length) + y[keep])
            firsts = np.flatnonzero(np.append(True, merged[1:] != merged[:-1])) if len(merged) else np.zeros(0, np.int64)
            common = np.diff(np.append(firsts, len(merged)))
            x, y = np.divmod(merged[firsts], len(self.length))
            r, s = self.hole[x], self.hole[y]
            enough = (common >= np.maximum(np.maximum(r, s) - 1, 1)) & (abs(r - s) <= 1)
            yield x[enough], y[enough]
            done = end

    def _agree(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, at_end: bool) -> np.ndarray:
        """Letters that two words have in common from the beginning, or from the end."""
        n, k, live = np.zeros(len(x), np.int64), 0, np.flatnonzero(most > 0)
        while len(live):
            i, j = (self.start[x[live]] + self.length[x[live]] - 1 - k, self.start[y[live]] + self.length[y[live]] - 1 - k) if at_end else (self.start[x[live]] + k, self.start[y[live]] + k)
            live = live[self.letters[i] == self.letters[j]]
            k += 1
            n[live] = k
            live = live[most[live] > k]
        return n

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, y in self.candidates():
            least = np.minimum(self.length[x], self.length[y])
            same = (self.c[x] == self.c[y]) & (self.a[x] == self.a[y]) & (self.b[x] == self.b[y])  # keys are hashes
            head, tail = self._agree(x, y, least, False), self._agree(x, y, least, True)
            near = head + tail >= np.maximum(self.length[x], self.length[y]) - 1
            own = (head >= self.a[x]) & ((head < self.b[x]) | (self.b[x] == self.c[x]))
            keep = same & near & own
            yield x[keep], y[keep]


def _compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of rows sorted by key that hold whole groups."""
    keys = table.column("key").to_numpy()
    first = np.append(True, keys[1:] != keys[:-1])
    alone = first & np.append(first[1:], True)
    table = table.filter(pa.array(~alone))
    if not table.num_rows:
        return
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    group = Group(words, *(table.column(x).to_numpy() for x in ("key", "c", "a", "b")))
    texts = table.column("word").combine_chunks()
    for x, y in group.pairs():
        if len(x):
            x, y = np.concatenate([x, y]), np.concatenate([y, x])
            yield pa.record_batch([texts.take(pa.array(x)), texts.take(pa.array(y)), pa.array(n[y], pa.int64())], schema=NEAR_ARROW)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK_WORDS:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last group may go on
        if cut:
            yield from _compared(table.slice(0, cut))
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield from _compared(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of each ordered pair of near words. words: (word, n), distinct."""
    done, now = [], written(_dealt(words))
    while True:
        crowded = written(now.filter("b - a > 1").groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > SPLIT).select("key"))
        if crowded.isEmpty():
            forget(crowded)
            done.append(now)
            break
        done.append(now.join(crowded, "key", "left_anti"))
        now = written(_halved(now.join(crowded, "key", "left_semi")))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("key", "word", "n", "c", "a", "b")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_near, NEAR)


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form: the end of its chain of forms. forms: (word, form), without circles."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        nexts = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(now.join(nexts, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        forget(now)
        now = step.drop("moved")
        now.written_at = step.written_at
        if step.filter("moved").isEmpty():
            return now


def group_variants(words: DataFrame, word: str = "word", n: str = "n", ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word."""
    words = words.filter(F.length(word) > 0).groupBy(F.col(word).alias("word")).agg(F.sum(n).cast("long").alias("n"))
    words = written(words)
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    found = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    found = written(found)
    roots = roots_of(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
