"""Spelling variants against brute force over all pairs, with crowded keys, odd code points and chains of forms."""

import itertools
import random
from collections import Counter

import pytest

from lineagelake.llm import catalog, spelling


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(counts, ratio=10):
    near = {w: [] for w in counts}
    for x, y in itertools.combinations(counts, 2):
        if one_edit(x, y):
            near[x].append(y)
            near[y].append(x)
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def check(spark, counts):
    out = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = out.collect()
    assert len(rows) == len(counts)
    assert {r.word: tuple(r)[1:] for r in rows} == brute(counts)


def random_words(rng, n, letters, least, most):
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(least, most))) for _ in range(n)}
    return {w: rng.choice((1, 2, 3, 9, 10, 30, 100, 1000)) for w in words}


@pytest.mark.parametrize("letters, least, most", [("ab", 1, 10), ("abcdef", 3, 7), ("aé\U0001f600\x00", 1, 6), ("abcdefghijklmnop", 7, 9)])
def test_near_words_match_brute_force(spark, letters, least, most):
    check(spark, random_words(random.Random(letters), 400, letters, least, most))


def test_crowded_keys_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SPLIT", 5)
    rng = random.Random(4)
    check(spark, random_words(rng, 500, "abc", 3, 11) | {"stemstem" + "".join(p): rng.randrange(1, 50) for p in itertools.product("abcd", repeat=3)})


def test_chunks_and_blocks_end_between_groups():
    """The kernel in small blocks finds what it finds at once."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    words = sorted(random_words(rng, 300, "abcd", 4, 8))
    rows = []
    for w in words:
        for c in (len(w), len(w) - 1):
            for a, b in ((0, c // 2), (c // 2, c)):
                rows.append((hash((c, a, b, w[:a], w[len(w) - (c - b) :] if c > b else "")), w, 1, c, a, b))
    rows.sort()
    batch = pa.record_batch([pa.array(col) for col in zip(*rows)], names=["key", "word", "n", "c", "a", "b"])

    def found(chunk, merged, size):
        spelling.CHUNK_WORDS, spelling.MERGED, saved = chunk, merged, (spelling.CHUNK_WORDS, spelling.MERGED)
        try:
            return Counter((x, y) for out in spelling._near(batch.slice(i, size) for i in range(0, batch.num_rows, size)) for x, y in zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
        finally:
            spelling.CHUNK_WORDS, spelling.MERGED = saved

    want = Counter((x, y) for x, y in itertools.permutations(words, 2) if one_edit(x, y))
    for chunk, merged, size in ((10**6, 10**6, 10**6), (50, 40, 7), (1, 1, 1)):
        assert found(chunk, merged, size) == want
    assert np.all(batch.column("n").to_numpy() == 1)


def test_odd_words(spark):
    long = "x" * 3000
    rows = [(None, 5), ("", 5), ("word", 1), ("word", 1), ("words", 20), ("wordsy", 200), ("swordsy", 2000), (long, 1), (long + "y", 30), ("y" + long, 30)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "word string, n long, key int, c string")
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(df).collect()}
    assert got.pop(long) == (long + "y", long + "y", 1, 2, 30)
    assert got["word"] == ("words", "swordsy", 2, 1, 20) and got["swordsy"] == (None, "swordsy", 2000, 1, None)
    assert set(got) == {"word", "words", "wordsy", "swordsy", long + "y", "y" + long}
    assert spelling.group_variants(df.limit(0)).count() == 0


def test_words_of_the_query(spark):
    import re
    import zlib

    rows = [(1, "Straßenbahn STRAßENBAHN straßenbahn-ÀÉ×÷ÿabc short"), (2, "straßenbahn " * 3 + "Àé×÷ÿABC"), (3, None), (None, "straßenbahn"), (4, ""), (5, "überall überall_überall " * 40), (1, "Straßenbahn")]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    got = {r.word: r.n for r in catalog.noisy_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and got["straßenbahn"] >= 7
