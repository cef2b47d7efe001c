"""Corpus operators against brute force, exact round trips and planted cases, on small fixtures."""

import collections
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelake.llm import components as comp
from lineagelake.llm import decontaminate, language_id, line_dedup, media, mixing, ngram_join, quality, substring_dedup, token_codes, url_filter

DOCS = "doc_id long, text string, lang string, source string"
VOCAB = ["".join(p) for p in itertools.product("bdfglmnprst", "aeiou", "bdfglmnrst")]


def prose(rng, n, words=VOCAB):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = prose(rng, 120)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail more", "en", "b")]
    words = base.split()
    for k in range(4, 14):  # near copies
        w = list(words)
        for _ in range(rng.choice((1, 2, 3))):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        rows.append((k, " ".join(w), "en", "b"))
    shared = prose(rng, 60)
    rows += [(k, prose(rng, 50) + "\n" + shared + "\n" + prose(rng, 40), "de", "c") for k in range(20, 26)]
    rows += [(k, prose(rng, 80), "fr", None) for k in range(30, 40)]
    rows += [(50, None, None, "a"), (51, "", "en", "a"), (52, "one two", "en", "a"), (53, "One TWO", "en", "b"), (None, "lost", "en", "a"), (1, base, "en", "a"), (54, " \t\n ", "en", "c")]
    rows += [(60, prose(rng, 5000), "en", "d")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def jaccard_brute(rows, threshold=75):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = words.findall((t or "").translate(lower))
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= threshold * len(x | y):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_components_match_brute_force(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == jaccard_brute(corpus())


def test_jaccard_full_postings_when_the_filter_is_small(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "REPEATED_BITS", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == jaccard_brute(corpus())


@pytest.mark.parametrize("block", [2, 5])
def test_jaccard_crowds_in_several_blocks(spark, monkeypatch, block):
    """Crowds that link in chains, in parts and not at all, all sharing passages, cut into small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(block)
    rows, shared = [], prose(rng, 30)
    for crowd in range(3):
        words = (shared + " " + prose(rng, 90)).split()
        for _ in range(24):
            for _ in range(rng.choice((0, 1, 2))):  # copies drift apart
                words[rng.randrange(30, len(words))] = rng.choice(VOCAB)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, shared + " " + prose(rng, rng.randrange(5, 60))) for i in range(20)]
    rng.shuffle(rows)
    want = jaccard_brute(rows)
    assert 4 < len({c for _, c in want.values()}) < len(rows) - 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_jaccard_empty_and_extra_columns(spark, docs):
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    kept = ngram_join.drop_near_copies(docs.withColumn("component_id", F.lit("x")).withColumn("n", F.lit(1)))
    assert kept.columns == [*docs.columns, "component_id", "n"]
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in jaccard_brute(corpus()).items() if i == c} | {None}


def test_jaccard_ids_with_several_texts(spark):
    rng = random.Random(41)
    a, b, other = prose(rng, 80), prose(rng, 80), prose(rng, 60)
    rows = [(2, a), (5, a), (5, b), (7, b + " more"), (8, other), (8, "x"), (9, None), (9, other), (10, ""), (10, "")]
    df = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, token int")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df).collect()}
    assert got == {2: 2, 5: 2, 7: 2, 8: 8, 9: 8, 10: 10}
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.drop_near_copies(df.drop("token")).collect())
    assert kept == sorted([(2, a), (8, other), (8, "x"), (10, "")])
    wide = df.withColumn("m", F.create_map(F.lit("k"), "doc_id")).withColumn("kept", F.lit(1))
    assert ngram_join.drop_near_copies(wide).columns == wide.columns and ngram_join.drop_near_copies(wide).count() == 5


def test_linked_pairs_probe_long_lists():
    rng = np.random.RandomState(1)
    common = np.unique(rng.randint(0, 2**62, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([common[rng.rand(len(common)) > 0.02 * k], rng.randint(0, 2**62, 10 * k).astype(np.uint64)])) for k in range(60)]
    every = np.arange(60)
    got = ngram_join.linked_pairs(sets, every, every, 75)
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
        parent[root(a)] = root(b)
    for a, b in itertools.combinations(range(60), 2):
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])):
            assert root(a) == root(b)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.id: r.component for r in comp.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


# urls

RULES = [("com/en/", False), ("example.com/en/7", True), ("net/de/", True), ("example.net/de/8", False), ("org/es/", False)]


def url_brute(url, rules=RULES):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r, _ in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


URLS = ["https://A.Example.COM/en/77?x#y", "http://com/en/", "http://xcom/en/1", "http://b.example.net/de/80", "http://net/de/", "http://x.org/es/?a://b", "no scheme", None, "", "://", "ftp://com?en/", "http://com/EN/", "http://a..com/en/é", "http://example.com/en/7", "a://b://com/en/", "http://com/en/" + "x" * 3000] * 2


@pytest.mark.parametrize("limit", [url_filter.MAX_BROADCAST, 0])
def test_urls_match_brute_force(spark, limit):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("verdict", F.lit(3))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, RULES, max_broadcast=limit).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = url_brute(u)
        assert got[i] == (host, path, rule, {None: "allow", True: "allow", False: "block"}[dict(RULES).get(rule)])


def test_url_ties_clashes_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARD_PROBES", 2)
    rules = [("b/éé", False), ("aa.b/", True), ("cc.b/é", False), ("b/éééé", True), ("", True), (None, True), ("b/éé", True)]
    df = spark.createDataFrame([(1, "http://aa.b/éé"), (2, "http://cc.b/éééé"), (2, "http://cc.b/éééé"), (3, None)], "hit long, url string").withColumn("rule", F.lit(1))
    for limit in (url_filter.MAX_BROADCAST, 0):
        out = url_filter.filter_urls(df, spark.createDataFrame(rules, "rule string, allow boolean"), max_broadcast=limit)
        assert out.columns == ["hit", "url", "host", "path", "rule", "verdict"]
        assert sorted((r.hit, r.rule, r.verdict) for r in out.collect() if r.hit < 3) == [(1, "aa.b/", "allow"), (2, "cc.b/é", "block"), (2, "cc.b/é", "block")]
        assert url_filter.filter_urls(df.limit(0), RULES, max_broadcast=limit).count() == 0
        assert {r.verdict for r in url_filter.filter_urls(df, spark.createDataFrame([], "rule string, allow boolean"), max_broadcast=limit).collect()} == {"allow"}


def test_digest_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda x: len(x))
    index = url_filter.DigestIndex.build(RULES).mapped()
    assert [r for r, _ in url_filter.judge([("com", "/en/1"), ("net", "/de/1"), ("org", "/xx/")], index)] == ["com/en/", "net/de/", None]


# lines


def lines_brute(rows, run, long):
    seen, out = {}, {}
    rows = sorted(rows)
    for i, t in rows:
        lines = t.split("\n")
        gone = set()
        for s in range(len(lines)):
            for n in range(1, min(run, len(lines) - s) + 1):
                w = tuple(lines[s : s + n])
                if (n == run or sum(map(len, w)) >= long) and seen.setdefault(w, (i, s)) != (i, s):
                    gone |= set(range(s, s + n))
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


@pytest.mark.parametrize("limit", [line_dedup.MAX_BROADCAST, 0])
@pytest.mark.parametrize("run", [1, 2, 3])
def test_line_runs_match_brute_force(spark, run, limit):
    rng = random.Random(run)
    rows = [(i, "\n".join(rng.choice("abcdefgh" if i % 2 else "xyz") * rng.choice((1, 1, 1, 6, 12)) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, "a\nb\nc"), (99, None)], "doc_id long, text string").withColumn("n_lines", F.lit(0)).withColumn("row", F.lit(1)).withColumn("gone", F.lit(1))
    out = line_dedup.drop_repeated_runs(df, run, 12, max_broadcast=limit)
    assert out.columns == ["doc_id", "text", "row", "gone", "n_lines", "n_removed"]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert got.pop(None) == ("a\nb\nc", 3, 0) and got.pop(99) == (None, 0, 0)
    assert got == lines_brute(rows, run, 12)


def test_lines_of_odd_tables(spark):
    rng = random.Random(4)
    tall, line = "\n".join(prose(rng, 3) for _ in range(5000)), prose(rng, 80)
    rows = [(1, tall), (2, tall), (3, line), (4, line), (5, "\n\n\n"), (6, ""), (7, "\n\n\n"), (8, "a\nb"), (9, "a\nb"), (3, line)]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, tall, 5000, 0), (2, "", 5000, 5000), (3, line, 1, 0), (3, line, 1, 0), (4, "", 1, 1), (5, "", 4, 3), (6, "", 1, 0), (7, "", 4, 4), (8, "a\nb", 2, 0), (9, "a\nb", 2, 0)]
    assert line_dedup.drop_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hosts_of_many_labels_take_linear_memory(spark):
    import tracemalloc

    host = "a." * 20_000 + "example.com"
    tracemalloc.start()
    found = url_filter.candidates(host, "/x/y", (1, 3), len("www.example.com"))
    assert tracemalloc.get_traced_memory()[1] < 1 << 20 and {"example.com/", "example.com/x/", "com/", "a.example.com/"} <= set(found) and all(len(c.split("/")[0]) <= 15 for c in found)
    tracemalloc.stop()
    df = spark.createDataFrame([(1, f"http://{host}/x/y"), (2, "http://www.example.com/x"), (3, "http://badexample.com/x"), (4, "http://example.com./x")], "page_id long, url string")
    rules = [("example.com/x", False), ("www.example.com/", True)]
    for limit in (url_filter.MAX_BROADCAST, 0):
        got = {r.page_id: r.rule for r in url_filter.filter_urls(df, rules, max_broadcast=limit).collect()}
        assert got == {1: "example.com/x", 2: "www.example.com/", 3: None, 4: None}


def test_rows_of_one_id_are_dealt_by_their_texts(spark):
    rows = [(None, f"text {i}") for i in range(2000)] + [(7, f"more {i}") for i in range(2000)]
    import public_tokenizers

    codes = token_codes.write_codes(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    index = token_codes.read_index(codes).collect()
    assert len(index) == 4000 and sorted(r.start for r in index)[0] == 0
    ends = sorted((r.start, r.start + r.n_tokens) for r in index)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and max(r.start for r in index if r.doc_id is None) < min(r.start for r in index if r.doc_id == 7)
    assert codes.select("part").distinct().count() >= 4


def test_null_ids_of_one_source_and_size_mix_apart(spark):
    df = spark.createDataFrame([(None, f"w{i} x", "a") for i in range(3000)] + [(i, "y z", "b") for i in range(9000)], "doc_id long, text string, source string")
    out = mixing.mix(df)
    assert out.count() == 12000
    sums = {r.source: (r.t, r.g) for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()}
    assert all(abs(t - g) <= 0.01 * g + 4 for t, g in sums.values())


def test_a_text_of_many_lines_takes_linear_time(spark):
    rng = random.Random(6)
    lines = [f"{rng.random()} {i}" for i in range(100_000)]
    lines[70_000:70_040] = lines[10:50]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[:40], "newer"]))]
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (100_000, 40), 2: (42, 40)} and time.time() - began < 60  # a quadratic plan takes hours


# languages


def test_language_held_out_and_edges(spark):
    rng = random.Random(5)
    stems = {"aa": ["ka", "ko", "ki"], "bb": ["lu", "le", "la"], "cc": ["zzi", "zzo", "zza"]}
    word = lambda lang: "".join(rng.choice(stems[lang]) for _ in range(rng.choice((1, 2, 3, 4))))
    rows = [(i, " ".join(word(lang) for _ in range(30)), lang, "s") for i, lang in enumerate(rng.choice(list(stems)) for _ in range(150))]
    df = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(df.filter("doc_id < 100"))
    extra = spark.createDataFrame([(900, None, None, None), (901, "", None, None), (902, "123 !!", None, None), (903, "kakoki " * 20000, "aa", None)], DOCS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df.unionByName(extra), model).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang, _ in rows if i >= 100]) > 0.95
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "aa" and all(0 <= s <= 1 for _, s in got.values())
    none = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def test_language_letters_labels_and_brute_score(spark):
    import math

    assert language_id.words_of("½ ² x½y É1z _a") == ["x", "y", "é", "z", "a"] and language_id.words_of(None) == []
    rows = [(1, "one two two tree", "word"), (2, "uno dos tres", "a`b"), (3, "uno uno", "a`b"), (4, "one six", "word"), (4, "one six", "word"), (5, "eins zwei", "gram"), (None, "zwei zwei", "gram"), (None, "drei", "gram")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, order=F.xxhash64("doc_id"))
    assert model.languages == ["a`b", "gram", "word"]
    counts, grams = {}, {}
    for t, g in {(t, g) for _, t, g in rows}:  # equal rows count once
        for w in t.split():
            counts.setdefault(w, dict.fromkeys(model.languages, 0))[g] += 1
            for n in language_id.GRAM_LENGTHS:
                p = f"_{w}_"
                for i in range(len(p) - n + 1):
                    grams.setdefault(p[i : i + n], dict.fromkeys(model.languages, 0))[g] += 1
    known = {w: c for w, c in counts.items() if sum(c.values()) >= 2}

    def logs(table, every, key, g):
        return math.log((table[key][g] + 0.5) / (sum(c[g] for c in every.values()) + 0.5 * len(table)))

    def brute(text):
        total = dict.fromkeys(model.languages, 0.0)
        for w in text.split():
            for g in model.languages:
                if w in known:
                    total[g] += logs(known, counts, w, g)
                    continue
                for n in language_id.GRAM_LENGTHS:
                    p = f"_{w}_"
                    own = [logs(grams, grams, p[i : i + n], g) for i in range(len(p) - n + 1) if p[i : i + n] in grams]
                    if own:
                        total[g] += sum(own) / len(own)
                        break
                else:
                    total[g] += math.log(1e-9)
        z = {g: v / len(text.split()) * min(len(text.split()), language_id.EVIDENCE_WORDS) for g, v in total.items()}
        top = max(sorted(z), key=z.get)
        return top, 1 / sum(math.exp(v - z[top]) for v in z.values())

    texts = ["one two", "uno", "twos onesie", "zwo drei ei", "qqq", "tres amigos uno dos", "x"]
    asked = spark.createDataFrame([(i, t, 0.0, "z") for i, t in enumerate([*texts, "½ ²"])], "doc_id long, text string, score double, told string")
    got = {r.doc_id: r for r in language_id.identify(asked, model).collect()}
    assert asked.columns == ["doc_id", "text", "score", "told"] and language_id.identify(asked, model).columns == ["doc_id", "text", "told", "lang_pred", "score"]
    for i, t in enumerate(texts):
        assert (got[i].lang_pred, got[i].score) == (brute(t)[0], pytest.approx(brute(t)[1])), t
    assert (got[len(texts)].lang_pred, got[len(texts)].score) == ("und", 0.0)
    few = language_id.fit(df, order=F.xxhash64("doc_id"), max_docs=2)
    assert len(few.words) <= 2 and language_id.fit(df.limit(0)).languages == []


# passages


def test_passages_found_and_clean_left_alone(docs):
    got = substring_dedup.repeated_passages(docs).collect()
    pairs = {(r.doc_id, r.source_id) for r in got}
    assert {d for d, _ in pairs} >= {2, 3, *range(4, 14), *range(21, 26)}
    assert not {d for d, _ in pairs} & {*range(30, 40), 50, 51, 52, 60}
    text = {r.doc_id: (r.text or "").split() for r in docs.filter("doc_id is not null").collect()}
    for r in got:
        assert r.doc_id > r.source_id and r.n_words >= substring_dedup.MIN_WORDS and r.first_word + r.n_words <= len(text[r.doc_id])
        if r.identity == 1:
            assert text[r.doc_id][r.first_word : r.first_word + r.n_words] == text[r.source_id][r.source_first_word : r.source_first_word + r.n_words]
    for d in range(21, 26):
        assert any(r.doc_id == d and r.n_words >= 60 for r in got)


def test_chains_are_best_by_brute_force():
    rng = np.random.RandomState(2)
    for _ in range(30):
        n = rng.randint(1, 9)
        x, y = np.sort(rng.randint(0, 40, n)), rng.randint(0, 40, n)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        first = substring_dedup.chains(x, y, 8)[0]

        def score(c):
            return 8 * len(c) - substring_dedup.GAP_COST * ((x[c[-1]] + y[c[-1]]) - (x[c[0]] + y[c[0]]))

        every = [c for k in range(1, n + 1) for c in map(list, itertools.combinations(range(n), k)) if all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:]))]
        assert score(first) == pytest.approx(max(map(score, every)))


def test_chains_go_on_after_a_long_one():
    k, far = 8, substring_dedup.MAX_GAP
    rng = np.random.RandomState(6)
    for gap in (65, 80, 100, 200, 500):
        for size in (100, 200):
            one = np.arange(0, size - k, 7)
            two = size + gap + np.arange(0, size - k, 9)
            x = np.concatenate([one, two])
            got = {tuple(c) for c in substring_dedup.chains(x, x + 7, k)}
            assert got == {tuple(range(len(one))), tuple(range(len(one), len(x)))}, (gap, size)
    for _ in range(200):
        n = rng.randint(2, 60)
        x, y = np.unique(np.stack([rng.randint(0, 400, n), rng.randint(0, 400, n)]), axis=1)
        score = []  # best chain that ends at each match, by all predecessors
        for i in range(len(x)):
            near = [score[j] - substring_dedup.GAP_COST * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if 0 < x[i] - x[j] <= far and 0 < y[i] - y[j] <= far]
            score.append(k + max([0, *near]))
        first = substring_dedup.chains(x, y, k)[0]
        assert all(x[b] - x[a] <= far and y[b] - y[a] <= far for a, b in zip(first, first[1:]))
        assert k * len(first) - substring_dedup.GAP_COST * (x[first[-1]] + y[first[-1]] - x[first[0]] - y[first[0]]) == pytest.approx(max(score))


def test_second_of_two_long_passages_is_found(spark):
    rng = random.Random(12)
    rows = []
    for i, (size, gap) in enumerate([(200, 100), (100, 80), (200, 65), (200, 500)]):
        one, two = prose(rng, size), prose(rng, size)
        for k in (0, 1):
            rows.append((2 * i + k, " ".join([prose(rng, 30), one, prose(rng, gap), two, prose(rng, 30)]), None, None))
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    for i, (size, gap) in enumerate([(200, 100), (100, 80), (200, 65), (200, 500)]):
        assert sorted((r.first_word, r.n_words) for r in got if r.doc_id == 2 * i + 1) == [(30, size), (30 + size + gap, size)]


def test_ties_of_seeds_over_batches_and_partitions():
    import pyarrow as pa

    rng = np.random.RandomState(8)
    rows = sorted({(int(s), int(d), int(p)) for s, d, p in np.stack([rng.randint(0, 12, 900), rng.randint(0, 25, 900), rng.randint(0, 40, 900)], 1)})

    def run(rows, size):
        batches = [pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows[i : i + size]), (pa.int64(), pa.int64(), pa.int32()))], names=["seed", "doc", "pos"]) for i in range(0, len(rows), size)]
        out = [r for b in substring_dedup._ties(iter(batches)) for r in b.to_pylist()]
        return sorted((r["doc"], r["other"], r["x"], r["y"]) for r in out if r["seed"] is None), [r for r in out if r["seed"] is not None]

    want = set()
    for s in {r[0] for r in rows}:
        docs = sorted({d for q, d, _ in rows if q == s})
        at = {d: [p for q, e, p in rows if (q, e) == (s, d)] for d in docs}
        for k, d in enumerate(docs):
            for e in {*docs[max(0, k - substring_dedup.NEAR) : k], *(docs[:1] if k else [])}:
                want |= {(d, e, x, y) for x in at[d] for y in (at[e][0], at[e][-1])}
    for size in (1, 3, 7, 50, 1000):
        got, rim = run(rows, size)
        assert set(got) == want and len(got) <= 1.5 * len(want), size
        assert [(r["seed"], r["doc"]) for r in rim] == [rows[0][:2], rows[-1][:2]]


def spread_of(rows):
    """Words of each document that some passage covers."""
    out = {}
    for r in rows:
        out.setdefault(r[0], set()).update(range(r[1], r[1] + r[2]))
    return out


def passages_by_all_pairs(rows):
    """Passages from the shared seeds of each two documents: the same chains and alignment without the choice of ties."""
    from lineagelake.llm.shingles import WordHashes, grams

    k, hashes = substring_dedup.SEED_WORDS, WordHashes()
    words = {i: hashes.of(t) for i, t in rows}
    seeds = {}
    for i, w in words.items():
        h = grams(w, k)
        for p in np.flatnonzero(h % np.uint64(substring_dedup.ONE_IN) == 0).tolist():
            seeds.setdefault(int(h[p]), {}).setdefault(i, []).append(p)
    met = {}
    for own in seeds.values():
        for a, b in itertools.combinations(sorted(own), 2):
            met.setdefault((b, a), set()).update(itertools.product(own[b], own[a]))
    out = []
    for (d, e), xy in met.items():
        x, y = np.array(sorted(xy)).T
        short = {n: (words[n] >> np.uint64(32)).astype(np.uint32) for n in (d, e)}
        for c in substring_dedup.chains(x, y, k):
            if len(c) > 1 and x[c[-1]] > x[c[0]]:
                x0, x1, y0, y1, matched = substring_dedup.align(short[d], short[e], x[c].tolist(), y[c].tolist(), k)
                if x1 - x0 >= substring_dedup.MIN_WORDS and matched / max(x1 - x0, y1 - y0) >= substring_dedup.IDENTITY:
                    out.append((d, x0, x1 - x0))
    return out


def test_passages_against_all_pairs_among_common_lines(spark):
    """Passages whose parts are common in other documents: the words found against those that all pairs give."""
    rng = random.Random(31)
    common = [prose(rng, 12) for _ in range(40)]
    passages = [" ".join(rng.sample(common, 3) + [prose(rng, 20)]) for _ in range(15)]
    rows = []
    for i in range(240):
        parts = [prose(rng, rng.randrange(5, 60)) if rng.random() < 0.5 else rng.choice(common) for _ in range(6)]
        if i % 4 == 0:
            w = passages[rng.randrange(15)].split()
            if i % 8 == 0:
                for p in range(rng.randrange(12), len(w), 12):  # a change in each 12 words
                    w[p] = rng.choice(VOCAB)
            parts.insert(rng.randrange(6), " ".join(w))
        rows.append((i, " ".join(parts)))
    want = spread_of(passages_by_all_pairs(rows))
    got = spread_of([(r.doc_id, r.first_word, r.n_words) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()])
    assert len(want) > 40
    assert sum(len(w & got.get(i, set())) for i, w in want.items()) / sum(map(len, want.values())) >= 0.9
    assert np.mean([i in got for i in want]) >= 0.9


@pytest.mark.parametrize("every", [8, 12, 20])
def test_changed_passages_are_found(spark, every):
    rng = random.Random(every)
    rows = []
    for i in range(60):
        w = prose(rng, 60).split()
        rows.append((2 * i, prose(rng, 30) + " " + " ".join(w) + " " + prose(rng, 30)))
        for p in range(rng.randrange(every), 60, every):
            w[p] = rng.choice(VOCAB)
        rows.append((2 * i + 1, prose(rng, 40) + " " + " ".join(w) + " " + prose(rng, 20)))
    got = {(r.doc_id, r.source_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {(2 * i + 1, 2 * i) for i in range(60)} and len(got) >= {8: 42, 12: 54, 20: 57}[every]


def test_passages_of_odd_tables(spark):
    one = prose(random.Random(1), 20000)
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, None, 0), (4, "", 0), (None, one, 0), (5, "a b", 0)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, source_id int")).collect()
    assert [(r.doc_id, r.first_word, r.n_words, r.source_id, r.identity) for r in got] == [(2, 0, 20000, 1, 1.0)]
    assert substring_dedup.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# quality


def test_quality_finds_planted_words(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 9 == 0
        text = prose(rng, 40) + (" vile rotten" if toxic else "") + (" | $$$ | ###" if i % 7 == 0 else "")
        rows.append((i, text, "en" if i % 2 else "de", f"s{i % 5}"))
        if i < 500:
            labels.append((i, int(i % 7 != 0), int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "en", "s0")]
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, lab, F.col("source"), F.col("lang")).collect()}
    assert len(got) == 602
    held = range(500, 600)
    assert np.mean([(got[i].p_toxic >= 0.3) == (i % 9 == 0) for i in held]) > 0.97 and np.mean([(got[i].p_quality >= 0.5) == (i % 7 != 0) for i in held]) > 0.97
    apart = quality.classify(spark.createDataFrame([(i, "", None, None) for i in range(99)] + [(100 + i, "", "", "") for i in range(99)] + [(1, "", None, None)], DOCS).withColumn("p_toxic", F.lit("x")), spark.createDataFrame([(i, int(i < 50), 0) for i in range(199)], "doc_id long, quality int, toxic int").withColumn("site", F.lit(1)), F.col("source"), F.col("lang")).collect()
    assert len(apart) == 199 and {r.site for r in apart} == {None, ""} and {r.site: r.p_quality for r in apart}[None] > {r.site: r.p_quality for r in apart}[""]
    assert quality.classify(df.limit(0), lab, F.col("source"), F.col("lang")).count() == 0
    assert {r.p_quality for r in quality.classify(df, lab.limit(0), F.col("source"), F.col("lang")).collect()} == {0.5}


def posteriors_brute(rows, labels, model, c):
    """The hierarchical posterior of one label, from the evidence on."""
    logit = lambda p: np.log(p / (1 - p))
    sig = lambda x: 1 / (1 + np.exp(-x))
    e = [model[c](quality.features(t)) for _, t, _, _ in rows]
    seen = {}
    for i, *y in labels:
        v = y[("quality", "toxic").index(c)]
        if v is not None:
            seen.setdefault(i, []).append(v)
    rate = min(1 - 1e-4, max(1e-4, np.mean([v for i, *y in labels for v in [y[("quality", "toxic").index(c)]] if v is not None])))
    path = {}
    for (i, _, s, p), x in zip(rows, e):
        k, n = (sum(seen[i]), len(seen[i])) if i in seen else (0.25 * sig(x + logit(rate)), 0.25)
        old = path.get((s, p), (0, 0))
        path[(s, p)] = (old[0] + k, old[1] + n)
    site = {}
    for (s, _), (k, n) in path.items():
        site[s] = (site.get(s, (0, 0))[0] + k, site.get(s, (0, 0))[1] + n)

    def shrunk(rates, toward):
        w = sum(n for _, n in rates.values())
        within = sum(n * toward[x] * (1 - toward[x]) for x, (_, n) in rates.items()) / w
        between = sum(n * (k / n - toward[x]) ** 2 for x, (k, n) in rates.items()) / w - within * len(rates) / w
        strength = min(1e6, max(1.0, within / between - 1)) if between > 0 else 1e6
        return {x: (k + strength * toward[x]) / (n + strength) for x, (k, n) in rates.items()}

    total = sum(k for k, _ in site.values()) / sum(n for _, n in site.values())
    of_site = shrunk(site, dict.fromkeys(site, total))
    of_path = shrunk(path, {x: of_site[x[0]] for x in path})
    return [sig(x + logit(min(1 - 1e-6, max(1e-6, of_path[(s, p)])))) for (_, _, s, p), x in zip(rows, e)]


def test_quality_posteriors_equal_brute_force(spark):
    rng = random.Random(19)
    rows, labels = [], []
    for i in range(300):
        bad = rng.random() < (0.6 if i % 4 == 0 else 0.1)
        rows.append((i, prose(rng, 15, VOCAB[:60]) + (" ### $$" if bad else ""), [None, "", "s1", "s2"][i % 4], rng.choice([None, "x", "y"])))
        if i % 2:
            labels.append((i, int(not bad), rng.choice((0, 1, None))))
    labels += [(1, 1, 1), (7777, 0, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab, ("quality", "toxic"))
    got = {r.doc_id: r for r in quality.classify(df, lab, F.col("source"), F.col("lang")).collect()}
    for c in ("quality", "toxic"):
        want = posteriors_brute(rows, labels, model, c)
        assert [got[i][f"p_{c}"] for i, *_ in rows] == pytest.approx(want, rel=1e-6), c
    assert {(got[i].site, got[i].path) for i, *_ in rows} == {(s, p) for _, _, s, p in rows}


# token codes


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


ODD = ["", "a", "it's we'll 'tis", "two  spaces\n\nnew\tline \n x", "naïve café ÀÖ ß", "пример текста 你好", "x" * 5000, "a.b,c!!  d  ", "12 345 6a b7", " <|endoftext|> ", "ªµº", "tail \n", "\r\n\r\nw", "a\u00a0b \u2003c", "\n \n a"]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\t.,'sx-é7Ж") for _ in range(60)) for _ in range(300)]
    texts += ["".join(rng.choice(["a", "b'll", "\n", " ", "\n", " ", "c", "É", "12", "\u2003", "<|endoftext|>"][: rng.choice((7, 9, 10, 11))]) for _ in range(40)) for _ in range(3000)]
    texts += ["".join(rng.choice("aB é½²ª'’!?#$\x1c\x85\t1٣жΩst\n") for _ in range(30)) for _ in range(3000)]
    assert "<|endoftext|>" in "".join(texts)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    small = token_codes.Encoder(tokenizer_path())
    small.MEMO = 50
    for encode in (token_codes.Encoder(tokenizer_path()), small):
        got = [g for k in range(0, len(texts), 100) for g in encode(texts[k : k + 100])]
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    got = token_codes.Encoder(path)(ODD)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ODD]


def test_codes_round_trip_and_random_access():
    rng = np.random.RandomState(4)
    for bits in (8, 16):
        sizes = rng.randint(1, 400, 30)
        ids = (2 ** rng.uniform(0, 31, sizes.sum())).astype(np.uint32)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        seg = token_codes.Segment(token_codes.pack(np.arange(30), offsets, ids, bits))
        assert all((seg.document(k) == ids[offsets[k] : offsets[k + 1]]).all() for k in range(30))
        for i in rng.randint(0, len(ids), 200):
            assert seg.token(int(i)) == ids[i]
        with pytest.raises(IndexError):
            seg.token(len(ids))


def test_codes_of_a_table(spark, monkeypatch):
    import zlib

    from tokenizers import Tokenizer

    monkeypatch.setattr(token_codes, "SEGMENT_TOKENS", 50)
    plain = Tokenizer.from_file(tokenizer_path())
    rows = [(None, "no id", None, None)] + [(i * 3, t, None, None) for i, t in enumerate(ODD)] + [(100, None, None, None), (100, None, None, None)]
    out = token_codes.read_index(token_codes.write_codes(spark.createDataFrame(rows, DOCS).withColumn("file", F.lit(1)), tokenizer_path())).orderBy("start").collect()
    start = 0
    for r, (i, t, *_) in zip(out, rows):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_codes.read_index(token_codes.write_codes(spark.createDataFrame([], DOCS), tokenizer_path())).count() == 0


def test_special_tokens_in_texts_are_single_ids(spark):
    import zlib

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "word<|endoftext|><|endoftext|>word", "plain words <|endoftext", "a b"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[-5].count(plain.token_to_id("<|endoftext|>")) == 1
    assert [np.frombuffer(g, "<u4").tolist() for g in token_codes.encoder(tokenizer_path())(texts)] == want
    out = token_codes.read_index(token_codes.write_codes(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS), tokenizer_path())).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in out] == [(i, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, ids in enumerate(want)]
    assert [r.start for r in out] == np.concatenate([[0], np.cumsum([r.n_tokens for r in out])])[:-1].tolist()


# decontamination


def test_leaks_found_and_search_equals_plain_scores(spark):
    rng = random.Random(8)
    items = [(i, f"{prose(rng, 20)}. {prose(rng, 8)}.") for i in range(40)] + [(90, None), (91, "")]
    rows = [(i, prose(rng, 300), None, None) for i in range(50)]
    for i in range(10):
        rows.append((100 + i, prose(rng, 90) + " " + items[i][1].upper() + "\n" + prose(rng, 100), None, None))
    rows += [(200, None, None, None), (201, "", None, None), (100, rows[50][1], None, None)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(100 + i, i) for i in range(10)}
    assert got == {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, max_broadcast=2000).collect()}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 == decontaminate.find_leaks(docs.limit(0), bench).count()
    twice = docs.filter("doc_id = 100").limit(1).select("doc_id", F.concat("text", F.lit(" "), "text").alias("text"), F.lit(1).alias("leaked"), F.lit(2).alias("score"))
    assert [(r.item_id, r.first_word) for r in decontaminate.find_leaks(twice, bench.withColumn("entry", F.lit(9)).union(bench.filter("item_id = 0").withColumn("entry", F.lit(9)))).collect()] == [(0, 0)]
    assert decontaminate.drop_leaks(twice, bench).columns == twice.columns and decontaminate.drop_leaks(twice, bench).count() == 0
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {*range(50), 200, 201}
    entries = [(i, 0, *decontaminate.entries_of(t)[0]) for i, t in items[:40]]
    df = {}
    for _, _, w, _ in entries:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    index = decontaminate.build(entries, df, 40, 28.0)
    terms = np.unique([index.vocab[w] for w in entries[3][2][:20] + entries[5][2][:15]])
    plain = np.zeros(40)
    for t in terms:
        own = slice(index.starts[t], index.starts[t + 1])
        plain[index.entry[own]] += index.weight[own]
    for threshold in (0.05, 0.3, 0.5):
        hit, score = decontaminate.retrieve(index, terms, threshold)
        assert hit.tolist() == np.flatnonzero(plain >= threshold).tolist() and np.allclose(score, plain[hit])


def leaks_brute(docs, items, threshold=decontaminate.THRESHOLD):
    """Every passage of every text against every entry, with plain BM25 sums; {(doc, item, entry): (score, question, answer, first word)}."""
    import math
    from collections import Counter

    entries = [(i, k, *e) for i, t in items for k, e in enumerate(decontaminate.placed_entries(t))]
    df = Counter(w for e in entries for w in set(e[2]))
    mean = sum(len(e[2]) for e in entries) / len(entries)
    weights = []
    for _, _, ws, *_ in entries:
        own = {}
        for w, tf in Counter(ws).items():
            idf = math.log1p((len(entries) - df[w] + 0.5) / (df[w] + 0.5))
            own[w] = idf * tf * (decontaminate.K1 + 1) / (tf + decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(ws) / mean))
        total = sum(own.values())
        weights.append({w: x / total for w, x in own.items()})
    text_of = dict(items)
    grams = lambda ws: {tuple(ws[j : j + min(3, len(ws))]) for j in range(len(ws) - min(3, len(ws)) + 1)} if ws else set()
    out = {}
    for d, text in docs:
        ws = decontaminate.words(text)
        for a in range(0, max(1, len(ws) - decontaminate.ENTRY_WORDS), decontaminate.STRIDE) if len(ws) > decontaminate.ENTRY_WORDS else [0]:
            b = min(a + decontaminate.ENTRY_WORDS + decontaminate.STRIDE, len(ws))
            there = set(ws[a:b])
            for (i, k, own, _, at, asked), weight in zip(entries, weights):
                score = sum(x for w, x in weight.items() if w in there)
                if score < threshold - 1e-9:
                    continue
                whole = [w for part in decontaminate._SENTENCE_END.split(text_of[i]) for w in decontaminate.words(part)]
                asked = asked or len(whole)
                lo, hi = max(0, a - at), b + len(whole) - at - len(own)
                near = ws[lo:hi]
                q = grams(whole[:asked])
                found_q = len(set(whole[:asked]) & set(near)) / len(set(whole[:asked])) if asked < 3 else len(q & grams(near)) / len(q)
                answer = set(whole[asked:])
                found_a = len(answer & set(near)) / len(answer) if answer else 1.0
                if found_q >= decontaminate.QUESTION_OVERLAP and found_a >= decontaminate.ANSWER_OVERLAP:
                    old = out.get((d, i, k))
                    if old is None or score > old[0] + 1e-12:
                        out[d, i, k] = (score, found_q, found_a, a)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_equal_brute_force_over_all_passages(spark, seed):
    rng = random.Random(seed)
    common = VOCAB[:40]  # few words, so that many passages come near the threshold
    say = lambda n: " ".join(rng.choice(common if rng.random() < 0.7 else VOCAB) for _ in range(n))
    items = [(i, f"{say(rng.choice((6, 20, 50, 90)))}. {say(rng.choice((1, 5, 12)))}.") for i in range(70)] + [(70, "one"), (71, say(30)), (72, say(160))]
    docs = []
    for d in range(60):
        parts = [say(rng.choice((0, 30, 140)))]
        for _ in range(rng.choice((0, 1, 2))):
            own = items[rng.randrange(len(items))][1].split()
            keep = [w for w in own if rng.random() < rng.choice((1.0, 0.9, 0.7))]
            parts += [" ".join(keep), say(rng.choice((5, 60)))]
        docs.append((d, " ".join(parts)))
    docs.append((60, say(6000)))
    want = leaks_brute(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.MAX_BROADCAST, 20_000):
        got = {(r.doc_id, r.item_id, r.entry): tuple(r)[3:] for r in decontaminate.find_leaks(df, bench, max_broadcast=limit).collect()}
        assert set(got) == set(want) and len(want) > 20
        assert all(got[k][:3] == pytest.approx(v[:3]) for k, v in want.items())


def test_items_longer_than_an_entry(spark):
    rng = random.Random(21)
    for n in (1, 63, 64, 65, 66, 128, 129, 300):
        flat = decontaminate.words(prose(rng, n))
        cuts = decontaminate.placed_entries(b" ".join(flat).decode())
        assert {len(c[0]) for c in cuts} == {min(n, 64)} and len(cuts) == -(-n // 64)
        assert set(range(n)) == {c[2] + k for c in cuts for k in range(len(c[0]))} and all(flat[c[2] : c[2] + len(c[0])] == c[0] for c in cuts)
    common = prose(rng, 1)
    items = [(1, f"{prose(rng, 64)} {common}"), (2, f"{prose(rng, 150)}. {prose(rng, 10)}."), (3, f"{prose(rng, 60)}. {prose(rng, 90)}."), (4, prose(rng, 20))]
    long, asked = items[1][1].split(), items[2][1].split(". ")[0]
    rows = [(i, prose(rng, 100) + f" {common} " + prose(rng, 100)) for i in range(10)]  # a tail word alone is no leak
    rows += [(100 + i, prose(rng, 70 + i) + " " + t + " " + prose(rng, 90)) for i, t in items]
    rows += [(200, prose(rng, 90) + " " + " ".join(long[:64]) + " " + prose(rng, 200)), (201, prose(rng, 90) + " " + asked + " " + prose(rng, 200))]  # less than half the question, no answer
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (decontaminate.MAX_BROADCAST, 4000):
        got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), max_broadcast=limit).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(100 + i, i) for i, _ in items}
        assert all(r.question_overlap == r.answer_overlap == 1 for r in got)


# mixing


def fill(sizes, weights=(1, 2, 3), top=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(top * sizes[s] for s in capped)) / max(1e-12, sum(w[s] for s in free))
        more = {s for s in free if level * w[s] >= top * sizes[s]}
        if not more:
            return {s: top * sizes[s] if s in capped else level * w[s] for s in sizes}
        capped |= more


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 60)), None, rng.choice(["a", "b", "b", "b", "b", "ü", None])) for i in range(3000)]
    rows += [(5, "x y z", None, "tiny"), (5, "x y z", None, "tiny"), (None, "q", None, "a"), (7, None, None, "a")]
    df = spark.createDataFrame(rows, DOCS).withColumn("taken", F.lit("clash"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = fill(sizes)
    took = dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.taken <= 3 * r.size
        took[r.source] += r.taken
    for s in sizes:
        assert abs(took[s] - goal[s]) <= 0.01 * goal[s] + 3
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(key, out)) == sorted(map(key, again))
    copies = mixing.take(df)
    assert copies.columns == df.columns and copies.count() == sum(r.copies for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


def test_tilted_rates_solve_the_constraint(spark):
    rows = [("a", 1.0, 100.0, 120.0), ("a", 0.2, 300.0, 120.0), ("a", 2.5, 10.0, 120.0), ("b", 1.0, 50.0, 150.0), ("c", 1.0, 5.0, 0.0)]
    x = {r.source: r.x for r in mixing.tilt(spark.createDataFrame(rows, "source string, q double, tokens double, target double")).collect()}
    got = {s: sum(t * min(3.0, q * np.exp(x[s])) for s2, q, t, _ in rows if s2 == s) for s in x}
    assert got["a"] == pytest.approx(120) and got["b"] == pytest.approx(150) and got["c"] == pytest.approx(0, abs=1e-9)


# images


def image(rng, k=(6, 12, 24), side=96):
    return np.clip(128 + 50 * sum(media._resize(rng.normal(0, 1, (n, n)), side, side) for n in k), 0, 255)


def test_cropped_and_edited_copies_link(spark):
    rng = np.random.RandomState(1)
    ims = [image(rng) for _ in range(12)]
    rows = [(i, media.write_pgm(a)) for i, a in enumerate(ims)]
    edits = [lambda a: a[10:90, 8:92], lambda a: np.clip(a * 0.8 + 20, 0, 255), lambda a: a + rng.normal(0, 3, a.shape), lambda a: np.rot90(a)]
    rows += [(100 + 10 * i + e, media.write_pgm(edits[e](ims[i]))) for i in range(6) for e in range(4)]
    rows += [(200, rows[0][1]), (900, None), (901, b""), (902, b"P5 3"), (903, media.write_pgm(np.full((40, 40), 7.0))), (None, rows[1][1])]
    got = {r.image: r for r in media.image_copies(spark.createDataFrame([(*r, 0, "x") for r in rows], "image long, data binary, class_id int, k string")).collect()}
    assert len(got) == len(rows) - 1
    right = [got[100 + 10 * i + e].class_id == i for i in range(6) for e in range(4)]
    assert np.mean(right) >= 0.9 and got[200].class_id == 0
    assert all(got[i].class_id == i for i in (*range(12), 900, 901, 902, 903))


def linked_by_all_pairs(files):
    """The link rule for all pairs of images, without tables."""
    found = {i: media.describe(media.read_pgm(d)) for i, d in files}
    return [(a, b) for a, b in itertools.combinations(sorted(found), 2) if media.linked(*found[a], *found[b])]


def classes_of(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("texture", ["fine", "smooth"])
def test_image_classes_against_all_pairs_in_a_crowd(spark, texture):
    rng = np.random.RandomState(5)
    k = (6, 12, 24) if texture == "fine" else (8,)
    files, truth = [], {}
    for base in range(150):
        a = image(rng, k, 64)
        n = 60 if base == 0 else 4 if base < 30 else 1  # one crowd of copies, some small groups, and strangers
        for e in range(n):
            b = a if e == 0 else np.clip(a * rng.uniform(0.8, 1.1) + rng.uniform(-10, 10), 0, 255) + rng.normal(0, 3, a.shape)
            b = b[rng.randint(0, 7) :, rng.randint(0, 7) :] if e % 2 else b
            truth[len(files)] = base
            files.append((len(files), media.write_pgm(b)))
    assert len(files) >= 290
    links = linked_by_all_pairs(files)
    assert all(truth[a] == truth[b] for a, b in links)  # strangers don't link
    same = [(a, b) for a, b in itertools.combinations(truth, 2) if truth[a] == truth[b]]
    assert len(links) >= 0.8 * len(same)
    got = {r.image: r.class_id for r in media.image_copies(spark.createDataFrame(files, "image long, data binary")).collect()}
    assert np.mean([got[a] == got[b] for a, b in links]) >= 0.95
    want = classes_of(truth, links)
    assert np.mean([got[i] == want[i] for i in truth]) >= 0.95 and all(truth[got[i]] == truth[i] for i in truth)


def test_images_of_one_id_and_empty_table(spark):
    rng = np.random.RandomState(3)
    a, b = (media.write_pgm(image(rng)) for _ in range(2))
    got = {r.image: r.class_id for r in media.image_copies(spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (9, b), (2, None)], "image long, data binary")).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 2: 2}
    assert media.image_copies(spark.createDataFrame([], "image long, data binary")).count() == 0
    vectors = [(1, [float(x) for x in range(70)]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float(x) for x in range(69)] + [1e4])]
    drawn = {r.image: r.data for r in media.render_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    assert drawn[2] is drawn[3] is None and drawn[1] != drawn[6] and media.read_pgm(drawn[4]) is not None


def test_equal_keys_over_partitions_meet():
    rows = sorted((int(k), int(p)) for k, p in np.random.RandomState(1).randint(0, 40, (300, 2)))
    import pyarrow as pa

    def batch(part):
        return pa.record_batch([pa.array([k for k, _ in part], pa.int64()), pa.array([p for _, p in part], pa.int64())], names=["k", "picture"])

    tied, borders = [], []
    for part in (rows[:7], rows[7:160], rows[160:]):
        for out in media._meet(iter([batch(part[i : i + 5]) for i in range(0, len(part), 5)])):
            for r in out.to_pylist():
                (borders if r["k"] is not None else tied).append(r)
    for k in {k for k, _ in rows}:
        own = sorted({p for q, p in rows if q == k})
        edges = [(a, b) for a, b in [(r["a"], r["b"]) for r in tied] if a in own and b in own]
        rim = sorted(r["a"] for r in borders if r["k"] == k)
        assert len(set(classes_of(own, edges + list(zip(rim, rim[1:]))).values())) == 1


def test_near_descriptors_meet_in_a_key_of_many_strangers():
    """The key's length doesn't follow the number of images: what stands under one key is ordered by the bits that follow."""
    import pyarrow as pa

    rng = np.random.RandomState(4)
    bits = rng.randint(0, 2, (3000, media.BITS)).astype(np.uint8)
    bits[:, media._ORDER[0, : media.KEY_BITS]] = 1  # all share the first table's key
    bits[2500] = bits[7]
    bits[2500, media._ORDER[0, 200:205]] ^= 1
    rows = []
    for part in (slice(0, 1000), slice(1000, 3000)):
        packed = [np.packbits(b).tobytes() for b in bits[part]]
        for out in media._keys(iter([pa.record_batch([pa.array(range(part.start, part.stop), pa.int64()), pa.array(packed, pa.binary())], names=["picture", "bits"])]), media.KEY_BITS):
            rows += [(r["k"], r["rest"], r["picture"]) for r in out.to_pylist()]
    crowded = collections.Counter(r[0] for r in rows).most_common(1)[0][0]
    rows = sorted(r for r in rows if r[0] == crowded)  # by the other tables' keys the two would meet anyway
    assert len(rows) >= 2999
    met = media._meet(iter([pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["k", "picture"])]))
    assert (7, 2500) in {(r["a"], r["b"]) for out in met for r in out.to_pylist()}


# pipeline


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline as cp

    d = str(tmp_path)
    base = docs.filter("doc_id is not null").withColumn("n_chars", F.length("text").cast("long"))
    base.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, prose(random.Random(77), 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == base.columns, name
    out = cp.run(spark, d)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == now.count()


def test_pipeline_of_an_empty_table_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(78)
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    one, two = prose(rng, 60), prose(rng, 60)
    rows = [(None, prose(rng, 50), "en", "a", 1, "x"), (1, one, "en", "a", 1, "x"), (1, one, "en", "a", 1, "x"), (2, one, "en", None, 1, "x"), (3, two, "en", "a", 1, "x"), (3, prose(rng, 40), "en", "a", 1, "x"), (4, None, None, None, None, None), (5, "", "en", "a", 0, "x")]
    for name, own in (("none", []), ("odd", rows)):
        d = str(tmp_path / name)
        spark.createDataFrame(own, kind).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in cp.STAGES[:-1]:
            now = stage(spark, now, d)
            assert now.columns == [f.split()[0] for f in kind.split(", ")]
        ids = [r.doc_id for r in now.collect()]
        out = cp.run(spark, d).collect()
        assert len(out) == len(ids)
        assert not ids if name == "none" else {None, 1, 3} == set(ids)
