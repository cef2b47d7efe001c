"""Language identification by word-first backoff.

A known word is scored by its log frequency per language. An unseen word falls back to its character n-grams of the
longest length for which any is known, and so on down to single letters. A text's score is the mean log likelihood per
word, turned into a posterior over the learned languages.

The model is fitted on a bounded sample of labelled rows: the MAX_TRAIN_DOCS distinct rows with the smallest hash. Its
tables hold the MAX_WORDS commonest words that occur twice and the MAX_GRAMS commonest n-grams, so the broadcast model
has a proven bound; the README says how little the bound loses. Everything else covers all rows and whole texts.

Texts that are null or have no letter get ``und`` with score 0. With no labelled row at all every text is ``und``.
Ties between languages go to the first by code point. Labels are data: any string is one. Equal rows count once for the
fit and are judged alike. Columns named lang_pred or score are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.llm.common import unused, written
from lineagelake.llm.shingles import release

MAX_TRAIN_DOCS = 20_000
MAX_WORDS = 200_000
MAX_GRAMS = 200_000
GRAM_LENGTHS = (5, 4, 3, 2, 1)
#: Evidence of more words than this doesn't sharpen the posterior any more (words of a text depend on one another).
EVIDENCE_WORDS = 30
UNDETERMINED = "und"

#: Runs of letters (Unicode category L), here and in Java's syntax. The first is a faster cut that also takes numerals
#: such as "½" for letters; what isn't all letters is cut again.
_RUNS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")
SQL_LETTERS = r"\\p{L}+"


def words_of(text: str | None) -> list[str]:
    """The words of a text, in order: lower-cased runs of letters."""
    found = _RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in _LETTERS.findall(run)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray
    floor: np.ndarray

    def word(self, w: str) -> np.ndarray:
        """Log likelihood of one word per language."""
        k = self.words.get(w)
        if k is not None:
            return self.word_scores[k]
        padded = f"_{w}_"
        for n in GRAM_LENGTHS:
            rows = [r for i in range(len(padded) - n + 1) if (r := self.grams.get(padded[i : i + n])) is not None]
            if rows:
                return self.gram_scores[rows].mean(0)
        return self.floor


def _log_shares(counts: DataFrame, key: str, languages: list[str], totals: dict[str, float], n: int, least: int) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequency per language of the n commonest keys; at most n rows for each language come to the driver."""
    top = counts.groupBy(key).agg(F.sum("n").alias("total")).filter(F.col("total") >= least).orderBy(F.desc("total"), key).limit(n)
    rows = counts.join(top, key).select(key, "lang", F.col("n").cast("double")).toArrow()
    keys, langs = rows.column(0).to_pylist(), rows.column(1).to_pylist()
    at = {k: i for i, k in enumerate(sorted(set(keys)))}
    place = {x: i for i, x in enumerate(languages)}
    table = np.full((len(at), len(languages)), 0.5)
    np.add.at(table, ([at[k] for k in keys], [place[x] for x in langs]), rows.column(2).to_numpy())
    size = np.array([totals.get(x, 0) + 0.5 * max(1, len(table)) for x in languages])
    return at, np.log(table / size)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """docs: labelled rows; those without label or text are left out."""
    order = F.xxhash64(text, lang) if order is None else order
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).withColumn("_o", order)
    labelled = labelled.withColumn("_h", F.xxhash64(text, lang))
    # the sample's last hashes first, without the texts; of equal rows one counts
    keys = labelled.select("_o", "_h").distinct().orderBy("_o", "_h").limit(max_docs)
    last = keys.agg(F.max(F.struct("_o", "_h"))).first()[0]
    within = F.struct("_o", "_h") <= F.struct(F.lit(last[0] if last else None), F.lit(last[1] if last else None))
    sample = labelled.filter(within if last else F.lit(False)).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("lang"), F.col("_o").alias("o"), F.col("_h").alias("h")).dropDuplicates(["o", "h"])
    n_parts = max(8, docs.sparkSession.sparkContext.defaultParallelism)
    words = (
        sample.repartition(n_parts, "o", "h").select("lang", F.explode(F.expr(rf"regexp_extract_all(lower(t), '{SQL_LETTERS}', 0)")).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n"))
    )
    words = written(words)
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").cast("double").alias("n")).collect()}
    languages = sorted(totals)
    lengths = ",".join(map(str, GRAM_LENGTHS))
    grams = words.select(
        "lang", "n",
        F.explode(F.expr(f"flatten(transform(array({lengths}), k -> if(length(word) + 2 >= k, transform(sequence(1, length(word) + 3 - k), i -> substring(concat('_', word, '_'), i, k)), array())))")).alias("gram"),
    ).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = written(grams)
    gram_totals = {r.lang: r.n for r in grams.groupBy("lang").agg(F.sum("n").cast("double").alias("n")).collect()}
    word_at, word_scores = _log_shares(words, "word", languages, totals, MAX_WORDS, 2)
    gram_at, gram_scores = _log_shares(grams, "gram", languages, gram_totals, MAX_GRAMS, 1)
    floor = np.full(len(languages), math.log(1e-9))
    return Model(languages, word_at, gram_at, word_scores, gram_scores, floor)


class Scorer:
    """Scores texts; remembers the scores of words up to a bound."""

    MEMO = 150_000

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((1024, len(model.languages)))
        self.memo: dict[str, int] = {}

    def _row(self, w: str) -> int:
        k = self.memo.get(w)
        if k is None:
            k = self.memo[w] = len(self.memo)
            if k == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[k] = self.model.word(w)
        return k

    def __call__(self, text: str | None) -> tuple[str, float]:
        m, words = self.model, words_of(text)
        if not words or not m.languages:
            return UNDETERMINED, 0.0
        if len(self.memo) > self.MEMO:
            self.memo.clear()
        at = list(map(self.memo.get, words))
        if None in at:
            at = list(map(self._row, words))
        mean = self.rows[at].mean(0)
        logit = mean * min(len(words), EVIDENCE_WORDS)
        p = np.exp(logit - logit.max())
        k = int(p.argmax())
        return m.languages[k], float(p[k] / p.sum())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for texts in parts:
            yield pd.DataFrame([scorer(t) for t in texts], columns=["lang_pred", "score"])
        del scorer
        release()

    kept, told = [c for c in docs.columns if c not in ("lang_pred", "score")], unused("told", docs)
    return docs.withColumn(told, predict(F.col(text))).select(*(docs[c] for c in kept), F.col(f"{told}.lang_pred"), F.col(f"{told}.score"))
