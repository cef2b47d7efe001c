"""Quality classifier by hierarchical empirical Bayes.

1. Document evidence: a logistic model over the features of a text (words, runs of symbols, and shares of symbols, upper
   case, repeats and lengths in steps) for each label, learned from a bounded sample: the MAX_TRAIN_DOCS labelled rows
   with the smallest hash; a repeated id is learned from once, by the text of the smallest hash. It has the KEPT_FEATURES features that tell the labels apart best. Its log-odds less those
   of the sample's rate are the document's evidence.
2. Sites and paths (a part of a site) gather, over all documents, labels where there are any, and else the classifier's
   probability with weight SOFT_WEIGHT, by grouped aggregation with map-side sums.
3. A site's rate is shrunk to the global rate by a beta prior fitted by moments over the sites; a path's rate to its
   site's in the same way. A site with little evidence stays near the global rate.
4. A document's posterior log-odds are its path's plus its own evidence.

keep: the posterior of quality is at least QUALITY_FROM and that of toxicity below TOXIC_FROM.

Null texts have no evidence and get their path's rate; null sites are one site, null paths one path of it, neither the
same as ''. Documents with several labels count each; equal rows are judged alike, and a repeated id gets its labels in
each of its rows; features that tell equally much are
kept in the order of their names. Labels without a document count for the global rate and the fit's choice of rows only. Without labels of
both kinds the evidence is 0 and rates are even. Empty tables give an empty result. Columns named p_* or keep are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.llm.common import written

MAX_TRAIN_DOCS = 20_000
MIN_FEATURE_DOCS = 5
KEPT_FEATURES = 3_000
#: Texts whose features a task holds at once.
TEXTS_HELD = 200
RIDGE, STEPS = 0.1, 400
SOFT_WEIGHT = 0.25
QUALITY_FROM, TOXIC_FROM = 0.5, 0.3

_FEATURES = re.compile(r"[^\W\d_]+|[^\w\s]+")


def features(text: str | None) -> set[str]:
    """Distinct features of a whole text."""
    if not text:
        return set()
    tokens = _FEATURES.findall(text)
    out = {f.lower() for f in tokens}
    n = max(1, len(tokens))
    lines = text.split("\n")
    steps = {
        "symbols": sum(1 for f in tokens if f[0] not in ".,;:?'\"-()" and not f[0].isalpha()) / n,
        "upper": sum(1 for f in tokens if len(f) > 2 and f.isupper()) / n,
        "repeats": 1 - len(out) / n,
        "lines": 1 - len(set(lines)) / len(lines),
    }
    out.update(f"^{name}{min(9, int(share * 10)) if share else 'none'}" for name, share in steps.items())
    out.add(f"^words{len(tokens).bit_length()}")
    out.add(f"^line{(len(text) // len(lines)).bit_length()}")
    return out


@dataclass
class Evidence:
    """Weights of the features and the constant, for one label."""

    weights: dict[str, float]
    constant: float

    def __call__(self, found: set[str]) -> float:
        w = self.weights
        return self.constant + sum(w[f] for f in found if f in w) if found else 0.0


def _learn(rows: np.ndarray, cols: np.ndarray, n_cols: int, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and constant of an L2 logistic model over 0/1 features, by Adam on the whole sample."""
    w, moment, square = np.zeros(n_cols + 1), np.zeros(n_cols + 1), np.zeros(n_cols + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for t in range(1, STEPS + 1):
        z = np.bincount(rows, w[cols], len(y)) + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(cols, r[rows], n_cols) + RIDGE * w[:-1], r.sum()) / len(y)
        moment, square = 0.9 * moment + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= 0.05 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], doc_id: str = "doc_id", text: str = "text") -> dict[str, Evidence]:
    """labels: doc_id and a 0/1 column for each name. The bounded sample's kept features are learned from on the driver."""
    picked = labels.select(F.col(doc_id).alias("_d"), *[F.col(c).cast("int").alias(c) for c in names]).filter(F.col("_d").isNotNull()).orderBy(F.xxhash64("_d"), *names).limit(MAX_TRAIN_DOCS)
    # one text for each labelled id, so that a repeated id doesn't grow the sample
    ids = F.broadcast(picked.select("_d").distinct())
    texts = docs.join(ids, docs[doc_id] == ids["_d"]).groupBy("_d").agg(F.min(F.struct(F.xxhash64(text), F.col(text).cast("string").alias("t"))).alias("least"))
    sample = texts.join(F.broadcast(picked), "_d").select("least.t", *names)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k in range(0, len(pdf), TEXTS_HELD):
                own = pdf.iloc[k : k + TEXTS_HELD]
                yield pd.DataFrame({"f": [list(features(t)) for t in own["t"]], **{c: own[c] for c in names}})

    sample = written(sample.repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism)).mapInPandas(rows, "f array<string>, " + ", ".join(f"{c} int" for c in names)))
    out = {}
    for c in names:
        known = sample.filter(F.col(c).isNotNull())
        n, pos = known.agg(F.count("*"), F.sum(c).cast("double")).first()
        if not n or not 0 < pos < n:
            out[c] = Evidence({}, 0.0)
            continue
        counts = known.select(F.explode("f").alias("f"), c).groupBy("f").agg(F.count("*").cast("double").alias("n"), F.sum(c).cast("double").alias("k")).filter(f"n >= {MIN_FEATURE_DOCS}")
        z = F.abs(F.col("k") - F.col("n") * (pos / n)) / F.sqrt(F.col("n") * (pos / n) * (1 - pos / n))
        kept = [r.f for r in counts.orderBy(z.desc(), "f").limit(KEPT_FEATURES).collect()]
        own = F.broadcast(docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(kept)], "f string, i int"))
        slim = known.withColumn("r", F.monotonically_increasing_id())
        cells = slim.select("r", F.explode("f").alias("f")).join(own, "f").groupBy("r").agg(F.collect_list("i").alias("i"))
        got = slim.select("r", F.col(c).alias("y")).join(cells, "r", "left").select("y", "i").toPandas()
        sizes = got["i"].map(lambda i: 0 if i is None else len(i)).to_numpy()
        cols = np.concatenate([np.zeros(0, np.int64), *[np.asarray(i) for i in got["i"] if i is not None]]).astype(np.int64)
        weights, constant = _learn(np.repeat(np.arange(len(got)), sizes), cols, len(kept), got["y"].to_numpy(float))
        out[c] = Evidence(dict(zip(kept, weights.tolist())), constant - float(np.log(pos / (n - pos))))
    return out


def _shrunk(rates: DataFrame, k: str, n: str, toward: Column) -> Column:
    """Posterior mean of k of n under a beta prior around `toward`, its strength by moments over the rows."""
    row = rates.select((F.col(k) / F.col(n)).alias("p"), toward.alias("m"), F.col(n).alias("w")).filter("w > 0").agg(
        F.sum(F.expr("w * pow(p - m, 2)")).alias("ss"), F.sum("w").alias("w"), F.sum(F.expr("w * m * (1 - m)")).alias("v"), F.count("*").alias("g")
    ).first()
    strength = 1e6
    if row.g and row.w and row.v:
        within = row.v / row.w
        between = row.ss / row.w - within * row.g / row.w
        if between > 0:
            strength = min(1e6, max(1.0, within / between - 1))
    return (F.col(k) + F.lit(float(strength)) * toward) / (F.col(n) + F.lit(float(strength)))


def _key(c: Column) -> Column:
    """A string to group and join by, that tells null ('') from all strings ('=' before them)."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def classify(docs: DataFrame, labels: DataFrame, site: Column, path: Column, quality: str = "quality", toxic: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, site, path, p_quality, p_toxic, keep) for each row of docs."""
    names = (quality, toxic)
    model = fit(docs, labels, names, doc_id, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(", ".join(f"{c} double" for c in names))
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in parts:
            out = np.zeros((len(texts), len(names)))
            for i, t in enumerate(texts):  # one text's features at a time
                found = features(t)
                out[i] = [m[c](found) for c in names]
            yield pd.DataFrame(out, columns=list(names))

    base = docs.select(F.col(doc_id).alias("doc_id"), _key(site).alias("site"), _key(path).alias("path"), evidence(F.col(text)).alias("e"))
    base = written(base)
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(*[F.sum(F.col(c).cast("double")).alias(f"k_{c}") for c in names], *[F.count(c).cast("double").alias(f"n_{c}") for c in names])
    joined = base.join(known, "doc_id", "left")
    overall = labels.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).first()
    sums = []
    for c in names:
        rate = min(1 - 1e-4, max(1e-4, overall[c] if overall[c] is not None else 0.5))
        soft = 1 / (1 + F.exp(-(F.col(f"e.{c}") + float(np.log(rate / (1 - rate))))))
        has = F.coalesce(F.col(f"n_{c}"), F.lit(0.0)) > 0
        sums += [F.sum(F.when(has, F.col(f"k_{c}")).otherwise(SOFT_WEIGHT * soft)).alias(f"k_{c}"), F.sum(F.when(has, F.col(f"n_{c}")).otherwise(SOFT_WEIGHT)).alias(f"n_{c}")]
    paths = written(joined.groupBy("site", "path").agg(*sums))
    sites = paths.groupBy("site").agg(*[F.sum(f"{a}_{c}").alias(f"{a}_{c}") for c in names for a in "kn"])
    total = sites.agg(*[(F.sum(f"k_{c}") / F.sum(f"n_{c}")).alias(c) for c in names]).first()
    for c in names:
        sites = sites.withColumn(f"s_{c}", _shrunk(sites, f"k_{c}", f"n_{c}", F.lit(float(total[c] if total[c] is not None else 0.5))))
    paths = written(paths.join(sites.select("site", *[f"s_{c}" for c in names]), "site"))
    rated = paths.select("site", "path", *[F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), _shrunk(paths, f"k_{c}", f"n_{c}", F.col(f"s_{c}")))).alias(f"r_{c}") for c in names])
    out = base.join(rated, ["site", "path"])
    post = {c: 1 / (1 + F.exp(-(F.col(f"e.{c}") + F.log(F.col(f"r_{c}") / (1 - F.col(f"r_{c}")))))) for c in names}
    site, path = (F.when(F.col(c) != "", F.substring(c, 2, 1 << 30)).alias(c) for c in ("site", "path"))
    out = out.select("doc_id", site, path, post[quality].alias("p_quality"), post[toxic].alias("p_toxic"))
    return out.withColumn("keep", (F.col("p_quality") >= QUALITY_FROM) & (F.col("p_toxic") < TOXIC_FROM))
