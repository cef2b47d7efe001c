"""URL filters by a sorted digest array.

The rules (host plus path prefix) become one sorted array of 64-bit xxhash keys with the full rule strings beside it.
Each task maps the array from a file into memory, probes the digests of a url's host suffixes and path prefixes by
vectorised binary search, and compares the stored string of each hit, so that two strings with one digest never count
as the same rule.

A list up to MAX_BROADCAST bytes is sent whole to each executor. A longer one is cut into shards by digest; the
distinct probe strings of all urls are shuffled to their shard; the number of shards follows both the rules and the
probes, so that no task needs more than its shard of either.

The longest rule that fits, in characters, wins; of two equally long ones that with the longer host (there is no third
case: a host and two lengths make one rule). Nulls, urls without "://" and empty hosts have an empty host and path, fit no rule and get the default verdict. Rules
that are null or empty are left out; of equal rules with different verdicts, block wins. Repeated rows are judged alike;
an empty table gives an empty result.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.llm.common import unused, written

#: Bytes of an index that executors get whole.
MAX_BROADCAST = 64 << 20
#: Rules, and probe strings, in a shard of a longer index.
SHARD_RULES, SHARD_PROBES = 1 << 20, 1 << 21


def split_url(url: str = "url") -> tuple[str, str]:
    """SQL for a url's host (A-Z lower-cased) and path; both empty without "://"."""
    rest = f"substring(`{url}`, locate('://', `{url}`) + 3)"
    has = f"coalesce(locate('://', `{url}`), 0) > 0"
    host = f"if({has}, translate(split({rest}, '[/?#]', 2)[0], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    after = f"substring({rest}, length(split({rest}, '[/?#]', 2)[0]) + 1)"
    path = f"if({has}, split({after}, '[?#]', 2)[0], '')"
    return host, path


@dataclass
class DigestIndex:
    """Sorted digests, the strings they stand for, and the shape of the rules (path lengths that occur)."""

    keys: bytes
    offsets: bytes
    blob: bytes
    allow: bytes
    path_lengths: tuple[int, ...]
    longest_host: int

    @classmethod
    def build(cls, rules: list[tuple[str, bool]]) -> DigestIndex:
        """rules: (host + path, allowed)."""
        merged: dict[str, bool] = {}
        for rule, allowed in rules:
            if rule and not rule.startswith("/"):
                merged[rule] = allowed and merged.get(rule, True)
        texts = [x.encode() for x in merged]
        digests = np.array([xxhash.xxh64_intdigest(x) for x in texts], dtype=np.uint64)
        order = np.argsort(digests, kind="stable")
        texts = [texts[i] for i in order]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        allow = np.array(list(merged.values()), dtype=bool)[order] if len(order) else np.array([], dtype=bool)
        lengths = sorted({len(x) - len(x.split("/", 1)[0]) for x in merged})
        longest = max((len(x.split("/", 1)[0]) for x in merged), default=0)
        return cls(digests[order].tobytes(), offsets.tobytes(), b"".join(texts), allow.tobytes(), tuple(lengths), longest)

    @property
    def size(self) -> int:
        return len(self.keys) + len(self.offsets) + len(self.blob) + len(self.allow)

    def mapped(self) -> MappedIndex:
        return MappedIndex(self)


class MappedIndex:
    """A DigestIndex in a file of the task's own temporary folder, mapped into memory."""

    def __init__(self, index: DigestIndex):
        self.n, self.path_lengths, self.longest_host = len(index.keys) // 8, index.path_lengths, index.longest_host
        with tempfile.NamedTemporaryFile(prefix="digests-", delete=False) as out:
            out.write(index.keys + index.offsets + index.allow + index.blob)
        self.map = None
        if self.n:
            with open(out.name, "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            a = self.n * 8
            b = a + (self.n + 1) * 8
            self.keys = np.frombuffer(self.map, np.uint64, self.n)
            self.offsets = np.frombuffer(self.map, np.int64, self.n + 1, a)
            self.allow = np.frombuffer(self.map, np.bool_, self.n, b)
            self.blob_at = b + self.n
        os.unlink(out.name)  # the mapping stays valid

    def probe(self, texts: list[bytes]) -> np.ndarray:
        """The rule's row for each text, or -1; digests by binary search, hits confirmed by the stored string."""
        out = np.full(len(texts), -1, np.int64)
        if not self.n or not texts:
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(x) for x in texts), np.uint64, len(texts))
        lo, hi = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(lo < hi):
            for row in range(lo[i], hi[i]):
                if self.text(row) == texts[i]:
                    out[i] = row
                    break
        return out

    def text(self, row: int) -> bytes:
        at = self.blob_at
        return self.map[at + self.offsets[row] : at + self.offsets[row + 1]]


def candidates(host: str, path: str, path_lengths: tuple[int, ...], longest_host: int) -> list[str]:
    """Host suffixes at label borders, no longer than a rule's, times the path prefixes whose length some rule has."""
    first = max(0, len(host) - longest_host)  # what starts before is longer than any rule's host
    hosts = ([host] if host and not first else []) + [host[i + 1 :] for i in range(max(0, first - 1), len(host)) if host[i] == "."]
    paths = [path[:n] for n in path_lengths if n <= len(path)]
    return [h + p for h in hosts if h for p in paths]


def _rank(rule: str) -> tuple[int, int]:
    """Rules of a higher rank win."""
    return len(rule), len(rule.split("/", 1)[0])


def judge(pairs: list[tuple[str, str]], index: MappedIndex) -> list[tuple[str | None, bool | None]]:
    """Longest rule that fits and whether it allows, for each (host, path)."""
    found: dict[tuple[str, str], tuple[str | None, bool | None]] = {}
    distinct = list(dict.fromkeys(pairs))
    probes, owner = [], []
    for k, (host, path) in enumerate(distinct):
        for c in candidates(host, path, index.path_lengths, index.longest_host):
            probes.append(c.encode())
            owner.append(k)
    best: dict[int, tuple[tuple[int, int], str, bool]] = {}
    rows = index.probe(probes)
    for i in np.flatnonzero(rows >= 0).tolist():
        rule = probes[i].decode()
        best[owner[i]] = max(best.get(owner[i], ((0, 0), "", False)), (_rank(rule), rule, bool(index.allow[rows[i]])))
    for k, pair in enumerate(distinct):
        found[pair] = best[k][1:] if k in best else (None, None)
    return [found[p] for p in pairs]


def filter_urls(df: DataFrame, rules: list[tuple[str, bool]] | DataFrame, url: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """df with host, path, rule and verdict; columns of these names are replaced.

    rules: (host + path, allowed) pairs, or a DataFrame (rule string, allow boolean) for lists of any size.
    """
    host, path = split_url(url)
    base = df.drop("host", "path", "rule", "verdict").withColumn("host", F.expr(host)).withColumn("path", F.expr(path))
    if isinstance(rules, DataFrame):
        total = rules.agg(F.sum(F.octet_length("rule") + 17)).first()[0] or 0
        if total > max_broadcast:
            return _filter_sharded(base, rules, default)
        rules = [(r.rule, r.allow) for r in rules.filter("rule is not null").select("rule", F.coalesce("allow", F.lit(False)).alias("allow")).collect()]
    index = DigestIndex.build(rules)
    if index.size > max_broadcast:
        return _filter_sharded(base, df.sparkSession.createDataFrame(rules, "rule string, allow boolean"), default)
    sent = df.sparkSession.sparkContext.broadcast(index)
    schema = "rule string, allowed boolean"

    @F.pandas_udf(schema)
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        mapped = sent.value.mapped()
        for hosts, paths in parts:
            got = judge(list(zip(hosts, paths)), mapped)
            yield pd.DataFrame({"rule": [r for r, _ in got], "allowed": pd.array([a for _, a in got], dtype="boolean")})

    kept, hit = base.columns, unused("hit", base)
    return base.withColumn(hit, look_up("host", "path")).select(*kept, F.col(f"{hit}.rule").alias("rule"), _verdict(f"{hit}.allowed", default))


def _verdict(allowed: str, default: str):
    return F.when(F.col(allowed), "allow").when(~F.col(allowed), "block").otherwise(default).alias("verdict")


def _filter_sharded(base: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same result where the rules are too many for one executor: probes meet their shard of the array."""
    rules = rules.filter("rule is not null and rule != '' and rule not like '/%'").groupBy("rule").agg(F.min(F.coalesce("allow", F.lit(False))).alias("allow"))
    lengths = [r[0] for r in rules.select((F.length("rule") - F.length(F.split("rule", "/", 2)[0])).alias("n")).distinct().orderBy("n").collect()]
    longest = rules.agg(F.max(F.length(F.split("rule", "/", 2)[0]))).first()[0] or 0
    # of the host's end: a longer suffix than a rule's host fits none
    end = f"right(host, {longest + 1})"
    hosts = f"filter(transform(sequence(0, length({end}) - length(replace({end}, '.', ''))), i -> substring_index({end}, '.', -(i + 1))), h -> h != '' and length(h) <= {longest})"
    paths = f"transform(filter(array({','.join(f'{n}' for n in lengths) or '0'}), n -> n <= length(path)), n -> substring(path, 1, n))"
    pairs = base.filter("host != ''").select("host", "path").distinct()
    probes = pairs.select("host", "path", F.explode(F.expr(f"array_distinct(flatten(transform({hosts}, h -> transform({paths}, p -> concat(h, p)))))")).alias("rule"))
    probes = written(probes)
    # the index meets each distinct probe once, whatever the number of urls behind it
    asked = written(probes.select("rule").distinct())
    shards = max(1, -(-rules.count() // SHARD_RULES), -(-asked.count() // SHARD_PROBES))
    shard = F.pmod(F.xxhash64("rule"), F.lit(shards)).alias("shard")

    def probe_shard(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mapped = DigestIndex.build(list(zip(right["rule"], right["allow"]))).mapped()
        rows = mapped.probe([x.encode() for x in left["rule"]])
        hit = np.flatnonzero(rows >= 0)
        return pd.DataFrame({"rule": left["rule"].to_numpy()[hit], "allowed": [bool(mapped.allow[r]) for r in rows[hit]]})

    hits = (
        asked.withColumn("shard", shard).groupBy("shard")
        .cogroup(rules.withColumn("shard", shard).groupBy("shard"))
        .applyInPandas(probe_shard, "rule string, allowed boolean")
    )
    hit = unused("hit", base)
    rank = F.struct(F.length("rule"), F.length(F.split("rule", "/", 2)[0]))
    best = probes.join(hits, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "allowed"), rank).alias(hit))
    kept = base.columns
    return base.join(best, ["host", "path"], "left").select(*kept, F.col(f"{hit}.rule").alias("rule"), _verdict(f"{hit}.allowed", default))
