"""Stored results: comparison with a golden table, stage results addressed by what made them, and a sorted site store."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagelake.operators.checkpoints import cut
from lineagelake.operators.genes import fingerprint

#: Buckets whose digests are compared before any row is.
BUCKETS = 4096


def _row_digest(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _bucket_digests(df: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, n, x, s): the rows' number, exclusive or and sum of their digests."""
    h = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    rows = df.select("bucket", _row_digest(columns).alias("digest"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.conv(F.substring("digest", 16, 15), 16, 10).cast("decimal(38,0)")).alias("s"))


def verify(found: DataFrame, golden: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows that differ: (status, keys, columns): missing, extra or changed, and of changed ones the columns' names; empty if the tables are equal.

    Both tables are first summed into one digest a bucket of keys, with map-side sums; only rows of buckets that differ are
    joined. Rows that share all keys are matched in the order of their digests. Nulls are equal to nulls. Tables with
    different columns raise.
    """
    if sorted(found.columns) != sorted(golden.columns):
        raise ValueError(f"different columns: {sorted(set(found.columns) ^ set(golden.columns))}")
    columns = sorted(golden.columns)
    values = [c for c in columns if c not in keys]
    keyed = lambda df: df.select(*columns, F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"))
    mine, theirs = keyed(found), keyed(golden)
    sums = _bucket_digests(mine, columns).unionByName(_bucket_digests(theirs, columns))
    # a bucket is equal if both tables gave the same three sums
    odd = sums.groupBy("bucket", "n", "x", "s").agg(F.count("*").alias("sides")).filter("sides = 1").select("bucket").distinct()
    odd = cut(odd)  # at most `buckets` rows
    same_key = Window.partitionBy(*keys).orderBy("_d")

    def rows(df: DataFrame, side: str) -> DataFrame:
        own = df.join(F.broadcast(odd), "bucket", "left_semi").withColumn("_d", _row_digest(columns))
        return own.select(*keys, F.row_number().over(same_key).alias("_nth"), F.struct(*[F.col(c) for c in values], F.lit(True).alias("_here")).alias(side))

    a, b = rows(mine, "_found"), rows(theirs, "_golden")
    names = a.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_nth").alias("_m"), "_found")
    match = F.col("_nth") == F.col("_m")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = b.join(names, match, "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_found.{c}").eqNullSafe(F.col(f"_golden.{c}")), F.lit(c)) for c in values])) if values else F.array().cast("array<string>")
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_golden").isNull(), "extra").when(F.size(differ) > 0, "changed")
    none = F.array().cast("array<string>")
    out = both.select(status.alias("status"), *[F.coalesce(F.col(k), F.col(f"_k{i}")).alias(k) for i, k in enumerate(keys)], F.when(status == "changed", differ).otherwise(none).alias("columns"))
    return out.filter("status is not null")


class StageStore:
    """Results of stages in a shared folder, addressed by the stage's name, its parameters and the fingerprints of its inputs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.made: list[str] = []
        self.read: list[str] = []

    def address(self, name: str, inputs: dict[str, DataFrame], parameters: dict) -> str:
        told = {"stage": name, "parameters": parameters, "inputs": {k: fingerprint(df) for k, df in sorted(inputs.items())}}
        return f"{name}-{hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:32]}"

    def stage(self, name: str, make: Callable[[], DataFrame], inputs: dict[str, DataFrame] | None = None, parameters: dict | None = None) -> DataFrame:
        """The stored result, made by make() only where none with this address is complete.

        A result is written beside its place and renamed, so that a run that dies leaves nothing that looks complete; of two
        runs that make the same one, the first to rename stays.
        """
        at = self.address(name, inputs or {}, parameters or {})
        path = f"{self.folder}/{at}"
        where, fs = self._fs(path)
        if not fs.exists(where):
            self.made.append(at)
            aside = f"{self.folder}/_making-{at}-{self.spark.sparkContext.applicationId}"
            make().write.mode("overwrite").parquet(aside)
            if not fs.rename(self._fs(aside)[0], where) and not fs.exists(where):
                raise OSError(f"can't rename {aside} to {path}")
        else:
            self.read.append(at)
        return self.spark.read.parquet(path)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())


class SiteStore:
    """Sites in order of (CHR, POS) over files of disjoint ranges, numbered over all, with a table of the files' ranges."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.read.parquet(f"{self.path}/schema").schema

    def _sites(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/sites")

    @classmethod
    def write(cls, sites: DataFrame, path: str, partitions: int | None = None) -> SiteStore:
        """sites (CHR, POS, ...); `number` counts them from 0 in order of (CHR, POS, all other columns)."""
        order = ["CHR", "POS", *[c for c in sites.columns if c not in ("CHR", "POS")]]
        dealt = sites.repartitionByRange(partitions, *order) if partitions else sites.repartitionByRange(*order)
        # the row's partition and place in it: the upper and lower bits of Spark's increasing ids
        run = cut(dealt.sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
        part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
        ranges = run.groupBy(part.alias("_p")).agg(F.count("*").alias("n"), F.min(F.struct("CHR", "POS")).alias("low"), F.max(F.struct("CHR", "POS")).alias("high"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
        ranges = cut(ranges.withColumn("before", before))
        numbered = run.withColumn("_p", part).join(F.broadcast(ranges.select("_p", "before")), "_p").withColumn("number", F.col("before") + place)
        path = path.rstrip("/")
        numbered = numbered.select(F.col("_p").cast("int").alias("_p"), *sites.columns, "number")
        numbered.write.partitionBy("_p").parquet(f"{path}/sites")
        numbered.limit(0).write.parquet(f"{path}/schema")
        ranges.coalesce(1).write.parquet(f"{path}/ranges")
        return cls(sites.sparkSession, path)

    def ranges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/ranges")

    def all(self) -> DataFrame:
        return self._sites().drop("_p")

    def between(self, chromosome: int, low: int, high: int) -> DataFrame:
        """Sites of a chromosome with low <= POS < high; opens only the files whose range meets it, and of these only fitting row groups."""
        least, most = F.struct(F.lit(chromosome).alias("CHR"), F.lit(low).alias("POS")), F.struct(F.lit(chromosome).alias("CHR"), F.lit(high).alias("POS"))
        parts = [r[0] for r in self.ranges().filter((F.struct("high.CHR", "high.POS") >= least) & (F.struct("low.CHR", "low.POS") < most)).select("_p").collect()]
        return self._sites().filter(F.col("_p").isin(parts) if parts else F.lit(False)).filter((F.col("CHR") == chromosome) & (F.col("POS") >= low) & (F.col("POS") < high)).drop("_p")

    def at(self, positions: DataFrame) -> DataFrame:
        """The sites at given (CHR, POS), each with the other columns of positions."""
        return positions.join(self.all(), ["CHR", "POS"])
