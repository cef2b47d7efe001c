"""Ranks through range partitions: no task gets all rows, whatever the number of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.operators.checkpoints import cut


def rank_score(df: DataFrame, order: Column, out: str, distinct_ids: bool = True) -> DataFrame:
    """rank / (rows + 1) as `out` and the rank as `out`_rank; ties by id.

    With distinct ids only id and order are ranked and written, and the ranks joined to the other columns.
    """
    if not distinct_ids:
        return _ranked(df.withColumn("_o", order), out).drop("_o")
    return df.join(_ranked(df.select("id", order.alias("_o")), out).drop("_o"), "id")


def _ranked(df: DataFrame, out: str) -> DataFrame:
    """df (id, _o, ...) with the rank by (_o, id)."""
    parts = cut(df.repartitionByRange("_o", "id").withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").agg(F.count("*").alias("n"))
    before = counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("_n"))
    ranked = parts.join(F.broadcast(before), "_p").withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_o", "id")) + F.col("_b"))
    return ranked.withColumn(out, F.col("_r") / (F.col("_n") + 1)).withColumnRenamed("_r", f"{out}_rank").drop("_p", "_b", "_n")


def rank_within(df: DataFrame, group: str, order: Column, out: str) -> DataFrame:
    """The rank from 1 within the rows of one value of `group` (few values), ties by id, and the group's size as `out`_of."""
    ranked = rank_score(df, F.struct(F.col(group), order), "_g")
    sizes = df.groupBy(group).agg(F.count("*").alias(f"{out}_of"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum(f"{out}_of").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = sizes.withColumnRenamed(group, "_group")
    both = ranked.join(F.broadcast(own), F.col(group).eqNullSafe(F.col("_group")))  # a row for each group
    return both.withColumn(out, F.col("_g_rank") - F.col("_before")).drop("_g", "_g_rank", "_group", "_before")


def place_in_family(df: DataFrame, *family: str) -> DataFrame:
    """df (id, family columns, ...) with _k, the place from 1 by id among the rows of its family, and _m, the family's size.

    Places follow from ranks over all rows, less the family's first: a family of any size is dealt over tasks.
    """
    ranked = _ranked(df.withColumn("_o", F.struct(*family)), "_f").drop("_o", "_f")
    first = ranked.groupBy(*family).agg(F.min("_f_rank").alias("_first"), F.count("*").alias("_m"))
    return ranked.join(first, [*family]).withColumn("_k", F.col("_f_rank") - F.col("_first") + 1).drop("_f_rank", "_first")
