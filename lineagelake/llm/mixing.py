"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the token-weighted divergence sum(size * (r log(r / q) - r + q)) from base rates q under one
token constraint per source, sum(size * r) = target. The convex dual has one multiplier per source and
r = min(cap, q * exp(lambda)): exponentially tilted rates. Newton's iterations for all sources run side by side as
grouped aggregations over (source, q), which map-side sums have shrunk to a few rows; a source is done when its tokens
are within TOLERANCE of the target.

Rates become copies by error diffusion over token mass: a source is dealt into buckets of about BUCKET documents (a
hot source has many); inside a bucket, from the longest document down, each takes floor or ceil of its rate, whichever
keeps the running sum near the running target, so a bucket ends about half a short document away from its share.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all tokens; a target stops at
max_repeat times its source's tokens and the excess is reshared by weight until none is above.

Null texts have size 0; documents of size 0 take as many copies as their rate's floor. Null ids are documents like any
other. Rows are judged one by one, so repeated rows may get different copies. Empty tables give empty results. Results
depend on the rows only, never on their partitioning; rows equal in all columns are alike.
Columns named size, source_size, target, copies or taken are replaced. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from lineagelake.llm.common import WORD, forget, written

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BUCKET = 512
MAX_NEWTON = 50
TOLERANCE = 1e-10


def words_in(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """sources (source, source_size) -> with target. Only scalars come to the driver, once for each round of capping."""
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).select("source", "source_size", F.spark_partition_id().alias("p"))
    parts = written(parts)
    offset = parts.groupBy("p").agg(F.count("*").alias("n"))
    offset = offset.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = parts.withColumn("i", place).join(F.broadcast(offset), "p").withColumn("i", F.col("i") + F.col("before"))
    ranked = written(ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("double").alias("w")))
    top = F.lit(float(max_repeat)) * F.col("source_size")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, count = None, -1
    while True:
        held = F.lit(False) if level is None else F.lit(level) * F.col("w") >= top
        row = ranked.agg(F.sum(F.when(held, 1).otherwise(0)), F.sum(F.when(held, top).otherwise(0.0)), F.sum(F.when(~held, F.col("w")).otherwise(0.0))).first()
        if not row[2] or row[0] == count:
            break
        count, level = row[0], (total - row[1]) / row[2]
    return ranked.select("source", "source_size", F.least(F.lit(level or 0.0) * F.col("w"), top).alias("target"))


def tilt(groups: DataFrame, cap: float = MAX_REPEAT) -> DataFrame:
    """groups (source, q, tokens, target) -> (source, multiplier): Newton's iterations on the dual, all sources at once."""
    now = written(groups.select("source", "q", "tokens", "target", F.lit(0.0).alias("x")))
    rate = F.least(F.lit(float(cap)), F.col("q") * F.exp("x"))
    for _ in range(MAX_NEWTON):
        open_ = F.col("q") * F.exp("x") < float(cap)
        sums = now.groupBy("source").agg(
            F.sum(rate * F.col("tokens")).alias("got"), F.sum(F.when(open_, rate * F.col("tokens")).otherwise(0.0)).alias("slope"),
            F.first("target").alias("target"), F.first("x").alias("x"),
        )
        gap = F.col("target") - F.col("got")
        # a step is damped to what the exponential can follow; with every rate at the cap the constraint is met or can't be
        step = F.when(F.abs(gap) <= TOLERANCE * F.greatest(F.lit(1.0), F.col("target")), 0.0).when(F.col("target") <= 0, -50.0)
        step = step.when(F.col("slope") > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / F.col("slope")))).when(gap < 0, -0.1).otherwise(0.0)
        moved = written(sums.select("source", step.alias("step"), (F.col("x") + step).alias("x2")))
        # a few rows; written each time, so that no plan holds the joins of all rounds before
        old, now = now, written(now.join(moved, now["source"].eqNullSafe(moved["source"])).select(now["source"], "q", "tokens", "target", F.col("x2").alias("x")))
        forget(old)
        if moved.filter("step != 0 and x2 > -40").isEmpty():
            break
    return now.groupBy("source").agg(F.first("x").alias("x"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", size: str | None = None, base_rate: Column | None = None, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs with size, source_size, target (its source's), copies and taken (copies * size).

    size: a column that already has the sizes; else the words of text are counted, once. The texts are moved only to
    meet their number of copies.
    """
    base = docs.drop(*({"size", "source_size", "target", "copies", "taken"} - {size}))
    q = F.lit(1.0) if base_rate is None else base_rate.cast("double")
    # of all columns, so that rows of one id (or none) that differ anywhere are told apart
    same = F.xxhash64(*[F.to_json(c) if isinstance(base.schema[c].dataType, MapType) else c for c in sorted(base.columns)])
    count = F.col(size).cast("long") if size else words_in(F.col(text))
    numbered = F.row_number().over(Window.partitionBy("_h").orderBy("_h"))  # tells repeated rows apart
    slim = base.select(same.alias("_h"), count.alias("size"), F.col(source).cast("string").alias("_s"), q.alias("_q"))
    slim = written(slim.withColumn("_k", numbered))
    groups = written(slim.groupBy(F.col("_s").alias("source"), F.col("_q").alias("q")).agg(F.sum("size").cast("double").alias("tokens"), F.count("*").alias("n")))
    sources = groups.groupBy("source").agg(F.sum("tokens").cast("long").alias("source_size"), F.sum("n").alias("n"))
    goal = targets(sources.select("source", "source_size"), weights, max_repeat)
    both = groups.join(goal, groups["source"].eqNullSafe(goal["source"])).select(groups["source"], "q", "tokens", "target")
    x = tilt(both, max_repeat)
    plan = goal.join(x, goal["source"].eqNullSafe(x["source"])).select(goal["source"], "source_size", "target", "x")
    plan = plan.join(sources.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = written(plan.withColumn("buckets", F.ceil(F.col("n") / BUCKET)))

    rated = slim.join(plan, slim["_s"].eqNullSafe(plan["source"])).select(
        "_s", "_h", "_k", "size", "source_size", "target", F.least(F.lit(float(max_repeat)), F.col("_q") * F.exp("x")).alias("r"),
        F.pmod(F.xxhash64("_h", F.expr(f"_k div {BUCKET}")), "buckets").alias("_b"),
    )
    # longest first; the state is the running target minus what was taken, and the copies so far
    copies = "greatest(floor(d.r + 1e-9), least(ceil(d.r - 1e-9), if(d.size = 0, floor(d.r + 1e-9), cast(round((a.e + d.r * d.size) / d.size) as bigint))))"
    fold = f"""aggregate(docs, named_struct('e', 0D, 'c', cast(array() as array<int>)),
      (a, d) -> named_struct('e', a.e + d.r * d.size - d.size * {copies}, 'c', concat(a.c, array(cast({copies} as int)))), a -> a.c)"""
    dealt = rated.groupBy("_s", "_b").agg(F.sort_array(F.collect_list(F.struct("size", "_h", "_k", "r")), asc=False).alias("docs"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    dealt = dealt.withColumn("copies", F.expr(fold)).select("source_size", "target", F.explode(F.arrays_zip("docs", "copies")).alias("z"))
    dealt = dealt.select("z.docs._h", "z.docs._k", "z.docs.size", "source_size", "target", "z.copies", (F.col("z.copies") * F.col("z.docs.size")).alias("taken"))
    whole = base.withColumn("_h", same).drop(*([size] if size else []))
    return whole.withColumn("_k", numbered).join(dealt, ["_h", "_k"]).drop("_h", "_k")


def take(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves, each as often as it has copies, with the columns of docs."""
    mixed = mix(docs, **how)
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)
