"""Sample counts below mutations, and genetic values, over the local trees of an edge table.

An edge (parent, child, left, right) holds for positions in [left, right); at each position the edges are a forest. What
moves along the edges are stretches of the genome, a generation of edges at a time, each round a join and a grouping: no
task holds a forest, and no row is made for a mutation and a descendant.

Counts go up: a sample is one sample on the whole genome, an edge hands its child's stretches to its parent where it
holds, and a node's stretches are added up to a step function, so that neighbours with one count become one stretch. Of a
site's mutations those below another of the site add nothing. Values come down: stretches that are asked for go up, each
once for a node, however many ask for it; a stretch's value is the effects of the node's own mutations in it and the
values of the stretches that its parents were asked for.

Sites have one position; edges whose parent or child is null, or that hold nowhere, are left out. Nodes without an edge are
trees of their own. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagelake.operators.checkpoints import cut

_WHOLE = ("double('-Infinity') as l", "double('Infinity') as r")


def _edges(edges: DataFrame) -> DataFrame:
    """(parent, child, a, b) of the edges that hold somewhere; a child with two parents at one position is an error."""
    out = edges.select("parent", "child", F.col("left").cast("double").alias("a"), F.col("right").cast("double").alias("b")).filter("parent is not null and child is not null and a < b")
    before = F.lag("b").over(Window.partitionBy("child").orderBy("a"))
    two = F.raise_error(F.concat(F.lit("node "), F.col("child").cast("string"), F.lit(" has two parents at one position"))).cast("double")
    return cut(out.withColumn("before", before).select("parent", "child", F.when(F.col("before") > F.col("a"), two).otherwise(F.col("a")).alias("a"), "b"))


def _above(stretches: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with (node, l, r), each with the parents that its node has in it and where: adds parent, pl, pr."""
    both = stretches.join(edges, (F.col("node") == F.col("child")) & (F.col("a") < F.col("r")) & (F.col("l") < F.col("b")))
    return both.select(*stretches.columns, "parent", F.greatest("l", "a").alias("pl"), F.least("r", "b").alias("pr"))


def _added_up(stretches: DataFrame) -> DataFrame:
    """(node, l, r, n): each node's stretches as one step function, without the steps of 0."""
    ends = stretches.select("node", F.explode(F.array(F.struct(F.col("l").alias("x"), F.col("n").alias("d")), F.struct(F.col("r").alias("x"), (-F.col("n")).alias("d")))).alias("e"))
    steps = ends.groupBy("node", F.col("e.x").alias("l")).agg(F.sum("e.d").alias("d")).filter("d != 0")
    along = Window.partitionBy("node").orderBy("l")
    return steps.select("node", "l", F.lead("l").over(along).alias("r"), F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("n")).filter("n != 0")


def _topmost(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """sites (site_id, x, node) without the mutations below another one of their site: those of sites with several climb to it."""
    several = sites.groupBy("site_id").agg(F.count("*").alias("n")).filter("n > 1").select("site_id")
    now = cut(sites.join(several, "site_id", "left_semi").select("site_id", "x", "node", F.col("node").alias("at")))
    others = now.select("site_id", F.col("node").alias("at"))
    covered = []
    while not now.isEmpty():
        now = now.join(edges, (F.col("at") == F.col("child")) & (F.col("a") <= F.col("x")) & (F.col("x") < F.col("b"))).select("site_id", "x", "node", F.col("parent").alias("at"))
        now = cut(now.join(others.withColumn("met", F.lit(True)), ["site_id", "at"], "left"))
        covered.append(now.filter("met").select("site_id", "node"))
        now = now.filter("met is null").drop("met")
    return sites.join(reduce(DataFrame.unionByName, covered), ["site_id", "node"], "left_anti") if covered else sites


def allele_counts(edges: DataFrame, mutations: DataFrame, samples: DataFrame, events: int | None = None) -> DataFrame:
    """(site_id, AC): samples at or below any of a site's mutations, in the tree at its position; 0 for sites without.

    events: of no effect; the genome isn't cut into blocks any more.
    """
    edges = _edges(edges)
    sites = cut(mutations.select("site_id", F.col("position").cast("double").alias("x"), "node").distinct())
    now = samples.select("node").distinct().selectExpr("node", *_WHOLE, "1L as n")
    below = []
    while not below or not now.isEmpty():
        below.append(now)
        now = cut(_added_up(_above(now, edges).select(F.col("parent").alias("node"), F.col("pl").alias("l"), F.col("pr").alias("r"), "n")))
    found = _topmost(sites, edges).join(reduce(DataFrame.unionByName, below), "node").filter("l <= x and x < r").groupBy("site_id").agg(F.sum("n").alias("AC"))
    return sites.select("site_id").distinct().join(found, "site_id", "left").na.fill(0, ["AC"])


def edge_genetic_values(edges: DataFrame, mutations: DataFrame, samples: DataFrame, events: int | None = None) -> DataFrame:
    """(trait_id, individual, genetic_value): effects of all mutations above a sample node, summed over an individual's nodes.

    mutations (site_id, position, node, trait_id, effect_size), one a site and trait; samples (node, individual); 0 for individuals without any.
    events: of no effect; the genome isn't cut into blocks any more.
    """
    traits = [r.trait_id for r in mutations.select("trait_id").distinct().orderBy("trait_id").collect()]  # a few
    every = samples.select("individual").distinct().withColumn("trait_id", F.explode(F.lit(traits) if traits else F.array().cast("array<int>")))
    if not traits:
        return every.select("trait_id", "individual", F.lit(0.0).alias("genetic_value"))
    edges = _edges(edges)
    own = cut(mutations.select(F.col("position").cast("double").alias("x"), F.col("node").alias("at"), "trait_id", F.col("effect_size").cast("double").alias("effect")))
    asked, steps = [samples.select("node").distinct().selectExpr("node", *_WHOLE)], []
    while not (step := cut(_above(asked[-1], edges))).isEmpty():
        steps.append(step)
        asked.append(cut(step.select(F.col("parent").alias("node"), F.col("pl").alias("l"), F.col("pr").alias("r")).distinct()))
    value = None
    for k in reversed(range(len(asked))):
        parts = asked[k].join(own, (F.col("node") == F.col("at")) & (F.col("l") <= F.col("x")) & (F.col("x") < F.col("r"))).select("node", "l", "r", "trait_id", F.col("effect").alias("value"))
        if value is not None:
            parts = parts.unionByName(steps[k].join(value.withColumnsRenamed({"node": "parent", "l": "pl", "r": "pr"}), ["parent", "pl", "pr"]).select("node", "l", "r", "trait_id", "value"))
        value = cut(parts.groupBy("node", "l", "r", "trait_id").agg(F.sum("value").alias("value")))
    sums = value.join(samples.select("node", "individual").distinct(), "node").groupBy("trait_id", "individual").agg(F.sum("value").alias("genetic_value"))
    return every.join(sums, ["trait_id", "individual"], "left").na.fill(0.0, ["genetic_value"])
