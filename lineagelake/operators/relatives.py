"""Relative pairs of a pedigree by distributed joins: 23 relationship codes as one long table (rel, id1, id2).

Parent-offspring and ancestor pairs are (younger, older); avuncular pairs are (older sibling's side, descendant) put in
canonical order like all others: id1 < id2. A pair gets its closest code only, by the order of CODES. An unknown parent
(-1, or one not in the table) never matches. Members of a twin pair count as MZ, not as full siblings, and so don't pass
on relatives through it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineagelake.operators.checkpoints import cut
from lineagelake.operators.close_kin import close_pairs
from lineagelake.operators.ranking import place_in_family

#: code -> (up, down, common ancestors, least max_degree): fixed values; up/down in meioses.
CODES = {
    "MZ": (0, 0, 0, 1), "MO": (1, 0, 1, 1), "FO": (1, 0, 1, 1), "FS": (1, 1, 2, 1), "MHS": (1, 1, 1, 1), "PHS": (1, 1, 1, 1),
    "GP": (2, 0, 1, 2), "Av": (1, 2, 2, 2), "1C": (2, 2, 2, 2),
    "GGP": (3, 0, 1, 3), "HAv": (1, 2, 1, 3), "GAv": (1, 3, 2, 3),
    "GGGP": (4, 0, 1, 4), "HGAv": (1, 3, 1, 4), "GGAv": (1, 4, 2, 4), "H1C": (2, 2, 1, 4), "1C1R": (2, 3, 2, 4),
    "G3GP": (5, 0, 1, 5), "HGGAv": (1, 4, 1, 5), "G3Av": (1, 5, 2, 5), "H1C1R": (2, 3, 1, 5), "1C2R": (2, 4, 2, 5), "2C": (3, 3, 2, 5),
}
CANONICAL = ("MZ", "FS", "MO", "FO", "MHS", "PHS", "1C")


def kinship_of(code: str) -> float:
    up, down, n, _ = CODES[code]
    return 0.5 if code == "MZ" else n * 0.5 ** (up + down + 1)


def parent_edges(ped: DataFrame, known_only: bool = True) -> DataFrame:
    """(child, parent, role): role M or F; parents absent from the table give no edge."""
    edges = ped.select(F.col("id").alias("child"), F.expr("inline(array(struct(mother as parent, 'M' as role), struct(father as parent, 'F' as role)))")).filter("parent >= 0")
    return edges.join(ped.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent", "role") if known_only else edges


def ancestors(edges: DataFrame, depth: int) -> dict[int, DataFrame]:
    """up -> distinct (id, ancestor), by repeated equi-joins on the parent."""
    hop = edges.select("child", "parent").distinct()
    out = {1: hop.select(F.col("child").alias("id"), F.col("parent").alias("ancestor"))}
    for k in range(2, depth + 1):
        out[k] = out[k - 1].join(hop, F.col("ancestor") == F.col("child")).select("id", F.col("parent").alias("ancestor")).distinct()
    return out


#: Children, or descendants at a distance, from which a person is heavy; children of a heavy parent that meet in a block.
HEAVY, BLOCK = 512, 256


def heavy_parents(ped: DataFrame) -> DataFrame:
    """(parent) of more than HEAVY children."""
    return ped.select(F.explode(F.array("mother", "father")).alias("parent")).filter("parent >= 0").groupBy("parent").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("parent")


def _in_blocks(kids: DataFrame) -> DataFrame:
    """Pairs of children of one parent, where these are many: children in blocks by id, each two blocks an own join key."""
    placed = place_in_family(kids, "parent").withColumn("_b", F.expr(f"int((_k - 1) div {BLOCK})")).withColumn("_last", F.expr(f"int((_m - 1) div {BLOCK})"))
    one = placed.select("parent", F.struct("id", "other", "twin").alias("p1"), F.col("_b").alias("b1"), F.explode(F.sequence("_b", "_last")).alias("b2"))
    two = placed.select("parent", F.struct("id", "other", "twin").alias("p2"), F.col("_b").alias("b2"), F.explode(F.sequence(F.lit(0), "_b")).alias("b1"))
    return one.join(two, ["parent", "b1", "b2"]).filter("p1.id < p2.id").select("p1", "p2")


def same_parent_pairs(ped: DataFrame, parent: str, heavy: DataFrame | None) -> DataFrame:
    """(p1, p2), structs (id, other, twin) with p1.id < p2.id, of the children of one mother (or father); other: the other parent."""
    kids = ped.filter(F.col(parent) >= 0).select("id", F.col(parent).alias("parent"), F.col("father" if parent == "mother" else "mother").alias("other"), "twin")
    light = kids if heavy is None else kids.join(heavy, "parent", "left_anti")
    one = lambda df, c: df.select("parent", F.struct("id", "other", "twin").alias(c))
    pairs = one(light, "p1").join(one(light, "p2"), "parent").filter("p1.id < p2.id").select("p1", "p2")
    return pairs if heavy is None else pairs.unionByName(_in_blocks(kids.join(heavy, "parent", "left_semi")))


def sibling_pairs(ped: DataFrame, heavy: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(full, maternal half, paternal half) as (id1, id2), id1 < id2; self equi-joins on the parents.

    heavy: parents whose children are dealt in blocks, as heavy_parents gives them.
    """
    pair = ["id1", "id2"]
    no_twins = "not (p1.twin = p2.id and p2.twin = p1.id)"
    ids = (F.col("p1.id").alias("id1"), F.col("p2.id").alias("id2"))
    of_mother = same_parent_pairs(ped, "mother", heavy).filter(no_twins)
    full = of_mother.filter("p1.other = p2.other and p1.other >= 0").select(*ids)
    mhs = of_mother.filter("p1.other != p2.other or p1.other < 0").select(*ids)
    phs = same_parent_pairs(ped, "father", heavy).filter(no_twins).filter("p1.other != p2.other or p1.other < 0").select(*ids)
    return full.select(*pair), mhs.select(*pair), phs.select(*pair)


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], dealt: bool) -> DataFrame:
    """An equi-join; where dealt, the right rows of a heavy key go to several tasks, with copies of the left ones."""
    if not dealt:
        return left.join(right, keys)
    parts = right.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select(*keys, F.ceil(F.col("n") / HEAVY).cast("int").alias("_parts"))
    n = F.coalesce("_parts", F.lit(1))
    one = left.join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    two = right.join(parts, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*[c for c in right.columns if c not in keys]), n).cast("int")).drop("_parts")
    return one.join(two, [*keys, "_part"]).drop("_part")


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2")).distinct()


def _through(sibs: DataFrame, left: DataFrame | None, right: DataFrame, dealt: bool = False) -> DataFrame:
    """Pairs of (x's descendant or x, y's descendant) over both directions of the sibling pairs (x, y)."""
    both = sibs.select(F.col("id1").alias("x"), F.col("id2").alias("y")).unionByName(sibs.select(F.col("id2").alias("x"), F.col("id1").alias("y")))
    far = right.select(F.col("id").alias("b"), F.col("ancestor").alias("y"))
    out = dealt_join(both, far, ["y"], dealt)
    if left is None:
        return _ordered(out, "x", "b")
    return _ordered(dealt_join(out, left.select(F.col("id").alias("a"), F.col("ancestor").alias("x")), ["x"], dealt), "a", "b")


def _within(pairs: DataFrame, sample: DataFrame | None) -> DataFrame:
    """The pairs with both ends in the sample."""
    if sample is None:
        return pairs
    ids = sample.select("id").distinct()
    return pairs.join(ids.withColumnRenamed("id", "id1"), "id1", "left_semi").join(ids.withColumnRenamed("id", "id2"), "id2", "left_semi")


def extract_pairs(ped: DataFrame, max_degree: int = 2, sample: DataFrame | None = None, codes: tuple[str, ...] | None = None) -> DataFrame:
    """(rel, id1, id2) for the codes up to max_degree.

    sample: ids to keep (a DataFrame with id); relations run through the whole pedigree, pairs need both ends in it.
    codes: those to return; codes that come after all of these are not looked for.
    """
    if not 1 <= max_degree <= 5:
        raise ValueError("max_degree must be 1 to 5")
    wanted = [c for c, v in CODES.items() if v[3] <= max_degree]
    if codes is not None:
        wanted = wanted[: max((i + 1 for i, c in enumerate(wanted) if c in codes), default=0)]
    if max_degree <= 2:
        pairs = close_pairs(ped, codes=tuple(wanted if codes is None else (c for c in wanted if c in codes))) if wanted else None
        return _within(pairs.select("rel", "id1", "id2") if pairs is not None else ped.select(F.lit("").alias("rel"), F.col("id").alias("id1"), F.col("id").alias("id2")).limit(0), sample)
    ped = cut(ped.select("id", "mother", "father", "twin"))  # read many times over
    edges = parent_edges(ped)
    anc = ancestors(edges, {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}[max_degree])
    heavy = heavy_parents(ped)
    heavy = None if heavy.isEmpty() else heavy
    dealt = heavy is not None
    fs, mhs, phs = sibling_pairs(ped, heavy)
    hs = mhs.unionByName(phs).distinct()
    older = lambda k: anc[k].select(F.col("id").alias("id1"), F.col("ancestor").alias("id2"))
    make = {
        "MZ": lambda: ped.filter("twin >= 0 and id < twin").select(F.col("id").alias("id1"), F.col("twin").alias("id2")).join(ped.select(F.col("id").alias("id2")), "id2", "left_semi").select("id1", "id2"),
        "MO": lambda: edges.filter("role = 'M'").select(F.col("child").alias("id1"), F.col("parent").alias("id2")),
        "FO": lambda: edges.filter("role = 'F'").select(F.col("child").alias("id1"), F.col("parent").alias("id2")),
        "FS": lambda: fs, "MHS": lambda: mhs, "PHS": lambda: phs,
        "GP": lambda: older(2), "GGP": lambda: older(3), "GGGP": lambda: older(4), "G3GP": lambda: older(5),
        "Av": lambda: _through(fs, None, anc[1], dealt), "GAv": lambda: _through(fs, None, anc[2], dealt), "GGAv": lambda: _through(fs, None, anc[3], dealt), "G3Av": lambda: _through(fs, None, anc[4], dealt),
        "HAv": lambda: _through(hs, None, anc[1], dealt), "HGAv": lambda: _through(hs, None, anc[2], dealt), "HGGAv": lambda: _through(hs, None, anc[3], dealt),
        "1C": lambda: _through(fs, anc[1], anc[1], dealt), "H1C": lambda: _through(hs, anc[1], anc[1], dealt),
        "1C1R": lambda: _through(fs, anc[1], anc[2], dealt), "H1C1R": lambda: _through(hs, anc[1], anc[2], dealt), "1C2R": lambda: _through(fs, anc[1], anc[3], dealt), "2C": lambda: _through(fs, anc[2], anc[2], dealt),
    }
    ranked = [make[c]().withColumn("rank", F.lit(i)) for i, c in enumerate(CODES) if c in wanted]
    if not ranked:
        return ped.select(F.lit("").alias("rel"), F.col("id").alias("id1"), F.col("id").alias("id2")).limit(0)
    every = reduce(DataFrame.unionByName, ranked)
    every = _within(every, sample)
    # the closest code of a pair, whichever way round it was found: one aggregation instead of a chain of anti-joins
    # rank and direction in one number, as structs are aggregated by sorting
    lo, hi = F.least("id1", "id2").alias("lo"), F.greatest("id1", "id2").alias("hi")
    best = every.groupBy(lo, hi).agg(F.min(2 * F.col("rank") + (F.col("id1") > F.col("id2")).cast("int")).alias("b"))
    names, turned = F.array(*[F.lit(c) for c in CODES]), F.col("b") % 2 == 1
    out = best.select(F.element_at(names, F.floor(F.col("b") / 2).cast("int") + 1).alias("rel"), F.when(turned, F.col("hi")).otherwise(F.col("lo")).alias("id1"), F.when(turned, F.col("lo")).otherwise(F.col("hi")).alias("id2"))
    return out if codes is None else out.filter(F.col("rel").isin(*codes))


def count_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("rel").agg(F.count("*").alias("n_pairs"))


#: People whose relatives are counted in one job; its shuffle files go before the next job's.
SLICE = 3_000_000
#: Code of a way over siblings: (full, steps up, steps down); either end may be the one that counts.
_WAYS = {(full, *way): c for c, (full, up, down) in {
    "FS": (True, 0, 0), "Av": (True, 0, 1), "GAv": (True, 0, 2), "GGAv": (True, 0, 3), "G3Av": (True, 0, 4), "1C": (True, 1, 1), "1C1R": (True, 1, 2), "1C2R": (True, 1, 3), "2C": (True, 2, 2),
    "HAv": (False, 0, 1), "HGAv": (False, 0, 2), "HGGAv": (False, 0, 3), "H1C": (False, 1, 1), "H1C1R": (False, 1, 2)}.items() for way in ((up, down), (down, up))}
_LINEAL = ("GP", "GGP", "GGGP", "G3GP")


def count_all_pairs(ped: DataFrame) -> DataFrame:
    """(rel, n_pairs) of extract_pairs(ped, 5), without a join for each code.

    A person's relatives are reached step by step, all codes' at once: up to parents, across to siblings, down to children. A
    pair is kept at its lower id only, so it is shuffled once for each way, and the people are taken in slices: shuffle files
    never hold more than one slice's pairs.
    """
    ped = cut(ped.select("id", "mother", "father", "twin"))
    heavy = heavy_parents(ped)
    heavy = None if heavy.isEmpty() else heavy
    dealt = heavy is not None
    edges = cut(parent_edges(ped))
    fs, mhs, phs = sibling_pairs(ped, heavy)
    sibs = cut(fs.withColumn("code", F.lit(_RANK["FS"])).unionByName(mhs.withColumn("code", F.lit(_RANK["MHS"]))).unionByName(phs.withColumn("code", F.lit(_RANK["PHS"]))))
    n = max(1, -(-ped.count() // SLICE))
    parts = [_reached(ped, edges, sibs, dealt, n, i) for i in range(n)]
    if n > 1:
        parts = [cut(x) for x in parts]
    names = F.array(*[F.lit(c) for c in CODES])
    total = reduce(DataFrame.unionByName, parts).groupBy("rank").agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"))
    return total.select(F.element_at(names, F.col("rank") + 1).alias("rel"), "n_pairs")


_RANK = {c: i for i, c in enumerate(CODES)}


def _reached(ped: DataFrame, edges: DataFrame, sibs: DataFrame, dealt: bool, n: int, i: int) -> DataFrame:
    """(rank, n_pairs) of the pairs whose lower id is in slice i of n."""
    mine = f"pmod(xxhash64(a), {n}) = {i}"
    up = edges.select(F.col("child").alias("at"), F.col("parent").alias("next"), "role")
    down = edges.select(F.col("parent").alias("at"), F.col("child").alias("next"), "role")
    across = sibs.selectExpr("code", "inline(array(struct(id1 as at, id2 as next), struct(id2 as at, id1 as next)))")
    of_role = F.when(F.col("role") == "M", _RANK["MO"]).otherwise(_RANK["FO"])
    found = []

    def keep(df: DataFrame, rank: Column) -> None:
        found.append(df.filter("a < at").select("a", F.col("at").alias("b"), rank.cast("int").alias("rank")))

    def step(df: DataFrame, to: DataFrame) -> DataFrame:
        return dealt_join(df, to, ["at"], dealt).drop("at").withColumnRenamed("next", "at")

    lower = ped.select(F.col("id").alias("a"), F.col("twin").alias("at")).filter(f"a < at and {mine}")
    keep(lower.join(ped.select(F.col("id").alias("at")), "at", "left_semi"), F.lit(_RANK["MZ"]))
    self_ = ped.select(F.col("id").alias("a"), F.col("id").alias("at")).filter(mine)
    ups, start = [self_.withColumn("u", F.lit(0))], self_
    lineal = {}  # ancestors and descendants by steps
    for k in range(1, 6):
        start = step(start, up if k == 1 else up.drop("role"))
        lineal["up", k] = start
        start = start.drop("role")
        ups.append(start.withColumn("u", F.lit(k)))
    below = self_
    for k in range(1, 6):
        below = step(below, down if k == 1 else down.drop("role"))
        lineal["down", k] = below
        below = below.drop("role")
    for (_, k), df in lineal.items():
        keep(df, of_role if k == 1 else F.lit(_RANK[_LINEAL[k - 2]]))
    # the way down goes on as long as a code lies ahead
    crossed = step(reduce(DataFrame.unionByName, ups[:5]), across).withColumn("full", F.col("code") == _RANK["FS"])
    keep(crossed.filter("u = 0"), F.col("code"))
    for d in range(5):
        rank = F.coalesce(*[F.when((F.col("full") == F.lit(full)) & (F.col("u") == u), _RANK[c]) for (full, u, v), c in _WAYS.items() if v == d and (u, d) != (0, 0)])
        keep(crossed.withColumn("rank", rank).filter("rank is not null"), F.col("rank"))
        ahead = reduce(lambda x, y: x | y, [(F.col("full") == F.lit(full)) & (F.col("u") == u) for full, u, v in _WAYS if v > d], F.lit(False))
        if d < 4:
            crossed = step(crossed.filter(ahead).select("a", "at", "u", "full"), down.drop("role"))
    best = reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.min("rank").alias("rank"))
    return best.groupBy("rank").agg(F.count("*").alias("n_pairs"))


def relative_counts(people: DataFrame, pairs: DataFrame, affected: str, kinds: tuple[str, ...]) -> DataFrame:
    """Per person and kind, how many relatives and affected relatives; only the younger is credited for older kin."""
    one_way = ("MO", "FO", "GP", "GGP", "GGGP", "G3GP")
    kept = pairs.filter(F.col("rel").isin(*kinds))
    a = kept.select("rel", F.col("id1").alias("id"), F.col("id2").alias("kin"))
    b = kept.filter(~F.col("rel").isin(*one_way)).select("rel", F.col("id2").alias("id"), F.col("id1").alias("kin"))
    gen = people.select("id", "generation", F.col(affected).cast("int").alias("hit"))
    both = a.unionByName(b).join(gen.select(F.col("id").alias("kin"), F.col("hit"), F.col("generation").alias("kin_generation")), "kin")
    both = both.join(people.select("id", "generation"), "id").filter("rel not in ('Av', 'HAv', 'GAv') or generation > kin_generation")
    wide = both.groupBy("id").pivot("rel", list(kinds)).agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    cols = [F.coalesce(f"{k}_{s}", F.lit(0)).alias(f"{name}_{k}") for k in kinds for s, name in (("hits", "diagnosed_relatives"), ("n", "n_relatives"))]
    return people.select("id").join(wide, "id", "left").select("id", *cols)
