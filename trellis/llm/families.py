"""Families: many near copies of one text, whose links are told by their distance from a middle, not pair by pair.

A family has a set P, its middle. A member's `gone` is what P has and it lacks, `added` what it has beside P, and its weight
5 |gone| + 3 |added|. Two members share at least |P| - |gone a| - |gone b| entries, so weights that add up to at most 2 |P| make
a Jaccard value of 0.6 certain. Such links are counted by running sums over the weights, and stand as one link to the
lightest member where only components matter. All other pairs of members are told exactly by

    overlap = |P| - |gone a or gone b| + |added a and added b|

in cells of equal weight that can hold such pairs. Any set may be P, and any class a member: that settles how many pairs must be
looked at, never which are linked. So P is what over half of at most SAMPLE classes hold of those with the same two least hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Classes that make a family worth while; classes from which its middle is taken; least hashes kept; cells of weights to |P|.
MANY, SAMPLE, LEAST, CELLS = 16, 64, 4, 16
#: Rows of a few bytes, and entries of middles, that may be broadcast.
FEW, ENTRIES = 500_000, 1_000_000


def least_hashes(sh):
    """Column: the LEAST least hashes of a set's entries."""
    return F.slice(F.sort_array(F.transform(sh, lambda x: F.xxhash64(x))), 1, LEAST)


def pairs_of(low):
    """Column: a hash of each two of the least hashes; one alone, of a common entry, would bring together what has little in common."""
    return F.array(*[F.xxhash64(F.element_at(low, i), F.element_at(low, j)) for i in range(1, LEAST) for j in range(i + 1, LEAST + 1)])


def found(classes: DataFrame, whole) -> DataFrame | None:
    """classes (id, copies, low) -> id, copies, fam, p (the size of P), weight, gone, added, or None if there is no family.
    whole(ids) gives id, sh of some ids."""
    key = F.xxhash64(F.element_at("low", 1), F.element_at("low", 2))
    keyed = classes.select("id", key.alias("fam"))
    big = written(keyed.groupBy("fam").agg(F.count("*").alias("many")).filter(F.col("many") >= MANY), "family-keys")
    n = big.count()
    if not n:
        discard(big)
        return None
    some = keyed.join(F.broadcast(big) if n <= FEW else big, "fam")
    nth = F.row_number().over(Window.partitionBy("fam").orderBy(F.xxhash64("id"), "id"))
    some = written(some.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE).drop("nth"), "family-samples")
    sets = whole(some.select("id"))
    held = some.join(sets, "id").select("fam", "many", F.explode("sh").alias("x")).groupBy("fam", "many", "x").count()
    held = held.filter(2 * F.col("count") > F.least("many", F.lit(SAMPLE)))
    middles = written(held.groupBy("fam", "many").agg(F.collect_list("x").alias("middle")), "family-middles")
    discard(sets, some, big)

    entries = middles.agg(F.coalesce(F.sum(F.size("middle")), F.lit(0))).first()[0]
    small = lambda d: F.broadcast(d) if entries <= ENTRIES else d
    heads = middles.filter(F.size("middle") >= LEAST).select("fam", "many", least_hashes(F.col("middle")).alias("low"))
    heads = heads.select("fam", "many", F.explode(pairs_of(F.col("low"))).alias("v"))
    near = classes.select("id", F.explode(pairs_of(F.col("low"))).alias("v")).join(small(heads), "v").select("id", "fam", "many").distinct()
    near = written(near, "family-candidates")
    sets = whole(near.select("id").distinct())
    m = near.join(sets, "id").join(small(middles.drop("many")), "fam")
    m = m.select("id", "fam", "many", F.size("middle").alias("p"), F.array_except("middle", "sh").alias("gone"), F.array_except("sh", "middle").alias("added"))
    m = m.withColumn("weight", 5 * F.size("gone") + 3 * F.size("added")).filter("2 * weight < 5 * p")
    # the family with the largest bucket, so that a text's copies meet in one
    m = m.groupBy("id").agg(F.max(F.struct("many", "fam", "p", "weight", "gone", "added")).alias("m")).select("id", "m.*").drop("many")
    m = written(m.join(classes.select("id", "copies"), "id"), "family-members")
    discard(sets, near, middles)
    return m


def certain(members: DataFrame) -> DataFrame:
    """id, sure: documents that a member is certain to be linked with, but for its own copies."""
    per = members.groupBy("fam", "p", "weight").agg(F.sum("copies").alias("c"))
    has = per.select("fam", F.col("weight").alias("at"), F.lit(0).alias("asks"), "c", "weight")
    asks = per.select("fam", (2 * F.col("p") - F.col("weight")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("c"), "weight")
    so_far = F.sum("c").over(Window.partitionBy("fam").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    sums = has.unionByName(asks).withColumn("sure", so_far).filter("asks = 1").select("fam", "weight", "sure")
    own = F.when(F.col("weight") <= F.col("p"), F.col("copies")).otherwise(0)
    return members.join(sums, ["fam", "weight"]).select("id", (F.col("sure") - own).alias("sure"))


def lightest(members: DataFrame) -> DataFrame:
    return members.groupBy("fam").agg(F.min(F.struct("weight", "id")).alias("h")).select("fam", F.col("h.id").alias("hub"), F.col("h.weight").alias("hub_weight"))


def stars(members: DataFrame) -> DataFrame:
    """(a, b): links that join all that certain links join."""
    j = members.select("id", "fam", "p", "weight").join(lightest(members), "fam").filter("id <> hub AND weight + hub_weight <= 2 * p")
    return j.select(F.greatest("id", "hub").alias("b"), F.least("id", "hub").alias("a")).select("a", "b")


def uncertain(members: DataFrame, counts: bool) -> DataFrame:
    """(a, b): the links of members that aren't certain; without counts, only those that stars don't make needless."""
    cell = F.floor(F.col("weight") * CELLS / F.col("p")).cast("int")
    m = members.withColumn("cell", cell)
    least = 2 * CELLS - 1 - F.col("cell")  # cells c, d hold weights that add up to less than c + d + 2
    heavy = m.filter(2 * F.col("cell") >= 2 * CELLS - 1)
    if not counts:
        heavy = heavy.join(lightest(members), "fam").filter("weight + hub_weight > 2 * p").drop("hub", "hub_weight")
    heavy = heavy.withColumn("cell", F.explode(F.sequence(F.greatest(least, F.lit(0)), F.col("cell"))))
    of = lambda d, s: d.select("fam", "cell", *[F.col(c).alias(c + s) for c in ("id", "p", "weight", "gone", "added")])
    j = of(heavy, "_a").join(of(m, "_b").drop("p_b"), ["fam", "cell"]).filter("weight_a + weight_b > 2 * p_a AND (weight_a > weight_b OR weight_a = weight_b AND id_a > id_b)")
    both = F.size("gone_a") + F.size("gone_b")
    total = 2 * F.col("p_a") - both + F.size("added_a") + F.size("added_b")
    most = F.col("p_a") - F.greatest(F.size("gone_a"), F.size("gone_b")) + F.least(F.size("added_a"), F.size("added_b"))
    o = F.col("p_a") - both + F.size(F.array_intersect("gone_a", "gone_b")) + F.size(F.array_intersect("added_a", "added_b"))
    j = j.filter(160 * most >= 60 * total).filter(160 * o >= 60 * total)
    return j.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
