"""N-gram Jaccard join, in DataFrame functions only: a size-aware heavy-light set join.

Sets are the distinct 2-word shingles of a text, as 54-bit hashes below a level. Documents with equal sets form
a class; only classes are compared, and a class of thousands of copies counts as one.

1. Levels: words are counted in SLOTS hash slots over all documents, by partial aggregation. A slot's level is the
   logarithm of its count over the mean, 0 to 15, and a shingle's level the sum of its words' levels, the frequency that it
   would have if words came independently. Levels come first in the order of shingles, so what many documents share comes last. Any order
   gives the same links; this one keeps the lists short without moving every shingle to count it.
2. Two sets with a Jaccard value of 0.6 share k shingles among the first n - ceil(0.6 n) + k of each (prefix filter;
   `depth` gives each set's k, and the smaller one holds for a pair). Texts are shingled once, and only prefixes are kept
   and moved. They are counted by partial aggregation, those of one class only go, and of the rest each set drops its
   `slack` most frequent: as all sets drop from the same order, a pair loses no more than the larger slack, which is below
   the k that it must share. Of two sets, the shingles that the one whose prefix ends first holds in it and shares lie in
   both prefixes, so at least the overlap asked for less what lies behind the prefix must be met there, too. Of k shared entries
   the k-th most frequent is k-th or later in both sets: a pair is looked for by its LAST entries only, which are the rarest,
   so passages that thousands of documents share make no pairs of documents that differ otherwise.
3. Large sets scan the inverted lists that remain, with a size filter; shared entries are counted by partial aggregation
   before they move. Small sets (up to `boundary`, at most SMALL) instead enumerate their subsets of the size that a
   partner must share, and meet in them. The boundary is where the sum of both costs is least: subsets to enumerate
   against entries of the lists to scan, both measured.
4. Candidates are verified by the whole overlap. One text of each class that has a candidate is shingled again. A pair
   goes to the group of the smallest candidate of its smaller end; groups of more than PAIRS pairs are cut in squares by
   hash. A set moves to the squares that own a pair of it, and nowhere else.
5. Components of the links by alternating large-star and small-star rounds, each written to the shared folder.

Shingles are 54 bits of a hash, so a false match has a chance of about 1e-11 a pair; classes are 64 bits of one.
Null and empty texts have an empty set and link with nothing; a text of one word has that word as its only shingle.
Repeated rows are documents of their own, linked with each other. A null doc_id is never a component's smallest. An empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import families
from .common import apart, discard, fresh, n_words, row_key, table, words, written

SMALL, LAST = 8, 4
#: Hash slots of the word counts; pairs of a group that are verified in one square; classes that may be broadcast.
SLOTS, PAIRS, FEW = 1 << 19, 1 << 15, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text):
    """Column: the text with A-Z in lower case, a null one empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def slot(word_hash):
    return word_hash.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def word_levels(docs: DataFrame):
    """Column: an array of SLOTS levels, 16 to an integer; a scalar subquery, as a literal of that size would fill the driver with
    the texts of plans. It can't stand within a lambda, so it is selected first. Counts all words of all documents."""
    w = docs.select(F.explode(words(lowered(F.col("text")))).alias("w"))
    counts = w.select(slot(F.xxhash64("w")).alias("slot")).groupBy("slot").count().toArrow()  # SLOTS rows at most
    n = np.zeros(SLOTS)
    n[counts.column("slot").to_numpy()] = counts.column("count").to_numpy()
    level = np.clip(np.round(np.log2(np.maximum(n, 1) / max(1.0, n.sum() / SLOTS)) + 3), 0, 15).astype(np.uint64)
    packed = np.bitwise_or.reduce(level.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64)
    array = F.split(F.lit(",".join(map(str, packed.tolist()))), ",").cast("array<bigint>")
    return written(docs.sparkSession.range(1).select(array.alias("levels")), "levels").scalar()


def shingles(text, levels):
    """Column: the distinct shingles of a text, as longs, in the order of levels and hashes."""

    def key(level, h):
        return F.shiftleft(level, 54).bitwiseOR(F.shiftrightunsigned(h, 10))

    def word(h):
        four = F.shiftleft(h.bitwiseAND(F.lit(15)).cast("int"), 2)
        return key(F.call_function("shiftrightunsigned", F.element_at(levels, F.shiftright(slot(h), 4) + 1), four).bitwiseAND(F.lit(15)), h)

    def pair(a, b):
        return key(F.shiftright(a, 54) + F.shiftright(b, 54), F.xxhash64(a, b))

    def of(w):
        pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), pair)
        return F.sort_array(F.array_distinct(F.when(F.size(w) >= 2, pairs).otherwise(w)))

    each = F.transform(F.transform(words(lowered(text)), lambda x: F.xxhash64(x)), word)
    # bound once, by a list of one
    return F.element_at(F.transform(F.array(each), of), 1)


def depth(n):
    """Shingles that a set of n must share with a partner's prefix; never less for a larger set."""
    return 1 + F.floor(F.least(n / 4, F.greatest(n / 16, F.lit(32.0))))


def slack(n):
    """How many of its most frequent shingles a set of n may drop: less than its own depth and any partner's."""
    return depth(F.floor(n * 3 / 5)) - 1


def prefix_length(n):
    return F.least(n, n - F.ceil(n * 3 / 5) + depth(n)).cast("int")


def least_overlap(m, n):
    return F.ceil((m + n) * 3 / 8)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp): comp is the smallest node reachable. Large-star and small-star rounds until nothing changes."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        big = written(big, "cc")
        down = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def boundary(enumerate_cost: dict[int, float], scan_cost: dict[int, float]) -> int:
    """The size up to which sets enumerate subsets: least sum of both costs."""
    total = {b: sum(c for n, c in enumerate_cost.items() if n <= b) + sum(c for n, c in scan_cost.items() if n > b) for b in range(SMALL + 1)}
    return min(total, key=lambda b: (total[b], b))


def subset_sizes(n: int, most: int = SMALL) -> list[int]:
    """The overlaps that a set of n may have to share with a partner of at most `most`."""
    return sorted({math.ceil(3 * (n + m) / 8) for m in range(1, most + 1) if 5 * min(n, m) >= 3 * max(n, m) and math.ceil(3 * (n + m) / 8) <= min(n, m)})


def _small_pairs(small: DataFrame, b: int) -> DataFrame:
    """Verified pairs of classes of at most b shingles, by equal subsets of equal size."""
    if b < 1:
        return small.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(0).alias("o")).limit(0)
    sizes = F.element_at(F.array(*[F.array(*[F.lit(c) for c in subset_sizes(n, b)]) for n in range(1, b + 1)]), F.col("n"))
    s = small.filter(F.col("n").between(1, b)).withColumn("sh", F.array_sort("sh"))
    masks = s.select("cls", "n", "sh", F.explode(F.sequence(F.lit(1), F.shiftleft(F.lit(1), b) - 1)).alias("mask")).filter("mask < pow(2, n)").withColumn("c", F.bit_count("mask")).filter(F.array_contains(sizes, F.col("c")))
    key = F.xxhash64("c", F.filter("sh", lambda x, i: F.expr("1").isNotNull() & (F.call_function("getbit", F.col("mask"), i) == 1)))
    k = masks.select("cls", "n", "sh", key.alias("key"))
    l, r = k.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sh").alias("sa"), "key"), k.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sh").alias("sb"), "key")
    j = l.join(r, "key").filter("a < b").withColumn("o", F.size(F.array_intersect("sa", "sb"))).filter("100 * o >= 60 * (na + nb - o)")
    return j.select("a", "b", "o").distinct()


def linked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, n_similar, component_id."""
    return linked_rows(docs).drop("row", "comp")


def linked_rows(docs: DataFrame, counts: bool = True) -> DataFrame:
    """The same with row, the row_key, and comp, the component, null for documents without shingles. Without counts, links
    that can't change a component aren't looked for, and n_similar is null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = word_levels(docs)

    # 2. prefixes, and whole sets of SMALL shingles
    d = docs.select("*", levels.alias("levels")).select("doc_id", row_key("doc_id", "text").alias("row"), shingles(F.col("text"), F.col("levels")).alias("sh"))
    n = F.size("sh")
    kept = F.when(n <= SMALL, F.col("sh")).otherwise(F.slice("sh", F.lit(1), prefix_length(n)))
    sets = written(d.select(F.monotonically_increasing_id().alias("id"), "doc_id", "row", n.alias("n"), F.xxhash64("sh").alias("cls"), kept.alias("sh"), F.when(n > SMALL, families.least_hashes(F.col("sh"))).alias("low")), "sets")
    members = written(sets.drop("sh", "low"), "members")
    one = F.min(F.struct("id", "row")).alias("one")
    classes = sets.withColumn("sh", F.when(F.col("n") <= SMALL, F.col("sh"))).filter("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("rep"), one, F.max("sh").alias("sh"), F.max("low").alias("low"))
    classes = written(classes.select("cls", "n", "copies", "rep", "one.*", "sh", "low"), "classes")
    copies = written(members.join(classes.filter("copies > 1").select("cls", F.col("id").alias("own")), "cls").filter("id <> own").select("id"), "copies")
    small = copies.count() <= FEW  # 8 bytes a row
    one_each = sets.filter("n > 0").join(F.broadcast(copies) if small else copies, "id", "left_anti")

    # entry: 48 bits of a shingle's hash, 16 of its set's size
    tok, size = lambda c: F.shiftrightunsigned(c, 16), lambda c: F.col(c).bitwiseAND(F.lit(0xFFFF)).cast("int")
    x = F.explode(F.slice("sh", F.lit(1), prefix_length(F.col("n")))).alias("x")
    entries = one_each.select("id", "n", x).select(F.shiftleft("x", 16).bitwiseOR(F.least("n", F.lit(0xFFFF)).cast("long")).alias("e"), "id")
    common = entries.groupBy(tok("e").alias("tok")).agg(F.count("*").alias("c")).filter("c > 1")
    shared = written(entries.join(common, tok("e") == F.col("tok")).select("e", "id", "c"), "shared")
    few = shared.filter(size("e") <= SMALL).select(tok("e").alias("tok"), size("e").alias("n")).groupBy("tok", "n").agg(F.count("*").alias("k"))
    few = few.join(few.groupBy("tok").agg(F.sum("k").alias("all")), "tok").groupBy("n").agg(F.sum(F.col("k") * F.col("all")).alias("cost"))
    count = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= SMALL).groupBy("n").count().collect()}  # SMALL rows
    enum = {n: k * sum(math.comb(n, c) for c in subset_sizes(n)) for n, k in count.items()}
    b = boundary(enum, {r["n"]: r["cost"] for r in few.collect()})  # SMALL rows
    discard(sets, copies)

    # 3. families
    family = families.found(classes.filter(F.col("n") > SMALL).select("id", "copies", "low"), lambda ids: _whole_sets(ids, members, classes, docs, levels))

    # 4. candidates
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "e"))  # of a set's own entries, most frequent first
    n = size("e")
    lists = shared.withColumn("rank", rank).filter(F.col("rank") > slack(n))
    # what the join asks of each set, in one integer and by integer arithmetic, so that it stays a small loop
    facts = [(F.col("rank"), 0), (slack(n), 16), (depth(n), 29), (n - prefix_length(n), 43)]
    lists = lists.select("e", "id", sum((F.shiftleft(x.cast("long"), k) for x, k in facts), F.lit(0).cast("long")).alias("f"))
    if family is not None:
        fam = family.select("id", "fam")
        lists = lists.join(F.broadcast(fam) if fam.count() <= FEW else fam, "id", "left")  # 16 bytes a row
    lists = written(lists, "lists")
    discard(shared)
    fact = lambda c, at, bits: F.shiftright(c, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    both = lambda f, at, bits: f(fact("fl", at, bits), fact("fr", at, bits))
    na, nb = size("l"), size("r")
    fits = (5 * F.least(na, nb) >= 3 * F.greatest(na, nb)) & (F.greatest(na, nb) > b)
    overlap = F.shiftright(3 * (na + nb) + 7, 3)  # least_overlap
    # tokens that the set whose prefix ends first holds there are in the other's prefix too: all others lie behind it
    met = F.greatest(F.least(both(F.least, 29, 14), overlap), overlap - both(F.greatest, 43, 18))
    # of so many shared entries the k-th most frequent has rank k or more in both sets, so the last few do for the pair
    low = both(F.greatest, 16, 13) + 1
    met = F.when(F.greatest(na, nb) == 0xFFFF, low).otherwise(met)  # sizes beyond aren't known here
    from_ = F.greatest(met - LAST + 1, low)
    fits = fits & (both(F.least, 0, 16) >= from_)
    left = lambda d, *more: d.select(F.col("id").alias("a"), F.col("e").alias("l"), F.col("f").alias("fl"), *more)
    right = lambda d, *more: d.select(F.col("id").alias("b"), F.col("e").alias("r"), F.col("f").alias("fr"), *more)
    need = (met - from_ + 1).alias("need")
    if family is None:
        hits = left(lists).join(right(lists), (tok("l") == tok("r")) & (F.col("a") < F.col("b")) & fits).select("a", "b", need)
    else:
        alone, within = lists.filter("fam IS NULL"), lists.filter("fam IS NOT NULL")
        hits = left(alone).join(right(alone), (tok("l") == tok("r")) & (F.col("a") < F.col("b")) & fits).select("a", "b", need)
        ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        hits = hits.unionByName(left(within).join(right(alone), (tok("l") == tok("r")) & fits).select(*ends, need))
        # members of one family never meet here
        fam = within.select(tok("e").alias("tok"), "fam").distinct()
        two = fam.withColumnRenamed("fam", "fa").join(fam.withColumnRenamed("fam", "fb"), "tok").filter("fa < fb")
        j = two.join(left(within.withColumnRenamed("fam", "fa"), "fa").withColumn("tok", tok("l")), ["tok", "fa"])
        j = j.join(right(within.withColumnRenamed("fam", "fb"), "fb").withColumn("tok", tok("r")), ["tok", "fb"]).filter(fits)
        hits = hits.unionByName(j.select(*ends, need))
    pairs = hits.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("need").alias("need"))
    pairs = written(pairs.filter("k >= need").select("a", "b"), "candidates")
    discard(lists)

    # 5. whole overlaps, where both sets are
    edges = _verified(pairs, members, classes, docs, levels).unionByName(_small_pairs(classes.filter(F.col("n") <= SMALL).select(F.col("id").alias("cls"), "n", "sh"), b).select("a", "b"))
    if family is not None:
        edges = edges.unionByName(families.uncertain(family, counts))
    edges = written(edges.distinct(), "links")
    discard(pairs)

    # 6. counts and components
    if counts:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = ways.join(classes.select(F.col("id").alias("b"), "copies"), "b").select(F.col("a").alias("id"), F.col("copies").alias("near"))
        if family is not None:
            near = near.unionByName(families.certain(family).withColumnRenamed("sure", "near"))
        near = near.groupBy("id").agg(F.sum("near").alias("near"))
    else:
        near = classes.select("id", F.lit(None).cast("long").alias("near")).limit(0)
    comp = components(edges if family is None else edges.unionByName(families.stars(family)))
    mine = classes.select("cls", "id", "rep", "copies").join(comp.withColumnRenamed("node", "id"), "id", "left").join(near, "id", "left")
    mine = written(mine.withColumn("comp", F.coalesce("comp", "id")), "class-links")
    ids = mine.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = mine.join(ids, "comp").select("cls", "comp", "component_id", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1 if counts else F.lit(None)).alias("n_similar"))
    j = members.join(of, "cls", "left")
    empty = F.col("n") == 0
    return j.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(empty & F.lit(counts), 0).otherwise(F.col("n_similar")).cast("long").alias("n_similar"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row", "comp")


def _whole_sets(ids: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, levels) -> DataFrame:
    """(id, sh): the whole sets of the classes in ids, shingled again from one text of each."""
    repeated = members.groupBy("row").count().filter("count > 1").select("row", F.lit(True).alias("repeated"))
    wanted = classes.join(ids, "id").select("row", "id").join(repeated, "row", "left")
    wanted = written(wanted.select("row", "id", F.coalesce("repeated", F.lit(False)).alias("repeated")), "wanted")
    few = wanted.count() <= FEW  # 25 bytes a row
    keyed = docs.withColumn("row", row_key("doc_id", "text"))

    def of(some):
        return keyed.join(F.broadcast(some) if few else some, "row")

    # only texts of rows that are alike have to meet
    sets = of(wanted.filter("not repeated")).unionByName(of(wanted.filter("repeated")).dropDuplicates(["id"]))
    sets = sets.select("id", "text", levels.alias("levels")).select("id", shingles(F.col("text"), F.col("levels")).alias("sh"))
    sets = written(sets, "candidate-sets")
    discard(wanted)
    return sets


def _verified(pairs: DataFrame, members: DataFrame, classes: DataFrame, docs: DataFrame, levels) -> DataFrame:
    """Pairs whose overlap suffices. Both sets of a pair lie in one partition, by group and square."""
    spark = pairs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy("a").agg(F.least("a", F.min("b")).alias("g"))
    p = pairs.join(least, "a")
    cut = p.groupBy("g").agg(F.ceil(F.sqrt(F.count("*") / PAIRS)).cast("int").alias("cut"))
    p = p.join(cut, "g").select(F.xxhash64("g", F.pmod(F.xxhash64("a"), "cut"), F.pmod(F.xxhash64("b"), "cut")).alias("g"), "a", "b")
    p = written(p, "squares")
    ends = p.select("g", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(True).alias("left")), F.struct(F.col("b").alias("id"), F.lit(False).alias("left")))).alias("x")).select("g", "x.*").distinct()
    sets = _whole_sets(ends.select("id").distinct(), members, classes, docs, levels)
    # in a session of its own, where one shuffle by g serves both joins
    own = apart(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})
    p, sets, ends = (again(own) for again in (p._again, sets._again, written(ends, "ends")._again))
    at = sets.join(F.broadcast(ends) if ends.count() <= FEW else ends, "id")  # 17 bytes a row
    left = at.filter("left").select("g", F.col("id").alias("a"), F.col("sh").alias("sa"))
    right = at.filter("not left").select("g", F.col("id").alias("b"), F.col("sh").alias("sb"))
    j = p.repartition(parts, "g").join(left.repartition(parts, "g"), ["g", "a"]).join(right.repartition(parts, "g"), ["g", "b"])
    o = F.size(F.array_intersect("sa", "sb"))
    j = j.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), o.alias("o")).filter("100 * o >= 60 * (na + nb - o)").select("a", "b")
    found = written(j, "verified")._again(spark)
    discard(p, sets, ends)
    return found


def op9_similar_documents(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents", "doc_id", "text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest doc_id (a null one last), of these that with the smallest row
    key; rows without shingles all stay. Keeps docs' columns, whatever their names."""
    row = fresh("row")
    at = linked_rows(docs.select("doc_id", "text"), counts=False).filter("comp IS NOT NULL")
    best = at.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best"))
    best = best.select(F.col("best.row").alias("row")).join(at.groupBy("row").count(), "row")
    best = written(best.select(F.col("row").alias(row), "count"), "kept")
    d = docs.withColumn(row, row_key("doc_id", "text"))

    def of(some):
        small = some.count() <= FEW  # 40 bytes a row
        return d.join(F.broadcast(some) if small else some, row, "left_semi")

    # only rows that are alike in doc_id and text have to meet
    once, more = of(best.filter("count = 1")), of(best.filter("count > 1")).dropDuplicates([row])
    return once.unionByName(more).select(*docs.columns).unionByName(docs.filter(n_words(F.col("text")) == 0))
