"""Mixing sources to target weights.

Every document gets a hash-random key; documents are ordered by (key, doc_id) within their source, distributed
prefix sums of their sizes are formed per (source, key bucket), and each source is cut at its exact budget: whole
epochs first, then the documents before the cut, and of the document on the cut just the words that are missing.

Nulls: a null text has size 0, a null source is a source of its own, last in order; a null doc_id is a document too.
Repeated rows are documents of their own (ties of the key are broken by a hash of the whole row's text, then anyhow, as
equal rows take the same place in turn). Empty tables give an empty result. Other columns pass through `mixed` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, table, words, written

WEIGHTS = (3, 1, 2)
#: The mix holds SHARE of all words, and no source more than CAP times its own.
SHARE = 1.5
CAP = 2
#: Documents per key bucket on average; a bucket of one source is sorted in one task.
BUCKET = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): min(cap * size, w * x) with x such that all sums to share.

    Sources take the weights in turn by code point, null last. In order of cap * size / w the sources that stay at their
    cap form a prefix; x is what the others share by weight. One row per source takes part, so the windows over all
    sources are as small as the list of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap))
    by = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    upto, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("before", F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
    s = s.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    s = s.withColumn("all_words", F.sum("source_size").over(everything) * float(share))
    s = s.withColumn("x", (F.col("all_words") - F.col("before")) / F.col("left_w"))
    # the first source, in this order, that its share doesn't fill
    s = s.withColumn("free", F.col("x") * F.col("w") < F.col("most"))
    s = s.withColumn("any_free", F.max("free").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("x", F.first(F.when(F.col("free"), F.col("x")), ignorenulls=True).over(everything))
    t = F.when(F.coalesce("any_free", F.lit(False)), F.col("x") * F.col("w")).otherwise(F.col("most"))
    return s.select("source", "source_size", t.alias("target"))


def mixed(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, bucket: int = BUCKET) -> DataFrame:
    """docs needs doc_id, source, size, and tie (a long that tells rows of one doc_id apart). Adds source_size, target, taken."""
    n = docs.count()
    buckets = max(1, -(-n // bucket))
    # 60 bits of MD5, which any engine has, so that SQL can tell the same order
    hashed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))), 1, 15)
    d = docs.withColumn("_key", F.conv(hashed, 16, 10).cast("long"))
    d = d.withColumn("_bucket", F.floor((F.col("_key") / F.lit(float(2**60))) * buckets).cast("int"))
    sums = d.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = written(sums, "mix-sums")  # one row per source and bucket
    goal = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, cap)
    w = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    plan = start.join(goal, start["source"].eqNullSafe(goal["source"])).select(start["source"].alias("_s"), F.col("_bucket").alias("_b"), "_start", "source_size", "target")
    d = d.join(plan, d["source"].eqNullSafe(plan["_s"]) & (d["_bucket"] == plan["_b"])).drop("_s", "_b")
    order = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("size").over(order), F.lit(0))
    budget = F.round("target").cast("long")
    per = F.greatest("source_size", F.lit(1))
    epochs = F.floor(budget / per).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return d.withColumn("taken", taken.cast("long")).drop("_key", "_bucket", "_start")


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    d = written(d.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "mix-docs")
    return mixed(d).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time cut to the words taken. Keeps the columns of docs.

    A document of no words stays once, as it takes nothing from any budget. Rows alike in doc_id and text share a list
    of counts, one for each of them.
    """
    tie, rid, rtie, rsize, takens, taken_ = F.xxhash64("text"), *map(fresh, ("id", "tie", "size", "takens", "taken"))
    d = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), tie.alias("tie")), "mix-docs")
    m = mixed(d, seed).groupBy(F.col("doc_id").alias(rid), F.col("tie").alias(rtie)).agg(F.first("size").alias(rsize), F.sort_array(F.collect_list("taken")).alias(takens))
    m = written(m, "mix-taken")
    once = m.filter(F.size(takens) == 1).count() == m.count()
    j = docs.join(m, docs["doc_id"].eqNullSafe(F.col(rid)) & (tie == F.col(rtie)))
    # rows alike in doc_id and text take the counts of the list in turn
    nth = F.lit(1) if once else F.row_number().over(Window.partitionBy(rid, rtie).orderBy(rsize))
    j = j.withColumn(taken_, F.element_at(takens, nth))
    per = F.greatest(rsize, F.lit(1))
    full = F.when(F.col(rsize) == 0, 1).otherwise(F.floor(F.col(taken_) / per)).cast("int")
    rest = (F.col(taken_) % per).cast("int")
    part = F.array_join(F.slice(words(F.col("text")), F.lit(1), rest), " ")
    none = F.array().cast("array<string>")
    copies = F.concat(F.array_repeat(F.col("text"), full), F.when(rest > 0, F.array(part)).otherwise(none))
    j = j.withColumn("text", F.explode(copies))
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return j.select(*docs.columns)
