"""Secret scans, in DataFrame functions only.

Base spans: three patterns, leftmost and non-overlapping per kind; positions come from the lengths of the pieces
between the matches (split) and of the matches (regexp_extract_all), in code points.

The battery takes the value of every base span, and every run of 24 or more characters of a base-64 or URL alphabet that
holds a digit and a letter and touches no base span (a UUID is such a run). The encoding (hex, base 32,
base 64) is inferred from the characters. Three tests of "drawn uniformly from the alphabet" are made: chi-squared of
the alphabet's classes (common letters and others, by case; digits; symbols), the number of runs of one coarse class, and
the lag-one serial correlation of the places in the alphabet. Their z values are combined by Stouffer's rule.

A discovery is a string that looks more random than structured text does. How structured text scores is fitted on the
corpus: every document gives one made-up name, the words at a hashed place in camel case or run together with two digits
(for hex, dates and counters), and z is regressed on the root of the length for each encoding. A string's p value is the
chance that structured text of its length and encoding scores as low. Benjamini-Hochberg at FDR, exact, within strata of
encoding and length, settles which are reported, kind "random"; so of what is reported at most that share is structured, by
that fit. Base spans stay whatever the battery says; `n_base_random` counts those that it would report too.

The step-up rule uses a histogram of ln p per stratum, BINS bins a unit, with each bin's rows and its least and largest p;
only the bins that these leave open are settled row by row. A corpus without words has no fit; then FIT stands in.

Null and empty texts have no spans. Very long texts are one row; a doc_id may be null or repeated, each row counts alone.
Rows alike in doc_id and text are judged once. An empty table gives no rows; other columns are ignored, `redact` keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, fresh, row_key, table, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"^(?=.*[0-9])(?=.*[A-Za-z])"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: False-discovery rate of "structured", bins per unit of ln p, and the edge of a length stratum.
FDR, BINS, STRATUM = 0.05, 20, 16
#: Rows with spans that may be broadcast.
FEW = 200_000
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UP, LOW, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
COMMON = "etaoinsr"
ALPHABET = {"hex": DIGITS + LOW[:6], "base32": UP + "234567", "base64": UP + LOW + DIGITS + "+/"}
#: Class of each character, for the chi-squared test, and the coarse class, for the runs test.
CLASS = {
    "hex": "0011223344556677",
    "base32": "".join("a" if c.lower() in COMMON else "b" for c in UP) + "c" * 6,
    "base64": "".join("a" if c.lower() in COMMON else "b" for c in UP) + "".join("c" if c in COMMON else "d" for c in LOW) + "e" * 10 + "ff",
}
COARSE = {"hex": "d" * 10 + "l" * 6, "base32": "u" * 26 + "d" * 6, "base64": "u" * 26 + "l" * 26 + "d" * 12}
#: Lengths of made-up names; intercept, slope on the root of the length, and deviation of z where the corpus gives no fit.
LENGTHS = (8, 12, 16, 24, 32, 48, 64)
FIT = {"hex": (0.0, 2.5, 3.0), "base32": (0.0, 0.6, 1.3), "base64": (-1.0, 0.9, 1.3)}


def spans(text, pattern: str, kind: int, good=None):
    """Column: array of (s, k, e) for the matches of pattern in text, those for which good(match) holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("out"))

    def step(acc, p):
        s = acc["at"] + F.length(p["g"])
        e = s + F.length(p["m"])
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        keep = F.lit(True) if good is None else good(p["m"])
        return F.struct(e.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    full = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), full).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def _joined(spans_col):
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidates(text, base):
    """Column: array of (s, e, m) for the runs of text that are long and mixed enough and touch no base span."""
    found = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    gaps = F.split(text, RUN, -1)
    kind = "array<struct<s:int,e:int,m:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, p):
        s = acc["at"] + F.length(p["g"])
        e = s + F.length(p["m"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m")))
        return F.struct(e.alias("at"), F.when(p["m"].rlike(MIXED), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    every = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    clear = F.filter(every, lambda c: ~F.exists(base, lambda x: (x["s"] < c["e"]) & (x["e"] > c["s"])))
    return F.when(text.rlike(RUN), clear).otherwise(F.array().cast(kind))


def battery(c: DataFrame) -> DataFrame:
    """Adds enc, length and z (large for structured strings) to rows with a string column v."""
    v = F.col("v")
    c = c.withColumn("v", F.when(v.rlike(UUID), F.regexp_replace(v, "-", "")).otherwise(F.regexp_replace(F.translate(v, "-_", "+/"), "[^A-Za-z0-9+/]", "")))
    c = c.withColumn("enc", F.when(v.rlike("^[0-9a-fA-F]+$"), "hex").when(v.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64"))
    c = c.withColumn("v", F.when(F.col("enc") == "hex", F.lower("v")).otherwise(v)).withColumn("length", F.length("v")).filter("length > 1")
    each = lambda f: F.when(F.col("enc") == "hex", f("hex")).when(F.col("enc") == "base32", f("base32")).otherwise(f("base64"))
    return c.withColumn("z", each(_z))


def _z(enc: str):
    """Column: combined z of v under "drawn uniformly from the alphabet of enc"."""
    alphabet, n = ALPHABET[enc], F.col("length").cast("double")
    size = len(alphabet)
    share = lambda classes: {k: classes.count(k) / size for k in dict.fromkeys(classes)}
    mapped = F.translate("v", alphabet, CLASS[enc])
    chi = sum(((F.col("length") - F.length(F.translate(mapped, k, "")) - n * p) ** 2 / (n * p) for k, p in share(CLASS[enc]).items()), F.lit(0.0))
    d = len(share(CLASS[enc])) - 1
    # Wilson-Hilferty: the cube root of chi-squared over its degrees is nearly normal
    z_chi = (F.pow(chi / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.lit((2 / (9 * d)) ** 0.5)
    runs = F.length(F.regexp_replace(F.translate("v", alphabet, COARSE[enc]), r"(.)\1+", "$1"))
    p2, p3 = (sum(p**k for p in share(COARSE[enc]).values()) for k in (2, 3))
    change = 1 - p2
    var = (n - 1) * change * p2 + 2 * F.greatest(n - 2, F.lit(0.0)) * ((1 - 2 * p2 + p3) - change**2)
    z_runs = ((n - 1) * change - (runs - 1)) / F.sqrt(F.greatest(var, F.lit(1e-9)))
    pos = F.expr(f"transform(filter(split(v, ''), x -> x <> ''), x -> locate(x, '{alphabet}') - {(size + 1) / 2}D)")
    products = F.zip_with(F.slice(pos, F.lit(1), F.col("length") - 1), F.slice(pos, F.lit(2), F.col("length") - 1), lambda a, b: a * b)
    cov = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
    z_serial = F.abs(cov / ((size**2 - 1) / 12)) / F.sqrt(n - 1)
    half = 0.7978845608  # mean of |z|, taken off the two-sided one; structured text has too few runs, never too many
    return (z_chi + z_runs + (z_serial - half)) / F.lit((2 + 0.3634) ** 0.5)


def structured(docs: DataFrame) -> DataFrame:
    """One made-up name per document and encoding, as v."""
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    d = docs.filter(F.length("text") > 20).select(h.alias("h"), F.split(F.trim("text"), GAP).alias("w"))
    n = F.element_at(F.array(*[F.lit(x) for x in LENGTHS]), (F.pmod("h", F.lit(len(LENGTHS))) + 1).cast("int"))
    words = F.array_join(F.slice("w", (F.pmod(F.shiftright("h", 3), F.size("w")) + 1).cast("int"), F.lit(24)), " ")
    d = d.select("h", n.alias("n"), F.regexp_replace(F.when(F.col("h") % 2 == 0, F.initcap(words)).otherwise(words), "[^A-Za-z0-9]", "").alias("w"))
    two = F.lpad(F.pmod(F.shiftright("h", 5), F.lit(100)).cast("string"), 2, "0")
    name = F.concat(F.col("w").substr(F.lit(1), F.col("n") - 2), two)
    part = lambda k, m: F.lpad((F.pmod(F.shiftright("h", k), F.lit(m)) + 1).cast("string"), 2, "0")
    dates = F.repeat(F.concat(F.lit("20"), part(4, 40), part(9, 12), part(13, 28), F.lpad(F.pmod("h", F.lit(999)).cast("string"), 8, "0")), 5)
    every = F.array(name, F.translate(F.upper(name), "0189", "2345"), dates.substr(F.lit(1), F.col("n")))
    return d.filter(F.length("w") >= F.col("n")).select(F.explode(every).alias("v"))


def fitted(docs: DataFrame) -> dict[str, tuple[float, float, float]]:
    """(intercept, slope, deviation) of z of structured text on the root of the length, by encoding. Three rows reach the driver."""
    b = battery(structured(docs)).withColumn("x", F.sqrt("length"))
    rows = b.groupBy("enc").agg(F.count("*").alias("n"), F.regr_intercept("z", "x").alias("a"), F.regr_slope("z", "x").alias("b"), F.stddev("z").alias("s"), F.corr("z", "x").alias("r")).collect()
    fit = {r["enc"]: (r["a"], r["b"], max(0.3, r["s"] * max(0.0, 1 - r["r"] ** 2) ** 0.5)) for r in rows if r["n"] >= 30 and r["r"] is not None and r["r"] == r["r"]}
    return FIT | fit


def p_values(c: DataFrame, fit: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Adds p, the chance that structured text scores as low, and stratum."""
    x = F.lit(0.0)
    for enc, (a, b, s) in fit.items():
        x = F.when(F.col("enc") == enc, (F.col("z") - (a + b * F.sqrt("length"))) / s).otherwise(x)
    # lower tail of the normal, by a logistic approximation
    c = c.withColumn("x", x).withColumn("p", 1 / (1 + F.exp(F.least(F.lit(700.0), -(0.07056 * F.pow("x", F.lit(3)) + 1.5976 * F.col("x"))))))
    return c.withColumn("stratum", F.floor(F.log2(F.col("length") / STRATUM) * 2)).drop("x")


NONE = "array<struct<s:int,k:int,e:int>>"


def cuts(c: DataFrame, fdr: float = FDR) -> DataFrame:
    """c (enc, stratum, p) -> enc, stratum, cut: the largest p that Benjamini-Hochberg rejects. Strata without one are left out."""
    c = c.select("enc", "stratum", "p", F.floor(F.ln("p") * BINS).alias("bin"))
    h = c.groupBy("enc", "stratum", "bin").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    w = Window.partitionBy("enc", "stratum")
    h = h.withColumn("rank", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    whole = F.col("hi") <= fdr * F.col("rank") / F.col("all")
    h = h.withColumn("cut", F.max(F.when(whole, F.col("hi"))).over(w))
    # above that cut a row may pass where its bin's least p would pass at the bin's last rank
    open_ = h.filter((F.col("lo") <= fdr * F.col("rank") / F.col("all")) & (F.col("cut").isNull() | (F.col("lo") > F.col("cut"))))
    rows = c.join(open_.select("enc", "stratum", "bin", (F.col("rank") - F.col("n")).alias("below"), "all"), ["enc", "stratum", "bin"])
    rank = F.col("below") + F.count("*").over(Window.partitionBy("enc", "stratum", "bin").orderBy("p"))
    rows = rows.withColumn("rank", rank).filter(F.col("p") <= fdr * F.col("rank") / F.col("all"))
    every = h.filter("cut IS NOT NULL").select("enc", "stratum", "cut").unionByName(rows.select("enc", "stratum", F.col("p").alias("cut")))
    return every.groupBy("enc", "stratum").agg(F.max("cut").alias("cut"))


def scanned(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """docs with doc_id and text -> (row, doc_id, base, spans, n_base_random); base and spans are arrays of (s, k, e) by start,
    then kind. row is the row_key. Apart from the fit, texts are read once; what follows holds spans and candidates only."""
    docs = docs.select("doc_id", "text")
    t = F.coalesce(F.col("text"), F.lit(""))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    base = F.array_sort(F.concat(spans(t, ASSIGN, 0, lambda m: F.length(value(m)) >= 6), spans(t, ACCESS, 1), spans(t, HEX, 2)))
    d = docs.select("doc_id", "text", base.alias("base"))

    def valued(x):
        m = F.col("text").substr(x["s"] + 1, x["e"] - x["s"])
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.when(x["k"] == 0, value(m)).otherwise(m).alias("v"))

    added = F.transform(candidates(t, F.col("base")), lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e"), c["m"].alias("v")))
    d = d.select(row_key("doc_id", "text").alias("row"), "doc_id", "base", F.concat(F.transform("base", valued), added).alias("cand"))
    d = written(d, "secret-spans")
    c = d.select("row", F.explode("cand").alias("c")).select("row", "c.*").distinct()
    c = written(p_values(battery(c), fitted(docs)).drop("v"), "secret-candidates")
    c = c.join(cuts(c, fdr), ["enc", "stratum"]).filter(F.col("p") <= F.col("cut"))
    found = F.collect_list(F.when(F.col("k") == 3, F.struct("s", "k", "e")))
    c = c.groupBy("row").agg(found.alias("added"), F.count(F.when(F.col("k") < 3, 1)).alias("n_base_random"))
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(NONE))))
    return d.join(c, "row", "left").select("row", "doc_id", "base", every.alias("spans"), F.coalesce("n_base_random", F.lit(0)).alias("n_base_random"))


def digest(d: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.col("n_base_random").cast("long"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(scanned(table(spark, sf_dir, "documents", "doc_id", "text")))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by mark; overlapping spans are replaced as one. Keeps the columns of docs."""
    row, spans_ = fresh("row"), fresh("spans")
    found = scanned(docs).filter(F.size("spans") > 0).select("row", "spans").groupBy("row").agg(F.first("spans").alias(spans_))
    found = written(found.withColumnRenamed("row", row), "secrets-found")
    small = found.count() <= FEW  # about 60 bytes a row
    d = docs.withColumn(row, row_key("doc_id", "text")).join(F.broadcast(found) if small else found, row, "left")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.col("text").substr(acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    text = F.aggregate(spans_, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.col("text").substr(acc["at"] + 1, F.length("text"))))
    hit = F.col(spans_).isNotNull()
    d = d.withColumn("text", F.when(hit, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)
