"""Toxicity: a counterfactually regularised linear classifier over words and their first letters.

Features of a text are its distinct words (lower case, letters and digits) and the first 4, 5 and 6 characters of its
longer words, so that unseen forms of a known stem count. FEATURES of them are chosen by the chi-squared statistic over
the labelled sample. Logistic loss; for each sampled text that names a group, the same text with that term swapped for
another group's takes part, and the squared difference of the two scores is penalised, so a term's own weight can't carry
a verdict. A proximal step (L1) keeps the model sparse, so long neutral texts don't add up to anything.

Group terms are those of IDENTITY, in sets within which any one may stand for another, and sets learned from the sample:
words of DF share of its texts that come with either label alike (smoothed log-odds of at most NEUTRAL), by how often they
come, SET to a set. The second kind is there as a corpus may name its groups by words that no list has. `train` reports how
many sampled texts got a swapped twin.

The labelled sample is the SAMPLE rows of lowest hash(doc_id) among the labelled ones outside the held-out fold
(crc32(doc_id) mod 4 = 2); the bound is this parameter. Scoring covers every whole text. Labels, lang, source and doc_id
are no inputs of a score. A null text scores as an empty one. Without labels, or with one class only, every score is the
share of toxic labels (0 without any). A doc_id with several labels counts once for each; a null doc_id has no label and
is never held out.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, release, ship, table, written

SAMPLE = 10_000
FEATURES = 1024
THRESHOLD = 0.3
COUNTERFACTUAL, L1, STEPS = 4.0, 2e-4, 1500
SMOOTH, POWER = 20.0, 2
KEPT = 250_000
#: Terms that name groups, in sets within which any one may stand for another.
IDENTITY = (
    ("women", "men", "woman", "man", "female", "male", "girls", "boys", "trans", "nonbinary"),
    ("muslim", "muslims", "jewish", "jews", "christian", "christians", "hindu", "buddhist", "atheist", "catholic"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "mexican", "chinese", "indian"),
    ("immigrants", "immigrant", "refugees", "refugee", "citizens", "foreigners"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
    ("femmes", "hommes", "musulmans", "juifs", "chrétiens", "frauen", "männer", "mujeres", "hombres"),
)
#: Learned terms: share of the texts that hold one, log-odds, terms of a set, terms at most.
DF, NEUTRAL, SET, LEARNED = (0.02, 0.3), 0.15, 4, 48
_word = re.compile(r"\w+").findall


def features_of(word: str) -> list[str]:
    """The features of one white-space word."""
    out = []
    for w in _word(word.lower()):
        out.append(w)
        out += [f"{w[:k]}*" for k in (4, 5, 6) if len(w) > k]
    return out


def ids_of(features) -> np.ndarray:
    """Features by number: 32-bit hashes, ascending."""
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(f) for f in features), np.uint32))


def text_features(text: str) -> set[str]:
    return {f for w in set(text.split()) for f in features_of(w)}


def swaps(sets) -> dict[str, tuple[str, ...]]:
    """Each term's set. A term of several sets counts in the first."""
    return {t: s for s in reversed([tuple(s) for s in sets if len(s) > 1]) for t in s}


def learned_sets(counts: list[tuple[str, int, int]], n: int, toxic: int) -> list[tuple[str, ...]]:
    """Sets of label-neutral terms from (word, texts that hold it, toxic ones among them) of n texts, so many of them toxic."""
    rate = toxic / n if n else 0.0
    if rate in (0.0, 1.0):
        return []
    odds = math.log(rate / (1 - rate))
    even = [(c, w) for w, c, a in counts if DF[0] * n <= c <= DF[1] * n and abs(math.log((a + SMOOTH * rate) / (c - a + SMOOTH * (1 - rate))) - odds) <= NEUTRAL]
    even = [w for _, w in sorted(even, key=lambda x: (-x[0], x[1]))[:LEARNED]]
    return [tuple(even[i : i + SET]) for i in range(0, len(even) - SET + 1, SET)]


def swapped(text: str, turn: int, terms: dict[str, tuple[str, ...]] | None = None) -> str | None:
    """text with each group term swapped for another of its set; None if there is none."""
    hit, terms = False, swaps(IDENTITY) if terms is None else terms

    def other(m):
        nonlocal hit
        s = terms.get(m[0].lower())
        if s is None:
            return m[0]
        hit = True
        return s[(s.index(m[0].lower()) + 1 + turn % (len(s) - 1)) % len(s)]

    out = re.sub(r"\w+", other, text)
    return out if hit else None


def fit(rows: list[np.ndarray], twins: list[np.ndarray | None], y, features: int = FEATURES, weight: float = COUNTERFACTUAL, l1: float = L1, steps: int = STEPS, terms=None) -> tuple[dict[int, float], float]:
    """(weight by feature number, bias) from the features of each text and of its swapped twin, if any.

    Full-batch proximal gradient on the chosen features, the same on every run.
    """
    y = np.asarray(y, float)
    n, rate = len(y), float(np.mean(y)) if len(y) else 0.0
    if n == 0 or rate in (0.0, 1.0):
        r = min(max(rate, 1e-6), 1 - 1e-6)
        return {}, float(np.log(r / (1 - r)))
    every = np.concatenate(rows)
    owner = np.repeat(np.arange(n), [len(x) for x in rows])
    known, inv = np.unique(every, return_inverse=True)
    df, a = np.bincount(inv, minlength=len(known)), np.bincount(inv, y[owner], len(known))
    chi = np.where(df >= 3, (a - df * rate) ** 2 / (df * rate * (1 - rate)), 0)
    for t in swaps(IDENTITY) if terms is None else terms:  # group terms always take part: it's their weights that the penalty holds down
        chi[known == ids_of([t])[0]] = np.inf
    chosen = np.sort(np.lexsort((known, -chi))[:features])
    known = known[chosen]

    def sparse(sets):
        c = [np.searchsorted(known, x[np.isin(x, known, assume_unique=True)]) for x in sets]
        return np.repeat(np.arange(len(c)), [len(x) for x in c]), np.concatenate(c).astype(np.int64) if c else np.array([], np.int64)

    r, c = sparse(rows)
    pair = np.array([i for i, t in enumerate(twins) if t is not None], np.int64)
    r2, c2 = sparse([twins[i] for i in pair])
    k, pos = len(known), y.sum()
    sw = np.where(y == 1, 0.5 / pos, 0.5 / (n - pos))  # balanced classes
    # a feature counts by the logarithm of its odds, smoothed, so that rare chance finds stay small
    a, f = np.bincount(c, y[r], k), np.bincount(c, 1 - y[r], k)
    scale = np.abs(np.log(((a + SMOOTH * rate) / (f + SMOOTH * (1 - rate))) * ((n - pos) / pos))) ** POWER
    w, b, gw, gb, step = np.zeros(k), 0.0, np.zeros(k), 0.0, 0.3 / max(1.0, float((np.bincount(r, (scale**2)[c], n)).max()))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(steps):
        p = sig(b + np.bincount(r, (w * scale)[c], n))
        g = sw * (p - y)
        grad = np.bincount(c, g[r], k) * scale
        if len(pair):
            p2 = sig(b + np.bincount(r2, (w * scale)[c2], len(pair)))
            diff, full = weight * (p[pair] - p2) / len(pair), np.zeros(n)
            full[pair] = diff * p[pair] * (1 - p[pair])
            grad += (np.bincount(c, full[r], k) - np.bincount(c2, (diff * p2 * (1 - p2))[r2], k)) * scale
        gw, gb = 0.9 * gw + grad, 0.9 * gb + g.sum()
        w = w - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= step * gb
    w = w * scale
    # Platt's scaling on natural class shares makes the scores probabilities
    z = np.bincount(r, w[c], n)
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (n - pos + 2))
    m = np.stack([z / max(z.std(), 1e-9), np.ones(n)])
    ab = np.array([1.0, float(np.log(rate / (1 - rate)))])
    for _ in range(50):
        p = sig(ab @ m)
        h = (m * (p * (1 - p))) @ m.T + 1e-3 * np.eye(2)
        ab = ab + np.clip(np.linalg.solve(h, m @ (t - p)), -1, 1)
    slope, b = ab[0] / max(z.std(), 1e-9), float(ab[1])
    w = w * slope
    return {int(f): float(x) for f, x in zip(known, w) if abs(x) > 1e-4}, b


def chosen(rows: DataFrame, n: int, toxic: int, always: np.ndarray, features: int = FEATURES) -> list[int]:
    """The features that `fit` chooses from n rows (own: feature numbers as bytes, toxic), told apart on the executors."""
    rate = toxic / n if n else 0.0

    def counted(batches):
        import pyarrow as pa

        for b in batches:
            own = [np.frombuffer(x.as_py(), np.uint32) for x in b.column(0)]
            y = np.repeat(b.column(1).to_numpy(), [len(x) for x in own]).astype(float)
            known, inv = np.unique(np.concatenate([np.array([], np.uint32), *own]), return_inverse=True)
            df, a = np.bincount(inv, minlength=len(known)), np.bincount(inv, y, len(known))
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(df, pa.int64()), pa.array(a, pa.float64())], ["f", "df", "a"])

    c = rows.select("own", "toxic").mapInArrow(counted, "f long, df long, a double").groupBy("f").agg(F.sum("df").alias("df"), F.sum("a").alias("a"))
    off = F.col("a") - F.col("df") * F.lit(rate)
    chi = F.lit(0.0) if rate in (0.0, 1.0) else F.when(F.col("df") >= 3, off * off / (F.col("df") * F.lit(rate) * F.lit(1 - rate))).otherwise(0.0)
    chi = F.when(F.col("f").isin(always.tolist()), F.lit(math.inf)).otherwise(chi)
    return [x["f"] for x in c.select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").limit(features).collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, identity=IDENTITY, weight: float = COUNTERFACTUAL, report: dict | None = None) -> tuple[dict[int, float], float]:
    """Fit on at most `sample` labelled rows of the training folds. Numbers of the FEATURES chosen ones and LEARNED terms' counts
    reach the driver, neither texts nor their other features. report, if given, gets rows, pairs (texts with a swapped twin) and
    the learned sets."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    # which rows: settled on ids alone, so that texts are read for the sample and nothing else moves
    lab = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held)
    rows = lab.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id", "toxic").limit(sample)
    d = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    j = d.join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")  # at most `sample` rows
    j = written(j, "labelled")
    n, toxic = j.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    words = j.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"(?U)\W+"))).alias("w")).filter("w <> ''")
    often = words.groupBy("w").agg(F.count("*").alias("c"), F.sum("toxic").alias("a")).filter((F.col("c") >= DF[0] * n) & (F.col("c") <= DF[1] * n))
    sets = learned_sets([tuple(r) for r in often.collect()], n, toxic)  # each text holds few words of 2 % of all texts
    terms = swaps([*identity, *sets])

    def numbered(batches):
        import pyarrow as pa

        release()
        for b in batches:
            own, twin = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                own.append(ids_of(text_features(t)).tobytes())
                x = swapped(t, i, terms)
                twin.append(None if x is None else ids_of(text_features(x)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary()), pa.array(twin, pa.binary()), b.column(2)], ["doc_id", "own", "twin", "toxic"])

    every = written(j.mapInArrow(numbered, "doc_id long, own binary, twin binary, toxic int"), "features")
    known = np.sort(np.array(chosen(every, n, toxic, ids_of(terms)), np.uint32))

    def cut(batches):
        import pyarrow as pa

        def only(x):
            if x is None:
                return None
            x = np.frombuffer(x, np.uint32)
            return x[np.isin(x, known, assume_unique=True)].tobytes()

        for b in batches:
            own, twin = ([only(x.as_py()) for x in b.column(i)] for i in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary()), pa.array(twin, pa.binary()), b.column(3)], ["doc_id", "own", "twin", "toxic"])

    got = every.mapInArrow(cut, every.schema).toArrow().to_pylist()
    discard(j, every)
    got.sort(key=lambda x: (x["doc_id"], x["own"], x["twin"] or b"", x["toxic"]))
    arr = lambda x: None if x is None else np.frombuffer(x, np.uint32)
    if report is not None:
        report |= {"rows": n, "pairs": sum(x["twin"] is not None for x in got), "sets": sets}
    return fit([arr(x["own"]) for x in got], [arr(x["twin"]) for x in got], [x["toxic"] for x in got], weight=weight, terms=terms)


class Scorer:
    """Scores whole texts. What a word adds is worked out once per worker and kept, up to KEPT words."""

    def __init__(self, model: tuple[dict[int, float], float]):
        self.weights, self.bias = model
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> float:
        hits: set[int] = set()
        get = self.memo.get
        for w in set(text.split()):
            t = get(w)
            if t is None:
                t = tuple(int(i) for i in ids_of(features_of(w)) if int(i) in self.weights)
                if len(self.memo) >= KEPT:
                    self.memo.clear()
                if len(w) <= 64:
                    self.memo[w] = t
            if t:
                hits.update(t)
        z = self.bias + math.fsum(map(self.weights.__getitem__, hits))
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def scored(docs: DataFrame, model: tuple[dict[int, float], float], name: str = "score") -> DataFrame:
    """docs with a column of that name appended, which docs must not have; all columns of docs are kept."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name}")
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    names = [*docs.columns, name]

    def score(batches):
        import pyarrow as pa

        release()
        s = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s(t.as_py() or "") for t in b.column(at)], pa.float64())], names)

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    at = THRESHOLD

    def score(batches):
        import pyarrow as pa

        release()
        s = Scorer(model)
        for b in batches:
            got = [s(t.as_py() or "") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64()), pa.array([int(x >= at) for x in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, with the columns of docs, whatever their names."""
    name = fresh("score")
    return scored(docs, train(docs, labels), name).filter(F.col(name) < threshold).select(*docs.columns)
