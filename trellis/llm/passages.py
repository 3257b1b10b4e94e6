"""Substring dedup: words of repeated 50-word windows go, but for the document with the smallest doc_id.

1. Anchors: of the 26 phrases of 25 words in each window of 50, the one with the smallest hash. Equal windows have equal
   anchors, so a window that recurs has an anchor that two different texts hold. About 2 in 27 words start an anchor.
2. Recurring anchors are confirmed passages once their words have been fetched from their owner, the text with the
   smallest number that holds them. They are sharded by owner, so a document meets few shards; an owner of more than
   PASSAGES passages is spread over several shards, and a shard holds about PASSAGES of them.
3. Each shard's passages are compiled into an Aho-Corasick automaton (of their first HEAD words; the rest is compared where
   one is met), and the documents that hold an anchor of the shard are streamed through it: the passages of a shard come
   first, then its documents, in one sorted stream, so no group is held in memory. A shard with more than CHARS
   characters to stream is salted: its passages go to every salt, each document to one.
4. Each window whose anchor the automaton has located is confirmed by a 128-bit digest of its words, grouped to the smallest
   doc_id, and marked if it starts in a smaller one too. Its words are removed from the text.

Texts of more than STRETCH characters are worked on in stretches that overlap by 49 words. Exact copies share one text: it is
searched once, under its smallest doc_id, and of the others every word goes if there are 50. Groups of copies and hot
passages are pre-aggregated (min and max), never collected.

A null or empty text has no words. A text of fewer than 50 words has no window. A null doc_id is smaller than none and
larger than none: the row keeps all words and takes none from others. Rows of one doc_id don't remove from each other. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, table, written

WINDOW, GRAM = 50, 25
HEAD, PASSAGES, CHARS, STRETCH = 6, 4000, 8_000_000, 1_000_000

_B = pow(0x9E3779B97F4A7C15 | 1, 3, 2**64)
_I = pow(_B, -1, 2**64)
_pw = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    if len(_pw[0]) < n:
        m = 1 << n.bit_length()
        for k, base in enumerate((_B, _I)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _pw[k] = np.cumprod(p, dtype=np.uint64)
    return _pw[0][:n], _pw[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Stretch:
    """Consecutive words of a text, the first of which has the number `at`."""

    def __init__(self, words: list[bytes], at: int = 0):
        self.words, self.n, self.at = words, len(words), at

    def phrases(self) -> np.ndarray:
        """Hash of each phrase of GRAM words."""
        w = _mix((np.fromiter(map(zlib.crc32, self.words), np.uint64, self.n) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        pw, inv = _powers(self.n + 1)
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * pw[:-1], dtype=np.uint64)])
        return _mix((s[GRAM:] - s[:-GRAM]) * inv[: self.n - GRAM + 1])

    def anchor_of_window(self, h: np.ndarray) -> np.ndarray:
        w = WINDOW - GRAM + 1
        return np.lib.stride_tricks.sliding_window_view(h, w).argmin(1) + np.arange(len(h) - w + 1)

    def phrase(self, p: int) -> str:
        return b" ".join(self.words[p : p + GRAM]).decode()

    def digests(self, starts: list[int]) -> np.ndarray:
        """Two 64-bit integers for each of the windows."""
        joined = b" ".join(self.words)
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.words), np.int64, self.n) + 1)]).tolist()
        all_ = b"".join([hashlib.blake2b(joined[begin[s] : begin[s + WINDOW] - 1], digest_size=16).digest() for s in starts])
        return np.frombuffer(all_, "<i8").reshape(-1, 2)


def stretches(text: str, most: int = STRETCH):
    """The stretches of a text that hold a window; windows lie in one of them each."""
    if len(text) <= most:
        words = text.encode().split()
        if len(words) >= WINDOW:
            yield Stretch(words)
        return
    data, i, carry, at = text.encode(), 0, [], 0
    while i < len(data):
        j = i + most
        while j < len(data) and data[j] not in b" \t\n\r\x0b\x0c":
            j += 1
        words = carry + data[i:j].split()
        if len(words) >= WINDOW:
            yield Stretch(words, at)
            at += len(words) - WINDOW + 1
            words = words[len(words) - WINDOW + 1 :]
        carry, i = words, j


def slices(batches, rows: int = 500):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, key, text -> h, tid (the key's first 64 bits), doc_id, key; each anchor once per text."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 2000):
            at, hs = [], []
            for k, t in enumerate(b.column(2)):
                found = []
                for x in stretches(t.as_py()):
                    h = x.phrases()
                    found.append(h[np.unique(x.anchor_of_window(h))])
                if found:
                    h = np.unique(np.concatenate(found))
                    at.append(np.full(len(h), k))
                    hs.append(h.view(np.int64))
            if at:
                tid = np.array([int.from_bytes(k.as_py()[:8], "big", signed=True) for k in b.column(1)])
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(tid[at]), *(b.column(k).take(pa.array(at)) for k in range(2))], ["h", "tid", "doc_id", "key"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "h long, tid long, doc_id long, key binary")


def fetched(owners: DataFrame) -> DataFrame:
    """text, own (h and shard of the passages that it owns) -> shard, text: the passages' words."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            shards, texts = [], []
            for t, own in zip(b.column(0), b.column(1)):
                todo = {x["h"]: x["shard"] for x in own.as_py()}
                for x in stretches(t.as_py()):
                    h = x.phrases().view(np.int64)
                    for p in np.flatnonzero(np.isin(h, np.fromiter(todo, np.int64, len(todo)))).tolist():
                        shard = todo.pop(int(h[p]), None)
                        if shard is not None:
                            shards.append(shard)
                            texts.append(x.phrase(p))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(texts, pa.string())], ["shard", "text"])

    return owners.select("text", "own").mapInArrow(run, "shard int, text string")


class Automaton:
    """Locates passages: the automaton finds their first HEAD words, and the text there settles which one it is."""

    def __init__(self, passages: list[str]):
        import ahocorasick

        self.tails: dict[str, list[str]] = {}
        for p in passages:
            head = " " + " ".join(p.split(" ", HEAD)[:HEAD]) + " "
            self.tails.setdefault(head, []).append(p + " ")
        self.a = ahocorasick.Automaton()
        for head, tails in self.tails.items():
            self.a.add_word(head, (len(head), tails))
        self.a.make_automaton()

    def __call__(self, x: Stretch) -> np.ndarray:
        """Numbers, in the stretch, of the words that begin a passage."""
        if not self.tails:
            return np.zeros(0, np.int64)
        text = " " + b" ".join(x.words).decode() + " "
        hits = [at for end, (n, tails) in self.a.iter(text) if any(text.startswith(p, at := end - n + 2) for p in tails)]
        if not hits:
            return np.zeros(0, np.int64)
        words = text[1:-1].split(" ")
        begin = np.cumsum(np.fromiter(map(len, words), np.int64, x.n) + 1)
        return np.searchsorted(begin, np.unique(hits), "left") if len(hits) else np.zeros(0, np.int64)


def located(stream: DataFrame) -> DataFrame:
    """shard, salt, kind, text, key, doc_id, sorted by the first three; kind 0 is a passage, 1 a document. Gives w1, w2, doc_id,
    key, s for the windows whose anchor is a passage of the shard."""

    def run(batches):
        import pyarrow as pa

        at, passages, a = None, [], None
        ws, who, ss, n = [], [], [], 0

        def out():
            k = np.repeat(np.arange(len(who)), [len(s) for s in ss])
            w = np.concatenate(ws)
            ids = pa.array([i for i, _ in who], pa.int64()).take(pa.array(k))
            keys = pa.array([x for _, x in who], pa.binary()).take(pa.array(k))
            return pa.RecordBatch.from_arrays([pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), ids, keys, pa.array(np.concatenate(ss), pa.int32())], ["w1", "w2", "doc_id", "key", "s"])

        for b in slices(batches):
            for shard, salt, kind, text, key, doc_id in zip(*(b.column(k) for k in range(6))):
                here, text = (shard.as_py(), salt.as_py()), text.as_py()
                if here != at:
                    at, passages, a = here, [], None
                if kind.as_py() == 0:
                    passages.append(text)
                    continue
                if a is None:
                    a = Automaton(passages)
                for x in stretches(text):
                    first = a(x)
                    if len(first):
                        s = np.flatnonzero(np.isin(x.anchor_of_window(x.phrases()), first))
                        if len(s):
                            ws.append(x.digests(s.tolist()))
                            who.append((doc_id.as_py(), key.as_py()))
                            ss.append(s + x.at)
                            n += len(s)
                if n > 20_000:
                    yield out()
                    ws, who, ss, n = [], [], [], 0
        if n:
            yield out()

    return stream.select("shard", "salt", "kind", "text", "key", "doc_id").mapInArrow(run, "w1 long, w2 long, doc_id long, key binary, s int")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, key, text -> key, starts (of the windows to remove of the row with the smallest doc_id), first (that doc_id, null
    where the text has one doc_id only: of the others every word goes)."""
    named = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * WINDOW - 1))
    t1 = written(anchors(named), "anchors")
    hot = t1.groupBy("h").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).filter(F.col("a") < F.col("b"))
    hot = written(hot.select("h", F.col("a").alias("owner")), "recurring")
    shards = max(1, -(-hot.count() // PASSAGES))
    large = hot.groupBy("owner").count().filter(F.col("count") > PASSAGES).select("owner", F.ceil(F.col("count") / PASSAGES).alias("subs"))
    shard = F.pmod(F.xxhash64("owner", F.pmod("h", F.coalesce("subs", F.lit(1)))), F.lit(shards)).cast("int")
    hot = hot.join(large, "owner", "left").select("h", "owner", shard.alias("shard"))
    own = F.when(F.col("owner") == F.col("tid"), F.struct("h", "shard"))
    held = t1.join(hot, "h").select("key", "doc_id", "shard", own.alias("own")).repartition("key")
    held = held.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.collect_set("shard").alias("shards"), F.collect_set("own").alias("own"))
    routed = written(named.select("doc_id", "key", "text").join(held, ["key", "doc_id"]), "routed")
    discard(t1)
    passages = written(fetched(routed.filter(F.size("own") > 0)), "passages")
    each = routed.select(F.explode("shards").alias("shard"), "key", "doc_id", "text")
    load = each.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / CHARS).cast("int").alias("salts"))
    load = written(load, "salts")  # a row per shard
    p = passages.distinct().join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "text", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"))
    d = each.join(load, "shard").select("shard", F.pmod(F.xxhash64("key"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), "text", "key", "doc_id")
    w = written(located(p.unionByName(d).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")), "windows")
    discard(routed, passages)
    first = w.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last")).drop("last")
    again = w.join(first, ["w1", "w2"]).filter(F.col("doc_id") > F.col("first"))
    marked = written(again.select("key", "s").repartition("key").groupBy("key").agg(F.collect_set("s").alias("starts")), "marks")
    discard(w)
    copies = named.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last"))
    return marked.join(copies.drop("last"), "key", "full")


def keyed(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), t.alias("text")).withColumn("key", F.unhex(F.md5("text")))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space)."""
    ship(docs.sparkSession)
    d = keyed(docs)
    j = d.join(repeats(d), "key", "left").withColumn("whole", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            n, gone, sha, kept = [], [], [], []
            for i, t, whole, starts in zip(*(b.column(k) for k in range(4))):
                words = t.as_py().encode().split()
                left, starts = words, starts.as_py()
                if whole.as_py():
                    left = [] if len(words) >= WINDOW else words
                elif starts and i.is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    s = np.array(starts)
                    edge[s] += 1
                    np.add.at(edge, s + WINDOW, -1)
                    left = [w for w, c in zip(words, np.cumsum(edge)[:-1].tolist()) if not c]
                joined = b" ".join(left)
                n.append(len(words))
                gone.append(len(words) - len(left))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return j.select("doc_id", "text", "whole", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op4_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")
