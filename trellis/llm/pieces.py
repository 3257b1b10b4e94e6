"""SentencePiece sampling: forward filtering, backward sampling over the piece lattice.

The text, with a space put before it, is cut at spaces, line ends and marks into chunks that no piece crosses, so the
lattice of a text is a chain of the chunks' lattices. A mark starts a chunk only after a character with which no piece of
the model holds it; a model with a piece across chunks is refused. Forward sums alpha[j] of a chunk depend on its string alone; they are worked
out once per chunk and worker, and kept for up to KEPT nodes. Backward sampling then goes from each chunk's end to its
start and draws the last piece with probability alpha[i] * weight(piece) / alpha[j]. It runs over all chunks of a batch at
once: the edges into all nodes lie in one array, ordered by node and cumulative probability, and all chunks step along
their node's edges together until each has met its draw.

A draw is a hash of the seed, the row's key and the place in the text: the same row gives the same pieces on any cluster
and in any batch. The model's scores are merge ranks, so a piece's weight is taken as 1 / (rank + 10) ** theta (Zipf).
Characters outside the vocabulary, and a literal U+2581, become byte pieces; decoding is therefore lossless for any text.

A null or empty text has no pieces and decodes to the empty text. A null key is seeded as the key 0.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship, table

SEED, THETA, KEPT = 2024, 1.0, 6_000_000
CHUNK = r"\n| *[^ \n]+| +"
#: Marks that may start a chunk, where no piece of the model holds them with the character before.
MARKS = ".,;:!?|"
#: Characters that are sampled at once; a batch holds whole texts.
BATCH = 1_000_000


#: Chunks of this length are laid out by array operations, so many characters at a time.
SHORT, AT_ONCE = 40, 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 17
_BELOW_1 = np.float32(1 - 2.0**-24)
_SLOT = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def piece_hash(s: str) -> int:
    h = 0
    for c in s:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
    return h


class Vocabulary:
    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        self.bytes: list[bytes] = []
        rank = 0
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                s = p.replace("▁", " ")
                self.bytes.append(s.encode())
                rank += 1
                found[s] = ((rank + 10.0) ** -theta, i)
        # a mark starts a chunk of its own except after the characters that a piece holds before it: fewer different chunks
        before: dict[str, set[str]] = {c: set() for c in MARKS}
        for s in found:
            for a, b in zip(s, s[1:]):
                if b in before:
                    before[b].add(a)
        marks = {c: "".join(sorted(x)) for c, x in before.items() if not any(map(str.isalpha, x))}
        joined = "".join(rf"|(?<=[{re.escape(x)}]){re.escape(c)}" for c, x in marks.items() if x)
        chunk = rf"\n| *[^ \n](?:[^ \n{re.escape(''.join(marks))}]{joined})*+| +" if marks else CHUNK
        self.cut = re.compile(chunk).findall
        crossing = [s for s in found if self.cut(s) != [s]]
        if crossing:
            raise ValueError(f"pieces across chunks: {crossing[:5]}")
        self.weight = found
        self.longest = max(map(len, self.weight))
        if self.longest > 31:
            raise ValueError(f"a piece of {self.longest} characters")
        # pieces by hash: each lies in one of two slots
        self.hash = np.zeros(1 << SLOTS, np.uint64)
        self.at = np.zeros(1 << SLOTS, np.int32)
        self.p_weight = np.array([x[0] for x in found.values()])
        self.p_id = np.array([x[1] for x in found.values()], np.int32)
        for k, s in enumerate(found):
            h, turn = piece_hash(s), 0
            while h:
                slot = h * _SLOT[turn % 2] % 2**64 >> 64 - SLOTS
                h, k, self.hash[slot], self.at[slot] = int(self.hash[slot]), int(self.at[slot]), h, k
                turn = 1 if h and h * _SLOT[0] % 2**64 >> 64 - SLOTS == slot else 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are a piece's, and these pieces' numbers among the weights."""
        a, b = ((h * np.uint64(m) >> np.uint64(64 - SLOTS)).astype(np.int64) for m in _SLOT)
        in_a = self.hash[a] == h
        hit = np.flatnonzero(in_a | (self.hash[b] == h))
        return hit, self.at[np.where(in_a[hit], a[hit], b[hit])]

    def decode(self, ids) -> str:
        """The text of a list of ids; the space put before it goes."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode()[1:]


def draws(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Uniform numbers below 1 from two arrays of 64-bit integers (splitmix64)."""
    with np.errstate(over="ignore"):
        z = seed + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


def grown(x: np.ndarray, used: int, size: int) -> np.ndarray:
    """x with room for size elements, of which the first used ones count. Memory behind them is not touched, so it isn't taken yet."""
    if size <= len(x):
        return x
    out = np.zeros(max(size, 2 * len(x)), x.dtype)
    out[:used] = x[:used]
    return out


class Lattices:
    """Forward sums and cumulative backward probabilities of the chunks met so far."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self):
        self.base: dict[str, int] = {}
        self.nodes = self.edges = 0
        #: first edge of each node; of each edge the cumulative probability, and 32 * piece + length
        self.first = np.zeros(1 << 15, np.int32)
        self.cum, self.edge = np.zeros(1 << 16, np.float32), np.zeros(1 << 16, np.int32)

    def _append(self, counts, cum, piece, back) -> int:
        """Add nodes with so many edges each; returns the number of the first one."""
        b, e, n, m = self.nodes, self.edges, len(counts), len(cum)
        self.first = grown(self.first, b, b + n)
        self.cum, self.edge = grown(self.cum, e, e + m), grown(self.edge, e, e + m)
        self.first[b : b + n] = e + np.cumsum(counts) - counts
        self.cum[e : e + m] = cum
        self.edge[e : e + m] = np.asarray(piece, np.int32) * 32 + np.asarray(back, np.int32)
        self.nodes, self.edges = b + n, e + m
        return b

    def add(self, s: str) -> int:
        """Place the chunk's nodes 1..len(s) after those that are there. Node b + j stands for its first j characters."""
        v, get, longest = self.v, self.v.weight.get, self.v.longest
        alpha = [1.0] + [0.0] * len(s)
        counts, cum, piece, back = [0], [], [], []
        for j in range(1, len(s) + 1):
            total, edges = 0.0, []
            for i in range(max(0, j - longest), j):
                w = get(s[i:j])
                if w is not None:
                    total += alpha[i] * w[0]
                    edges.append((total, w[1], j - i))
            if get(s[j - 1]) is None:
                c = s[j - 1].encode()
                total += alpha[j - 1] * 1e-6
                edges.append((total, v.byte[c[0]] if len(c) == 1 else -ord(s[j - 1]), 1))
            alpha[j] = total
            for t, p, k in edges:
                cum.append(t / total)
                piece.append(p)
                back.append(k)
            cum[-1] = 1.0
            counts.append(len(edges))
            if total < 1e-200:  # only ratios within a piece's reach count
                for i in range(max(0, j - longest), j + 1):
                    alpha[i] *= 1e200
        b = self.base[s] = self._append(np.array(counts), cum, piece, back)
        return b

    def add_all(self, chunks: list[str]) -> None:
        """The same for many chunks at once: SHORT characters at most by array operations, longer ones one by one."""
        short = [c for c in chunks if len(c) <= SHORT]
        for c in chunks:
            if len(c) > SHORT:
                self.add(c)
        i = 0
        while i < len(short):
            j, n = i, 0
            while j < len(short) and (j == i or n + len(short[j]) <= AT_ONCE):
                n += len(short[j])
                j += 1
            self._add_short(short[i:j])
            i = j

    def _add_short(self, chunks: list[str]) -> None:
        v, longest = self.v, min(self.v.longest, SHORT)
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        char = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(char)
        pos = np.arange(n) - np.repeat(np.cumsum(length) - length, length) + 1  # of each character in its chunk, from 1
        w, ids = np.zeros((n, longest)), np.zeros((n, longest), np.int32)
        h, here = char + np.uint64(1), np.arange(n)
        for k in range(1, longest + 1):  # the piece of k characters that ends here
            if k > 1:
                h = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) * _BASE + char + np.uint64(1)
                here = here[pos[here] >= k]
            hit, which = v.find(h[here])
            w[here[hit], longest - k], ids[here[hit], longest - k] = v.p_weight[which], v.p_id[which]
        lone = w[:, -1] == 0
        w[lone, -1] = 1e-6
        c = char[lone].astype(np.int64)
        ids[lone, -1] = np.where(c < 128, np.array(v.byte)[np.minimum(c, 127)], -c)
        alpha, back = np.ones(n + longest), np.arange(longest, 0, -1)
        order = np.argsort(pos, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(pos)[1:])])
        for j in range(1, len(edges)):  # alpha of the node after character p lies at p + longest; before a chunk it is 1
            sel = order[edges[j - 1] : edges[j]]
            own = w[sel]
            cols = np.arange(max(0, longest - j + 1), longest)  # pieces that don't begin the chunk
            own[:, cols] *= alpha[sel[:, None] + cols]
            w[sel] = own
            alpha[sel + longest] = own.sum(1)
        there = w > 0
        cum = np.cumsum(w, axis=1, out=w)
        cum /= cum[:, -1:].copy()
        cum[:, -1] = 1.0
        counts = np.zeros(n + len(chunks), np.int64)
        counts[np.arange(n) + np.repeat(np.arange(len(chunks)), length) + 1] = there.sum(1)
        b = self._append(counts, cum[there], ids[there], np.broadcast_to(back, w.shape)[there])
        self.base.update(zip(chunks, (b + np.cumsum(length + 1) - length - 1).tolist()))


def row_seed(key, seed: int = SEED) -> int:
    return zlib.crc32(str(0 if key is None else key).encode()) << 32 | (seed & 0xFFFFFFFF)


class Sampler:
    def __init__(self, path: str, seed: int = SEED, theta: float = THETA):
        self.v = Vocabulary(path, theta)
        self.lattices = Lattices(self.v)
        self.cut = self.v.cut
        self.seed = seed

    def __call__(self, keys: list, texts: list[str]) -> list[np.ndarray]:
        """Sampled piece ids of each text."""
        lat = self.lattices
        if lat.nodes > KEPT:
            lat.clear()
        chunks, per = [], []
        for t in texts:
            c = self.cut(" " + t) if t else []
            chunks += c
            per.append(len(c))
        if not chunks:
            return [np.zeros(0, np.int32) for _ in texts]
        base = list(map(lat.base.get, chunks))
        if None in base:
            lat.add_all(list(dict.fromkeys(c for c, b in zip(chunks, base) if b is None)))
            base = list(map(lat.base.__getitem__, chunks))
        first, cum, edge = lat.first, lat.cum, lat.edge
        base = np.array(base, np.int64)
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.cumsum(length) - length  # in characters of the whole batch
        owner = np.repeat(np.arange(len(texts)), per)
        chars = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        text_start = np.cumsum(chars) - chars
        seeds = np.array([row_seed(k, self.seed) for k in keys], np.uint64)[owner]
        place = (start - text_start[owner]).astype(np.uint64)
        out = np.full(int(chars.sum()), -(2**31), np.int32)  # a piece lies at its last character's place
        pos = length.copy()
        while len(pos):
            e, u = first[base + pos], np.minimum(draws(seeds, place + pos.astype(np.uint64)).astype(np.float32), _BELOW_1)
            step = np.flatnonzero(cum[e] <= u)
            while len(step):  # the last edge of a node has 1
                e[step] += 1
                step = step[cum[e[step]] <= u[step]]
            e = edge[e]
            out[start + pos - 1] = e >> 5
            pos = pos - (e & 31)
            go = pos > 0
            base, pos, start, seeds, place = base[go], pos[go], start[go], seeds[go], place[go]
        there = out > -(2**31)
        ends = np.concatenate([[0], np.cumsum(there)])
        ids = out[there]
        result = [ids[ends[a] : ends[a + n]] for a, n in zip(text_start.tolist(), chars.tolist())]
        if len(ids) and ids.min() < 0:
            result = [self._bytes(r) if len(r) and r.min() < 0 else r for r in result]
        return result

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Negative entries stand for characters of several bytes."""
        parts, last = [], 0
        for k in np.flatnonzero(ids < 0).tolist():
            parts += [ids[last:k], np.array([self.v.byte[c] for c in chr(-int(ids[k])).encode()], np.int32)]
            last = k + 1
        return np.concatenate([*parts, ids[last:]])


def sampler(*args) -> Sampler:
    """One per worker process, so that the chunks met by one task serve the next."""
    return kept(Sampler, *args)


def stretches(batch, most: int = BATCH):
    """(keys, texts) of consecutive rows of an Arrow batch, null texts as empty ones: at most `most` characters together, or one
    row. Only these rows are Python strings at a time."""
    import pyarrow.compute as pc

    a, n = 0, 0
    lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
    part = lambda a, b: (batch.column(0)[a:b].to_pylist(), [t or "" for t in batch.column(1)[a:b].to_pylist()])
    for b, k in enumerate(lengths):
        if b > a and n + k > most:
            yield part(a, b)
            a, n = b, 0
        n += k
    if a < len(lengths):
        yield part(a, len(lengths))


def encoded(docs: DataFrame, model: str, seed: int = SEED, theta: float = THETA) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (array of int), the sampled segmentation of each whole text."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        s = sampler(model, seed, theta)
        for b in batches:
            for keys, texts in stretches(b):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(s(keys, texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """doc_id, ids -> doc_id, text. Null ids are the empty text."""
    ship(ids.sparkSession)

    def run(batches):
        import pyarrow as pa

        v = Vocabulary(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.decode(x.as_py() or []) for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digested(docs: DataFrame, model: str, seed: int = SEED, theta: float = THETA) -> DataFrame:
    """Encode and decode: doc_id, n_chars, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), lossless."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        s = sampler(model, seed, theta)
        for b in batches:
            for keys, texts in stretches(b):
                ids = s(keys, texts)
                same = [s.v.decode(x.tolist()) == t for x, t in zip(ids, texts)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                cols = [pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "n_pieces", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_crc32 long, lossless boolean")


def op3_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return digested(table(spark, sf_dir, "documents", "doc_id", "text"), path("piece_bpe_32k.model"))
