"""Token ids in binary shards with Elias-Fano document boundaries.

A shard file holds consecutive documents in ascending doc_id order:

    magic TRLEF001 | u32 id width | u32 lengths' count of null doc_ids | u64 documents | u64 ids
    u64 size of the boundary structure | boundaries | doc_ids (i64 each) | ids (u16 or u32, little-endian)

Boundaries are the end offsets of the documents, a non-decreasing list, kept as Elias-Fano: the low bits packed, the
high bits as a unary bit vector, and the place of every 512th one for select. Offset i is found without decoding more
than one stretch of the bit vector. The documents before a shard are added from the shards' own totals.

Documents are range-partitioned by doc_id, so shards ascend as their numbers do. Null doc_ids come first. Rows with the
same doc_id lie side by side, ordered by text. A null or empty text is the end id alone. An empty table has no shards.
A task writes its file under a private name and renames it, with the same bytes whenever it is run again.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, open_fs, put_file, release, ship, table, work_dir

MAGIC = b"TRLEF001"
HEAD = "<8sIIQQQ"
END_ID = 2
#: Pieces kept with their ids per worker; the store is emptied beyond it, so memory is bounded.
KEPT = 500_000
SAMPLE = 512
#: Ids of a file; bytes of text that are encoded at once; words whose ids are put together at once.
SHARD_IDS, SLICE, STRETCH = 64 << 20, 4 << 20, 250_000


class EliasFano:
    """A non-decreasing list of integers below `universe`, about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        lb = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(lb, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if lb else np.zeros((n, 0), np.uint8)
        at = (v >> np.uint64(lb)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) + 1 if n else 0), np.uint8)
        high[at] = 1
        return cls(n, lb, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.ones)) + self.low.tobytes() + self.high.tobytes() + self.ones.tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> EliasFano:
        n, lb, nl, nh, no = struct.unpack_from("<QIIII", b)
        at = struct.calcsize("<QIIII")
        low = np.frombuffer(b, np.uint8, nl, at)
        high = np.frombuffer(b, np.uint8, nh, at + nl)
        return cls(n, lb, low, high, np.frombuffer(b, "<u4", no, at + nl + nh))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1)

    def select(self, i: int) -> int:
        """Value i: scans the bit vector from the nearest kept one, at most SAMPLE ones away."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.ones[i // SAMPLE])
        end = int(self.ones[i // SAMPLE + 1]) if i // SAMPLE + 1 < len(self.ones) else len(self.high) * 8
        first = start >> 3
        bits = np.unpackbits(self.high[first : (end >> 3) + 1], bitorder="little")
        bits[: start & 7] = 0
        at = int(np.flatnonzero(bits)[i % SAMPLE]) + first * 8
        return ((at - i) << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)


#: The character that byte-level BPE writes for each byte.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) if b in _SHOWN else chr(256 + k) for b, k in [(b, 0) for b in _SHOWN] + [(b, k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)]}

#: A word that stands between others when many are encoded at once.
MARK = "\x02"
#: Words of characters that NFC leaves alone and that are lower-cased one by one: ASCII and European Latin letters and signs.
EASY = "[!-~\u00a1-\u012f\u0131-\u017f]*"


class BatchEncoder:
    """Ids of whole texts by the tokenizers library.

    Where the tokenizer joins nothing across ASCII white space and drops it, a text's ids are its words' ids in turn. Texts
    are then split, their words told apart and cut in pieces by Arrow, by the pattern in the tokenizer's own file; only new
    pieces go to its model, and are kept. That holds for words of EASY characters and where the file is of the form that
    `_pattern` knows; other new words go to the library together, with MARK between them. Whether the tokenizer is of either
    kind is tried out at the start, on every EASY character; if it isn't, and for texts that hold the start of a special
    token, texts go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        self.special = sorted({t.content for t in self.tk.get_added_tokens_decoder().values()})
        self.dtype = np.dtype("<u2" if self.tk.get_vocab_size() < 65536 else "<u4")
        self.clear()
        self.cut = self._pattern()
        self.by_word = self._tried()
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tk.encode(text, add_special_tokens=False).ids

    def _pattern(self) -> str | None:
        """What pieces of words are, for byte-level BPE after lower-casing and one splitting pattern."""
        d = json.loads(self.tk.to_str())
        norm, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in norm.get("normalizers", [])]
        split = pre.get("pretokenizers", [])
        if set(steps) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in steps and [x.get("type") for x in split] == ["Split", "ByteLevel"]:
            if split[0].get("behavior") == "Removed" and split[0].get("invert") and not split[1].get("use_regex") and not split[1].get("add_prefix_space"):
                pattern = split[0]["pattern"].get("Regex")
                if pattern:
                    self.cut_any = regex.compile(pattern).findall
                return pattern
        return None

    def _others(self, words: list[str]) -> list[list[int]] | None:
        """Ids of words that hold other than EASY characters; None where normalizing them joins or parts words."""
        normal = self.tk.normalizer.normalize_str(" ".join(words)).split(" ")
        return [[k for p in self.cut_any(w) for k in self._piece(p)] for w in normal] if len(normal) == len(words) else None

    def _piece(self, p: str) -> list[int]:
        return [t.id for t in self.tk.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(BYTES))]

    def _tried(self) -> bool:
        import pyarrow as pa

        words = ["The", "cat's", "e\u0301t\u00e9", "\u0301x", "12,5", "don't", "\U0001f600!", "'s", "a\u00a0b", "STRASSE", "\u4e2d\u6587"]
        apart = [self._ids(w) for w in words]
        mark = self._ids(MARK)
        joined = [sum(apart, []), sum((x + mark for x in apart), [])]
        if self.cut:
            plain = ["The", "cat's", "12,5", "don't", "'s", "I'LL", "'\"s", "STRASSE", "a1B2--c''ll", "(x)", "#!9", "na\u00efve's", "\u00c0\u00c9", "anticonstitutionnellement"]
            plain += [f"{c}a{c}{c}b1{c}" for c in map(chr, range(33, 0x180)) if re.fullmatch(EASY, c)]
            others = [*words, "\u01c5", "\u0130x", "\ufb01", "\x85", "\u2014a"]
            try:
                at, ends = self._cut(pa.array(plain))
                found = [[k for e in at[i:j] for k in self._entry(e)] for i, j in itertools.pairwise([0, *ends])]
            except pa.ArrowInvalid:  # Arrow doesn't know the pattern's syntax
                found = None
            if found != [self._ids(w) for w in plain] or any((self._others([w]) or [self._ids(w)]) != [self._ids(w)] for w in others):
                self.cut = None
        return len(mark) == 1 and mark[0] not in sum(apart, []) and [self._ids(" \n".join(["", *words, ""])), self._ids(f" {MARK} ".join([*words, ""]))] == joined

    def clear(self):
        self.number: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.start, self.length, self.flat, self.n, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, self.dtype), 0, 0

    def _keep(self, lengths: np.ndarray, ids: np.ndarray) -> int:
        """Add entries; returns the number of the first one."""
        a, n, m = self.n, len(lengths), len(ids)
        while a + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.size + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[a : a + n] = self.size + np.cumsum(lengths) - lengths
        self.length[a : a + n] = lengths
        self.flat[self.size : self.size + m] = ids
        self.n, self.size = a + n, self.size + m
        return a

    def _keep_all(self, store: dict[str, int], names: list[str], found: list[list[int]]) -> None:
        first = self._keep(np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(itertools.chain.from_iterable(found), np.int64))
        store.update(zip(names, range(first, first + len(found))))

    def _entry(self, k: int) -> list[int]:
        return self.flat[self.start[k] : self.start[k] + self.length[k]].tolist()

    def _learn(self, words: list[str]) -> None:
        if self.cut:
            for i in range(0, len(words), 500):
                part = words[i : i + 500]
                found = self._others(part)
                if found is not None:
                    self._keep_all(self.number, part, found)
            words = [w for w in words if w not in self.number]
        plain = [w for w in words if MARK not in w]
        for i in range(0, len(plain), 5000):
            part = plain[i : i + 5000]
            ids = np.array(self._ids(f" {MARK} ".join([*part, ""])), np.int64)
            ends = np.flatnonzero(ids == self._mark())
            if len(ends) != len(part):
                raise ValueError("the tokenizer gives the mark for other words too")
            first = self._keep(np.diff(ends, prepend=-1) - 1, np.delete(ids, ends))
            self.number.update(zip(part, range(first, first + len(part))))
        for w in words:
            if MARK in w:
                ids = self._ids(w)
                self.number[w] = self._keep(np.array([len(ids)]), np.array(ids, np.int64))

    def _mark(self) -> int:
        return self._ids(MARK)[0]

    def _numbers(self, store: dict[str, int], names: list[str], learn) -> np.ndarray:
        number = list(map(store.get, names))
        if None in number:
            learn([w for w, k in zip(names, number) if k is None])
            number = list(map(store.__getitem__, names))
        return np.array(number, np.int32)

    def _cut(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Words of EASY characters -> entries of their pieces, and where each word's end. Runs of letters are one piece."""
        import pyarrow as pa
        import pyarrow.compute as pc

        low = pc.utf8_lower(words)
        more = pc.invert(pc.match_substring_regex(low, r"^\p{L}*$"))
        low = pc.replace_with_mask(low, more, pc.replace_substring_regex(low.filter(more), f"({self.cut})", r"\1 "))
        split = pc.ascii_split_whitespace(low)
        pieces = split.flatten().dictionary_encode()
        number = self._numbers(self.pieces, pieces.dictionary.to_pylist(), lambda new: self._keep_all(self.pieces, new, list(map(self._piece, new))))
        ends = split.offsets.to_numpy()
        return number[pieces.indices.to_numpy()], ends[1:] - ends[0]

    def _entries(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Different words -> entries that make up each, and where each word's end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.cut:
            return self._numbers(self.number, words.to_pylist(), self._learn), np.arange(1, len(words) + 1)
        easy = pc.match_substring_regex(words, f"^(?:{EASY})$")
        hard = ~easy.to_numpy(zero_copy_only=False)
        at, ends = self._cut(pc.if_else(easy, words, pa.scalar("", words.type)) if hard.any() else words)
        if hard.any():  # the empty word stands for it, as one empty piece
            at[ends[hard] - 1] = self._numbers(self.number, words.filter(pa.array(hard)).to_pylist(), self._learn)
        return at, ends

    def __call__(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """An Arrow array of texts without nulls -> all ids, each text's followed by end_id, and how many each text has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.n > KEPT or self.size > 8 * KEPT:
            self.clear()
        whole = np.ones(len(texts), bool)
        if self.by_word:
            whole[:] = False
            for s in self.special:
                whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        rest = texts
        if whole.any():
            rest = pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts)
        split = pc.ascii_split_whitespace(rest)
        ends = split.offsets.to_numpy()
        ends = ends[1:] - ends[0]
        words = split.flatten().dictionary_encode()
        del split, rest
        entries, upto = self._entries(words.dictionary)
        ids = gathered(self.flat, self.start, self.length, entries)
        upto = np.concatenate([[0], np.cumsum(self.length[entries], dtype=np.int64)])[np.concatenate([[0], upto])]
        # entries of this call: its different words, the end, texts that went to the library whole
        found = [self._ids(texts[int(k)].as_py()) for k in np.flatnonzero(whole)]
        length = np.concatenate([np.diff(upto), [1], list(map(len, found))]).astype(np.int32)
        ids = np.concatenate([ids, np.array([end_id], self.dtype), *(np.array(x, self.dtype) for x in found)])
        start, end = np.cumsum(length, dtype=np.int32) - length, len(words.dictionary)
        at, each, out = words.indices.to_numpy(), np.zeros(len(texts), np.int64), []
        del words
        i = n = 0
        while i < len(texts):  # a stretch of words at a time
            a = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, a + STRETCH, "right")))
            own, last = at[a : ends[j - 1]], ends[i:j] - a
            if whole[i:j].any():
                here = whole[i:j]
                own = np.insert(own, last[here], np.arange(end + 1 + n, end + 1 + n + here.sum()))
                last, n = last + np.cumsum(here), n + int(here.sum())
            own = np.insert(own, last, end)
            last = last + np.arange(1, j - i + 1)
            each[i:j] = np.diff(np.concatenate([[0], np.cumsum(length[own], dtype=np.int64)])[last], prepend=0)
            out.append(gathered(ids, start, length, own))
            i = j
        return np.concatenate(out) if out else np.zeros(0, self.dtype), each


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stretches of flat that the numbers in `at` stand for, one after the other."""
    n = length[at]
    upto = np.cumsum(n)
    return flat[np.repeat(start[at] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]


def write_shards(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None, most: int = SHARD_IDS) -> list[dict]:
    """Encode docs (doc_id, text) into shard files below uri. Returns a row per shard: shard, part, path, docs, ids.

    shards: ranges of doc_id, by default one per shuffle partition. A task starts another file once one holds `most` ids,
    so it never holds more than that and one slice of rows.
    """
    ship(docs.sparkSession)
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = kept(BatchEncoder, tokenizer)
        shard = TaskContext.get().partitionId()
        made, doc_ids, counts, chunks, total, nulls = [], [], [], [], 0, 0

        def flush():
            ends = np.cumsum(np.concatenate(counts))
            ef = EliasFano.of(ends.astype(np.uint64)).to_bytes()
            head = struct.pack(HEAD, MAGIC, encode.dtype.itemsize, nulls, len(ends), total, len(ef))
            path = f"{uri}/shard-{shard:06d}-{len(made):04d}.ids"
            put_file(path, [head, ef, np.concatenate(doc_ids).astype("<i8").tobytes(), *chunks])
            made.append((shard, len(made), path, len(ends), total))

        for b in batches:
            for i, j in of_size(b.column(1), SLICE):
                who = b.column(0).slice(i, j - i)
                ids, each = encode(b.column(1).slice(i, j - i), end_id)
                nulls += who.null_count
                doc_ids.append(who.fill_null(0).to_numpy())
                counts.append(each)
                chunks.append(ids.tobytes())
                total += len(ids)
                if total >= most:
                    flush()
                    doc_ids, counts, chunks, total, nulls = [], [], [], 0, 0
        if counts:
            flush()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made) if made else [[]] * 5, kinds)], ["shard", "part", "path", "docs", "ids"])

    rows = d.mapInArrow(write, "shard long, part long, path string, docs long, ids long").collect()  # one row per `most` ids
    return [r.asDict() for r in sorted(rows, key=lambda r: (r["shard"], r["part"]))]


def of_size(texts, most: int):
    """Ranges of rows of at most `most` bytes together, or one row."""
    import pyarrow.compute as pc

    n, i, sum_ = pc.binary_length(texts).to_pylist(), 0, 0
    for j, k in enumerate(n):
        if j > i and sum_ + k > most:
            yield i, j
            i, sum_ = j, 0
        sum_ += k
    if i < len(n):
        yield i, len(n)


class Shard:
    """One file, read by ranges: document i's ids without the ids of the others."""

    def __init__(self, path: str):
        fs, at = open_fs(path)
        self.file = fs.open_input_file(at)
        magic, self.width, self.nulls, self.docs, self.total, size = struct.unpack(HEAD, self.file.read(struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError(f"{path}: not a shard file")
        self.ends = EliasFano.from_bytes(self.file.read(size))
        self.doc_ids = np.frombuffer(self.file.read(8 * self.docs), "<i8")
        self.start = struct.calcsize(HEAD) + size + 8 * self.docs

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from offset a to b of the shard's id array."""
        self.file.seek(self.start + a * self.width)
        return np.frombuffer(self.file.read((b - a) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))


def read_shards(spark, shards: list[dict]) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32. Ids are read in stretches of 2 MB or one document."""
    rows, before = [], 0
    for s in shards:
        rows.append((s["path"], before))
        before += s["ids"]
    ship(spark)
    d = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)), "path")

    def read(batches):
        import pyarrow as pa

        release()  # the write's store, in a worker that goes on to read
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(path)
                ends = s.ends.all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                i = 0
                while i < s.docs:
                    j = max(i + 1, int(np.searchsorted(ends, starts[i] + 1_000_000, "right")))
                    ids, a = s.ids(int(starts[i]), int(ends[j - 1])), int(starts[i])
                    crc = [zlib.crc32(ids[x - a : y - a].astype("<u4").tobytes()) for x, y in zip(starts[i:j].tolist(), ends[i:j].tolist())]
                    who = pa.array(s.doc_ids[i:j], pa.int64(), mask=np.arange(i, j) < s.nulls)
                    yield pa.RecordBatch.from_arrays([who, pa.array(starts[i:j] + before), pa.array(ends[i:j] - starts[i:j]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    i = j

    return d.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    shards = write_shards(table(spark, sf_dir, "documents", "doc_id", "text"), work_dir(spark, "tokens"), path("word_bpe_49k.json"))
    return read_shards(spark, shards)
