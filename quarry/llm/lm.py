"""Language-model scoring with an Elias-Fano n-gram trie.

The model merges the counts of contexts of 1 to ``order`` - 1 words, longer ones ``LIFT``
times as much each (c(g): occurrences of the word sequence g in training texts):

    P(w | u v) = (LIFT c(u v w) + c(v w) + MU p(w)) / (LIFT c(u v) + c(v) + MU)
    p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

here for order 3, over words and one end token; texts begin after start tokens. It sums to
one for every context, seen or not. In logarithms it splits into a part that belongs to the
token and its predecessors (numerator) and a part that belongs to a sequence as the context
of what follows (denominator). Both are found below the sequence's last word, so a text's
score is a sum of independent lookups, and each token travels once, whatever the order.

1. A first pass counts the words: V, N, and the hot words, those of more than a quarter of
   a shard's tokens; a second one counts sequences of hot words and finds the hot ones by the
   same bound. There are at most four of any length per shard; they are broadcast with their
   counts, so nothing that a large part of the corpus holds is shuffled to one place.
2. A third pass cuts the documents into chunks. For each shard of the trie a chunk sends one
   packed row: its distinct words, below each word its distinct predecessors (32-bit
   hashes), below those their predecessors, and so on, and last the documents and counts.
   Rows are dealt by word, those of hot words by word and predecessor, those of hot pairs by
   three words; the number of shards follows the number of tokens. Training counts and
   queries travel in the same rows.
3. A shard builds its part of the trie from the training counts: level one the words, then
   the predecessors seen before each (a reversed trie). Words, counts and the pointers to the
   children are Elias-Fano coded; their high bits stay packed, with one directory number per
   64 bits. A child is 32 bits below its pointer, with a 16-bit code of its smoothed log
   numerator and, on inner levels, one of its log denominator. The levels are written to one
   file and memory-mapped; a query searches the successor of its predecessor's hash between
   the two pointers of its context.
4. Lookups are summed per document inside the shard; only these sums return, and are
   added up chunk by chunk as they stream in.

Quantisation moves a token's log10 probability by at most ``STEP / 2``, by ``STEP`` above
order 2. Hash collisions merge two words (64 bits) or two predecessors of one context (32
bits; a context has at most 2 million in a shard, mostly some).

Null texts are empty texts, which consist of their end token. Repeated rows are scored each
and, if they are training rows, counted each. Without training rows N = V = 0, and every
token gets the uniform share. Empty tables give empty results.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship_package
from .common import blobs, col, staged

MU = 2.0
#: Weight of a context's counts against those of the context shorter by one word.
LIFT = 64.0
#: Tokens of one shard and text bytes of one chunk.
SHARD_TOKENS = 2_000_000
CHUNK_BYTES = 6 << 20
#: 16-bit codes of log10 values.
LOWEST, STEP = -14.0, 26 / 65535

START, END = 1, 2
CHILD_BYTES = 4
_CHILD = np.uint64((1 << 8 * CHILD_BYTES) - 1)


def tokens_of(texts: list[bytes], order: int = 2):
    """(paths, text numbers) of all tokens: 64-bit hashes of the words, then of the words
    1 to ``order`` - 1 places before them."""
    xx = xxhash.xxh64_intdigest
    parts, sizes = [], []
    for text in texts:
        words = text.lower().split()  # bytes: A-Z only, ASCII blanks only
        h = np.empty(len(words) + 1, dtype=np.uint64)
        h[:-1] = np.fromiter(map(xx, words), dtype=np.uint64, count=len(words))
        h[-1] = END
        parts.append(h)
        sizes.append(len(h))
    paths = [np.concatenate(parts)]
    first = np.cumsum([0, *sizes[:-1]])
    for _ in range(order - 1):
        v = np.r_[np.uint64(START), paths[-1][:-1]]
        v[first] = START
        paths.append(v)
    return paths, np.repeat(np.arange(len(texts)), sizes)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(32)


#: Place of the r-th set bit of every byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], dtype=np.int64)


class EliasFano:
    """A monotone sequence below 2**64: low bits in whole bytes, high bits in unary.

    The buffers may be views of a mapped file and stay as they are; beside them lies a
    directory of the ones (from the file) and of the zeros before every 64 high bits.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.width = n, np.uint64(low_bits), (low_bits + 7) // 8
        self.mask = np.uint64((1 << low_bits) - 1)
        # numbers of 8 bytes at every byte; the buffer has 8 bytes to spare
        self.low = np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
        self.high, self.ones = high.reshape(-1, 8), ones
        self.window = np.ndarray((max(0, len(high) - 7),), dtype="<u8", buffer=high, strides=(1,))
        self.zeros = 64 * np.arange(len(ones)) - ones

    def select(self, r: np.ndarray, one: bool) -> np.ndarray:
        """Places of the r-th ones or zeros of the high bits."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, r, side="right") - 1
        at = self.high[word] if one else ~self.high[word]
        total = np.cumsum(np.bitwise_count(at), axis=1, dtype=np.int64)
        left = r - before[word]
        byte = (total <= left[:, None]).sum(axis=1)
        row = np.arange(len(r))
        left -= np.where(byte > 0, total[row, byte - 1], 0)
        return 64 * word + 8 * byte + _IN_BYTE[at[row, byte], left]

    def start(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``h``."""
        out = np.where(h > 0, self.n, 0)
        known = np.flatnonzero((h > 0) & (h <= 64 * len(self.ones) - self.n))
        z = h[known] - 1
        out[known] = self.select(z, False) - z
        return out

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        width = (low_bits + 7) // 8
        low = (values & np.uint64((1 << low_bits) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes()
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(place[-1]) // 64 + 2) * 64 if n else 0, dtype=np.uint8)  # 64 to spare
        bits[place] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.cumsum(np.bitwise_count(high).reshape(-1, 8).sum(axis=1, dtype=np.int64))
        ones = np.r_[0, ones[:-1]].astype("<u4").tobytes() if n else b""
        low += bytes(8)
        return struct.pack("<QQQQQ", n, low_bits, len(low), len(high), len(ones)) + low + high.tobytes() + ones

    @classmethod
    def read(cls, buf: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, low_bits, nl, nh, no = struct.unpack("<QQQQQ", buf[at:at + 40].tobytes())
        at += 40
        ones = np.frombuffer(buf, "<u4", no // 4, at + nl + nh)
        return cls(n, low_bits, buf[at:at + nl], buf[at + nl:at + nl + nh], ones), at + nl + nh + no

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        top = (self.select(i, True) - i).astype(np.uint64)
        return top << self.bits | (self.low[i * self.width] & self.mask)

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places ``i`` and ``i + 1``: the next one is mostly within the next bits."""
        place = self.select(i, True)
        after = place + 1
        x = self.window[np.minimum(after >> 3, len(self.window) - 1)] >> (after & 7).astype(np.uint64)
        zeros = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = np.flatnonzero((x == 0) | (after >> 3 >= len(self.window)))
        after += zeros
        after[far] = self.select(i[far] + 1, True)
        return tuple((at - j).astype(np.uint64) << self.bits | (self.low[j * self.width] & self.mask)
                     for at, j in ((place, i), (after, i + 1)))

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of ``x``, -1 where it is missing: its successor must be itself."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n:
            return out
        h = np.minimum(x >> self.bits, np.uint64(64 * len(self.ones))).astype(np.int64)
        # the values that share the high part stand in [lo, end)
        lo, end = self.start(h), self.start(h + 1)
        want = x & self.mask
        at = successor(lambda i: self.low[i * self.width] & self.mask, lo, end, want)
        hit = np.flatnonzero(at < end)
        hit = hit[(self.low[at[hit] * self.width] & self.mask) == want[hit]]
        out[hit] = at[hit]
        return out


def successor(value, lo: np.ndarray, end: np.ndarray, want: np.ndarray) -> np.ndarray:
    """First place in each [lo, end) whose ``value`` isn't below ``want``."""
    lo, hi = lo.copy(), end.copy()
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        less = value(mid) < want[todo]
        lo[todo[less]] = mid[less] + 1
        hi[todo[~less]] = mid[~less]
        todo = todo[lo[todo] < hi[todo]]
    return lo


def coded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((np.log10(x) - LOWEST) / STEP), 0, 65535).astype("<u2")


class Trie:
    """Words, the predecessors seen before each, theirs, and codes of log probabilities."""

    def __init__(self, buf: np.ndarray):
        depth, self.n, self.v = struct.unpack("<QQQ", buf[:24].tobytes())
        self.words, at = EliasFano.read(buf, 24)
        self.counts, at = EliasFano.read(buf, at)
        self.levels = []
        for k in range(1, depth):
            pointers, at = EliasFano.read(buf, at)
            m = int(pointers.get(np.array([pointers.n - 1]))[0])
            size = [4, 2, 2 if k + 1 < depth else 0]  # children, numerators, denominators
            ends = at + m * np.cumsum([0, *size])
            self.levels.append((pointers, buf[at:ends[1]].view("<u4"), buf[ends[1]:ends[2]].view("<u2"),
                                buf[ends[2]:ends[3]].view("<u2")))
            at = int(ends[3])

    @staticmethod
    def encode(paths: list[np.ndarray], first: list[np.ndarray], counts: list[np.ndarray], n: int, distinct: int) -> bytes:
        """From sorted distinct paths; per level the first path of every node and its count."""
        word = counts[0].astype(np.float64)
        top, low = MU * unigram(word, n, distinct), MU + word
        out = [struct.pack("<QQQ", len(paths), n, distinct), EliasFano.encode(paths[0][first[0]]),
               EliasFano.encode(np.r_[0, np.cumsum(counts[0])].astype(np.uint64))]
        for k in range(1, len(paths)):
            pointers = np.r_[np.searchsorted(first[k], first[k - 1]), len(first[k])]
            of = np.repeat(np.arange(len(first[k - 1])), np.diff(pointers))
            top = top[of] + LIFT ** (k - 1) * counts[k]
            low = low[of] + LIFT ** k * counts[k]
            out += [EliasFano.encode(pointers.astype(np.uint64)), paths[k][first[k]].astype("<u4").tobytes(), coded(top).tobytes()]
            if k + 1 < len(paths):
                out.append(coded(low).tobytes())
        return b"".join(out)

    def word(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, count) of each word."""
        node = self.words.find(w)
        if not self.words.n:
            return node, np.zeros(len(w))
        known = np.maximum(node, 0)
        before, to = self.counts.both(known)
        count = (to - before).astype(np.float64)
        return node, np.where(node >= 0, count, 0.0)

    def child(self, k: int, node: np.ndarray, n_child: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Nodes of level ``k`` for predecessors ``v``, ``n_child`` below each node; -1: unseen."""
        pointers, children = self.levels[k - 1][:2]
        out = np.full(len(v), -1, dtype=np.int64)
        lo, end = np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=np.int64)
        known = np.flatnonzero(node >= 0)
        if not len(known):
            return out
        lo[known], end[known] = pointers.both(node[known])
        lo, end, want = np.repeat(lo, n_child), np.repeat(end, n_child), v.astype(np.uint32)
        at = successor(lambda i: children[i], lo, end, want)
        hit = np.flatnonzero(at < end)
        hit = hit[children[at[hit]] == want[hit]]
        out[hit] = at[hit]
        return out

    def score(self, word: np.ndarray, count: np.ndarray, node: np.ndarray, n_child: list, children: list) -> np.ndarray:
        """log10 of numerator over denominator for every path of a row."""
        top = np.log10(MU * unigram(count, self.n, self.v))
        low = np.where(word == END, 0.0, np.log10(count + MU))
        ends = word == END
        for k, (n, v) in enumerate(zip(n_child, children, strict=True), 1):
            node = self.child(k, node, n, v)
            top, low, ends = np.repeat(top, n), np.repeat(low, n), np.repeat(ends, n)
            seen = np.flatnonzero(node >= 0)
            _, _, tops, lows = self.levels[k - 1]
            top[seen] = LOWEST + STEP * tops[node[seen]]
            if k < len(n_child):
                low[seen] = np.where(ends[seen], 0.0, LOWEST + STEP * lows[node[seen]])
        return top - low


def unigram(count, n: int, distinct: int):
    return (count + 0.5) / (n + 0.5 * (distinct + 1))


def mapped(blob: bytes) -> np.ndarray:
    """The bytes as a memory map of an unnamed file that goes with the map."""
    with tempfile.TemporaryFile() as f:
        f.write(blob)
        f.flush()
        return np.frombuffer(mmap.mmap(f.fileno(), len(blob), access=mmap.ACCESS_READ), dtype=np.uint8)


def text_chunks(batches, max_bytes: int = CHUNK_BYTES, most: int = 60_000):
    """(ids as Arrow array, train flags, texts) of about ``max_bytes`` of text, across batches."""
    ids, train, texts, held = [], [], [], 0
    for b in batches:
        data = blobs(b.column(2))
        at = 0
        for i, t in enumerate(data):
            held += len(t)
            if held >= max_bytes or len(texts) + i + 1 - at >= most:
                ids.append(b.column(0).slice(at, i + 1 - at))
                train.append(np.asarray(b.column(1).slice(at, i + 1 - at)))
                yield pa.concat_arrays(ids), np.concatenate(train), texts + data[at:i + 1]
                ids, train, texts, held, at = [], [], [], 0, i + 1
        ids.append(b.column(0).slice(at))
        train.append(np.asarray(b.column(1).slice(at)))
        texts += data[at:]
    if texts:
        yield pa.concat_arrays(ids), np.concatenate(train), texts


def _counts(keys: np.ndarray, train: np.ndarray):
    """(distinct keys, training count, count)."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, train, len(found)).astype(np.int64), np.bincount(at, minlength=len(found))


COUNTS = "h long, n_train long, n_all long"


def count_words(rows: DataFrame) -> DataFrame:
    """(h, n_train, n_all) of every word of (id, train, text) rows."""
    def run(batches):
        for _, train, texts in text_chunks(batches, 3 * CHUNK_BYTES):
            (w,), doc = tokens_of(texts, 1)
            h, a, b = _counts(w, train[doc])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), a, b)], names=["h", "n_train", "n_all"])

    return rows.mapInArrow(run, COUNTS).groupBy("h").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def places(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each value in a sorted array, -1 where it is missing."""
    if not len(sorted_):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def path_keys(paths: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the paths' beginnings of every length; predecessors are child hashes."""
    keys = [mix(paths[0])]
    for v in paths[1:]:
        keys.append(mix(keys[-1] + mix(v)))
    return keys


def count_hot_paths(rows: DataFrame, hot: np.ndarray, order: int) -> DataFrame:
    """(level, h, n_train, n_all) of the sequences of hot words; h: their path key."""
    sent = rows.sparkSession.sparkContext.broadcast((hot, np.sort(np.append(hot, np.uint64(START)))))

    def run(batches):
        words, contexts = sent.value
        for _, train, texts in text_chunks(batches, 3 * CHUNK_BYTES):
            paths, doc = tokens_of(texts, order)
            here = np.flatnonzero(places(words, paths[0]) >= 0)
            paths, doc = [x[here] for x in paths], doc[here]
            keys = mix(paths[0])
            for k in range(1, order):
                here = np.flatnonzero(places(contexts, paths[k]) >= 0)
                paths, doc = [x[here] for x in paths], doc[here]
                keys = mix(keys[here] + mix(child_hash(paths[k])))
                h, a, b = _counts(keys, train[doc])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k)), pa.array(h.view(np.int64)), pa.array(a), pa.array(b)],
                                                 names=["level", "h", "n_train", "n_all"])

    return rows.mapInArrow(run, "level long, " + COUNTS).groupBy("level", "h").agg(
        F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def hot_arrays(got) -> tuple[np.ndarray, np.ndarray]:
    """(keys, training counts) of (h, n_train) rows, sorted by key."""
    keys = np.array([r["h"] for r in got], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["n_train"] for r in got], dtype=np.int64)[order]


def path_order(paths: list[np.ndarray], key: np.ndarray) -> np.ndarray:
    """Stable order by ``key`` and then by the children, two of them in one number."""
    tails = []
    for k in range(1, len(paths), 2):
        pair = paths[k] << np.uint64(32)
        tails.append(pair | paths[k + 1] if k + 1 < len(paths) else pair)
    return np.lexsort((*tails[::-1], key))


def changes(paths: list[np.ndarray]) -> list[np.ndarray]:
    """Per level, where a new node begins in sorted paths."""
    new, out = np.zeros(len(paths[0]), dtype=bool), []
    for x in paths:
        new = new | np.r_[True, x[1:] != x[:-1]][:len(x)]
        out.append(new)
    return out


def pack(paths, doc, train) -> bytes:
    """Tokens (sorted by path, then text) as one row."""
    new = changes(paths)
    at = [np.flatnonzero(x) for x in new]
    at.append(np.flatnonzero(new[-1] | np.r_[True, doc[1:] != doc[:-1]]))
    n_child = [np.diff(np.r_[np.searchsorted(b, a), len(b)]) for a, b in zip(at[:-1], at[1:], strict=True)]
    learned = np.add.reduceat(train.astype(np.int64), at[-2])
    cnt = np.diff(np.r_[at[-1], len(doc)])
    small = b"".join(x.astype("<u4").tobytes() for x in (*n_child, learned, cnt))
    small += doc[at[-1]].astype("<u2").tobytes()
    small = zstd.ZstdCompressor(level=1).compress(small)
    return b"".join([np.array([len(paths), *map(len, at)], "<u8").tobytes(), paths[0][at[0]].tobytes(),
                     *[p[a].astype("<u4").tobytes() for p, a in zip(paths[1:], at[1:], strict=False)], small])


def unpack(blob: bytes):
    """(words and children of each level, children of each node, training counts, texts of
    each path, counts, text numbers)."""
    depth = int(np.frombuffer(blob, "<u8", 1)[0])
    size = np.frombuffer(blob, "<u8", depth + 1, 8).astype(np.int64)
    at = 8 * (depth + 2)
    paths = [np.frombuffer(blob, "<u8", size[0], at)]
    at += 8 * size[0]
    for m in size[1:depth]:
        paths.append(np.frombuffer(blob, "<u4", m, at).astype(np.uint64))
        at += 4 * m
    small = zstd.ZstdDecompressor().decompress(blob[at:])
    four = np.frombuffer(small, "<u4", size[:depth].sum() + size[-2] + size[-1])
    *n_child, n_docs, learned, cnt = np.split(four.astype(np.int64), np.cumsum([*size[:depth], size[-2]]))
    return paths, n_child, learned, n_docs, cnt, np.frombuffer(small, "<u2", size[-1], 4 * len(four)).astype(np.int64)


def spread_down(values: np.ndarray, n_child: list[np.ndarray]) -> np.ndarray:
    for n in n_child:
        values = np.repeat(values, n)
    return values


SUM = np.dtype([("doc", "<u2"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")])


def summed(doc, times, known, base, score) -> bytes:
    """Sums per text as packed SUM records."""
    top = int(doc.max()) + 1 if len(doc) else 0
    hit = np.flatnonzero(np.bincount(doc, minlength=top))
    out = np.zeros(len(hit), dtype=SUM)
    out["doc"] = hit
    for name, x in (("known", known), ("base", base), ("score", score)):
        out[name] = np.bincount(doc, times * x, top)[hit]
    return out.tobytes()


def solve_shard(blobs_: list[bytes], hot: list, n: int, distinct: int) -> list[bytes]:
    """Builds the trie of a shard from its rows and answers each row with sums per text.

    ``hot``: per level (keys, training counts) of the hot words and sequences."""
    kept = []
    for blob in blobs_:
        paths, n_child, c, *_ = unpack(blob)
        # what is hot has counts from elsewhere, whether this shard learned of it or not
        keep = (c > 0) | spread_down(places(hot[0][0], paths[0]) >= 0, n_child)
        kept.append([*[spread_down(p, n_child[k:])[keep] for k, p in enumerate(paths)], c[keep]])
    *paths, c = [np.concatenate(x) for x in zip(*kept, strict=True)]
    del kept
    order = path_order(paths, paths[0])
    paths, c = [p[order] for p in paths], c[order]
    leaf = np.flatnonzero(changes(paths)[-1])
    if len(leaf):
        c = np.add.reduceat(c, leaf)
    paths = [p[leaf] for p in paths]
    first, counts = [np.flatnonzero(x) for x in changes(paths)], []
    for k, f in enumerate(first):
        counts.append(np.add.reduceat(c, f) if len(f) else c)
        if len(hot[k][0]):
            maybe = np.flatnonzero(places(hot[0][0], paths[0][f]) >= 0)
            key = path_keys([p[f[maybe]] for p in paths[:k + 1]])[k] if k else paths[0][f[maybe]]
            at = places(hot[k][0], key)
            counts[k][maybe[at >= 0]] = hot[k][1][at[at >= 0]]
    trie = Trie(mapped(Trie.encode(paths, first, counts, n, distinct)))
    del paths, c, first, counts
    out = []
    for blob in blobs_:
        (word, *children), n_child, _, n_docs, cnt, doc = unpack(blob)
        node, count = trie.word(word)
        at = places(hot[0][0], word)
        count = np.where(at >= 0, hot[0][1][at] if len(hot[0][1]) else 0, count)
        score = np.repeat(trie.score(word, count, node, n_child, children), n_docs)
        known, base = (np.repeat(spread_down(x, n_child), n_docs) for x in (count > 0, np.log10(count + 0.5)))
        out.append(summed(doc, cnt, known, base, score))
    return out


def fit_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
              shard_tokens: int = SHARD_TOKENS, order: int = 2) -> tuple[DataFrame, dict]:
    """Scores every document by a model of order ``order`` (2 at least) of the rows that
    satisfy ``train``.

    Returns (id, n_tokens, n_known, base_score, score) rows and the facts of the model.
    ``base_score`` is the text's log10 probability by the unigram part alone.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"),
                       col(text_col).cast("string").cast("binary").alias("text"))
    counts = staged(count_words(rows), "words")
    total = counts.agg(F.sum("n_train"), F.sum((F.col("n_train") > 0).cast("long")), F.sum("n_all"),
                       F.sum(F.when(F.col("h") == END, F.col("n_train")))).first()
    n, distinct, tokens, n_docs = (int(x or 0) for x in total)
    shards = max(1, -(-tokens // shard_tokens))
    limit = shard_tokens // 4  # at most four times as many words as shards can exceed it
    hot = [hot_arrays(counts.filter(F.col("n_all") > limit).select("h", "n_train").collect())]
    got = count_hot_paths(rows, hot[0][0], order).filter(F.col("n_all") > limit).collect() if len(hot[0][0]) else []
    hot += [hot_arrays([r for r in got if r["level"] == k]) for k in range(1, order)]
    upper = spark.sparkContext.broadcast(hot)
    start = float(np.log10(MU + n_docs * sum(LIFT ** k for k in range(order - 1))))

    def send(batches):
        up, seq = upper.value, 0
        for ids, learn, texts in text_chunks(batches):
            paths, doc = tokens_of(texts, order)
            w = paths[0]
            paths = [w, *map(child_hash, paths[1:])]
            # dealt by word, below hot beginnings by one word more
            key, here = mix(w), places(up[0][0], w) >= 0
            hw = np.flatnonzero(here)
            count = up[0][1][places(up[0][0], w[hw])].astype(np.float64) if len(hw) else np.empty(0)
            top, low, first = MU * unigram(count, n, distinct), MU + count, count
            for k in range(1, order):
                key[hw] = mix(key[hw] + mix(paths[k][hw]))
                at = places(up[k][0], key[hw])
                some = at >= 0
                hw, top, low, first = hw[some], top[some], low[some], first[some]
                count = up[k][1][at[some]] if len(hw) else np.empty(0)
                top = top + LIFT ** (k - 1) * count
                low = low + (LIFT ** k * count if k + 1 < order else 0)
            # what is hot to its end is answered on the spot
            here = np.zeros(len(w), dtype=bool)
            here[hw] = True
            score = np.log10(top) - np.where(w[hw] == END, 0.0, np.log10(low))
            known, base, hd = first > 0, np.log10(first + 0.5), doc[hw]
            size = np.bincount(doc, minlength=len(texts))
            # a chunk is named by its place and, as a check, by what it holds
            c1 = TaskContext.get().partitionId() << 32 | seq
            c2 = int(mix(w).sum() + mix(size.astype(np.uint64)).sum()) >> 1
            seq += 1
            sums = summed(hd, np.ones(len(hd)), known, base, score)
            yield pa.RecordBatch.from_arrays([
                pa.array([c2 & 0x7FFFFFFF]), pa.array([c1]), pa.array([c2]),
                pa.array([size.astype("<i8").tobytes() + sums], pa.binary()),
                pa.array([ids.to_pylist()], pa.list_(ids.type))], schema=sent)
            rest = ~here
            paths, doc, key = [p[rest] for p in paths], doc[rest], key[rest]
            if not len(key):
                continue
            by = path_order(paths, key)
            paths, doc, key = [p[by] for p in paths], doc[by], key[by]
            shard = (key >> np.uint64(33)).astype(np.int64) * shards >> 31
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield pa.RecordBatch.from_arrays([
                    pa.array([-1 - int(shard[a])]), pa.array([c1]), pa.array([c2]),
                    pa.array([pack([p[a:b] for p in paths], doc[a:b], learn[doc[a:b]])], pa.binary()),
                    pa.array([None], pa.list_(ids.type))], schema=sent)

    kind = T.StructType([T.StructField("shard", T.LongType()), T.StructField("c1", T.LongType()),
                         T.StructField("c2", T.LongType()), T.StructField("data", T.BinaryType()),
                         T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])
    sent = to_arrow_schema(kind)

    def answer(batches):
        up = upper.value
        held: list = []

        def flush():
            if held:
                got = solve_shard([h[2] for h in held], up, n, distinct)
                for (c1, c2, _), data in zip(held, got, strict=True):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([-1]), pa.array([c1]), pa.array([c2]), pa.array([data], pa.binary()),
                        pa.array([None], sent.field("ids").type)], schema=sent)
                held.clear()

        last = None
        for b in batches:
            shard = b.column(0).to_pylist()
            for r in range(b.num_rows):
                if shard[r] >= 0:  # a chunk's own row goes through
                    yield b.slice(r, 1)
                    continue
                if shard[r] != last:
                    yield from flush()
                    last = shard[r]
                held.append((b.column(1)[r].as_py(), b.column(2)[r].as_py(), b.column(3)[r].as_py()))
        yield from flush()

    # a task per shard, however many there are; the chunks' own rows go anywhere
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    to = F.pmod(F.when(F.col("shard") < 0, -1 - F.col("shard")).otherwise(F.col("shard")), F.lit(parts)).cast("int")
    deal = rows.mapInArrow(send, kind).repartitionById(parts, to).sortWithinPartitions("shard")
    back = deal.mapInArrow(answer, kind).repartition("c1", "c2").sortWithinPartitions("c1", "c2", F.desc("shard"))
    scale = float(np.log10(n + 0.5 * (distinct + 1)))
    result = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    final = to_arrow_schema(result)

    def gather(batches):
        now = size = ids = None
        sums = np.zeros((3, 0))

        def flush():
            if now is not None:
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(size), pa.array(sums[0].astype(np.int64)),
                    pa.array(sums[1] - size * scale), pa.array(sums[2] - start)], schema=final)

        for b in batches:
            for r in range(b.num_rows):
                data = b.column(3)[r].as_py()
                if b.column(0)[r].as_py() >= 0:  # comes first in its chunk
                    yield from flush()
                    now = (b.column(1)[r].as_py(), b.column(2)[r].as_py())
                    ids = pa.array(b.column(4)[r].as_py(), final.field("id").type)
                    size = np.frombuffer(data, "<i8", len(ids))
                    data = data[8 * len(ids):]
                    sums = np.zeros((3, len(ids)))
                elif (b.column(1)[r].as_py(), b.column(2)[r].as_py()) != now:
                    raise ValueError("a chunk was cut differently when it was computed again")
                got = np.frombuffer(data, dtype=SUM)
                for k, name in enumerate(("known", "base", "score")):
                    sums[k][got["doc"]] += got[name]
        yield from flush()

    return back.mapInArrow(gather, result), {"train_tokens": n, "distinct": distinct, "shards": shards, "hot": sum(len(k) for k, _ in hot)}


def child_hash(v: np.ndarray) -> np.ndarray:
    """The hash by which a predecessor is known below a word."""
    return mix(v ^ np.uint64(0x5851F42D4C957F2D)) & _CHILD
