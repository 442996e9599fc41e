"""SimHash near-duplicates with a Gray-order hierarchical index.

1. Every text gets a 64-bit SimHash of its word shingles. Equal fingerprints collapse to
   one row first, so a group of exact copies of any size is one fingerprint.
2. Fingerprints within ``max_bits`` bits agree on all of one of ``max_bits + 1`` blocks of
   bits. For each block the fingerprints are dealt by the block's value: these are the
   roots of the index, the masked pattern that all below them share.
3. Inside a root they are sorted by Gray rank, where neighbours differ in few bits, and
   packed into a tree: a node keeps the bits that all its members share and its parent
   doesn't already hold (mask and pattern). A query walks down adding up the differences
   to the patterns, and leaves a whole group as soon as the sum exceeds ``max_bits``. All
   queries of a task walk in step, level by level, in slices of bounded memory. Links are
   merged at once, so a root returns a forest, not its pairs.
4. A root of more than ``root_cap`` distinct fingerprints is not searched in one task: its
   fingerprints meet in the points of Hamming space that lie between them. Each is sent
   to all points within half of ``max_bits``; a point has at most as many members as
   there are such points (65 for 2 bits), so nothing is skewed, and the links are the same.
5. Components by alternating stars.

Null and blank texts have fingerprint zero and are linked like others. Null ids are
allowed; they never become a component's id unless it has no other. Repeated rows share
a fingerprint. Texts are used whole. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import blobs, col, free_name, row_key, staged
from .graph import components

FANOUT = 8
#: Pairs of query and node that a task follows at once.
SLICE = 2_000_000


def simhashes(texts: list[bytes], shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text (uint64)."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[np.ndarray] = []
    who: list[int] = []
    held = 0

    def flush():
        if not hashes:
            return
        n = np.array([len(h) for h in hashes])
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.uint32)
        out[who] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]

    xx = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z only, ASCII blanks only
        if not words:
            continue
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        k = min(shingle, len(words))
        spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
        hashes.append(np.array([xx(joined[s:e], seed) for s, e in spans], dtype=np.uint64))
        who.append(i)
        held += len(words)
        if held > 100_000:
            flush()
            hashes, who, held = [], [], 0
    flush()
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` without the text column and with ``fp``, the SimHash as a signed long."""
    ship_package(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col and c.lower() != "fp"]
    df = docs.select(*[col(c) for c in keep],
                     col(text_col).cast("string").cast("binary").alias(free_name(docs, "_text")))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fp = simhashes(blobs(b.column(b.num_columns - 1)), shingle)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=schema.names)

    return df.mapInArrow(run, schema)


def block_masks(max_bits: int) -> list[int]:
    """Bit masks of ``max_bits + 1`` blocks that cover 64 bits, as signed longs."""
    cuts = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code word in the Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Trees over fingerprints that are sorted by root and, below it, by Gray rank."""

    def __init__(self, fps: np.ndarray, root: np.ndarray):
        order = np.lexsort((gray_rank(fps), root))
        self.order, self.fps, root = order, fps[order], root[order]
        first = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        self.size = np.diff(np.r_[first, len(root)])
        self.tree = np.repeat(np.arange(len(first)), self.size)
        # levels from the leaves up: pattern, mask of own bits, first child, tree
        full = np.full(len(fps), ~np.uint64(0))
        lo, hi, tree = self.fps, self.fps, self.tree
        levels = [(self.fps, full, np.arange(len(fps)), tree)]
        while len(tree) > len(first):
            at = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
            place = np.arange(len(tree)) - np.repeat(at, np.diff(np.r_[at, len(tree)]))
            start = np.flatnonzero(place % FANOUT == 0)
            lo, hi = np.bitwise_and.reduceat(lo, start), np.bitwise_or.reduceat(hi, start)
            tree = tree[start]
            levels.append((lo, ~(lo ^ hi), start, tree))
        # top down; each node keeps only the bits that its parent doesn't hold
        self.levels = []
        for i, (pattern, mask, _, _) in enumerate(levels):
            if i + 1 < len(levels):
                start, above = levels[i + 1][2], levels[i + 1][1]
                mask = mask & ~np.repeat(above, np.diff(np.r_[start, len(mask)]))
            child = levels[i][2] if i else None
            ends = np.r_[child[1:], len(levels[i - 1][0])] if i else None
            self.levels.append((pattern & mask, mask, child, ends))
        self.levels.reverse()

    def search(self, queries: np.ndarray, max_bits: int):
        """(query, member) places in sorted order, member after query, within ``max_bits``."""
        q, node = queries, self.tree[queries]
        held = np.zeros(len(q), dtype=np.uint8)
        for pattern, mask, child, ends in self.levels:
            held = held + np.bitwise_count((self.fps[q] & mask[node]) ^ pattern[node])
            ok = held <= max_bits
            q, node, held = q[ok], node[ok], held[ok]
            if child is None:
                later = node > q
                return q[later], node[later]
            n = ends[node] - child[node]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, node, held = np.repeat(q, n), np.repeat(child[node], n) + inner, np.repeat(held, n)
        raise AssertionError("the last level has no children")

    def forest(self, max_bits: int) -> np.ndarray:
        """For each input place the place of its group's first member."""
        label = np.arange(len(self.fps))
        todo = np.flatnonzero(self.size[self.tree] > 1)
        reach = np.cumsum(self.size[self.tree[todo]])
        for cut in np.split(todo, np.searchsorted(reach, np.arange(SLICE, reach[-1], SLICE))) if len(todo) else []:
            a, b = self.search(cut, max_bits)
            while len(a):
                x, y = label[a], label[b]
                far = x != y
                a, b, x, y = a[far], b[far], x[far], y[far]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label[label] != label).any():
                    label = label[label]
        out = np.empty(len(label), dtype=np.int64)
        out[self.order] = self.order[label]
        return out


def index_links(rooted: DataFrame, max_bits: int) -> DataFrame:
    """Forest edges (u, v) inside each root of (block, root, fp) rows."""
    deal = rooted.repartition("block", "root").sortWithinPartitions("block", "root")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def link(block, root, fp):
        change = (block[1:] != block[:-1]) | (root[1:] != root[:-1])
        place = GrayIndex(fp.view(np.uint64), np.cumsum(np.r_[False, change])).forest(max_bits)
        moved = np.flatnonzero(place != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[place[moved]])], schema=schema)

    def run(batches):
        held: list = []
        rows = 0
        for b in batches:
            held.append([np.asarray(c) for c in b.columns])
            rows += b.num_rows
            if rows < 60_000:
                continue
            block, root, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            # the last root may go on in the next batch
            cut = int(np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (root[1:] != root[:-1])])[-1])
            if cut:
                yield link(block[:cut], root[:cut], fp[:cut])
            held, rows = [[block[cut:], root[cut:], fp[cut:]]], len(fp) - cut
        if rows:
            yield link(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return deal.mapInArrow(run, "u long, v long")


def point_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u, v) that join all ``fp`` within ``max_bits``, by points between them."""
    near, odd = max_bits // 2, max_bits % 2

    def flips(r):
        found = [sum(1 << b for b in bits) for k in range(r + 1) for bits in combinations(range(64), k)]
        return [m - (1 << 64) if m >> 63 else m for m in found]

    inner = set(flips(near))
    marks = F.array(*[F.struct(F.lit(m).cast("long").alias("flip"), F.lit(m in inner).alias("near"))
                      for m in flips(near + odd)])
    at = fps.select("fp", F.explode(marks).alias("m")).select(
        F.col("fp").bitwiseXOR(F.col("m.flip")).alias("point"), "fp", F.col("m.near").alias("near"))
    met = at.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("v"),
                                  F.collect_set("fp").alias("us")).filter(F.col("v").isNotNull() & (F.size("us") > 1))
    return met.select(F.explode("us").alias("u"), "v").filter("u <> v").distinct()


def link_fingerprints(fps: DataFrame, max_bits: int = 2, root_cap: int = 16384) -> DataFrame:
    """(fp, component) of the fingerprints that have a link; ``fps`` holds distinct ``fp``."""
    ship_package(fps.sparkSession)
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(max_bits)])
    rooted = fps.select("fp", F.posexplode(masks).alias("block", "mask")).select(
        "block", F.col("fp").bitwiseAND(F.col("mask")).alias("root"), "fp")
    count = rooted.groupBy("block", "root").agg(F.count("*").alias("n")).filter("n > 1")
    big = staged(count.filter(F.col("n") > root_cap).select("block", "root"), "big-roots")
    edges = index_links(rooted.join(big, ["block", "root"], "left_anti"), max_bits)
    if big.head(1):
        hot = rooted.join(big, ["block", "root"], "left_semi").select("fp").distinct()
        edges = edges.unionByName(point_links(hot, max_bits))
    return components(edges).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, root_cap: int = 16384) -> DataFrame:
    """(id, fp, component_id) per document; ``component_id`` is the smallest id reachable."""
    base = staged(fingerprints(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")),
                               "text", shingle), "simhash")
    distinct = base.groupBy("fp").agg(F.min("id").alias("least"))
    linked = link_fingerprints(distinct.select("fp"), max_bits, root_cap)
    groups = distinct.join(linked, "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    groups = groups.join(groups.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    return base.join(groups.select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 2, root_cap: int = 16384) -> DataFrame:
    """One document of each component: the one of the smallest id. Columns as in ``docs``.

    Rows without an id come last; of equal rows one stays.
    """
    k1, k2, n = (free_name(docs, x) for x in ("_k1", "_k2", "_n"))
    keys = row_key(docs, id_col, text_col)
    slim = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"),
                       keys[0].alias("k1"), keys[1].alias("k2"))
    base = staged(fingerprints(slim, "text", shingle), "simhash")
    best = base.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("best"))
    linked = link_fingerprints(best.select("fp"), max_bits, root_cap)
    best = best.join(linked, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("best").alias("best"))
    best = best.select(F.col("best.k1").alias(k1), F.col("best.k2").alias(k2))
    kept = docs.select("*", keys[0].alias(k1), keys[1].alias(k2)).join(best, [k1, k2], "left_semi")
    # equal rows share their keys
    kept = kept.withColumn(n, F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1)))
    return kept.filter(col(n) == 1).select(*[col(c) for c in docs.columns])
