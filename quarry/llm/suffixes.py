"""Suffix-array deduplication of byte strings of a fixed length, across all documents.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Sorting
the suffixes of the whole corpus would compare places that cannot match, so the work is
cut into shards that no match leaves, and only what is still open is sorted:

1. Anchors. Every ``length``-byte window picks its smallest hashed gram. Equal windows pick
   equal grams at equal offsets, so each window start belongs to one anchor occurrence,
   and a match never leaves the set of occurrences of one anchor. An occurrence is kept as
   (document, first start, number of starts, anchor hash, hash of the bytes it spans).
2. Anchors that occur once can't match and go. Occurrences with equal spans repeat as
   a whole: they are settled by counting, however many copies there are (those of one text
   already in its task), and one of them stands for all below.
3. What is left are the borders of repeated passages: anchors with several different
   spans. Their spans are fetched from the texts and dealt to shards by anchor; an anchor
   of many different spans is salted over several shards.
4. A shard builds its suffix array by Larsson-Sadakane refinement (sort by the first 8
   bytes, then double the sorted depth by the ranks, only inside groups that are still
   tied) and the common prefixes of neighbours by Kasai's rule, on arrays: only places
   whose prefix can't be derived from the place before are compared. Neighbours that share
   ``length`` bytes are matches.
5. Shards that share a salted anchor are merged by binary search: each gives one digest
   per different window, sorted; equal digests of other shards are found by searching.
6. The starts are gathered per document and cut from the text.

Texts are bytes (null: empty), used whole; matches never cross documents. Texts shorter than
``length`` can't match and pass. Repeated rows are occurrences of their own. Empty tables
give empty results. Input columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import blobs, col, free_name, row_key, staged

GRAM = 32
#: Bytes that one suffix array holds, and different spans of one anchor in one shard.
SHARD_BYTES = 1 << 20
ANCHOR_SPANS = 2000

_ODD1, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number, zeros after the end."""
    pad = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    n = len(data)
    two = pad[:n + 7] << np.uint64(8) | pad[1:n + 8]
    four = two[:n + 4] << np.uint64(16) | two[2:n + 6]
    return four[:n] << np.uint64(32) | four[4:n + 4]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _ODD1
    h = (h ^ h >> np.uint64(29)) * _ODD2
    return h ^ h >> np.uint64(32)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on that has as many."""
    h = mix(words_at(data))
    size = 8
    while size < GRAM:
        h = mix(h[:len(h) - size] * _ODD2 + h[size:])
        size *= 2
    return h[:max(0, len(data) - GRAM + 1)]


def anchors(texts: list[bytes], length: int):
    """Arrays (text number, first start, number of starts, anchor hash, span hash) of all
    windows of ``texts``. A window's anchor is its smallest gram, the last one of equals."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    wide = length - GRAM + 1  # grams of a window
    h = gram_hashes(data)
    n = len(h) - wide + 1
    if n <= 0:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    # the low bits of a gram's key count places down, so the last of equal grams is least
    low_bits = np.uint64((1 << max(20, len(data).bit_length())) - 1)
    key = (h & ~low_bits) | (low_bits - np.arange(len(h), dtype=np.uint64))
    step = 1
    while 2 * step <= wide:  # running minimum over `wide` places by doubling
        key = np.minimum(key[:len(key) - step], key[step:])
        step *= 2
    key = np.minimum(key[:n], key[wide - step:wide - step + n])
    spot = (low_bits - (key & low_bits)).astype(np.int64)
    base = np.cumsum(size) - size
    # windows inside one text, cut where the anchor or the text changes
    owner = np.repeat(np.arange(len(texts)), size)
    ok = owner[:n] == owner[length - 1:length - 1 + n]
    first = np.flatnonzero(ok & np.r_[True, (spot[1:] != spot[:-1]) | (owner[1:n] != owner[:n - 1]) | ~ok[:-1]])
    stops = np.flatnonzero(ok & np.r_[(spot[1:] != spot[:-1]) | (owner[1:n] != owner[:n - 1]) | ~ok[1:], True]) + 1
    many = stops - first
    view = memoryview(data)
    digest = xxhash.xxh64_intdigest
    spans = zip(first.tolist(), (stops + length - 1).tolist(), strict=True)
    c = np.array([digest(view[a:b], 1) for a, b in spans], dtype=np.uint64)
    who = owner[first]
    # where the anchor lies in its span is part of what makes two occurrences equal
    c ^= mix((spot[first] - first).astype(np.uint64))
    return who, first - base[who], many, h[spot[first]], c


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order (Larsson-Sadakane refinement)."""
    n = len(data)
    key = words_at(data)
    sa = np.argsort(key, kind="stable")
    if not n:
        return sa
    new = np.r_[True, key[sa][1:] != key[sa][:-1]]
    if not data.all():  # a short suffix sorts before one that has zero bytes in its place
        left = np.minimum(8, n - sa)
        order = np.lexsort((left, np.cumsum(new)))
        sa, left = sa[order], left[order]
        new[1:] |= left[1:] != left[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank: its first place
    rank[sa] = group
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
    depth = 8
    while len(tied):
        who = sa[tied]
        first = group[tied]
        after = rank[np.minimum(who + depth, n)]
        order = np.lexsort((after, first))
        who, first, after = who[order], first[order], after[order]
        sa[tied] = who
        split = np.r_[True, (first[1:] != first[:-1]) | (after[1:] != after[:-1])]
        # a group's members lie side by side, so a subgroup starts at a place of `tied`
        fresh = np.maximum.accumulate(np.where(split, np.arange(len(tied)), 0))
        group[tied] = tied[fresh]
        rank[who] = tied[fresh]
        tied = tied[~(split & np.r_[split[1:], True])]
        depth *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``sa`` (first: 0).

    Kasai's rule: if two neighbours stand behind equal bytes, those behind share one byte
    more and are neighbours too. So only places where that fails are compared.
    """
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    has = before >= 0
    derived = np.zeros(n, dtype=bool)
    derived[1:] = has[1:] & (before[1:] > 0) & (data[:-1] == data[np.maximum(before[1:] - 1, 0)])
    todo = place[has & ~derived]
    shared = np.zeros(n, dtype=np.int64)
    words = words_at(data)
    a, b, who = todo, before[todo], todo
    done = np.zeros(len(todo), dtype=np.int64)
    while len(who):
        x = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        room = np.minimum(np.minimum(8, n - a), n - b)
        same = np.zeros(len(x), dtype=np.int64)
        for bits in range(0, 64, 8):  # equal leading bytes
            same += x < np.uint64(1 << bits)
        same = np.minimum(same, np.maximum(room, 0))
        done = done + same
        more = same == 8
        shared[who[~more]] = done[~more]
        a, b, who, done = a[more] + 8, b[more] + 8, who[more], done[more]
    # a derived place has one byte less than the place before
    last = np.maximum.accumulate(np.where(derived, -1, place))
    shared = np.where(derived, shared[last] + last - place, shared)
    return np.maximum(shared, 0)[sa]


def ragged(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def runs_of(places: np.ndarray):
    """(first, last) arrays of the runs of rising places."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.r_[0, cut + 1]], places[np.r_[cut, len(places) - 1]]


def shard_classes(spans: list[bytes], counts: np.ndarray, n_starts: np.ndarray, length: int):
    """Window starts of a shard's spans, one span after the other.

    Returns (place in the joined bytes, span number, class, repeats): starts are of one class
    if their windows are equal, and repeat if the class has several occurrences.
    """
    size = np.array([len(x) for x in spans], dtype=np.int64)
    data = np.frombuffer(b"".join(spans), dtype=np.uint8)
    sa = suffix_array(data)
    klass = np.empty(len(data), dtype=np.int64)
    klass[sa] = np.cumsum(common_prefixes(data, sa) < length)
    owner = np.repeat(np.arange(len(spans)), n_starts)
    place = (np.cumsum(size) - size)[owner] + ragged(n_starts)
    mine = klass[place]
    # a span that stands for several occurrences counts as often
    members = np.bincount(mine, weights=counts[owner])
    return place, owner, mine, members[mine] > 1


OCC = "k1 long, k2 long, s int, n int, h long, c long, m int"
FOUND = "k1 long, k2 long, s int, e int, part int, data binary"
#: A window of a salted anchor: its digest, place, and whether it is the only one in its shard.
WINDOW = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("s", "<i4"), ("alone", "?")])
#: Windows that one merging task should get.
MERGE_WINDOWS = 200_000


def chunks(batches, max_bytes: int, text_at: int):
    """Slices of batches of about ``max_bytes`` of text, with the texts as bytes."""
    for b in batches:
        texts = blobs(b.column(text_at))
        at = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= max_bytes:
                yield b.slice(at, i + 1 - at), texts[at:i + 1]
                at, held = i + 1, 0
        if at < len(texts):
            yield b.slice(at), texts[at:]


def fold_echoes(who, s, n, h, c):
    """Occurrences of one text that have equal spans, as a text that repeats itself has many.

    Returns (places of the first of each, 1 or 2 for one or more of them) and the runs of
    starts of those that are not alone, as (text number, first start, number of starts).
    """
    order = np.lexsort((s, c, h, who))
    w, x, y = who[order], h[order], c[order]
    new = np.r_[True, (w[1:] != w[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    size = np.diff(np.r_[np.flatnonzero(new), len(order)])
    first = order[new]
    again = np.sort(order[np.repeat(size > 1, size)])  # in the order of text and start
    w, a, k = who[again], s[again], n[again]
    head = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (a[1:] != a[:-1] + k[:-1])][:len(again)])
    total = np.add.reduceat(k, head) if len(head) else k
    return first, np.minimum(size, 2), (w[head], a[head], total)


def occurrences(keyed: DataFrame, length: int) -> DataFrame:
    """Anchor occurrences (OCC) of (k1, k2, text) rows; ``m`` is 2 for a span that the text
    holds several times. Rows without ``h`` are starts that are known to repeat by that."""
    names = [x.split()[0] for x in OCC.split(", ")]

    def run(batches):
        for b, texts in chunks(batches, 1 << 18, 2):
            who, s, n, h, c = anchors(texts, length)
            if not len(who):
                continue
            first, m, (rw, rs, rn) = fold_echoes(who, s, n, h, c)
            known = np.r_[np.ones(len(first), bool), np.zeros(len(rw), bool)]
            row = np.r_[who[first], rw]
            k1, k2 = (pa.array(np.asarray(b.column(i))[row]) for i in (0, 1))
            pad = np.zeros(len(rw), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [k1, k2, pa.array(np.r_[s[first], rs].astype(np.int32)), pa.array(np.r_[n[first], rn].astype(np.int32)),
                 pa.array(np.r_[h[first].view(np.int64), pad], mask=~known),
                 pa.array(np.r_[c[first].view(np.int64), pad], mask=~known),
                 pa.array(np.r_[m, pad].astype(np.int32))], names=names)

    return keyed.filter(F.octet_length("text") >= length).mapInArrow(run, OCC)


SKETCH_BITS = 26


def sketch(keys: DataFrame, name: str) -> np.ndarray:
    """A bit table of fixed size (8 MB) in which every value of a long column has its bit.

    It only saves shuffling rows that can't match; an exact join follows everywhere, so a
    table that fills up costs time, never rows.
    """
    bit = F.pmod(F.xxhash64(name), F.lit(1 << SKETCH_BITS))
    words = keys.select(bit.alias("b")).selectExpr(
        "shiftright(b, 6) AS w", "shiftleft(1L, cast(b & 63 AS int)) AS v")
    out = np.zeros(1 << (SKETCH_BITS - 6), dtype=np.uint64)
    got = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out[np.asarray(got["w"].combine_chunks())] = np.asarray(got["v"].combine_chunks()).view(np.uint64)
    return out


def may_hold(df: DataFrame, bits: np.ndarray, name: str, negate: bool = False) -> DataFrame:
    """Rows whose value has its bit (or, negated, has not)."""
    table = df.sparkSession.sparkContext.broadcast(bits)
    probe = free_name(df, "_bit")
    wide = df.withColumn(probe, F.pmod(F.xxhash64(name), F.lit(1 << SKETCH_BITS)))

    def run(batches):
        for b in batches:
            at = np.asarray(b.column(b.num_columns - 1))
            has = (table.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            got = b.filter(pa.array(has != negate))
            if got.num_rows:
                yield got

    return wide.mapInArrow(run, wide.schema).drop(probe)


def fetch_spans(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The spans of ``wanted`` (k1, k2, spans: array of structs with s, n) with their bytes."""
    item = wanted.schema["spans"].dataType.elementType
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *item.fields,
                           T.StructField("span", T.BinaryType())])
    joined = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "spans")

    def run(batches):
        for b, text in chunks(batches, 1 << 22, 2):
            many = np.asarray(b.column(3).value_lengths())
            flat = b.column(3).flatten()
            owner = np.repeat(np.arange(b.num_rows), many)
            s, n = (np.asarray(flat.field(item.fieldNames().index(x))) for x in ("s", "n"))
            cut = [text[o][i:i + k + length - 1] for o, i, k in zip(owner.tolist(), s.tolist(), n.tolist(), strict=True)]
            k1, k2 = (pa.array(np.asarray(b.column(i))[owner]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([k1, k2, *(flat.field(i) for i in range(len(item.fields))),
                                              pa.array(cut, pa.binary())], names=schema.names)

    return joined.mapInArrow(run, schema)


def search_shards(spans: DataFrame, length: int, shard_bytes: int, anchor_spans: int, parts: int) -> DataFrame:
    """FOUND rows of (k1, k2, s, n, h, m, k, salt, span) rows.

    Rows without ``part`` are runs of starts that repeat in their shard. For the windows of
    salted anchors a shard gives one WINDOW record per class, dealt by digest over
    ``parts``: a row per shard and part holds them sorted.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    deal = spans.select("h", "salt", "k1", "k2", "s", "n", "m", "k", "span") \
        .repartition("h", "salt").sortWithinPartitions("h", "salt")

    def solve(rows):
        h, salt, k1, k2, s, n, m, k = (np.concatenate([r[i] for r in rows]) for i in range(8))
        text = [x for r in rows for x in r[8]]
        place, owner, klass, repeats = shard_classes(text, m, n, length)
        # spans that occur several times as a whole are settled already
        sel = np.flatnonzero(repeats & (m[owner] == 1))
        if len(sel):
            a, b = runs_of(place[sel])  # spans are longer than their starts, so no run spans two
            at = owner[np.searchsorted(place, a)]
            start = s[at] + a - place[np.searchsorted(owner, at)]
            none = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[at]), pa.array(k2[at]), pa.array(start.astype(np.int32)),
                 pa.array((start + b - a).astype(np.int32)), *none], names=names)
        wide = np.flatnonzero(k[owner] > anchor_spans)
        if len(wide):
            _, one = np.unique(klass[wide], return_index=True)
            one = wide[one]
            at = owner[one]
            data = memoryview(b"".join(text))
            got = np.zeros(len(one), dtype=WINDOW)
            for name, seed in (("d1", 1), ("d2", 2)):
                got[name] = [xxhash.xxh64_intdigest(data[p:p + length], seed) for p in place[one].tolist()]
            got["k1"], got["k2"], got["alone"] = k1[at], k2[at], ~repeats[one]
            got["s"] = s[at] + place[one] - place[np.searchsorted(owner, at)]
            part = (got["d1"] % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((got["d1"], part))
            got, part = got[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            rows_ = [(int(part[x]), got[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            gone = [pa.nulls(len(rows_), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*gone, pa.array([r[0] for r in rows_], pa.int32()),
                                              pa.array([r[1] for r in rows_], pa.binary())], names=names)

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(8)] + [b.column(8).to_pylist()]
            h, salt = cols[0], cols[1]
            cuts = np.r_[0, np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1, len(h)]
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if size >= shard_bytes and (h[a], salt[a]) != last:
                    yield from solve(held)
                    held, size = [], 0
                held.append([c[a:z] for c in cols])
                size += sum(map(len, cols[8][a:z]))
                last = (h[a], salt[a])
        if held:
            yield from solve(held)

    return deal.mapInArrow(run, FOUND)


def merge_shards(found: DataFrame, parts: int) -> DataFrame:
    """(k1, k2, s, e) of the windows that are alone in their shard and occur in another.

    A part's sorted arrays, one per shard, are merged; a binary search in the merged one
    tells how often a digest occurs.
    """
    deal = found.select("part", "data").repartition(parts, "part").sortWithinPartitions("part")

    def solve(arrays):
        w = np.concatenate([np.frombuffer(a, dtype=WINDOW) for a in arrays])
        w = w[np.lexsort((w["d2"], w["d1"]))]
        several = np.searchsorted(w["d1"], w["d1"], side="right") - np.searchsorted(w["d1"], w["d1"], side="left") > 1
        twin = np.zeros(len(w) + 1, dtype=bool)
        twin[1:-1] = (w["d1"][1:] == w["d1"][:-1]) & (w["d2"][1:] == w["d2"][:-1])
        w = w[several & (twin[1:] | twin[:-1]) & w["alone"]]
        start = pa.array(w["s"].copy())
        return pa.RecordBatch.from_arrays([pa.array(w["k1"].copy()), pa.array(w["k2"].copy()), start, start],
                                          names=["k1", "k2", "s", "e"])

    def run(batches):
        held, last = [], None
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and part != last:
                    yield solve(held)
                    held = []
                held.append(data)
                last = part
        if held:
            yield solve(held)

    return deal.mapInArrow(run, "k1 long, k2 long, s int, e int")


def repeats(keyed: DataFrame, length: int, shard_bytes: int = SHARD_BYTES,
            anchor_spans: int = ANCHOR_SPANS) -> DataFrame:
    """(k1, k2, runs) for the rows of (k1, k2, text) that hold repeated windows: runs of starts."""
    every = staged(occurrences(keyed, length), "occurrences")
    once = every.filter("h IS NOT NULL")
    several = staged(once.groupBy("h").agg(F.sum("m").alias("x")).filter("x > 1").select("h"), "anchors")
    occ = staged(may_hold(once, sketch(several, "h"), "h").join(several, "h", "left_semi"), "repeated")
    span = staged(occ.groupBy("h", "c").agg(F.sum("m").alias("m"), F.min(F.struct("k1", "k2", "s", "n")).alias("o")),
                  "spans")
    echoes = every.filter("h IS NULL").select("k1", "k2", "s", (F.col("s") + F.col("n") - 1).alias("e"))
    settled = occ.join(span.filter("m > 1").select("h", "c"), ["h", "c"], "left_semi").select(
        "k1", "k2", "s", (F.col("s") + F.col("n") - 1).alias("e"))
    per = span.groupBy("h").agg(F.count("*").alias("k"), F.min("m").alias("least")).filter("k > 1 AND least = 1")
    # windows of salted anchors: each of their spans has at most as many as a window has grams
    wide = per.agg(F.sum(F.when(F.col("k") > anchor_spans, F.col("k")))).first()[0] or 0
    parts = 1 + int(wide) * length // 2 // MERGE_WINDOWS
    open_ = span.join(per, "h").select(
        "h", "m", "k", "o.*", F.pmod("c", F.ceil(F.col("k") / anchor_spans)).cast("long").alias("salt"))
    wanted = staged(open_.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("s", "n", "h", "m", "k", "salt")).alias("spans")), "wanted")
    texts = may_hold(keyed, sketch(wanted, "k1"), "k1")
    found = staged(search_shards(fetch_spans(texts, wanted, length), length, shard_bytes, anchor_spans, parts),
                   "found")
    runs = settled.unionByName(echoes).unionByName(found.filter("part IS NULL").select("k1", "k2", "s", "e"))
    runs = runs.unionByName(merge_shards(found.filter("part IS NOT NULL"), parts))
    return staged(runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("runs")), "runs")


def cut_out(text: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs); runs of starts may overlap."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order] + length)
    head = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    a, b = a[head].tolist(), b[np.r_[head[1:] - 1, len(b) - 1]].tolist()
    left = b"".join([text[i:j] for i, j in zip([0, *b], [*a, len(text)], strict=True)])
    return left, len(text) - len(left), len(a)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                   shard_bytes: int = SHARD_BYTES, anchor_spans: int = ANCHOR_SPANS) -> DataFrame:
    """``docs`` with ``cut``: struct of left (binary), n_bytes, n_removed, n_spans (longs).

    A column of that name is replaced. ``left`` may begin or end inside a character.
    """
    ship_package(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() != "cut"]
    k1, k2, t, r = (free_name(docs, x) for x in ("_k1", "_k2", "_bytes", "_runs"))
    keys = row_key(docs, id_col, text_col)
    data = F.coalesce(col(text_col).cast("string").cast("binary"), F.lit(b""))
    runs = repeats(docs.select(keys[0].alias("k1"), keys[1].alias("k2"), data.alias("text")), length, shard_bytes,
                   anchor_spans)
    full = docs.select(*[col(c) for c in keep], keys[0].alias(k1), keys[1].alias(k2))
    bits = sketch(runs, "k1")
    size = F.octet_length(F.coalesce(col(text_col).cast("string"), F.lit(""))).cast("long")
    zero = F.lit(0).cast("long")
    clean = may_hold(full, bits, k1, negate=True).select(*[col(c) for c in keep], F.struct(
        F.coalesce(col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("left"), size.alias("n_bytes"),
        zero.alias("n_removed"), zero.alias("n_spans")).alias("cut"))
    hit = may_hold(full, bits, k1).join(
        runs.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("runs").alias(r)), [k1, k2], "left")
    hit = hit.select(*[col(c) for c in keep], col(r), data.alias(t))
    schema = T.StructType([*hit.schema.fields[:-2], clean.schema["cut"]])
    kind = pa.struct([("left", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def run(batches):
        for b, texts in chunks(batches, 1 << 22, len(keep) + 1):
            out = []
            for text, found in zip(texts, b.column(len(keep)), strict=True):
                if found.is_valid:
                    s, e = (np.asarray(found.values.field(i), dtype=np.int64) for i in (0, 1))
                    left, gone, spans = cut_out(text, s, e, length)
                else:
                    left, gone, spans = text, 0, 0
                out.append({"left": left, "n_bytes": len(text), "n_removed": gone, "n_spans": spans})
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(out, kind)], names=schema.names)

    return clean.unionByName(hit.mapInArrow(run, schema))


def clean(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without repeated passages; columns as in ``docs``.

    A character that a cut goes through goes as a whole. ``n_chars`` follows the text; a
    document that is all repeats stays with an empty text.
    """
    text_col = how.get("text_col", "text")
    own = free_name(docs, "_own")
    had = {c: own for c in docs.columns if c.lower() == "cut"}
    got = remove_repeats(docs.withColumnsRenamed(had), **how)
    ship_package(docs.sparkSession)
    text = F.when(F.col("cut.n_removed") > 0, whole_characters(F.col("cut.left")))
    new = []
    for c in docs.columns:
        old = col(had.get(c, c))
        if c == text_col:
            old = F.coalesce(text, old)
        elif c == "n_chars":
            old = F.coalesce(F.length(text).cast(docs.schema[c].dataType), old)
        new.append(old.alias(c))
    return got.select(*new)


def whole_characters(data):
    """Binary column as a string, without the bytes that are no whole character.

    Replacement characters that the text has itself are kept: they are written as an escape
    of two characters while the broken bytes are found.
    """
    mark, own, kept = "\ue000", "\ufffd", F.lit
    text = F.replace(F.replace(data.cast("string"), kept(mark), kept(mark + "a")), kept(own), kept(mark + "b"))
    text = F.replace(F.make_valid_utf8(text), kept(own), kept(""))
    return F.replace(F.replace(text, kept(mark + "b"), kept(own)), kept(mark + "a"), kept(mark))
