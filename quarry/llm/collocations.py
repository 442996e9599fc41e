"""Phrase collocations: n-gram counts from FM-indexes over word ids.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words
``[^\\x20\\x09]+``. A phrase of a language is scored by its worst cut into two parts,
``floor(1000000 * a * a / (l * r))`` with a the count of the phrase, l and r those of the
parts, and is dropped where a longer phrase that holds it is at least half as frequent.

**Method.** A task gathers the texts of its input split into shards of ``shard_bytes`` per
language, without a shuffle, and writes them as word ids to the shared folder. A shard is a sequence of word ids with a separator between
pieces, and has two FM-indexes, of the sequence and of its reverse. An index sorts positions
by their next ``depth`` words, which is all that patterns of that length need, and keeps the
Burrows-Wheeler transform with its first-to-last mapping. A phrase has an interval in both;
extending it to the left narrows the interval of the forward index and shifts the other by
the number of smaller left neighbours, extending it to the right does the reverse. All
phrases of a length are extended at once, and every extension comes with its count, so the
phrases of the next length are enumerated exactly. Counts are then summed across shards.

**Scale.** A phrase can only be frequent if all its neighbouring pairs are, so pairs are
counted first, by hash: a shard deals its pairs to buckets as sorted 32-bit hashes with
counts clipped at ``min_count``, a bucket adds them up and answers each shard with one bit
a pair. Shards then extend intervals only where the new pair's bit is set, and return
phrases as text, packed and compressed by bucket, which are summed exactly. Equal hashes only
let a rare pair through. The
number of buckets follows the size of the texts, so a bucket is bounded and a shard's rows to
buckets are never more than its pairs. A phrase that is in every text costs one row a shard.
What follows works on phrases of at least ``min_count``, with every part they need among
them. Memory is a shard; a text longer than that is indexed in parts that overlap by
``depth - 1`` words, and what lies inside an overlap is taken off again.

**Defined cases.** A null text is empty, a null language is ``und``. Repeated rows count each
time. Phrases that tie in score and count go by their bytes. A language with no word, or
without candidates, has no rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import blobs, col, staged

#: Bytes to bytes: A-Z to lower case, what ends a piece to a point, tab to blank.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
END = b"."
#: Text whose pairs share a bucket.
BUCKET_BYTES = 16 << 20
GRAMS = "lang string, phrase string, words int, count long"
PACKED = "bucket int, grams binary"


def words_of(data: bytes) -> list[bytes]:
    """Words of a text, with ``END`` where a piece ends."""
    return data.translate(FOLD).replace(END, b" . ").split()


class FMIndex:
    """Intervals of the positions of ``ids`` sorted by their next ``depth`` symbols.

    Symbols are 0 to ``size`` - 1, 0 ends a piece. ``start[c]`` is the first row of symbol c,
    ``before[i]`` the symbol left of row i's position (the transform), ``back[i]`` the row of
    the position one to the left, up to order among rows with equal context.
    """

    def __init__(self, ids: np.ndarray, size: int, depth: int):
        n = len(ids)
        key, span = ids.astype(np.int64), size
        for d in range(1, depth):
            if span > 2**62 // size:
                key = np.unique(key, return_inverse=True)[1]
                span = int(key.max()) + 1
            key, span = key * size + np.concatenate([ids[d:], np.zeros(min(d, n), ids.dtype)]), span * size
        order = np.argsort(key)
        self.before = ids[order - 1]  # the sequence ends with 0, which also stands before its start
        self.start = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=size))])
        by_symbol = np.sort(self.before.astype(np.int64) << 32 | np.arange(n)) & 0xFFFFFFFF
        self.back = np.empty(n, np.int64)
        self.back[by_symbol] = np.arange(n)

    def extend(self, lo: np.ndarray, n: np.ndarray):
        """All extensions of the intervals: (owner, symbol, row, count, smaller).

        ``row`` starts the new interval here; ``smaller`` counts the occurrences of the
        owner with a smaller neighbour, by which its interval in the other index moves.
        """
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        rows = np.arange(ends[-1] if len(n) else 0) + np.repeat(lo - (ends - n), n)
        order = np.argsort(owner * len(self.start) + self.before[rows], kind="stable")
        who, symbol = owner[order], self.before[rows[order]]
        new = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (symbol[1:] != symbol[:-1])])[:len(who)])
        count = np.diff(np.append(new, len(who)))
        return who[new], symbol[new], self.back[rows[order[new]]], count, new - (ends - n)[who[new]]


def grams_of(ids: np.ndarray, size: int, depth: int, alive=None):
    """(word columns, counts) of the phrases of 1 to ``depth`` words, one pair per length.

    Lengths grow by a word to the right and to the left in turn. ``alive`` gets the pairs
    and answers which may be extended; without it all are.
    """
    ids = np.append(ids, 0)
    ahead = FMIndex(ids, size, depth)
    turned = FMIndex(np.append(ids[-2::-1], 0), size, depth)
    count = np.diff(ahead.start)[1:]
    words = [np.flatnonzero(count) + 1]
    # first rows in the index over the sequence and in that over its reverse
    lo = rev = ahead.start[words[0]]
    count = count[words[0] - 1]
    yield words, count
    good = None
    for length in range(2, depth + 1):
        right = length % 2 == 0
        index, here, there = (turned, rev, lo) if right else (ahead, lo, rev)
        owner, symbol, row, count, smaller = index.extend(here, count)
        keep = symbol > 0
        if good is not None:
            pair = (words[-1][owner], symbol) if right else (symbol, words[0][owner])
            keep &= np.isin(pair[0] * size + pair[1], good)
        owner, symbol, row, count = owner[keep], symbol[keep], row[keep], count[keep]
        moved = there[owner] + smaller[keep]
        lo, rev = (moved, row) if right else (row, moved)
        words = [w[owner] for w in words]
        words = [*words, symbol.astype(np.int64)] if right else [symbol.astype(np.int64), *words]
        if length == 2 and alive is not None:
            ok = alive(*words)
            words, count, lo, rev = [w[ok] for w in words], count[ok], lo[ok], rev[ok]
            good = np.sort(words[0] * size + words[1])
        yield words, count


def word_hashes(lang: str, names: list[bytes]) -> np.ndarray:
    seed = lang.encode() + b"\0"
    return np.array([0, *(xxhash.xxh64_intdigest(seed + w) for w in names[1:])], np.uint64)


def pair_hashes(lang: str, names: list[bytes], left: np.ndarray, right: np.ndarray, buckets: int):
    """(bucket, 32-bit hash) of pairs of words, the same in every shard of a language."""
    h = word_hashes(lang, names)
    mixed = (h[left] * np.uint64(0x9E3779B97F4A7C15) + (h[right] << np.uint64(31) | h[right] >> np.uint64(33)))
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    high, low = mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF)
    return (high * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), low.astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress where the high ones are zero."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


SHARD = ("shard string, lang string, sign int, ids binary, names array<binary>, bucket int, hashes binary, "
         "counts binary")


def shard_batches(lang: str, words: list[bytes], depth: int, min_count: int, buckets: int, sign: int = 1):
    """A shard as one row with its ids and, for longer phrases, one row per bucket of its pairs."""
    column = pa.array(words, pa.binary()).dictionary_encode()
    names = column.dictionary.to_pylist()
    ids, first = column.indices.to_numpy().astype(np.int32) + 1, names.index(END) if END in names else -1
    if first >= 0:  # the end of a piece has symbol 0, the others keep theirs
        ids[ids == first + 1] = 0
    del column
    shard, names = uuid.uuid4().hex, [b"", *names]
    schema = pa.schema([("shard", pa.string()), ("lang", pa.string()), ("sign", pa.int32()), ("ids", pa.binary()),
                        ("names", pa.list_(pa.binary())), ("bucket", pa.int32()), ("hashes", pa.binary()),
                        ("counts", pa.binary())])
    none = dict.fromkeys(schema.names) | {"shard": shard, "lang": lang}
    yield pa.RecordBatch.from_pylist([none | {"sign": sign, "ids": pack(ids), "names": names}], schema)
    if depth < 3:
        return
    *_, ((left, right), count) = grams_of(ids, len(names), 2)
    bucket, low = pair_hashes(lang, names, left, right, buckets)
    order = np.argsort(bucket << 32 | low)
    bucket, low, count = bucket[order], low[order], np.minimum(count[order], min_count) * (sign > 0)
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)[:len(bucket)]) + 1
    rows = [none | {"bucket": int(bucket[i]), "hashes": pack(np.diff(low[i:j], prepend=0)), "counts": pack(count[i:j])}
            for i, j in zip([0, *ends[:-1]], ends, strict=False) if j > i]
    yield pa.RecordBatch.from_pylist(rows, schema)


def shards(lang: str, texts: list[bytes], shard_bytes: int, *how):
    """Rows of ``texts``; together they are at most one shard, or a single longer text."""
    if len(texts) > 1 or len(texts[0]) <= shard_bytes:
        yield from shard_batches(lang, words_of(b".".join(texts)), *how)
        return
    data, at, carry, depth = texts[0], 0, [], how[0]
    while at < len(data):
        end = data.find(b" ", at + shard_bytes)
        end = len(data) if end < 0 else end
        words = carry + words_of(data[at:end])
        yield from shard_batches(lang, words, *how)
        at, carry = end, words[1 - depth:] if depth > 1 else []
        if at < len(data) and carry:  # the next part counts these again
            yield from shard_batches(lang, carry, *how, -1)


def write_shards(docs: DataFrame, shard_bytes: int, depth: int, min_count: int, buckets: int) -> DataFrame:
    """Shards of the texts and their pairs (SHARD), written to the shared folder."""
    how = depth, min_count, buckets

    def run(batches):
        held, size = {}, {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), blobs(b.column(1)), strict=True):
                if len(text) > shard_bytes:
                    yield from shards(lang, [text], shard_bytes, *how)
                elif text:
                    held.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
                    most = max(size, key=size.get) if sum(size.values()) > 4 * shard_bytes else lang
                    if size[most] > shard_bytes or most != lang:
                        size.pop(most)
                        yield from shards(most, held.pop(most), 2 * shard_bytes, *how)
        for lang in list(held):
            yield from shards(lang, held.pop(lang), 2 * shard_bytes, *how)

    return staged(docs.mapInArrow(run, SHARD), "shards")


def frequent_pairs(table: DataFrame, min_count: int) -> DataFrame:
    """(shard, bucket, bits): which pairs of a shard, by hash, reach ``min_count`` in all."""

    def run(group: pa.Table) -> pa.Table:
        low = [np.cumsum(unpack(h)) for h in group.column("hashes").to_pylist()]
        count = np.concatenate([unpack(c) for c in group.column("counts").to_pylist()])
        _, which = np.unique(np.concatenate(low), return_inverse=True)
        alive = (np.bincount(which, weights=count) >= min_count)[which]
        ends = np.cumsum([len(x) for x in low])
        bits = [np.packbits(x).tobytes() for x in np.split(alive, ends[:-1])]
        return pa.table({"shard": group.column("shard"), "bucket": group.column("bucket"), "bits": pa.array(bits, pa.binary())})

    rows = table.filter("bucket is not null").select("shard", "bucket", "hashes", "counts")
    return rows.groupBy("bucket").applyInArrow(run, "shard string, bucket int, bits binary")


def shard_grams(shard: dict, bits: dict, depth: int, buckets: int) -> pa.Table:
    """Phrases (GRAMS) of one shard, packed by bucket; phrase '' counts the words."""
    names, lang, sign = shard["names"], shard["lang"], shard["sign"]
    ids = unpack(shard["ids"]).astype(np.int32)
    hashes = word_hashes(lang, names)

    def alive(left, right):
        bucket, low = pair_hashes(lang, names, left, right, buckets)
        order, ok = np.argsort(bucket << 32 | low), np.empty(len(low), bool)
        n = np.bincount(bucket, minlength=buckets)
        ok[order] = np.concatenate([np.unpackbits(np.frombuffer(bits[k], np.uint8), count=n[k])
                                    for k in np.flatnonzero(n)] or [np.zeros(0, bool)]).astype(bool)
        return ok

    column = pa.array(names, pa.binary())
    tables = [gram_table(lang, pa.array([""]), 0, np.array([np.count_nonzero(ids)]), sign)]
    dealt = [np.zeros(1, np.int64)]
    for got, count in grams_of(ids, len(names), depth, alive if depth > 2 else None):
        parts = [column.take(pa.array(w)) for w in got]
        phrase = pc.binary_join_element_wise(*parts, b" ") if len(parts) > 1 else parts[0]
        tables.append(gram_table(lang, phrase.cast(pa.string()), len(got), count, sign))
        dealt.append(phrase_buckets(hashes, got, buckets))
    return packed(pa.concat_tables(tables), np.concatenate(dealt))


def phrase_buckets(hashes: np.ndarray, words: list[np.ndarray], buckets: int) -> np.ndarray:
    """Bucket of each phrase, the same in every shard of a language."""
    mixed = np.zeros(len(words[0]), np.uint64)
    for w in words:
        mixed = (mixed ^ hashes[w]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def packed(grams: pa.Table, bucket: np.ndarray) -> pa.Table:
    """One row (PACKED) per bucket: its phrases as a compressed Arrow stream."""
    order = np.argsort(bucket, kind="stable")
    grams, bucket = grams.take(pa.array(order)).combine_chunks(), bucket[order]
    ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1
    blobs = []
    for i, j in zip([0, *ends[:-1]], ends, strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, grams.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(grams.slice(i, j - i))
        blobs.append(sink.getvalue().to_pybytes())
    return pa.table([pa.array(bucket[ends - 1], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "grams"])


def summed(group: pa.Table, min_count: int) -> pa.Table:
    """The phrases (GRAMS) of a bucket that reach ``min_count`` in all, and the counts of words."""
    streams = (pa.ipc.open_stream(blob.as_buffer()).read_all() for blob in group.column("grams"))
    # a few streams are added up at a time, so that memory is a bucket's different phrases
    total, held = None, []
    for stream in streams:
        held.append(stream)
        if sum(x.num_rows for x in held) > 1_000_000:
            total, held = added([total, *held]), []
    total = added([total, *held])
    return total.filter(pc.or_(pc.greater_equal(total["count"], min_count), pc.equal(total["words"], 0)))


def added(tables: list[pa.Table | None]) -> pa.Table:
    keys = ["lang", "phrase", "words"]
    total = pa.concat_tables([t for t in tables if t is not None]).group_by(keys).aggregate([("count", "sum")])
    return total.select([*keys, "count_sum"]).rename_columns([*keys, "count"])


def gram_table(lang: str, phrase: pa.Array, words: int, count: np.ndarray, sign: int) -> pa.Table:
    n = len(phrase)
    return pa.table([pa.repeat(pa.scalar(lang), n), phrase, pa.repeat(pa.scalar(words, pa.int32()), n),
                     pa.array(count * sign, pa.int64())], names=["lang", "phrase", "words", "count"])


def gram_counts(docs: DataFrame, depth: int = 3, min_count: int = 10, shard_bytes: int = 8 << 20,
                text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, count) of phrases of up to ``depth`` words; '' counts words.

    All phrases of ``min_count`` are there with their exact counts, and none that is rarer.
    """
    ship_package(docs.sparkSession)
    plain = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, size // BUCKET_BYTES)
    table = write_shards(plain, shard_bytes, depth, min_count, buckets)
    whole = table.filter("ids is not null").select("shard", "lang", "sign", "ids", "names")

    def run(shard: pa.Table, bits: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return pa.table([[], []], schema=pa.schema([("bucket", pa.int32()), ("grams", pa.binary())]))
        found = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
        return shard_grams(shard.to_pylist()[0], found, depth, buckets)

    grams = whole.groupBy("shard").cogroup(frequent_pairs(table, min_count).groupBy("shard")).applyInArrow(run, PACKED)
    return grams.groupBy("bucket").applyInArrow(lambda group: summed(group, min_count), GRAMS)


def part(first: int, n: int) -> Column:
    """``n`` words of ``phrase`` from the one numbered ``first`` (from 1), space-joined."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def collocations(docs: DataFrame, min_count: int = 10, depth: int = 3, share: int = 50, top: int = 2000,
                 shard_bytes: int = 8 << 20, **columns) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language.

    Candidates have 2 to ``depth`` words and a count of at least ``min_count``; one that a
    longer candidate holds with ``share`` per cent of its count is dropped.
    """
    grams = gram_counts(docs, depth, min_count, shard_bytes, **columns)
    grams = staged(grams.filter((F.col("count") >= min_count) | (F.col("words") == 0)), "grams")
    cand = grams.filter("words > 1").withColumnRenamed("count", "a")
    counts = grams.select("lang", F.col("phrase").alias("part"), F.col("count").alias("n_part"))
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    left = counts.withColumnsRenamed({"part": "left", "n_part": "l"})
    right = counts.withColumnsRenamed({"part": "right", "n_part": "r"})
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = (cuts.withColumn("left", part(1, F.col("k"))).withColumn("right", part(F.col("k") + 1, F.col("words")))
            .join(left, ["lang", "left"]).join(right, ["lang", "right"])
            .withColumn("score", F.expr("1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) "
                                        "div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")))
    scored = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the shorter phrases that a candidate covers
    spans = [F.struct(part(i, n).alias("phrase")) for n in range(2, depth) for i in range(1, depth - n + 2)]
    if spans:
        held = [F.when(F.col("words") >= i + n - 1, part(i, n)) for n in range(2, depth) for i in range(1, depth - n + 2)]
        covers = cand.select("lang", "words", F.col("a").alias("longer"), F.explode(F.array(*held)).alias("inside"))
        covers = (covers.filter("inside is not null and size(split(inside, ' ')) < words")
                  .groupBy("lang", "inside").agg(F.max("longer").alias("longer")).withColumnRenamed("inside", "phrase"))
        scored = scored.join(covers, ["lang", "phrase"], "left").filter(
            F.col("longer").isNull() | (100 * wide("longer") < share * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    total = grams.filter("words = 0").select("lang", F.col("count").alias("n"))
    best = (scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
