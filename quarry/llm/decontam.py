"""Benchmark decontamination by spaced seeds.

Texts and benchmark items are cut into words (runs of letters and digits, lower case; in
scripts that set no blanks between words each character is one).
A seed mask looks at 5 of up to 10 neighbouring words and ignores the others, so a
replaced word hides a passage only if it meets a looked-at position; the masks together
hit every passage of 13 words with any 2 replaced, and of 16 words with any 3. Items of 5 to
12 words have two masks of 3 words, which hit whatever the check accepts of them. Hashes of
all masked windows of the items are joined with those of the texts: a task probes its
windows against a bit table and then the sorted array of the items' hashes. Around each
hit the item is laid over the text on that diagonal, and the overlap counts if at least
``min_words`` words in a row (the whole item, if it is shorter) agree in ``similarity`` or
more of their places.

The benchmark is the small side and is broadcast in parts of at most ``part_words`` words
(one longer item: a part of its own); each part is one more step over the texts in the same
pass, so any size is covered exactly, and no text is shuffled.

Null and empty texts are clean, as are items of fewer than 5 words, which name nothing.
Item ids may have any type and be null; rows that share an id are one item, found if any of
them is. Repeated rows are judged alike. Empty tables: nothing is contaminated.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship_package
from .common import blobs, col, free_name

#: Word places that a seed looks at.
MASKS = [(0, 1, 3, 5, 6), (0, 3, 7, 8, 9), (0, 1, 4, 6, 9)]
#: The same for items of fewer than WHOLE words, which are compared as a whole.
SHORT = [(0, 1, 2), (0, 1, 3)]
LEAST, WHOLE = 5, 13

_ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_WORD = regex.compile(rf"(?V1)[[\p{{L}}\p{{N}}]&&[{_ALONE}]]|[[\p{{L}}\p{{N}}]--[{_ALONE}]]+")


#: All scripts of ``_ALONE`` lie from here on; texts below it need no look at scripts.
_FIRST_ALONE = "\u0e00"
_PLAIN = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (_WORD if max(text, default="") >= _FIRST_ALONE else _PLAIN).findall(text)


def seeds_at(tokens: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Hash of the masked window that starts at each place (as many as fit)."""
    n = max(0, len(tokens) - mask[-1])
    h = np.full(n, salt + 1, dtype=np.uint64)
    for c in mask:
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[c:c + n]
        h ^= h >> np.uint64(29)
    return h


class Probe:
    """Seeds of a part of the benchmark, and the check around a hit."""

    def __init__(self, items: list[tuple], min_words: int, similarity: float):
        self.min_words, self.similarity = min_words, similarity
        cut = [(i, w) for i, t in items if len(w := words_of(t)) >= LEAST]
        self.hash = {w: xxhash.xxh64_intdigest(w.encode(), 1) | 1 for _, ws in cut for w in ws}
        self.ids = [i for i, _ in cut]
        self.tokens = [np.array([self.hash[w] for w in ws], dtype=np.uint64) for _, ws in cut]
        seeds, item, place = [], [], []
        lengths = {len(t) < WHOLE for t in self.tokens}
        self.masks = [*(MASKS if False in lengths else []), *(SHORT if True in lengths else [])]
        for k, t in enumerate(self.tokens):
            for m, mask in enumerate(self.masks):
                if (mask in SHORT) != (len(t) < WHOLE):
                    continue
                h = seeds_at(t, mask, m)
                seeds.append(h)
                item.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        h = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.seeds = h[order]
        self.item = (np.concatenate(item) if item else np.empty(0, np.int64))[order]
        self.place = (np.concatenate(place) if place else np.empty(0, np.int64))[order]
        self.shift = np.uint64(64 - max(16, int(len(h) * 64).bit_length()))
        self.table = np.zeros(1 << int(64 - self.shift), dtype=bool)
        self.table[self.seeds >> self.shift] = True

    def overlap(self, eq: np.ndarray, whole: int) -> int:
        """Words of the longest run of places that agree well enough, 0 if none does."""
        need = min(self.min_words, whole)
        if len(eq) < need:
            return 0
        s = np.r_[0.0, np.cumsum(eq - self.similarity)]
        low = np.minimum.accumulate(s)
        for n in range(len(eq), need - 1, -1):  # longest first; most overlaps are found at once
            if (s[n:] >= s[:len(s) - n] - 1e-9).any():
                return n
            if not (s[need:] >= low[:len(s) - need] - 1e-9).any():
                return 0
        return 0

    def check(self, texts: list[str]) -> list[dict]:
        """For each text {item id: longest overlap}."""
        found: list[dict] = [{} for _ in texts]
        if not len(self.seeds):
            return found
        get = self.hash.get
        gap = MASKS[1][-1] + 1
        parts, starts, at = [], [], 0
        for t in texts:
            ws = words_of(t)
            parts.append(np.fromiter((get(w, 0) for w in ws), dtype=np.uint64, count=len(ws)))
            parts.append(np.zeros(gap, dtype=np.uint64))
            starts.append(at)
            at += len(ws) + gap
        tokens, begin = np.concatenate(parts), np.array([*starts, at])
        seen = set()
        for m, mask in enumerate(self.masks):
            h = seeds_at(tokens, mask, m)
            maybe = np.flatnonzero(self.table[h >> self.shift])
            lo = np.searchsorted(self.seeds, h[maybe], side="left")
            hi = np.searchsorted(self.seeds, h[maybe], side="right")
            hit = hi > lo
            maybe, lo, n = maybe[hit], lo[hit], (hi - lo)[hit]
            entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = np.repeat(maybe, n)
            doc = np.searchsorted(begin, where, side="right") - 1
            seen.update(zip(doc.tolist(), self.item[entry].tolist(), (where - self.place[entry]).tolist(), strict=True))
        for doc, k, start in seen:
            item = self.tokens[k]
            a, b = max(start, int(begin[doc])), min(start + len(item), int(begin[doc + 1]) - gap)
            n = self.overlap(tokens[a:b] == item[a - start:b - start], len(item))
            if n and n > found[doc].get(self.ids[k], 0):
                found[doc][self.ids[k]] = n
        return found


_PROBES: dict = {}


def probe_of(key: str, items, min_words: int, similarity: float) -> Probe:
    """The probe of this worker process, built by its first task; one is kept."""
    if key not in _PROBES:
        _PROBES.clear()
        _PROBES[key] = Probe(items.value, min_words, similarity)
    return _PROBES[key]


def benchmark_parts(benchmark: DataFrame, part_words: int, id_col: str, text_col: str):
    """Yields the benchmark's (id, text) rows in parts of about ``part_words`` words; the
    driver holds one part at a time."""
    b = benchmark.filter(col(text_col).isNotNull()).select(
        col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    size = F.greatest(F.size(F.split(F.trim("text"), r"\s+")), (F.length("text") / 8).cast("int"))
    total = b.agg(F.sum(size)).first()[0] or 0
    n = -(-int(total) // part_words)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(max(1, n)))
    for i in range(n):
        yield [tuple(r) for r in b.filter(part == i).collect()]


def merged(old: list[dict], found: dict) -> list[dict]:
    """Items of earlier parts and of this one, longest overlap each, by id."""
    best = {o["item_id"]: o["words"] for o in old}
    for i, n in found.items():
        best[i] = max(n, best.get(i, 0))
    known = sorted((i for i in best if i is not None))
    return [{"item_id": i, "words": best[i]} for i in known + [None] * (None in best)]


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", bench_id: str = "item_id",
         bench_text: str = "text", min_words: int = 13, similarity: float = 0.8,
         part_words: int = 1_000_000) -> DataFrame:
    """``docs`` with ``overlaps``: the benchmark items found in the text (``item_id``, nulls
    last) and the length of the longest overlap in ``words``. A column of that name is replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    keep = [c for c in docs.columns if c.lower() != "overlaps"]
    t = free_name(docs, "_text")
    item = benchmark.select(col(bench_id)).schema[0].dataType
    kind = T.ArrayType(T.StructType([T.StructField("item_id", item), T.StructField("words", T.IntegerType())]))
    arrow = to_arrow_type(kind)
    df = docs.select(*[col(c) for c in keep], F.array().cast(kind).alias("overlaps"),
                     col(text_col).cast("string").cast("binary").alias(t))

    def step(key, items):
        def run(batches):
            probe = probe_of(key, items, min_words, similarity)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    k = b.num_columns
                    got = probe.check([x.decode("utf-8", "replace") for x in blobs(b.column(k - 1))])
                    old = b.column(k - 2).to_pylist()
                    new = pa.array([merged(o, g) for o, g in zip(old, got, strict=True)], arrow)
                    yield pa.RecordBatch.from_arrays([*b.columns[:k - 2], new, b.column(k - 1)], names=b.schema.names)
        return run

    for part in benchmark_parts(benchmark, part_words, bench_id, bench_text):
        df = df.mapInArrow(step(uuid.uuid4().hex, spark.sparkContext.broadcast(part)), df.schema)
    return df.drop(t)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without an overlap; columns as in ``docs``."""
    name = free_name(docs, "_own")
    had = {c: name for c in docs.columns if c.lower() == "overlaps"}
    kept = mark(docs.withColumnsRenamed(had), benchmark, **how).filter(F.size("overlaps") == 0).drop("overlaps")
    return kept.withColumnsRenamed({v: k for k, v in had.items()})
