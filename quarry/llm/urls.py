"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed in bulk.

The rules are compiled once into one file: sorted xxhash64 keys of the rule strings
(``host + path``), their offsets and the strings themselves. ``SparkContext.addFile``
copies it to every executor, whose Python workers map it read-only, so all workers of a
machine share one copy and its size is bounded by disk, not by a worker's memory.

A URL is judged by its candidates: every suffix of its host at a dot, with every prefix
of its path whose length some rule has. The candidates of a batch are hashed and probed
with one binary search; hits are confirmed against the stored string, so a collision of
digests never decides. The longest confirmed rule wins; without one the URL gets the
``default`` verdict, because a membership filter has nothing against it.

Nulls and urls without ``://`` have empty host and path and so fit no rule. Repeated rows
are judged alike, empty tables give empty results.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import col, free_name

MAGIC = b"URLRULE1"


def compile_rules(rules) -> bytes:
    """``(host, path, verdict)`` rules as one mappable blob.

    Layout: magic, number of rules, number of path lengths, path lengths, sorted keys,
    offsets, verdict flags (1 = block), strings. Repeated rules: the last one counts.
    """
    table = {(h.lower() + p).encode(): v for h, p, v in rules}
    lengths = sorted({len(p.encode()) for _, p, _ in rules})
    rows = sorted((xxhash.xxh64_intdigest(s), s, v) for s, v in table.items())
    keys = np.array([k for k, _, _ in rows], dtype="<u8")
    offs = np.cumsum([0] + [len(s) for _, s, _ in rows]).astype("<u8")
    flags = np.array([v == "block" for _, _, v in rows], dtype="u1")
    return b"".join([MAGIC, struct.pack("<QQ", len(rows), len(lengths)),
                     np.array(lengths, dtype="<u8").tobytes(), keys.tobytes(), offs.tobytes(),
                     flags.tobytes(), *(s for _, s, _ in rows)])


class RuleArray:
    """A compiled rule file, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype="u1", mode="r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not a rule file")
        n, m = struct.unpack("<QQ", raw[8:24].tobytes())
        at = 24
        self.lengths = raw[at:at + 8 * m].view("<u8").tolist()
        at += 8 * m
        self.keys = raw[at:at + 8 * n].view("<u8")
        at += 8 * n
        self.offs = raw[at:at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.flags = raw[at:at + n]
        self.strings = raw[at + n:]

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """Rule number of each candidate, -1 where no stored string equals it."""
        out = np.full(len(candidates), -1, dtype=np.int64)
        if not len(self.keys) or not candidates:
            return out
        h = np.fromiter(map(xxhash.xxh64_intdigest, candidates), dtype=np.uint64, count=len(candidates))
        at = np.searchsorted(self.keys, h, side="left")
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == h):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == h[i]:  # equal digests lie together
                if self.strings[int(self.offs[j]):int(self.offs[j + 1])].tobytes() == candidates[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[str, str] | None]:
        """(rule, verdict) of each host and path, None where no rule fits."""
        cands: list[bytes] = []
        owner: list[int] = []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            tails = [p[:n] for n in self.lengths if n <= len(p)]
            while h:
                cands += [h + t for t in tails]
                owner += [i] * len(tails)
                h = h.partition(b".")[2]
        best: dict[int, int] = {}
        for i, c, r in zip(owner, cands, self.probe(cands).tolist(), strict=True):
            if r >= 0 and (i not in best or len(c) > int(self.offs[best[i] + 1] - self.offs[best[i]])):
                best[i] = r
        return [None if (r := best.get(i)) is None else
                (self.strings[int(self.offs[r]):int(self.offs[r + 1])].tobytes().decode(),
                 "block" if self.flags[r] else "allow") for i in range(len(hosts))]


def host_and_path(url):
    """Columns (host, path) of a URL column; see the module docstring for empty ones."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict columns.

    Columns of ``pages`` with one of these names are replaced.
    """
    spark = pages.sparkSession
    ship_package(spark)
    name = f"rules-{uuid.uuid4().hex[:12]}.bin"
    local = os.path.join(tempfile.mkdtemp(prefix="quarry-rules-"), name)
    with open(local, "wb") as f:
        f.write(compile_rules(list(rules)))
    spark.sparkContext.addFile(local)

    host, path = host_and_path(col(url_col).cast("string"))
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    df = pages.select(*[col(c) for c in pages.columns], host.alias(h := free_name(pages, "_h")),
                      path.alias(p := free_name(pages, "_p"))).select(
        *[col(c) for c in keep], col(h).alias("host"), col(p).alias("path"))
    schema = T.StructType([*df.schema.fields, T.StructField("rule", T.StringType()),
                           T.StructField("verdict", T.StringType())])

    def run(batches):
        array = RuleArray(SparkFiles.get(name))
        for b in batches:
            hosts, paths = (b.column(i).cast(pa.binary()).to_pylist() for i in (b.num_columns - 2, b.num_columns - 1))
            said = array.judge(hosts, paths)
            extra = [pa.array([s and s[0] for s in said], pa.string()),
                     pa.array([s[1] if s else default for s in said], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "rule", "verdict"])

    return df.mapInArrow(run, schema)
