"""CSV records from lines (S02): many tasks per file, files of any size.

``spark.read.text`` splits a file at line ends. A line begins either a record or inside a
quoted cell, and which of the two the next line does depends on nothing else, so a line is a
function of two states, and so is a split, the composition of its lines. A quote only opens
a cell at the start of a field; within a bare field it is a character like any other.

Pass one returns a row per split: where it ends and how many records it begins, from either
state. A window over the splits of a file (a constant function forgets what was before, a
swap turns it round) gives every split its state and its first record's number. Pass two
reads the records in each split in place; only a record that crosses splits is put together
from its pieces. The result doesn't depend on the splits.
"""

from __future__ import annotations

import csv
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import DEFAULT_BROADCAST_BYTES, estimated_bytes

#: From a field's start: closed fields, then a quoted cell that doesn't end.
_OPEN = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]++|"")*+\Z')
_QUOTED = re.compile(r'(?:[^"]++|"")*+')
_BARE = re.compile(r"[^,]*+,?+")

SPLITS = "path string, block long, lines long, from_start boolean, n_start long, from_quote boolean, n_quote long"
RECORDS = "path string, block long, rec long, fields array<string>, piece string"


def ends_open(line: str, quoted: bool) -> bool:
    """Whether a quoted cell is open after ``line``, which begins a record or goes on with a cell."""
    if '"' not in line:
        return quoted
    at = 0
    if quoted:
        at = _QUOTED.match(line).end()
        if at == len(line):
            return True
        at = _BARE.match(line, at + 1).end()
        if line[at - 1] != ",":  # the line's last field
            return False
    return _OPEN.match(line, at) is not None


def fed(lines: list[str]):
    yield from (x + "\n" for x in lines[:-1])
    yield lines[-1]


def parse(lines: list[str]) -> list[list[str]]:
    """Records of whole lines. Only a line feed, or CR and line feed, ends a line; a cell that
    is still open at the end of the file ends with its last line."""
    csv.field_size_limit(sys.maxsize)  # cells of any length
    if any("\r" in x[:-1] for x in lines):
        # the reader would end a record here: a character that isn't in the text stands in
        text = "\n".join(lines)
        other = next(chr(c) for c in range(0xF0000, 0xFFFFE) if chr(c) not in text)
        lines = [x[:-1].replace("\r", other) + x[-1:] for x in lines]
        return [[f.replace(other, "\r") for f in r] for r in csv.reader(fed(lines))]
    return list(csv.reader(fed(lines)))


def _runs(batch):
    """(path, block, lines) of consecutive rows of one split."""
    import numpy as np

    if not batch.num_rows:
        return
    path, block = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    which, values = path.indices.to_numpy(), batch.column(2).to_pylist()
    cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(block) != 0)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield path.dictionary[which[i]].as_py(), int(block[i]), [v.decode("utf-8", "replace") for v in values[i:j]]


def _scan(strip_bom: bool):
    """Pass one: a row per split."""
    import pyarrow as pa

    def run(batches):
        held, out = None, []
        for b in batches:
            for path, block, lines in _runs(b):
                if held is None or held[:2] != [path, block]:
                    if held is not None:
                        out.append(held)
                    held = [path, block, 0, False, 0, True, 0]
                    if strip_bom and block == 0:
                        lines[0] = lines[0].removeprefix("\ufeff")
                held[2] += len(lines)
                for from_, n in ((3, 4), (5, 6)):
                    quoted, begun = held[from_], 0
                    for line in lines:
                        begun += not quoted
                        if '"' in line:
                            quoted = ends_open(line, quoted)
                    held[from_], held[n] = quoted, held[n] + begun
        if held is not None:
            out.append(held)
        names = [f.split()[0] for f in SPLITS.split(", ")]
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def _records(strip_bom: bool, batch_lines: int = 4096):
    """Pass two: records that lie in a split, and the pieces of those that don't."""
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("rec", pa.int64()),
                        ("fields", pa.list_(pa.string())), ("piece", pa.string())])

    def run(batches):
        at, quoted, rec, whole, part = None, False, 0, [], []

        def rows(got, piece=None):
            n = len(got)
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()),
                                               pa.array(range(rec, rec + n), pa.int64()), pa.array(got, schema.types[3]),
                                               pa.array([piece] * n, pa.string())], schema=schema)

        def flush():
            nonlocal rec, whole
            if whole:
                got = parse(whole)
                yield rows(got)
                rec, whole = rec + len(got), []

        def end():
            nonlocal part
            yield from flush()
            if part:
                yield rows([None], "\n".join(part))
                part = []

        for b in batches:
            state, before = b.column(3), b.column(4)
            row = 0
            for path, block, lines in _runs(b):
                if at != (path, block):
                    if at is not None:
                        yield from end()
                    at, quoted, rec = (path, block), state[row].as_py(), before[row].as_py()
                    entered = quoted  # in the middle of a record that an earlier split began
                    if entered:
                        rec -= 1
                    if strip_bom and block == 0:
                        lines[0] = lines[0].removeprefix("\ufeff")
                row += len(lines)
                for line in lines:
                    opened = ends_open(line, quoted) if '"' in line else quoted
                    if not opened and not quoted:
                        whole.append(line)
                    else:
                        part.append(line)
                        if quoted and not opened:
                            if entered:
                                yield rows([None], "\n".join(part))
                                rec, entered = rec + 1, False
                            else:
                                whole += part
                            part = []
                    quoted = opened
                    if len(whole) >= batch_lines:
                        yield from flush()
        if at is not None:
            yield from end()

    return run


def _join_pieces():
    import pyarrow as pa

    def run(batches):
        for b in batches:
            got = [parse(t.split("\n"))[0] for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.list_(pa.string()))],
                                             names=["path", "block", "rec", "fields"])

    return run


def split_states(splits: DataFrame) -> DataFrame:
    """Adds ``quoted``, the state at a split's start, and ``before``, the records begun earlier."""
    over = Window.partitionBy("path").orderBy("block")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    constant, swap = F.col("from_start") == F.col("from_quote"), (F.col("from_start") & ~F.col("from_quote")).cast("int")
    s = splits.withColumn("swaps", F.sum(swap).over(over))
    last = F.max(F.when(constant, F.struct("block", F.col("from_start").alias("open"), "swaps"))).over(earlier)
    s = s.withColumn("last", last).withColumn("swapped", F.coalesce(F.sum(swap).over(earlier), F.lit(0)))
    odd = (F.col("swapped") - F.coalesce("last.swaps", F.lit(0))) % 2 == 1
    s = s.withColumn("quoted", F.coalesce("last.open", F.lit(False)) != odd)
    n = F.when(F.col("quoted"), F.col("n_quote")).otherwise(F.col("n_start"))
    return s.select("path", "block", "quoted", F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("before"))


def read_fields(spark: SparkSession, paths: list[str], strip_bom: bool = True) -> DataFrame:
    """(path, rec, fields) of every record of the files; the path is a URI."""
    from ..operators.batch import materialize
    from ..session import ship_package

    ship_package(spark)
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))
    states = materialize(split_states(lines.mapInArrow(_scan(strip_bom), SPLITS)))
    size = estimated_bytes(states)
    if states.count() * 200 <= DEFAULT_BROADCAST_BYTES or size is not None and size <= DEFAULT_BROADCAST_BYTES:
        placed = lines.join(F.broadcast(states), ["path", "block"])  # the lines stay where they are, in order
    else:
        placed = (lines.withColumn("_no", F.monotonically_increasing_id()).join(states.hint("merge"), ["path", "block"])
                  .repartition("path", "block").sortWithinPartitions("path", "block", "_no"))
    found = materialize(placed.select("path", "block", "value", "quoted", "before").mapInArrow(_records(strip_bom), RECORDS))
    pieces = found.filter("piece is not null").groupBy("path", "rec").agg(
        F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("p"))
    joined = pieces.select("path", "block", "rec", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("text"))
    joined = joined.mapInArrow(_join_pieces(), "path string, block long, rec long, fields array<string>")
    return found.filter("piece is null").select("path", "rec", "fields").unionByName(joined.select("path", "rec", "fields"))
