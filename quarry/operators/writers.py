"""Library processor path (F05, F11, F36, A07, U01-U03): rows handed to a row writer.

A writer is either the built-in table sink (ids assigned like W01), ``None`` (every
row fails with the no-writer error, U03), or a registry of up to two user functions, of
which the first that is set is used (U01 the insert function, U02 the hook). A user
function gets an iterator of pandas frames with ``import_id, rec_no, cells`` and yields
frames with ``import_id, rec_no, ok, id, error`` (the result F36 classifies). A frame
whose call raises is handed over again row by row, so an exception becomes the error of
the row that caused it; a writer should therefore tolerate a row twice.

Keys are compared after case folding, as everywhere in this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import (MSG_PROC_FAILED, MSG_PROC_MISSING_QUESTION, MSG_PROC_NO_WRITER,
                                   MSG_PROC_UNKNOWN)
from . import batch as B
from .rows import cell, fold_keys, has_content, let

BUILTIN = "builtin"
RESULT_COLUMNS = ["import_id", "rec_no", "ok", "id", "error"]


@dataclass(frozen=True)
class Writers:
    """The insert function, and the hook that is used if there is none."""

    insert: Callable[[Iterator], Iterator] | None = None
    hook: Callable[[Iterator], Iterator] | None = None

    def chosen(self) -> Callable[[Iterator], Iterator] | None:
        return self.insert or self.hook


def _singly(writer):
    """Results for a frame; if the call raises, its rows are handed over again one by one."""
    import pandas as pd

    def results(part):
        try:
            got = list(writer(iter([part[["import_id", "rec_no", "cells"]]])))
            return pd.concat(got) if got else pd.DataFrame(columns=RESULT_COLUMNS)
        except Exception as e:  # any failure of user code is that row's error
            if len(part) > 1:
                return pd.concat([results(part.iloc[i:i + 1]) for i in range(len(part))])
            return part[["import_id", "rec_no"]].assign(ok=None, id=None, error=str(e) or type(e).__name__)

    return results


def beside(part, got, keep: list[str]):
    """Results beside the rows they belong to: the n-th result of a key belongs to its n-th
    row; a row without one stays open (``_merge`` tells which)."""
    left = part[["import_id", "rec_no", *keep]].copy()
    for df in (left, got):
        df["_n"] = df.groupby(["import_id", "rec_no"], dropna=False).cumcount()
    both = left.merge(got[[*RESULT_COLUMNS, "_n"]], on=["import_id", "rec_no", "_n"], how="left", indicator=True)
    both["id"] = both["id"].map(lambda v: None if v is None or v != v else str(v))
    both["error"] = both["error"].map(lambda v: None if v is None or v != v else str(v))
    both["ok"] = both["ok"].map(lambda v: None if v is None or v != v else bool(v))
    return both


def _calls(writer):
    """``mapInPandas`` body: results of ``writer`` beside the rows they belong to."""
    def run(frames):
        results = _singly(writer)
        for part in frames:
            yield beside(part, results(part), ["row_number"])[["import_id", "rec_no", "row_number", "ok", "id", "error"]]

    return run


def _required_ok(cells):
    q = F.coalesce(cell(cells, "question"), cell(cells, "question_text"))
    return ~(q.isNotNull() & ~T.has_visible_text(F.regexp_replace(q, "^\\x{FEFF}", "")))


def checked_rows(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes of rows without question text, rows for a writer); blank rows are skipped."""
    df = fold_keys(records)
    df = df.filter(let(F.col("cells"), has_content))
    df = df.withColumns({"row_number": (F.col("rec_no") + 1).cast("long"),
                         "_req": let(F.col("cells"), _required_ok)})
    failed_req = df.filter(~F.col("_req")).select(
        "import_id", "rec_no", "row_number", F.lit("failed").alias("status"), F.lit(None).cast("long").alias("id"),
        F.format_string(MSG_PROC_MISSING_QUESTION, F.col("row_number")).alias("message"))
    return failed_req, df.filter(F.col("_req"))


def classified(done: DataFrame, *more: str) -> DataFrame:
    """outcomes of the results ``import_id, rec_no, row_number, ok, id, error``; columns
    ``more`` stay."""
    is_id = T.is_numeric(F.col("id")) | F.coalesce(F.col("id").rlike("^[0-9]+$"), F.lit(False))
    status = (F.when(F.col("error").isNotNull() | (F.col("ok") == F.lit(False)), F.lit("failed"))
              .when(is_id, F.lit("imported"))
              .when(F.col("ok") == F.lit(True), F.lit("imported"))
              .otherwise(F.lit("failed")))
    message = (F.when(F.col("error").isNotNull() | (F.col("ok") == F.lit(False)),
                      F.format_string("Row %d: %s", F.col("row_number"),
                                      F.coalesce(F.col("error"), F.lit(MSG_PROC_FAILED))))
               .when(is_id | (F.col("ok") == F.lit(True)), F.lit(None).cast("string"))
               .otherwise(F.format_string(MSG_PROC_UNKNOWN, F.col("row_number"))))
    return done.select("import_id", "rec_no", "row_number", status.alias("status"),
                       F.when(is_id, T.php_intval(F.col("id"))).alias("id"), message.alias("message"), *more)


def process_rows(records: DataFrame, writer: str | Writers | Callable[[Iterator], Iterator] | None = BUILTIN,
                 base: int = 1) -> DataFrame:
    """Per-row outcome of the processor: ``import_id, rec_no, row_number, status, id, message``.

    The frame is lazy: every action on it calls a user function again. ``ledger.process_once``
    calls it once per row."""
    failed_req, todo = checked_rows(records)
    if isinstance(writer, Writers):
        writer = writer.chosen()
    if writer == BUILTIN:
        ided, _ = B.assign_ids(todo.select("import_id", "rec_no", "row_number", F.col("rec_no").alias("orig_row")),
                               base=base)
        done = ided.select("import_id", "rec_no", "row_number", F.lit(True).alias("ok"),
                           F.col("question_id").cast("string").alias("id"), F.lit(None).cast("string").alias("error"))
    elif writer is None:
        done = todo.select("import_id", "rec_no", "row_number", F.lit(False).alias("ok"),
                           F.lit(None).cast("string").alias("id"), F.lit(MSG_PROC_NO_WRITER).alias("error"))
    else:
        done = todo.select("import_id", "rec_no", "row_number", "cells").mapInPandas(
            _calls(writer), "import_id long, rec_no long, row_number long, ok boolean, id string, error string")
    return failed_req.unionByName(classified(done))


def processor_summary(outcomes: DataFrame) -> DataFrame:
    """Imported / failed counts; total is reconciled to their sum."""
    agg = outcomes.groupBy("import_id").agg(
        F.count_if(F.col("status") == "imported").alias("imported_rows"),
        F.count_if(F.col("status") == "failed").alias("failed_rows"),
        F.count_if(F.col("message").isNotNull()).alias("n_errors"))
    return agg.withColumn("total_rows", F.col("imported_rows") + F.col("failed_rows"))
