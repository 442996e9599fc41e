"""Row writers whose calls are kept (U01, U02, K10): a ledger of (run, import, record).

A user function writes somewhere else, so a call can't be taken back. ``process_once`` keeps
the result of every call in a table below ``root/writer_calls/<run key>``; a run of the same
key hands over only rows that have no result yet, and outcomes are read from the table, so no
action on them calls anything.

Each task handles about ``rows_per_task`` rows and publishes its results as one file when it
ends, independent of the other tasks and of the job. What is finished therefore stays finished
when another task, the job, an executor or the driver is lost; a task that breaks off before
its end calls its own rows again, and nothing else is repeated. This needs a file system whose
rename is atomic, and ``spark.speculation`` off.

* A record is known by its import, its number and its cells: a changed record is a new one,
  and a record that comes twice is called once.
* A call that raises ends its batch: results it gave before count, every other row of the
  batch gets the exception as its error. No row of it is handed over again in this run.
* Failed rows are finished, too. ``retry_failed`` hands them over again; the result of the
  last attempt counts.
* Rows without question text fail and blank rows are skipped as in ``process_rows``; neither
  reaches the writer. Null ids and empty tables are ordinary input.

Two sessions mustn't run the same key at the same time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import batch as B
from . import publish
from . import writers as W

CALLS = ("call_key string, import_id long, rec_no long, row_number long, ok boolean, id string, error string, "
         "attempt long")


def _folder(root: str, run_key: str) -> str:
    name = re.sub(r"[^A-Za-z0-9-]", lambda m: f"_{ord(m[0]):x}_", run_key)
    return f"{root.rstrip('/')}/writer_calls/run-{name}"


def calls(spark: SparkSession, root: str, run_key: str) -> DataFrame:
    """Every call of a run that has a result, those of earlier attempts included."""
    path = _folder(root, run_key)
    if not publish.exists(spark, path):
        return spark.createDataFrame([], CALLS)
    return spark.read.schema(CALLS).parquet(path)


def latest_calls(spark: SparkSession, root: str, run_key: str) -> DataFrame:
    """The result of the last attempt per record."""
    fields = ["import_id", "rec_no", "row_number", "ok", "id", "error", "attempt"]
    return calls(spark, root, run_key).groupBy("call_key").agg(
        F.max_by(F.struct(*fields), F.col("attempt")).alias("r")).select("call_key", "r.*")


def _calls_once(writer, attempt: int):
    """``mapInPandas`` body: one call per batch, whose results so far outlive an exception."""
    import pandas as pd

    def run(frames):
        for part in frames:
            got, broke = [], None
            try:
                for frame in writer(iter([part[["import_id", "rec_no", "cells"]]])):
                    got.append(frame)
            except Exception as e:
                broke = str(e) or type(e).__name__
            done = W.beside(part, pd.concat(got) if got else pd.DataFrame(columns=W.RESULT_COLUMNS), ["call_key", "row_number"])
            if broke is not None:
                done.loc[done["_merge"] == "left_only", "error"] = broke
            yield done.assign(attempt=attempt)[["call_key", "import_id", "rec_no", "row_number", "ok", "id", "error", "attempt"]]

    return run


def process_once(spark: SparkSession, root: str, run_key: str, records: DataFrame,
                 writer: W.Writers | Callable[[Iterator], Iterator], retry_failed: bool = False,
                 rows_per_task: int = 10_000) -> DataFrame:
    """Per-row outcome as ``process_rows`` gives it, with ``attempt`` (the number of the run
    that called the row, null for rows that were never handed over)."""
    chosen = writer.chosen() if isinstance(writer, W.Writers) else writer
    if not callable(chosen):
        raise ValueError("the ledger keeps calls of a writer function; use process_rows without one")
    ship_package(spark)
    failed_req, todo = W.checked_rows(records)
    key = F.sha2(F.to_json(F.struct("import_id", "rec_no", "cells")), 256)
    # evaluated once for the count, the calls and the outcomes
    todo = B.materialize(todo.select(key.alias("call_key"), "import_id", "rec_no", "row_number", "cells")
                         .dropDuplicates(["call_key"]))
    finished = latest_calls(spark, root, run_key)
    if retry_failed:
        finished = finished.join(W.classified(finished, "call_key").filter("status = 'imported'"), "call_key", "left_semi")
    left = todo.join(finished.select("call_key"), "call_key", "left_anti")
    n = left.count()
    if n:
        attempt, _ = publish.claim(spark, root)
        # committed task by task: a file moves to the table when its task ends
        (left.repartition(-(-n // rows_per_task), "call_key").mapInPandas(_calls_once(chosen, attempt), CALLS)
         .write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .parquet(_folder(root, run_key)))
    done = latest_calls(spark, root, run_key).join(todo.select("call_key"), "call_key", "left_semi")
    return W.classified(done, "attempt").unionByName(
        failed_req.distinct().withColumn("attempt", F.lit(None).cast("long")))
