"""Calls of row writers that are kept: broken runs, failing batches, repeats, odd input."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import ledger as L
from quarry.operators import writers as W
from quarry.schema import RECORDS


def records(spark, n=24, text="q"):
    rows = [(1 + i % 2, i, i + 2, [(0, "question", f"{text}{i}"), (1, "option1", "a")]) for i in range(n)]
    return spark.createDataFrame(rows, RECORDS)


def noting(path, crash_at=None, folder=None, refuse=None):
    """A writer that notes every call in a file; at one record its process dies, but only
    after other tasks have ended."""
    def writer(frames):
        import os
        import time

        import pandas as pd

        for part in frames:
            for imp, rec in zip(part["import_id"], part["rec_no"]):
                if rec == crash_at:
                    end = time.time() + 60
                    while time.time() < end and not (os.path.isdir(folder) and any(f.startswith("part-") for f in os.listdir(folder))):
                        time.sleep(0.1)
                    os._exit(1)
                with open(path, "a") as f:
                    f.write(f"{rec}\n")
                if refuse is not None and rec == refuse:
                    raise ValueError("disk full")
                yield pd.DataFrame({"import_id": [imp], "rec_no": [rec], "ok": [True], "id": [str(100 + rec)], "error": [None]})
    return writer


def called(path):
    return sorted(int(x) for x in path.read_text().split()) if path.exists() else []


def test_a_broken_run_keeps_what_it_finished(spark, tmp_path):
    root, first, second = str(tmp_path / "wh"), tmp_path / "first", tmp_path / "second"
    breaking = noting(str(first), crash_at=7, folder=L._folder(root, "k/1"))
    with pytest.raises(Exception, match="crashed|exited|aborted"):
        L.process_once(spark, root, "k/1", records(spark), breaking, rows_per_task=1)
    kept = sorted(r["rec_no"] for r in L.calls(spark, root, "k/1").collect())
    assert kept and 7 not in kept and set(kept) <= set(called(first))
    out = L.process_once(spark, root, "k/1", records(spark), noting(str(second)), rows_per_task=1)
    assert called(second) == sorted(set(range(24)) - set(kept))  # the others, once each
    assert {(r["rec_no"], r["status"], r["id"]) for r in out.collect()} == {(i, "imported", 100 + i) for i in range(24)}
    out.count()
    L.process_once(spark, root, "k/1", records(spark), noting(str(second)))
    assert len(called(second)) == 24 - len(kept)  # neither actions nor a repeat call anything
    L.process_once(spark, root, "other", records(spark), noting(str(second)))
    assert len(called(second)) == 48 - len(kept)  # another key is other work


def test_a_failing_batch_is_row_errors(spark, tmp_path):
    root, log = str(tmp_path / "wh"), tmp_path / "log"
    out = L.process_once(spark, root, "k", records(spark).repartition(1), noting(str(log), refuse=5), rows_per_task=100)
    rows = {r["rec_no"]: r for r in out.collect()}
    calls = called(log)
    assert len(calls) == len(set(calls)) and 5 in calls  # none was handed over twice
    bad = set(range(24)) - (set(calls) - {5})
    assert {k for k, r in rows.items() if r["status"] == "failed"} == bad
    assert {rows[k]["message"] for k in bad} == {f"Row {k + 1}: disk full" for k in bad}
    # failed rows are finished, unless asked for
    L.process_once(spark, root, "k", records(spark), noting(str(log)))
    assert called(log) == calls
    again = L.process_once(spark, root, "k", records(spark), noting(str(log)), retry_failed=True)
    assert again.filter("status = 'imported'").count() == 24
    assert {r["rec_no"] for r in again.filter("attempt = 2").collect()} == bad
    assert sorted(called(log)) == sorted([*calls, *bad])


def test_changed_repeated_null_and_empty_input(spark, tmp_path):
    root, log = str(tmp_path / "wh"), tmp_path / "log"
    twice = records(spark, 4).unionByName(records(spark, 4))
    assert L.process_once(spark, root, "k", twice, noting(str(log))).count() == 4 and called(log) == [0, 1, 2, 3]
    changed = records(spark, 4).withColumn("cells", F.when(F.col("rec_no") == 2, F.transform(
        "cells", lambda c: c.withField("value", F.lit("new")))).otherwise(F.col("cells")))
    assert L.process_once(spark, root, "k", changed, noting(str(log))).count() == 4
    assert called(log) == [0, 1, 2, 2, 3]
    assert L.process_once(spark, root, "none", records(spark, 0), noting(str(log))).count() == 0
    odd = spark.createDataFrame([(None, 9, 11, [(0, "question", "q")]), (None, 10, 12, [(0, "question", " "), (1, "option1", "a")]),
                                 (1, 11, 13, [(0, "question", "")]), (1, 12, 14, [(0, "question", "x" * 300_000)])],
                                "import_id long, rec_no long, orig_row long, cells array<struct<pos:int,key:string,value:string>>")
    got = {r["rec_no"]: (r["import_id"], r["status"], r["id"], r["attempt"])
           for r in L.process_once(spark, root, "odd", odd, noting(str(log))).collect()}
    assert set(got) == {9, 10, 12} and got[9][:3] == (None, "imported", 109) and got[12][:3] == (1, "imported", 112)
    assert got[10] == (None, "failed", None, None)
    with pytest.raises(ValueError):
        L.process_once(spark, root, "k", records(spark), W.Writers())
