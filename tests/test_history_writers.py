"""History helpers, target projection (F21 F38 K10), log defaults (F41) and row writers."""

import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import batch as B
from quarry.operators import history as H
from quarry.operators import writers as W
from quarry.schema import RECORDS


def logs_df(spark):
    rows = [(1, "a", "2024-01-01 10:00:00", "Success", 3), (2, "b", "2024-01-02 10:00:00", "Partial", 0),
            (3, "c", "2024-01-02 10:00:00", "RolledBack", 2)]
    return spark.createDataFrame(rows, "id long, file_name string, t string, status string, n_question_ids long") \
        .withColumn("import_time", F.to_timestamp("t")).drop("t")


def test_get_logs_clamps_and_ties(spark):
    lg = logs_df(spark)
    assert [r["id"] for r in H.get_logs(lg, per_page=0, offset=-4).collect()] == [3]
    assert [r["id"] for r in H.get_logs(lg, per_page=2, offset=1).collect()] == [2, 1]
    assert H.page_count(lg, 2).first()["pages"] == 2


def test_update_and_safe_delete(spark):
    lg = logs_df(spark)
    assert H.update_log_fields(lg, 0, {"status": "x"}) is None
    up = {r["id"]: r["status"] for r in H.update_log_fields(lg, 2, {"status": "RolledBack"}).collect()}
    assert up == {1: "Success", 2: "RolledBack", 3: "RolledBack"}
    assert H.safe_delete(lg, {}) is None
    rem, cnt = H.safe_delete(lg, {"status": "RolledBack", "id": 3})
    assert rem.count() == 2 and cnt.first()["deleted"] == 1


def test_log_defaults(spark):
    df = spark.createDataFrame([(5, "<b>f.csv</b>", None, "abc", None, None)],
                               "id long, file_name string, quiz_name string, quiz_id string, status string, "
                               "total_rows string")
    r = H.log_defaults(df).first()
    assert (r["file_name"], r["quiz_name"], r["quiz_id"], r["status"], r["total_rows"]) == \
        ("f.csv", "", 0, "pending", 0)


def test_target_projection_and_unwritable(spark):
    pairs = dict(B.writable_columns(["id", "quizid", "cat", "answer_one", "nothing"]))
    assert pairs == {"quizid": "quiz_id", "cat": "category", "answer_one": "answer_one"}
    assert B.writable_columns(["foo"]) == []
    df = spark.createDataFrame([(1, 2, "ok", None, None, None), (1, 3, "missing_question", "m", "error", "E1")],
                               "import_id long, orig_row long, row_status string, message string, "
                               "severity string, code string")
    out = {r["orig_row"]: r for r in B.fail_unwritable(df, ["foo"]).collect()}
    assert out[2]["row_status"] == "no_columns" and out[2]["code2"] == "E4"
    assert out[2]["message2"] == "Row 2: no writable columns found in the target table. Skipped."
    assert out[3]["code"] == "E1" and out[3]["code2"] is None


def records(spark):
    rows = [(1, i, i + 1, [(0, "question", q), (1, "option1", "a")]) for i, q in
            enumerate(["q0", "   ", "q2", "q3", "q4", "q5"])]
    return spark.createDataFrame(rows, RECORDS)


def test_builtin_and_missing_writer(spark):
    out = W.process_rows(records(spark))
    s = W.processor_summary(out).first()
    assert (s["imported_rows"], s["failed_rows"], s["total_rows"]) == (5, 1, 6)
    msgs = [r["message"] for r in out.filter(F.col("status") == "failed").collect()]
    assert msgs == ["Row 2: missing required question text."]
    none = W.processor_summary(W.process_rows(records(spark), writer=None)).first()
    assert (none["imported_rows"], none["failed_rows"]) == (0, 6)


def test_custom_writer_classification(spark):
    # defined inside the test so the worker receives it by value
    def custom_writer(batches):
        """A user writer; results cover every F36 branch."""
        for pdf in batches:
            res = []
            for rec in pdf["rec_no"]:
                kind = rec % 5
                if kind == 0:
                    res.append((True, "41", None))          # numeric id -> imported with id
                elif kind == 2:
                    res.append((None, None, "db down"))     # error -> failed with message
                elif kind == 3:
                    res.append((False, None, None))         # false -> failed, "Insertion failed"
                elif kind == 4:
                    res.append((True, None, None))          # truthy -> imported without id
                else:
                    res.append((None, None, None))          # nothing -> unknown result
            yield pd.DataFrame({"import_id": pdf["import_id"], "rec_no": pdf["rec_no"],
                                "ok": [r[0] for r in res], "id": [r[1] for r in res], "error": [r[2] for r in res]})

    out = {r["rec_no"]: r for r in W.process_rows(records(spark), writer=custom_writer).collect()}
    assert out[0]["status"] == "imported" and out[0]["id"] == 41
    assert out[2]["message"] == "Row 3: db down"
    assert out[3]["message"] == "Row 4: Insertion failed"
    assert out[4]["status"] == "imported" and out[4]["id"] is None
    assert out[5]["status"] == "imported" and out[5]["id"] == 41
    assert out[1]["message"] == "Row 2: missing required question text."
