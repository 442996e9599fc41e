"""End to end: files on disk -> import -> tables -> history -> rollback (invariants)."""

import csv
import io
import json

from pyspark.sql import functions as F

from quarry.operators import params as P
from quarry.operators import store as S
from quarry.sources import files as FS
from quarry.sources.xlsx import xlsx_bytes

HEADER = ["question", "option1", "option2", "option3", "correct_answer"]
ROWS = [["Capital of France?", "Paris", "London", "Rome", "paris"],
        ["", "a", "b", "", "1"],
        ["Pick B", "x", "y", "", "B"],
        ["", "", "", "", ""],
        ["No options", "", "", "", ""],
        ["Multi\nline", "one", "two", "three", "zzz"]]


def write_files(d):
    buf = io.StringIO()
    w = csv.writer(buf)
    w.writerow(HEADER)
    w.writerows(ROWS)
    (d / "a.csv").write_text(buf.getvalue())
    (d / "b.json").write_text(json.dumps([dict(zip(HEADER, r)) for r in ROWS]))
    (d / "c.xlsx").write_bytes(xlsx_bytes([HEADER] + ROWS))
    (d / "d.txt").write_text("nope")


def manifest(spark, d):
    rows = [(1, "a.csv", str(d / "a.csv"), {"qsm_quiz": "3", "qsm_category": "2"}, 7, True),
            (2, "b.json", str(d / "b.json"), {"qsm_quiz": "NATION_1", "qsm_points_correct": "5"}, 7, False),
            (3, "c.xlsx", str(d / "c.xlsx"), {"qsm_category": "Geo"}, 7, True),
            (4, "d.txt", str(d / "d.txt"), {}, 7, False)]
    return spark.createDataFrame(rows, "import_id long, file_name string, path string, "
                                       "params map<string,string>, uploader_id long, has_taxonomy boolean")


def test_files_import_history_rollback(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write_files(d)
    man = manifest(spark, d)
    quizzes = spark.createDataFrame([(3, "NATION_3"), (1, "NATION_1")], "quiz_id long, quiz_name string")
    recs, files = FS.read_manifest_files(spark, man)
    fe = {r["import_id"]: r["error"] for r in files.collect()}
    assert fe[4] and fe[1] is None and fe[2] is None and fe[3] is None
    params = P.resolve_params(man, quizzes)
    root = str(tmp_path / "wh")
    S.run_import(spark, root, recs, params, file_errors=files)
    logs = {r["id"]: r for r in S.logs_now(spark, root).collect()}
    assert set(logs) == {1, 2, 3}                       # failed file: no log row (Q18)
    for i in (1, 2, 3):
        lg = logs[i]
        assert lg["total_rows"] == 5 and lg["success_rows"] == 3 and lg["failed_rows"] == 2
        assert lg["total_rows"] == lg["success_rows"] + lg["failed_rows"]
        assert lg["status"] == "Partial"
    q = S.live_questions(spark, root)
    assert q.count() == 9 and q.select("question_id").distinct().count() == 9
    by = {(r["import_id"], r["orig_row"]): r for r in q.collect()}
    assert by[(1, 2)]["correct_answer"] == 1 and by[(1, 4)]["correct_answer"] == 2
    assert by[(1, 2)]["quiz_id"] == 3 and by[(2, 1)]["quiz_id"] == 1  # JSON rows count from 1
    assert by[(2, 1)]["answer_one_points"] == 5.0 and by[(1, 2)]["answer_two_points"] == -0.67
    assert by[(1, 7)]["question_settings"]["question_title"] == "Multi\nline"
    assert by[(3, 2)]["category"] == "Geo" and by[(1, 2)]["category"] == ""
    links = S.live_links(spark, root)
    assert links.count() == 3 and {r["term_id"] for r in links.collect()} == {2}
    # second import continues ids
    assert S.next_id_base(spark, root) == 10
    # rollback import 1 plus invalid requests
    req = spark.createDataFrame([(1,), (0,), (99,)], "log_id long")
    out = {r["log_id"]: r for r in S.rollback(spark, root, req).collect()}
    assert out[1]["outcome"] == "rolled_back" and out[1]["attempted"] == 3 and out[1]["removed"] == 3
    assert out[0]["outcome"] == "invalid_id" and out[99]["outcome"] == "not_found"
    assert S.live_questions(spark, root).filter(F.col("import_id") == 1).count() == 0
    assert S.live_questions(spark, root).count() == 6
    assert S.live_links(spark, root).count() == 0
    assert {r["id"]: r["status"] for r in S.logs_now(spark, root).collect()}[1] == "RolledBack"


def test_dry_run_writes_nothing(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write_files(d)
    man = manifest(spark, d)
    recs, _ = FS.read_manifest_files(spark, man)
    params = P.resolve_params(man, spark.createDataFrame([], "quiz_id long, quiz_name string"))
    root = str(tmp_path / "wh")
    rep = S.run_import(spark, root, recs, params, dry_run=True)["report"]
    r = {x["import_id"]: x for x in rep.collect()}
    assert r[1]["valid_rows"] == 3 and r[1]["invalid_rows"] == 2
    assert S.table(spark, root, "questions") is None


def test_unwritable_target_fails_rows(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write_files(d)
    man = manifest(spark, d).filter("import_id = 1")
    recs, files = FS.read_manifest_files(spark, man)
    params = P.resolve_params(man, spark.createDataFrame([], "quiz_id long, quiz_name string"))
    root = str(tmp_path / "wh")
    S.run_import(spark, root, recs, params, file_errors=files, target_columns=["nothing"])
    lg = S.logs_now(spark, root).first()
    assert (lg["success_rows"], lg["failed_rows"], lg["total_rows"]) == (0, 5, 5)
    assert lg["first_question_id"] is None
    errs = spark.read.parquet(root + "/row_errors").orderBy("orig_row", "seq").collect()
    assert [(r["orig_row"], r["seq"], r["code"]) for r in errs] == \
        [(2, 1, "E4"), (3, 1, "E1"), (4, 1, "E4"), (6, 1, "E2"), (7, 1, "E3"), (7, 2, "E4")]
    assert lg["n_errors"] == 6


def test_csv_line_path_matches_file_decoder(spark, tmp_path):
    """spark.read.text path (split ordinals, quote parity) == per-file decoder, for any splits."""
    d = tmp_path / "in"
    d.mkdir()
    rows = [["Q" + str(i), "a" if i % 3 else "", "b,c" if i % 4 == 0 else 'x "y"', str(i % 5)] for i in range(3000)]
    rows[7] = ["", "", "", ""]
    rows[11][1] = "two\nlines, \"quoted\"\n\nand more"
    rows[12][1] = "cr\r\nlf"
    rows[13][2] = "w " * 150_000  # one cell above the csv module's default limit
    buf = io.StringIO()
    w = csv.writer(buf)
    w.writerow([" Question", "Option1", "OPTION2", "correct_answer"])
    w.writerows(rows)
    text = buf.getvalue() + "\r\nshort\r\nlong,1,2,3,4,5\r\n"
    (d / "big.csv").write_bytes(text.encode("utf-8-sig"))
    man = spark.createDataFrame([(9, "big.csv", str(d / "big.csv"), {}, 1, False)],
                                "import_id long, file_name string, path string, params map<string,string>, "
                                "uploader_id long, has_taxonomy boolean")

    def cells(df):
        return sorted((r["orig_row"], tuple((c["key"], c["value"]) for c in r["cells"])) for r in df.collect())

    ref, files = FS.read_manifest_files(spark, man)
    want = cells(ref)
    assert files.filter("error is not null").count() == 0 and len(want) == 3003
    for size in ("16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert cells(FS.read_csv_lines(spark, man.select("import_id", "path"))) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bad_files_fail_alone(spark, tmp_path):
    """A broken, a missing and an odd file among good ones: each is its own import's error."""
    d = tmp_path / "in"
    d.mkdir()
    write_files(d)
    (d / "broken.xlsx").write_bytes(b"PK no workbook")
    (d / "deep.json").write_text("[" * 100_000)
    (d / "nan.json").write_text('[{"question": NaN}]')
    (d / "huge.json").write_text('[{"question": "q", "option1": ' + "7" * 5000 + "}]")
    names = ["a.csv", "missing.csv", "b.json", "broken.xlsx", "deep.json", "nan.json", "huge.json"]
    rows = [(i, n, str(d / n), {}, 1, False) for i, n in enumerate(names)]
    rows.append((50, "gone.csv", str(tmp_path / "nowhere" / "gone.csv"), {}, 1, False))
    man = spark.createDataFrame(rows, "import_id long, file_name string, path string, params map<string,string>, "
                                      "uploader_id long, has_taxonomy boolean")
    recs, files = FS.read_manifest_files(spark, man)
    errors = {r["import_id"]: r["error"] for r in files.collect()}
    assert {i for i, e in errors.items() if e} == {1, 3, 4, 5, 50} and errors[1] == errors[50] == "File missing."
    got = {r["import_id"]: r["count"] for r in recs.groupBy("import_id").count().collect()}
    assert got == {0: 6, 2: 6, 6: 1}


def test_import_rollback_import_again(spark, tmp_path):
    """Log ids are fresh per run: import, roll back, import again, roll back, compact, import."""
    d = tmp_path / "in"
    d.mkdir()
    write_files(d)
    man = manifest(spark, d).filter("import_id in (1, 2)")
    recs, files = FS.read_manifest_files(spark, man)
    params = P.resolve_params(man, spark.createDataFrame([], "quiz_id long, quiz_name string"))
    root, fresh = str(tmp_path / "wh"), str(tmp_path / "wh2")
    ask = lambda root, *ids: {r["log_id"]: r for r in S.rollback(
        spark, root, spark.createDataFrame([(i,) for i in ids], "log_id long")).collect()}
    S.run_import(spark, root, recs, params, file_errors=files)
    assert ask(root, 2)[2]["removed"] == 3
    S.run_import(spark, root, recs, params, file_errors=files)
    status = {r["id"]: r["status"] for r in S.logs_now(spark, root).collect()}
    assert status == {1: "Partial", 2: "RolledBack", 3: "Partial", 4: "Partial"}
    live = S.live_questions(spark, root)
    assert {r["import_id"] for r in live.select("import_id").distinct().collect()} == {1, 3, 4}
    again = ask(root, 2, 4)
    assert (again[2]["outcome"], again[2]["attempted"], again[2]["removed"]) == ("already_rolled_back", 0, 0)
    assert (again[4]["outcome"], again[4]["attempted"], again[4]["removed"]) == ("rolled_back", 3, 3)
    S.compact(spark, root, fresh)
    assert S.next_id_base(spark, fresh) == 13  # ids of removed questions aren't given again
    S.run_import(spark, fresh, recs, params, file_errors=files)
    q = S.live_questions(spark, fresh)
    assert sorted(r["question_id"] for r in q.collect()) == [1, 2, 3, 7, 8, 9, *range(13, 19)]
    assert {r["id"] for r in S.logs_now(spark, fresh).collect()} == set(range(1, 7))


def test_compact_after_rollback(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write_files(d)
    man = manifest(spark, d).filter("import_id in (1, 3)")
    recs, files = FS.read_manifest_files(spark, man)
    params = P.resolve_params(man, spark.createDataFrame([], "quiz_id long, quiz_name string"))
    root, fresh = str(tmp_path / "wh"), str(tmp_path / "wh2")
    S.run_import(spark, root, recs, params, file_errors=files)
    S.rollback(spark, root, spark.createDataFrame([(2,)], "log_id long"))
    S.compact(spark, root, fresh)
    q = spark.read.parquet(fresh + "/questions")
    assert q.count() == 3 and {r["import_id"] for r in q.select("import_id").distinct().collect()} == {1}
    st = {r["id"]: r["status"] for r in spark.read.parquet(fresh + "/import_logs").collect()}
    assert st == {1: "Partial", 2: "RolledBack"}
    assert S.table(spark, fresh, "tombstones") is None   # compacted tables need no tombstones
