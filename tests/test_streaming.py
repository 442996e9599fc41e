"""Landing-folder stream runs the batch import per micro-batch."""

from quarry.operators import store as S
from quarry.streaming.landing import start_landing_import


def test_landing_stream_imports_files(spark, tmp_path):
    land = tmp_path / "landing"
    land.mkdir()
    (land / "a.csv").write_text("question,option1,option2,correct_answer\nQ1,a,b,b\nQ2,c,d,2\n,x,y,1\n")
    (land / "b.json").write_text('[{"question": "Q3", "option1": "yes", "option2": "no", "correct": "A"}]')
    quizzes = spark.createDataFrame([(5, "Five")], "quiz_id long, quiz_name string")
    root = str(tmp_path / "wh")
    q = start_landing_import(spark, str(land), root, {"qsm_quiz": "5"}, quizzes,
                             checkpoint=str(tmp_path / "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    logs = S.logs_now(spark, root).collect()
    assert len(logs) == 2
    assert sorted((r["success_rows"], r["failed_rows"]) for r in logs) == [(1, 0), (2, 1)]
    assert {r["quiz_name"] for r in logs} == {"Five"}
    assert S.live_questions(spark, root).count() == 3
