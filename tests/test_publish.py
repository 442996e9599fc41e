"""Runs that break off, claims at the same time, removals, look-ups and deletes in stored tables."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quarry.operators import history as H
from quarry.operators import params as P
from quarry.operators import publish
from quarry.operators import store as S
from quarry.streaming.landing import start_landing_import

RECORD = "import_id long, rec_no long, orig_row long, cells array<struct<pos:int,key:string,value:string>>"


class Broken(Exception):
    pass


def records(spark, n=4):
    rows = []
    for imp in (1, 2):
        for i in range(n):
            title = "" if i == 1 else f"Q{imp}-{i}"
            values = [("question", title), ("option1", "a"), ("option2", "b"), ("correct_answer", "b")]
            rows.append((imp, i, i + 2, [(p, k, v) for p, (k, v) in enumerate(values)]))
    return spark.createDataFrame(rows, RECORD)


def params(spark):
    man = spark.createDataFrame([(i, f"{i}.csv", f"/{i}.csv", {"qsm_category": "2"}, 7, True) for i in (1, 2)],
                                "import_id long, file_name string, path string, params map<string,string>, "
                                "uploader_id long, has_taxonomy boolean")
    return P.resolve_params(man, spark.createDataFrame([], "quiz_id long, quiz_name string"))


def titles(spark, root):
    q = S.live_questions(spark, root).select("question_id", F.col("question_settings.question_title").alias("t"))
    got = [(r["question_id"], r["t"]) for r in q.collect()]
    assert len({i for i, _ in got}) == len(got)
    return sorted(t for _, t in got)


WANT = sorted(f"Q{imp}-{i}" for imp in (1, 2) for i in (0, 2, 3))


def test_run_that_breaks_off_anywhere_leaves_nothing(spark, tmp_path, monkeypatch):
    root, append = str(tmp_path / "wh"), S.append
    fe = spark.createDataFrame([(2, None)], "import_id long, error string")
    for stop in range(5):  # after the questions, the links, the errors, the file errors, the logs
        left = [stop]

        def breaking(*a, **k):
            append(*a, **k)
            left[0] -= 1
            if left[0] < 0:
                raise Broken
        monkeypatch.setattr(S, "append", breaking)
        with pytest.raises(Broken):
            S.run_import(spark, root, records(spark), params(spark), file_errors=fe, run_key="k")
        monkeypatch.setattr(S, "append", append)
        for name in ("questions", "question_terms", "row_errors", "import_logs"):
            t = S.visible(spark, root, name)
            assert t is None or t.count() == 0
    got = S.run_import(spark, root, records(spark), params(spark), file_errors=fe, run_key="k")
    assert got["done"] and titles(spark, root) == WANT
    again = S.run_import(spark, root, records(spark), params(spark), file_errors=fe, run_key="k")
    assert not again["done"] and again["run"] == got["run"] and titles(spark, root) == WANT
    logs = S.logs_now(spark, root).collect()
    assert len(logs) == 2 and {r["success_rows"] for r in logs} == {3}
    assert S.live_links(spark, root).count() == 6 and S.visible(spark, root, "row_errors").count() == 2
    one = S.log_by_id(spark, root, logs[0]["id"]).collect()
    assert [(r["id"], r["success_rows"], r["n_question_ids"]) for r in one] == [(logs[0]["id"], 3, 3)]
    assert S.log_by_id(spark, root, 10**9).count() == 0
    # a compacted copy keeps the key of the run
    S.compact(spark, root, str(tmp_path / "wh2"))
    assert not S.run_import(spark, str(tmp_path / "wh2"), records(spark), params(spark), run_key="k")["done"]
    assert titles(spark, str(tmp_path / "wh2")) == WANT


def test_stream_batch_that_breaks_off_is_imported_once(spark, tmp_path, monkeypatch):
    land, root = tmp_path / "landing", str(tmp_path / "wh")
    land.mkdir()
    (land / "a.csv").write_text("question,option1,option2,correct_answer\nQ1,a,b,b\nQ2,c,d,2\n")
    quizzes = spark.createDataFrame([], "quiz_id long, quiz_name string")

    def run():
        q = start_landing_import(spark, str(land), root, {}, quizzes, checkpoint=str(tmp_path / "ckpt"), trigger_once=True)
        q.awaitTermination(120)

    def broken(*a, **k):
        raise Broken
    monkeypatch.setattr(publish, "commit", broken)
    with pytest.raises(Exception, match="Broken"):
        run()
    monkeypatch.undo()
    run()
    assert titles(spark, root) == ["Q1", "Q2"]


def test_sessions_that_claim_at_once_share_no_id(spark, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: publish.claim(spark, root, "question_id", 1 + i % 3), range(40)))
    assert sorted(n for n, _ in got) == list(range(1, 41))
    used = [x for i, (_, first) in enumerate(got) for x in range(first, first + 1 + i % 3)]
    assert len(set(used)) == len(used) and max(used) == len(used)
    assert publish.counters(spark, root)[1] == {"question_id": len(used) + 1, "log_id": 1}


@pytest.mark.parametrize("scheme", ["", "viewfs://shared/t"])
def test_a_file_is_published_once(spark, tmp_path, scheme):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shared.link./t", f"file://{tmp_path}")
    path = f"{scheme or tmp_path}/a b/c%20[d]"
    assert publish.create_new(spark, path, "one\n") and not publish.create_new(spark, path, "two")
    assert publish.read_text(spark, path) == "one\n"
    assert [p.name for p in (tmp_path / "a b").iterdir() if not p.name.endswith(".crc")] == ["c%20[d]"]


def test_removed_ranges_cover_exactly_the_ids(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BITS", 6)
    monkeypatch.setattr(H, "RANGE_BITS", 3)
    monkeypatch.setattr(H.block_of, "__defaults__", (6,))
    rng = random.Random(1)
    asked = [(a, a + rng.choice([0, 0, 1, 5, 90, 200, -3])) for a in (rng.randrange(-100, 1500) for _ in range(60))] * 2
    gone = {i for a, b in asked for i in range(a, b + 1)}
    ranges = H.removed_ranges(spark.createDataFrame(asked, "first_id long, last_id long"))
    rows = ranges.collect()
    assert sorted(i for r in rows for i in range(r["first_id"], r["last_id"] + 1)) == sorted(gone)
    assert {r["bits"] for r in rows} == {3, 6} and all((r["first_id"] >> r["bits"]) == (r["last_id"] >> r["bits"]) for r in rows)
    ids = spark.range(-200, 1800).withColumnRenamed("id", "question_id").withColumn("id_block", H.block_of(F.col("question_id")))
    assert {r["question_id"] for r in H.without_ids(ids, ranges).collect()} == set(range(-200, 1800)) - gone
    singles = H.removed_ranges(spark.createDataFrame([(5,), (6,), (7,), (8,), (5,), (20,)], "question_id long"))
    assert sorted((r["first_id"], r["last_id"]) for r in singles.collect()) == [(5, 7), (8, 8), (20, 20)]


def stored(spark, root, ids):
    run, _ = publish.claim(spark, root)
    S.append(spark.createDataFrame([(i, i // 3) for i in ids], "question_id long, import_id long"), root, "questions", run,
             "question_id")
    publish.commit(spark, root, run)


def test_removal_and_look_up(spark, tmp_path):
    root, far = str(tmp_path), 3 << 20
    stored(spark, root, [*range(1, 50), far, far + 1])
    got = S.remove_questions(spark, root, spark.createDataFrame([(3,), (7,), (3,), (1000,)], "question_id long"), run_key="r")
    assert got == {"attempted": 3, "removed": 2, "done": True}
    assert not S.remove_questions(spark, root, spark.createDataFrame([(9,)], "question_id long"), run_key="r")["done"]
    got = S.remove_questions(spark, root, spark.createDataFrame([(6, 12), (10, 20)], "first_id long, last_id long"))
    assert (got["attempted"], got["removed"]) == (15, 14)
    left = set(range(1, 50)) - {3} - set(range(6, 21)) | {far, far + 1}
    assert {r["question_id"] for r in S.live_questions(spark, root).collect()} == left
    few = S.questions_by_id(spark, root, [2, 3, far, 77])
    assert sorted(r["question_id"] for r in few.collect()) == [2, far]
    many = S.questions_by_id(spark, root, spark.createDataFrame([(2,), (7,), (far + 1,), (None,)], "question_id long"))
    assert sorted(r["question_id"] for r in many.collect()) == [2, far + 1]


@pytest.mark.parametrize("frame", [False, True])
def test_look_up_reads_only_the_blocks_asked_for(spark, tmp_path, frame):
    root, far = str(tmp_path / "wh"), 3 << 20
    stored(spark, root, [*range(1, 50), far, far + 1])
    ids = [far + 1]
    if frame:
        spark.createDataFrame([(far + 1,)], "question_id long").write.parquet(str(tmp_path / "ids"))
        ids = spark.read.parquet(str(tmp_path / "ids"))
    got = S.questions_by_id(spark, root, ids)
    for p in (tmp_path / "wh" / "questions").rglob("id_block=0/part-*"):
        p.write_bytes(b"x" * p.stat().st_size)  # reading it would fail
    assert [r["question_id"] for r in got.collect()] == [far + 1]


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("part-*") if "_deletes" not in str(p)}


def test_delete_rewrites_touched_partitions_only(spark, tmp_path, monkeypatch):
    path = tmp_path / "t"
    df = spark.range(100).select("id", F.concat(F.lit("k %/"), F.col("id") % 4).alias("k"), (F.col("id") % 3).alias("d"))
    df.withColumn("k", F.when(F.col("id") % 4 > 0, F.col("k"))).write.partitionBy("k").parquet(str(path))
    before = files(path)
    where = {"d": 1, "k": "k %/1"}
    want = {i for i in range(100) if not (i % 3 == 1 and i % 4 == 1)}

    def broken(*a):
        raise Broken
    finish = S._finish_delete
    monkeypatch.setattr(S, "_finish_delete", lambda s, p: broken() if publish.exists(s, f"{p}/_deletes/pending") else None)
    with pytest.raises(Broken):
        S.delete_where(spark, str(path), where)
    assert files(path) == before
    monkeypatch.setattr(S, "_finish_delete", finish)
    assert S.delete_where(spark, str(path), where) == 0  # what had been begun is finished first
    read = spark.read.parquet(str(path))
    assert {r["id"] for r in read.collect()} == want and read.count() == len(want)
    changed = before ^ files(path)
    assert changed and all("1" in f.split("/")[0] for f in changed)
    assert S.delete_where(spark, str(path), {"k": "k %/2"}) == 25 and spark.read.parquet(str(path)).count() == len(want) - 25
    assert S.delete_where(spark, str(path), {}) is None and S.delete_where(spark, str(tmp_path / "no"), {"d": 1}) is None
