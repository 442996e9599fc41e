"""The line reader against one pass over the file, for any splits; odd paths."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources import csvlines
from quarry.sources import files as FS

MANIFEST = ("import_id long, file_name string, path string, params map<string,string>, uploader_id long, "
            "has_taxonomy boolean")


def manifest(spark, paths):
    return spark.createDataFrame([(i, str(p).rsplit("/", 1)[1], str(p), {}, 1, False) for i, p in enumerate(paths)], MANIFEST)


def one_pass(text):
    """The records of a text, read character by character."""
    rows, row, field, state = [], [], "", "start"
    text = text[:-1] if text.endswith("\n") else text
    for i, c in enumerate(text + "\n"):
        last = i == len(text)
        if state == "quoted" and not (last and c == "\n"):
            if c == '"':
                state = "closed"
            else:
                field += c
            continue
        if state == "closed" and c == '"':
            field, state = field + c, "quoted"
        elif c == "\n":
            if state != "quoted":
                field = field.removesuffix("\r") if state != "closed" else field
            rows.append(row + [field] if row or field or state in ("quoted", "closed") else [])
            row, field, state = [], "", "start"
        elif c == ",":
            row, field, state = [*row, field], "", "start"
        elif c == '"' and state == "start":
            state = "quoted"
        elif not (c == "\r" and state == "closed" and (text + "\n")[i + 1] == "\n"):
            field, state = field + c, "bare"
    return rows


def random_text(rng, n):
    pieces = ["a", "b c", '"', '""', ",", ",", "\n", "\n", "\r\n", '"x, ""y""\nz"', 'say "hi"', "é", ' "', '",', ',"', "\r"]
    return "".join(rng.choice(pieces) for _ in range(n))


def test_lines_as_functions_of_two_states():
    rng = random.Random(1)
    for _ in range(4000):
        line = random_text(rng, rng.randrange(12)).replace("\n", "")
        for quoted in (False, True):
            # a line that begins in a quoted cell continues '"'
            text = ('"\n' if quoted else "") + line + "\nZ"
            assert csvlines.ends_open(line, quoted) == (one_pass(text)[-1:] != [["Z"]]), (line, quoted)


def test_parse_agrees_with_one_pass():
    rng = random.Random(2)
    for _ in range(3000):
        text = random_text(rng, rng.randrange(30))
        body = text[:-1] if text.endswith("\n") else text
        assert csvlines.parse(body.split("\n")) == one_pass(text) or not text


@pytest.mark.parametrize("size", ["64b", "1k", "128m"])
def test_any_split_size(spark, tmp_path, size):
    rng, texts = random.Random(3), []
    for i in range(6):
        text = ("﻿" if i % 2 else "") + "Question,option1,,option1\n" + random_text(rng, 900)
        (tmp_path / f"{i}.csv").write_bytes(text.encode())
        texts.append(text.removeprefix("﻿"))
    (tmp_path / "6.csv").write_bytes(b"")
    (tmp_path / "7.csv").write_bytes(b"\nx,\xff\xfe\n")
    texts += ["", "\nx,��\n"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        recs, outcome = FS.read_manifest_files(spark, manifest(spark, [tmp_path / f"{i}.csv" for i in range(8)]))
        got = {(r["import_id"], r["rec_no"]): [(c["key"], c["value"]) for c in r["cells"]] for r in recs.collect()}
        ends = {r["import_id"]: (r["n_records"], r["error"]) for r in outcome.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for i, text in enumerate(texts):
        rows = one_pass(text) if text else []
        keys = [k.strip(" \t\n\r\0\x0b").lower() for k in (rows[0] or [""])] if rows else []
        for n, row in enumerate(rows[1:]):
            want[i, n] = [(k, row[j] if j < len(row) else "") for j, k in enumerate(keys)]
        assert ends[i] == (max(len(rows) - 1, 0), None)
    assert got == want


def test_states_over_many_splits(spark):
    rng = random.Random(4)
    rows = [("f", b, 1, rng.random() < 0.5, rng.randrange(5), rng.random() < 0.5, rng.randrange(5)) for b in range(200)]
    got = {r["block"]: (r["quoted"], r["before"]) for r in
           csvlines.split_states(spark.createDataFrame(rows, csvlines.SPLITS)).collect()}
    state, n = False, 0
    for _, b, _, s, ns, q, nq in rows:
        assert got[b] == (state, n)
        n, state = (n + nq, q) if state else (n + ns, s)


def test_odd_names_load_and_missing_ones_fail_alone(spark, tmp_path):
    names = ["sp ace/y.csv", "g[1]/x.csv", "p%20c/a%2Bb+c.csv", "u/_hidden.csv", "u/.dot.json", "é {a,b}/*.csv", "a/b?.json", "u/plain.csv"]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text('[{"question": "q"}]' if n.endswith("json") else "question\nq\n")
    (tmp_path / "u" / "other.csv").write_text("question\nnot asked for\n")
    paths = [tmp_path / n for n in names] + [tmp_path / "nowhere" / "z.csv", tmp_path / "u" / "no.csv", tmp_path / "u" / "_no.csv"]
    recs, outcome = FS.read_manifest_files(spark, manifest(spark, paths))
    got = {r["import_id"]: [c["value"] for c in r["cells"]] for r in recs.collect()}
    assert got == {i: ["q"] for i in range(len(names))}
    errors = {r["import_id"]: r["error"] for r in outcome.collect()}
    assert errors == {i: None if i < len(names) else "File missing." for i in range(len(paths))}


def test_one_file_for_two_imports_and_large_csv(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FS, "MAX_VALUE_BYTES", 100)
    buf = io.StringIO()
    csv.writer(buf).writerows([["question"], *[[f"line\n{i}"] for i in range(50)]])
    (tmp_path / "a.csv").write_text(buf.getvalue())
    (tmp_path / "a.json").write_text(str([{"question": "x" * 200}]).replace("'", '"'))
    recs, outcome = FS.read_manifest_files(spark, manifest(spark, [tmp_path / "a.csv", tmp_path / "a.csv", tmp_path / "a.json"]))
    assert {r["import_id"]: r["count"] for r in recs.groupBy("import_id").count().collect()} == {0: 50, 1: 50}
    assert {r["import_id"]: r["error"] for r in outcome.collect()} == {0: None, 1: None, 2: "File too large for one task."}
    assert recs.filter(F.col("cells")[0]["value"] == "line\n7").count() == 2
