"""Files of any name by the library's rules: what each is taken for, its rows and its meta row."""

import zipfile

from quarry.sources import files as FS
from quarry.sources.xlsx import xlsx_bytes

CSV = "question,option1,option2\nfirst,a,b\n , ,\nlast ,c,d\n"
JSON = '[{"question": "first", "option1": "a"}, {"question": " "}, {"question": "last ", "option1": ["c", "d"]}]'
SHEET = xlsx_bytes([["question", "option1"], ["first", "a"], ["last", "c"]])
OLE = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(600)

CASES = [  # name, content, type, parser, rows before, rows after
    ("a.csv", CSV, "text/csv", "csv", 3, 2),
    ("named.json", CSV, "text/csv", "csv", 3, 2),
    ("b.json", JSON, "application/json", "json", 3, 2),
    ("b b%20.DAT", "﻿" + JSON, "application/json", "json", 3, 2),
    ("noext", JSON, "application/json", "json", 3, 2),
    ("sheet.xlsx", SHEET, FS.SPREADSHEET, "xlsx", 2, 2),
    ("sheet.bin", SHEET, FS.SPREADSHEET, "xlsx", 2, 2),
    ("empty.csv", "", "application/x-empty", "csv", 0, 0),
    ("plain.note", "only one line\n", "text/plain", None, 1, 1),
]


def parse(spark, folder, files):
    rows = []
    for i, (name, content) in enumerate(files):
        path = folder / str(i) / name
        path.parent.mkdir()
        if content is not None:
            path.write_bytes(content if isinstance(content, bytes) else content.encode())
        rows.append((i, str(path)))
    recs, meta = FS.parse_files(spark, spark.createDataFrame(rows, "import_id long, path string"))
    by_file = {}
    for r in sorted(recs.collect(), key=lambda r: (r["import_id"], r["rec_no"])):
        by_file.setdefault(r["import_id"], []).append(r)
    return by_file, {r["import_id"]: r for r in meta.collect()}


def test_types_and_counts(spark, tmp_path):
    recs, meta = parse(spark, tmp_path, [c[:2] for c in CASES])
    for i, (name, _, mime, parser, before, after) in enumerate(CASES):
        m = meta[i]
        assert (m["name"], m["mime"], m["parser"], m["error"]) == (name, mime, parser, None), m
        assert (m["total_before_filter"], m["total_after_filter"]) == (before, after), m
        assert [r["rec_no"] for r in recs.get(i, [])] == list(range(after))
    assert meta[3]["extension"] == "dat" and meta[4]["extension"] == ""
    for i in range(7):  # whatever the format: trimmed, the blank row gone
        values = [next(c["value"] for c in r["cells"] if c["key"] == "question") for r in recs[i]]
        assert values == ["first", "last"], CASES[i][0]
    assert [c["value"] for c in recs[2][1]["cells"]] == ["last", "c d"]


def test_errors_stay_with_their_file(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z", "w") as z:
        z.writestr("readme", "x")
    recs, meta = parse(spark, tmp_path, [
        ("gone.csv", None), ("old.xls", OLE), ("broken.json", '[{"question": '), ("zip.xlsx", (tmp_path / "z").read_bytes()),
        ("new.xls", SHEET), ("long.txt", "question,option1\n" + "x" * 300_000 + ",a\n")])
    assert meta[0]["error"] == FS.MSG_INVALID_FILE and meta[0]["mime"] is None
    assert meta[1]["mime"] == "application/vnd.ms-excel" and meta[1]["error"]
    assert meta[2]["error"] is None and meta[2]["mime"] == "application/json"  # broken JSON has no rows
    assert meta[3]["error"] and meta[3]["mime"] == "application/zip"
    assert all(meta[i]["total_before_filter"] == 0 and i not in recs for i in range(4))
    assert meta[4]["error"] is None and meta[4]["total_after_filter"] == 2  # the content tells
    assert meta[5]["total_after_filter"] == 1 and len(recs[5][0]["cells"][0]["value"]) == 300_000


def test_no_files(spark):
    recs, meta = FS.parse_files(spark, spark.createDataFrame([], "import_id long, path string"))
    assert recs.count() == 0 and meta.count() == 0
