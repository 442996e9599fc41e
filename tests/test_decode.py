"""Pure-Python decoder cases."""

from quarry.sources import decode as D
from quarry.sources.xlsx import xlsx_bytes


def cells(rec):
    return [(k, v) for _, k, v in rec[2]]


def test_csv_live_header_padding_and_duplicates():
    data = b"Question, Option1 ,option1,Correct_Answer\nWhat?,a,b,2\n\nshort\n\"multi\nline\",x,y,z,extra\n"
    recs, hh, err = D.decode_csv(data)
    assert err is None and hh
    assert [r[1] for r in recs] == [2, 3, 4, 5]          # blank line counts, multi-line is one record
    assert cells(recs[0]) == [("question", "What?"), ("option1", "a"), ("option1", "b"), ("correct_answer", "2")]
    assert cells(recs[1]) == [("question", ""), ("option1", ""), ("option1", ""), ("correct_answer", "")]
    assert cells(recs[2])[0] == ("question", "short") and cells(recs[2])[1] == ("option1", "")
    assert cells(recs[3])[0] == ("question", "multi\nline") and len(recs[3][2]) == 4  # extra cell dropped


def test_csv_bom_and_empty():
    recs, _, _ = D.decode_csv("﻿question,option1\nq,a\n".encode())
    assert cells(recs[0])[0] == ("question", "q")
    recs, _, _ = D.decode_csv("﻿question,option1\nq,a\n".encode(), strip_bom=False)
    assert cells(recs[0])[0][0] == "﻿question"     # Q5 when not fixed
    assert D.decode_csv(b"") == ([], False, None)


def test_csv_leading_blank_line_header():
    recs, _, _ = D.decode_csv(b"\nquestion,option1\nq,a\n")
    assert cells(recs[0]) == [("", "question,option1")] or cells(recs[0])[0][0] == ""


def test_csv_lib_detection():
    assert D.detect_delimiter(b"a;b;c\n1;2;3") == ";"
    assert D.detect_delimiter(b"a\tb,c\n1\t2\t3") == "\t"
    assert D.detect_delimiter(b"a,b;c") == ","
    recs, hh, _ = D.decode_csv(b"Question Text;Option 1\nq;a;extra\n", mode="lib")
    assert hh and cells(recs[0]) == [("question-text", "q"), ("option-1", "a"), ("2", "extra")]
    recs, hh, _ = D.decode_csv(b"1,2\n3,4\n", mode="lib")
    assert not hh and cells(recs[0]) == [("0", "1"), ("1", "2")]


def test_header_heuristic():
    assert D.looks_like_header(["name", "1", "2", "brand"])       # 2/4
    assert not D.looks_like_header(["1", "2.5", ""])
    assert not D.looks_like_header(["name", "1", "2"])            # 1/3


def test_json_live_and_lib():
    doc = b'[{"Question": "q", "OPTION1": 1.0, "opt2": true, "x": null, "n": [1, 2]}, 5, ["a", "b"]]'
    recs, _, err = D.decode_json(doc)
    assert err is None and [r[1] for r in recs] == [1, 2]
    assert cells(recs[0]) == [("question", "q"), ("option1", "1"), ("opt2", "1"), ("x", ""), ("n", "Array")]
    assert cells(recs[1]) == [("0", "a"), ("1", "b")]
    assert D.decode_json(b'"scalar"')[2] is not None
    assert D.decode_json(b"{bad")[2] is not None
    env = b'{"rows": [{"k": 1}, 42, {"k": [1, 2]}]}'
    recs, _, _ = D.decode_json(env, mode="lib")
    assert [cells(r) for r in recs] == [[("k", "1")], [("0", "42")], [("k", "1 2")]]
    recs, _, _ = D.decode_json(b'{"data": [{"a": "x"}]}', mode="lib")
    assert cells(recs[0]) == [("a", "x")]


def test_php_float_str():
    assert D.php_float_str(1.0) == "1"
    assert D.php_float_str(0.1) == "0.1"
    assert D.php_float_str(1e20) == "1.0E+20"
    assert D.php_float_str(-2.5) == "-2.5"


def test_xlsx_rows_and_missing_rows():
    data = xlsx_bytes([["Question", "Option1", "Option2", "Correct"], ["q1", "a", 2, "B"],
                       ["q3", "c", 1.5, True]], row_numbers=[1, 2, 4])
    recs, hh, err = D.decode_xlsx(data)
    assert err is None and hh
    assert [r[1] for r in recs] == [2, 3, 4]                 # row 3 is missing in the sheet XML
    assert cells(recs[0]) == [("question", "q1"), ("option1", "a"), ("option2", "2"), ("correct", "B")]
    assert all(v == "" for _, v in cells(recs[1]))
    assert cells(recs[2])[2:] == [("option2", "1.5"), ("correct", "1")]


def test_routing():
    assert D.decode_file("a.TXT", b"x")[2] is not None         # live: unsupported
    assert D.decode_file("a.xls", b"x")[2] is not None
    assert D.decode_file("dir.v2/a", b"x")[2] is not None
    assert D.decode_file("a.CSV", b"q\nx\n")[0]


def test_xlsx_library_mode_headers():
    data = xlsx_bytes([["Question Text", "", "Option 1"], ["q", "mid", "a"]])
    recs, hh, err = D.decode_xlsx(data, mode="lib")
    assert err is None and cells(recs[0]) == [("question-text", "q"), ("B", "mid"), ("option-1", "a")]


def test_csv_rows_come_one_by_one():
    """A file's records are never all held: the decoder hands them over as it reads."""
    import tracemalloc

    from quarry.sources.decode import decode_file

    content = b"question,option1\n" + b"".join(b"q%d,\"a \xc3\xa9\"\n" % i for i in range(60_000))
    tracemalloc.start()
    recs, header, err = decode_file("x.csv", content)
    n = sum(1 for _ in recs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, header, err) == (60_000, True, None)
    assert peak < 2 * len(content)


def test_decoder_hands_over_bounded_batches():
    import pyarrow as pa

    from quarry.sources.files import ROWS_PER_BATCH, _decoder

    n = 2 * ROWS_PER_BATCH + 5
    content = b"question,option1\n" + b"q,a\n" * n
    files = pa.RecordBatch.from_pydict({"import_id": [1, 2, 3], "name": ["a.csv", "b.csv", "c.csv"], "content": [content, b"", b"h\n"]})
    got = list(_decoder("live", True)([files]))
    assert max(b.num_rows for b in got) == ROWS_PER_BATCH
    rows = pa.Table.from_batches(got).to_pylist()
    assert [(r["import_id"], r["has_header"], r["n_records"]) for r in rows if r["kind"] == "file"] == [(1, True, n), (2, False, 0), (3, True, 0)]
    assert [r["rec_no"] for r in rows if r["kind"] == "record"] == list(range(n))
