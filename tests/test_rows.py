"""Row rules against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import batch as B
from quarry.operators import rows as R
from quarry.schema import RECORDS


def records(spark, rows):
    """rows: list of (orig_row, [(key, value), ...])."""
    data = [(1, i, orow, [(p, k, v) for p, (k, v) in enumerate(cells)]) for i, (orow, cells) in enumerate(rows)]
    return spark.createDataFrame(data, RECORDS)


LADDER = [
    (["Paris", "London", "Rome"], "london", 2, "exact"),
    (["Paris", "London", "Rome"], "B", 2, "letter"),
    (["Paris", "London", "Rome"], "option 3", 3, "number"),
    (["Paris", "London", "Rome"], "10", 0, "none"),
    (["Paris", "London", "Rome"], "None", 0, "none"),
    (["Paris", "London", "Rome"], "ndo", 2, "substring"),
    (["Paris", "London", "Rome"], "-2", 2, "number"),
    (["Paris", "London", "Rome"], "2.5", 2, "number"),
    (["Paris", "London", "Rome"], "om", 3, "substring"),
    (["a1", "a2", "a3", "a4", "a5"], "None", 5, "letter"),
    (["Paris", "London", "Rome"], "", 0, "blank"),
]


def test_correct_answer_ladder(spark):
    rows = []
    for i, (opts, raw, _, _) in enumerate(LADDER):
        cells = [("question", f"q{i}")] + [(f"option{j + 1}", o) for j, o in enumerate(opts)]
        cells.append(("correct_answer", raw))
        rows.append((i + 2, cells))
    out = R.evaluate_rows(records(spark, rows)).orderBy("orig_row").collect()
    got = [(r["correct_index"], r["match_method"]) for r in out]
    assert got == [(e, m) for _, _, e, m in LADDER]
    assert out[3]["message"].startswith('Row 5: correct_answer value "10" did not match')


def test_options_compaction_and_fallbacks(spark):
    rows = [
        (2, [("question", "q"), ("option1", "a"), ("option2", "  "), ("option3", "c"), ("correct_answer", "3")]),
        (3, [("question", "q"), ("opt 2", "b"), ("Answer1", "a"), ("ans_2", "B2")]),
        (4, [("question", "q"), ("option_a", "x"), ("answer_correct", "y"), ("correct", "x")]),
        (5, [("question", "q"), ("explanation", "e")]),
        (6, [("question", "   "), ("option1", "a")]),
        (7, [("Question", "q"), ("OPTION1", "a"), ("option1", "z"), ("correct_answer", "z")]),
    ]
    out = {r["orig_row"]: r for r in R.evaluate_rows(records(spark, rows)).collect()}
    assert out[2]["opts"] == ["a", "c"] and out[2]["correct_index"] == 0      # '3' > 2 options, no substring
    assert out[3]["opts"] == ["a", "B2"]                                       # later key with same number wins
    assert out[4]["opts"] == ["x", "y"] and out[4]["correct_index"] == 1       # prefix fallback, cell order
    assert out[5]["row_status"] == "no_options" and out[5]["message"] == "Row 5: no options found. Skipped."
    assert out[6]["row_status"] == "missing_question"
    assert out[7]["opts"] == ["z"] and out[7]["correct_index"] == 1           # case fold + last value wins


def test_blank_rows_use_normalization(spark):
    rows = [(2, [("question", " ​"), ("option1", "&nbsp;&Tab;")]),
            (3, [("question", "﻿"), ("option1", "&#8203;")]),
            (4, [("question", "x")])]
    out = R.evaluate_rows(records(spark, rows), keep_blank=True).orderBy("orig_row").collect()
    assert [r["is_blank"] for r in out] == [True, True, False]


@pytest.mark.parametrize("tax,cat,stored,link", [
    (True, "3", "", True), (True, "0", "", False), (True, "Science", "Science", False),
    (False, "3", "3", False), (False, "Science", "Science", False), (True, "", "", False),
])
def test_category_table(spark, tax, cat, stored, link):
    df = spark.createDataFrame([(tax, cat)], "has_taxonomy boolean, category_input string") \
        .withColumn("category_is_numeric", T.is_numeric(F.col("category_input")))
    r = df.select(B.category_text(F.col("has_taxonomy"), F.col("category_input"),
                                  F.col("category_is_numeric")).alias("c"),
                  (F.col("has_taxonomy") & F.col("category_is_numeric") &
                   (T.php_intval(F.col("category_input")) > 0)).alias("l")).first()
    assert r["c"] == stored and r["l"] == link


def test_php_scalars(spark):
    df = spark.createDataFrame([(" 12 ",), ("1e3",), ("abc",), ("12abc",), (".5",), ("NaN",), ("0x1A",)], "s string")
    out = df.select(T.is_numeric(F.col("s")).alias("n"), T.php_intval(F.col("s")).alias("i")).collect()
    assert [r["n"] for r in out] == [True, True, False, False, True, False, False]
    assert [r["i"] for r in out] == [12, 1000, 0, 12, 0, 0, 0]


def test_ids_are_dense_and_ordered_with_skew(spark):
    # one import holds most rows; ids must follow (import_id, orig_row) densely
    data = [(0 if i % 3 else 1, i) for i in range(3000)]
    df = spark.createDataFrame(data, "import_id long, orig_row long")
    out, offsets = B.assign_ids(df, base=100, bucket_rows=256)
    rows = out.orderBy("import_id", "orig_row").collect()
    assert [r["question_id"] for r in rows] == list(range(100, 3100))


def test_strict_letters_option(spark):
    rows = [(2, [("question", "q"), ("option1", "a1"), ("option2", "a2"), ("option3", "a3"), ("option4", "a4"),
                 ("option5", "a5"), ("correct_answer", "None")]),
            (3, [("question", "q"), ("option1", "x"), ("option2", "y"), ("correct_answer", "b")])]
    loose = {r["orig_row"]: r["correct_index"] for r in R.evaluate_rows(records(spark, rows)).collect()}
    strict = {r["orig_row"]: r["correct_index"]
              for r in R.evaluate_rows(records(spark, rows), strict_letters=True).collect()}
    assert loose == {2: 5, 3: 2} and strict == {2: 0, 3: 2}
