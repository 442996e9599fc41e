"""The plain forms of the row rules against the higher-order ones, on odd records."""

from pyspark.sql import functions as F

from quarry.operators import rows as R
from quarry.schema import RECORDS

ODD = [
    [("question", "q"), ("option1", "a"), ("option2", " b "), ("option3", ""), ("correct_answer", "b")],
    [("Question ", "q"), (" Option_1", "a"), ("OPTION 2", "b"), ("Correct Answer", "2")],
    [("question", "q"), ("option2", "second"), ("option1", "first"), ("correct", "A")],
    [("question", "q"), ("option1", "a"), ("opt1", "later"), ("option2", "b"), ("correct", "later")],
    [("question", "q"), ("option1", "a"), ("option1", "again"), ("question", "last"), ("correct", "gai")],
    [("question", "q"), ("option1", None), ("option2", "b"), ("correct", None)],
    [("question", "q")] + [(f"option{i}", f"<b>o{i}</b>") for i in range(1, 13)] + [("correct", "o11")],
    [("question", "q"), ("option\n1", "not one"), ("option 2", "x"), ("option3 ", "y"), ("correct", "y")],
    [("question", "q"), ("\noption1\n", "trimmed"), ("", "no key"), ("correct", "trimmed")],
    [("question", "q"), ("option_a", "a"), ("option_b", "\x00"), ("answer_c", "c%41"), ("correct", "c")],
    [("question", "q"), ("option99999999999999999999", "huge"), ("option7", "seven"), ("correct", "seven")],
    [("question", "\x00"), ("option1", "\x00"), ("option2", "Ä b"), ("correct", "ä B")],
    [("question", "&nbsp;"), ("option1", "​")],
    [],
]


def odd_records(spark):
    return spark.createDataFrame([(1, i, i, [(p, k, v) for p, (k, v) in enumerate(cells)]) for i, cells in enumerate(ODD)],
                                 RECORDS)


def test_plain_forms_equal_the_general_ones(spark):
    general = R.let(R.fold_key_case(F.col("cells")), R.collapse_keys)
    cells = odd_records(spark).select(R.normalized_cells(F.col("cells")).alias("now"), general.alias("general"))
    for r in cells.collect():
        assert r["now"] == r["general"]

    def options(c):
        numbered = R.let(R.numbered_candidates(c), R.compact_numbered)
        return R.let(numbered, lambda n: F.when(F.size(n) > 0, F.transform(n, R.T.sanitize_text_field_fast))
                     .otherwise(R.options_prefixed(c)))

    found = R.with_options(odd_records(spark).withColumn("cells", general)).withColumn("general", options(F.col("cells")))
    for r in found.collect():
        assert r["opts"] == r["general"], r


def test_outcomes_of_odd_records(spark):
    got = {r["orig_row"]: (r["opts"], r["correct_index"], r["match_method"])
           for r in R.evaluate_rows(odd_records(spark), keep_blank=True).collect()}
    assert got[0] == (["a", "b"], 2, "exact")
    assert got[1] == (["a", "b"], 2, "number")
    assert got[2] == (["first", "second"], 1, "letter")
    assert got[3] == (["later", "b"], 1, "exact")
    assert got[4] == (["again"], 1, "letter")
    assert got[6][0] == [f"o{i}" for i in range(1, 13)] and got[6][1:] == (11, "exact")
    assert got[10] == (["seven", "huge"], 1, "exact")
    assert got[11][1:] == (0, None)


def test_filter_on_blank_rows_stays_above_a_join(spark):
    """Pushed into a join, the test would compute the folded cells of each row twice."""
    names = spark.createDataFrame([(i, f"k{i}") for i in range(14)], "rec_no long, name string")
    joined = odd_records(spark).join(names, "rec_no").withColumn(
        "cells", F.concat("cells", F.array(F.struct(F.lit(20).alias("pos"), F.lit("x").alias("key"), F.col("name").alias("value")))))
    plan = R.evaluate_rows(joined, keep_blank=False)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("lambda" in line for line in joins)
