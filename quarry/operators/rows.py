"""Row-level import semantics (F04-F21, F37-F39) as one narrow projection.

Input: a records frame ``(import_id, rec_no, orig_row, cells)`` where ``cells`` is the
ordered ``ARRAY<STRUCT<pos, key, value>>`` of one parsed record. Nothing here shuffles:
each output column is a native Column expression over one row.

Spark interprets the body of a higher-order function, which costs more than ten times what
the same rule costs as a plain expression. So each rule has a plain form, over keys joined
to one text and over the first ``UNROLLED`` options, with an exact test of where it holds;
the other rows (repeated or odd keys, more options) take the higher-order form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .parallel import spread
from ..functions.constants import (CORRECT_GENERIC, CORRECT_KEYS, MSG_MISSING_QUESTION,
                                   MSG_NO_OPTIONS, MSG_UNMATCHED, OPTION_NUMBERED_RE,
                                   OPTION_PREFIX_RE)

MAX_LONG = 9223372036854775807

#: Options that the plain forms spell out one by one; rows with more take the general ones.
UNROLLED = 8

#: Stands for a blank option: trimmed text is never this alone.
BLANK = "\x00"

# Over keys that are joined by line feeds (and hold none): a character that folding may
# change; a key holds another line terminator; the numbered option keys.
_ENDS = r"[ \t\r\x00\x0B]"
MAYBE_FOLDED_RE = r"[A-Z \t\r\x00\x0B]"
LINE_END_RE = r"[\r\x{85}\x{2028}\x{2029}]"
NUMBERED_KEYS_RE = r"(?m)^(?:option|answer|opt|ans)[ \t\x0B\f_]?[0-9]+$"


# ---------------------------------------------------------------------------
# Key folding and PHP array-assignment collapse
# ---------------------------------------------------------------------------
def fold_key_case(cells: Column) -> Column:
    """keys -> ASCII lower(trim); NULL values -> ''."""
    return F.transform(cells, lambda c: F.struct(
        c["pos"].alias("pos"), T.ascii_lower(T.php_trim(c["key"])).alias("key"),
        F.coalesce(c["value"], F.lit("")).alias("value")))


def collapse_keys(folded: Column) -> Column:
    """a repeated key keeps its first position and its last value (PHP array
    assignment). Only rows that really repeat a key pay for the quadratic collapse."""
    keys = F.transform(folded, lambda c: c["key"])
    collapsed = F.transform(
        F.filter(folded, lambda c, i: ~F.exists(F.slice(folded, F.lit(1), i), lambda p: p["key"] == c["key"])),
        lambda c: F.struct(
            c["pos"].alias("pos"), c["key"].alias("key"),
            F.try_element_at(F.filter(folded, lambda p: p["key"] == c["key"]), F.lit(-1))["value"]
            .alias("value")))
    return F.when(F.size(F.array_distinct(keys)) == F.size(folded), folded).otherwise(collapsed)


def fold_keys(df: DataFrame, col: str = "cells") -> DataFrame:
    """F08 + F09 on a records frame."""
    return df.withColumn(col, normalized_cells(F.col(col)))


def cell(cells: Column, key: str) -> Column:
    """Value for ``key`` (NULL when absent); keys are unique after ``fold_keys``."""
    return F.get(F.filter(cells, lambda c: c["key"] == F.lit(key)), 0)["value"]


def value_at(cells: Column, key: Column | str) -> Column:
    """``cell`` as a plain expression."""
    return F.get(cells["value"], F.array_position(cells["key"], key).cast("int") - 1)


def has_content(cells: Column) -> Column:
    """some cell is non-empty after F02 normalization. Without any '&' an ASCII letter
    or digit decides for the whole record (see ``has_visible_text``)."""
    text = F.array_join(cells["value"], " ")
    return (~text.contains("&") & text.rlike("[0-9A-Za-z]")) | F.exists(cells, lambda c: T.has_visible_text(c["value"]))


def has_content_trim_only(cells: Column) -> Column:
    """some cell is non-empty after plain trim."""
    return F.exists(cells, lambda c: T.php_trim(F.coalesce(c["value"], F.lit(""))) != F.lit(""))


# ---------------------------------------------------------------------------
# options
# ---------------------------------------------------------------------------
def _option_like(key: Column, regex: str) -> Column:
    """Key test with a cheap exact prefilter: every option-like key starts with 'o'
    or 'a' (keys are ASCII-lower-cased by F08), so the regex runs only on those."""
    return F.substring(key, 1, 1).isin("o", "a") & key.rlike(regex)


def numbered_candidates(cells: Column) -> Column:
    """Non-blank cells whose key is ``option|answer|opt|ans`` + number, as (n, p, v)."""
    cand = F.filter(cells, lambda c: _option_like(c["key"], OPTION_NUMBERED_RE)
                    & (T.php_trim(c["value"]) != ""))
    return F.transform(cand, lambda c: F.struct(
        F.coalesce(F.regexp_extract(c["key"], OPTION_NUMBERED_RE, 2).try_cast("long"),
                   F.lit(MAX_LONG)).alias("n"),
        c["pos"].alias("p"),
        T.php_trim(c["value"]).alias("v")))


def compact_numbered(numbered: Column) -> Column:
    """Same number twice -> the later key wins; sort by number; compact to 1..n.
    The quadratic duplicate check runs only when a number repeats."""
    kept = F.filter(numbered, lambda x: ~F.exists(
        numbered, lambda y: (y["n"] == x["n"]) & (y["p"] > x["p"])))
    unique = F.size(F.array_distinct(F.transform(numbered, lambda x: x["n"]))) == F.size(numbered)
    return F.transform(F.sort_array(F.when(unique, numbered).otherwise(kept)), lambda x: x["v"])


def options_prefixed(cells: Column) -> Column:
    cand = F.filter(cells, lambda c: _option_like(c["key"], OPTION_PREFIX_RE) & (T.php_trim(c["value"]) != ""))
    return F.transform(cand, lambda c: T.sanitize_text_field_fast(T.php_trim(c["value"])))


# ---------------------------------------------------------------------------
# Correct answer
# ---------------------------------------------------------------------------
def correct_source(cells: Column) -> Column:
    """Raw (untrimmed) text of the first non-blank alias, else the first non-blank cell
    whose key contains 'correct'; '' when none."""
    picks = []
    for k in CORRECT_KEYS:
        v = value_at(cells, k)
        picks.append(F.when(T.php_trim(F.coalesce(v, F.lit(""))) != "", v))
    generic = F.get(F.filter(cells, lambda c: (F.instr(T.ascii_lower(c["key"]), CORRECT_GENERIC) > 0)
                             & (T.php_trim(c["value"]) != "")), 0)["value"]
    return F.coalesce(*picks, generic, F.lit(""))


def first_index(opts: Column, test) -> Column:
    """1-based index of the first of ``opts`` (no nulls) for which ``test`` holds, else 0."""
    found = F.when(test(F.get(opts, 0)), F.lit(1))
    for i in range(1, UNROLLED):
        found = found.when(test(F.get(opts, i)), F.lit(i + 1))
    more = F.array_position(F.transform(opts, test), F.lit(True)).cast("int")
    return found.when(F.size(opts) > UNROLLED, more).otherwise(F.lit(0))


def ladder(df: DataFrame, strict_letters: bool = False) -> DataFrame:
    """adds ``_i`` (1-based index or 0) and ``_method`` for ``opts`` and ``correct_raw``.

    Each step is bound once and the substring scan runs only when the exact and
    number/letter steps fail.
    """
    opts, raw = F.col("opts"), F.col("correct_raw")
    # Q1: by default a letter a-f anywhere counts ("None" -> E); strict mode
    # accepts only an answer that is exactly one letter.
    df = df.withColumn("_rt", T.php_trim(raw))
    df = df.withColumns({
        "_lower": F.lower("_rt"), "_folded": T.ascii_lower("_rt"),
        "_digits": F.regexp_extract("_rt", r"[0-9]+", 0),
        "_letter": F.regexp_extract("_rt", r"^[a-fA-F]$" if strict_letters else r"[a-fA-F]", 0)})

    def build():
        # a failed cast costs an exception each, so text without digits is not cast
        num = F.when(F.col("_digits") != "", F.col("_digits").try_cast("long"))
        num_ok = F.coalesce(num.between(1, 6), F.lit(False))
        parsed = (F.when(num_ok, num).when(F.col("_letter") != "", F.ascii(F.upper("_letter")) - 64)
                  .otherwise(F.lit(0)))
        return {"_exact": first_index(opts, lambda o: F.lower(T.php_trim(o)) == F.col("_lower")),
                "_num_ok": num_ok, "_parsed": parsed.cast("long")}

    df = computed(df, "ladder", build)
    parsed_ok = (F.col("_parsed") > 0) & (F.col("_parsed") <= F.size(opts))
    known = (raw == "") | (F.col("_exact") > 0) | parsed_ok
    df = computed(df, "substring", lambda: {"_sub": F.when(known, F.lit(0)).otherwise(
        first_index(opts, lambda o: F.instr(T.ascii_lower(T.php_trim(o)), F.col("_folded")) > 0))})
    return computed(df, "method", lambda: {
        "_i": F.when(raw == "", F.lit(0)).when(F.col("_exact") > 0, F.col("_exact"))
        .when(parsed_ok, F.col("_parsed").cast("int")).otherwise(F.col("_sub")),
        "_method": F.when(raw == "", F.lit("blank")).when(F.col("_exact") > 0, F.lit("exact"))
        .when(parsed_ok, F.when(F.col("_num_ok"), F.lit("number")).otherwise(F.lit("letter")))
        .when(F.col("_sub") > 0, F.lit("substring")).otherwise(F.lit("none"))})


# ---------------------------------------------------------------------------
# The whole row projection
# ---------------------------------------------------------------------------
_COLUMN_CACHE: dict = {}


def cached(name: str, build) -> Column:
    """Build a fixed Column expression once per JVM and reuse it.

    Row expressions over fixed column names are unresolved trees; reusing them
    avoids thousands of Py4J calls per query plan.
    """
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    key = (name, id(sc))
    col = _COLUMN_CACHE.get(key)
    if col is None:
        col = build()
        _COLUMN_CACHE[key] = col
    return col


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(value)``: ``transform(array(v), x -> body)[0]``.

    Later references are lambda-variable field accesses, which the optimizer cannot
    inline, so a value used many times is computed once and the plan stays linear.
    """
    return F.get(F.transform(F.array(value), body), 0)


def computed(df: DataFrame, name: str, build) -> DataFrame:
    """Adds the columns of ``build()``; ``name`` keys the expression cache. One that is used
    more than once isn't copied into the projections above."""
    return df.withColumns(cached(f"computed:{name}", build))


def fixed(df: DataFrame, *names: str) -> DataFrame:
    """The same rows; a filter above on one of the named columns is not pushed below, where it
    would compute them again. (They pass through ``inline`` as one row; rules stay outside of
    it, as Spark interprets a generator that holds a higher-order function.)"""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def normalized_cells(cells: Column) -> Column:
    """F08 + F09 with the folded array bound once. Cells whose keys are distinct and folded
    already, without NULL values, stay as they are; keys without line feeds are folded as
    one text."""
    keys, values = cells["key"], cells["value"]
    joined = F.array_join(keys, "\n", "\n")
    # null for an array without BLANK, but with a null
    filled = ~F.array_contains(values, BLANK)
    # a line feed at the end of a key meets the next one, or an end of the text
    fed = joined.contains("\n\n") | joined.startswith("\n") | joined.endswith("\n")
    plain = filled & ~fed & ~joined.rlike(MAYBE_FOLDED_RE) & (F.size(F.array_distinct(keys)) == F.size(keys))
    folded = F.split(F.regexp_replace(T.ascii_lower(joined), rf"(?<=\A|\n){_ENDS}+|{_ENDS}+(?=\n|\z)", ""), "\n", -1)
    whole = filled & (F.size(folded) == F.size(keys)) & (F.size(F.array_distinct(folded)) == F.size(keys))
    return (F.when(plain, cells)
            .when(whole, F.arrays_zip(cells["pos"].alias("pos"), folded.alias("key"), values.alias("value")))
            .otherwise(let(fold_key_case(cells), collapse_keys)))


def with_options(df: DataFrame) -> DataFrame:
    """Adds ``opts``: F13 numbered options compacted 1..n, else F14 prefix keys in cell order
    (F15 is unreachable). The numbered ones are spelled out where their keys stand in the order
    of the numbers, UNROLLED at most."""
    cells = F.col("cells")
    joined = F.array_join(cells["key"], "\n", "\n")

    def keys():
        clean = (F.size(F.split(joined, "\n", -1)) == F.size(cells)) & ~joined.rlike(LINE_END_RE)
        return {"_keys": F.when(clean, F.regexp_extract_all(joined, F.lit(NUMBERED_KEYS_RE), F.lit(0)))}

    key = [F.get("_keys", i) for i in range(UNROLLED)]

    def numbers():
        return {"_numbers": F.transform("_keys", lambda k: F.regexp_extract(k, "[0-9]+$", 0).try_cast("long"))}

    def numbered():
        number = [F.get("_numbers", i) for i in range(UNROLLED)]
        in_order = F.size("_keys") <= UNROLLED
        for i in range(1, UNROLLED):
            in_order &= key[i].isNull() | F.coalesce(number[i - 1] < number[i], F.lit(False))
        value = [F.coalesce(F.nullif(T.php_trim(value_at(cells, k)), F.lit("")), F.lit(BLANK)) for k in key]
        return {"_numbered": F.when(in_order, F.array_remove(F.array(*value), BLANK))
                .otherwise(let(numbered_candidates(cells), compact_numbered))}

    def opts():
        found = F.col("_numbered")
        rough = F.array_join(found, "x").rlike(T.SANITIZE_SLOW_RE)
        return {"opts": F.when(F.size(found) == 0, options_prefixed(cells))
                .when(rough, F.transform(found, T.sanitize_text_field_fast)).otherwise(found)}

    for name, build in (("keys", keys), ("numbers", numbers), ("numbered", numbered), ("opts", opts)):
        df = computed(df, name, build)
    return df


def evaluate_rows(records: DataFrame, keep_blank: bool = False, strict_letters: bool = False) -> DataFrame:
    """Fold keys, drop blank rows (F04) and evaluate every row rule.

    Output adds: question_text, explanation, opts, correct_raw, correct_index,
    match_method, row_status ('ok' | 'missing_question' | 'no_options'), and the
    row message (E1 / E2 / E3) with its severity and code.
    """
    df = spread(records)
    kept = df.columns
    df = fixed(computed(df, "cells", lambda: {"cells": normalized_cells(F.col("cells"))}), "cells")
    df = computed(df, "is_blank", lambda: {"is_blank": ~has_content(F.col("cells"))})
    if not keep_blank:
        df = df.filter(~F.col("is_blank"))
    else:
        kept = [*kept, "is_blank"]
    df = with_options(df)

    def fields():
        c = F.col("cells")
        return {"question_text": T.php_trim(F.coalesce(value_at(c, "question"), F.lit(""))),
                "explanation": T.php_trim(F.coalesce(value_at(c, "explanation"), F.lit(""))),
                "correct_raw": correct_source(c)}

    df = ladder(computed(df, "fields", fields), strict_letters)

    def status():
        st = (F.when(F.col("question_text") == "", F.lit("missing_question"))
              .when(F.size("opts") == 0, F.lit("no_options")).otherwise(F.lit("ok")))
        return {"row_status": st}

    def outcome():
        st, row = F.col("row_status"), F.col("orig_row")
        mm = F.when(st == "ok", F.col("_method"))
        return {
            "correct_index": F.when(st == "ok", F.col("_i")).otherwise(F.lit(0)), "match_method": mm,
            "message": F.when(st == "missing_question", F.format_string(MSG_MISSING_QUESTION, row))
            .when(st == "no_options", F.format_string(MSG_NO_OPTIONS, row))
            .when(mm == "none", F.format_string(MSG_UNMATCHED, row, T.sanitize_text_field(F.col("correct_raw")))),
            "severity": F.when(st != "ok", F.lit("error")).when(mm == "none", F.lit("warning")),
            "code": F.when(st == "missing_question", F.lit("E1")).when(st == "no_options", F.lit("E2"))
            .when(mm == "none", F.lit("E3"))}

    df = computed(computed(df, "status", status), "outcome", outcome)
    made = ["question_text", "explanation", "opts", "correct_raw", "row_status", "correct_index",
            "match_method", "message", "severity", "code"]
    return fixed(df.select(*kept, *made), *made)


def score_answers(opts: Column, index: Column, correct_mark: Column, incorrect_mark: Column) -> Column:
    """``ARRAY<STRUCT<text, points, is_correct>>`` with batch marks."""
    def answer(o, i):
        return F.struct(o.alias("text"),
                        F.when(i + 1 == index, correct_mark).otherwise(incorrect_mark).cast("double").alias("points"),
                        (i + 1 == index).cast("int").alias("is_correct"))

    few = F.slice(F.array(*[answer(F.get(opts, i), F.lit(i)) for i in range(UNROLLED)]), F.lit(1), F.size(opts))
    return F.when(F.size(opts) <= UNROLLED, few).otherwise(F.transform(opts, answer))
