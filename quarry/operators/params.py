"""Import-parameter resolution on the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import (CATEGORY_KEYS, CORRECT_MARK_KEYS, DEFAULT_CORRECT_MARK,
                                   DEFAULT_INCORRECT_MARK, INCORRECT_MARK_KEYS, QUIZ_KEYS,
                                   TYPE_KEYS)
from . import lookups as L
from .joins import join_small


def _param(key: str):
    return F.try_element_at(F.col("params"), F.lit(key))


def _first_mark(keys: list[str], default: float):
    """First alias whose trimmed value is non-blank and whose sanitized value is numeric
    (aliases failing the test are skipped), as floatval; else ``default``."""
    vals = F.array(*[_param(k) for k in keys])
    ok = F.filter(vals, lambda v: (T.php_trim(F.coalesce(v, F.lit(""))) != "")
                  & T.is_numeric(T.sanitize_text_field(v)))
    first = F.get(ok, 0)
    return F.when(first.isNotNull(), T.php_floatval(T.sanitize_text_field(first))) \
        .otherwise(F.lit(default)).cast("double")


def resolve_params(manifest: DataFrame, quizzes: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Add quiz_id, quiz_name, category_input, category_is_numeric, question_type,
    correct_mark and incorrect_mark to each manifest row.

    Quiz: the first alias whose trimmed value is numeric (intval) or names an existing
    quiz with a non-zero id; aliases that resolve to nothing are skipped. The name
    lookup is one set-oriented join of (import, alias rank, name) to ``quizzes``.
    """
    from .rows import cached

    def cat_expr():
        # the first non-blank alias wins; only that value is sanitized
        picks = [F.when(T.php_trim(F.coalesce(_param(k), F.lit(""))) != "", _param(k)) for k in CATEGORY_KEYS]
        first = F.coalesce(*picks)
        return F.when(first.isNotNull(), T.sanitize_text_field(first)).otherwise(F.lit(""))

    def type_expr():
        types = [F.when(T.is_numeric(_param(k)), T.php_intval(_param(k))) for k in TYPE_KEYS]
        return F.coalesce(*types, F.lit(0)).cast("long")

    base = manifest.withColumns({
        "category_input": cached("p_category", cat_expr),
        "question_type": cached("p_type", type_expr),
        "correct_mark": cached("p_cm", lambda: _first_mark(CORRECT_MARK_KEYS, DEFAULT_CORRECT_MARK)),
        "incorrect_mark": cached("p_im", lambda: _first_mark(INCORRECT_MARK_KEYS, DEFAULT_INCORRECT_MARK)),
    }).withColumn("category_is_numeric", cached("p_catnum", lambda: T.is_numeric(F.col("category_input"))))

    # One candidate per (import, alias rank); numeric -> intval, else name lookup.
    cand = manifest.select(
        "import_id",
        F.posexplode(F.array(*[T.php_trim(F.coalesce(_param(k), F.lit(""))) for k in QUIZ_KEYS]))
        .alias("rank", "val"),
    ).filter(F.col("val") != "")
    by_name = L.ids_by_name(quizzes, posts).withColumnsRenamed({"quiz_name": "val", "quiz_id": "named_id"})
    cand = join_small(cand, by_name, "val", "left")
    cand = cand.withColumn(
        "cand_id",
        F.when(T.is_numeric(F.col("val")), T.php_intval(F.col("val")))
        .when(F.coalesce(F.col("named_id"), F.lit(0)) != 0, F.col("named_id")))
    first = (cand.filter(F.col("cand_id").isNotNull())
             .groupBy("import_id").agg(F.min_by("cand_id", "rank").alias("quiz_id")))
    out = join_small(base, first, "import_id", "left").withColumn(
        "quiz_id", F.coalesce(F.col("quiz_id"), F.lit(0)).cast("long"))

    return L.quiz_names(out, quizzes, posts)  # J02


def quiz_lookup_by_name(names: DataFrame, quizzes: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """J01 alone: each name -> quiz id by the quiz table, else by post title (NULL if none)."""
    return join_small(names, L.ids_by_name(quizzes, posts), "quiz_name", "left")


def ordered_quizzes(quizzes: DataFrame) -> DataFrame:
    """Quizzes by id."""
    return quizzes.select("quiz_id", "quiz_name").orderBy("quiz_id")


__all__ = ["resolve_params", "quiz_lookup_by_name", "ordered_quizzes"]
