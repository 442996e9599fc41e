"""Form lookups: quiz names (J02), categories (A10, S11, U-S2) and question types
(A11, J09, U-S1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import DEFAULT_QUESTION_TYPES, DISTINCT_CATEGORY_CAP, DISTINCT_TYPE_CAP, TAXONOMY
from .joins import join_small

# Fixed value: the type of posts that stand for a quiz.
POST_TYPE_QUIZ = "quiz"


def _first(quizzes: DataFrame, posts: DataFrame | None, key: str, value: str) -> DataFrame:
    """(key, value): the smallest value of the quizzes, else of the posts, per key."""
    both = quizzes.select(key, value, F.lit(0).alias("_rank"))
    if posts is not None:
        both = both.unionByName(posts.select(key, value, F.lit(1).alias("_rank")))
    return both.groupBy(key).agg(F.min(F.struct("_rank", value)).getField(value).alias(value))


def names_by_id(quizzes: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """(quiz_id, quiz_name) by the quiz table, else by the title of the post with
    that id (any type). A name that PHP takes as false ('' and '0') counts as none."""
    named = quizzes.filter(~F.col("quiz_name").isin("", "0"))
    if posts is not None:
        posts = posts.select(F.col("post_id").alias("quiz_id"), F.col("post_title").alias("quiz_name")).filter("quiz_name is not null")
    return _first(named, posts, "quiz_id", "quiz_name")


def ids_by_name(quizzes: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """(quiz_name, quiz_id) by the quiz table, else by the title of a post of type quiz.
    Titles fit exactly; of several the smallest id counts. Quiz id 0 counts as none where
    there are posts to look in."""
    known = quizzes.filter(F.col("quiz_name").isNotNull())
    if posts is not None:
        known = known.filter(F.col("quiz_id") != 0)
        posts = posts.filter((F.col("post_type") == POST_TYPE_QUIZ) & F.col("post_title").isNotNull()).select(
            F.col("post_title").alias("quiz_name"), F.col("post_id").alias("quiz_id"))
    return _first(known, posts, "quiz_name", "quiz_id")


def quiz_names(ids: DataFrame, quizzes: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Quiz id -> name; '' for ids <= 0 or without a quiz row and post."""
    names = names_by_id(quizzes, posts).withColumnRenamed("quiz_name", "_name")
    out = join_small(ids, names, "quiz_id", "left")
    return out.withColumn("quiz_name", F.when(F.col("quiz_id") > 0, F.coalesce(F.col("_name"), F.lit("")))
                          .otherwise(F.lit(""))).drop("_name")


def part_questions(part: DataFrame) -> DataFrame:
    """An existing questions table derived from ``part`` (category / type columns)."""
    k = F.col("p_partkey")
    return part.select(
        k.cast("long").alias("question_id"),
        F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.lit("  ")).otherwise(F.col("p_type")).alias("category"),
        (F.col("p_size") % 5).cast("long").alias("question_type"),
        F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("question_type_new"))


def distinct_categories(questions: DataFrame, cap: int = DISTINCT_CATEGORY_CAP) -> DataFrame:
    """A10: ``DISTINCT category WHERE category <> '' LIMIT 200`` (ordered, so the cap is
    deterministic), then the F33 trim test and sanitizing; the cap is the feature."""
    d = (questions.select("category").filter(F.col("category") != "").distinct()
         .orderBy("category").limit(cap))
    return (d.filter(T.php_trim(F.col("category")) != "")
            .select(T.sanitize_text_field(F.col("category")).alias("category")).distinct())


def category_choices(terms: DataFrame, questions: DataFrame) -> DataFrame:
    """U-S2: taxonomy terms if any exist, else the distinct category text.

    The "else" branch is an anti join on a constant key against at most one row, so
    the choice is made inside the plan, with no driver round trip.
    """
    terms = terms.filter(F.col("taxonomy") == TAXONOMY)
    t = terms.select(F.col("term_id").cast("string").alias("choice_key"), F.col("name").alias("label"))
    cats = distinct_categories(questions).select(F.col("category").alias("choice_key"),
                                                 F.col("category").alias("label"))
    any_term = terms.select(F.lit(1).alias("_k")).limit(1)
    cats = cats.withColumn("_k", F.lit(1)).join(F.broadcast(any_term), "_k", "left_anti").drop("_k")
    return t.unionByName(cats)


def question_types(questions: DataFrame, cap: int = DISTINCT_TYPE_CAP) -> DataFrame:
    """A11 + J09: defaults first; the first ``cap`` types that have a label are added with
    their first label (types before labels, so no type's labels can use up the limit)."""
    disc = (questions.filter(F.length("question_type_new") > 0).groupBy("question_type")
            .agg(F.min("question_type_new").alias("_label")).orderBy("question_type").limit(cap)
            .select(F.col("question_type").cast("string").alias("type_key"),
                    T.sanitize_text_field(F.col("_label")).alias("label")))
    spark = questions.sparkSession
    defaults = spark.createDataFrame(DEFAULT_QUESTION_TYPES, "type_key string, label string")
    new = join_small(disc, defaults.select("type_key"), "type_key", "left_anti")
    return defaults.unionByName(new)
