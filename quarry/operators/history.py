"""Import history and rollback.

Logs are never updated in place: status changes are appended as events and the
current status is the latest event per log (``max_by``). Questions and links are
never deleted in place: a rollback produces the set of ids to remove, and readers
anti-join it (or a compaction job rewrites the table to a fresh path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.constants import (MSG_ALREADY_ROLLED_BACK, MSG_BAD_LOG_ID, MSG_LOG_NOT_FOUND, MSG_NO_IDS, MSG_ROLLBACK_DONE,
                                   NO_QUIZ_LABEL, RECENT_PAGE_SIZE, STATUS_ROLLED_BACK)
from .joins import join_small
from .lookups import names_by_id

# Ids are laid out in blocks of 2^20 and id ranges joined by buckets of 2^10.
BLOCK_BITS, RANGE_BITS = 20, 10

DATETIME_FMT = "yyyy-MM-dd HH:mm:ss"


def counts_text(success: Column, failed: Column) -> Column:
    """'%d imported / %d failed'."""
    return F.format_string("%d imported / %d failed", F.coalesce(success, F.lit(0)),
                           F.coalesce(failed, F.lit(0)))


def rollback_eligible(n_ids: Column, status: Column) -> Column:
    """F31 (Q13 fixed): ids present and not already rolled back."""
    return (F.coalesce(n_ids, F.lit(0)) > 0) & (F.lower(F.coalesce(status, F.lit(""))) != "rolledback")


def current_status(logs: DataFrame, events: DataFrame | None) -> DataFrame:
    """The latest status event per log wins over the stored status."""
    if events is None:
        return logs
    latest = events.groupBy("id").agg(F.max_by("status", "event_seq").alias("_st"))
    out = join_small(logs, latest, "id", "left")
    return out.withColumn("status", F.coalesce(F.col("_st"), F.col("status"))).drop("_st")


def recent_page(logs: DataFrame, page: int = 1, per_page: int = RECENT_PAGE_SIZE) -> DataFrame:
    """Newest first, ``page`` >= 1; ties broken by id (ours). Planned as a
    top-k (TakeOrderedAndProject with offset), never a full sort."""
    page = max(1, int(page))
    per_page = max(1, int(per_page))
    return (logs.orderBy(F.col("import_time").desc(), F.col("id").desc())
            .offset((page - 1) * per_page).limit(per_page)
            .select("id", "file_name", "quiz_name",
                    F.date_format("import_time", DATETIME_FMT).alias("import_time"),
                    counts_text(F.col("success_rows"), F.col("failed_rows")).alias("counts"),
                    "status",
                    rollback_eligible(F.col("n_question_ids"), F.col("status")).alias("can_rollback")))


def get_logs(logs: DataFrame, per_page: int = RECENT_PAGE_SIZE, offset: int = 0) -> DataFrame:
    """``per_page`` clamped to >= 1 and ``offset`` to >= 0."""
    per_page, offset = max(1, int(per_page)), max(0, int(offset))
    return logs.orderBy(F.col("import_time").desc(), F.col("id").desc()).offset(offset).limit(per_page)


def page_count(logs: DataFrame, per_page: int = RECENT_PAGE_SIZE) -> DataFrame:
    """A01 + A12: total logs and number of pages."""
    return logs.agg(F.count("*").alias("total")).select(
        "total", F.lit(per_page).cast("long").alias("per_page"),
        F.ceil(F.col("total") / F.lit(per_page)).cast("long").alias("pages"))


def import_detail(logs: DataFrame, quizzes: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """F30 + J03 + F40: display fields of each log; name from the log, else the quiz
    table or a post's title (only for quiz_id > 0), else the not-set label."""
    names = names_by_id(quizzes, posts).withColumnRenamed("quiz_name", "_qn")
    out = join_small(logs, names, "quiz_id", "left")
    logged = T.php_trim(F.coalesce(F.col("quiz_name"), F.lit("")))
    looked = F.when(F.col("quiz_id") > 0, F.coalesce(F.col("_qn"), F.lit(""))).otherwise(F.lit(""))
    name = F.when(logged != "", logged).otherwise(looked)
    return out.select(
        "id", "file_name",
        F.when(name == "", F.lit(NO_QUIZ_LABEL)).otherwise(name).alias("display_quiz_name"),
        F.date_format("import_time", DATETIME_FMT).alias("import_time"),
        counts_text(F.col("success_rows"), F.col("failed_rows")).alias("counts"),
        F.coalesce(F.col("total_rows"), F.lit(0)).alias("total_rows"), "status",
        rollback_eligible(F.col("n_question_ids"), F.col("status")).alias("can_rollback"))


def rollback_plan(requests: DataFrame, logs: DataFrame, questions: DataFrame) -> dict[str, DataFrame]:
    """F32 + J04-J06 + A09 + K05 for many rollback requests at once.

    ``requests(log_id)``; ``logs(id, status, n_question_ids, ...)``;
    ``questions(question_id, import_id, ...)``: those that still exist, ``import_id`` being
    the log's id. ``attempted`` is the number of ids the log names, ``removed`` the number
    of questions that go. Returns outcome rows, the questions to remove, the status events
    to append and the rolled-back logs.
    """
    lg = logs.select(F.col("id").alias("log_id"), F.col("status").alias("_status"),
                     F.col("n_question_ids").alias("_n"), F.lit(True).alias("_found"))
    outcome = (F.when(F.col("log_id") == 0, F.lit("invalid_id"))
               .when(F.col("_found").isNull(), F.lit("not_found"))
               .when(F.coalesce(F.col("_n"), F.lit(0)) <= 0, F.lit("no_ids"))
               .when(F.lower(F.coalesce(F.col("_status"), F.lit(""))) == "rolledback", F.lit("already_rolled_back"))
               .otherwise(F.lit("rolled_back")))
    req = requests.join(lg, "log_id", "left").withColumn("outcome", outcome)
    ok = req.filter(F.col("outcome") == "rolled_back").select("log_id").distinct()
    # semi join against the small set of rolled-back logs, then partial aggregates: the
    # questions table is read once and never shuffled by question id
    removed = join_small(questions, ok.select(F.col("log_id").alias("import_id")), "import_id", "left_semi")
    per_log = removed.groupBy(F.col("import_id").alias("log_id")).agg(F.count("*").alias("removed"))
    done = F.col("outcome") == "rolled_back"
    res = req.join(per_log, "log_id", "left").select(
        "log_id", "outcome", F.when(done, F.col("_n")).otherwise(F.lit(0)).cast("long").alias("attempted"),
        F.when(done, F.coalesce(F.col("removed"), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("removed"))
    message = (F.when(F.col("outcome") == "invalid_id", F.lit(MSG_BAD_LOG_ID))
               .when(F.col("outcome") == "not_found", F.lit(MSG_LOG_NOT_FOUND))
               .when(F.col("outcome") == "no_ids", F.lit(MSG_NO_IDS))
               .when(F.col("outcome") == "already_rolled_back", F.lit(MSG_ALREADY_ROLLED_BACK))
               .otherwise(F.format_string(MSG_ROLLBACK_DONE, F.col("attempted"))))
    res = res.withColumn("message", message)
    events = ok.select(F.col("log_id").alias("id"), F.lit(STATUS_ROLLED_BACK).alias("status"))
    return {"outcomes": res, "removed": removed, "events": events,
            "imports": ok.select(F.col("log_id").alias("import_id"))}


def without_imports(table: DataFrame, imports: DataFrame, key: str = "import_id") -> DataFrame:
    """J04 at import granularity: rows of imports that were not rolled back.

    A rollback removes every question of a log, so the anti join runs against the
    small set of rolled-back import ids (broadcast behind a size check) instead of
    shuffling the questions table against an id list."""
    return join_small(table, imports.select(F.col("import_id").alias(key)).distinct(), key, "left_anti")


def block_of(id_col: Column, bits: int = BLOCK_BITS) -> Column:
    """The block of ``2 ** bits`` ids that an id lies in."""
    return F.shiftright(id_col.cast("long"), bits)


def removed_ranges(ids: DataFrame) -> DataFrame:
    """Id sets as disjoint ranges (bits, bucket, first_id, last_id), none across a bucket.

    ``ids`` has ``question_id``, or ``first_id`` and ``last_id``. Whole blocks of
    2^BLOCK_BITS ids are one row; the rest is cut at 2^RANGE_BITS ids and merged there, so
    a bucket has at most half as many ranges as ids and a long range few rows.
    """
    if "question_id" in ids.columns:
        ids = ids.select(F.col("question_id").alias("first_id"), F.col("question_id").alias("last_id"))
    ids = ids.select(F.col("first_id").cast("long").alias("f"), F.col("last_id").cast("long").alias("l")).filter("f <= l")

    def cut(df: DataFrame, bits: int) -> DataFrame:
        b = F.explode(F.sequence(block_of(F.col("f"), bits), block_of(F.col("l"), bits)))
        df = df.select("f", "l", b.alias("bucket"))
        low = F.shiftleft(F.col("bucket"), bits)
        return df.select("bucket", F.greatest("f", low).alias("f"), F.least("l", low + (1 << bits) - 1).alias("l")).distinct()

    blocks = cut(ids, BLOCK_BITS)
    whole = F.col("l") - F.col("f") + 1 == 1 << BLOCK_BITS
    full = blocks.filter(whole).select("bucket").distinct()
    rest = cut(blocks.filter(~whole).join(full, "bucket", "left_anti").select("f", "l"), RANGE_BITS)
    # ranges that touch or overlap what came before in their bucket belong together
    before = Window.partitionBy("bucket").orderBy("f", "l").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("bucket").orderBy("f", "l")
    rest = rest.withColumn("new", (F.col("f") > F.coalesce(F.max("l").over(before), F.col("f") - 2) + 1).cast("int"))
    rest = rest.withColumn("no", F.sum("new").over(upto)).groupBy("bucket", "no").agg(
        F.min("f").alias("first_id"), F.max("l").alias("last_id"))
    low = F.shiftleft(F.col("bucket"), BLOCK_BITS)
    return (rest.select(F.lit(RANGE_BITS).alias("bits"), "bucket", "first_id", "last_id").unionByName(
        full.select(F.lit(BLOCK_BITS).alias("bits"), "bucket", low.alias("first_id"),
                    (low + (1 << BLOCK_BITS) - 1).alias("last_id"))))


def without_ids(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (question_id, id_block, ...) that no range covers.

    Anti joins on the block and on the bucket, so a row meets the ranges of its own bucket
    only; ranges of bounded size are broadcast and the rows stay where they are.
    """
    full = ranges.filter(F.col("bits") == BLOCK_BITS).select(F.col("bucket").alias("id_block")).distinct()
    part = ranges.filter(F.col("bits") == RANGE_BITS).select(F.col("bucket").alias("_b"), "first_id", "last_id")
    rows = join_small(rows, full, "id_block", "left_anti")
    inside = (block_of(F.col("question_id"), RANGE_BITS) == F.col("_b")) & F.col("question_id").between(
        F.col("first_id"), F.col("last_id"))
    return join_small(rows, part, inside, "left_anti")


def matches(where: dict) -> Column:
    """The AND of equalities; false where one is unknown."""
    pred = F.lit(True)
    for k, v in where.items():
        pred = pred & (F.col(k) == F.lit(v))
    return F.coalesce(pred, F.lit(False))


def safe_delete(table: DataFrame, where: dict) -> tuple[DataFrame, DataFrame] | None:
    """Delete rows matching the AND of equalities; an empty table or clause gives
    ``None`` (the reference returns false). Returns (remaining rows, deleted count)."""
    if table is None or not where:
        return None
    hit = matches(where)
    remaining = table.filter(~hit)
    deleted = table.agg(F.count_if(hit).alias("deleted"))
    return remaining, deleted


def update_log_fields(logs: DataFrame, log_id: int, data: dict) -> DataFrame:
    """K05 generic form: new values for the given fields of one log (write to a fresh
    path; never overwrite the path being read). Empty id or data -> ``None``."""
    if not log_id or not data:
        return None
    out = logs
    for k, v in data.items():
        out = out.withColumn(k, F.when(F.col("id") == F.lit(int(log_id)), F.lit(v)).otherwise(F.col(k)))
    return out


def log_defaults(logs: DataFrame) -> DataFrame:
    """every log field cast with its default when missing (status 'pending');
    file names lose tags, quiz names and status are sanitized text."""
    def col_or_null(name, typ):
        return F.col(name).cast(typ) if name in logs.columns else F.lit(None).cast(typ)

    def as_long(name):
        v = col_or_null(name, "string")
        return F.when(T.is_numeric(v), T.php_intval(v)).otherwise(F.lit(0)).cast("long")

    return logs.select(
        col_or_null("id", "long").alias("id"),
        F.coalesce(T.strip_all_tags(col_or_null("file_name", "string")), F.lit("")).alias("file_name"),
        as_long("uploader_id").alias("uploader_id"), as_long("quiz_id").alias("quiz_id"),
        F.when(col_or_null("quiz_name", "string").isNull(), F.lit(""))
        .otherwise(T.sanitize_text_field(col_or_null("quiz_name", "string"))).alias("quiz_name"),
        F.coalesce(col_or_null("import_time", "timestamp_ntz"), F.localtimestamp()).alias("import_time"),
        F.when(col_or_null("status", "string").isNull(), F.lit("pending"))
        .otherwise(T.sanitize_text_field(col_or_null("status", "string"))).alias("status"),
        as_long("total_rows").alias("total_rows"), as_long("success_rows").alias("success_rows"),
        as_long("failed_rows").alias("failed_rows"))
