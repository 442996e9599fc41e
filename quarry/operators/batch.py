"""Batch import: ids (W01), question rows (F12, F19-F21, F37, F38), category links (K02),
row errors (F39), the per-import log aggregate (A02-A07, F34, F35) and the writes (K01-K04).

Shuffle budget: ids shuffle once on ``(import_id, id_bucket)``; the log aggregate
shuffles partial aggregates on ``import_id``. No group is ever collected into one
array: id lists are contiguous ranges, error lists are the long ``row_errors`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.constants import (ANSWER_COLUMNS, MSG_NOTICE, STATUS_PARTIAL, STATUS_SUCCESS,
                                   TAXONOMY)
from .joins import join_small, local_rows
from .rows import evaluate_rows, score_answers

# Rows of one import are ranked inside buckets of this many source rows, so a single
# huge import is spread over many window partitions instead of one task.
ID_BUCKET_ROWS = 1 << 20

# Rows of bucket counts that the driver adds up by itself.
FEW_OFFSETS = 10_000


def running_offsets(counts: DataFrame, keys: list[str], n: str = "_n", out: str = "_off") -> DataFrame:
    """Adds ``out``: the sum of ``n`` over all rows before, in the order of ``keys``.

    Up to FEW_OFFSETS rows (checked) are added up on the driver. Beyond that it is a prefix
    sum in two levels, without a window over everything: the rows are dealt into ranges
    (written once, so a range keeps its rows), the ranges' sums (one number each, as many
    as there are shuffle partitions) are added up on the driver, and a window per range does
    the rest.
    """
    spark = counts.sparkSession
    counts = materialize(counts)
    few = counts.limit(FEW_OFFSETS + 1).collect()
    if len(few) <= FEW_OFFSETS:
        total, rows = 0, []
        for r in sorted(few, key=lambda r: [(r[k] is not None, r[k]) for k in keys]):
            rows.append((*r, total))
            total += int(r[n] or 0)
        return local_rows(spark, rows, StructType([*counts.schema, StructField(out, LongType())]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counts.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r["s"] for r in ranged.groupBy("_part").agg(F.sum(n).alias("s")).collect()}
    before, total = {}, 0
    for p in sorted(sums):
        before[p], total = total, total + int(sums[p] or 0)
    start = F.lit(0).cast("long")
    if before:
        start = F.element_at(F.create_map(*[F.lit(x) for p, v in before.items() for x in (p, v)]), F.col("_part"))
    w = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(out, (start + F.coalesce(F.sum(n).over(w), F.lit(0))).cast("long")).drop("_part")


def bucket_rank(rows: DataFrame, grp: str, ordcol: str, keep, bucket_rows: int = ID_BUCKET_ROWS) -> DataFrame:
    """Adds ``_bkt`` and ``_rk``, the running count of ``keep`` rows inside the (group,
    bucket of source rows) window, so a huge group is spread over bounded windows."""
    rows = rows.withColumns({"_bkt": F.floor(F.col(ordcol) / F.lit(bucket_rows)).cast("long"),
                             "_keep": keep.cast("int")})
    # rec_no breaks ties between equal source rows, so the order is total (deterministic).
    order_cols = [ordcol] + (["rec_no"] if "rec_no" in rows.columns and ordcol != "rec_no" else [])
    w = (Window.partitionBy(grp, "_bkt").orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_rk", F.sum("_keep").over(w))


def rank_in_group(rows: DataFrame, grp: str, ordcol: str, out: str, bucket_rows: int = ID_BUCKET_ROWS) -> DataFrame:
    """Dense 1-based rank of each row inside its group, by bucketed windows."""
    ranked = bucket_rank(rows, grp, ordcol, F.lit(True), bucket_rows)
    w = Window.partitionBy(grp).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offs = ranked.groupBy(grp, "_bkt").agg(F.count("*").alias("_n")).select(
        grp, "_bkt", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return ranked.join(offs, [grp, "_bkt"]).withColumn(out, (F.col("_off") + F.col("_rk")).cast("long")) \
        .drop("_bkt", "_rk", "_off", "_keep")


def assign_ids(rows: DataFrame, base: int = 1, id_col: str = "question_id",
               order=("import_id", "orig_row"), keep=None,
               bucket_rows: int = ID_BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Dense ids in ``order`` starting at ``base`` for rows where ``keep`` holds.

    Deterministic and skew-safe: a running count of kept rows inside (group, bucket)
    windows, per-bucket counts from a scan of the two columns, their offsets by a two-level
    prefix sum, and id = base + offset + running count - 1.

    Returns (rows with ``id_col`` (NULL where not kept), per-bucket counts with offsets).
    """
    grp, ordcol = order
    keep = F.lit(True) if keep is None else keep
    buckets = rows.groupBy(F.col(grp), F.floor(F.col(ordcol) / F.lit(bucket_rows)).cast("long").alias("_bkt")).agg(
        F.sum(keep.cast("int")).alias("_n"))
    offsets = running_offsets(buckets, [grp, "_bkt"])
    ranked = bucket_rank(rows, grp, ordcol, keep, bucket_rows)
    out = join_small(ranked, offsets.select(grp, "_bkt", "_off"), [grp, "_bkt"], "inner")
    out = out.withColumn(id_col, F.when(F.col("_keep") == 1,
                                        (F.lit(base) + F.col("_off") + F.col("_rk") - 1).cast("long")))
    return out.drop("_bkt", "_rk", "_off", "_keep"), offsets


def id_ranges(offsets: DataFrame, base: int = 1, grp: str = "import_id") -> DataFrame:
    """Per group: number of ids and the contiguous range they occupy."""
    r = offsets.groupBy(grp).agg(F.sum("_n").alias("n_ids"), F.min("_off").alias("_first_off"))
    return r.select(grp, F.col("n_ids").cast("long").alias("n_ids"),
                    F.when(F.col("n_ids") > 0, F.lit(base) + F.col("_first_off")).cast("long")
                    .alias("first_question_id"),
                    F.when(F.col("n_ids") > 0, F.lit(base) + F.col("_first_off") + F.col("n_ids") - 1)
                    .cast("long").alias("last_question_id"))


def prepare(records: DataFrame, params: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Evaluate every row and attach the resolved parameters of its import."""
    ev = evaluate_rows(records, keep_blank=keep_blank)
    p = params.select("import_id", "quiz_id", "quiz_name", "category_input", "category_is_numeric",
                      "question_type", "correct_mark", "incorrect_mark", "has_taxonomy")
    ev = join_small(ev, p, "import_id", "left")
    from .rows import cached
    return ev.withColumn("answers", cached("answers", lambda: score_answers(
        F.col("opts"), F.col("correct_index"), F.col("correct_mark"), F.col("incorrect_mark"))))


def category_text(has_taxonomy, cat_input, cat_numeric):
    """stored category text (table §2.12), including the post-insert update."""
    return (F.when(cat_input == "", F.lit(""))
            .when(F.coalesce(has_taxonomy, F.lit(False)) & cat_numeric, F.lit(""))
            .otherwise(cat_input))


def with_ids(scored: DataFrame, base: int = 1) -> tuple[DataFrame, DataFrame]:
    """Ids for accepted rows of every import; also returns per-bucket offsets.

    ``scored`` is the materialized evaluation, so reading ``row_status`` twice (rows
    and offsets) costs a scan, not a second evaluation."""
    return assign_ids(scored, base=base, keep=F.col("row_status") == "ok")


def questions_from(ided: DataFrame) -> DataFrame:
    """Accepted rows (with ids) -> rows of the ``questions`` table."""
    ok = ided.filter(F.col("row_status") == "ok")
    opts = F.col("opts")
    wide = {}
    for i, name in enumerate(ANSWER_COLUMNS):
        wide[name] = F.get(opts, i)
        wide[name + "_points"] = F.get(F.col("answers"), i)["points"]
    qt = F.col("question_type")
    return ok.select(
        "question_id", "import_id", "orig_row",
        F.col("quiz_id").cast("long").alias("quiz_id"),
        F.lit("").alias("question_name"),
        F.col("answers").alias("answer_array"),
        *[v.alias(k) for k, v in wide.items()],
        F.col("correct_index").cast("long").alias("correct_answer"),
        T.kses_post(F.col("explanation")).alias("question_answer_info"),
        F.lit(1).cast("int").alias("comments"),
        F.lit("").alias("hints"),
        F.lit(0).cast("int").alias("question_order"),
        qt.cast("long").alias("question_type"),
        qt.cast("string").alias("question_type_new"),
        F.struct(F.col("question_text").alias("question_title"), F.lit("1").alias("isPublished"),
                 F.lit(1).alias("required")).alias("question_settings"),
        category_text(F.col("has_taxonomy"), F.col("category_input"), F.col("category_is_numeric"))
        .alias("category"),
        F.lit(None).cast("string").alias("category_terms"),
        F.lit(0).cast("long").alias("linked_question"),
        F.lit(0).cast("int").alias("deleted"),
        F.lit(0).cast("int").alias("deleted_question_bank"),
        F.col("has_taxonomy"), F.col("category_input"), F.col("category_is_numeric"),
    )


def category_links(questions: DataFrame) -> DataFrame:
    """One link per accepted row when the taxonomy exists and the category is a
    number whose intval is > 0."""
    term = T.php_intval(F.col("category_input"))
    return (questions
            .filter(F.coalesce(F.col("has_taxonomy"), F.lit(False)) & F.col("category_is_numeric") & (term > 0))
            .select("question_id", "quiz_id", term.alias("term_id"), F.lit(TAXONOMY).alias("taxonomy"),
                    "import_id"))


def row_errors(scored: DataFrame) -> DataFrame:
    """F39 long form: one row per message, in row order (seq is the order inside a row)."""
    first = scored.filter(F.col("message").isNotNull()).select(
        "import_id", "orig_row", F.lit(1).alias("seq"), "severity", "code", "message")
    if "message2" not in scored.columns:
        return first
    second = scored.filter(F.col("message2").isNotNull()).select(
        "import_id", "orig_row",
        F.when(F.col("message").isNotNull(), F.lit(2)).otherwise(F.lit(1)).alias("seq"),
        F.col("severity2").alias("severity"),
        F.col("code2").alias("code"), F.col("message2").alias("message"))
    return first.unionByName(second)


def log_rows(params: DataFrame, scored: DataFrame, offsets: DataFrame, base: int = 1,
             import_time=None) -> DataFrame:
    """One log row per manifest import (empty imports log 0/0/Success).

    Counts are partial-then-final aggregates on import_id; the inserted ids of an
    import are the contiguous range [first_question_id, last_question_id].
    """
    n_err = F.col("message").isNotNull().cast("int")
    if "message2" in scored.columns:
        n_err = n_err + F.col("message2").isNotNull().cast("int")
    counts = scored.groupBy("import_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("row_status") != "ok").alias("failed_rows"),
        F.sum(n_err).alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    ids = id_ranges(offsets, base=base)
    t = import_time if import_time is not None else F.localtimestamp()
    logs = (params.select("import_id", "file_name", "uploader_id", "quiz_id", "quiz_name")
            .join(counts, "import_id", "left").join(ids, "import_id", "left"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return logs.select(
        F.col("import_id").alias("id"), "file_name", "uploader_id",
        F.col("quiz_id").cast("long").alias("quiz_id"), "quiz_name",
        t.alias("import_time"),
        F.when(z("failed_rows") > 0, F.lit(STATUS_PARTIAL)).otherwise(F.lit(STATUS_SUCCESS)).alias("status"),
        z("total_rows").alias("total_rows"), z("n_ids").alias("success_rows"),
        z("failed_rows").alias("failed_rows"),
        F.col("first_question_id"), F.col("last_question_id"),
        z("n_errors").alias("n_errors"), z("n_warnings").alias("n_warnings"))


def with_notice(logs: DataFrame) -> DataFrame:
    """redirect notice per import, as columns of the log rows."""
    return logs.withColumns({
        "notice_level": F.when(F.col("failed_rows") > 0, F.lit("warning")).otherwise(F.lit("success")),
        "notice": F.format_string(MSG_NOTICE, F.col("success_rows"), F.col("failed_rows"),
                                  F.col("id").cast("string"))})


def materialize(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once into the shared checkpoint folder (reliable checkpoint).

    The evaluated rows feed several consumers (ids, offsets, log counts, questions,
    errors); without this each consumer would re-decode files and re-run the row
    rules. The checkpoint also survives executor loss and cuts the lineage.
    """
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class ImportFrames(dict):
    """Frames of one import batch, each built on first access (nothing is written)."""

    def __init__(self, records: DataFrame, params: DataFrame, base: int = 1, import_time=None):
        super().__init__()
        self._args = (records, params, base, import_time)

    def __missing__(self, key):
        records, params, base, import_time = self._args
        if key == "scored":
            val = materialize(prepare(records, params).drop("cells"))
        elif key in ("ided", "offsets"):
            ided, offsets = with_ids(self["scored"], base=base)  # the log needs the offsets only
            self["ided"], self["offsets"] = ided, offsets
            return self[key]
        elif key == "questions":
            val = questions_from(self["ided"])
        elif key == "links":
            val = category_links(self["questions"])
        elif key == "row_errors":
            val = row_errors(self["scored"])  # messages need no ids
        elif key == "logs":
            val = log_rows(params, self["scored"], self["offsets"], base=base, import_time=import_time)
        else:
            raise KeyError(key)
        self[key] = val
        return val


def import_frames(records: DataFrame, params: DataFrame, base: int = 1, import_time=None) -> ImportFrames:
    """All frames of one import batch, built lazily on access (nothing is written)."""
    return ImportFrames(records, params, base=base, import_time=import_time)


def dry_run(records: DataFrame, params: DataFrame) -> DataFrame:
    """Validate every row and report per import; writes nothing."""
    scored = prepare(records, params)
    agg = scored.groupBy("import_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("row_status") == "ok").alias("valid_rows"),
        F.count_if(F.col("row_status") != "ok").alias("invalid_rows"),
        F.count_if(F.col("severity") == "warning").alias("warning_rows"))
    out = params.select("import_id").join(agg, "import_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("import_id", z("total_rows").alias("total_rows"), z("valid_rows").alias("valid_rows"),
                      z("invalid_rows").alias("invalid_rows"), z("warning_rows").alias("warning_rows"),
                      F.when(z("invalid_rows") > 0, F.lit(STATUS_PARTIAL)).otherwise(F.lit(STATUS_SUCCESS))
                      .alias("would_status"))


# ---------------------------------------------------------------------------
# Projection onto an existing target table
# ---------------------------------------------------------------------------
INSERT_KEYS = ["quiz_id", "question_name", "answer_array", "correct_answer", "question_answer_info",
               "comments", "hints", "question_order", "question_type", "question_type_new",
               "question_settings", "category", "linked_question", "deleted", "deleted_question_bank",
               *[c for name in ANSWER_COLUMNS for c in (name, name + "_points")]]


def writable_columns(target_columns: list[str]) -> list[tuple[str, str]]:
    """(target column, source column) pairs the insert can write, decided at plan time.

    Quiz id goes to the first existing synonym (F38), category text to the first
    existing category synonym; everything else only where the column exists (F21).
    """
    from ..functions.constants import CATEGORY_COLUMN_SYNONYMS, QUIZ_COLUMN_SYNONYMS

    have = set(target_columns)
    pairs = [(k, k) for k in INSERT_KEYS if k in have]
    for syn in QUIZ_COLUMN_SYNONYMS:
        if syn in have:
            if syn != "quiz_id":
                pairs.append((syn, "quiz_id"))
            break
    for syn in CATEGORY_COLUMN_SYNONYMS:
        if syn in have:
            if syn != "category":
                pairs.append((syn, "category"))
            break
    return pairs


def fail_unwritable(scored: DataFrame, target_columns: list[str] | None) -> DataFrame:
    """K10 (first case): with no writable column every accepted row fails."""
    from ..functions.constants import MSG_NO_COLUMNS

    if target_columns is None or writable_columns(target_columns):
        return scored
    ok = F.col("row_status") == "ok"
    # an accepted row keeps its E3 warning (seq 1) and gains the E4 error (seq 2)
    return scored.withColumns({
        "message2": F.when(ok, F.format_string(MSG_NO_COLUMNS, F.col("orig_row"))),
        "severity2": F.when(ok, F.lit("error")),
        "code2": F.when(ok, F.lit("E4")),
        "row_status": F.when(ok, F.lit("no_columns")).otherwise(F.col("row_status")),
    })


def project_to_target(questions: DataFrame, target_columns: list[str]) -> DataFrame:
    """Questions restricted to the target's columns (ids and import_id always kept)."""
    pairs = writable_columns(target_columns)
    return questions.select("question_id", "import_id", *[F.col(src).alias(dst) for dst, src in pairs])
