"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame whose column names
match the oracle's. Inputs are the driver's tables or frames Spark derives from
them, so every query's work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import ANSWER_COLUMNS
from ..operators import batch as B
from ..operators import history as H
from ..operators import lookups as L
from ..operators import params as P
from ..operators import publish
from ..operators import rows as R
from ..operators import store as S
from ..operators import ledger
from ..operators import writers as W
from ..operators.joins import join_small  # noqa: F401  (re-exported for query authors)
from ..operators.parallel import spread
from ..session import staging_dir
from ..sources import derived as D
from ..sources import files as FS
from . import duck

PINNED_TIME = "2024-01-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql() if callable(sql) else sql
        return fn
    return deco


def _params(spark: SparkSession, sf: str) -> DataFrame:
    return P.resolve_params(D.manifest(spark, sf), D.quizzes(spark, sf))


def _frames(spark: SparkSession, sf: str, variant: str = "base") -> dict:
    return B.import_frames(D.qrows(spark, sf, variant), _params(spark, sf),
                           import_time=F.lit(PINNED_TIME).cast("timestamp_ntz"))


@register("import_log_summary", duck.import_log_summary)
def import_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: F04 F10 F13 F16-F19 W01 A02-A05 F34 F35 per import."""
    return B.with_notice(_frames(spark, sf)["logs"]).drop("import_time")


# ---------------------------------------------------------------------------
# Row rules on the qrows fixture
# ---------------------------------------------------------------------------


@register("blank_rows", duck.blank_rows)
def blank_rows(spark: SparkSession, sf: str) -> DataFrame:
    """F02 + F04: records dropped as blank after normalization."""
    df = R.fold_keys(D.qrows(spark, sf))
    return df.filter(~R.has_content(F.col("cells"))).select("import_id", "rec_no", "orig_row")


@register("blank_rows_trim_only", duck.blank_rows_trim_only)
def blank_rows_trim_only(spark: SparkSession, sf: str) -> DataFrame:
    """F06 + W02 (parser form): records kept under plain trim, densely re-indexed per file."""
    df = R.fold_keys(D.qrows(spark, sf)).filter(R.has_content_trim_only(F.col("cells")))
    return B.rank_in_group(df, "import_id", "rec_no", "parser_row").select("import_id", "rec_no", "parser_row")


@register("parse_meta", duck.parse_meta)
def parse_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Records per file before / after the trim-only filter and after F04."""
    df = R.fold_keys(D.qrows(spark, sf))
    return df.groupBy("import_id").agg(
        F.count("*").alias("total_before_filter"),
        F.count_if(R.has_content_trim_only(F.col("cells"))).alias("total_after_filter"),
        F.count_if(R.has_content(F.col("cells"))).alias("effective_rows"))


@register("options_compacted", duck.options_compacted)
def options_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """numbered options, blanks dropped, compacted 1..n (long form)."""
    ev = R.evaluate_rows(D.qrows(spark, sf))
    return ev.select("import_id", "orig_row", F.posexplode("opts").alias("pos", "opt_text")) \
        .select("import_id", "orig_row", (F.col("pos") + 1).cast("long").alias("opt_no"), "opt_text")


@register("options_prefix_fallback", duck.options_compacted)
def options_prefix_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """option_a..option_d keys taken in cell order when no numbered key exists."""
    ev = R.evaluate_rows(D.qrows(spark, sf, "prefix"))
    return ev.select("import_id", "orig_row", F.posexplode("opts").alias("pos", "opt_text")) \
        .select("import_id", "orig_row", (F.col("pos") + 1).cast("long").alias("opt_no"), "opt_text")


@register("correct_source", duck.correct_source)
def correct_source(spark: SparkSession, sf: str) -> DataFrame:
    """F08 F09 F17 F18 on the alias variant: which cell feeds the answer, and its index."""
    ev = R.evaluate_rows(D.qrows(spark, sf, "alias"))
    return ev.select("import_id", "orig_row", "correct_raw", "row_status", "correct_index", "match_method",
                     F.array_join("opts", "|").alias("opts_text"))


@register("correct_index", duck.correct_index)
def correct_index(spark: SparkSession, sf: str) -> DataFrame:
    """exact -> number/letter -> substring ladder per effective row."""
    ev = R.evaluate_rows(D.qrows(spark, sf))
    return ev.select("import_id", "orig_row", "row_status", "correct_index", "match_method")


@register("match_method_counts", duck.match_method_counts)
def match_method_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome counts per branch."""
    ev = R.evaluate_rows(D.qrows(spark, sf))
    return ev.groupBy("row_status", "match_method").agg(F.count("*").alias("n"))


@register("answers_scored_long", duck.answers_scored_long)
def answers_scored_long(spark: SparkSession, sf: str) -> DataFrame:
    """F19 + J08: every option of every accepted row with its points."""
    q = _frames(spark, sf)["questions"]
    return q.select("question_id", "import_id", "orig_row",
                    F.posexplode("answer_array").alias("pos", "a")).select(
        "question_id", "import_id", "orig_row", (F.col("pos") + 1).cast("long").alias("opt_no"),
        F.col("a.text").alias("text"), F.col("a.points").alias("points"),
        F.col("a.is_correct").alias("is_correct"))


@register("questions_final", duck.questions_final)
def questions_final(spark: SparkSession, sf: str) -> DataFrame:
    """The rows written to the questions table."""
    q = _frames(spark, sf)["questions"]
    wide = []
    for name in ANSWER_COLUMNS:
        wide += [name, name + "_points"]
    return q.select("question_id", "import_id", "orig_row", "quiz_id", "question_name", *wide,
                    "correct_answer", "question_answer_info", "comments", "hints", "question_order",
                    "question_type", "question_type_new",
                    F.col("question_settings.question_title").alias("question_title"),
                    F.col("question_settings.isPublished").alias("is_published"),
                    F.col("question_settings.required").alias("required"),
                    "category", "linked_question", "deleted", "deleted_question_bank")


@register("row_errors", duck.row_errors)
def row_errors(spark: SparkSession, sf: str) -> DataFrame:
    """long-form row messages (E1, E2 errors; E3 warnings)."""
    return _frames(spark, sf)["row_errors"]


@register("errors_by_import", duck.errors_by_import)
def errors_by_import(spark: SparkSession, sf: str) -> DataFrame:
    """A06 without collecting: counts plus first / last message in row order."""
    e = _frames(spark, sf)["row_errors"]
    return e.groupBy("import_id").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.min("orig_row").alias("first_row"),
        F.min_by("message", "orig_row").alias("first_message"),
        F.max_by("message", "orig_row").alias("last_message"))


@register("dry_run_report", duck.dry_run_report)
def dry_run_report(spark: SparkSession, sf: str) -> DataFrame:
    """Validate only; nothing is written."""
    return B.dry_run(D.qrows(spark, sf), _params(spark, sf))


@register("params_resolved", duck.params_resolved_q)
def params_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """F28 F29 J01 J02 on the manifest."""
    return _params(spark, sf).select("import_id", "quiz_id", "quiz_name", "category_input",
                                     "category_is_numeric", "question_type", "correct_mark",
                                     "incorrect_mark")


@register("params_alias_order", duck.params_alias_order)
def params_alias_order(spark: SparkSession, sf: str) -> DataFrame:
    """all 26 parameter keys, two at a time, unusable first values skipped."""
    p = P.resolve_params(D.alias_manifest(spark, sf), D.quizzes(spark, sf))
    return p.select("import_id", "quiz_id", "category_input", "question_type", "correct_mark", "incorrect_mark")


@register("question_explanations", duck.question_explanations)
def question_explanations(spark: SparkSession, sf: str) -> DataFrame:
    """the explanation of every accepted row, cleaned of scripts and handlers."""
    return _frames(spark, sf, "explained")["questions"].select("import_id", "orig_row", "question_answer_info")


@register("category_links", duck.category_links)
def category_links(spark: SparkSession, sf: str) -> DataFrame:
    """F20 + K02: question -> term links."""
    return _frames(spark, sf)["links"]


@register("quiz_id_by_name", duck.quiz_id_by_name)
def quiz_id_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Quiz names (nation names; region names never match) -> smallest quiz id."""
    names = (D.table(spark, sf, "nation").select(F.col("n_name").alias("quiz_name"))
             .unionByName(D.table(spark, sf, "region").select(F.col("r_name").alias("quiz_name"))))
    return P.quiz_lookup_by_name(names, D.quizzes(spark, sf))


@register("quiz_id_by_title", duck.quiz_id_by_title)
def quiz_id_by_title(spark: SparkSession, sf: str) -> DataFrame:
    """J01 with its second table: names of nations, regions and suppliers -> quiz or post id."""
    names = D.table(spark, sf, "nation").select(F.col("n_name").alias("quiz_name"))
    for name, column in (("region", "r_name"), ("supplier", "s_name")):
        names = names.unionByName(D.table(spark, sf, name).select(F.col(column).alias("quiz_name")))
    return P.quiz_lookup_by_name(names, D.quizzes(spark, sf), D.posts(spark, sf))


@register("quiz_name_by_post", duck.quiz_name_by_post)
def quiz_name_by_post(spark: SparkSession, sf: str) -> DataFrame:
    """J02 with its second table: every customer's key and those around 0 and 500 -> quiz or post name."""
    ids = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("quiz_id"))
    key = F.col("r_regionkey").cast("long")
    ids = ids.union(D.table(spark, sf, "region").select(F.explode(F.array(key + 500, -key)))).distinct()
    return L.quiz_names(ids, D.quizzes(spark, sf), D.posts(spark, sf))


@register("import_detail_posts", duck.import_detail_posts)
def import_detail_posts(spark: SparkSession, sf: str) -> DataFrame:
    """J03 with its second table: display names of logs whose quiz may be a post."""
    logs = _logs(spark, sf).withColumn("quiz_id", F.col("uploader_id") % 60)
    return H.import_detail(logs, D.quizzes(spark, sf), D.posts(spark, sf)).select("id", "display_quiz_name")


@register("quiz_name_lookup", duck.quiz_name_lookup)
def quiz_name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Quiz id -> name ('' when id <= 0 or unknown) for every order's custkey % 30."""
    ids = D.table(spark, sf, "orders").select((F.col("o_custkey") % 30).cast("long").alias("quiz_id")).distinct()
    return L.quiz_names(ids, D.quizzes(spark, sf))


@register("quizzes_ordered", duck.quizzes_ordered)
def quizzes_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """S10 + L03: quiz dropdown source ordered by id."""
    return P.ordered_quizzes(D.quizzes(spark, sf))


@register("category_choices", duck.category_choices)
def category_choices(spark: SparkSession, sf: str) -> DataFrame:
    """S11 + U-S2: taxonomy terms when any exist, else distinct category text (A10)."""
    return L.category_choices(D.terms(spark, sf), L.part_questions(D.table(spark, sf, "part")))


@register("category_choices_no_terms", duck.category_choices_no_terms)
def category_choices_no_terms(spark: SparkSession, sf: str) -> DataFrame:
    """U-S2, other branch: terms exist, but of another taxonomy only."""
    return L.category_choices(D.other_terms(spark, sf), L.part_questions(D.table(spark, sf, "part")))


@register("distinct_categories", duck.distinct_categories)
def distinct_categories(spark: SparkSession, sf: str) -> DataFrame:
    """A10 + F33 + L05: non-blank distinct categories, first 200 in order."""
    return L.distinct_categories(L.part_questions(D.table(spark, sf, "part")))


@register("question_types", duck.question_types)
def question_types(spark: SparkSession, sf: str) -> DataFrame:
    """A11 + J09 + U-S1: default types merged with types discovered in the table."""
    return L.question_types(L.part_questions(D.table(spark, sf, "part")))


# ---------------------------------------------------------------------------
# History and rollback on the logs fixture (orders / lineitem)
# ---------------------------------------------------------------------------


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    return D.logs(spark, sf)


def _rollback(spark: SparkSession, sf: str) -> dict:
    return H.rollback_plan(D.rollback_requests(spark, sf), _logs(spark, sf), D.live_question_ids(spark, sf))


@register("recent_imports_page", duck.recent_imports_page)
def recent_imports_page(spark: SparkSession, sf: str) -> DataFrame:
    """L01 + F31 + F40: page 2 of the recent-imports list (top-k, no full sort)."""
    return H.recent_page(_logs(spark, sf), page=2)


@register("import_page_count", duck.import_page_count)
def import_page_count(spark: SparkSession, sf: str) -> DataFrame:
    """A01 + A12: log count and page count."""
    return H.page_count(_logs(spark, sf))


@register("import_detail", duck.import_detail)
def import_detail(spark: SparkSession, sf: str) -> DataFrame:
    """F30 + J03 + F40: display fields of every log."""
    return H.import_detail(_logs(spark, sf), D.quizzes(spark, sf))


@register("rollback_outcome", duck.rollback_outcome)
def rollback_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """F32 + A09: outcome and counts per rollback request."""
    return _rollback(spark, sf)["outcomes"]


@register("rollback_survivors", duck.rollback_survivors)
def rollback_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """Questions left after the rollbacks (anti join on the import)."""
    r = _rollback(spark, sf)
    return H.without_imports(D.live_question_ids(spark, sf), r["imports"])


@register("rollback_removed", duck.rollback_removed)
def rollback_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Questions the rollbacks remove (semi join)."""
    return _rollback(spark, sf)["removed"]


@register("rollback_links", duck.rollback_links)
def rollback_links(spark: SparkSession, sf: str) -> DataFrame:
    """Category links left after the rollbacks."""
    r = _rollback(spark, sf)
    return H.without_imports(D.link_rows(spark, sf), r["imports"])


@register("rollback_status", duck.rollback_status)
def rollback_status(spark: SparkSession, sf: str) -> DataFrame:
    """K05 + W03: every log's status after appending the rollback events."""
    ev = _rollback(spark, sf)["events"].withColumn("event_seq", F.lit(1))
    return H.current_status(_logs(spark, sf), ev).select("id", "status")


# ---------------------------------------------------------------------------
# Stored tables: runs, removals, look-ups and deletes, written below the shared folder
# ---------------------------------------------------------------------------


def _stored_questions(spark: SparkSession, sf: str) -> str:
    """A root whose only run holds the questions of the logs."""
    root = staging_dir(spark, "stored-questions")
    run_id, _ = publish.claim(spark, root)
    S.append(D.question_ids_of_logs(spark, sf), root, "questions", run_id, "question_id")
    publish.commit(spark, root, run_id)
    return root


@register("import_runs_published", duck.import_runs_published)
def import_runs_published(spark: SparkSession, sf: str) -> DataFrame:
    """Live questions after a run that never committed, its repeat and a replay."""
    root = staging_dir(spark, "runs")
    args = (spark, root, D.qrows(spark, sf), _params(spark, sf))
    S.run_import(*args, commit=False)
    run = S.run_import(*args, run_key="batch")
    S.run_import(*args, run_key="batch")
    ids = run["ids"].select(F.col("import_id").alias("manifest_id"), F.col("log_id").alias("import_id"))
    return join_small(S.live_questions(spark, root), ids, "import_id", "inner").select(
        F.col("manifest_id").alias("import_id"), "orig_row", (F.col("question_id") - run["base"] + 1).alias("question_no"),
        F.col("question_settings.question_title").alias("question_title"), "correct_answer", "category")


@register("removed_id_sets", duck.removed_id_sets)
def removed_id_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Questions left after removing single ids and ranges that cross imports."""
    root = _stored_questions(spark, sf)
    S.remove_questions(spark, root, D.deleted_question_ids(spark, sf))
    S.remove_questions(spark, root, D.removal_ranges(spark, sf))
    return S.live_questions(spark, root)


@register("questions_by_id", duck.questions_by_id)
def questions_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Stored questions by id; blocks without an asked id aren't read."""
    return S.questions_by_id(spark, _stored_questions(spark, sf), D.looked_up_ids(spark, sf))


@register("stored_delete", duck.safe_delete)
def stored_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Delete in a stored table that is partitioned by priority; one partition is rewritten."""
    path = f"{staging_dir(spark, 'stored-orders')}/orders"
    rows = D.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rows.write.partitionBy("o_orderpriority").parquet(path)
    S.delete_where(spark, path, {"o_orderstatus": "P", "o_orderpriority": "1-URGENT"})
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@register("safe_delete", duck.safe_delete)
def safe_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Delete pending urgent orders; the survivors plus the deleted count."""
    remaining, deleted = H.safe_delete(D.table(spark, sf, "orders"),
                                       {"o_orderstatus": "P", "o_orderpriority": "1-URGENT"})
    return remaining.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@register("safe_delete_count", duck.safe_delete_count)
def safe_delete_count(spark: SparkSession, sf: str) -> DataFrame:
    """K08 return value: number of rows the delete removes."""
    _, deleted = H.safe_delete(D.table(spark, sf, "orders"),
                               {"o_orderstatus": "P", "o_orderpriority": "1-URGENT"})
    return deleted.select(F.col("deleted").cast("long").alias("deleted"))


# ---------------------------------------------------------------------------
# Text normalization, cleaning and detection over whole texts
# ---------------------------------------------------------------------------
@register("normalize_text", duck.normalize_text)
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    """F02 (+F24 invisible entities) over every document, whole text."""
    d = spread(D.documents_text(spark, sf), materialize=False).withColumn("normalized", T.normalize_text(F.col("text")))
    return d.select("doc_id", "normalized", (F.col("normalized") == "").alias("is_blank"))


@register("entity_and_tag_clean", duck.entity_and_tag_clean)
def entity_and_tag_clean(spark: SparkSession, sf: str) -> DataFrame:
    """F24-F26 over every page: text field sanitizing, tag stripping, rich-text cleaning."""
    p = spread(D.pages_html(spark, sf), materialize=False)
    return p.select("page_id", T.sanitize_text_field(F.col("html")).alias("text_clean"),
                    T.strip_all_tags(F.col("html")).alias("stripped"),
                    T.kses_post(F.col("html")).alias("safe_html")) \
        .withColumn("is_blank", ~T.has_visible_text(F.col("stripped")))


@register("delimiter_detect", duck.delimiter_detect)
def delimiter_detect(spark: SparkSession, sf: str) -> DataFrame:
    """delimiter of each document's first 4096 bytes."""
    d = D.delimited_text(spark, sf).withColumn("_s", T.byte_sample(F.col("text"), 4096))
    return d.select("doc_id", T.count_char(F.col("_s"), ",").alias("n_comma"),
                    T.count_char(F.col("_s"), ";").alias("n_semicolon"),
                    T.count_char(F.col("_s"), "\t").alias("n_tab"),
                    T.detect_delimiter(F.col("text")).alias("delimiter"))


@register("header_detect", duck.header_detect)
def header_detect(spark: SparkSession, sf: str) -> DataFrame:
    """F23 + A13: header heuristic on candidate first records."""
    h = D.header_candidates(spark, sf)
    ratio = T.text_like_ratio(F.col("cells"))
    return h.select("k", F.size("cells").alias("n_cells"),
                    F.size(F.filter("cells", T.text_like)).alias("n_text"),
                    ratio.cast("double").alias("ratio"), (ratio >= 0.5).alias("is_header"))


@register("bulk_import_lineitem", duck.bulk_import_lineitem)
def bulk_import_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """The whole import over one question per lineitem row; import 0 holds a third of
    all rows (skew path of W01 / A04)."""
    logs = B.import_frames(D.bulk_records(spark, sf), _params(spark, sf),
                           import_time=F.lit(PINNED_TIME).cast("timestamp_ntz"))["logs"]
    return B.with_notice(logs).drop("import_time")


# ---------------------------------------------------------------------------
# File decoding and the library processor path
# ---------------------------------------------------------------------------


@register("json_rows", duck.json_rows)
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """S07 + S08 + F07: events.props packed into JSON documents (bare lists, ``rows`` and
    ``data`` envelopes, a scalar item in every 4th) and decoded back by the reader."""
    ev = D.table(spark, sf, "events").select("event_id", "event_type", "props",
                                             F.floor(F.col("event_id") / 100).cast("long").alias("bucket"))
    docs = ev.groupBy("event_type", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("items"))
    body = F.concat(F.when(F.col("bucket") % 4 == 0, F.lit("42,")).otherwise(F.lit("")),
                    F.array_join(F.transform("items", lambda x: x["props"]), ","))
    content = (F.when(F.col("bucket") % 3 == 0, F.concat(F.lit("["), body, F.lit("]")))
               .when(F.col("bucket") % 3 == 1, F.concat(F.lit('{"rows": ['), body, F.lit("]}")))
               .otherwise(F.concat(F.lit('{"data": ['), body, F.lit("]}"))))
    files = docs.select(F.col("bucket").alias("import_id"),
                        F.concat(F.col("event_type"), F.lit("/"), F.col("bucket").cast("string"),
                                 F.lit(".json")).alias("name"),
                        F.encode(content, "UTF-8").alias("content"))
    recs, _ = FS.split_decoded(FS.decode_contents(files, mode="lib"))
    return recs.select(F.regexp_replace("name", r"\.json$", "").alias("doc"),
                       (F.col("rec_no") + 1).alias("item_no"), F.explode("cells").alias("c")) \
        .select("doc", "item_no", F.col("c.pos").alias("pos"), F.col("c.key").alias("key"),
                F.col("c.value").alias("value"))


@register("json_rows_live", duck.json_rows_live)
def json_rows_live(spark: SparkSession, sf: str) -> DataFrame:
    """S04 + F02: events.props as JSON arrays or objects of rows, read in live mode: scalar
    items are skipped, keys folded, nested values read 'Array' or, holding nothing, blank."""
    ev = D.table(spark, sf, "events").select("event_id", "event_type", "props",
                                             F.floor(F.col("event_id") / 100).cast("long").alias("bucket"))
    docs = ev.groupBy("event_type", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("items"))
    odd = '{" K ": ["", " "], "Q": {"a": 1}, "f": 1.50, "t": true, "z": null, "n": 9007199254740993}'
    listed = F.concat(F.lit(f'[7, "text", {odd}, '), F.array_join(F.transform("items", lambda x: x["props"]), ","),
                      F.lit(", null]"))
    keyed = F.concat(F.lit(f'{{"no": 1, "odd": {odd}, '), F.array_join(F.transform(
        "items", lambda x: F.concat(F.lit('"r'), x["event_id"].cast("string"), F.lit('": '), x["props"])), ","),
        F.lit("}"))
    content = F.when(F.col("bucket") % 2 == 0, listed).otherwise(keyed)
    files = docs.select(F.col("bucket").alias("import_id"),
                        F.concat(F.col("event_type"), F.lit("/"), F.col("bucket").cast("string"),
                                 F.lit(".json")).alias("name"), F.encode(content, "UTF-8").alias("content"))
    recs, _ = FS.split_decoded(FS.decode_contents(files, mode="live"))
    return recs.select(F.regexp_replace("name", r"\.json$", "").alias("doc"), "rec_no", "orig_row",
                       F.explode("cells").alias("c")) \
        .select("doc", "rec_no", "orig_row", F.col("c.pos").alias("pos"), F.col("c.key").alias("key"),
                F.col("c.value").alias("value"))


@register("csv_edge_cases", duck.csv_edge_cases)
def csv_edge_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Blank line, multi-line cell, short and long row, duplicate header, BOM and a cell
    above 200,000 characters, one file per import, through the import's own file source."""
    from ..session import staging_dir

    out = staging_dir(spark, "csv-edge")
    (D.csv_edge_lines(spark, sf).repartition("import_id").sortWithinPartitions("import_id", "k")
     .select("import_id", "value").write.partitionBy("import_id").text(out))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).select(
        F.regexp_extract("path", r"import_id=([0-9]+)", 1).cast("long").alias("import_id"),
        F.lit("upload.csv").alias("file_name"), "path")
    recs, _ = FS.read_manifest_files(spark, files)
    return recs.select("import_id", "rec_no", "orig_row", F.explode("cells").alias("c")).select(
        "import_id", "rec_no", "orig_row", F.col("c.pos").alias("pos"), F.col("c.key").alias("key"),
        F.md5(F.col("c.value").cast("binary")).alias("value_md5"))


@register("processor_summary", duck.processor_summary)
def processor_summary(spark: SparkSession, sf: str) -> DataFrame:
    """F05 + F11 + F36 + A07 + U01 (built-in sink) per import."""
    return W.processor_summary(W.process_rows(D.qrows(spark, sf)))


@register("writer_outcomes", duck.writer_outcomes)
def writer_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of result of a row writer, called as the hook."""
    out = W.process_rows(D.qrows(spark, sf), writer=W.Writers(hook=D.sample_writer))
    return out.select("import_id", "rec_no", "status", "id", "message")


@register("writer_ledger", duck.writer_ledger)
def writer_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs of one key, the first over a part of the imports (as if it broke
    off), the last with another try for failed rows; ids and ``attempt`` tell who was called when."""
    from ..session import staging_dir

    root, rows = staging_dir(spark, "writer-ledger"), D.qrows(spark, sf)
    ledger.process_once(spark, root, "bank", rows.filter("import_id % 3 <> 0"), D.numbered_writer(1))
    ledger.process_once(spark, root, "bank", rows, D.numbered_writer(2))
    out = ledger.process_once(spark, root, "bank", rows, D.numbered_writer(3), retry_failed=True)
    return out.select("import_id", "rec_no", "status", "id", "message", "attempt")


@register("parse_files_meta", duck.parse_files_meta)
def parse_files_meta(spark: SparkSession, sf: str) -> DataFrame:
    """One file per import, by import_id % 5 CSV, JSON, CSV named .json, JSON named .dat
    and none at all; what each is taken for and its rows before and after the blank filter."""
    from ..session import staging_dir

    out, kind = staging_dir(spark, "parse-files"), F.col("import_id") % 5
    lines = D.mixed_file_lines(spark, sf)
    (lines.filter(kind < 4).repartition("import_id").sortWithinPartitions("import_id", "k")
     .select("import_id", "value").write.partitionBy("import_id").text(out))
    here = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).select(
        F.regexp_extract("path", r"import_id=([0-9]+)", 1).cast("long").alias("import_id"), "path")
    files = lines.select("import_id").distinct().join(here, "import_id", "left").select(
        "import_id", F.when(kind == 0, "bank.csv").when(kind == 3, "bank.dat").otherwise("bank.json").alias("file_name"),
        F.coalesce("path", F.lit(f"{out}/none")).alias("path"))
    recs, meta = FS.parse_files(spark, files)
    n = recs.groupBy("import_id").agg((F.max("rec_no") + 1).alias("n_numbered"))
    return meta.join(n, "import_id", "left").withColumn("n_numbered", F.coalesce("n_numbered", F.lit(0)).cast("long"))


@register("csv_roundtrip", duck.csv_roundtrip)
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S01 + S02: qrows written as CSV files (one folder per import, in the shared
    checkpoint folder), read back with binaryFile and decoded, then evaluated."""
    from ..session import staging_dir

    out = staging_dir(spark, "csv-roundtrip")
    wide = D.qrow_fields(D.table(spark, sf, "part"))
    (wide.select("import_id", "question", "option1", "option2", "option3", "option4", "correct_answer")
     .write.partitionBy("import_id").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(out))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.csv").load(out)
    files = raw.select(F.regexp_extract("path", r"import_id=([0-9]+)", 1).cast("long").alias("import_id"),
                       F.col("path").alias("name"), "content")
    recs, _ = FS.split_decoded(FS.decode_contents(files, mode="live"))
    ev = R.evaluate_rows(recs)
    return ev.select("import_id", "question_text", F.array_join("opts", "|").alias("opts_text"),
                     "row_status", "correct_index", "match_method")


def _workbooks(pdf):
    """One XLSX workbook (bytes) per group of question rows, rows in record order."""
    import pandas as pd

    from ..sources.xlsx import xlsx_bytes

    pdf = pdf.sort_values("rec_no")
    cols = ["question", "option1", "option2", "option3", "option4", "correct_answer"]
    rows = [cols] + pdf[cols].astype(str).values.tolist()
    imp, chunk = int(pdf["import_id"].iloc[0]), int(pdf["chunk"].iloc[0])
    return pd.DataFrame({"import_id": [imp], "name": [f"import_{imp}_{chunk}.xlsx"],
                         "content": [xlsx_bytes(rows)]})


@register("xlsx_roundtrip", duck.csv_roundtrip)
def xlsx_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Qrows packed into XLSX workbooks (<= 250 rows each, built in tasks by
    applyInPandas) and decoded back by the reader, then evaluated."""
    wide = D.qrow_fields(D.table(spark, sf, "part")).withColumn(
        "chunk", F.floor(F.col("rec_no") / 250).cast("long"))
    books = wide.select("import_id", "chunk", "rec_no", "question", "option1", "option2", "option3", "option4",
                        "correct_answer").groupBy("import_id", "chunk").applyInPandas(
        _workbooks, "import_id long, name string, content binary")
    recs, _ = FS.split_decoded(FS.decode_contents(books, mode="live"))
    ev = R.evaluate_rows(recs)
    return ev.select("import_id", "question_text", F.array_join("opts", "|").alias("opts_text"),
                     "row_status", "correct_index", "match_method")


@register("logs_offset_page", duck.logs_offset_page)
def logs_offset_page(spark: SparkSession, sf: str) -> DataFrame:
    """``get_logs(per_page=25, offset=-5)``: the offset clamps to 0 (top-k)."""
    return H.get_logs(_logs(spark, sf), per_page=25, offset=-5).select(
        "id", "file_name", F.date_format("import_time", H.DATETIME_FMT).alias("import_time"), "status")


@register("log_defaults", duck.log_defaults)
def log_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """log fields cast with defaults, names sanitized, file names without tags."""
    return H.log_defaults(_logs(spark, sf)).withColumn(
        "import_time", F.date_format("import_time", H.DATETIME_FMT))
