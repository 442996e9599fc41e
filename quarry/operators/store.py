"""Table writes (K01-K04, K06-K09): Parquet tables under one root, published run by run.

Layout under ``root``::

    questions/        by run and block of 2^20 question ids (K01)
    question_terms/   category links, likewise (K02)
    row_errors/       long-form messages (F39)
    file_errors/      imports whose file failed (Q18)
    import_logs/      one row per import, by run and block of log ids (K04)
    tombstones/       log ids removed by rollbacks (K06, K07)
    removed_ids/      id ranges removed from imports that stay (K06, K07)
    log_events/       status events, latest wins (K05)
    claims/, commits/ ids in use and published runs (``publish``)

Every write carries the number of its run, which no run had before; readers see the runs
that were committed. A run that breaks off has committed nothing, whatever it has written,
and its repeat is a run of its own. Question and log ids are claimed before they are
written, so sessions that import at once never share one (a broken run leaves a gap).

Blocks of ids are folders: a look-up by id, a removal and a delete read the blocks they
concern. Nothing is rewritten in place but by ``delete_where``.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batch as B
from . import history as H
from . import publish
from .joins import join_small


# Blocks that a look-up names one by one.
MAX_BLOCKS = 10_000


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """All rows of a table, those of runs that were not committed included."""
    p = _path(root, name)
    if not publish.exists(spark, p):
        return None
    try:
        return spark.read.parquet(p)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # no rows yet
            return None
        raise


def visible(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The rows of committed runs; the run's number is no column of the result."""
    t = table(spark, root, name)
    if t is None or "run_id" not in t.columns:
        return t
    t = t.withColumn("run_id", F.col("run_id").cast("long"))
    return join_small(t, publish.commits(spark, root).select("run_id").distinct(), "run_id", "left_semi").drop("run_id")


def append(df: DataFrame, root: str, name: str, run_id: int, block_of: str | None = None) -> None:
    """Adds rows of a run; with ``block_of`` they are laid out by blocks of that id."""
    df, parts = df.withColumn("run_id", F.lit(run_id).cast("long")), ["run_id"]
    if block_of is not None:
        df = df.withColumn("id_block", H.block_of(F.col(block_of))).repartition("id_block").sortWithinPartitions(
            "id_block", block_of)
        parts.append("id_block")
    df.write.mode("append").partitionBy(*parts).parquet(_path(root, name))


def next_id_base(spark: SparkSession, root: str) -> int:
    """The question id that the next import starts from."""
    return publish.counters(spark, root)[1]["question_id"]


def assign_log_ids(params: DataFrame, base: int) -> DataFrame:
    """(import_id, log_id): a fresh log id per import of the run, in the order of import ids."""
    one = params.select("import_id", F.lit(1).alias("_n"))
    return B.running_offsets(one, ["import_id"]).select(
        "import_id", (F.lit(base) + F.col("_off")).cast("long").alias("log_id"))


def run_import(spark: SparkSession, root: str, records: DataFrame, params: DataFrame,
               file_errors: DataFrame | None = None, dry_run: bool = False, base: int | None = None,
               import_time=None, target_columns: list[str] | None = None, run_key: str | None = None, commit: bool = True) -> dict:
    """Import a batch; with ``dry_run`` only the validation report is returned.

    ``import_id`` of ``params`` and ``records`` tells the imports of this run apart. Every
    import gets a log id of its own, the ``import_id`` of all rows that are written, so the
    same import can run again after a rollback.

    The rows appear together, when the run is committed. ``run_key`` (optional) names the
    work: once a run with that key is committed, further ones do nothing (``run`` of the
    result is then the earlier run, ``done`` is False). With ``commit=False`` the rows are
    written and stay invisible until ``publish.commit`` is called with the result's ``run``.

    ``target_columns`` (optional) is the column list of an existing questions table:
    rows are projected onto it (F21, F38), and if nothing is writable every accepted
    row fails with E4 (K10)."""
    if dry_run:
        return {"report": B.dry_run(records, params)}
    earlier = None if run_key is None else publish.run_of(spark, root, run_key)
    if earlier is not None:
        return {"run": earlier, "done": False, "logs": visible(spark, root, "import_logs")}
    run_id, first_log = publish.claim(spark, root, "log_id", params.count())
    ids = assign_log_ids(params, first_log)

    def logged(df: DataFrame) -> DataFrame:
        cols = df.columns
        return join_small(df, ids, "import_id", "inner").withColumn("import_id", F.col("log_id")).select(*cols)

    params = logged(params)
    # Four writes read the evaluated rows: evaluated once, into the shared checkpoint
    # folder (reliable; a lost executor re-reads it instead of re-parsing files).
    scored = B.materialize(B.fail_unwritable(B.prepare(logged(records), params), target_columns).drop("cells"))
    if base is None:
        base = publish.claim(spark, root, "question_id", scored.filter("row_status = 'ok'").count())[1]
    ided, offsets = B.with_ids(scored, base=base)
    questions = B.questions_from(ided)
    q = questions.drop("has_taxonomy", "category_input", "category_is_numeric")
    if target_columns is not None:
        q = B.project_to_target(q, target_columns)
    append(q, root, "questions", run_id, "question_id")
    append(B.category_links(questions), root, "question_terms", run_id, "question_id")
    append(B.row_errors(scored), root, "row_errors", run_id)
    ok_params = params
    if file_errors is not None:
        fe = logged(file_errors.filter(F.col("error").isNotNull()))
        append(fe, root, "file_errors", run_id)
        ok_params = params.join(fe.select("import_id"), "import_id", "left_anti")
    logs = B.log_rows(params, scored, offsets, base=base, import_time=import_time)
    logs = logs.join(ok_params.select(F.col("import_id").alias("id")), "id", "left_semi")
    append(logs, root, "import_logs", run_id, "id")
    done = commit and publish.commit(spark, root, run_id, run_key)
    return {"run": run_id if done or not commit else publish.run_of(spark, root, run_key), "done": done, "base": base, "ids": ids,
            "logs": visible(spark, root, "import_logs")}


def live(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows with a question id that no rollback and no removal covers."""
    rows = visible(spark, root, name)
    if rows is None:
        raise ValueError(f"{root} has no {name}")
    rows = rows.withColumn("id_block", H.block_of(F.col("question_id")))
    gone = visible(spark, root, "tombstones")
    if gone is not None:
        rows = H.without_imports(rows, gone)
    removed = visible(spark, root, "removed_ids")
    return (rows if removed is None else H.without_ids(rows, removed)).drop("id_block")


def live_questions(spark: SparkSession, root: str) -> DataFrame:
    return live(spark, root, "questions")


def live_links(spark: SparkSession, root: str) -> DataFrame:
    return live(spark, root, "question_terms")


def logs_now(spark: SparkSession, root: str) -> DataFrame:
    """Import logs with the latest status event applied."""
    logs, ev = visible(spark, root, "import_logs"), visible(spark, root, "log_events")
    logs = logs.withColumn("n_question_ids", F.coalesce(
        F.col("last_question_id") - F.col("first_question_id") + 1, F.lit(0)).cast("long"))
    return H.current_status(logs.drop("id_block"), ev)


def log_by_id(spark: SparkSession, root: str, log_id: int) -> DataFrame:
    """one log with its current status, read from the block that can hold it."""
    here = (F.col("id") == log_id) & (F.col("id_block") == (int(log_id) >> H.BLOCK_BITS))
    logs, ev = visible(spark, root, "import_logs").filter(here), visible(spark, root, "log_events")
    logs = logs.drop("id_block").withColumn("n_question_ids", F.coalesce(
        F.col("last_question_id") - F.col("first_question_id") + 1, F.lit(0)).cast("long"))
    return H.current_status(logs, None if ev is None else ev.filter(F.col("id") == log_id))


def questions_by_id(spark: SparkSession, root: str, ids: DataFrame | list[int]) -> DataFrame:
    """The live questions of ``ids`` (a list, or a frame with ``question_id``).

    Blocks without an asked id are not read, as their folders are left out of the plan. Only
    if a frame asks for more than ``MAX_BLOCKS`` blocks are all of them read and joined.
    """
    if isinstance(ids, list):
        blocks = sorted({int(i) >> H.BLOCK_BITS for i in ids})
        asked = lambda t: t.filter(F.col("id_block").isin(blocks) & F.col("question_id").isin([int(i) for i in ids]))
    else:
        keys = ids.select("question_id").distinct().withColumn("id_block", H.block_of(F.col("question_id")))
        blocks = [r[0] for r in keys.select("id_block").filter("id_block is not null").distinct().limit(MAX_BLOCKS + 1).collect()]
        few = F.col("id_block").isin(blocks) if len(blocks) <= MAX_BLOCKS else F.lit(True)
        asked = lambda t: join_small(t.filter(few), keys, ["id_block", "question_id"], "left_semi")
    rows = asked(visible(spark, root, "questions"))
    gone, removed = visible(spark, root, "tombstones"), visible(spark, root, "removed_ids")
    rows = rows if gone is None else H.without_imports(rows, gone)
    return (rows if removed is None else H.without_ids(rows, removed)).drop("id_block")


def rollback(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """Roll back many imports: append tombstones and status events; return outcomes."""
    run_id, _ = publish.claim(spark, root)
    plan = H.rollback_plan(requests, logs_now(spark, root), live_questions(spark, root))
    # the outcome counts questions that the writes below remove: computed first
    outcomes = B.materialize(plan["outcomes"])
    # tombstones are log ids: a rollback always removes a whole import
    append(plan["imports"], root, "tombstones", run_id)
    # later runs have larger numbers, so the number orders the events
    append(plan["events"].withColumn("event_seq", F.lit(run_id).cast("long")), root, "log_events", run_id)
    publish.commit(spark, root, run_id)
    return outcomes


def remove_questions(spark: SparkSession, root: str, ids: DataFrame, run_key: str | None = None) -> dict:
    """K06, K07 for any set of ids: single ones (``question_id``) or ranges (``first_id``, ``last_id``).

    Ids may lie in any imports, repeat, overlap or name no question. Returns the number of
    ids asked for (``attempted``) and of live questions that went (``removed``).
    """
    if run_key is not None and publish.run_of(spark, root, run_key) is not None:
        return {"attempted": 0, "removed": 0, "done": False}
    run_id, _ = publish.claim(spark, root)
    ranges = B.materialize(H.removed_ranges(ids))
    before = live_questions(spark, root).select("question_id").withColumn("id_block", H.block_of(F.col("question_id")))
    counts = {"attempted": int(ranges.agg(F.sum(F.col("last_id") - F.col("first_id") + 1)).first()[0] or 0),
              "removed": before.count() - H.without_ids(before, ranges).count()}
    append(ranges, root, "removed_ids", run_id)
    return counts | {"done": publish.commit(spark, root, run_id, run_key)}


def delete_where(spark: SparkSession, path: str, where: dict) -> int | None:
    """K08 in a stored partitioned table: rewrites the partitions that hold rows to delete.

    Untouched partitions keep their files. What stays of the touched ones is written beside
    the table first, then named in a marker, then moved into their place; a call that finds
    the marker of one that broke off finishes that first, so a repeat loses and doubles
    nothing. One delete of a table runs at a time: of two the later fails at the marker.
    Returns the number of deleted rows, None for a missing table or an empty clause.
    """
    path = path.rstrip("/")
    _finish_delete(spark, path)
    if not where or not publish.exists(spark, path):
        return None
    hit, folder = H.matches(where), F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)
    rows = spark.read.parquet(path).withColumn("_folder", folder)
    touched = rows.groupBy("_folder").agg(F.count_if(hit).alias("_gone"), F.count("*").alias("_all")).filter("_gone > 0")
    touched = B.materialize(touched.withColumn("_no", F.monotonically_increasing_id()))
    n = int(touched.agg(F.sum("_gone")).first()[0] or 0)
    if not n:
        return 0
    # one row per touched partition; its path is a URI
    todo = [[r["_folder"], r["_no"], r["_all"] > r["_gone"]] for r in touched.toLocalIterator()]
    root = publish.file_system(spark, path)[1].toUri().getPath()
    inside = [spark.sparkContext._jvm.java.net.URI(f).getPath() for f, _, _ in todo]
    if any(f.rstrip("/") == root for f in inside):
        raise ValueError("the table has no partitions")
    names = [part.split("=")[0] for part in inside[0][len(root):].strip("/").split("/")]
    keep = join_small(rows, touched.select("_folder", "_no"), "_folder", "inner").filter(~hit).drop("_folder", *names)
    aside = f"{path}/_deletes/rows-{publish.claim(spark, path + '/_deletes')[0]}"
    keep.write.partitionBy("_no").parquet(aside)
    if not publish.create_new(spark, f"{path}/_deletes/pending", json.dumps({"aside": aside, "folders": todo})):
        raise RuntimeError("another delete of this table is under way")
    _finish_delete(spark, path)
    return n


def _finish_delete(spark: SparkSession, path: str) -> None:
    """Moves the rows beside the table into the partitions that the marker names."""
    marker = f"{path}/_deletes/pending"
    if not publish.exists(spark, marker):
        return
    jvm, p, fs = publish.file_system(spark, marker)
    what = json.loads(publish.read_text(spark, marker))
    for folder, no, stays in what["folders"]:
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        source = jvm.org.apache.hadoop.fs.Path(f"{what['aside']}/_no={no}")
        if not stays:
            fs.delete(target, True)
        elif fs.exists(source):  # else it was moved before
            fs.delete(target, True)
            fs.rename(source, target)
    fs.delete(p, False)


def compact(spark: SparkSession, root: str, new_root: str) -> None:
    """Rewrite live rows to a fresh root (never overwrite a path being read), as its first run.

    The ids in use and the keys of published runs go along, so no id is given twice and no
    named work is done again.
    """
    n, free = publish.counters(spark, root)
    publish.start_counters(spark, new_root, free, n)
    run_id, _ = publish.claim(spark, new_root)
    append(live_questions(spark, root), new_root, "questions", run_id, "question_id")
    append(live_links(spark, root), new_root, "question_terms", run_id, "question_id")
    append(logs_now(spark, root).drop("n_question_ids"), new_root, "import_logs", run_id, "id")
    for name in ("row_errors", "file_errors"):
        t = visible(spark, root, name)
        if t is not None:
            append(t, new_root, name, run_id)
    keys = publish.commits(spark, root).select(F.lit(run_id).cast("long").alias("run_id"), "key")
    keys.write.mode("append").json(_path(new_root, "commits"))  # a run is visible once any row names it
    publish.commit(spark, new_root, run_id)


__all__ = ["run_import", "rollback", "remove_questions", "delete_where", "live_questions", "live_links", "logs_now",
           "log_by_id", "questions_by_id", "compact", "next_id_base", "table", "visible"]
