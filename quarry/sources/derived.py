"""Fixture tables derived by Spark from the driver's parquet tables (FIXTURES.md §3).

Every frame here is a projection / join of the given tables, so its size grows with
the scale factor. The DuckDB oracle (``quarry.plans.duck``) derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INV = "\u00a0\u200b"  # NBSP + zero-width space: blank after normalization, not after trim


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cell(pos: int | Column, key: str | Column, value: Column) -> Column:
    pos = F.lit(pos) if isinstance(pos, int) else pos
    key = F.lit(key) if isinstance(key, str) else key
    return F.struct(pos.cast("int").alias("pos"), key.alias("key"), value.cast("string").alias("value"))


def qrow_fields(part: DataFrame) -> DataFrame:
    """Wide question fields per part row (FIXTURES §3.1)."""
    k = F.col("p_partkey")
    m13, m17 = (k % 13 == 0), (k % 17 == 0)
    question = F.when(m13, F.lit(INV)).when(k % 11 == 0, F.lit("   ")).otherwise(F.col("p_name"))
    o1 = F.when(m13, F.lit(INV)).when(m17, F.lit("")).otherwise(F.col("p_name"))
    o2 = F.when(m13 | m17, F.lit("")).otherwise(F.col("p_brand"))
    o3 = F.when(m13 | m17 | (k % 4 == 0), F.lit("")).otherwise(F.col("p_type"))
    o4 = F.when(m13 | m17, F.lit("")).otherwise(F.col("p_size").cast("string"))
    r = k % 9
    correct = (F.when(m13, F.lit(""))
               .when(r == 0, F.col("p_brand"))
               .when(r == 1, F.lower(F.col("p_type")))
               .when(r == 2, F.lit("3"))
               .when(r == 3, F.lit("B"))
               .when(r == 4, F.lit("Option 2"))
               .when(r == 5, F.substring(F.col("p_name"), 1, 3))
               .when(r == 6, F.lit("zzz"))
               .when(r == 7, F.lit(""))
               .otherwise(F.lit("10")))
    return part.select(
        k.alias("k"),
        (k % 20).cast("long").alias("import_id"),
        F.concat(F.lit("file_"), (k % 20).cast("string")).alias("file_name"),
        k.cast("long").alias("rec_no"),
        (k + 2).cast("long").alias("orig_row"),
        question.alias("question"), o1.alias("option1"), o2.alias("option2"),
        o3.alias("option3"), o4.alias("option4"), correct.alias("correct_answer"),
        F.col("p_type"),
    )


ALIAS_BY_MOD7 = ["correct_answer", "correct", "answer_correct", "correctoption",
                 "correct_option", "correct answer", "is_correct_pick"]


def qrows(spark: SparkSession, sf_dir: str, variant: str = "base") -> DataFrame:
    """Question records as ordered cells.

    variant ``base``: keys question, option1..4, correct_answer.
    variant ``prefix``: option keys renamed option_a..option_d (F14 fallback).
    variant ``alias``: correct-answer key chosen by k % 7 from the aliases and a generic
    key; k % 5 = 0 adds a leading ``Correct_Note`` cell; k % 4 = 1 adds a trailing
    ``OPTION1`` cell holding p_type (case folding + duplicate-key collapse).
    """
    from ..operators.parallel import spread

    w = qrow_fields(spread(table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size"), materialize=False))
    k = F.col("k")
    if variant == "prefix":
        okeys = ["option_a", "option_b", "option_c", "option_d"]
    else:
        okeys = ["option1", "option2", "option3", "option4"]
    if variant == "alias":
        ckey = F.element_at(F.array(*[F.lit(a) for a in ALIAS_BY_MOD7]), (k % 7 + 1).cast("int"))
    else:
        ckey = F.lit("correct_answer")
    base = F.array(
        _cell(0, "question", F.col("question")),
        _cell(1, okeys[0], F.col("option1")),
        _cell(2, okeys[1], F.col("option2")),
        _cell(3, okeys[2], F.col("option3")),
        _cell(4, okeys[3], F.col("option4")),
        _cell(5, ckey, F.col("correct_answer")),
    )
    if variant == "explained":
        base = F.concat(base, F.array(_cell(6, " Explanation", explanation(k, F.col("question")))))
    if variant == "alias":
        empty = F.array().cast("array<struct<pos:int,key:string,value:string>>")
        lead = F.when(k % 5 == 0, F.array(_cell(-1, "Correct_Note", F.lit("note")))).otherwise(empty)
        tail = F.when(k % 4 == 1, F.array(_cell(6, "OPTION1", F.col("p_type")))).otherwise(empty)
        cells = F.concat(lead, base, tail)
        # positions are the order in the record
        cells = F.transform(cells, lambda c, i: F.struct(i.cast("int").alias("pos"),
                                                         c["key"].alias("key"),
                                                         c["value"].alias("value")))
    else:
        cells = base
    return w.select("import_id", "file_name", "rec_no", "orig_row", cells.alias("cells"))


def explanation(k: Column, text: Column) -> Column:
    """Explanations by k % 4: with a script, with an event handler, plain, missing."""
    return (F.when(k % 13 == 0, F.lit(None))  # blank rows stay blank
            .when(k % 4 == 0, F.concat(F.lit("<b>See</b><script>alert(1)</script> "), text))
            .when(k % 4 == 1, F.concat(F.lit('<i class="x" onclick="go()">why</i> '), text))
            .when(k % 4 == 2, F.concat(F.lit("  because "), text)))


#: Keys of ``alias_manifest`` in the order in which they are looked up (fixed values of the
#: input format), by parameter.
ALIASES = {
    "quiz": ["qsm_target_quiz", "target_quiz", "quiz_id", "quiz", "qsm_quiz", "qsm_target_quiz_select"],
    "category": ["qsm_question_category", "target_category", "category", "target_cat", "qsm_category",
                 "qsm_category_select", "qsm_category_field"],
    "type": ["qsm_question_type", "question_type", "qsm_type"],
    "correct": ["qsm_correct_mark", "correct_mark", "marks_correct", "correct_points", "qsm_points_correct"],
    "incorrect": ["qsm_incorrect_mark", "incorrect_mark", "marks_incorrect", "incorrect_points",
                  "qsm_points_incorrect"],
}


def alias_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One import per part row that gives every parameter under two of its keys: key number
    k % n holds a value that is unusable when k % 3 = 0, key number (k / n) % n a usable one."""
    k = F.col("p_partkey").cast("long")
    first = {"quiz": (F.lit("no such quiz"), k % 24 + 1), "category": (F.lit(" \t"), F.concat(F.lit("first "), k)),
             "type": (F.lit("x"), k % 7), "correct": (F.lit("many"), k % 9 + F.lit(0.5)),
             "incorrect": (F.lit(""), -(k % 4))}
    second = {"quiz": k * 7 % 24 + 1, "category": F.concat(F.lit("second "), k), "type": k % 5, "correct": k % 6,
              "incorrect": F.lit(-0.25)}
    entries = []
    for name, keys in ALIASES.items():
        n = len(keys)
        names = F.array(*[F.lit(x) for x in keys])
        bad, good = first[name]
        a, b = k % n, F.floor(k / n) % n
        entries += [F.struct(F.get(names, a.cast("int")).alias("key"),
                             F.when(k % 3 == 0, bad).otherwise(good.cast("string")).alias("value")),
                    F.when(a != b, F.struct(F.get(names, b.cast("int")).alias("key"),
                                            second[name].cast("string").alias("value")))]
    params = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    return table(spark, sf_dir, "part").select(
        k.alias("import_id"), F.lit("f").alias("file_name"), F.lit(None).cast("string").alias("path"),
        params.alias("params"), F.lit(1).cast("long").alias("uploader_id"), F.lit(False).alias("has_taxonomy"))


CSV_HEADER = " Question,OPTION1,option1,correct_answer"


def csv_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(import_id, k, value): CSV text per part row, by k % 8: a plain row, a blank line, a cell
    over several lines, a short row, a long row, quotes and commas, a cell above 200,000
    characters (for every 1,000th part), spaces; k = -1 is the header, after a BOM in every
    other file."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    name, imp = F.col("p_name"), (k % 20).cast("long").alias("import_id")
    value = (F.when(k % 1000 == 6, F.concat(F.lit("big,"), F.repeat(F.lit("0123456789"), 20001), F.lit(",b,1")))
             .when(k % 8 == 1, F.lit(""))
             .when(k % 8 == 2, F.concat(F.lit('"'), name, F.lit('\nsecond ""line""\n",a,b,2')))
             .when(k % 8 == 3, name)
             .when(k % 8 == 4, F.concat(name, F.lit(",a,b,c,d,e,f")))
             .when(k % 8 == 5, F.concat(F.lit('"x, ""y""",'), name, F.lit(",,")))
             .when(k % 8 == 7, F.concat(F.lit("  "), name, F.lit("  , a ,b,  ")))
             .otherwise(F.concat(name, F.lit(",a,b,1"))))
    rows = p.select(imp, k.cast("long").alias("k"), value.alias("value"))
    heads = p.select(imp).distinct().select(
        "import_id", F.lit(-1).cast("long").alias("k"),
        F.concat(F.when(F.col("import_id") % 2 == 0, F.lit("\ufeff")).otherwise(F.lit("")), F.lit(CSV_HEADER))
        .alias("value"))
    return heads.unionByName(rows)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One import per nation row (FIXTURES §3.2); params as a string map."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    quiz = F.when(key % 2 == 0, key.cast("string")).otherwise(F.col("n_name"))
    m4 = key % 4
    cat = (F.when(m4 == 0, (F.col("n_regionkey") + 1).cast("string"))
           .when(m4 == 1, F.col("n_name")).when(m4 == 2, F.lit("")).otherwise(F.lit("0")))
    m3 = key % 3
    cm = F.when(m3 == 0, F.lit("4")).when(m3 == 1, F.lit("")).otherwise(F.lit("abc"))
    im = F.when(key % 5 == 0, F.lit("-1")).otherwise(F.lit(""))
    qtype = F.when(key % 7 == 0, F.lit("1")).otherwise(F.lit(""))
    params = F.create_map(
        F.lit("qsm_quiz"), quiz, F.lit("qsm_category"), cat,
        F.lit("qsm_points_correct"), cm, F.lit("qsm_points_incorrect"), im,
        F.lit("qsm_type"), qtype)
    return n.select(
        key.cast("long").alias("import_id"),
        F.concat(F.lit("file_"), key.cast("string")).alias("file_name"),
        F.lit(None).cast("string").alias("path"),
        params.alias("params"),
        F.lit(1).cast("long").alias("uploader_id"),
        (key < 10).alias("has_taxonomy"),
    )


def quizzes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("quiz_id"), F.col("n_name").alias("quiz_name"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts (post_id, post_title, post_type): regions and suppliers, every second of them of
    type quiz, and nations, whose names the quiz table has with other ids."""
    def of(name, key, title, base, other):
        kind = F.when(F.col(key) % 2 == 0, F.lit("quiz")).otherwise(F.lit(other))
        return table(spark, sf_dir, name).select((F.col(key) + base).cast("long").alias("post_id"),
                                                 F.col(title).alias("post_title"), kind.alias("post_type"))
    return (of("region", "r_regionkey", "r_name", 500, "post").unionByName(of("supplier", "s_suppkey", "s_name", 25, "page"))
            .unionByName(of("nation", "n_nationkey", "n_name", 1000, "quiz")))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category terms from region, and terms of another taxonomy from nation."""
    region = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1).cast("long").alias("term_id"), F.col("r_name").alias("name"),
        F.lit("qsm_category").alias("taxonomy"))
    return region.unionByName(other_terms(spark, sf_dir))


def other_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).cast("long").alias("term_id"), F.col("n_name").alias("name"),
        F.lit("post_tag").alias("taxonomy"))


def question_ids_of_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``questions_scale``: distinct (question_id, import_id) from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return (li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("question_id"),
                      F.col("l_orderkey").cast("long").alias("import_id"))
            .distinct())


def deleted_question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that were deleted since: every 7th id of the logs."""
    return question_ids_of_logs(spark, sf_dir).filter(F.col("question_id") % 7 == 0).select("question_id")


def live_question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions that still exist: those of the logs without the deleted ones."""
    return question_ids_of_logs(spark, sf_dir).join(deleted_question_ids(spark, sf_dir), "question_id", "left_anti")


def removal_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id ranges to remove: from every urgent order's second id into the next order's."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    first = (F.col("o_orderkey") * 10).cast("long")
    return o.select((first + 2).alias("first_id"), (first + 15).alias("last_id"))


def looked_up_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question ids to look up: the third of every finished order, present or not."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return o.select((F.col("o_orderkey") * 10 + 3).cast("long").alias("question_id"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import logs derived from orders (FIXTURES §3.4); ids live in the long-form
    ``question_ids_of_logs`` table keyed by ``import_id`` = log id."""
    o = table(spark, sf_dir, "orders")
    nat = quizzes(spark, sf_dir)
    ids = question_ids_of_logs(spark, sf_dir).groupBy("import_id").agg(F.count("*").alias("n_ids"))
    ok = F.col("o_orderkey")
    base = o.select(
        ok.cast("long").alias("id"),
        F.concat(F.lit("file_"), ok.cast("string")).alias("file_name"),
        F.col("o_custkey").cast("long").alias("uploader_id"),
        (F.col("o_custkey") % 25).cast("long").alias("quiz_id"),
        (ok % 4 == 0).alias("_noname"),
        F.col("o_orderdate").alias("import_time"),
        (F.when(F.col("o_orderstatus") == "F", "Success")
         .when(F.col("o_orderstatus") == "O", "Partial").otherwise("RolledBack")).alias("status"),
        (ok % 3).cast("long").alias("failed_rows"),
    )
    out = (base.join(nat, "quiz_id", "left")
           .join(ids, base["id"] == ids["import_id"], "left")
           .select("id", "file_name", "uploader_id", "quiz_id",
                   F.when(F.col("_noname"), F.lit("")).otherwise(F.coalesce(F.col("quiz_name"), F.lit("")))
                   .alias("quiz_name"),
                   "import_time", "status",
                   (F.coalesce(F.col("n_ids"), F.lit(0)) + F.col("failed_rows")).cast("long").alias("total_rows"),
                   F.coalesce(F.col("n_ids"), F.lit(0)).cast("long").alias("success_rows"),
                   "failed_rows",
                   F.coalesce(F.col("n_ids"), F.lit(0)).cast("long").alias("n_question_ids")))
    return out


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category links of the existing questions with odd ids."""
    q = live_question_ids(spark, sf_dir)
    return q.filter(F.col("question_id") % 2 == 1).select(
        "question_id", "import_id", F.col("import_id").alias("quiz_id"),
        (F.col("question_id") % 5 + 1).cast("long").alias("term_id"),
        F.lit("qsm_category").alias("taxonomy"))


def rollback_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll back every urgent import, plus three invalid requests (0, -1, max + 1)."""
    o = table(spark, sf_dir, "orders")
    urgent = o.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").cast("long").alias("log_id"))
    beyond = o.agg((F.max("o_orderkey") + 1).cast("long").alias("log_id"))
    fixed = spark.createDataFrame([(0,), (-1,)], "log_id long")
    return urgent.unionByName(beyond).unionByName(fixed)


VISIBLE_ENTITIES = " &amp;nbsp; &lt;b&gt; &eacute;&bogus; &#8364;&#x1F600;&#13;&NotEqualTilde;&#39;&"


def documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents.text with a tail by doc_id % 5 (INV, tab, BOM, &nbsp;, visible entities);
    every 11th document is replaced by invisible characters only."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    tail = (F.when(i % 5 == 0, F.lit(INV)).when(i % 5 == 1, F.lit("\t"))
            .when(i % 5 == 2, F.lit("\ufeff")).when(i % 5 == 3, F.lit("&nbsp;")).otherwise(F.lit(VISIBLE_ENTITIES)))
    blank = F.lit(INV + "&zwj;\t&#160;")
    return d.select("doc_id", F.when(i % 11 == 0, blank).otherwise(F.concat(F.col("text"), tail)).alias("text"))


def pages_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages.html with '&nbsp;' appended when page_id % 3 = 0."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", F.concat(F.col("html"), F.when(F.col("page_id") % 3 == 0, F.lit("&nbsp;"))
                                        .otherwise(F.lit(""))).alias("html"))


def delimited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents.text with ', ' turned into ';' (doc_id % 3 = 1) or a tab (= 2)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    t = (F.when(i % 3 == 1, F.replace(F.col("text"), F.lit(", "), F.lit(";")))
         .when(i % 3 == 2, F.replace(F.col("text"), F.lit(", "), F.lit("\t"))).otherwise(F.col("text")))
    return d.select("doc_id", t.alias("text"))


def header_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-record candidates built from part rows (four shapes by key % 4)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    cells = (F.when(k % 4 == 0, F.array(F.col("p_name"), size, price, F.col("p_brand")))
             .when(k % 4 == 1, F.array(size, price, F.lit("")))
             .when(k % 4 == 2, F.array(F.col("p_name"), size, price))
             .otherwise(F.array(F.col("p_type"), F.col("p_brand"), F.lit(""), price)))
    return p.select(k.cast("long").alias("k"), cells.alias("cells"))


def bulk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question record per lineitem row (joined to its part): the large fixture.

    import_id puts every order with key % 3 = 0 into import 0 (a third of all rows,
    the skewed import); the rest spread over imports 1..24. orig_row follows the
    order / line number; rec_no breaks the ties of repeated (order, line) pairs.
    """
    from ..operators.joins import join_small

    from ..operators.parallel import spread

    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                        "l_quantity", "l_returnflag"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    j = join_small(li, part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "inner")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    r = ln % 5
    correct = (F.when(r == 0, F.lit("B")).when(r == 1, F.lower(F.col("p_type"))).when(r == 2, F.lit("3"))
               .when(r == 3, F.lit("zzz")).otherwise(F.col("l_returnflag")))
    cells = F.array(
        _cell(0, "question", F.when(ok % 29 == 0, F.lit("")).otherwise(
            F.concat(F.col("p_name"), F.lit(" #"), ln.cast("string")))),
        _cell(1, "option1", F.col("p_brand")),
        _cell(2, "option2", F.col("p_type")),
        _cell(3, "option3", F.when(ln % 2 == 0, F.lit("")).otherwise(F.col("l_quantity").cast("string"))),
        _cell(4, "option4", F.col("l_returnflag")),
        _cell(5, "correct_answer", correct),
    )
    return j.select(
        F.when(ok % 3 == 0, F.lit(0)).otherwise(ok % 25).cast("long").alias("import_id"),
        (F.col("l_partkey") * F.lit(4294967296) + F.col("l_suppkey")).cast("long").alias("rec_no"),
        (ok * 8 + ln + 2).cast("long").alias("orig_row"),
        cells.alias("cells"))


def sample_writer(frames):
    """A row writer that gives every kind of result, by ``rec_no % 8``: an id, an id as text,
    success without an id, success with a name, refusal, an error, an exception, nothing."""
    import pandas as pd

    for part in frames:
        rows = []
        for import_id, rec_no in zip(part["import_id"], part["rec_no"]):
            kind = int(rec_no) % 8
            if kind == 6:
                raise ValueError(f"refused {rec_no}")
            if kind < 7:
                ok = {4: False, 5: None}.get(kind, True)
                given = {0: str(rec_no), 1: f"00{rec_no}", 3: "named"}.get(kind)
                rows.append((import_id, rec_no, ok, given, "no space left" if kind == 5 else None))
        yield pd.DataFrame(rows, columns=["import_id", "rec_no", "ok", "id", "error"])


def numbered_writer(run: int):
    """A row writer whose ids end in the number of its run; before run 3 it refuses rows of
    kind 4 and 5 (``rec_no % 8``), and it never has a result for kind 7."""
    def writer(frames):
        import pandas as pd

        for part in frames:
            part = part[part["rec_no"] % 8 != 7]
            kind = part["rec_no"] % 8
            bad = kind.isin([4, 5]) & (run < 3)
            yield pd.DataFrame({"import_id": part["import_id"], "rec_no": part["rec_no"], "ok": ~bad,
                                "id": (part["rec_no"] * 10 + run).astype(str).where(~bad, None),
                                "error": pd.Series("no space left", index=part.index, dtype=object).where(bad & (kind == 5), None)})

    return writer


def mixed_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(import_id, k, value): the lines of one file per import in the order of ``k``, CSV if
    import_id % 5 is 0 or 2, a JSON array otherwise."""
    cols = ["question", "option1", "option2", "option3", "option4", "correct_answer"]
    rows = qrow_fields(table(spark, sf_dir, "part")).select("import_id", "rec_no", *cols)
    is_csv = (F.col("import_id") % 5).isin(0, 2)
    quoted = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in cols])
    ends = rows.groupBy("import_id").agg(F.min("rec_no").alias("_first"))
    comma = F.when(F.col("rec_no") > F.col("_first"), ",").otherwise("")
    body = rows.join(ends, "import_id").select("import_id", F.col("rec_no").alias("k"), F.when(is_csv, quoted).otherwise(
        F.concat(comma, F.to_json(F.struct(*cols)))).alias("value"))
    head = ends.select("import_id", F.lit(-1).cast("long").alias("k"), F.when(is_csv, ",".join(cols)).otherwise("[").alias("value"))
    foot = ends.filter(~is_csv).select("import_id", F.lit(2**62).cast("long").alias("k"), F.lit("]").alias("value"))
    return body.unionByName(head).unionByName(foot)
