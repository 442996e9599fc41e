"""File sources (S01-S09): many uploaded files decoded in parallel.

CSV files are read line by line (``csvlines``). ``binaryFile`` reads JSON and XLSX files; one
Arrow-batched Python function (``mapInArrow``) decodes each file's bytes into ordered cells
with record ordinals. Everything after that (blank filter, validation, ids) is native Column work.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ..session import staging_dir
from . import csvlines
from .decode import decode_file

DECODED_SCHEMA = (
    "import_id long, name string, kind string, rec_no long, orig_row long, "
    "cells array<struct<pos:int,key:string,value:string>>, has_header boolean, "
    "n_records long, error string"
)

# Spark hands a file to a task as one value, which can't be larger.
MAX_VALUE_BYTES = 2**31 - 16

# Decoded rows that a task hands over at once.
ROWS_PER_BATCH = 4096

# What the type of a file is told from.
HEAD_BYTES = 4096

# The message for a file that isn't there, the media type of workbooks.
MSG_INVALID_FILE = "Invalid file provided to parser."
SPREADSHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"


def _decoder(mode: str, strip_bom: bool, delimiter: str | None = None, has_header: bool | None = None):
    import pyarrow as pa

    cell_t = pa.struct([("pos", pa.int32()), ("key", pa.string()), ("value", pa.string())])
    schema = pa.schema([("import_id", pa.int64()), ("name", pa.string()), ("kind", pa.string()),
                        ("rec_no", pa.int64()),
                        ("orig_row", pa.int64()), ("cells", pa.list_(cell_t)),
                        ("has_header", pa.bool_()), ("n_records", pa.int64()), ("error", pa.string())])

    def of_file(imp, name, content):
        """Rows of one file in the order of ``schema``: its records, then its outcome."""
        recs, hh, err = decode_file(name or "", content, mode, strip_bom, delimiter, has_header)
        n = 0
        for rec_no, orig_row, cells in recs:
            n += 1
            yield (imp, name, "record", rec_no, orig_row,
                   [{"pos": p, "key": k, "value": v} for p, k, v in cells], hh, None, None)
        yield imp, name, "file", None, None, None, hh, n, err

    def run(batches):
        for batch in batches:
            files = batch.column("import_id"), batch.column("name"), batch.column("content")
            # one file at a time, its bytes where Arrow holds them
            rows = chain.from_iterable(of_file(imp.as_py(), name.as_py(), content.as_buffer())
                                       for imp, name, content in zip(*files, strict=True))
            while some := list(islice(rows, ROWS_PER_BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)],
                                                 schema=schema)

    return run


def decode_contents(files: DataFrame, mode: str = "live", strip_bom: bool = True,
                    delimiter: str | None = None, has_header: bool | None = None) -> DataFrame:
    """``files(import_id, name, content)`` -> decoded rows (kind 'record' or 'file').

    ``delimiter`` and ``has_header`` override the detection of library mode (S03)."""
    from ..session import ship_package

    ship_package(files.sparkSession)
    return files.select("import_id", "name", "content").mapInArrow(
        _decoder(mode, strip_bom, delimiter, has_header), DECODED_SCHEMA)


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, per-file outcome). A file that failed has no records (the reference aborts
    its import without a log row); its error is in the file frame."""
    files = decoded.filter(F.col("kind") == "file").select("import_id", "name", "has_header", "n_records", "error")
    recs = decoded.filter(F.col("kind") == "record").select("import_id", "name", "rec_no", "orig_row", "cells")
    return recs, files


def path_key(path):
    """What names a file whichever way it was listed: the path without a local scheme."""
    return F.regexp_replace(path, r"^file:/*", "/")


def uri_key(uri):
    """The same of a URI such as ``_metadata.file_path`` gives, where blanks and the like are coded."""
    return path_key(F.url_decode(F.regexp_replace(uri, r"\+", "%2B")))


def _escaped(path: str) -> str:
    """A path as a pattern that fits itself only."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def list_files(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(_key, path, length) of the files that ``paths(path)`` names, as far as they exist.

    Only folders reach the driver, which asks a few at a time whether they are there; Spark
    lists them in tasks and reads no content. The driver looks once more for what Spark did
    not list: empty files, and those whose name begins with ``_`` or ``.``, which Spark's
    readers never see and which are copied to the shared folder under another name.
    """
    from ..operators.batch import materialize

    wanted = paths.select("path").filter(F.col("path").isNotNull()).distinct()
    folders = [r[0] or "/" for r in wanted.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).distinct().collect()]
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm

    def there(folder: str):
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(hadoop)
        return folder if fs.exists(p) and len(fs.listStatus(p)) else None

    with ThreadPoolExecutor(16) as pool:
        folders = [f for f in pool.map(there, folders) if f]
    found = spark.createDataFrame([], "_key string, path string, length long")
    if folders:
        listing = spark.read.format("binaryFile").load([_escaped(f) for f in folders]).select(
            path_key(F.col("path")).alias("_key"), "path", "length")
        found = listing.join(wanted.select(path_key(F.col("path")).alias("_key")).distinct(), "_key", "left_semi")
    found = materialize(found)
    unseen = wanted.withColumn("_key", path_key(F.col("path"))).join(found, "_key", "left_anti").select("path")
    rows, aside = [], None
    for path in [r[0] for r in unseen.toLocalIterator()]:
        source = jvm.org.apache.hadoop.fs.Path(path)
        fs = source.getFileSystem(hadoop)
        if not fs.exists(source) or fs.getFileStatus(source).isDirectory():
            continue
        target, length = source, fs.getFileStatus(source).getLen()
        if length:
            aside = aside or staging_dir(spark, "hidden-files")
            target = jvm.org.apache.hadoop.fs.Path(f"{aside}/{len(rows)}-{re.sub('[^A-Za-z0-9.]', 'x', path.rsplit('/', 1)[1])}")
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, target.getFileSystem(hadoop), target, False, hadoop)
        rows.append((re.sub("^file:/*", "/", path), target.toString(), length))
    if rows:
        found = found.unionByName(spark.createDataFrame(rows, "_key string, path string, length long"))
    return found


def _whole_files(spark: SparkSession, whole: DataFrame) -> DataFrame:
    """(import_id, name, content) of listed files ``whole``; contents stay on the side that isn't moved."""
    files = whole.filter("length = 0").select("import_id", "name", F.lit(b"").alias("content"))
    paths = [_escaped(r[0]) for r in whole.filter("length > 0").select("path").distinct().toLocalIterator()]
    if paths:
        content = spark.read.format("binaryFile").load(paths).select("path", "content")
        files = files.unionByName(join_small(content, whole.select("import_id", "name", "path"), "path", "inner").drop("path"))
    return files


def media_type(content):
    """What a file's first 4096 bytes say it is, whatever its name.

    A zip archive that names workbook parts is a spreadsheet; JSON begins with a bracket and
    a value or a closing one; two lines with as many commas outside quotes are CSV."""
    head = F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1")
    text = F.regexp_replace(head, "^\u00EF\u00BB\u00BF", "")
    lines = F.split(F.regexp_replace(text, '"[^"]*"', "q"), "\r\n|\n|\r")
    commas = lambda k: F.length(F.regexp_replace(F.get(lines, F.lit(k)), "[^,]", ""))
    # a second line that the sample cuts off says nothing
    whole = (F.size(lines) > 2) | (F.length(content) <= HEAD_BYTES)
    return (F.when(F.length(content) == 0, "application/x-empty")
            .when(head.startswith("\xD0\xCF\x11\xE0\xA1\xB1\x1A\xE1"), "application/vnd.ms-excel")
            .when(head.startswith("PK\x03\x04") & head.rlike(r"xl/|\[Content_Types\]"), SPREADSHEET)
            .when(head.startswith("PK\x03\x04"), "application/zip")
            .when(head.contains("\x00"), "application/octet-stream")
            .when(text.rlike(r'^\s*(\[\s*(["\[{\]]|-?[0-9]|true|false|null)|\{\s*["}])'), "application/json")
            .when(whole & (commas(0) > 0) & (commas(0) == commas(1)), "text/csv")
            .otherwise("text/plain"))


def parse_files(spark: SparkSession, manifest: DataFrame, strip_bom: bool = True,
                delimiter: str | None = None, has_header: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, one meta row per file) of files of any name, by the library's rules.

    The parser is chosen by extension or by what the first bytes say: CSV (csv, txt), then
    JSON, then workbooks; a file that is none of these is read as CSV and, if that gives no
    record, as JSON. Values are trimmed, rows without any are dropped and the others numbered
    from 0 again. ``meta``: import_id, name, extension, mime, parser, total_before_filter,
    total_after_filter, error; a file that failed has an error and no rows, a missing one no
    type either. ``manifest`` has one row per import: import_id, path and optionally file_name.
    """
    from ..functions.text import php_trim
    from ..operators import batch as B
    from ..operators.rows import has_content_trim_only

    man = manifest if "file_name" in manifest.columns else manifest.withColumn("file_name", F.lit(None).cast("string"))
    last = F.regexp_extract(F.coalesce(F.col("file_name"), F.col("path")), r"([^/]*)$", 1)
    man = man.select("import_id", last.alias("name"), path_key(F.col("path")).alias("_key"))
    known = B.materialize(man.join(list_files(spark, manifest), "_key", "left").withColumn(
        "extension", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))))
    fits = F.col("length") <= MAX_VALUE_BYTES
    ext, mime = F.col("extension"), F.col("mime")
    parser = (F.when(ext.isin("csv", "txt") | mime.contains("csv"), "csv")
              .when((ext == "json") | mime.contains("json"), "json")
              .when(mime == "application/vnd.ms-excel", "xls")
              .when(ext.isin("xlsx", "xls") | mime.contains("spreadsheet"), "xlsx"))
    files = join_small(_whole_files(spark, known.filter(fits)), known.select("import_id", "extension"), "import_id", "inner")
    # the type travels in the name that the decoder goes by
    routed = files.withColumn("mime", media_type(F.col("content"))).withColumn(
        "name", F.concat("mime", F.lit("/f"), F.coalesce(F.concat(F.lit("."), parser), F.lit(""))))
    recs, outcome = split_decoded(B.materialize(decode_contents(routed, "lib", strip_bom, delimiter, has_header)))
    recs = recs.drop("name").withColumn("cells", F.transform(
        "cells", lambda c: c.withField("value", php_trim(c["value"])))).filter(has_content_trim_only(F.col("cells")))
    kept = recs.groupBy("import_id").agg(F.count("*").alias("n"))
    # a number per record over the batch, less that of its file's first
    numbered, _ = B.assign_ids(recs, base=0)
    first = numbered.groupBy("import_id").agg(F.min("question_id").alias("_first"))
    recs = join_small(numbered, first, "import_id", "inner").select(
        "import_id", (F.col("question_id") - F.col("_first")).alias("rec_no"), "orig_row", "cells")
    missing = F.col("length").isNull()
    meta = known.join(outcome.select("import_id", F.col("name").alias("_routed"), "n_records", F.col("error").alias("_e")),
                      "import_id", "left").join(kept, "import_id", "left").select(
        "import_id", "name", "extension", F.regexp_extract("_routed", "^(.*)/f[^/]*$", 1).alias("mime"),
        F.nullif(F.regexp_extract("_routed", r"/f\.([^/]*)$", 1), F.lit("")).alias("parser"),
        F.when(F.col("_e").isNull(), F.coalesce("n_records", F.lit(0))).otherwise(0).cast("long").alias("total_before_filter"),
        F.coalesce("n", F.lit(0)).cast("long").alias("total_after_filter"),
        F.when(missing, MSG_INVALID_FILE).when(~fits, "File too large for one task.").otherwise(F.col("_e")).alias("error"))
    return recs, meta


def read_manifest_files(spark: SparkSession, manifest: DataFrame, mode: str = "live", strip_bom: bool = True,
                        delimiter: str | None = None, has_header: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, per-file outcome) of every manifest path, each file decoded once.

    The manifest (one row per import) is joined to the listing of its folders, and only its
    own files are opened. CSV files of any size are read line by line by many tasks; JSON
    and XLSX files are decoded whole and may have 2 GiB. A path that doesn't exist, or a
    file too large for one value, is the error of its own import.
    """
    from ..operators.batch import materialize

    man = manifest.select("import_id", F.coalesce(F.col("file_name"), F.col("path")).alias("name"),
                          path_key(F.col("path")).alias("_key"))
    known = materialize(man.join(list_files(spark, manifest), "_key", "left"))
    by_line = F.lower(F.col("name")).endswith(".csv") if mode == "live" and delimiter is None else F.lit(False)
    fits = F.col("length") <= MAX_VALUE_BYTES
    whole = known.filter(fits & ~by_line)
    recs = spark.createDataFrame([], "import_id long, name string, rec_no long, orig_row long, "
                                     "cells array<struct<pos:int,key:string,value:string>>")
    outcome = spark.createDataFrame([], "import_id long, name string, has_header boolean, n_records long, error string")
    if not whole.isEmpty():
        files = _whole_files(spark, whole)
        recs, outcome = split_decoded(materialize(decode_contents(files, mode, strip_bom, delimiter, has_header)))
    lines = known.filter(F.col("length").isNotNull() & by_line)
    if not lines.isEmpty():
        got = read_csv_lines(spark, lines.filter("length > 0").select("import_id", "name", "path"), strip_bom)
        n = got.groupBy("import_id").agg(F.count("*").alias("n"))
        recs = recs.unionByName(got)
        outcome = outcome.unionByName(lines.join(n, "import_id", "left").select(
            "import_id", "name", (F.col("length") > 0).alias("has_header"), F.coalesce("n", F.lit(0)).alias("n_records"),
            F.lit(None).cast("string").alias("error")))
    missing = F.col("length").isNull()
    lost = known.filter(missing | (~fits & ~by_line)).select(
        "import_id", "name", F.lit(None).cast("boolean").alias("has_header"), F.lit(0).cast("long").alias("n_records"),
        F.when(missing, F.lit("File missing.")).otherwise(F.lit("File too large for one task.")).alias("error"))
    return recs, outcome.unionByName(lost)


def read_csv_lines(spark: SparkSession, files: DataFrame, strip_bom: bool = True) -> DataFrame:
    """Records of CSV files ``files(import_id, path)`` read line by line (``csvlines``).

    The first record of a file names the cells (lower-cased, trimmed); a record has a cell
    per name, missing ones are empty and further ones are dropped.
    """
    from ..operators.batch import materialize

    files = files if "name" in files.columns else files.withColumn("name", F.lit(None).cast("string"))
    paths = [_escaped(r[0]) for r in files.select("path").distinct().toLocalIterator()]
    rows = csvlines.read_fields(spark, paths, strip_bom) if paths else spark.createDataFrame(
        [], "path string, rec long, fields array<string>")
    heads = rows.filter("rec = 0").select(
        "path", F.when(F.size("fields") > 0, F.transform("fields", ascii_lower_trim)).otherwise(F.array(F.lit(""))).alias("_keys"))
    # one row per import and file, joined to the records once
    man = files.select("import_id", "name", path_key(F.col("path")).alias("_key"))
    heads = materialize(join_small(heads.withColumn("_key", uri_key(F.col("path"))), man, "_key", "inner").drop("_key"))
    cells = F.transform("_keys", lambda k, i: F.struct(i.cast("int").alias("pos"), k.alias("key"),
                                                       F.coalesce(F.get("fields", i), F.lit("")).alias("value")))
    return join_small(rows.filter("rec > 0"), heads, "path", "inner").select(
        "import_id", "name", (F.col("rec") - 1).alias("rec_no"), (F.col("rec") + 1).alias("orig_row"), cells.alias("cells"))


def ascii_lower_trim(c):
    from ..functions.text import ascii_lower, php_trim

    return ascii_lower(php_trim(c))
