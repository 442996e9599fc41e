"""Continuous import from a landing folder (Structured Streaming).

The reference has no streaming operators; imports arrive one upload at a time. The
Spark-native way to run the *same* batch import on files as they land is a
``binaryFile`` stream with ``foreachBatch``: each micro-batch is a manifest of new
files, decoded and imported exactly like a batch (``quarry.operators.store``).
A micro-batch is a run whose key is the stream's checkpoint and the batch's number: once it
is committed the stream may hand it over again without effect, and what one that broke off
had written is never visible.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import params as P
from ..operators import publish
from ..operators import store as S
from ..operators.batch import materialize
from ..sources import files as FS


def start_landing_import(spark: SparkSession, landing_dir: str, root: str, params: dict[str, str],
                         quizzes: DataFrame, checkpoint: str, has_taxonomy: bool = False,
                         glob: str = "*.{csv,json,xlsx}", trigger_once: bool = False):
    """Start a stream that imports every file dropped into ``landing_dir``.

    ``params`` are the import parameters applied to every file (form fields);
    import ids are derived from the file path (stable across retries).
    """
    stream_id = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob)
              .option("recursiveFileLookup", "true").load(landing_dir))

    def import_batch(batch: DataFrame, epoch_id: int) -> None:
        key = f"stream-{stream_id}-{epoch_id}"
        if publish.run_of(spark, root, key) is not None:
            return
        pmap = F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(v))]) if params \
            else F.create_map().cast("map<string,string>")
        # the content column isn't read here: the import opens the files as it does in a batch
        manifest = materialize(batch.select(
            F.xxhash64("path").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)).alias("import_id"),
            F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"), "path", pmap.alias("params"),
            F.lit(0).cast("long").alias("uploader_id"), F.lit(has_taxonomy).alias("has_taxonomy")))
        recs, outcome = FS.read_manifest_files(spark, manifest)
        S.run_import(spark, root, recs, P.resolve_params(manifest, quizzes), file_errors=outcome, run_key=key)

    w = stream.writeStream.foreachBatch(import_batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
