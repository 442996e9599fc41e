"""Runs that appear as a whole: claims of ids and commits, one small file each.

``root/claims/<n>`` holds the next free ids after claim n, ``root/commits/<key>`` the run
that the key's work was published by. Both are created whole or not at all, and never
replaced: two sessions that claim at once get different numbers, and of two that commit the
same key one loses. The number of a claim is unused before, so it names the run.

This needs a file system whose rename fails if the target exists (HDFS and the like); on a
local one a hard link does it. Object stores without such a rename aren't supported.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTERS = ("question_id", "log_id")


def file_system(spark: SparkSession, path: str):
    """(jvm, Hadoop path, its file system)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = file_system(spark, path)
    return fs.exists(p)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Publishes a small file whole; False if there is one already."""
    jvm, target, fs = file_system(spark, path)
    if fs.exists(target):
        return False
    sc = spark.sparkContext
    temp = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(temp))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration())
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            context.rename(temp, target, sc._gateway.new_array(kind, 0))
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        if fs.exists(temp):
            fs.delete(temp, False)


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def _last_claim(spark: SparkSession, root: str) -> int:
    _, p, fs = file_system(spark, f"{root}/claims")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n) for n in names if re.fullmatch(r"\d+", n)), default=0)


def counters(spark: SparkSession, root: str) -> tuple[int, dict[str, int]]:
    """(number of the last claim, next free id of each kind)."""
    root = root.rstrip("/")
    n = _last_claim(spark, root)
    if not n:
        return 0, dict.fromkeys(COUNTERS, 1)
    return n, json.loads(read_text(spark, f"{root}/claims/{n:020d}"))


def claim(spark: SparkSession, root: str, kind: str | None = None, count: int = 0) -> tuple[int, int]:
    """Reserves ``count`` ids of ``kind``: (number of the claim, first id)."""
    root = root.rstrip("/")
    while True:
        n, free = counters(spark, root)
        first = free.get(kind, 0)
        after = free if kind is None else free | {kind: first + count}
        if create_new(spark, f"{root}/claims/{n + 1:020d}", json.dumps(after)):
            return n + 1, first


def start_counters(spark: SparkSession, root: str, free: dict[str, int], n: int) -> None:
    """The first claim of a fresh root that goes on from another one."""
    create_new(spark, f"{root.rstrip('/')}/claims/{n:020d}", json.dumps(free))


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, key) of everything that was published."""
    path = f"{root.rstrip('/')}/commits"
    schema = "run_id long, key string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).filter("run_id is not null")


def run_of(spark: SparkSession, root: str, key: str) -> int | None:
    """The run that published ``key``."""
    row = commits(spark, root).filter(F.col("key") == F.lit(key)).first()
    return row and row["run_id"]


def commit(spark: SparkSession, root: str, run_id: int, key: str | None = None) -> bool:
    """Publishes a run; False if its key was published by another one."""
    key = f"run-{run_id}" if key is None else key
    name = re.sub(r"[^A-Za-z0-9-]", lambda m: f"_{ord(m[0]):x}_", key)
    return create_new(spark, f"{root.rstrip('/')}/commits/{name}", json.dumps({"run_id": run_id, "key": key}) + "\n")
