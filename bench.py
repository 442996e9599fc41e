"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query is timed as build + full execution (a hash over all columns of all rows, so
everything is computed), median of BENCH_REPEAT runs after a warm-up.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "import_log_summary",      # flagship: whole batch import, log per import
    "questions_final",         # questions table rows with ids
    "row_errors",
    "correct_index",
    "normalize_text",
    "entity_and_tag_clean",
    "rollback_survivors",
    "rollback_outcome",
    "recent_imports_page",
    "import_detail",
    "bulk_import_lineitem",    # large fixture: one question per lineitem row
    "csv_roundtrip",           # files written, listed by binaryFile, decoded, evaluated
    "json_rows",
    "csv_edge_cases",          # files read line by line
    "writer_outcomes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    os.environ.setdefault("QUARRY_MASTER", f"local[{cpus}]")

    from quarry.plans import catalog
    from quarry.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    names = [n for n in HEADLINE if n in catalog.QUERIES]
    only = os.environ.get("BENCH_QUERIES")
    if only:
        names = [n for n in only.split(",") if n in catalog.QUERIES]

    def run(name: str) -> tuple[float, int]:
        t = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf_dir)
        n = _consume(df)
        return time.perf_counter() - t, n

    times, rows = {}, {}
    for name in names:
        run(name)  # warm-up (JIT, codegen caches)
        samples = []
        for _ in range(repeat):
            sec, n = run(name)
            samples.append(sec)
        times[name] = round(statistics.median(samples), 3)
        rows[name] = n
    total = round(sum(times.values()), 3)
    # Throughput of the import itself: input records per second (BASELINE "to be measured").
    throughput = {}
    inputs = {"import_log_summary": ("part", None), "bulk_import_lineitem": ("lineitem", None)}
    for name, (tbl, _) in inputs.items():
        if name in times and times[name] > 0:
            n_in = spark.read.parquet(f"{sf_dir}/{tbl}.parquet").count()
            throughput[name] = {"input_rows": n_in, "rows_per_sec": round(n_in / times[name], 1)}
    throughput["files"] = _file_rates(spark, sf_dir)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "throughput": throughput,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
        "spark": spark.version,
    }))


def _file_rates(spark, sf_dir: str) -> dict:
    """Reading rates of generated CSV files: one decoded task per file, and line by line."""
    from pyspark.sql import functions as F

    from quarry.session import staging_dir
    from quarry.sources import derived as D
    from quarry.sources import files as FS

    out = staging_dir(spark, "bench-csv")
    (D.csv_edge_lines(spark, sf_dir).repartition("import_id").sortWithinPartitions("import_id", "k")
     .select("import_id", "value").write.partitionBy("import_id").text(out))
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).select(
        F.regexp_extract("path", r"import_id=([0-9]+)", 1).cast("long").alias("import_id"), "path", "length", "content")
    n, size = listing.agg(F.count("*"), F.sum("length")).first()
    rates = {"files": n, "bytes": size}
    whole = listing.select("import_id", F.lit("x.csv").alias("name"), "content")
    for name, build in (("decoded", lambda: FS.decode_contents(whole)),
                        ("by_line", lambda: FS.read_csv_lines(spark, listing.select("import_id", "path")))):
        _consume(build())
        t = time.perf_counter()
        _consume(build())
        sec = time.perf_counter() - t
        rates[name] = {"files_per_sec": round(n / sec, 1), "mb_per_sec": round(size / sec / 1e6, 1)}
    return rates


def _consume(df) -> int:
    """Compute every row and column without collecting to the driver."""
    from pyspark.sql import functions as F

    cols = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("_h")]
    r = df.select(*cols).agg(F.count("*").alias("n"), F.bit_xor("_h").alias("h")).collect()[0]
    return int(r["n"])


if __name__ == "__main__":
    main()
