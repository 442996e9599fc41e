"""Engine table schemas."""

from pyspark.sql import types as T

CELL = T.StructType([
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])
CELLS = T.ArrayType(CELL, False)

# One row per parsed record of an uploaded file.
RECORDS = T.StructType([
    T.StructField("import_id", T.LongType(), False),
    T.StructField("rec_no", T.LongType(), False),
    T.StructField("orig_row", T.LongType(), False),
    T.StructField("cells", CELLS, False),
])

# Per-file parse outcome (file-level errors abort only that import).
FILE_META = T.StructType([
    T.StructField("import_id", T.LongType(), False),
    T.StructField("path", T.StringType(), True),
    T.StructField("ext", T.StringType(), True),
    T.StructField("has_header", T.BooleanType(), True),
    T.StructField("n_records", T.LongType(), True),
    T.StructField("error", T.StringType(), True),
])

ANSWER = T.StructType([
    T.StructField("text", T.StringType(), True),
    T.StructField("points", T.DoubleType(), True),
    T.StructField("is_correct", T.IntegerType(), True),
])

MANIFEST = T.StructType([
    T.StructField("import_id", T.LongType(), False),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("params", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("uploader_id", T.LongType(), True),
    T.StructField("has_taxonomy", T.BooleanType(), True),
])


