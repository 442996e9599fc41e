"""quarry: a Spark-native bulk question-bank import engine.

Many question files (CSV, JSON, XLSX) and a manifest of import parameters go in;
question rows, category links, one log row per import, long-form row errors,
paged history and rollbacks come out. All row work is expressed as native
Column expressions; Python runs only inside file decoders.
"""

__version__ = "0.1.0"
