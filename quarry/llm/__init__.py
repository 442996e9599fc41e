"""Training-data operators: quality, deduplication, decontamination, archives, models.

Each module holds one operator with its own general interface; ``queries`` holds the
registered queries that apply them to the given tables, and their DuckDB SQL.
"""
