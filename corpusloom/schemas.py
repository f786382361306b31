"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FILES = _schema(
    ("project", T.StringType()),
    ("path", T.StringType()),
    ("size", T.LongType()),
    ("content", T.StringType()),
)

PROFILES = _schema(
    ("project", T.StringType()),
    ("max_file_size", T.LongType()),
    ("include_tests", T.BooleanType()),
    ("include_configs", T.BooleanType()),
    ("include_markup", T.BooleanType()),
    ("include_styles", T.BooleanType()),
    ("include_docs", T.BooleanType()),
    ("excluded_patterns", STRINGS),
    ("documentation_mode", T.StringType()),
    ("selection_mode", T.StringType()),
    ("included_paths", STRINGS),
    ("include_patterns", STRINGS),
    ("important_files", STRINGS),
    ("show_full_structure", T.BooleanType()),
    ("output_format", T.StringType()),
    ("output_filename", T.StringType()),
    ("append_timestamp", T.BooleanType()),
)

# One row per save or delete of a named selection; ``seq`` orders them.
SELECTION_LOG = _schema(
    ("project", T.StringType()),
    ("seq", T.LongType()),
    ("op", T.StringType()),
    ("key", T.StringType()),
    ("name", T.StringType()),
    ("description", T.StringType()),
    ("created", T.TimestampType()),
    ("paths", STRINGS),
    ("patterns", STRINGS),
)

# ``action`` is select or deselect; an empty target is the whole project.
SELECTION_EVENTS = _schema(
    ("project", T.StringType()),
    ("seq", T.LongType()),
    ("target", T.StringType()),
    ("action", T.StringType()),
)
