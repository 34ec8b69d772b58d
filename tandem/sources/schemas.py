"""Explicit schemas for the nested JSON inputs.

Reading with a fixed schema (never inference) means a match without any
substitution or shot still has those columns (as NULL) and every file of a
folder yields the same columns, so a whole season is one scan.
"""

from pyspark.sql import types as T

_ID = T.StructType([T.StructField("id", T.LongType())])


def event_schema(type_id: T.DataType = T.LongType()) -> T.StructType:
    """Event record schema; ``type_id`` is the type of ``type.id`` (numeric
    ids in the original files, names in the table binding)."""
    return T.StructType([
        T.StructField("index", T.LongType()),
        T.StructField("type", T.StructType([T.StructField("id", type_id)])),
        *_EVENT_REST,
    ])


_EVENT_REST = [
    T.StructField("player", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
    ])),
    T.StructField("team", _ID),
    T.StructField("possession_team", _ID),
    T.StructField("location", T.ArrayType(T.DoubleType())),
    T.StructField("timestamp", T.StringType()),
    T.StructField("shot", T.StructType([T.StructField("outcome", _ID)])),
    T.StructField("substitution", T.StructType([T.StructField("replacement", _ID)])),
]

EVENT_SCHEMA = event_schema()

LINEUP_SCHEMA = T.StructType([
    T.StructField("team_id", T.LongType()),
    T.StructField("lineup", T.ArrayType(T.StructType([
        T.StructField("player_id", T.LongType()),
        T.StructField("player_name", T.StringType()),
    ]))),
])

MATCH_LIST_SCHEMA = T.StructType([T.StructField("match_id", T.LongType())])
