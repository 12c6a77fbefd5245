"""Declared schemas of the activity-log data model (header / child /
dimension / bridge), plus the change log and attempt log this library
adds. Every table is read with an explicit schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the source application's for equal results:
# number of body parts a full-body workout covers, history page default,
# search result cap, minimum search term length, lockout window (seconds)
# and maximum failed attempts inside it.
TOTAL_MEMBERS = 7
DEFAULT_PAGE_SIZE = 20
SEARCH_LIMIT = 10
SEARCH_MIN_LEN = 2
LOCKOUT_WINDOW_SECONDS = 300
LOCKOUT_MAX_ATTEMPTS = 5
# numeric(6,2): |x| must stay below 10^4
WEIGHT_TYPE = T.DecimalType(6, 2)

PROJECTS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("tags", T.ArrayType(T.StringType()), True),
    T.StructField("sort_order", T.IntegerType(), True),
    T.StructField("visible", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

GYMS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("sort_order", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

BODY_PARTS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("sort_order", T.IntegerType(), True),
])

WORKOUTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("gym_id", T.LongType(), False),
    T.StructField("started_at", T.TimestampNTZType(), False),
    T.StructField("finished_at", T.TimestampNTZType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

EXERCISES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("workout_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("machine", T.StringType(), True),
    T.StructField("max_weight", WEIGHT_TYPE, True),
    T.StructField("sort_order", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

EXERCISE_BODY_PARTS = T.StructType([
    T.StructField("exercise_id", T.LongType(), False),
    T.StructField("body_part_id", T.IntegerType(), False),
])

# Change log: one JSON request body per row, ordered by ``seq``.
CHANGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("header_id", T.LongType(), True),
    T.StructField("child_id", T.LongType(), True),
    T.StructField("payload", T.StringType(), True),
])

# Request body fields, all kept as raw text/JSON so the coercion rules of
# the validation step decide what is valid.
PAYLOAD = T.StructType([
    T.StructField("gym_id", T.StringType(), True),
    T.StructField("workout_id", T.StringType(), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("machine", T.StringType(), True),
    T.StructField("max_weight", T.StringType(), True),
    T.StructField("body_part_ids", T.ArrayType(T.StringType()), True),
])

ATTEMPTS = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("attempt_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("kind", T.StringType(), False),
])

TABLES = {
    "projects": PROJECTS,
    "gyms": GYMS,
    "body_parts": BODY_PARTS,
    "workouts": WORKOUTS,
    "exercises": EXERCISES,
    "exercise_body_parts": EXERCISE_BODY_PARTS,
}
