"""Seed rows of the source application (5 finished workouts, 24 exercises,
26 bridge rows) with ``NOW()`` pinned to 2026-01-22 12:00:00, built with
explicit schemas."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from logmart import schemas as S

NOW = dt.datetime(2026, 1, 22, 12, 0, 0)

GYMS = [(1, "Chlumec - Bonasus", 1), (2, "Poděbrady - 24", 2), (3, "Poděbrady - Staďák", 3),
        (4, "Praha - Čerňák", 4), (5, "Other", 99)]
BODY_PARTS = [(1, "legs", 1), (2, "back", 2), (3, "shoulders", 3), (4, "core", 5),
              (5, "biceps", 6), (6, "triceps", 7), (7, "chest", 3)]
LEGS, BACK, SHOULDERS, CORE, BICEPS, TRICEPS, CHEST = 1, 2, 3, 4, 5, 6, 7

# workout id, gym, days before NOW, minutes, [(name, machine, weight, parts)]
WORKOUTS = [
    (1, 1, 21, 55, [("Squat", "Smith machine", "80", [LEGS]), ("Leg press", None, "120", [LEGS]),
                    ("Leg curl", "Machine", "45", [LEGS]), ("Plank", None, None, [CORE])]),
    (2, 2, 14, 50, [("Bench press", None, "65", [CHEST]),
                    ("Incline dumbbell press", None, "22", [CHEST, SHOULDERS]),
                    ("Tricep pushdown", "Cable", "30", [TRICEPS]), ("Dips", None, None, [TRICEPS, CHEST])]),
    (3, 4, 10, 65, [("Pull-ups", None, None, [BACK]), ("Barbell row", None, "60", [BACK]),
                    ("Lat pulldown", "Cable", "55", [BACK]), ("Bicep curl", "Dumbbell", "14", [BICEPS]),
                    ("Hammer curl", "Dumbbell", "12", [BICEPS])]),
    (4, 1, 5, 60, [("Overhead press", None, "40", [SHOULDERS]), ("Lateral raise", "Dumbbell", "10", [SHOULDERS]),
                   ("Squat", "Smith machine", "85", [LEGS]), ("Leg press", None, "130", [LEGS])]),
    (5, 3, 2, 70, [("Bench press", None, "70", [CHEST]), ("Squat", None, "90", [LEGS]),
                   ("Lat pulldown", "Cable", "60", [BACK]), ("Overhead press", None, "42", [SHOULDERS]),
                   ("Plank", None, None, [CORE]), ("Bicep curl", "Dumbbell", "16", [BICEPS]),
                   ("Tricep pushdown", "Cable", "32", [TRICEPS])]),
]


def seed(spark: SparkSession) -> dict[str, DataFrame]:
    workouts, exercises, bridge = [], [], []
    eid = 0
    for wid, gym, days, minutes, exs in WORKOUTS:
        start = NOW - dt.timedelta(days=days)
        workouts.append((wid, gym, start, start + dt.timedelta(minutes=minutes), None, NOW))
        for pos, (name, machine, w, parts) in enumerate(exs, start=1):
            eid += 1
            exercises.append((eid, wid, name, machine, None if w is None else Decimal(w).quantize(Decimal("0.01")),
                              pos, NOW))
            bridge.extend((eid, p) for p in parts)
    return {
        "gyms": spark.createDataFrame([(i, n, s, NOW) for i, n, s in GYMS], S.GYMS),
        "body_parts": spark.createDataFrame(BODY_PARTS, S.BODY_PARTS),
        "workouts": spark.createDataFrame(workouts, S.WORKOUTS),
        "exercises": spark.createDataFrame(exercises, S.EXERCISES),
        "exercise_body_parts": spark.createDataFrame(bridge, S.EXERCISE_BODY_PARTS),
        "projects": spark.createDataFrame([
            (1, "Workout tracker", "Mobile-first tracker for logging workouts, exercises, and progress.", None,
             ["HTML", "CSS", "JavaScript", "PHP", "PostgreSQL"], 1, True, NOW),
            (2, "Wedding Guest Page", "Minimal webpage for wedding guests with RSVP.", None,
             ["HTML", "CSS"], 2, True, NOW)], S.PROJECTS),
    }
