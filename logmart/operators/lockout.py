"""K1: failed-attempt lockout, batch form.

Rule per key, attempts in arrival order ``(ts, attempt_id)``, times in
whole seconds:

1. keep only recorded failures newer than ``t - window`` (strict);
2. if ``max_attempts`` or more remain: outcome ``blocked``; the attempt is
   neither checked nor recorded;
3. else a success clears the list (``ok``), a failure is appended
   (``invalid``);
4. a ``reset`` (logout) always clears the list (``reset``);
5. any other kind is a failed attempt.

Each outcome depends on earlier outcomes (a blocked attempt is not
recorded), so this is a sequential fold, not a window count. The plan
keeps it exact and skew-safe:

* A key's timeline is cut into **segments** where the state is provably
  empty: before the first attempt, after a gap of at least ``window``
  seconds (every recorded failure has expired) and after a ``reset``.
  The cut points are found per (key, time bucket of ``window`` seconds)
  plus one summary row per bucket (``segments``), so no step sorts a key's
  whole history in one task. Segments are independent and spread over
  tasks by ``(key, segment)``: a key holding a third of all attempts is
  split wherever it pauses.
* A segment with fewer than ``max_attempts`` failures can never block;
  its outcomes come from column expressions in the JVM.
* Only the remaining segments go through ``mapInPandas``: rows arrive
  sorted by ``(key, segment, ts, id)`` and the fold streams over them
  with at most ``max_attempts`` timestamps of state, never holding a group
  in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmart.operators.common import null_safe_join
from logmart.schemas import LOCKOUT_MAX_ATTEMPTS, LOCKOUT_WINDOW_SECONDS
from logmart.session import ensure_checkpoint_dir, shuffle_partitions

# Outcome labels (HTTP 200 / 401 / 429 of the source, and
# the logout).
OK, INVALID, BLOCKED, RESET = "ok", "invalid", "blocked", "reset"
FAIL, SUCCESS = "fail", "success"

EPOCH = "1970-01-01 00:00:00"


def epoch_seconds(ts: str):
    """Whole seconds since 1970 of a timestamp_ntz (no time zone)."""
    return F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(ts))


class SegmentFold:
    """Sequential rule over rows sorted by (key, segment, ts, id); the
    state restarts at every (key, segment) change and is carried across
    Arrow batches of one partition."""

    def __init__(self, max_attempts: int, window: int):
        self.max_attempts, self.window = max_attempts, window
        self.state: list[int] = []
        self.prev = None

    def outcomes(self, pdf: pd.DataFrame) -> list[str]:
        out = []
        for k, seg, t, kind in zip(pdf["_k"], pdf["_seg"], pdf["_t"], pdf["_kind"]):
            k = None if pd.isna(k) else k          # NaN never equals itself
            if (k, seg) != self.prev:
                self.state, self.prev = [], (k, seg)
            self.state, o = step(self.state, int(t), kind, self.max_attempts, self.window)
            out.append(o)
        return out


def step(state: list[int], t: int, kind: str, max_attempts: int, window: int) -> tuple[list[int], str]:
    """One attempt against the recorded failures; returns (state, outcome)."""
    state = [f for f in state if f > t - window]
    if kind == "reset":
        return [], RESET
    if len(state) >= max_attempts:
        return state, BLOCKED
    if kind == "success":
        return [], OK
    return state + [t], INVALID


def _fold_partitions(max_attempts: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = SegmentFold(max_attempts, window)
        for pdf in batches:
            yield pdf[["_k", "_rid", "_ts", "_kind_in"]].assign(outcome=fold.outcomes(pdf))
    return run


def segments(a: DataFrame, window: int) -> DataFrame:
    """Add ``_seg`` (the (t, id) of the segment's first attempt, packed as a
    struct) to attempts ``_k, _rid, _ts, _t, _kind``.

    A row starts a segment when its key's previous attempt is absent, at
    least ``window`` seconds older, or a ``reset``. Time is cut into buckets
    ``window`` seconds wide: a bucket's first row can only have its
    predecessor in the previous bucket (anything older is a gap of at least
    ``window``). So row-level work runs per (key, bucket), bounded by a key's
    attempts per ``window`` seconds, never by all of a key's history; only
    one summary row per (key, bucket) is scanned per key to carry the open
    segment across buckets.
    """
    a = a.withColumn("_b", F.floor(F.col("_t") / window).cast("long"))
    order = F.struct("_ts", "_rid")
    wb = Window.partitionBy("_k", "_b").orderBy("_ts", "_rid")
    prev_t, prev_kind = F.lag("_t").over(wb), F.lag("_kind").over(wb)
    # last attempt of each (key, bucket), to be seen by the next bucket
    last = a.groupBy("_k", "_b").agg(F.max_by(F.struct("_t", "_kind"), order).alias("_last"))
    nxt = last.select("_k", (F.col("_b") + 1).alias("_b"), F.col("_last._t").alias("_pt"),
                      F.col("_last._kind").alias("_pk"))
    a = null_safe_join(a, nxt, ["_k", "_b"], "left")
    pt = F.coalesce(prev_t, F.col("_pt"))
    pk = F.when(prev_t.isNotNull(), prev_kind).otherwise(F.col("_pk"))
    a = a.withColumn("_brk", pt.isNull() | ((F.col("_t") - pt) >= window) | (pk == "reset"))
    # within the bucket: the last break at or before the row
    a = a.withColumn("_sb", F.last(F.when(F.col("_brk"), order), ignorenulls=True).over(
        wb.rowsBetween(Window.unboundedPreceding, 0)))
    # read twice below (bucket summary and the row join): compute it once
    ensure_checkpoint_dir(a.sparkSession)
    a = a.checkpoint(eager=True)
    # across buckets: segment still open at the end of each bucket
    summ = a.groupBy("_k", "_b").agg(F.max_by(F.when(F.col("_brk"), order), F.when(F.col("_brk"), order))
                                     .alias("_lastbrk"))
    wk = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    summ = summ.withColumn("_open", F.last("_lastbrk", ignorenulls=True).over(wk))
    carry = summ.select("_k", (F.col("_b") + 1).alias("_b"), F.col("_open").alias("_carry"))
    a = null_safe_join(a, carry, ["_k", "_b"], "left")
    return a.withColumn("_seg", F.coalesce("_sb", "_carry")).drop("_b", "_pt", "_pk", "_brk", "_sb", "_carry")


def lockout(attempts: DataFrame, *, key: str = "key", ts: str = "ts", attempt_id: str = "attempt_id",
            kind: str = "kind", max_attempts: int = LOCKOUT_MAX_ATTEMPTS,
            window: int = LOCKOUT_WINDOW_SECONDS, partitions: int | None = None) -> DataFrame:
    """Every attempt with its ``outcome`` (ok / invalid / blocked / reset)."""
    # any kind other than success / reset counts as a failed attempt, in the
    # fold and in the per-segment failure count alike; the input kind is kept
    a = attempts.select(F.col(key).alias("_k"), F.col(attempt_id).alias("_rid"), F.col(ts).alias("_ts"),
                        F.col(kind).alias("_kind_in"),
                        F.when(F.col(kind).isin(SUCCESS, RESET), F.col(kind)).otherwise(F.lit(FAIL)).alias("_kind"))
    a = segments(a.withColumn("_t", epoch_seconds("_ts")), window)
    # failures per segment: a partially aggregated count, joined back
    fails = a.groupBy("_k", "_seg").agg(F.sum((F.col("_kind") == FAIL).cast("int")).alias("_segfails"))
    # both outcome paths read the segmented attempts: materialise them once
    a = null_safe_join(a, fails, ["_k", "_seg"]).checkpoint(eager=True)
    simple = a.where(F.col("_segfails") < max_attempts).withColumn(
        "outcome", F.when(F.col("_kind") == "reset", RESET).when(F.col("_kind") == SUCCESS, OK).otherwise(INVALID))
    hard = a.where(F.col("_segfails") >= max_attempts).select("_k", "_seg", "_rid", "_ts", "_t", "_kind",
                                                              "_kind_in")
    n = partitions or shuffle_partitions(attempts.sparkSession)
    hard_sorted = hard.repartition(int(n), "_k", "_seg").sortWithinPartitions("_k", "_seg", "_ts", "_rid")
    out_schema = (f"_k {a.schema['_k'].dataType.simpleString()}, _rid {a.schema['_rid'].dataType.simpleString()}, "
                  f"_ts timestamp_ntz, _kind_in {a.schema['_kind_in'].dataType.simpleString()}, outcome string")
    hard_out = hard_sorted.mapInPandas(_fold_partitions(max_attempts, window), out_schema)
    cols = [F.col("_k").alias(key), F.col("_rid").alias(attempt_id), F.col("_ts").alias(ts),
            F.col("_kind_in").alias(kind), "outcome"]
    return simple.select(*cols).unionByName(hard_out.select(*cols))
