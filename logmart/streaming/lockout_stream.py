"""K1 as a Structured Streaming job: ``applyInPandasWithState`` keyed by
the attempt key, with the same rule as ``operators.lockout``.

State per key: the recorded failure times still inside the window (at
most ``max_attempts`` longs) plus the (time, id) of the last attempt seen.

* Within a micro-batch the rows of a key are taken in ``(ts, id)`` order.
* A row older than the last attempt already seen for its key is emitted
  with outcome ``late`` and leaves the state alone (the source sees
  arrival order, so it has no late data; this is the streaming policy).
* Every row comes out, however late: by default there is no watermark (with
  one, Spark drops rows behind it before this code sees them) and a key's
  state stays, at most ``max_attempts`` + 2 longs.
* With ``watermark`` idle keys expire on an event-time timeout at ``last +
  window`` behind it: by then every recorded failure has expired, so dropping
  the state cannot change an outcome. Rows behind the watermark are then
  dropped by Spark, so the option fits sources that have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logmart.operators.lockout import epoch_seconds, step
from logmart.schemas import LOCKOUT_MAX_ATTEMPTS, LOCKOUT_WINDOW_SECONDS

LATE = "late"
STATE_SCHEMA = "fails array<long>, last_t long, last_id long, last_wm long"


def _make_fn(max_attempts: int, window: int, expire: bool):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            fails, last_t, last_id, last_wm = state.get
            fails = list(fails or [])
        else:
            fails, last_t, last_id, last_wm = [], None, None, None
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t_exact", "_rid"], kind="stable")
        outcomes = []
        for t, t_exact, wm, rid, kind in zip(pdf["_t"], pdf["_t_exact"], pdf["_wm_us"], pdf["_rid"], pdf["_kind"]):
            if last_t is not None and (t_exact, rid) < (last_t, last_id):
                outcomes.append(LATE)
                continue
            fails, o = step(fails, int(t), kind, max_attempts, window)
            outcomes.append(o)
            last_t, last_id, last_wm = int(t_exact), int(rid), int(wm)
        state.update((fails, last_t, last_id, last_wm))
        # expire once every recorded failure is older than the window, in
        # the watermark's own (event-time, milliseconds) timeline
        if expire:
            state.setTimeoutTimestamp(last_wm // 1000 + window * 1000 + 1)
        yield pd.DataFrame({"_k": pdf["_k"], "_rid": pdf["_rid"], "_ts": pdf["_ts"], "_kind": pdf["_kind"],
                            "outcome": outcomes})
    return fn


def lockout_stream(attempts: DataFrame, *, key: str = "key", ts: str = "ts", attempt_id: str = "attempt_id",
                   kind: str = "kind", max_attempts: int = LOCKOUT_MAX_ATTEMPTS,
                   window: int = LOCKOUT_WINDOW_SECONDS, watermark: str | None = None) -> DataFrame:
    """Streaming outcomes (append mode), one row per attempt."""
    a = attempts.select(F.col(key).cast("string").alias("_k"), F.col(attempt_id).alias("_rid"),
                        F.col(ts).alias("_ts"), F.col(kind).alias("_kind"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    a = a.withColumn("_t", epoch_seconds("_ts")).withColumn("_t_exact", F.timestamp_diff("MICROSECOND", epoch, "_ts"))
    # event time as an instant built from the zone-free microseconds, so the
    # watermark does not depend on the session time zone (or DST)
    a = a.withColumn("_wm", F.timestamp_micros("_t_exact")).withColumn("_wm_us", F.col("_t_exact"))
    if watermark:
        a = a.withWatermark("_wm", watermark)
    out_schema = (f"_k string, _rid {a.schema['_rid'].dataType.simpleString()}, _ts timestamp_ntz, "
                  "_kind string, outcome string")
    res = a.groupBy("_k").applyInPandasWithState(
        _make_fn(max_attempts, window, bool(watermark)), out_schema, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout)
    return res.select(F.col("_k").alias(key), F.col("_rid").alias(attempt_id), F.col("_ts").alias(ts),
                      F.col("_kind").alias(kind), "outcome")
