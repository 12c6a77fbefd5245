"""K1 lockout: boundaries of the rule, batch fold against a plain Python
replay, and stream = batch for a log split into micro-batches."""

from __future__ import annotations

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import functions as F

from logmart import schemas as S
from logmart.operators.lockout import lockout, step
from logmart.streaming.changes_stream import run_available_now
from logmart.streaming.lockout_stream import lockout_stream

T0 = dt.datetime(2026, 1, 22, 12, 0, 0)


def attempts(spark, rows):
    """rows: (key, seconds after T0, kind)"""
    data = [(k, i + 1, T0 + dt.timedelta(seconds=s), kind) for i, (k, s, kind) in enumerate(rows)]
    return spark.createDataFrame(data, S.ATTEMPTS)


def outcomes(df):
    return [r.outcome for r in df.orderBy("attempt_id").collect()]


def replay(rows, max_attempts=5, window=300):
    state, out = {}, []
    for k, s, kind in sorted(rows, key=lambda r: r[1]):
        st, o = step(state.get(k, []), s, kind, max_attempts, window)
        state[k] = st
        out.append(o)
    return out


def test_fifth_failure_blocks_and_window_boundary(spark):
    rows = [("a", s, "fail") for s in (0, 10, 20, 30, 40)]       # five failures
    rows += [("a", 299, "fail"), ("a", 300, "success"), ("a", 301, "fail")]
    # at 299: failures 0..40 are all newer than 299-300 -> blocked
    # at 300: the failure at 0 is exactly 300 s old -> expired, 4 remain -> success clears
    # at 301: empty list -> invalid
    assert outcomes(lockout(attempts(spark, rows))) == [
        "invalid", "invalid", "invalid", "invalid", "invalid", "blocked", "ok", "invalid"]


def test_correct_attempt_while_blocked_and_reset(spark):
    rows = [("b", s, "fail") for s in range(5)] + [("b", 10, "success"), ("b", 20, "reset"), ("b", 30, "fail"),
                                                    ("c", 5, "success")]
    assert outcomes(lockout(attempts(spark, rows))) == [
        "invalid"] * 5 + ["blocked", "reset", "invalid", "ok"]


def test_blocked_attempt_does_not_extend_lockout(spark):
    rows = [("d", s, "fail") for s in (0, 1, 2, 3, 4)] + [("d", 250, "fail"), ("d", 302, "fail")]
    # 250 is blocked and not recorded; at 302 the failures at 0..2 expired -> 2 remain -> invalid
    assert outcomes(lockout(attempts(spark, rows))) == ["invalid"] * 5 + ["blocked", "invalid"]


def test_random_against_replay(spark):
    rnd = random.Random(11)
    rows, t = [], 0
    for _ in range(600):
        t += rnd.choice([1, 2, 5, 30, 90, 400])
        rows.append((rnd.choice("pqrs"), t, rnd.choice(["fail"] * 6 + ["success", "reset"])))
    got = outcomes(lockout(attempts(spark, rows), max_attempts=3, window=300))
    assert got == replay(rows, 3, 300)
    assert "blocked" in got


def test_stream_equals_batch_over_micro_batches(spark):
    rnd = random.Random(5)
    rows, t = [], 0
    for _ in range(300):
        t += rnd.choice([1, 3, 20, 200])
        rows.append((rnd.choice("xyz"), t, rnd.choice(["fail"] * 5 + ["success"])))
    df = attempts(spark, rows)
    batch = {r.attempt_id: r.outcome for r in lockout(df, max_attempts=3).collect()}
    src = tempfile.mkdtemp(prefix="logmart-attempts-")
    n = len(rows)
    for i, (lo, hi) in enumerate([(1, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n + 1)]):
        # one file per arrival so arrival order follows time (tiny fixture)
        df.where((F.col("attempt_id") >= lo) & (F.col("attempt_id") < hi)).coalesce(1).write.mode(
            "append").parquet(os.path.join(src, f"part{i}"))
    stream = (spark.readStream.schema(S.ATTEMPTS).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    out = run_available_now(lockout_stream(stream, max_attempts=3), "test_lockout_stream")
    streamed = {r.attempt_id: r.outcome for r in out.collect()}
    assert streamed == batch


def test_unknown_kind_counts_as_failure(spark):
    rows = [("e", s, "typo") for s in range(5)] + [("e", 10, "success")]
    out = lockout(attempts(spark, rows)).orderBy("attempt_id").collect()
    assert [r.outcome for r in out] == ["invalid"] * 5 + ["blocked"]
    assert out[0].kind == "typo"


def test_stream_marks_late_rows(spark):
    """A row older than the last attempt already seen for its key (but
    inside the watermark) is emitted as 'late' and leaves the state alone."""
    first = [("k", 100, "fail"), ("k", 200, "fail")]
    second = [("k", 150, "fail"), ("k", 210, "fail"), ("j", 5, "success")]
    src = tempfile.mkdtemp(prefix="logmart-late-")
    a1 = attempts(spark, first)
    a2 = spark.createDataFrame([(k, 10 + i, T0 + dt.timedelta(seconds=s), kind) for i, (k, s, kind) in
                                enumerate(second)], S.ATTEMPTS)
    a1.coalesce(1).write.parquet(os.path.join(src, "b0"))
    a2.coalesce(1).write.parquet(os.path.join(src, "b1"))
    stream = (spark.readStream.schema(S.ATTEMPTS).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    out = run_available_now(lockout_stream(stream, max_attempts=3), "test_lockout_late")
    got = {r.attempt_id: r.outcome for r in out.collect()}
    assert got == {1: "invalid", 2: "invalid", 10: "late", 11: "invalid", 12: "ok"}


def test_stream_keeps_rows_far_behind(spark):
    """Rows days behind the newest one come out too: late for a key that is
    past them, judged for a new key."""
    day = 86400
    batches = [[("k", 30 * day, "fail")], [("j", 30 * day + 1, "fail")], [("k", 5, "fail"), ("n", 6, "success"), ("n", 7, "fail")]]
    src, n = tempfile.mkdtemp(prefix="logmart-far-"), 0
    for b, rows in enumerate(batches):
        data = [(k, n + i, T0 + dt.timedelta(seconds=s), kind) for i, (k, s, kind) in enumerate(rows)]
        n += len(rows)
        spark.createDataFrame(data, S.ATTEMPTS).coalesce(1).write.parquet(os.path.join(src, f"b{b}"))
    stream = (spark.readStream.schema(S.ATTEMPTS).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    out = run_available_now(lockout_stream(stream, window=60), "test_lockout_far")
    assert {r.attempt_id: r.outcome for r in out.collect()} == {0: "invalid", 1: "invalid", 2: "late", 3: "ok", 4: "invalid"}


def test_hot_key_with_pauses_against_replay(spark):
    """One key holds most attempts; bursts and pauses cross many time
    buckets, so segments and the carry between buckets are exercised."""
    rnd = random.Random(29)
    rows, t = [], 0
    for _ in range(2000):
        t += rnd.choice([0, 1, 2, 3, 7, 20, 49, 50, 51, 120])
        key = "hot" if rnd.random() < 0.8 else rnd.choice("uvw")
        rows.append((key, t, rnd.choice(["fail"] * 7 + ["success", "reset"])))
    got = outcomes(lockout(attempts(spark, rows), max_attempts=4, window=50))
    assert got == replay(rows, 4, 50)
    assert got.count("blocked") > 50


def test_null_keys_are_one_key_and_lose_nothing(spark):
    rows = [(None, s, "fail") for s in range(6)] + [("a", 3, "fail"), (None, 900, "success")]
    data = [(k, i + 1, T0 + dt.timedelta(seconds=s), kind) for i, (k, s, kind) in enumerate(rows)]
    got = lockout(spark.createDataFrame(data, "key string, attempt_id long, ts timestamp_ntz, kind string"))
    assert got.count() == len(rows)
    assert outcomes(got) == ["invalid"] * 5 + ["blocked", "invalid", "ok"]


def test_group_rank_keeps_null_groups_on_every_path(spark, monkeypatch):
    from logmart.operators import common
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3), ("a", 1)], "g string, v int")
    want = {(None, 1, 1), (None, 2, 2), ("a", 1, 1), ("a", 3, 2)}
    for limit in (100, 0):                       # few hot groups, and more than the limit
        monkeypatch.setattr(common, "HOT_GROUP_LIMIT", limit)
        got = common.group_rank(df, "g", [F.col("v")], hot_rows=1)
        assert {(r.g, r.v, r.position) for r in got.collect()} == want


def test_repeated_wildcard_terms_are_one_term(spark):
    from logmart.operators.latest import search_latest
    names = spark.createDataFrame([("aa", 1), ("bb", 2)], "name string, max_weight int")
    terms = spark.createDataFrame([("%%",), ("%%",)], "term string")
    got = search_latest(names, terms).collect()
    assert sorted((r["name"], r["rank"]) for r in got) == [("aa", 1), ("bb", 2)]
