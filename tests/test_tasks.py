"""The forms that large tables take give the rows of the plain ones."""

from __future__ import annotations

import pytest

from logmart.operators import changes, common, rollup


def _tables(spark):
    """Orders with repeated lines, lines without an order, part or member."""
    lines = [(1, 1, 10), (2, 1, 10), (3, 1, 11), (4, 2, 12), (5, 2, None), (6, None, 10), (7, None, None), (8, 3, 99), (8, 3, 99)]
    held = [(10, "a"), (10, "b"), (11, "b"), (12, "c"), (12, "c"), (None, "z"), (13, None)]
    return (spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long"),
            spark.createDataFrame(lines, "id long, workout_id long, part int"),
            spark.createDataFrame(held, "part long, member string"))


NAMES = dict(child_bridge_key="part", bridge_child="part", bridge_member="member")


@pytest.mark.parametrize("op", ["member_set", "sibling_members"])
def test_rollups_in_tasks_of_bounded_size(spark, monkeypatch, op):
    headers, lines, held = _tables(spark)
    run = {"member_set": lambda: rollup.member_set(headers, lines, held, **NAMES),
           "sibling_members": lambda: rollup.sibling_members(lines, held, **NAMES)}[op]
    rows = lambda df: sorted(map(repr, df.collect()))
    plain = rows(run())
    monkeypatch.setattr(common, "TASK_ROWS", 1)      # nine rows, more than the eight shuffle partitions
    assert common.tasks_for(lines) == 9
    large = run()
    assert rows(large) == plain
    assert "REPARTITION_BY_NUM" in large._jdf.queryExecution().executedPlan().toString()


def test_append_children_groups_before_it_joins(spark, monkeypatch):
    base = spark.createDataFrame([(1, 7, "x", 3), (2, 7, "x", 5), (3, 8, "x", None), (4, 9, "x", 2)],
                                 "id long, workout_id long, name string, sort_order int").selectExpr(
        "id", "workout_id", "name", "'m' AS machine", "CAST(1 AS DECIMAL(6,2)) AS max_weight", "sort_order",
        "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS created_at")
    adds = spark.createDataFrame([(1, 7, 20), (2, 7, 21), (3, 8, 22), (4, 5, 23), (5, None, 24)], "seq long, h long, cid long").selectExpr(
        "seq", "h", "cid", "'n' AS name", "'m' AS machine", "CAST(1 AS DECIMAL(6,2)) AS max_weight",
        "TIMESTAMP_NTZ '2026-01-02 00:00:00' AS ts")
    want = [(20, 6), (21, 7), (22, 1), (23, 1), (24, 1)]
    for limit in (1000, 0):                          # few headers, then more than fit
        monkeypatch.setattr(changes, "BROADCAST_ROW_LIMIT", limit)
        out = changes.append_children(base, adds)
        assert sorted((r.id, r.sort_order) for r in out.where("id >= 20").collect()) == want
        assert out.where("id < 20").count() == 4


def test_streamed_log_is_made_once(spark):
    from logmart import schemas as S
    from logmart.plans.catalog import _streamed
    from logmart.streaming.changes_stream import read_outcomes
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(1, 7).selectExpr(
        "id AS seq", "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS ts", "'create_header' AS op", "id AS header_id",
        "CAST(NULL AS LONG) AS child_id", """'{"gym_id":"1"}' AS payload""")
    log = rows.mapInPandas(counted, S.CHANGES)
    base = changes.empty_tables(spark, spark.range(1, 2), spark.range(1, 2))
    out = _streamed(spark, base, log, [0, 3, 5, 9])
    assert made.value == 6
    assert sorted((r.seq, r.batch, r.outcome) for r in read_outcomes(spark, out).collect()) == [
        (1, 0, "ok"), (2, 0, "ok"), (3, 1, "ok"), (4, 1, "ok"), (5, 2, "ok"), (6, 2, "ok")]
