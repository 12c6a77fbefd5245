"""C1-C11 on inline fixtures: ordinals that depend on history, rejects,
no-ops, cascades, and a brute-force replay as the oracle."""

from __future__ import annotations

import datetime as dt
import json
import random
import re
from decimal import Decimal

from pyspark.sql import functions as F

from logmart import schemas as S
from logmart.operators import changes as C

T0 = dt.datetime(2026, 1, 22, 12, 0, 0)


def log(spark, rows):
    """rows: (op, header_id, child_id, payload dict)"""
    data = [(i + 1, T0 + dt.timedelta(minutes=i), op, h, c, json.dumps(p)) for i, (op, h, c, p) in enumerate(rows)]
    return spark.createDataFrame(data, S.CHANGES)


def base(spark, seed, empty=False):
    if empty:
        return C.empty_tables(spark, seed["gyms"], seed["body_parts"])
    return C.Tables(seed["gyms"], seed["body_parts"], seed["workouts"], seed["exercises"],
                    seed["exercise_body_parts"])


def add(h, cid, name="Row", parts=(1,), w="10"):
    return ("add_child", None, cid, {"workout_id": str(h), "name": name, "body_part_ids": list(parts),
                                     "max_weight": w})


def test_ordinals_follow_history(spark, seed):
    rows = [("create_header", 100, None, {"gym_id": 1})]
    rows += [add(100, 1000 + i) for i in range(1, 4)]                      # 1, 2, 3
    rows += [("delete_child", None, None, {"id": 1003}), add(100, 1004)]   # delete last -> 3 again
    rows += [("delete_child", None, None, {"id": 1002}), add(100, 1005)]   # delete middle -> 4
    out = C.apply_changes(base(spark, seed, empty=True), log(spark, rows))
    got = {r.id: r.sort_order for r in out["exercises"].collect()}
    assert got == {1001: 1, 1004: 3, 1005: 4}
    assert {r.outcome for r in out["outcomes"].collect()} == {"ok"}


def test_outcomes_and_rejects(spark, seed):
    rows = [
        ("create_header", 100, None, {"gym_id": "0"}),                    # missing gym
        ("create_header", 101, None, {"gym_id": "12abc"}),                # unknown gym (FK)
        ("create_header", 102, None, {"gym_id": " 3"}),
        add(999, 2000),                                                    # unknown header
        add(102, 2001, name="0"),                                          # "0" is not a name
        add(102, 2002, parts=()),                                          # no members
        add(102, 2003, w="10000"),                                         # numeric(6,2) overflow
        add(102, 2004, parts=(1, 1)),                                      # duplicate member (PK)
        add(102, 2005, parts=(1, 42)),                                     # unknown member (FK)
        add(102, 2006, name="  Squat\t", parts=(1, 7), w=""),
        ("update_child", None, None, {"id": 777, "name": "x", "body_part_ids": [1]}),   # not found
        ("delete_child", None, None, {"id": 777}),                         # missing: fine
        ("finish_header", None, None, {"id": 102}),
        ("finish_header", None, None, {"id": 102}),                        # double finish overwrites
        ("finish_header", None, None, {"id": 5555}),                       # missing: fine
        ("finish_header", None, None, {}),                                 # id required
        ("bogus", None, None, {}),
    ]
    out = C.apply_changes(base(spark, seed, empty=True), log(spark, rows))
    got = [r.outcome for r in out["outcomes"].orderBy("seq").collect()]
    assert got == ["rejected:missing_gym", "rejected:unknown_gym", "ok", "rejected:unknown_header",
                   "rejected:missing_fields", "rejected:missing_fields", "rejected:weight_out_of_range",
                   "rejected:duplicate_member", "rejected:unknown_member", "ok", "rejected:not_found", "noop",
                   "ok", "ok", "noop", "rejected:missing_id", "rejected:unknown_op"]
    ex = out["exercises"].collect()
    assert [(r.id, r.name, r.max_weight, r.sort_order) for r in ex] == [(2006, "Squat", None, 1)]
    assert sorted(r.body_part_id for r in out["exercise_body_parts"].collect()) == [1, 7]
    w = out["workouts"].collect()
    assert [(r.id, r.finished_at) for r in w] == [(102, T0 + dt.timedelta(minutes=13))]


def test_update_replaces_fields_and_members_on_seed(spark, seed):
    rows = [("update_child", None, None, {"id": "6", "name": "Incline press", "machine": " 0 ",
                                          "max_weight": "2.345", "body_part_ids": ["3"]}),
            add(5, 5000, name="Dips", parts=(6,)),             # next ordinal after 7 in workout 5
            ("delete_header", None, None, {"id": 1}),             # cascade
            ("update_child", None, None, {"id": 1, "name": "gone", "body_part_ids": [1]})]
    out = C.apply_changes(base(spark, seed), log(spark, rows))
    ex = {r.id: r for r in out["exercises"].collect()}
    assert (ex[6].name, ex[6].machine, ex[6].max_weight, ex[6].sort_order) == (
        "Incline press", None, Decimal("2.35"), 2)
    assert ex[5000].sort_order == 8
    assert not any(r.workout_id == 1 for r in ex.values())
    members = {(r.exercise_id, r.body_part_id) for r in out["exercise_body_parts"].collect()}
    assert (6, 3) in members and (6, 7) not in members
    assert not any(e in (1, 2, 3, 4) for e, _ in members)
    assert out["workouts"].count() == 4
    last = out["outcomes"].orderBy("seq").collect()[-1]
    assert last.outcome == "rejected:not_found"


def replay(base_children, rows):
    """Brute force: the endpoints applied one request at a time."""
    headers = {100: True}
    kids = dict(base_children)          # cid -> (header, sort)
    out = []
    for op, h, c, p in rows:
        if op == "add_child":
            hh = int(p["workout_id"])
            if not headers.get(hh):
                out.append("rejected:unknown_header")
                continue
            mx = max([s for (x, s) in kids.values() if x == hh] or [0])
            kids[c] = (hh, mx + 1)
            out.append("ok")
        elif op == "delete_child":
            out.append("ok" if kids.pop(int(p["id"]), None) else "noop")
        elif op == "delete_header":
            hh = int(p["id"])
            if headers.get(hh):
                headers[hh] = False
                kids = {k: v for k, v in kids.items() if v[0] != hh}
                out.append("ok")
            else:
                out.append("noop")
    return kids, out


def test_random_logs_against_brute_force(spark, seed):
    rnd = random.Random(7)
    for trial in range(3):
        rows, next_id, ids = [], 3000, []
        for _ in range(40):
            r = rnd.random()
            if r < 0.55 or not ids:
                rows.append(add(100, next_id))
                ids.append(next_id)
                next_id += 1
            elif r < 0.95:
                rows.append(("delete_child", None, None, {"id": rnd.choice(ids + [1])}))
            else:
                rows.append(("delete_header", None, None, {"id": 100}))
        t = base(spark, seed, empty=True)
        t.workouts = spark.createDataFrame([(100, 1, T0, None, None, T0)], S.WORKOUTS)
        out = C.apply_changes(t, log(spark, rows))
        kids, expected = replay({}, rows)
        assert [r.outcome for r in out["outcomes"].orderBy("seq").collect()] == expected, trial
        assert {r.id: r.sort_order for r in out["exercises"].collect()} == {k: v[1] for k, v in kids.items()}


def test_log_split_equals_whole(spark, seed):
    rows = [add(5, 6000 + i) for i in range(4)] + [("delete_child", None, None, {"id": 6003}), add(5, 6010),
                                                  ("delete_child", None, None, {"id": 24}), add(5, 6011)]
    whole = C.apply_changes(base(spark, seed), log(spark, rows))
    first = C.apply_changes(base(spark, seed), log(spark, rows[:4]))
    mid = C.Tables(seed["gyms"], seed["body_parts"], first["workouts"], first["exercises"],
                   first["exercise_body_parts"])
    second_log = log(spark, rows).where(F.col("seq") > 4)
    second = C.apply_changes(mid, second_log)
    key = lambda df: sorted((r.id, r.sort_order) for r in df.collect())
    assert key(whole["exercises"]) == key(second["exercises"])


def test_set_based_pieces(spark, seed):
    ex, br = C.fk_to_bridge(spark.createDataFrame([(1, 3), (2, None)], "id long, body_part_id int"))
    assert ex.columns == ["id"] and [tuple(r) for r in br.collect()] == [(1, 3)]
    upd = C.keyed_update(seed["gyms"], "id", spark.createDataFrame([(5, None)], "id long, name string"))
    assert {r.id: r.name for r in upd.collect()}[5] is None
    more = C.append_rows(seed["body_parts"], spark.createDataFrame([(8, "neck")], "id int, name string"))
    assert more.where("id = 8").first().sort_order is None
    h, c, b = C.cascade_delete(seed["workouts"], seed["exercises"], seed["exercise_body_parts"],
                               header_ids=spark.createDataFrame([(3,), (77,)], "id long"))
    assert (h.count(), c.count(), b.count()) == (4, 19, 21)


def test_append_only_pieces(spark, seed):
    adds = spark.createDataFrame(
        [(10, T0, 2, 900, "Row A", None, Decimal("5.00"), [1]), (11, T0, 2, 901, "Row B", "M", None, [2, 3]),
         (12, T0, 99, 902, "Row C", None, None, [4])],
        "seq long, ts timestamp_ntz, h long, cid long, name string, machine string, max_weight decimal(6,2), "
        "members array<int>")
    kids = C.append_children(seed["exercises"], adds)
    got = {r.id: r.sort_order for r in kids.where("id >= 900").collect()}
    assert got == {900: 5, 901: 6, 902: 1}        # after max 4 of workout 2; a new header starts at 1
    br = C.append_bridge(seed["exercise_body_parts"], adds)
    assert br.count() == 26 + 4
    fin = C.finish_headers(seed["workouts"], spark.createDataFrame(
        [(1, T0, 1), (2, T0 + dt.timedelta(hours=1), 1), (3, T0, 77)], "seq long, ts timestamp_ntz, h long"))
    assert {r.id: r.finished_at for r in fin.collect()}[1] == T0 + dt.timedelta(hours=1)
    ex, b = C.upsert_children(seed["exercises"], seed["exercise_body_parts"], adds.withColumn("cid", F.lit(1)))
    r1 = ex.where("id = 1").first()
    assert (r1.name, r1.sort_order) == ("Row C", 1)       # last update wins, ordinal kept
    assert sorted(x.body_part_id for x in b.where("exercise_id = 1").collect()) == [4]
    hdr = C.append_headers(seed["workouts"], adds.withColumn("gym_id", F.lit(1)).where("seq = 12"))
    assert hdr.where("id = 99").first().finished_at is None


def test_resolve_keys(spark, seed):
    from logmart.operators.listing import resolve_keys
    names = spark.createDataFrame([("legs",), ("chest",), ("neck",)], "part string")
    ok, missing = resolve_keys(names, seed["body_parts"], name_col="part")
    assert {r.part: r.resolved_id for r in ok.collect()} == {"legs": 1, "chest": 7}
    assert [r.part for r in missing.collect()] == ["neck"]


def test_stream_changes_equals_batch(spark, seed, tmp_path):
    from logmart.streaming.changes_stream import read_latest, read_outcomes, stream_changes, write_batch
    rows = [add(5, 7000), add(5, 7001), ("delete_child", None, None, {"id": 7001}),
            ("finish_header", None, None, {"id": 4}), add(5, 7002), ("delete_child", None, None, {"id": 24}),
            add(5, 7003), ("update_child", None, None, {"id": 7000, "name": "Renamed", "body_part_ids": [2, 3]})]
    whole = C.apply_changes(base(spark, seed), log(spark, rows))
    src, out = str(tmp_path / "log"), str(tmp_path / "tables")
    full = log(spark, rows)
    for lo, hi in ((1, 4), (4, 9)):
        full.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").json(src)
        q = stream_changes(spark.readStream.schema(S.CHANGES).json(src), base(spark, seed), out,
                           str(tmp_path / "ckpt"), available_now=True)
        q.awaitTermination()
    verdicts = sorted((r.batch, r.seq, r.outcome) for r in read_outcomes(spark, out).collect())
    assert [(b, s) for b, s, _ in verdicts] == [(0, 1), (0, 2), (0, 3), *[(1, i) for i in range(4, 9)]]
    # only what a batch changed is written, and running it again changes nothing
    changed = lambda: sorted((r.batch, r.id, r.deleted) for r in spark.read.parquet(f"{out}/exercises").collect())
    assert changed() == [(0, 7000, False), (0, 7001, True), (1, 24, True), (1, 7000, False), (1, 7002, False), (1, 7003, False)]
    before = changed()
    write_batch(spark, out, base(spark, seed), full.where("seq >= 4"), 1)
    assert changed() == before
    got = read_latest(spark, out, base(spark, seed))
    key = lambda df: sorted((r.id, r.name, r.sort_order) for r in df.collect())
    assert key(got.exercises) == key(whole["exercises"])
    assert sorted(tuple(r) for r in got.exercise_body_parts.collect()) == sorted(
        tuple(r) for r in whole["exercise_body_parts"].collect())
    assert {r.id: r.finished_at for r in got.workouts.collect()} == {
        r.id: r.finished_at for r in whole["workouts"].collect()}


def test_create_without_assigned_id(spark, seed):
    rows = [("create_header", None, None, {"gym_id": 1}), ("add_child", None, None, {"workout_id": 1, "name": "x",
                                                                                       "body_part_ids": [1]})]
    out = C.apply_changes(base(spark, seed), log(spark, rows))
    assert [r.outcome for r in out["outcomes"].orderBy("seq").collect()] == ["rejected:missing_id"] * 2


def test_large_random_log_several_headers(spark, seed):
    """200 interleaved adds and deletes over three headers (one of them
    deleted midway) against the brute-force replay."""
    rnd = random.Random(41)
    rows, next_id, ids = [], 9000, []
    for i in range(200):
        r = rnd.random()
        if r < 0.55 or not ids:
            rows.append(add(rnd.choice([100, 100, 100, 101, 102]), next_id))
            ids.append(next_id)
            next_id += 1
        elif r < 0.98:
            rows.append(("delete_child", None, None, {"id": rnd.choice(ids)}))
        else:
            rows.append(("delete_header", None, None, {"id": 101}))
    t = base(spark, seed, empty=True)
    t.workouts = spark.createDataFrame([(h, 1, T0, None, None, T0) for h in (100, 101)], S.WORKOUTS)
    out = C.apply_changes(t, log(spark, rows))

    headers = {100: True, 101: True}
    kids, expected = {}, []
    for op, h, c, p in rows:
        if op == "add_child":
            hh = int(p["workout_id"])
            if not headers.get(hh):
                expected.append("rejected:unknown_header")
                continue
            kids[c] = (hh, max([s for (x, s) in kids.values() if x == hh] or [0]) + 1)
            expected.append("ok")
        elif op == "delete_child":
            expected.append("ok" if kids.pop(int(p["id"]), None) else "noop")
        else:
            if headers.get(101):
                headers[101] = False
                kids = {k: v for k, v in kids.items() if v[0] != 101}
                expected.append("ok")
            else:
                expected.append("noop")
    assert [r.outcome for r in out["outcomes"].orderBy("seq").collect()] == expected
    assert {r.id: (r.workout_id, r.sort_order) for r in out["exercises"].collect()} == kids


def test_empty_inputs(spark, seed):
    from logmart.operators import latest, lockout as L
    from logmart.operators.common import global_rank, group_rank
    out = C.apply_changes(base(spark, seed), spark.createDataFrame([], S.CHANGES))
    assert out["outcomes"].count() == 0 and out["exercises"].count() == 24
    assert L.lockout(spark.createDataFrame([], S.ATTEMPTS)).count() == 0
    l1 = latest.latest_values(seed["exercises"], seed["workouts"])
    assert latest.search_latest(l1, spark.createDataFrame([], "term string")).count() == 0
    empty = spark.createDataFrame([], "id long, g long")
    assert global_rank(empty, [F.col("id")]).count() == 0
    assert group_rank(empty, "g", [F.col("id")], hot_rows=0).count() == 0


def test_oversized_member_id_is_unknown(spark, seed, monkeypatch):
    rows = [("create_header", 100, None, {"gym_id": 1}), add(100, 1, parts=(99999999999,)), add(100, 2)]
    for limit in (1000, 0):                      # the members inline, and through a join
        monkeypatch.setattr(C, "INLINE_MEMBER_LIMIT", limit)
        out = C.apply_changes(base(spark, seed, empty=True), log(spark, rows))
        assert [r.outcome for r in out["outcomes"].orderBy("seq").collect()] == ["ok", "rejected:unknown_member", "ok"]


def replay_all(headers, kids, rows, t0=0):
    """Brute force over all ops; kids: id -> [header, sort, name, members],
    headers: id -> [gym, finished_at]."""
    out = []
    for i, (op, h, c, p) in enumerate(rows):
        ts = T0 + dt.timedelta(minutes=t0 + i)
        i = int(p.get("id", 0))
        if op == "create_header":
            out.append("rejected:duplicate_id" if h in headers else "ok")
            headers.setdefault(h, [p["gym_id"], None])
        elif op in ("finish_header", "delete_header"):
            out.append("ok" if i in headers else "noop")
            if i in headers and op == "finish_header":
                headers[i][1] = ts
            elif i in headers:
                del headers[i]
                for k in [k for k, v in kids.items() if v[0] == i]:
                    del kids[k]
        elif op == "add_child":
            hh = int(p["workout_id"])
            if hh not in headers:
                out.append("rejected:unknown_header")
            elif c in kids:
                out.append("rejected:duplicate_id")
            else:
                mx = max([v[1] for v in kids.values() if v[0] == hh], default=0)
                kids[c] = [hh, mx + 1, p["name"], set(p["body_part_ids"])]
                out.append("ok")
        elif op == "update_child":
            out.append("ok" if i in kids else "rejected:not_found")
            if i in kids:
                kids[i][2:] = [p["name"], set(p["body_part_ids"])]
        else:
            out.append("ok" if kids.pop(i, None) else "noop")
    return out


def state(spark, t):
    members = {}
    for r in t["exercise_body_parts"].collect():
        members.setdefault(r.exercise_id, []).append(r.body_part_id)
    assert all(len(m) == len(set(m)) for m in members.values())
    kids = [(r.id, r.workout_id, r.sort_order, r.name, sorted(members.pop(r.id, []))) for r in t["exercises"].collect()]
    assert not members, "members of no child"
    return sorted(kids), sorted((r.id, r.gym_id, r.finished_at) for r in t["workouts"].collect())


def test_reused_ids_against_brute_force(spark, seed):
    """Adds after deletes, re-created headers, ids that move between
    headers, base children; whole and split in two."""
    rnd = random.Random(11)
    b = base(spark, seed)
    start = {"workouts": b.workouts, "exercises": b.exercises, "exercise_body_parts": b.exercise_body_parts}
    for trial in range(2):
        rows = []
        for _ in range(150):
            r, i = rnd.random(), rnd.choice([1, 2, 5, 6, 24, 900, 901, 902, 903])
            h = rnd.choice([1, 2, 5, 100])
            parts = rnd.sample(range(1, 8), rnd.randint(1, 3))
            rows.append(add(h, i, name=f"n{rnd.randrange(99)}", parts=parts) if r < 0.4 else
                        ("delete_child", None, None, {"id": i}) if r < 0.6 else
                        ("update_child", None, None, {"id": i, "name": f"u{rnd.randrange(99)}", "body_part_ids": parts})
                        if r < 0.75 else ("finish_header", None, None, {"id": h}) if r < 0.8 else
                        ("delete_header", None, None, {"id": h}) if r < 0.87 else ("create_header", h, None, {"gym_id": 1}))
        headers = {r.id: [r.gym_id, r.finished_at] for r in b.workouts.collect()}
        kids = {k: [h, s, n, set(m)] for k, h, s, n, m in state(spark, start)[0]}
        expected = replay_all(headers, kids, rows)
        want = (sorted((k, v[0], v[1], v[2], sorted(v[3])) for k, v in kids.items()),
                sorted((k, *v) for k, v in headers.items()))
        full = log(spark, rows)
        whole = C.apply_changes(b, full)
        assert [r.outcome for r in whole["outcomes"].orderBy("seq").collect()] == expected
        assert state(spark, whole) == want
        cut = rnd.randrange(20, 130)
        first = C.apply_changes(b, full.where(F.col("seq") <= cut))
        second = C.apply_changes(C.Tables(b.gyms, b.body_parts, first["workouts"], first["exercises"],
                                          first["exercise_body_parts"]), full.where(F.col("seq") > cut))
        assert [r.outcome for x in (first, second) for r in x["outcomes"].orderBy("seq").collect()] == expected
        assert state(spark, second) == want


def test_many_adds_to_one_header():
    """Ordinals cost no pass over the header's children."""
    import time
    fold, t = C._Ordinals(), time.time()
    for i in range(200_000):
        assert fold.apply((1, None), "add_child", i, None) == i // 2 + 1 + (i % 2)
        if i % 2:
            fold.apply((1, None), "delete_child", i - 1, None)
            fold.apply((1, None), "delete_child", i, None)
            fold.apply((1, None), "add_child", -i, None)
    assert time.time() - t < 20


def test_repeated_seq_both_member_checks(spark, seed, monkeypatch):
    """Requests of one seq are judged apart, whatever the size of the member
    dimension."""
    rows = [add(5, 9100, parts=(1, 42)), add(5, 9101, parts=(2, 2)), add(5, 9102, parts=(3,))]
    same = log(spark, rows).withColumn("seq", F.lit(1).cast("long")).coalesce(1)
    for limit in (1000, 0):
        monkeypatch.setattr(C, "INLINE_MEMBER_LIMIT", limit)
        out = C.apply_changes(base(spark, seed), same)
        assert sorted(r.outcome for r in out["outcomes"].collect()) == [
            "ok", "rejected:duplicate_member", "rejected:unknown_member"]


def test_plan_without_python(spark, seed):
    """A log without a delete before an add, and without moving ids, is
    applied by built-in operators only; its hot header in many tasks."""
    rows = [("create_header", 100, None, {"gym_id": 1})] + [add(100, 8000 + i) for i in range(9)]
    rows += [("delete_child", None, None, {"id": 8003}), ("finish_header", None, None, {"id": 100})]
    out = C.apply_changes(base(spark, seed), log(spark, rows))
    for df in out.values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "Python" not in plan
    assert sorted(r.sort_order for r in out["exercises"].where("workout_id = 100").collect()) == [1, 2, 3, 5, 6, 7, 8, 9]


def test_hot_groups_scan(spark):
    """Running values are the same when every group is split over tasks."""
    from logmart.operators.common import group_scan, hot_groups
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 2, 3, None]), i, rnd.choice([None, None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "g long, i long, x long").repartition(5)
    want, last = {}, {}
    for g, i, x in rows:
        want[i] = last.get(g)
        last[g] = x if x is not None else last.get(g)
    for limit in (10**6, 60, 0):
        got = group_scan(df, "g", [F.asc("i")], {"was": F.col("x")}, hot_groups(df, "g", limit)).collect()
        assert {r.i: r.was for r in got} == want


def test_log_is_validated_where_it_is(spark, seed, monkeypatch):
    """The whole log isn't joined with the gyms, only its creates are."""
    plans, keep = {}, C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: plans.update(
        {name: df._jdf.queryExecution().optimizedPlan().toString()}) or keep(df, name))
    rows = [("create_header", 101, None, {"gym_id": "1"}), ("create_header", 102, None, {"gym_id": "999"}),
            ("create_header", 103, None, {"gym_id": "x"}), ("finish_header", None, None, {"id": "101"})]
    out = C.apply_changes(base(spark, seed, empty=True), log(spark, rows))
    got = {r.seq: r.outcome for r in out["outcomes"].collect()}
    assert got == {1: "ok", 2: "rejected:unknown_gym", 3: "rejected:missing_gym", 4: "ok"}
    assert "Join" not in plans["changes"] and "Join" in plans["creates"]


def test_member_faults_in_order(spark):
    """Lists with unknown, repeated, both kinds of members, in either order."""
    lists = [[1, 2], [], [1, 1], [9, 1], [9, 9], [1, 1, 9], [9, 1, 1], [None], [2, None, 2], [2, 2, None], [1, 9, 1]]
    v = spark.createDataFrame([(i, "add_child", m) for i, m in enumerate(lists)], "seq long, op string, members array<int>")
    known = spark.createDataFrame([(1,), (2,)], "id int")

    def fault(members):
        for i, m in enumerate(members):
            if m not in (1, 2):
                return "unknown_member"
            if m in members[:i]:
                return "duplicate_member"

    got = {r.seq: r.member_reason for r in C._member_reasons(v, known, "id").collect()}
    assert got == {i: fault(m) for i, m in enumerate(lists)}


def test_replayed_orders_meet_customers_first(spark):
    """Lines are dealt by order once: the orders' customers are joined before."""
    from logmart.plans import driver_log
    plan = driver_log._line_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    places = [re.search(rf"Join Inner, \(.*{a}#\w+ = {b}#", plan).start()
              for a, b in (("l_partkey", "p_partkey"), ("l_orderkey", "o_orderkey"), ("o_custkey", "c_custkey"))]
    assert places == sorted(places)                     # a plan is printed from its last step on


def test_a_batch_leaves_its_change_set_only(spark, seed, tmp_path):
    """The copies that a micro-batch works on are gone when its change set is written."""
    from pathlib import Path

    from logmart.session import ensure_checkpoint_dir
    from logmart.streaming.changes_stream import _create, read_latest, write_batch
    top = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    files = lambda: {p for p in top.rglob("*") if p.is_file()}
    out, b = str(tmp_path / "out"), base(spark, seed)
    _create(spark, out)
    was = files()
    write_batch(spark, out, b, log(spark, [("create_header", 201, None, {"gym_id": 1}),
                                           add(201, 3001, name="Row", parts=(1, 2), w="5"),
                                           ("delete_child", None, None, {"id": 3001}),
                                           add(201, 3002, name="Dip", parts=(1,), w="6")]), 0)
    assert files() <= was
    assert [r.sort_order for r in read_latest(spark, out, b).exercises.where("id = 3002").collect()] == [1]
