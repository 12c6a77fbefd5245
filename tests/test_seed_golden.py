"""Golden tests on the source application's seed rows (FIXTURES.md)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from logmart.operators import latest, listing, nest, rollup
from logmart.schemas import TOTAL_MEMBERS


def test_seed_counts(seed):
    assert seed["workouts"].count() == 5
    assert seed["exercises"].count() == 24
    assert seed["exercise_body_parts"].count() == 26


def test_history_newest_first(seed):
    h = rollup.history(seed["workouts"], seed["gyms"], seed["exercises"], seed["exercise_body_parts"],
                       limit=20, offset=0).collect()
    got = [(r.id, r.exercise_count, r.body_part_ids, r.full_coverage) for r in h]
    assert got == [
        (5, 7, [1, 2, 3, 4, 5, 6, 7], True),
        (4, 4, [1, 3], False),
        (3, 5, [2, 5], False),
        (2, 4, [3, 6, 7], False),
        (1, 4, [1, 4], False),
    ]
    assert [r.rank for r in h] == [1, 2, 3, 4, 5]
    assert h[0].gym_name == "Poděbrady - Staďák"


def test_history_paging_and_all(seed):
    args = (seed["workouts"], seed["gyms"], seed["exercises"], seed["exercise_body_parts"])
    page = rollup.history(*args, limit=2, offset=1).collect()
    assert [(r.rank, r.id) for r in page] == [(2, 4), (3, 3)]
    assert rollup.history(*args, limit=0).count() == 0
    every = {r.id: r.exercise_count for r in rollup.history(*args, limit=None).collect()}
    assert every == {1: 4, 2: 4, 3: 5, 4: 4, 5: 7}


def test_history_k_none_counts_dimension(seed):
    h = rollup.history(seed["workouts"], seed["gyms"], seed["exercises"], seed["exercise_body_parts"],
                       limit=None, k=None, member_dim=seed["body_parts"]).collect()
    assert {r.id for r in h if r.full_coverage} == {5}
    assert TOTAL_MEMBERS == seed["body_parts"].count()


def test_latest_per_name(seed):
    l1 = latest.latest_values(seed["exercises"], seed["workouts"]).collect()
    got = {r.name: (r.max_weight, r.workout_id) for r in l1}
    assert len(got) == 15
    assert got["Squat"] == (Decimal("90.00"), 5)
    assert got["Dips"] == (None, 2)
    assert got["Plank"] == (None, 5)
    assert got["Leg press"] == (Decimal("130.00"), 4)
    assert got["Hammer curl"] == (Decimal("12.00"), 3)


def test_search_press(spark, seed):
    l1 = latest.latest_values(seed["exercises"], seed["workouts"])
    terms = spark.createDataFrame([("press",)], "term string")
    hits = latest.search_latest(l1, terms).orderBy("rank").collect()
    assert [(r.name, r.max_weight) for r in hits] == [
        ("Bench press", Decimal("70.00")), ("Incline dumbbell press", Decimal("22.00")),
        ("Leg press", Decimal("130.00")), ("Overhead press", Decimal("42.00"))]


def test_exact_lookup(spark, seed):
    l1 = latest.latest_values(seed["exercises"], seed["workouts"])
    terms = spark.createDataFrame([("SQUAT",), ("plank",), ("x",)], "term string")
    got = {r.term: (r.name, r.max_weight, r.workout_id) for r in latest.last_value_for(l1, terms).collect()}
    assert got == {"SQUAT": ("Squat", Decimal("90.00"), 5)}


def test_active_header_none_and_older_unfinished_ignored(spark, seed):
    assert latest.active_header(seed["workouts"]).count() == 0
    w = seed["workouts"]
    older_open = w.withColumn("finished_at", F.when(F.col("id") == 1, None).otherwise(F.col("finished_at")))
    assert latest.active_header(older_open).count() == 0
    newest_open = w.withColumn("finished_at", F.when(F.col("id") == 5, None).otherwise(F.col("finished_at")))
    assert [r.id for r in latest.active_header(newest_open).collect()] == [5]


def test_nested_document(seed):
    docs = nest.header_documents(seed["workouts"], seed["gyms"], seed["exercises"], seed["exercise_body_parts"],
                                 seed["body_parts"]).where("id = 2").collect()
    assert len(docs) == 1
    ex = docs[0].exercises
    assert [e.name for e in ex] == ["Bench press", "Incline dumbbell press", "Tricep pushdown", "Dips"]
    # shoulders and chest tie on sort_order 3: id breaks the tie
    assert [(m.id, m.name) for m in ex[1].body_parts] == [(3, "shoulders"), (7, "chest")]
    assert [(m.id, m.name) for m in ex[3].body_parts] == [(7, "chest"), (6, "triceps")]
    assert docs[0].gym_name == "Poděbrady - 24"


def test_dim_listing_tie(seed):
    rows = listing.dim_listing(seed["body_parts"]).orderBy("rank").collect()
    assert [r.name for r in rows] == ["legs", "back", "shoulders", "chest", "core", "biceps", "triceps"]


def test_sibling_members_skip_edited(seed):
    s = rollup.sibling_members(seed["exercises"], seed["exercise_body_parts"]).collect()
    by_id = {r.id: (r.own_ids, r.sibling_ids) for r in s}
    # workout 2: Bench press (chest) edited; others cover chest, shoulders, triceps
    assert by_id[5] == ([7], [3, 6, 7])
    # Incline dumbbell press (chest, shoulders); Dips also covers chest
    assert by_id[6] == ([3, 7], [6, 7])


def test_coverage_grid_for_single_child(spark, seed):
    trained = seed["exercise_body_parts"].where("exercise_id IN (5, 7, 8)")
    g = rollup.coverage_grid_for(seed["body_parts"], [7, 3], trained).collect()
    assert [(r.name, r.selected, r.trained) for r in g] == [
        ("legs", False, False), ("back", False, False), ("shoulders", True, False), ("chest", True, True),
        ("core", False, False), ("biceps", False, False), ("triceps", False, True)]


def test_member_grid_shows_every_member(seed):
    grid = rollup.member_grid(seed["body_parts"], seed["exercises"], seed["exercise_body_parts"]).where("id = 6").collect()
    assert [(g.member_name, g.selected, g.trained) for g in grid[0].grid] == [
        ("legs", False, False), ("back", False, False), ("shoulders", True, False), ("chest", True, True),
        ("core", False, False), ("biceps", False, False), ("triceps", False, True)]


def test_member_grid_of_many_members(spark):
    """More than 64 members, NULL order, unknown members, repeated bridge
    rows, a child without a key and one without members."""
    import random
    rnd = random.Random(9)
    order = {m: rnd.choice([None, 1, 2, 3]) for m in range(150)}
    dim = spark.createDataFrame([(m, f"m{m}", o) for m, o in order.items()], "id int, name string, sort_order int")
    own = {i: {rnd.randrange(160) for _ in range(rnd.choice([0, 1, 5, 60]))} for i in range(60)}
    header = {i: rnd.choice([1, 1, 2, None]) for i in own}
    kids = spark.createDataFrame([(i, header[i]) for i in own] + [(None, 1)], "id long, workout_id long")
    bridge = spark.createDataFrame([(i, m) for i in own for m in own[i]] + [(i, m) for i in own for m in list(own[i])[:1]],
                                   "exercise_id long, body_part_id int")
    shown = sorted(order, key=lambda m: (order[m] is None, order[m] or 0, m))
    own[None], header[None] = set(), 1
    got = rollup.member_grid(dim, kids, bridge).collect()
    assert len(got) == len(own)
    for r in got:
        rest = set().union(*(own[i] for i in own if i != r.id and header[i] == header[r.id] is not None))
        assert [(g.member_id, g.selected, g.trained) for g in r.grid] == [(m, m in own[r.id], m in rest) for m in shown]


def test_member_grid_cells_after_the_join(seed):
    """Bit words go through the join with the children, not arrays of cells,
    and a place's words are made once, not again in the lambda of each cell."""
    grid = rollup.member_grid(seed["body_parts"], seed["exercises"], seed["exercise_body_parts"])
    plan = grid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("member_name") < plan.index("Join ") and plan.count("member_name, ") == 1
    assert plan.count("sequence(") == 1 and plan.index("sequence(") < plan.index("member_name")


def test_header_summary_minutes(seed):
    s = rollup.header_summary(seed["workouts"], seed["gyms"], seed["exercises"], seed["exercise_body_parts"],
                              seed["body_parts"], as_of="2026-01-22 12:00:00").collect()
    got = {r.id: (r.minutes, r.exercise_count, r.member_names) for r in s}
    assert got[1] == (55, 4, "legs, core")
    assert got[2] == (50, 4, "shoulders, chest, triceps")


def test_edge_rows(spark, seed):
    """Header without children, child without members, same name twice in
    one header (tie broken by child id), and case-sensitive keys."""
    import datetime as dt

    from fixtures import NOW
    from logmart import schemas as S
    w = seed["workouts"].unionByName(spark.createDataFrame(
        [(6, 2, NOW - dt.timedelta(days=1), None, None, NOW), (7, 2, NOW, NOW, None, NOW)], S.WORKOUTS))
    e = seed["exercises"].unionByName(spark.createDataFrame(
        [(30, 7, "squat", None, Decimal("20.00"), 1, NOW), (31, 7, "Squat", None, Decimal("95.00"), 2, NOW),
         (32, 7, "Squat", None, Decimal("96.00"), 2, NOW), (33, 7, "Band pull", None, None, None, NOW)],
        S.EXERCISES))
    h = {r.id: r for r in rollup.history(w, seed["gyms"], e, seed["exercise_body_parts"], limit=None).collect()}
    assert (h[6].exercise_count, h[6].body_part_ids, h[6].full_coverage) == (0, [], False)
    assert (h[7].exercise_count, h[7].body_part_ids) == (4, [])      # children without members
    l1 = {r.name: (r.max_weight, r.workout_id) for r in latest.latest_values(e, w).collect()}
    assert l1["Squat"] == (Decimal("96.00"), 7)                       # same header twice: higher child id
    assert l1["squat"] == (Decimal("20.00"), 7)                       # a separate key
    doc = nest.header_documents(w, seed["gyms"], e, seed["exercise_body_parts"], seed["body_parts"]).where(
        "id = 7").first()
    assert [x.id for x in doc.exercises] == [30, 31, 32, 33]          # NULL sort_order last
    assert all(x.body_parts == [] for x in doc.exercises)
    empty = nest.header_documents(w, seed["gyms"], e, seed["exercise_body_parts"], seed["body_parts"]).where(
        "id = 6").first()
    assert empty.exercises == []
    # the newest header (7) is finished, so the older open one (6) is not active
    assert latest.active_header(w).count() == 0


def test_history_page_skips_orphans(spark, seed):
    """Headers without a dimension row drop out before paging, also when
    they crowd the first candidates (the page widens until it is full)."""
    import datetime as dt

    from fixtures import NOW
    from logmart import schemas as S
    orphans = [(100 + i, 77, NOW + dt.timedelta(hours=i), None, None, NOW) for i in range(6)]
    w = seed["workouts"].unionByName(spark.createDataFrame(orphans, S.WORKOUTS))
    args = (w, seed["gyms"], seed["exercises"], seed["exercise_body_parts"])
    page = rollup.history(*args, limit=2, offset=1).collect()
    assert [(r.rank, r.id) for r in page] == [(2, 4), (3, 3)]
    assert [r.id for r in rollup.history(*args, limit=20).collect()] == [5, 4, 3, 2, 1]
    clean = (seed["workouts"], seed["gyms"], seed["exercises"], seed["exercise_body_parts"])
    assert [r.id for r in rollup.history(*clean, limit=3, assume_fk_integrity=True).collect()] == [5, 4, 3]


def test_sibling_members_child_without_bridge_key(spark):
    kids = spark.createDataFrame([(1, 10, None), (2, 10, 5), (3, 10, 6)], "id long, workout_id long, part long")
    bridge = spark.createDataFrame([(5, "a"), (5, "b"), (6, "b")], "part long, word string")
    got = {r.id: (r.own_ids, r.sibling_ids) for r in rollup.sibling_members(
        kids, bridge, child_bridge_key="part", bridge_child="part", bridge_member="word").collect()}
    assert got == {1: ([], ["a", "b"]), 2: (["a", "b"], ["b"]), 3: (["b"], ["a", "b"])}


def test_document_for_requested_ids(spark, seed):
    ids = spark.createDataFrame([(3,), (42,)], "id long")
    docs = nest.header_documents(seed["workouts"], seed["gyms"], seed["exercises"], seed["exercise_body_parts"],
                                 seed["body_parts"], header_ids=ids, max_ids=2).collect()
    assert [d.id for d in docs] == [3]
    assert [e.name for e in docs[0].exercises] == ["Pull-ups", "Barbell row", "Lat pulldown", "Bicep curl",
                                                    "Hammer curl"]


def test_hot_header_positions(spark, seed, monkeypatch):
    """One header holds most children: with a low hot-group threshold the
    positions come from the distributed path and equal row_number()."""
    import datetime as dt

    from pyspark.sql import Window

    from fixtures import NOW
    from logmart import schemas as S
    from logmart.operators import common
    hot = [(1000 + i, 5, f"Set {i % 17}", None, Decimal(i % 90), (i * 7) % 50 or None, NOW) for i in range(400)]
    e = seed["exercises"].unionByName(spark.createDataFrame(hot, S.EXERCISES))
    w = Window.partitionBy("workout_id").orderBy(F.col("sort_order").asc_nulls_last(), F.col("id"))
    want = {r.id: r.p for r in e.withColumn("p", F.row_number().over(w)).collect()}
    monkeypatch.setattr(common, "HOT_GROUP_ROWS", 50)
    got = {r.id: r.position for r in listing.ordered_children(e.repartition(5)).collect()}
    assert got == want
    rows = nest.header_document_rows(seed["workouts"], seed["gyms"], e, seed["exercise_body_parts"],
                                     seed["body_parts"]).collect()
    assert {r.child_id: r.position for r in rows if r.child_id is not None} == want


def test_document_json_shape(spark, seed, tmp_path):
    """The nested document written as JSON has the source API's shape,
    NULL values kept."""
    import json

    from logmart.sources import io
    docs = nest.header_documents(seed["workouts"], seed["gyms"], seed["exercises"], seed["exercise_body_parts"],
                                 seed["body_parts"]).where("id = 1")
    io.write_json(docs, str(tmp_path / "doc"))
    line = json.loads(spark.read.text(str(tmp_path / "doc")).first().value)
    assert list(line) == ["id", "started_at", "finished_at", "notes", "gym_name", "exercises"]
    assert line["notes"] is None and line["gym_name"] == "Chlumec - Bonasus"
    first = line["exercises"][0]
    assert list(first) == ["id", "name", "machine", "max_weight", "body_parts"]
    assert (first["name"], first["machine"], first["max_weight"]) == ("Squat", "Smith machine", 80.0)
    assert line["exercises"][3]["max_weight"] is None
    assert first["body_parts"] == [{"id": 1, "name": "legs"}]


def test_header_by_id_found_flag(spark, seed):
    ids = spark.createDataFrame([(2,), (9,)], "id long")
    for max_ids in (None, 2):
        got = {r.requested_id: (r.found, r.gym_name) for r in listing.header_by_id(
            seed["workouts"], seed["gyms"], ids, max_ids=max_ids).collect()}
        assert got == {2: (True, "Poděbrady - 24"), 9: (False, None)}


def test_history_distributed_page_path(spark, seed, monkeypatch):
    """The path for pages above the IN-list limit (checkpointed candidates,
    broadcast keys, semi-joined children) gives the same pages."""
    import datetime as dt

    from fixtures import NOW
    from logmart import schemas as S
    monkeypatch.setattr(rollup, "PUSHDOWN_IN_LIMIT", 0)
    orphans = [(100 + i, 77, NOW + dt.timedelta(hours=i), None, None, NOW) for i in range(6)]
    w = seed["workouts"].unionByName(spark.createDataFrame(orphans, S.WORKOUTS))
    args = (w, seed["gyms"], seed["exercises"], seed["exercise_body_parts"])
    page = rollup.history(*args, limit=2, offset=1).collect()
    assert [(r.rank, r.id, r.exercise_count) for r in page] == [(2, 4, 4), (3, 3, 5)]
    assert [r.id for r in rollup.history(*args, limit=20).collect()] == [5, 4, 3, 2, 1]


def test_readme_usage(spark, seed, tmp_path):
    """The README's usage example, on the seed written as Parquet."""
    import json

    from logmart.operators import changes
    from logmart.sources.io import read_changes, read_tables, write_json
    for name in ("projects", "gyms", "body_parts", "workouts", "exercises", "exercise_body_parts"):
        seed[name].write.parquet(str(tmp_path / f"{name}.parquet"))
    t = read_tables(spark, str(tmp_path))
    page = rollup.history(t["workouts"], t["gyms"], t["exercises"], t["exercise_body_parts"], limit=50, offset=0)
    assert [r.id for r in page.collect()] == [5, 4, 3, 2, 1]
    l1 = latest.latest_values(t["exercises"], t["workouts"])
    assert latest.search_latest(l1, spark.createDataFrame([("press",)], "term string")).count() == 4
    doc = nest.header_documents(t["workouts"], t["gyms"], t["exercises"], t["exercise_body_parts"],
                                t["body_parts"], header_ids=spark.createDataFrame([(5,)], "id long"), max_ids=1)
    write_json(doc, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["id"] == 5
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text(json.dumps(
        {"seq": 1, "ts": "2026-01-22T12:00:00", "op": "delete_child", "payload": json.dumps({"id": 24})}) + "\n")
    tables = changes.Tables(t["gyms"], t["body_parts"], t["workouts"], t["exercises"], t["exercise_body_parts"])
    result = changes.apply_changes(tables, read_changes(spark, str(tmp_path / "log")))
    assert result["exercises"].count() == 23 and result["outcomes"].first().outcome == "ok"


def test_hot_rows_argument(spark, seed):
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("workout_id").orderBy("sort_order", "id")
    want = {r.id: r.p for r in seed["exercises"].withColumn("p", F.row_number().over(w)).collect()}
    got = {r.id: r.position for r in listing.ordered_children(seed["exercises"], hot_rows=3).collect()}
    assert got == want
    rows = nest.header_document_rows(seed["workouts"], seed["gyms"], seed["exercises"], seed["exercise_body_parts"],
                                     seed["body_parts"], hot_rows=3).collect()
    assert {r.child_id: r.position for r in rows} == want


def test_page_of_orphans_stays_bounded(spark, monkeypatch):
    """Orphans on top of the page: both page forms find the rows below them."""
    from logmart.operators import rollup
    h = spark.range(500).selectExpr("id", "if(id < 490, id % 3, -1) gym_id")
    dims = spark.createDataFrame([(1,), (2,)], "gid long")
    want = [r for r in range(499, -1, -1) if r < 490 and r % 3][2:7]
    for limit in (10_000, 0):
        monkeypatch.setattr(rollup, "PUSHDOWN_IN_LIMIT", limit)
        got = rollup._verified_page(h, dims, [F.col("id").desc()], 5, 2, "gym_id", "gid", True)
        assert [r.id for r in got.orderBy(F.col("id").desc()).collect()] == want
