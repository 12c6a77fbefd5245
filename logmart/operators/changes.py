"""Change-log application: the write endpoints of the source application
re-aimed as table jobs.

Change row: ``seq, ts, op, header_id, child_id, payload`` (JSON request
body). ``header_id`` / ``child_id`` carry the ids a create was assigned
(the id sequence is the source's job); other ops name their target in the
payload (``id``, ``workout_id``), coerced the PHP way.

Ops: ``create_header`` {gym_id}, ``finish_header`` {id}, ``delete_header``
{id}, ``add_child`` {workout_id, name, machine, max_weight,
body_part_ids}, ``update_child`` {id, name, machine, max_weight,
body_part_ids}, ``delete_child`` {id}.

Set-based pieces (usable alone on append-only logs):
C1 validate, C2 append_headers, C3 append_children, C4 append_bridge,
C5 upsert_children, C6 cascade_delete, C7 finish_headers,
C9 fk_to_bridge, C10 keyed_update, C11 append_rows.

C8 apply_changes handles a mixed, ordered log. Ordinals depend on history
(children 1,2,3; delete 3; add -> 3; delete 2; add -> 4) and the outcome
of an op depends on earlier ops of the same header, yet nearly all of it
is set-based:

* validation and every stateless reject (missing fields, weight out of
  range, duplicate or unknown members, unknown gym) are column
  expressions and joins;
* whether a header or child is there before a request follows from the
  last request of few kinds before it: running values over one timeline
  per header and one per child id (``group_scan``), on narrow rows;
* ordinals count up from a carried maximum in every part of a header's
  log in which no child delete comes before an add;
* Python folds get only the rest, as ids and operations: headers with a
  delete before an add (``_Ordinals``), and child ids that the log puts
  under several headers (``_Ownership``). A log without them has a plan
  without Python;
* final tables are assembled from the verdicts with anti joins and
  unions (C6, C7, C5 logic).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmart import schemas as S
from logmart.functions.coerce import empty_to_null, php_int, php_trim, weight_value
from logmart.operators.common import BROADCAST_ROW_LIMIT, fits, group_rank, group_scan, hot_groups, null_safe_join
from logmart.session import ensure_checkpoint_dir, shuffle_partitions, stored
from logmart.sources.io import parse_payload

# Operation names and outcome texts.
CREATE_HEADER, FINISH_HEADER, DELETE_HEADER = "create_header", "finish_header", "delete_header"
ADD_CHILD, UPDATE_CHILD, DELETE_CHILD = "add_child", "update_child", "delete_child"
OPS = (CREATE_HEADER, FINISH_HEADER, DELETE_HEADER, ADD_CHILD, UPDATE_CHILD, DELETE_CHILD)
OK, NOOP = "ok", "noop"
HEADER_OPS = (CREATE_HEADER, FINISH_HEADER, DELETE_HEADER, ADD_CHILD)
CHILD_OPS = (UPDATE_CHILD, DELETE_CHILD)


def rejected(reason: str) -> str:
    return f"rejected:{reason}"


# ------------------------------------------------------------------ C1
def validate(changes: DataFrame, gyms: DataFrame, members: DataFrame, *, gym_id: str = "id",
             member_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Parse and coerce every request; returns ``(good, rejects)``.
    See ``validated`` for the columns."""
    return split_validated(validated(changes, gyms, members, gym_id=gym_id, member_id=member_id))


def split_validated(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = v.where(F.col("_reason").isNull()).drop("_reason")
    bad_rows = v.where(F.col("_reason").isNotNull()).select(
        "seq", "ts", "op", F.concat(F.lit("rejected:"), F.col("_reason")).alias("outcome"))
    return good, bad_rows


def validated(changes: DataFrame, gyms: DataFrame, members: DataFrame, *, gym_id: str = "id",
              member_id: str = "id") -> DataFrame:
    """Every request parsed and coerced, with ``_reason`` (NULL = valid).

    ``good`` columns: seq, ts, op, h (target header; for child updates and
    deletes resolved later), cid, gym_id, name, machine, max_weight,
    members (array<int>), member_reason (first failing member: duplicate or
    unknown id, checked after the header exists, as the insert order
    does). ``rejects``: seq, ts, op, outcome.
    """
    return _gyms_checked(_requests(changes, members, member_id), gyms, gym_id)


def _requests(changes: DataFrame, members: DataFrame, member_id: str = "id") -> DataFrame:
    """``validated`` but for the gyms of creates: row by row, so the log
    isn't moved."""
    p = changes.withColumn("_p", parse_payload("payload"))
    pl = lambda f: F.col(f"_p.{f}")
    is_create = F.col("op") == CREATE_HEADER
    is_add = F.col("op") == ADD_CHILD
    members_arr = F.transform(F.coalesce(pl("body_part_ids"), F.array().cast("array<string>")),
                              lambda e: php_int(e).try_cast("int"))  # out of range: NULL, in no dimension
    # each op reads one id of its body
    named = F.when(is_create, pl("gym_id")).when(is_add, pl("workout_id")).otherwise(pl("id"))
    p = p.withColumn("_n", php_int(named))
    v = p.select(
        "seq", "ts", "op",
        F.when(is_create, F.col("header_id").cast("long"))
         .when(F.col("op").isin(ADD_CHILD, FINISH_HEADER, DELETE_HEADER), F.col("_n")).alias("h"),
        F.when(is_add, F.col("child_id").cast("long"))
         .when(F.col("op").isin(*CHILD_OPS), F.col("_n")).alias("cid"),
        F.when(is_create, F.col("_n")).alias("gym_id"),
        php_trim(F.coalesce(pl("name"), F.lit(""))).alias("name"),
        empty_to_null(pl("machine")).alias("machine"),
        pl("max_weight").alias("_wraw"),
        weight_value(pl("max_weight")).alias("max_weight"),
        members_arr.alias("members"),
    ).withColumn("_wbad", F.col("_wraw").isNotNull() & (F.col("_wraw") != "") & F.col("max_weight").isNull()
    ).withColumn("_noname", F.col("name").isin("", "0")).drop("_wraw")
    v = _member_reasons(v, members, member_id)
    needs = F.col("op").isin(ADD_CHILD, UPDATE_CHILD)
    missing = (F.when(is_add, F.col("h") == 0).otherwise(F.col("cid") == 0)
               | (F.size("members") == 0) | F.col("_noname"))
    reason = (F.when(~F.col("op").isin(*OPS) | F.col("op").isNull(), F.lit("unknown_op"))
              # creates must carry the id the source assigned
              .when((is_create & F.col("h").isNull()) | (is_add & F.col("cid").isNull()), F.lit("missing_id"))
              .when(is_create & (F.col("gym_id") == 0), F.lit("missing_gym"))
              .when(F.col("op").isin(FINISH_HEADER, DELETE_HEADER) & (F.col("h") == 0), F.lit("missing_id"))
              .when((F.col("op") == DELETE_CHILD) & (F.col("cid") == 0), F.lit("missing_id"))
              .when(needs & missing, F.lit("missing_fields"))
              .when(needs & F.col("_wbad"), F.lit("weight_out_of_range")))
    return v.withColumn("_reason", reason).drop("_wbad", "_noname")


def _admitted() -> Column:
    """Creates that nothing but their gym can refuse."""
    return (F.col("op") == CREATE_HEADER) & F.col("_reason").isNull()


def _gyms_checked(v: DataFrame, gyms: DataFrame, gym_id: str = "id") -> DataFrame:
    """Creates of unknown gyms (FK) get their reason. That is stateless: the
    dimension does not change in the log. Other rows join on (false, seq):
    they never match and spread evenly instead of piling up on one NULL/0 key
    in a shuffle."""
    g = gyms.select(F.lit(True).alias("_gc"), F.col(gym_id).cast("long").alias("_gk"),
                    F.lit(True).alias("_g")).distinct()
    v = v.withColumns({"_gc": _admitted(), "_gk": F.when(_admitted(), F.col("gym_id")).otherwise(F.col("seq"))})
    v = v.join(g, ["_gc", "_gk"], "left")
    reason = F.when(F.col("_gc") & F.col("_g").isNull(), F.lit("unknown_gym")).otherwise(F.col("_reason"))
    return v.withColumn("_reason", reason).drop("_gc", "_gk", "_g")


# Member dimensions up to this many rows are checked inline against one
# array (scalar subquery, computed once); larger ones through a join.
INLINE_MEMBER_LIMIT = 1000


def _member_reasons(v: DataFrame, members: DataFrame, member_id: str) -> DataFrame:
    """``member_reason`` of each add/update: the first member, in request
    order, that is unknown or repeats an earlier one (the first failing
    insert of the source's loop)."""
    ids = members.select(F.col(member_id).cast("int").alias("_m")).distinct()
    needs = F.col("op").isin(ADD_CHILD, UPDATE_CHILD)
    if fits(ids, INLINE_MEMBER_LIMIT):
        # one-row scalar subquery, evaluated once; lambdas cannot hold it
        v = v.withColumn("_known", ids.agg(F.collect_set("_m")).scalar())
        per_pos = F.transform("members", lambda m, i: F.when(
            ~F.coalesce(F.array_contains("_known", m), F.lit(False)), F.lit("unknown_member"))
                              .when(F.array_position("members", m) < i + 1, F.lit("duplicate_member")))
        first = F.get(F.filter(per_pos, lambda x: x.isNotNull()), 0)
        # lists with faults of both kinds are walked, others need no lambda
        strange = F.size(F.array_except("members", "_known")) > 0
        twice = F.size(F.array_distinct("members")) < F.size("members")
        first = F.when(strange & twice, first).when(strange, F.lit("unknown_member")).when(twice, F.lit("duplicate_member"))
        return v.withColumn("member_reason", F.when(needs, first)).drop("_known")
    # equal lists have equal reasons: each distinct list is checked once
    ex = v.where(needs).select("members").distinct().select("members", F.posexplode("members").alias("_pos", "_m"))
    ex = ex.join(ids.withColumn("_known", F.lit(True)), "_m", "left")
    bad = ex.where(F.col("_known").isNull() | (F.array_position("members", F.col("_m")) < F.col("_pos") + 1))
    bad = bad.groupBy("members").agg(F.min_by(
        F.when(F.col("_known").isNull(), F.lit("unknown_member")).otherwise(F.lit("duplicate_member")),
        F.col("_pos")).alias("_bad"))
    return v.join(bad, "members", "left").withColumn("member_reason", F.when(needs, F.col("_bad"))).drop("_bad")


# ------------------------------------------------------------------ C2..C7, C9..C11
def append_headers(headers: DataFrame, creates: DataFrame) -> DataFrame:
    """New headers from valid creates; ``started_at`` is the change's
    ``ts`` (the source uses ``now()``), ``finished_at`` NULL."""
    new = creates.select(F.col("h").cast("long").alias("id"), F.col("gym_id").cast("long").alias("gym_id"),
                         F.col("ts").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
                         F.lit(None).cast("string").alias("notes"), F.col("ts").alias("created_at"))
    return headers.unionByName(new)


def append_children(children: DataFrame, adds: DataFrame) -> DataFrame:
    """C3 for append-only logs: next ordinal per header =
    ``COALESCE(MAX(sort_order), 0)`` of the existing children plus the
    add's rank in ``seq`` order. (Interleaved deletes need C8.) The children
    themselves are never sorted for a join: those of other headers go by a
    broadcast of bounded size, or all are first reduced to a row per header."""
    held = children.select(F.col("workout_id").alias("h"), "sort_order")
    hs = adds.select("h").distinct()
    if fits(hs, BROADCAST_ROW_LIMIT):   # the other headers' children are left out where they are read
        held = held.join(F.broadcast(hs), "h", "left_semi")
    base_max = held.groupBy("h").agg(F.coalesce(F.max("sort_order"), F.lit(0)).alias("_mx"))
    w = Window.partitionBy("h").orderBy("seq")
    a = adds.join(base_max, "h", "left").withColumn(
        "sort_order", (F.coalesce(F.col("_mx"), F.lit(0)) + F.row_number().over(w)).cast("int"))
    return children.unionByName(_child_rows(a))


def _child_rows(a: DataFrame) -> DataFrame:
    return a.select(F.col("cid").cast("long").alias("id"), F.col("h").cast("long").alias("workout_id"), "name",
                    "machine", "max_weight", F.col("sort_order").cast("int"), F.col("ts").alias("created_at"))


def append_bridge(bridge: DataFrame, rows: DataFrame) -> DataFrame:
    """C4: one bridge row per member id of each valid add/update."""
    new = rows.select(F.col("cid").cast("long").alias("exercise_id"),
                      F.explode(F.col("members").cast("array<int>")).alias("body_part_id"))
    return bridge.unionByName(new)


def upsert_children(children: DataFrame, bridge: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full replace of name, machine, max_weight (ordinal and header
    unchanged) by the last update per child, and replacement of its
    member set. ``updates`` must already be verdicts (existing children)."""
    last = updates.groupBy("cid").agg(F.max_by(F.struct("name", "machine", "max_weight", "members"),
                                               F.col("seq")).alias("_u"))
    j = children.join(last, F.col("id") == F.col("cid"), "left")
    out = j.select("id", "workout_id",
                   *[F.when(F.col("cid").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c)
                     for c in ("name", "machine", "max_weight")],
                   "sort_order", "created_at")
    kept = bridge.join(last.select(F.col("cid").alias("exercise_id")), "exercise_id", "left_anti")
    new = last.select(F.col("cid").cast("long").alias("exercise_id"),
                      F.explode(F.col("_u.members").cast("array<int>")).alias("body_part_id"))
    return out, kept.unionByName(new)


def cascade_delete(headers: DataFrame, children: DataFrame, bridge: DataFrame,
                   header_ids: DataFrame | None = None, child_ids: DataFrame | None = None
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete headers and children (column ``id``) with ``ON
    DELETE CASCADE``: header -> children -> bridge. Missing ids are
    silently fine. Every step is an anti join against the (small) set of
    removed ids, so the big tables are filtered, not joined to each
    other."""
    removed = []
    if header_ids is not None:
        hid = header_ids.select(F.col("id").cast(headers.schema["id"].dataType).alias("id")).distinct()
        headers = headers.join(hid, "id", "left_anti")
        removed.append(children.join(hid.select(F.col("id").alias("workout_id")), "workout_id", "left_semi")
                       .select("id"))
    if child_ids is not None:
        removed.append(child_ids.select(F.col("id").cast(children.schema["id"].dataType).alias("id")))
    if removed:
        gone = removed[0]
        for r in removed[1:]:
            gone = gone.unionByName(r)
        gone = gone.distinct()
        children = children.join(gone, "id", "left_anti")
        bridge = bridge.join(gone.select(F.col("id").alias("exercise_id")), "exercise_id", "left_anti")
    return headers, children, bridge


def finish_headers(headers: DataFrame, finishes: DataFrame) -> DataFrame:
    """``finished_at = ts`` of the last finish per header (no guard:
    finishing again overwrites); missing ids change nothing."""
    last = finishes.groupBy(F.col("h").alias("_h")).agg(F.max_by("ts", "seq").alias("_fin"))
    j = headers.join(last, F.col("id") == F.col("_h"), "left")
    return j.withColumn("finished_at", F.coalesce(F.col("_fin"), F.col("finished_at"))).drop("_h", "_fin")


def fk_to_bridge(children: DataFrame, key: str = "id", fk: str = "body_part_id",
                 out: tuple[str, str] = ("exercise_id", "body_part_id")) -> tuple[DataFrame, DataFrame]:
    """Move a single FK column into a bridge table (NULLs skipped) and
    drop the column."""
    bridge = children.where(F.col(fk).isNotNull()).select(F.col(key).alias(out[0]), F.col(fk).alias(out[1]))
    return children.drop(fk), bridge


def keyed_update(df: DataFrame, key: str | list[str], updates: DataFrame) -> DataFrame:
    """``UPDATE df SET cols = updates.cols WHERE key matches``; a
    ``matched`` flag (not ``coalesce``) so an update can set NULL.
    ``updates`` holds the key and the columns to set."""
    k = [key] if isinstance(key, str) else list(key)
    set_cols = [c for c in updates.columns if c not in k]
    u = updates.select(*k, *[F.col(c).alias(f"_new_{c}") for c in set_cols]).withColumn("_matched", F.lit(True))
    j = df.join(u, k, "left")
    out = j.select(*[F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
                     if c in set_cols else F.col(c) for c in df.columns])
    return out


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """C11: ``INSERT`` of reference rows; missing columns become NULL."""
    return df.unionByName(rows, allowMissingColumns=True)


# ------------------------------------------------------------------ C8
@dataclass
class Tables:
    gyms: DataFrame
    body_parts: DataFrame
    workouts: DataFrame
    exercises: DataFrame
    exercise_body_parts: DataFrame


# rows of the tables before the log, in the timelines of headers and children
BEFORE = "before"
EVENT = ("rid", "seq", "ts", "op", "h", "cid", "member_reason")
AT = ("seq", "rid")                # the order of requests


def _order(descending: bool = False) -> list:
    return [F.desc_nulls_last(c) if descending else F.asc_nulls_first(c) for c in AT]


def _blank(df: DataFrame, like: DataFrame, **given) -> DataFrame:
    """Rows of ``df`` with the columns of ``like``: those given, those that
    ``df`` has, else NULL."""
    kinds = {f.name: f.dataType for f in like.schema}
    return df.select(*[(given[c] if c in given else F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c)
                       for c, k in kinds.items()])


class _Ownership:
    """Who holds one child id that the log puts under several headers: the
    header of the last accepted add, until the child's or that header's next
    delete. Fed in order, carried across batches."""

    def __init__(self):
        self.cid = self.owner = None

    def apply(self, cid, op, able, h, ep, at, until):
        if cid != self.cid:
            self.cid, self.owner = cid, None
        alive = self.owner is not None and at < self.owner[2]
        holder = self.owner if alive and op != ADD_CHILD else (h, ep)
        if op == DELETE_CHILD:
            self.owner = None
        elif not alive and (op == BEFORE or (op == ADD_CHILD and able)):
            self.owner = h, ep, until
        return alive, holder[0], holder[1]


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state, first, last = _Ownership(), (-(1 << 63), -1), ((1 << 63) - 1, 1 << 62)
    long = lambda x: None if pd.isna(x) else int(x)
    at = lambda seq, rid: (first[0] if pd.isna(seq) else int(seq), int(rid))
    for pdf in batches:
        rows = [state.apply(cid, op, able, long(h), long(ep), first if op == BEFORE else at(seq, rid),
                            last if pd.isna(n_rid) else at(n_seq, n_rid))
                for cid, op, able, h, ep, seq, rid, n_seq, n_rid in zip(*(pdf[c].tolist() for c in (
                    "cid", "op", "able", "h", "ep", "seq", "rid", "next_seq", "next_rid")))]
        out = pdf[[c for c in pdf.columns if c not in ("able", "next_seq", "next_rid")]].copy()
        out["alive"] = [r[0] for r in rows]
        out["h"], out["ep"] = (pd.array([r[i] for r in rows], dtype="Int64") for i in (1, 2))
        yield out[(out["op"] != BEFORE).to_numpy()]


class _Ordinals:
    """Ordinals of one header in which deletes come before adds: the largest
    of the children that the log doesn't name (``rest``) and of a heap from
    which dead children are dropped when they come up."""

    def __init__(self):
        self.key = None

    def apply(self, key, op, cid, ordinal):
        if key != self.key:
            self.key, self.rest, self.heap, self.alive = key, 0, [], {}
        if op == BEFORE and cid is None:
            self.rest = ordinal or 0
        elif op == DELETE_CHILD:
            self.alive.pop(cid, None)
        else:
            while self.heap and self.alive.get(self.heap[0][1]) != -self.heap[0][0]:
                heapq.heappop(self.heap)
            if op == ADD_CHILD:
                ordinal = max(self.rest, -self.heap[0][0] if self.heap else 0) + 1
            if ordinal is not None:
                self.alive[cid] = ordinal
                heapq.heappush(self.heap, (-ordinal, cid))
        return ordinal


def _count_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state = _Ordinals()
    long = lambda x: None if pd.isna(x) else int(x)
    for pdf in batches:
        got = [state.apply((h, long(ep)), op, long(cid), long(n)) for h, ep, op, cid, n in
               zip(*(pdf[c].tolist() for c in ("h", "ep", "op", "cid", "sort_order")))]
        out = pdf[["rid"]].assign(sort_order=pd.array(got, dtype="Int32"))
        yield out[(pdf["op"] == ADD_CHILD).to_numpy()]


def apply_changes(t: Tables, changes: DataFrame, partitions: int | None = None) -> dict[str, DataFrame]:
    """Apply a mixed, ordered change log. Returns the new
    ``workouts``, ``exercises``, ``exercise_body_parts``, ``outcomes``
    (seq, ts, op, outcome: ok / noop / rejected:<reason>) and the ids of the
    rows that may have changed (``touched_workouts``, ``touched_exercises``).

    An id may come back after its row is deleted, also under another header:
    the tables hold what the last accepted requests left, in ``seq`` order;
    requests of one ``seq`` follow each other in the order of the log's rows.
    """
    ensure_checkpoint_dir(changes.sparkSession)
    n = partitions or shuffle_partitions(changes.sparkSession)
    # validation reads the log once; every later branch reads columns of this
    # copy. Only creates meet the gyms, so the log isn't shuffled for them
    v = stored(_requests(changes, t.body_parts).withColumn("rid", F.monotonically_increasing_id()), "changes")
    total = v.count()                                   # from the files' footers
    creates = stored(_gyms_checked(v.where(_admitted()), t.gyms), "creates")
    v = v.where(~_admitted()).unionByName(creates)
    good, rejects = split_validated(v)
    events = good.select(*EVENT)
    # of the base children only those that the log names matter: semi-join
    # them first so the base table is filtered, never shuffled as a whole
    named = events.where(F.col("op").isin(ADD_CHILD, *CHILD_OPS)).select("cid").distinct()
    base_children = t.exercises.select(F.col("id").cast("long").alias("cid"),
                                       F.col("workout_id").cast("long").alias("h"), F.col("sort_order").cast("int"))
    base_named = stored(base_children.join(named, "cid", "left_semi"), "named")

    judged = stored(_judge(t, events, base_named, n, total), "verdicts")
    outcomes = judged.select("seq", "ts", "op", "outcome").unionByName(rejects)
    ok = judged.where(F.col("outcome") == OK)
    ordinals = _next_ordinals(ok, base_children, base_named, n, total)
    fields = good.drop("seq", "ts", "op", "h", "cid", "member_reason").join(ok.drop("outcome"), "rid")
    workouts, exercises, bridge = _assemble(t, fields, ordinals)
    of = lambda *ops: ok.where(F.col("op").isin(*ops))
    under = t.exercises.join(of(DELETE_HEADER).select(F.col("h").alias("workout_id")), "workout_id", "left_semi")
    return {"workouts": workouts, "exercises": exercises, "exercise_body_parts": bridge, "outcomes": outcomes,
            "touched_workouts": of(CREATE_HEADER, FINISH_HEADER, DELETE_HEADER).select(F.col("h").alias("id")).distinct(),
            "touched_exercises": of(ADD_CHILD, *CHILD_OPS).select(F.col("cid").alias("id")).unionByName(
                under.select(F.col("id").cast("long").alias("id"))).distinct()}


def _judge(t: Tables, events: DataFrame, base_named: DataFrame, n: int, total: int
           ) -> DataFrame:
    """Verdict of every valid request, as running values over two timelines
    (no request waits for another one's verdict):

    * a header is there if the last create or delete request before, or the
      table, says so, whatever became of that request. An add also gets the
      header's last delete request before (``ep``) and its next one (``next``);
    * a child is there if the last add that its header and members admit came
      after the child's last delete, and that add's ``next`` is yet to come.

    Ids that the log puts under several headers are followed one by one.
    Columns: rid, seq, ts, op, h, cid, ep, outcome; a child request has its
    child's header.
    """
    is_ = lambda *ops: F.col("op").isin(*ops)
    child_ops = events.where(is_(*CHILD_OPS))
    on_header = events.where(~is_(*CHILD_OPS))
    placed = on_header.where(is_(ADD_CHILD)).select("cid", "h").unionByName(base_named.select("cid", "h"))
    shared = placed.groupBy("cid").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("cid")
    moving = not shared.isEmpty()

    touched = on_header.select("h").unionByName(base_named.select("h")).distinct()
    headers = t.workouts.select(F.col("id").cast("long").alias("h")).join(touched, "h", "left_semi")
    rows = (on_header.unionByName(_blank(headers, events, op=F.lit(BEFORE)))
            .unionByName(_blank(base_named, events, op=F.lit(BEFORE))))
    hot = hot_groups(on_header, "h", total=total)
    gone = is_(DELETE_HEADER)
    rows = group_scan(rows, "h", _order(), {
        "state": F.when(is_(CREATE_HEADER, DELETE_HEADER) | (is_(BEFORE) & F.col("cid").isNull()), F.col("op")),
        "ep": F.when(gone, F.col("rid"))}, hot)
    rows = group_scan(rows, "h", _order(descending=True), {"next": F.when(gone, F.struct(*AT))}, hot)
    rows = rows.where(~is_(BEFORE) | F.col("cid").isNotNull()).withColumns({
        "exists": is_(BEFORE) | F.coalesce(F.col("state") != DELETE_HEADER, F.lit(False)),
        # header requests pass through the children's timeline, each as a group of its own
        "alone": F.when(is_(CREATE_HEADER, FINISH_HEADER, DELETE_HEADER), F.col("rid"))}).drop("state")
    rows = rows.unionByName(_blank(child_ops, rows))
    able = F.col("exists") & F.col("member_reason").isNull()
    if moving:
        rows, apart = rows.join(shared, "cid", "left_anti"), rows.join(shared, "cid", "left_semi")
    cid_sizes = events.where("cid is not null").select("cid", F.lit(None).cast("long").alias("alone"))
    judged = group_scan(rows, ["cid", "alone"], _order(), {
        "was": F.when(is_(BEFORE, DELETE_CHILD) | (is_(ADD_CHILD) & able),
                      F.struct((~is_(DELETE_CHILD)).alias("there"), "h", "ep", "next"))}, hot_groups(cid_sizes, ["cid", "alone"], total=total))
    alive = F.coalesce(F.col("was.there") & (F.col("was.next").isNull() | (F.struct(*AT) < F.col("was.next"))), F.lit(False))
    judged = judged.where(~is_(BEFORE)).withColumn("alive", alive).withColumns({
        c: F.when(is_(*CHILD_OPS), F.col(f"was.{c}")).otherwise(F.col(c)) for c in ("h", "ep")}).drop("was", "alone", "next")
    if moving:
        apart = apart.withColumns({"able": able, "next_seq": F.col("next.seq"), "next_rid": F.col("next.rid")}).drop("next", "alone")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in judged.schema)
        apart = apart.select(*[c for c in judged.columns if c != "alive"], "able", "next_seq", "next_rid")
        judged = judged.unionByName(apart.repartition(n, "cid").sortWithinPartitions("cid", *_order()).mapInPandas(_own, schema))
    no = lambda reason: F.lit(rejected(reason))
    member = F.when(F.col("member_reason").isNotNull(), F.concat(F.lit("rejected:"), F.col("member_reason")))
    verdict = (F.when(is_(CREATE_HEADER), F.when(F.col("exists"), no("duplicate_id")))
               .when(is_(FINISH_HEADER, DELETE_HEADER), F.when(~F.col("exists"), F.lit(NOOP)))
               .when(is_(ADD_CHILD), F.coalesce(F.when(~F.col("exists"), no("unknown_header")), member,
                                                F.when(F.col("alive"), no("duplicate_id"))))
               .when(is_(UPDATE_CHILD), F.coalesce(F.when(~F.col("alive"), no("not_found")), member))
               .when(is_(DELETE_CHILD), F.when(~F.col("alive"), F.lit(NOOP))))
    return judged.select("rid", "seq", "ts", "op", "h", "cid", "ep", F.coalesce(verdict, F.lit(OK)).alias("outcome"))


def _next_ordinals(ok: DataFrame, base_children: DataFrame, base_named: DataFrame, n: int, total: int) -> DataFrame:
    """(rid, sort_order) of the accepted adds. A header's log is cut at its
    deletes (``ep``). Where no child delete comes before an add, ordinals
    count up from the carried maximum: the largest of the table's children
    before the first cut, else 0. Only the other parts, in which the maximum
    falls when the last child goes, are folded, by ids and operations."""
    of = lambda op: F.when(F.col("op") == op, F.struct(*AT))
    moves = ok.where(F.col("op").isin(ADD_CHILD, DELETE_CHILD)).select(*AT, "op", "h", "cid", "ep")
    mixed = moves.groupBy("h", "ep").agg(F.min(of(DELETE_CHILD)).alias("d"), F.max(of(ADD_CHILD)).alias("a")).where(
        F.col("d") < F.col("a")).select("h", "ep")
    adds = moves.where(F.col("op") == ADD_CHILD)
    folds = not mixed.isEmpty()
    if folds:
        mixed = stored(mixed, "mixed")
        adds = null_safe_join(adds, mixed, ["h", "ep"], "left_anti")
    first = adds.where(F.col("ep").isNull()).select("h").distinct()
    top = base_children.join(first, "h", "left_semi").groupBy("h").agg(F.max("sort_order").alias("top"))
    ranked = group_rank(adds, ["h", "ep"], _order(), "n", total=total).join(top, "h", "left")
    carried = F.when(F.col("ep").isNull(), F.coalesce("top", F.lit(0))).otherwise(0)
    out = ranked.select("rid", (carried + F.col("n")).cast("int").alias("sort_order"))
    if not folds:
        return out
    like = moves.withColumn("sort_order", F.lit(None).cast("int"))
    early = mixed.where(F.col("ep").isNull()).select("h")
    rest = (base_children.join(early, "h", "left_semi").join(base_named.select("cid"), "cid", "left_anti")
            .groupBy("h").agg(F.max("sort_order").alias("sort_order")))
    rows = (null_safe_join(like, mixed, ["h", "ep"], "left_semi")
            .unionByName(_blank(rest, like, op=F.lit(BEFORE)))
            .unionByName(_blank(base_named.join(early, "h", "left_semi"), like, op=F.lit(BEFORE))))
    return out.unionByName(
        rows.repartition(n, "h", "ep").sortWithinPartitions("h", "ep", *_order(), F.asc_nulls_first("cid"))
        .mapInPandas(_count_up, "rid long, sort_order int"))


def _assemble(t: Tables, ok: DataFrame, ordinals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after the accepted requests. A row of the log is there if
    its last add came after the last delete of it and of its header; an
    update or finish counts if it came after that add. Base rows are there if
    the log never deleted them (an id that was added again had been)."""
    at = F.struct(*AT)
    of = lambda op: ok.where(F.col("op") == op)
    after = lambda a, b: F.col(b).isNull() | (F.col(a) > F.col(b))
    gone_h = of(DELETE_HEADER).groupBy("h").agg(F.max(at).alias("_hd"))
    gone_c = of(DELETE_CHILD).groupBy("cid").agg(F.max(at).alias("_cd"))

    made = of(CREATE_HEADER).groupBy("h").agg(F.max_by(F.struct("gym_id", "ts"), at).alias("_r"), F.max(at).alias("_made"))
    there = made.join(gone_h, "h", "left").where(after("_made", "_hd"))
    finishes = of(FINISH_HEADER).withColumn("seq", at).join(made.select("h", "_made"), "h", "left").where(
        after("seq", "_made"))
    added = of(ADD_CHILD).groupBy("cid").agg(
        F.max_by(F.struct("rid", "h", "ts", "name", "machine", "max_weight", "members"), at).alias("_r"),
        F.max(at).alias("_added"))
    live = added.select("cid", "_added", "_r.*").join(gone_c, "cid", "left").join(gone_h, "h", "left").where(
        after("_added", "_cd") & after("_added", "_hd"))
    updates = of(UPDATE_CHILD).withColumn("seq", at).join(added.select("cid", "_added"), "cid", "left").where(
        after("seq", "_added"))
    removed = gone_c.select(F.col("cid").alias("id")).unionByName(added.select(F.col("cid").alias("id")))

    workouts, exercises, bridge = cascade_delete(t.workouts, t.exercises, t.exercise_body_parts,
                                                 gone_h.select(F.col("h").alias("id")), removed)
    workouts = finish_headers(append_headers(workouts, there.select("h", "_r.*")), finishes)
    exercises, bridge = upsert_children(exercises.unionByName(_child_rows(live.join(ordinals, "rid"))),
                                        append_bridge(bridge, live), updates)
    # an update of a child that is gone by now left members behind
    gone_now = gone_c.select("cid").unionByName(added.select("cid")).unionByName(
        updates.join(gone_h, "h").select("cid")).distinct().join(live.select("cid"), "cid", "left_anti")
    bridge = bridge.join(gone_now.select(F.col("cid").alias("exercise_id")), "exercise_id", "left_anti")
    return workouts, exercises, bridge


def empty_tables(spark, gyms: DataFrame, body_parts: DataFrame) -> Tables:
    e = lambda s: spark.createDataFrame([], s).limit(0)  # noqa: E731  (planned as empty: no task reads them)
    return Tables(gyms, body_parts, e(S.WORKOUTS), e(S.EXERCISES), e(S.EXERCISE_BODY_PARTS))

