"""Header rollups over children and the child-member bridge.

A1 child_count, A2 member_set, A3 next_ordinal, A4 history,
A5 full_coverage, A6 sibling_members, A7 coverage_grid, A8 header_summary.

Scale notes
-----------
* Every aggregation is keyed by the header (or header, member) and gets a
  map-side partial aggregate, so a header holding a third of all children
  is reduced to one row per task (count) or one row per distinct member
  per task (member sets) before anything is shuffled.
* Member arrays are bounded by the member dimension, never by the number
  of children: ``(header, member)`` pairs are made distinct first.
* ``history`` pages first: the ``offset + limit`` newest headers come from
  a per-partition top-k (``TakeOrderedAndProject``), orphans are removed
  from those candidates only (an IN lookup pushed to the dimension scan
  for ordinary pages), and the page's ids reach the children scan as an IN
  filter. Children are scanned once for counts and member sets
  (``_rolled``). Broadcast sides are bounded by ``offset + limit``.
* A6/A7 work per (header, bridge key) and join back on both keys, so a
  hot header is not funnelled into one join partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmart.operators.common import Keys, bounded_broadcast, dealt, desc_pg, keys, tasks_for
from logmart.schemas import DEFAULT_PAGE_SIZE, TOTAL_MEMBERS
from logmart.session import ensure_checkpoint_dir

# Pages up to this many headers filter children with a literal IN list
# (pushed to the scan); larger ones use a broadcast semi join.
PUSHDOWN_IN_LIMIT = 10_000


def _pairs(children: DataFrame, bridge: DataFrame, child_fk: str, child_bridge_key: Keys,
           bridge_child: Keys, bridge_member: str) -> DataFrame:
    """Distinct (header, member) pairs. Children are first made distinct per
    (header, bridge key), so the bridge join sees that reduced set, then the
    pairs are made distinct again, each in tasks of bounded size."""
    ck, bk = keys(child_bridge_key), keys(bridge_child)
    kcols = [f"_bk{i}" for i in range(len(ck))]
    n = tasks_for(children)
    c = dealt(children.select(F.col(child_fk).alias("_hk"), *[F.col(a).alias(k) for a, k in zip(ck, kcols)]),
              n, "_hk", *kcols).distinct()
    b = bridge.select(*[F.col(a).alias(k) for a, k in zip(bk, kcols)], F.col(bridge_member).alias("_m"))
    return dealt(c.join(b, kcols).select("_hk", "_m"), n, "_hk").distinct()


def _rolled(children: DataFrame, bridge: DataFrame, child_fk: str, child_bridge_key: Keys, bridge_child: Keys,
            member: Column) -> DataFrame:
    """Per header (``_hk``) the ``exercise_count`` and the sorted distinct
    ``members`` (values of ``member`` in the bridge), from one scan of the
    children and two mergeable aggregates.

    Children are counted per (header, bridge key); each such row meets the
    one member array of its key and becomes a row per member, of which the
    first carries the count. These are summed per (header, member), so a hot
    header is at most one row per member and task, then per header."""
    ck, bk = keys(child_bridge_key), keys(bridge_child)
    kcols = [f"_bk{i}" for i in range(len(ck))]
    per_key = children.groupBy(F.col(child_fk).alias("_hk"), *[F.col(a).alias(k) for a, k in zip(ck, kcols)]) \
        .agg(F.count(F.lit(1)).alias("_n"))
    held = bridge.groupBy(*[F.col(a).alias(k) for a, k in zip(bk, kcols)]).agg(F.collect_set(member).alias("_ms"))
    rows = per_key.join(held, kcols, "left").select("_hk", "_n", F.posexplode_outer("_ms").alias("_p", "_m"))
    rows = rows.select("_hk", "_m", F.when(F.coalesce("_p", F.lit(0)) == 0, F.col("_n")).otherwise(0).alias("_n"))
    return rows.groupBy("_hk", "_m").agg(F.sum("_n").alias("_n")).groupBy("_hk").agg(
        F.sum("_n").alias("exercise_count"), F.array_sort(F.collect_list("_m")).alias("members"))


def child_count(headers: DataFrame, children: DataFrame, *, header_id: str = "id",
                child_fk: str = "workout_id", out: str = "exercise_count") -> DataFrame:
    """A1: number of children per header, 0 when it has none."""
    counts = children.groupBy(F.col(child_fk).alias("_hk")).agg(F.count(F.lit(1)).alias(out))
    return (headers.join(counts, F.col(header_id) == F.col("_hk"), "left").drop("_hk")
            .withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long")))


def member_set(headers: DataFrame, children: DataFrame, bridge: DataFrame, *, header_id: str = "id",
               child_fk: str = "workout_id", child_bridge_key: Keys = "id",
               bridge_child: Keys = "exercise_id", bridge_member: str = "body_part_id",
               out: str = "body_part_ids") -> DataFrame:
    """A2: sorted distinct member ids per header through the bridge; ``[]``
    when the header has no children or its children have no members."""
    pairs = _pairs(children, bridge, child_fk, child_bridge_key, bridge_child, bridge_member)
    sets = pairs.groupBy("_hk").agg(F.array_sort(F.collect_list("_m")).alias(out))
    elem = bridge.schema[bridge_member].dataType.simpleString()
    return (headers.join(sets, F.col(header_id) == F.col("_hk"), "left").drop("_hk")
            .withColumn(out, F.coalesce(F.col(out), F.array().cast(f"array<{elem}>"))))


def next_ordinal(children: DataFrame, *, child_fk: str = "workout_id", sort_col: str = "sort_order",
                 out: str = "next_sort_order") -> DataFrame:
    """A3: ``COALESCE(MAX(sort_order), 0) + 1`` per header."""
    return children.groupBy(child_fk).agg(
        (F.coalesce(F.max(sort_col), F.lit(0)) + 1).alias(out))


def coverage_flag(member_ids: Column, k: int | Column | None = TOTAL_MEMBERS) -> Column:
    """A5 predicate: distinct members >= k. ``k`` may be a Column such as
    ``dim.select(F.count('*')).scalar()`` for true relational division."""
    kk = F.lit(k) if isinstance(k, int) else k
    return F.size(member_ids) >= kk


def member_count(dim: DataFrame) -> Column:
    """Scalar subquery counting the member dimension (runs once)."""
    return dim.select(F.count(F.lit(1))).scalar()


def full_coverage(headers: DataFrame, children: DataFrame, bridge: DataFrame, *,
                  k: int | Column | None = TOTAL_MEMBERS, member_dim: DataFrame | None = None,
                  out: str = "full_coverage", **cols) -> DataFrame:
    """A5: flag headers whose children together cover >= k members. With
    ``k=None`` the member dimension is counted (every member covered)."""
    if k is None:
        if member_dim is None:
            raise ValueError("k=None needs member_dim")
        k = member_count(member_dim)
    ids_col = cols.pop("out_ids", "body_part_ids")
    df = member_set(headers, children, bridge, out=ids_col, **cols)
    return df.withColumn(out, coverage_flag(F.col(ids_col), k))


def _verified_page(h: DataFrame, dims: DataFrame, order: list[Column], limit: int, offset: int,
                   header_fk: str, dim_id: str, check_fk: bool) -> DataFrame:
    """The page of headers that have a dimension row: take the top
    ``offset + limit`` candidates and drop orphans. Any header outside the
    candidates ranks below all of them, so with intact foreign keys that is
    the page, and no step joins all headers to the dimension. Where orphans
    leave it short, one join of all headers to the dimension and one top-k
    give the page."""
    want = offset + limit
    page = lambda df: df.orderBy(*order).offset(offset).limit(limit)
    if want <= PUSHDOWN_IN_LIMIT:
        return _small_page(h, dims, order, limit, offset, header_fk, dim_id, check_fk)
    ensure_checkpoint_dir(h.sparkSession)
    cand = h.orderBy(*order).limit(want).checkpoint(eager=True)
    if not check_fk:
        return page(cand)
    keys_ = cand.select(F.col(header_fk).alias("_gid")).distinct()
    found = (dims.select(F.col(dim_id).alias("_gid")).join(bounded_broadcast(keys_, want), "_gid")
             .distinct().withColumn("_ok", F.lit(True)))
    flagged = cand.join(bounded_broadcast(found, want), F.col(header_fk) == F.col("_gid"), "left").drop("_gid")
    n_cand, n_ok = flagged.agg(F.count(F.lit(1)), F.count("_ok")).first()
    if n_ok == want or n_cand < want:
        return page(flagged.where(F.col("_ok")).drop("_ok"))
    return page(_with_dimension(h, dims, header_fk, dim_id))


def _with_dimension(h: DataFrame, dims: DataFrame, header_fk: str, dim_id: str) -> DataFrame:
    keys_ = dims.select(F.col(dim_id).alias("_gid")).distinct()
    return h.join(keys_, F.col(header_fk) == F.col("_gid"), "left_semi")


def _small_page(h: DataFrame, dims: DataFrame, order: list[Column], limit: int, offset: int,
                header_fk: str, dim_id: str, check_fk: bool) -> DataFrame:
    """``_verified_page`` for pages of at most ``PUSHDOWN_IN_LIMIT``
    candidates: the top candidates are fetched (a bounded top-k, as a page
    is), their dimension keys are looked up with an IN filter pushed to the
    dimension scan, and the page is returned as a small local DataFrame.
    The driver never gets more than ``offset + limit`` rows at once."""
    want = offset + limit
    cand = h.orderBy(*order).limit(want).collect()
    ok = cand
    if check_fk and cand:
        wanted = list({r[header_fk] for r in cand if r[header_fk] is not None})
        found = {r[0] for r in dims.where(F.col(dim_id).isin(wanted)).select(dim_id).distinct().collect()}
        ok = [r for r in cand if r[header_fk] in found]
        if len(ok) < want == len(cand):
            ok = _with_dimension(h, dims, header_fk, dim_id).orderBy(*order).limit(want).collect()
    return h.sparkSession.createDataFrame(ok[offset:want], h.schema)


def history(headers: DataFrame, dims: DataFrame, children: DataFrame, bridge: DataFrame, *,
            limit: int | None = DEFAULT_PAGE_SIZE, offset: int = 0,
            k: int | Column | None = TOTAL_MEMBERS, member_dim: DataFrame | None = None,
            assume_fk_integrity: bool = False,
            header_id: str = "id", header_fk: str = "gym_id", started: str = "started_at",
            finished: str = "finished_at", dim_id: str = "id", dim_name: str = "name",
            child_fk: str = "workout_id", child_bridge_key: Keys = "id",
            bridge_child: Keys = "exercise_id", bridge_member: str = "body_part_id") -> DataFrame:
    """A4: history rows ``id, started_at, finished_at, gym_name,
    exercise_count, body_part_ids, full_coverage`` newest first
    (``started_at DESC``, then id DESC as tie-break), paged by
    ``limit``/``offset``; ``limit=None`` returns every header.

    Headers whose dimension row is missing are dropped before paging, as
    the inner join does in SQL (checked on the page's candidates only, see
    ``_verified_page``; ``assume_fk_integrity=True`` skips the check, e.g.
    after ``audit`` found no orphan). Children are scanned once: a partial
    aggregate per (header, bridge key) feeds both the count and the
    member set.
    """
    if limit is not None and (limit < 0 or offset < 0):
        raise ValueError("limit and offset must be >= 0")
    if k is None:
        if member_dim is None:
            raise ValueError("k=None needs member_dim")
        k = member_count(member_dim)
    h = headers.select(header_id, header_fk, started, finished)
    order = [desc_pg(started), desc_pg(header_id)]
    if limit is not None:
        h = _verified_page(h, dims, order, limit, offset, header_fk, dim_id, not assume_fk_integrity)
        if limit <= PUSHDOWN_IN_LIMIT:
            # the page (<= limit ids) becomes a literal IN filter that reaches
            # the Parquet scan: row groups whose key range misses the page are
            # skipped, like the source's index on the child's header key
            ids = [r[0] for r in h.select(header_id).collect()]
            kids = children.where(F.col(child_fk).isin(ids))
        else:
            kids = children.join(
                bounded_broadcast(h.select(F.col(header_id).alias(child_fk)), limit), child_fk, "left_semi")
        h = bounded_broadcast(h, limit)
    else:
        kids = children
    named = h.join(dims.select(F.col(dim_id).alias("_gid"), F.col(dim_name).alias("gym_name")),
                   F.col(header_fk) == F.col("_gid"), "inner")
    rolled = _rolled(kids, bridge, child_fk, child_bridge_key, bridge_child, F.col(bridge_member))
    elem = bridge.schema[bridge_member].dataType.simpleString()
    out = (named.join(rolled, F.col(header_id) == F.col("_hk"), "left")
           .withColumn("exercise_count", F.coalesce(F.col("exercise_count"), F.lit(0)).cast("long"))
           .withColumn("body_part_ids", F.coalesce(F.col("members"), F.array().cast(f"array<{elem}>"))))
    out = out.withColumn("full_coverage", coverage_flag(F.col("body_part_ids"), k))
    cols = [header_id, started, finished, "gym_name", "exercise_count", "body_part_ids", "full_coverage"]
    if limit is not None:
        from pyspark.sql import Window
        w = Window.orderBy(*order)
        out = out.withColumn("rank", (F.row_number().over(w) + F.lit(offset)).cast("long"))
        return out.select("rank", *cols).orderBy("rank")
    return out.select(*cols)


def sibling_members(children: DataFrame, bridge: DataFrame, *, child_id: Keys = "id",
                    child_fk: str = "workout_id", child_bridge_key: Keys = "id",
                    bridge_child: Keys = "exercise_id", bridge_member: str = "body_part_id",
                    out: str = "sibling_ids", own: str = "own_ids") -> DataFrame:
    """For every child, its own members and the members covered by the
    header's *other* children.

    A member is a sibling member of a child when the header's count of
    children holding it, minus the child's own contribution, is > 0. That
    depends only on (header, the child's member set), and the member set
    only on the bridge key, so the work runs per (header, bridge key) from
    a partially aggregated count; per-header lists hold one entry per
    distinct member (bounded by the member dimension). No child-by-child
    pairs are formed, and children join back on (header, bridge key), not
    on the header alone.
    """
    ck, bk, ids = keys(child_bridge_key), keys(bridge_child), keys(child_id)
    kcols = [f"_bk{i}" for i in range(len(ck))]
    b = (bridge.select(*[F.col(a).alias(f"_bk{i}") for i, a in enumerate(bk)], F.col(bridge_member).alias("_m"))
         .groupBy(*kcols).agg(F.array_sort(F.collect_set("_m")).alias("_own")))
    own_t = b.schema["_own"].dataType
    n = tasks_for(children)
    per_key = dealt(children.select(F.col(child_fk).alias("_hk"), *[F.col(a).alias(k) for a, k in zip(ck, kcols)]),
                    n, "_hk", *kcols).groupBy("_hk", *kcols).agg(F.count(F.lit(1)).alias("_c"))
    pk = per_key.join(b, kcols, "left").withColumn("_own", F.coalesce("_own", F.array().cast(own_t)))
    hm = (dealt(pk.select("_hk", "_c", F.explode("_own").alias("_m")), n, "_hk").groupBy("_hk", "_m").agg(
        F.sum("_c").alias("_n")).groupBy("_hk").agg(F.collect_list(F.struct("_m", "_n")).alias("_hm")))
    pk = dealt(pk, n, "_hk")
    pk = pk.join(hm, "_hk", "left")
    sib = F.array_sort(F.transform(
        F.filter(F.coalesce("_hm", F.array().cast(hm.schema["_hm"].dataType)),
                 lambda s: (s["_n"] - F.when(F.array_contains("_own", s["_m"]), 1).otherwise(0)) > 0),
        lambda s: s["_m"]))
    pk = pk.select(F.col("_hk").alias("_phk"), *[F.col(k).alias(f"_p{k}") for k in kcols],
                   F.col("_own").alias(own), sib.alias(out))
    c = children.select(*dict.fromkeys([*ids, child_fk, *ck]))
    # NULL-safe: a child without a bridge key still appears, with no members
    j = _rejoined(c, pk, [child_fk, *ck], ["_phk", *[f"_p{k}" for k in kcols]], n)
    return j.select(*ids, *([child_fk] if child_fk not in ids else []), own, out)


def _rejoined(c: DataFrame, pk: DataFrame, left: list[str], right: list[str], n: int | None) -> DataFrame:
    """NULL-safe join of ``c`` and ``pk`` on equal keys. With ``n`` both sides
    are dealt to so many partitions by a hash of the keys and joined on it;
    the keys themselves are compared on the pairs it brings together."""
    cond = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]
    if n:
        kind = dict(c.dtypes)
        c = c.withColumn("_at", F.xxhash64(*left)).repartition(n, "_at")
        pk = pk.withColumn("_pat", F.xxhash64(*[F.col(b).cast(kind[a]) for a, b in zip(left, right)])).repartition(n, "_pat")
        same = [F.coalesce(F.col(a) == F.col(b), F.col(a).isNull() & F.col(b).isNull()) for a, b in zip(left, right)]
        return c.join(pk, [F.col("_at") == F.col("_pat"), *same]).drop("_at", "_pat")
    return c.join(pk, cond)


def coverage_grid(dim: DataFrame, children: DataFrame, bridge: DataFrame, *, dim_id: str = "id",
                  dim_name: str = "name", dim_sort: str = "sort_order", **cols) -> DataFrame:
    """A7 (batch form): for every child, one row per member that is
    ``selected`` (the child's own) or ``trained`` (covered by a sibling).
    Members with neither flag are implied by the dimension and not
    emitted, so the output is linear in the children."""
    child_id = keys(cols.get("child_id", "id"))
    sib = sibling_members(children, bridge, **cols)
    cells = sib.select(*child_id, F.explode(F.array_union("own_ids", "sibling_ids")).alias("_m"),
                       "own_ids", "sibling_ids")
    d = dim.select(F.col(dim_id).alias("_m"), F.col(dim_name).alias("member_name"),
                   F.col(dim_sort).alias("member_sort"))
    return cells.join(d, "_m", "left").select(
        *child_id, F.col("_m").alias("member_id"), "member_name", "member_sort",
        F.array_contains("own_ids", F.col("_m")).alias("selected"),
        F.array_contains("sibling_ids", F.col("_m")).alias("trained"))


def member_grid(dim: DataFrame, children: DataFrame, bridge: DataFrame, *, dim_id: str = "id",
                dim_name: str = "name", dim_sort: str = "sort_order", child_id: Keys = "id",
                child_fk: str = "workout_id", child_bridge_key: Keys = "id", bridge_child: Keys = "exercise_id",
                bridge_member: str = "body_part_id", out: str = "grid") -> DataFrame:
    """A6 / A7, the whole grid: for every child one array with *every* member
    of the dimension in display order, as (member_id, member_name,
    ``selected``, ``trained``), members with neither flag included.

    Member sets are bitmaps over the members' display positions (64 a word).
    Counts per (header, member) give two planes per header, the members that
    any child holds (``once``) and those that two hold (``twice``). A child's
    siblings hold ``twice | (once & ~own)``, so every cell is one bit test
    and no list is searched. Members that aren't in the dimension don't show;
    a child without a header has no siblings.
    """
    ck, bk, ids = keys(child_bridge_key), keys(bridge_child), keys(child_id)
    kcols = [f"_bk{i}" for i in range(len(ck))]
    shown = dim.agg(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col(dim_sort).isNull().alias("a"), F.col(dim_sort).alias("b"), F.col(dim_id).alias("c"),
        F.col(dim_name).alias("d")))), lambda m: F.struct(m["c"].alias("id"), m["d"].alias("name"))).alias("_dim"))
    place = shown.select(F.posexplode("_dim").alias("_pos", "_d")).select(F.col("_d.id").alias("_m"), "_pos")
    bit = F.expr("shiftleft(1L, cast(_pos % 64 as int))")
    word = F.floor(F.col("_pos") / 64).cast("int").alias("_w")
    words = lambda c: F.map_from_entries(F.collect_list(F.struct("_w", c)))

    held = bridge.select(*[F.col(a).alias(k) for a, k in zip(bk, kcols)], F.col(bridge_member).alias("_m")).join(
        place, "_m").select(*kcols, "_pos").distinct()
    own = held.groupBy(*kcols, word).agg(F.bit_or(bit).alias("_b")).groupBy(*kcols).agg(words("_b").alias("_own"))
    per_key = children.groupBy(F.col(child_fk).alias("_hk"), *[F.col(a).alias(k) for a, k in zip(ck, kcols)]).agg(
        F.count(F.lit(1)).alias("_c"))
    counts = per_key.join(held, kcols).groupBy("_hk", "_pos").agg(F.sum("_c").alias("_n"))
    planes = (counts.groupBy("_hk", word).agg(F.bit_or(bit).alias("_o"), F.bit_or(F.when(F.col("_n") > 1, bit)).alias("_t"))
              .groupBy("_hk").agg(words("_o").alias("_once"), words("_t").alias("_twice")))
    pk = per_key.join(own, kcols, "left").join(planes, "_hk", "left").select(
        F.col("_hk").alias("_phk"), *[F.col(k).alias(f"_p{k}") for k in kcols], "_own", "_once", "_twice")
    c = children.select(*dict.fromkeys([*ids, child_fk, *ck]))
    cond = [F.col(child_fk).eqNullSafe(F.col("_phk"))] + [F.col(a).eqNullSafe(F.col(f"_p{k}")) for a, k in zip(ck, kcols)]
    # the words travel to the children, not the cells. The words of a place are
    # bound by the outer lambda: made once, not again for each cell
    j = c.join(pk, cond).withColumn("_dim", shown.scalar())
    at = lambda m, w: F.coalesce(F.try_element_at(m, w), F.lit(0).cast("long"))
    planes_at = F.transform(F.sequence(F.lit(0), F.floor((F.size("_dim") - 1) / 64).cast("int")), lambda w: F.struct(
        w.alias("w"), at(F.col("_own"), w).alias("own"), at(F.col("_twice"), w).bitwiseOR(
            at(F.col("_once"), w).bitwiseAND(F.bitwise_not(at(F.col("_own"), w)))).alias("sib")))
    cells = lambda p: F.transform(F.slice("_dim", p["w"] * 64 + 1, F.lit(64)), lambda m, i: F.struct(
        m["id"].alias("member_id"), m["name"].alias("member_name"),
        (F.getbit(p["own"], i) == 1).alias("selected"), (F.getbit(p["sib"], i) == 1).alias("trained")))
    return j.select(*dict.fromkeys([*ids, child_fk]), F.flatten(F.transform(planes_at, cells)).alias(out))


def coverage_grid_for(dim: DataFrame, selected_ids: list[int], trained: DataFrame, *,
                      dim_id: str = "id", dim_name: str = "name", dim_sort: str = "sort_order",
                      member_col: str = "body_part_id") -> DataFrame:
    """A7 (single editor form, as in the source UI): the whole member
    dimension in display order with ``selected``/``trained`` flags.
    ``trained`` holds the member ids of the other children (one column)."""
    t = trained.select(F.col(member_col).alias("_t")).distinct()
    return (dim.join(t, F.col(dim_id) == F.col("_t"), "left")
            .select(F.col(dim_id).alias("id"), F.col(dim_name).alias("name"),
                    F.col(dim_id).isin(list(selected_ids)).alias("selected"),
                    F.col("_t").isNotNull().alias("trained"), F.col(dim_sort).alias("_s"))
            .orderBy(F.col("_s").asc_nulls_last(), "id").drop("_s"))


def header_summary(headers: DataFrame, dims: DataFrame, children: DataFrame, bridge: DataFrame,
                   member_dim: DataFrame, *, as_of, header_id: str = "id", header_fk: str = "gym_id",
                   started: str = "started_at", finished: str = "finished_at", dim_id: str = "id",
                   dim_name: str = "name", child_fk: str = "workout_id", child_bridge_key: Keys = "id",
                   bridge_child: Keys = "exercise_id", bridge_member: str = "body_part_id",
                   member_id: str = "id", member_name: str = "name", member_sort: str = "sort_order") -> DataFrame:
    """Per header ``gym_name``, ``minutes`` (D1: to ``finished_at``,
    else to ``as_of``), ``exercise_count`` (A1) and ``member_names``: the
    distinct members covered, in member display order."""
    from logmart.functions.labels import session_minutes
    named = headers.join(dims.select(F.col(dim_id).alias("_gid"), F.col(dim_name).alias("gym_name")),
                         F.col(header_fk) == F.col("_gid")).drop("_gid")
    md = member_dim.select(F.col(member_id).alias("_m"), F.struct(
        F.col(member_sort).isNull().alias("a"), F.col(member_sort).alias("b"), F.col(member_id).alias("c"),
        F.col(member_name).alias("n")).alias("_shown"))
    shown = bridge.join(md, F.col(bridge_member) == F.col("_m")).select(*keys(bridge_child), "_shown")
    rolled = _rolled(children, shown, child_fk, child_bridge_key, bridge_child, F.col("_shown"))
    out = (named.join(rolled, F.col(header_id) == F.col("_hk"), "left")
           .withColumn("exercise_count", F.coalesce(F.col("exercise_count"), F.lit(0)).cast("long")))
    as_of_col = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return out.select(
        header_id, "gym_name", session_minutes(started, finished, as_of_col).alias("minutes"),
        "exercise_count",
        F.coalesce(F.array_join(F.transform("members", lambda x: x["n"]), ", "), F.lit("")).alias("member_names"))
