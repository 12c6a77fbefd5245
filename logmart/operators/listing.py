"""Sorted listings, paging and keyed lookups.

T1 page / deep_page, P1 visible_listing, P2 dim_listing, P3 header_by_id,
P4 ordered_children, P5/P6 bridge_members, J6 lookup_or_empty,
J7 resolve_keys.

Every listing names its NULL placement (PostgreSQL: ASC NULLS LAST,
DESC NULLS FIRST) and ends with the id so the order is total.
Whole-table listings get their rank from ``global_rank`` (range-sorted,
counted per partition), never from a window over one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmart.operators.common import Keys, asc_pg, bounded_broadcast, desc_pg, global_rank, group_rank, keys


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0,
         rank: str | None = "rank") -> DataFrame:
    """``ORDER BY ... LIMIT limit OFFSET offset`` (one
    ``TakeOrderedAndProject``; each task keeps ``offset + limit`` rows).
    Negative values are refused as PostgreSQL refuses them."""
    if limit < 0 or offset < 0:
        raise ValueError("LIMIT/OFFSET must not be negative")
    out = df.orderBy(*order).offset(offset).limit(limit)
    if rank:
        out = out.withColumn(rank, (F.row_number().over(Window.orderBy(*order)) + F.lit(offset)).cast("long"))
    return out


def deep_page(df: DataFrame, key: str, tie: str, limit: int, offset: int, *, descending: bool = True,
              buckets: int = 64, few: int = 100_000, rank: str | None = "rank") -> DataFrame:
    """T1 for any offset: ``ORDER BY key DESC, tie DESC`` (or both ASC; NULLs
    as PostgreSQL places them) ``LIMIT limit OFFSET offset`` by distributed
    selection.

    Each round cuts the keys that are left at approximate quantiles, counts
    the rows of every bucket and keeps the buckets that hold the page, until
    they hold at most ``few`` rows or one key only. Only those are sorted.
    The driver sees ``buckets`` numbers a round. ``key`` is a number, date
    or timestamp; ``tie`` makes the order total.
    """
    if limit < 0 or offset < 0:
        raise ValueError("LIMIT/OFFSET must not be negative")
    k, before, rows = F.col(key), 0, df
    order = [desc_pg(key), desc_pg(tie)] if descending else [asc_pg(key), asc_pg(tie)]
    while limit:
        cuts = rows.agg(F.percentile_approx(k, [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
        cuts = sorted(set(cuts or []))
        kind = df.schema[key].dataType
        marks = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else F.array().cast(T.ArrayType(kind))
        bucket = F.when(k.isNull(), len(cuts) + 1).otherwise(F.size(F.filter(marks, lambda c: c < k)))
        counts = sorted(((r[0], r[1]) for r in rows.groupBy(bucket).count().collect()), reverse=descending)
        held, start = [], before                 # NULLs last, or first if descending
        for b, n in counts:
            if start < offset + limit and start + n > offset:
                if not held:
                    before = start
                held.append(b)
            start += n
        n_held = sum(n for b, n in counts if b in held)
        rows = rows.where(bucket.between(min(held), max(held))) if held else rows.where(F.lit(False))
        if n_held <= few or len(held) == len(counts):
            break
    return page(rows, order, limit, offset - before, None if rank is None else "_r").withColumnsRenamed(
        {} if rank is None else {"_r": rank}).withColumns({} if rank is None else {rank: (F.col(rank) + before).cast("long")})


def visible_listing(df: DataFrame, *, flag: str = "visible", sort: str = "sort_order",
                    created: str = "created_at", id_col: str = "id", rank: str | None = "rank") -> DataFrame:
    """Rows whose ``flag`` is true (NULL is not true) ordered
    ``sort ASC NULLS LAST, created DESC NULLS FIRST, id``."""
    order = [asc_pg(sort), desc_pg(created), F.col(id_col).asc()]
    v = df.where(F.col(flag) == F.lit(True))
    return global_rank(v, order, rank) if rank else v.orderBy(*order)


def dim_listing(dim: DataFrame, *, sort: str = "sort_order", id_col: str = "id", name: str = "name",
                rank: str | None = "rank") -> DataFrame:
    """``id, name`` by ``sort ASC NULLS LAST`` then id."""
    order = [asc_pg(sort), F.col(id_col).asc()]
    d = dim.select(id_col, name, sort)
    out = global_rank(d, order, rank) if rank else d.orderBy(*order)
    return out.drop(sort)


def header_by_id(headers: DataFrame, dims: DataFrame, ids: DataFrame, *, id_col: str = "id",
                 header_id: str = "id", header_fk: str = "gym_id", dim_id: str = "id", dim_name: str = "name",
                 header_cols: Sequence[str] = ("started_at", "finished_at", "notes"),
                 max_ids: int | None = None) -> DataFrame:
    """Look up requested header ids; ``found`` is false when the header
    (or its dimension row, the inner join) is missing. ``max_ids`` bounds
    the request: it is then pushed to the header scan as an IN filter and
    broadcast."""
    req = ids.select(F.col(id_col).alias("requested_id")).distinct()
    if max_ids is not None and max_ids <= 10_000:
        # a bounded request is pushed to the header scan as an IN filter
        wanted = [r[0] for r in req.limit(max_ids + 1).collect()]
        if len(wanted) > max_ids:
            raise ValueError(f"more than max_ids={max_ids} ids requested")
        headers = headers.where(F.col(header_id).isin(wanted))
    named = headers.join(dims.select(F.col(dim_id).alias("_gid"), F.col(dim_name).alias("gym_name")),
                         F.col(header_fk) == F.col("_gid")).select(
        F.col(header_id).alias("_hid"), *header_cols, "gym_name")
    req = bounded_broadcast(req, max_ids)
    return req.join(named, F.col("requested_id") == F.col("_hid"), "left").select(
        "requested_id", F.col("_hid").isNotNull().alias("found"), *header_cols, "gym_name")


def ordered_children(children: DataFrame, *, child_fk: str = "workout_id", sort: str = "sort_order",
                     child_id: Keys = "id", out: str = "position", hot_rows: int | None = None) -> DataFrame:
    """Children with their position in the header (``sort ASC NULLS
    LAST, id``). ``group_rank`` keeps a header holding a large share of
    all children spread over many tasks."""
    ids = keys(child_id)
    return group_rank(children, child_fk, [asc_pg(sort), *[F.col(c).asc() for c in ids]], out, hot_rows=hot_rows)


def bridge_members(bridge: DataFrame, dim: DataFrame, child_ids: DataFrame | None = None, *,
                   bridge_child: str = "exercise_id", bridge_member: str = "body_part_id",
                   dim_id: str = "id", dim_name: str = "name", dim_sort: str = "sort_order",
                   id_col: str = "id", out: str = "position") -> DataFrame:
    """Members of the given children (all when ``child_ids`` is
    None) through the bridge, ``(child, member id, member name,
    position)`` ordered by the member's ``sort`` NULLS LAST then id. The
    batch ``IN (...)`` is a semi join on the id table."""
    b = bridge.select(bridge_child, bridge_member)
    if child_ids is not None:
        b = b.join(child_ids.select(F.col(id_col).alias(bridge_child)), bridge_child, "left_semi")
    d = dim.select(F.col(dim_id).alias(bridge_member), F.col(dim_name).alias("member_name"),
                   F.col(dim_sort).alias("_s"))
    j = b.join(d, bridge_member)
    w = Window.partitionBy(bridge_child).orderBy(asc_pg("_s"), F.col(bridge_member).asc())
    return j.withColumn(out, F.row_number().over(w).cast("long")).drop("_s")


def lookup_or_empty(df: DataFrame, lists: DataFrame, on: str | Sequence[str], col: str) -> DataFrame:
    """``map[key] ?? []``: left join and replace a missing list by
    ``[]``."""
    j = df.join(lists, on, "left")
    return j.withColumn(col, F.coalesce(F.col(col), F.array().cast(lists.schema[col].dataType)))


def resolve_keys(df: DataFrame, dim: DataFrame, *, name_col: str, dim_name: str = "name", dim_id: str = "id",
                 out: str = "resolved_id") -> tuple[DataFrame, DataFrame]:
    """Natural key -> id (``SELECT id INTO ... WHERE name = ...``).
    Returns (resolved rows, unresolved rows). A name matching several
    dimension rows resolves to the smallest id, as one row is taken."""
    d = dim.groupBy(F.col(dim_name).alias("_n")).agg(F.min(dim_id).alias(out))
    j = df.join(d, F.col(name_col) == F.col("_n"), "left").drop("_n")
    return j.where(F.col(out).isNotNull()), j.where(F.col(out).isNull()).drop(out)
