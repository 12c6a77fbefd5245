"""Nested documents.

N1 nest_members: ordered ``[{id, name}]`` members per child, ``[]`` when
none. N2 header_documents: header rows with ordered ``exercises[]``, each
carrying its N1 members; header_document_rows: the same document as one
row per child with its position (for headers too large to nest in one
row). N3 is ``size``; N4 is ``explode`` (see ``changes``).

Ordering inside arrays is done by ``array_sort`` over structs whose first
fields are ``(sort IS NULL, sort, id)`` so NULL ordinals go last, as
PostgreSQL's ``ORDER BY sort ASC`` puts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmart.operators.common import Keys, asc_pg, bounded_broadcast, group_rank, keys
from logmart.operators.rollup import PUSHDOWN_IN_LIMIT

MEMBER_T = "array<struct<id:int,name:string>>"


def member_lists(bridge: DataFrame, dim: DataFrame, *, bridge_child: Keys = "exercise_id",
                 bridge_member: str = "body_part_id", dim_id: str = "id", dim_name: str = "name",
                 dim_sort: str = "sort_order", out: str = "body_parts") -> DataFrame:
    """Per bridge child key, members ordered by (sort NULLS LAST, id). The
    list is bounded by the member dimension (one bridge row per pair)."""
    bk = keys(bridge_child)
    d = dim.select(F.col(dim_id).alias("_mid"), F.col(dim_name).alias("_mname"), F.col(dim_sort).alias("_ms"))
    j = bridge.select(*bk, F.col(bridge_member).alias("_mid")).join(d, "_mid")
    agg = j.groupBy(*bk).agg(F.array_sort(F.collect_list(F.struct(
        F.col("_ms").isNull().alias("a"), F.col("_ms").alias("b"), F.col("_mid").alias("id"),
        F.col("_mname").alias("name")))).alias("_arr"))
    return agg.select(*bk, F.transform("_arr", lambda x: F.struct(
        x["id"].cast("int").alias("id"), x["name"].alias("name"))).alias(out))


def nest_members(children: DataFrame, bridge: DataFrame, dim: DataFrame, *, child_bridge_key: Keys = "id",
                 bridge_child: Keys = "exercise_id", out: str = "body_parts", **dim_cols) -> DataFrame:
    """Attach ``out`` = ordered members to every child (``[]`` if none)."""
    ck, bk = keys(child_bridge_key), keys(bridge_child)
    ml = member_lists(bridge, dim, bridge_child=bk, out=out, **dim_cols)
    ml = ml.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(bk)], out)
    cond = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(ck)]
    j = children.join(ml, cond, "left").drop(*[f"_k{i}" for i in range(len(bk))])
    return j.withColumn(out, F.coalesce(F.col(out), F.array().cast(MEMBER_T)))


def _doc_headers(headers: DataFrame, dims: DataFrame, header_id: str, header_fk: str, dim_id: str,
                 dim_name: str, header_cols: list[str]) -> DataFrame:
    d = dims.select(F.col(dim_id).alias("_gid"), F.col(dim_name).alias("gym_name"))
    return headers.join(d, F.col(header_fk) == F.col("_gid"), "inner").select(
        header_id, *[c for c in header_cols if c != header_id], "gym_name")


def header_document_rows(headers: DataFrame, dims: DataFrame, children: DataFrame, bridge: DataFrame,
                         member_dim: DataFrame, *, header_id: str = "id", header_fk: str = "gym_id",
                         dim_id: str = "id", dim_name: str = "name", child_id: Keys = "id",
                         child_fk: str = "workout_id", child_sort: str = "sort_order",
                         child_cols: tuple[str, ...] = ("name", "machine", "max_weight"),
                         child_bridge_key: Keys = "id", bridge_child: Keys = "exercise_id",
                         header_cols: tuple[str, ...] = ("id", "started_at", "finished_at", "notes"),
                         header_ids: DataFrame | None = None, max_ids: int | None = None,
                         hot_rows: int | None = None, **member_cols) -> DataFrame:
    """N2 as rows: one row per child of each (dim-joined) header with the
    header fields, ``position`` in the document (sort_order NULLS LAST,
    then child id) and the child's ordered members. Headers without
    children appear once with NULL child fields and ``position`` NULL.

    ``header_ids`` (column ``id``) restricts the documents to requested
    headers, as the single-document endpoint does. With ``max_ids`` (a
    bound on the request) the ids become IN filters pushed to the header
    and child scans; without it, headers and children are semi-joined to
    the request."""
    if header_ids is not None and max_ids is not None and max_ids <= PUSHDOWN_IN_LIMIT:
        # a bounded request becomes literal IN filters pushed to both scans
        wanted = [r[0] for r in header_ids.select("id").distinct().limit(max_ids + 1).collect()]
        if len(wanted) > max_ids:
            raise ValueError(f"more than max_ids={max_ids} header ids requested")
        headers = headers.where(F.col(header_id).isin(wanted))
        children = children.where(F.col(child_fk).isin(wanted))
    elif header_ids is not None:
        req = bounded_broadcast(header_ids.select(F.col("id").alias("_rid")).distinct(), max_ids)
        headers = headers.join(req, F.col(header_id) == F.col("_rid"), "left_semi")
        children = children.join(req, F.col(child_fk) == F.col("_rid"), "left_semi")
    ids = keys(child_id)
    # rank the plain children (a narrow scan for the group sizes), then nest
    ranked = group_rank(children, child_fk, [asc_pg(child_sort), *[F.col(c).asc() for c in ids]], "position",
                        hot_rows=hot_rows)
    kids = nest_members(ranked, bridge, member_dim, child_bridge_key=child_bridge_key,
                        bridge_child=bridge_child, **member_cols)
    h = _doc_headers(headers, dims, header_id, header_fk, dim_id, dim_name, list(header_cols))
    names = child_names(h.columns, [*ids, child_sort, *child_cols])
    kids = kids.select(F.col(child_fk).alias("_hk"), *[F.col(c).alias(a) for c, a in names.items()],
                       "body_parts", "position")
    return h.join(kids, F.col(header_id) == F.col("_hk"), "left").drop("_hk")


def child_names(header_cols: list[str], child_cols: list[str]) -> dict[str, str]:
    """Child column -> name in document rows (``child_<c>`` on a clash
    with a header column, e.g. both tables' ``id``)."""
    return {c: (f"child_{c}" if c in header_cols else c) for c in dict.fromkeys(child_cols)}


def header_documents(headers: DataFrame, dims: DataFrame, children: DataFrame, bridge: DataFrame,
                     member_dim: DataFrame, *, header_id: str = "id", child_id: Keys = "id",
                     child_fk: str = "workout_id", child_sort: str = "sort_order",
                     child_cols: tuple[str, ...] = ("name", "machine", "max_weight"),
                     header_cols: tuple[str, ...] = ("id", "started_at", "finished_at", "notes"),
                     **kw) -> DataFrame:
    """One document row per header: header fields, ``gym_name`` and
    ``exercises`` = ordered array of {id..., name, machine, max_weight,
    body_parts}. The array holds all of a header's children; use
    ``header_document_rows`` where one header can be unbounded."""
    ids = keys(child_id)
    rows = header_document_rows(headers, dims, children, bridge, member_dim, header_id=header_id,
                                child_id=ids, child_fk=child_fk, child_sort=child_sort,
                                child_cols=child_cols, header_cols=header_cols, **kw)
    hcols = [header_id, *[c for c in header_cols if c != header_id], "gym_name"]
    names = child_names(hcols, [*ids, *child_cols])
    item = F.struct(F.col("position").alias("_pos"), *[F.col(a).alias(c) for c, a in names.items()],
                    F.col("body_parts"))
    fields = [*names, "body_parts"]
    docs = rows.groupBy(*hcols).agg(
        F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), item))).alias("_ex"))
    ex = F.transform("_ex", lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    return docs.select(*hcols, ex.alias("exercises"))


def render_members(c: Column | str) -> Column:
    """Stable text of a member list: ``id:name|id:name``."""
    x = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(x, lambda m: F.concat(m["id"].cast("string"), F.lit(":"), m["name"])), "|")
