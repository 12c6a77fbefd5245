"""Small shared helpers: key lists, PostgreSQL null ordering, size-checked
broadcasts and a distributed global rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmart.session import shuffle_partitions

Keys = str | Sequence[str]

# Largest side (in rows) this library broadcasts on its own authority.
# Anything whose size is not bounded by a parameter is left to AQE, which
# broadcasts only after measuring the side at run time
# (spark.sql.autoBroadcastJoinThreshold).
BROADCAST_ROW_LIMIT = 1_000_000


def keys(k: Keys) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def asc_pg(c: str | Column) -> Column:
    """PostgreSQL ``ASC``: NULLs last (Spark's default is first)."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc_pg(c: str | Column) -> Column:
    """PostgreSQL ``DESC``: NULLs first (Spark's default is last)."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def bounded_broadcast(df: DataFrame, bound_rows: int | None) -> DataFrame:
    """Broadcast ``df`` only when a parameter proves it holds at most
    ``bound_rows`` rows (e.g. a page of ``offset + limit`` keys). Without a
    proven bound the join strategy is left to AQE's measured sizes."""
    if bound_rows is not None and bound_rows <= BROADCAST_ROW_LIMIT:
        return F.broadcast(df)
    return df


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name where NULL equals NULL (still an
    equi-join); the key columns are the left side's."""
    named = right.withColumnsRenamed({c: f"_ns_{c}" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"_ns_{c}")) for c in on]
    return left.join(named, cond, how).drop(*[f"_ns_{c}" for c in on])


def fits(df: DataFrame, max_rows: int) -> bool:
    """Bounded size check: reads at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


# Rows that one task of a wide aggregate or join works on at once.
TASK_ROWS = 1_000_000


def tasks_for(df: DataFrame) -> int | None:
    """Partitions of at most about ``TASK_ROWS`` rows of ``df`` each, where
    the session's shuffle partitions would hold more (else None)."""
    n = -(-df.count() // TASK_ROWS)
    return n if n > shuffle_partitions(df.sparkSession) else None


def dealt(df: DataFrame, n: int | None, *by: str) -> DataFrame:
    """``df`` dealt to ``n`` partitions by the columns ``by``; without ``n``
    (see ``tasks_for``) the exchange is left to Spark."""
    return df.repartition(n, *by) if n else df


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row in a total order, without moving the
    table into one partition.

    The table is range-partitioned and sorted by ``order`` (must be a total
    order, i.e. end with a unique key). ``monotonically_increasing_id``
    then carries (partition index, row in partition); the rows per
    partition are counted (one row per partition, so broadcast is bounded
    by the partition count) and turned into offsets. The sorted table is
    materialised once with a reliable checkpoint so both uses see the same
    partitions, and the lineage is cut for executor loss.
    """
    sorted_df = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    sorted_df = sorted_df.checkpoint(eager=True)
    tagged = sorted_df.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).select("_pid", "_off")
    n_parts = sorted_df.rdd.getNumPartitions()
    out = tagged.join(bounded_broadcast(offsets, n_parts), "_pid").withColumn(
        name, (F.col("_off") + F.col("_row") + 1).cast("long")
    )
    return out.drop("_mid", "_pid", "_row", "_off")


# A group with more rows than this is ranked across many tasks.
HOT_GROUP_ROWS = 5_000_000
# More hot groups than this and every group takes the distributed path.
HOT_GROUP_LIMIT = 100_000


def group_rank(df: DataFrame, group: Keys, order: Sequence[Column], name: str = "position",
               hot_rows: int | None = None, total: int | None = None) -> DataFrame:
    """1-based position of each row inside its group (``row_number() OVER
    (PARTITION BY group ORDER BY order)``) that stays parallel when one
    group holds a large share of the table.

    Group sizes come from a partially aggregated count. Groups up to
    ``hot_rows`` rows (default ``HOT_GROUP_ROWS``) use the window; larger ("hot") groups are
    range-sorted over many partitions and ranked from per-(partition,
    group) counts, a table bounded by hot groups x partitions, so no task
    sorts a whole hot group. ``order`` must make the order total. A known
    ``total`` of rows saves the count when no group can be hot.
    """
    g = keys(group)
    hot_rows = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    hot, n_hot = hot_groups(df, g, hot_rows, total)
    w = Window.partitionBy(*g).orderBy(*order)
    if n_hot == 0:
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    if n_hot <= HOT_GROUP_LIMIT:
        tagged = null_safe_join(df, F.broadcast(hot.withColumn("_hot", F.lit(True))), g, "left")
        cold = tagged.where(F.col("_hot").isNull()).drop("_hot").withColumn(name, F.row_number().over(w).cast("long"))
        hot_rows_df = tagged.where(F.col("_hot")).drop("_hot")
    else:
        cold, hot_rows_df = None, df
    s = hot_rows_df.orderBy(*[F.col(c) for c in g], *order).withColumn("_mid", F.monotonically_increasing_id())
    s = s.checkpoint(eager=True)   # both uses below must see the same partitions
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    per = s.groupBy("_pid", *g).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bound = (n_hot * s.rdd.getNumPartitions()) if cold is not None else None
    firsts = bounded_broadcast(per.select("_pid", *g, "_off", "_first"), bound)
    hot_out = null_safe_join(s, firsts, ["_pid", *g]).withColumn(
        name, (F.col("_off") + F.col("_row") - F.col("_first") + 1).cast("long")).drop(
        "_mid", "_pid", "_row", "_off", "_first")
    return hot_out if cold is None else cold.unionByName(hot_out)


def hot_groups(sized: DataFrame, group: Keys, hot_rows: int | None = None, total: int | None = None
               ) -> tuple[DataFrame | None, int]:
    """Keys of the groups above ``hot_rows`` rows (default
    ``HOT_GROUP_ROWS``) and how many there are (counted up to one more than
    ``HOT_GROUP_LIMIT``). A known ``total`` of rows up to that needs no job."""
    limit = HOT_GROUP_ROWS if hot_rows is None else hot_rows
    if total is not None and total <= limit:
        return None, 0
    hot = sized.groupBy(*keys(group)).agg(F.count(F.lit(1)).alias("_gn")).where(F.col("_gn") > limit).drop("_gn")
    return hot, hot.limit(HOT_GROUP_LIMIT + 1).count()


def group_scan(df: DataFrame, group: Keys, order: Sequence[Column], last: dict[str, Column],
               hot: tuple[DataFrame, int]) -> DataFrame:
    """Adds, per name in ``last``, the last non-null value of that column
    among the rows before each row in its group (``last(v, ignorenulls) OVER
    (PARTITION BY group ORDER BY order ROWS .. 1 PRECEDING)``), in parallel
    also when one group holds a large share of the table.

    ``hot`` (see ``hot_groups``) names the large groups. They are range-sorted
    over many tasks. Each piece of a group is scanned alone and takes what it
    lacks from the last values of the pieces before it, of which there is one
    row per piece. ``order`` must make the order total.
    """
    g = keys(group)
    df = df.withColumns({f"_v_{k}": c for k, c in last.items()})
    drop = [f"_v_{k}" for k in last]

    def scanned(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by, *g).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({k: F.last(f"_v_{k}", ignorenulls=True).over(w) for k in last})

    groups, n_hot = hot
    if n_hot == 0:
        return scanned(df).drop(*drop)
    if n_hot <= HOT_GROUP_LIMIT:
        tagged = null_safe_join(df, F.broadcast(groups.withColumn("_hot", F.lit(True))), g, "left")
        cold, rows = tagged.where(F.col("_hot").isNull()).drop("_hot"), tagged.where(F.col("_hot")).drop("_hot")
    else:
        cold, rows = None, df
    rows = rows.orderBy(*[F.col(c) for c in g], *order).withColumn("_mid", F.monotonically_increasing_id())
    rows = rows.checkpoint(eager=True).withColumn("_pid", F.shiftright("_mid", 33))
    ends = rows.groupBy("_pid", *g).agg(*[
        F.max_by(F.struct(f"_v_{k}"), F.when(F.col(f"_v_{k}").isNotNull(), F.col("_mid"))).alias(f"_e_{k}") for k in last])
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_pid", *g, *[F.last(f"_e_{k}", ignorenulls=True).over(before)[f"_v_{k}"].alias(f"_b_{k}") for k in last])
    bound = n_hot * rows.rdd.getNumPartitions() if cold is not None else None
    found = null_safe_join(scanned(rows, "_pid"), bounded_broadcast(ends, bound), ["_pid", *g])
    found = found.withColumns({k: F.coalesce(k, f"_b_{k}") for k in last}).drop(
        "_mid", "_pid", *drop, *[f"_b_{k}" for k in last])
    return found if cold is None else scanned(cold).drop(*drop).unionByName(found)
