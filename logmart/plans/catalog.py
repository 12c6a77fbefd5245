"""Registered queries: each operator of the library wired to the driver's
tables (see ``driver_tables``), with an equivalent DuckDB SQL oracle.

Every query reads whole tables. Arrays are emitted joined to strings and
counters as BIGINT so the oracle comparison hashes equal values equally.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmart.plans import driver_tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# The driver mapping adds the region members through supplier -> nation.
_REGION_OF_LINE = """JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey"""

_HISTORY_SQL = f"""WITH h AS ({D.HEADERS_SQL}),
named AS (
  SELECT h.id, h.started_at, h.finished_at, c.c_name AS gym_name
  FROM h JOIN customer c ON c.c_custkey = h.gym_id
  {{page}}
),
cnt AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
mem AS (
  SELECT l.l_orderkey, array_to_string(list_sort(list(DISTINCT n.n_regionkey)), ',') AS ids,
         count(DISTINCT n.n_regionkey) AS k
  FROM lineitem l {_REGION_OF_LINE}
  GROUP BY l.l_orderkey
)
SELECT {{rank}} p.id, p.started_at, p.finished_at, p.gym_name,
  CAST(coalesce(cnt.n, 0) AS BIGINT) AS exercise_count,
  coalesce(mem.ids, '') AS body_part_ids,
  coalesce(mem.k, 0) >= (SELECT count(*) FROM region) AS full_coverage
FROM named p
LEFT JOIN cnt ON cnt.l_orderkey = p.id
LEFT JOIN mem ON mem.l_orderkey = p.id"""


def _history(spark: SparkSession, sf_dir: str, limit: int | None, offset: int) -> DataFrame:
    from logmart.operators.rollup import history
    out = history(D.headers(spark, sf_dir), D.dims(spark, sf_dir), D.children(spark, sf_dir),
                  D.bridge(spark, sf_dir), limit=limit, offset=offset, k=None,
                  member_dim=D.members(spark, sf_dir),
                  child_bridge_key="l_suppkey", bridge_child="s_suppkey")
    return out.withColumn("body_part_ids", F.array_join("body_part_ids", ","))


@register("history_page", _HISTORY_SQL.format(
    page="ORDER BY h.started_at DESC, h.id DESC LIMIT 50 OFFSET 20",
    rank="CAST(row_number() OVER (ORDER BY p.started_at DESC, p.id DESC) + 20 AS BIGINT) AS rank,"))
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4+T1+J1+A1+A2+A5: the client's history screen (limit 50) at offset 20."""
    return _history(spark, sf_dir, 50, 20)


@register("history_all", _HISTORY_SQL.format(page="", rank=""))
def history_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 over every header: counts, member sets and coverage for all."""
    return _history(spark, sf_dir, None, 0)


# ---------------------------------------------------------------- shared SQL
_KEY_DESC = ", ".join(f"l.{c} DESC" for c in D.LINE_KEY)
_KEY_ASC = ", ".join(f"{c}" for c in D.LINE_KEY)

_CHILDREN_SQL = """SELECT l.*, l.l_orderkey AS workout_id, l.l_linenumber AS sort_order,
  CAST(l.l_quantity AS DECIMAL(6,2)) AS max_weight, p.p_name AS name, p.p_brand AS machine
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey"""

_LATEST_SQL = f"""SELECT name, max_weight, last_date, workout_id FROM (
  SELECT p.p_name AS name, CAST(l.l_quantity AS DECIMAL(6,2)) AS max_weight,
         o.o_orderdate AS last_date, l.l_orderkey AS workout_id,
         row_number() OVER (PARTITION BY p.p_name ORDER BY o.o_orderdate DESC, {_KEY_DESC}) AS rn
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
) t WHERE rn = 1"""

_WORDS_SQL = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logmart.operators.latest import latest_values
    return latest_values(D.children(spark, sf_dir, with_name=True), D.headers(spark, sf_dir),
                         child_id=D.LINE_KEY)


def _word_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.word_bridge(spark, sf_dir).select(F.col("word").alias("term")).distinct()


# ------------------------------------------------------------- L1 .. L4
@register("latest_per_key", _LATEST_SQL)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: last value per child name from the most recent header."""
    return _latest(spark, sf_dir)


_SEARCH_SQL = f"""WITH latest AS ({_LATEST_SQL}),
terms AS ({{terms}}),
hits AS (
  SELECT t.term, l.*, row_number() OVER (PARTITION BY t.term ORDER BY l.name) AS rn
  FROM terms t JOIN latest l ON l.name ILIKE '%' || trim(t.term) || '%'
  WHERE length(trim(t.term)) >= 2
)"""


@register("search_latest", _SEARCH_SQL.format(terms=_WORDS_SQL) + """
SELECT term, CAST(rn AS BIGINT) AS rank, name, max_weight, last_date, workout_id FROM hits WHERE rn <= 10""")
def search_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: every word of the part names as a search term, top 10 by name."""
    from logmart.operators.latest import search_latest as op
    return op(_latest(spark, sf_dir), _word_terms(spark, sf_dir))


_EXACT_TERMS_SQL = f"SELECT DISTINCT upper(p_name) AS term FROM part UNION {_WORDS_SQL}"


@register("last_value_for", _SEARCH_SQL.format(terms=_EXACT_TERMS_SQL) + """,
exact AS (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY rn) AS r1 FROM hits
  WHERE rn <= 10 AND lower(name) = lower(trim(term))
)
SELECT term, CAST(rn AS BIGINT) AS rank, name, max_weight, last_date, workout_id
FROM exact WHERE r1 = 1 AND max_weight IS NOT NULL""")
def last_value_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: exact (case-insensitive) hit among the top 10 for upper-cased
    names and single words."""
    from logmart.operators.latest import last_value_for as op
    p = D.table(spark, sf_dir, "part")
    terms = p.select(F.upper("p_name").alias("term")).unionByName(_word_terms(spark, sf_dir)).distinct()
    return op(_latest(spark, sf_dir), terms)


@register("active_header", f"""WITH h AS ({D.HEADERS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY gym_id ORDER BY started_at DESC, id DESC) AS rn FROM h)
SELECT id, gym_id, started_at, finished_at, notes FROM r WHERE rn = 1 AND finished_at IS NULL""")
def active_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4 per customer: the newest order, only when it is still open."""
    from logmart.operators.latest import active_header as op
    return op(D.headers(spark, sf_dir), partition="gym_id")


# ------------------------------------------------------------- N1, N2
_REGION_MEMBER_SQL = """SELECT s.s_suppkey, n.n_regionkey AS mid, r.r_name AS mname
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"""


def _nested_children(spark: SparkSession, sf_dir: str, with_name: bool = True) -> DataFrame:
    from logmart.operators.nest import nest_members
    return nest_members(D.children(spark, sf_dir, with_name=with_name), D.bridge(spark, sf_dir),
                        D.members(spark, sf_dir), child_bridge_key="l_suppkey", bridge_child="s_suppkey")


@register("nest_members", f"""SELECT {_KEY_ASC}, coalesce(m.mid || ':' || m.mname, '') AS body_parts
FROM lineitem l LEFT JOIN ({_REGION_MEMBER_SQL}) m ON m.s_suppkey = l.l_suppkey""")
def nest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered member list of every child."""
    from logmart.operators.nest import render_members
    n = _nested_children(spark, sf_dir, with_name=False)
    return n.select(*D.LINE_KEY, render_members("body_parts").alias("body_parts"))


_DOC_ROWS_SQL = f"""WITH h AS ({D.HEADERS_SQL}),
c AS ({_CHILDREN_SQL}),
k AS (
  SELECT c.*, coalesce(m.mid || ':' || m.mname, '') AS body_parts,
         row_number() OVER (PARTITION BY c.workout_id ORDER BY c.sort_order NULLS LAST, {_KEY_ASC}) AS position
  FROM c LEFT JOIN ({_REGION_MEMBER_SQL}) m ON m.s_suppkey = c.l_suppkey
),
rows AS (
  SELECT h.id, h.started_at, h.finished_at, h.notes, cu.c_name AS gym_name, k.*
  FROM h JOIN customer cu ON cu.c_custkey = h.gym_id LEFT JOIN k ON k.workout_id = h.id
)"""


def _doc_kwargs():
    return dict(child_id=D.LINE_KEY, child_cols=("name", "machine", "max_weight"),
                child_bridge_key="l_suppkey", bridge_child="s_suppkey")


@register("header_document_rows", _DOC_ROWS_SQL + f"""
SELECT id, started_at, finished_at, notes, gym_name, {_KEY_ASC}, sort_order, name, machine, max_weight,
       body_parts, CAST(position AS BIGINT) AS position
FROM rows""")
def header_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2 as rows: every child in document position with its members."""
    from logmart.operators.nest import header_document_rows as op
    from logmart.operators.nest import render_members
    r = op(D.headers(spark, sf_dir), D.dims(spark, sf_dir), D.children(spark, sf_dir, with_name=True),
           D.bridge(spark, sf_dir), D.members(spark, sf_dir), **_doc_kwargs())
    return r.withColumn("body_parts", render_members("body_parts"))


@register("header_documents", _DOC_ROWS_SQL + """
SELECT id, started_at, finished_at, notes, gym_name,
  coalesce(string_agg(concat_ws('/', l_linenumber, name, machine, max_weight, body_parts), ';'
                      ORDER BY position) FILTER (WHERE position IS NOT NULL), '') AS exercises
FROM rows GROUP BY id, started_at, finished_at, notes, gym_name""")
def header_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document per order (exercises[] with body_parts[]),
    rendered to text for the comparison."""
    from logmart.operators.nest import header_documents as op
    from logmart.operators.nest import render_members
    d = op(D.headers(spark, sf_dir), D.dims(spark, sf_dir), D.children(spark, sf_dir, with_name=True),
           D.bridge(spark, sf_dir), D.members(spark, sf_dir), **_doc_kwargs())
    ex = F.array_join(F.transform("exercises", lambda e: F.concat_ws(
        "/", e["l_linenumber"].cast("string"), e["name"], e["machine"], e["max_weight"].cast("string"),
        render_members(e["body_parts"]))), ";")
    return d.select("id", "started_at", "finished_at", "notes", "gym_name", ex.alias("exercises"))


# ------------------------------------------------------------- P1 .. P6
_PRIO_INT_SQL = r"""coalesce(TRY_CAST(regexp_extract(o_orderpriority,
  '^[ \t\n\r\x0b\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1) AS BIGINT), 0)"""


@register("visible_listing", f"""SELECT CAST(row_number() OVER (ORDER BY sort_order ASC NULLS LAST,
         created_at DESC NULLS FIRST, id ASC) AS BIGINT) AS rank, id, sort_order, created_at
FROM (SELECT o_orderkey AS id, {_PRIO_INT_SQL} AS sort_order, o_orderdate AS created_at
      FROM orders WHERE o_orderstatus = 'F') t""")
def visible_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as visible items, by priority number then
    newest, with a distributed global rank."""
    from logmart.functions.coerce import php_int
    from logmart.operators.listing import visible_listing as op
    o = D.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), php_int("o_orderpriority").alias("sort_order"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("visible"))
    return op(o).select("rank", "id", "sort_order", "created_at")


@register("dim_listing", """SELECT CAST(row_number() OVER (ORDER BY n_regionkey ASC NULLS LAST, n_nationkey)
  AS BIGINT) AS rank, n_nationkey AS id, n_name AS name FROM nation""")
def dim_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a dimension listing ordered by region, then id."""
    from logmart.operators.listing import dim_listing as op
    n = D.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("sort_order"))
    return op(n).select("rank", "id", "name")


@register("header_by_id", f"""WITH h AS ({D.HEADERS_SQL}),
req AS (SELECT DISTINCT event_id AS requested_id FROM events WHERE event_type = 'purchase')
SELECT req.requested_id, x.id IS NOT NULL AS found, x.started_at, x.finished_at, x.notes, x.gym_name
FROM req LEFT JOIN (SELECT h.*, c.c_name AS gym_name FROM h JOIN customer c ON c.c_custkey = h.gym_id) x
  ON x.id = req.requested_id""")
def header_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch lookup of header ids named by purchase events."""
    from logmart.operators.listing import header_by_id as op
    ids = D.table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id"))
    return op(D.headers(spark, sf_dir), D.dims(spark, sf_dir), ids)


@register("ordered_children", f"""SELECT {_KEY_ASC}, CAST(row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber NULLS LAST, {_KEY_ASC}) AS BIGINT) AS position FROM lineitem""")
def ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of every line in its order."""
    from logmart.operators.listing import ordered_children as op
    return op(D.children(spark, sf_dir), child_id=D.LINE_KEY).select(*D.LINE_KEY, "position")


@register("bridge_members", f"""SELECT m.s_suppkey, CAST(m.mid AS INTEGER) AS body_part_id, m.mname AS member_name,
  CAST(row_number() OVER (PARTITION BY m.s_suppkey ORDER BY m.mid) AS BIGINT) AS position
FROM ({_REGION_MEMBER_SQL}) m
WHERE m.s_suppkey IN (SELECT l_suppkey FROM lineitem)""")
def bridge_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the suppliers named by the lines (batch IN)."""
    from logmart.operators.listing import bridge_members as op
    ids = D.children(spark, sf_dir).select(F.col("l_suppkey").alias("id"))
    return op(D.bridge(spark, sf_dir), D.members(spark, sf_dir), ids, bridge_child="s_suppkey")


# ------------------------------------------------------------- A1 .. A8
@register("child_count", """SELECT o.o_orderkey AS id, CAST(count(l.l_orderkey) AS BIGINT) AS exercise_count
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def child_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: lines per order, 0 for orders without lines."""
    from logmart.operators.rollup import child_count as op
    return op(D.headers(spark, sf_dir).select("id"), D.children(spark, sf_dir))


_WORD_BRIDGE_SQL = "SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part"


@register("member_set_words", f"""SELECT o.o_orderkey AS id, coalesce(w.words, '') AS words
FROM orders o LEFT JOIN (
  SELECT l.l_orderkey, array_to_string(list_sort(list(DISTINCT b.word)), ',') AS words
  FROM lineitem l JOIN ({_WORD_BRIDGE_SQL}) b ON b.p_partkey = l.l_partkey GROUP BY l.l_orderkey
) w ON w.l_orderkey = o.o_orderkey""")
def member_set_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 through a many-to-many bridge: distinct part-name words per order."""
    from logmart.operators.rollup import member_set
    m = member_set(D.headers(spark, sf_dir).select("id"), D.children(spark, sf_dir), D.word_bridge(spark, sf_dir),
                   child_bridge_key="l_partkey", bridge_child="p_partkey", bridge_member="word", out="words")
    return m.withColumn("words", F.array_join("words", ","))


@register("next_ordinal", """SELECT l_orderkey AS workout_id, coalesce(max(l_linenumber), 0) + 1 AS next_sort_order
FROM lineitem GROUP BY l_orderkey""")
def next_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: next line number per order."""
    from logmart.operators.rollup import next_ordinal as op
    return op(D.children(spark, sf_dir))


@register("full_coverage", f"""SELECT o.o_orderkey AS id, coalesce(m.ids, '') AS body_part_ids,
  coalesce(m.k, 0) >= 3 AS full_coverage
FROM orders o LEFT JOIN (
  SELECT l.l_orderkey, array_to_string(list_sort(list(DISTINCT n.n_regionkey)), ',') AS ids,
         count(DISTINCT n.n_regionkey) AS k
  FROM lineitem l {_REGION_OF_LINE} GROUP BY l.l_orderkey
) m ON m.l_orderkey = o.o_orderkey""")
def full_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 with a fixed threshold (3 regions), as the source fixes 7."""
    from logmart.operators.rollup import full_coverage as op
    f = op(D.headers(spark, sf_dir).select("id"), D.children(spark, sf_dir), D.bridge(spark, sf_dir), k=3,
           child_bridge_key="l_suppkey", bridge_child="s_suppkey")
    return f.withColumn("body_part_ids", F.array_join("body_part_ids", ","))


_SIBLING_SQL = f"""WITH c AS (SELECT {_KEY_ASC} FROM lineitem),
own AS (
  SELECT DISTINCT {", ".join("c." + k for k in D.LINE_KEY)}, b.word
  FROM c JOIN ({_WORD_BRIDGE_SQL}) b ON b.p_partkey = c.l_partkey
),
hw AS (SELECT l_orderkey, word, count(*) AS n FROM own GROUP BY l_orderkey, word),
ownagg AS (SELECT {_KEY_ASC}, string_agg(word, ',' ORDER BY word) AS own_ids FROM own GROUP BY ALL),
sib AS (
  SELECT {", ".join("c." + k for k in D.LINE_KEY)}, string_agg(hw.word, ',' ORDER BY hw.word) AS sibling_ids
  FROM c JOIN hw ON hw.l_orderkey = c.l_orderkey
  LEFT JOIN own o ON {" AND ".join(f"o.{k} = c.{k}" for k in D.LINE_KEY)} AND o.word = hw.word
  WHERE hw.n - (CASE WHEN o.word IS NULL THEN 0 ELSE 1 END) > 0
  GROUP BY ALL
)"""


@register("sibling_members", _SIBLING_SQL + f"""
SELECT {", ".join("c." + k for k in D.LINE_KEY)}, c.l_orderkey AS workout_id,
  coalesce(ownagg.own_ids, '') AS own_ids, coalesce(sib.sibling_ids, '') AS sibling_ids
FROM c
LEFT JOIN ownagg ON {" AND ".join(f"ownagg.{k} = c.{k}" for k in D.LINE_KEY)}
LEFT JOIN sib ON {" AND ".join(f"sib.{k} = c.{k}" for k in D.LINE_KEY)}""")
def sibling_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line, its own part-name words and the words of the other
    lines of the same order."""
    from logmart.operators.rollup import sibling_members as op
    s = op(D.children(spark, sf_dir), D.word_bridge(spark, sf_dir), child_id=D.LINE_KEY,
           child_bridge_key="l_partkey", bridge_child="p_partkey", bridge_member="word")
    return s.withColumn("own_ids", F.array_join("own_ids", ",")).withColumn(
        "sibling_ids", F.array_join("sibling_ids", ","))


@register("coverage_grid", f"""WITH c AS (SELECT {_KEY_ASC} FROM lineitem),
own AS (SELECT {", ".join("c." + k for k in D.LINE_KEY)}, m.mid, m.mname
        FROM c JOIN ({_REGION_MEMBER_SQL}) m ON m.s_suppkey = c.l_suppkey),
hw AS (SELECT l_orderkey, mid, any_value(mname) AS mname, count(*) AS n FROM own GROUP BY l_orderkey, mid)
SELECT {", ".join("c." + k for k in D.LINE_KEY)}, CAST(hw.mid AS INTEGER) AS member_id, hw.mname AS member_name,
  CAST(hw.mid AS INTEGER) AS member_sort, o.mid IS NOT NULL AS selected,
  hw.n - (CASE WHEN o.mid IS NULL THEN 0 ELSE 1 END) > 0 AS trained
FROM c JOIN hw ON hw.l_orderkey = c.l_orderkey
LEFT JOIN own o ON {" AND ".join(f"o.{k} = c.{k}" for k in D.LINE_KEY)} AND o.mid = hw.mid""")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line, every region that is selected (its own) or trained
    (covered by another line of the order)."""
    from logmart.operators.rollup import coverage_grid as op
    return op(D.members(spark, sf_dir), D.children(spark, sf_dir), D.bridge(spark, sf_dir),
              child_id=D.LINE_KEY, child_bridge_key="l_suppkey", bridge_child="s_suppkey")


@register("member_grid", f"""WITH c AS (SELECT {_KEY_ASC} FROM lineitem),
own AS (SELECT {", ".join("c." + k for k in D.LINE_KEY)}, m.mid
        FROM c JOIN ({_REGION_MEMBER_SQL}) m ON m.s_suppkey = c.l_suppkey),
hw AS (SELECT l_orderkey, mid, count(*) AS n FROM own GROUP BY l_orderkey, mid)
SELECT {", ".join("c." + k for k in D.LINE_KEY)},
  string_agg(r.r_name || ':' || CAST(o.mid IS NOT NULL AS INTEGER) || ':'
    || CAST(coalesce(hw.n, 0) - CASE WHEN o.mid IS NULL THEN 0 ELSE 1 END > 0 AS INTEGER), ',' ORDER BY r.r_regionkey) AS grid
FROM c CROSS JOIN region r
LEFT JOIN hw ON hw.l_orderkey = c.l_orderkey AND hw.mid = r.r_regionkey
LEFT JOIN own o ON {" AND ".join(f"o.{k} = c.{k}" for k in D.LINE_KEY)} AND o.mid = r.r_regionkey
GROUP BY {", ".join("c." + k for k in D.LINE_KEY)}""")
def member_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line the whole grid, every region with both flags."""
    from logmart.operators.rollup import member_grid as op
    out = op(D.members(spark, sf_dir), D.children(spark, sf_dir), D.bridge(spark, sf_dir),
             child_id=D.LINE_KEY, child_bridge_key="l_suppkey", bridge_child="s_suppkey")
    cell = lambda g: F.concat_ws(":", g["member_name"], g["selected"].cast("int"), g["trained"].cast("int"))
    return out.select(*D.LINE_KEY, F.array_join(F.transform("grid", cell), ",").alias("grid"))


AS_OF = "2026-01-22 12:00:00"


@register("header_summary", f"""WITH h AS ({D.HEADERS_SQL})
SELECT h.id, c.c_name AS gym_name,
  CAST(floor(date_diff('second', h.started_at, coalesce(h.finished_at, TIMESTAMP '{AS_OF}')) / 60) AS BIGINT) AS minutes,
  CAST(coalesce(k0.n, 0) AS BIGINT) AS exercise_count, coalesce(k.names, '') AS member_names
FROM h JOIN customer c ON c.c_custkey = h.gym_id
LEFT JOIN (SELECT l.l_orderkey, count(*) AS n FROM lineitem l GROUP BY l.l_orderkey) k0 ON k0.l_orderkey = h.id
LEFT JOIN (
  SELECT l_orderkey, string_agg(r_name, ', ' ORDER BY r_regionkey) AS names FROM (
    SELECT DISTINCT l.l_orderkey, r.r_regionkey, r.r_name
    FROM lineitem l {_REGION_OF_LINE} JOIN region r ON r.r_regionkey = n.n_regionkey) d
  GROUP BY l_orderkey
) k ON k.l_orderkey = h.id""")
def header_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the customer, minutes (to finish, else to the as-of
    time), line count and the names of the regions covered."""
    from logmart.operators.rollup import header_summary as op
    return op(D.headers(spark, sf_dir), D.dims(spark, sf_dir), D.children(spark, sf_dir), D.bridge(spark, sf_dir),
              D.members(spark, sf_dir), as_of=AS_OF, child_bridge_key="l_suppkey", bridge_child="s_suppkey")


# ------------------------------------------------------------- F*, D1, S2, S3
@register("history_labels", f"""WITH h AS ({D.HEADERS_SQL})
SELECT id, strftime(started_at, '%-d. %-m. %Y') AS date_label, strftime(started_at, '%H:%M') AS time_label,
  CAST(floor(date_diff('second', started_at, coalesce(finished_at, TIMESTAMP '{AS_OF}')) / 60) AS BIGINT) AS minutes,
  CASE WHEN finished_at IS NULL THEN NULL ELSE
    CAST(floor(date_diff('second', started_at, finished_at) / 60) AS BIGINT) || ':' ||
    lpad(CAST(date_diff('second', started_at, finished_at) % 60 AS VARCHAR), 2, '0') END AS elapsed_label
FROM h""")
def history_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date/time labels, minutes and m:ss of every order."""
    from logmart.functions.labels import cz_date, cz_time, elapsed_label, seconds_between, session_minutes
    h = D.headers(spark, sf_dir)
    return h.select(
        "id", cz_date("started_at").alias("date_label"), cz_time("started_at").alias("time_label"),
        session_minutes("started_at", "finished_at", F.lit(AS_OF).cast("timestamp_ntz")).alias("minutes"),
        F.when(F.col("finished_at").isNotNull(),
               elapsed_label(seconds_between("started_at", "finished_at"))).alias("elapsed_label"))


@register("last_value_labels", f"""SELECT name, CASE WHEN max_weight IS NULL THEN '' ELSE
  CAST(max_weight AS VARCHAR) || ' kg' END AS weight_label,
  CASE WHEN max_weight IS NULL THEN NULL ELSE 'Last time: ' || CAST(max_weight AS VARCHAR) || ' kg (' ||
  strftime(last_date, '%-d. %-m. %Y') || ')' END AS last_label
FROM ({_LATEST_SQL}) t""")
def last_value_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weight label and last-value label of every L1 row."""
    from logmart.functions.labels import last_value_label, weight_label
    return _latest(spark, sf_dir).select(
        "name", weight_label("max_weight").alias("weight_label"),
        last_value_label("max_weight", "last_date").alias("last_label"))


_NUM = r"'^[ \t\n\r\x0b\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)'"


def _php_int_sql(x: str) -> str:
    p = f"regexp_extract({x}, {_NUM}, 1)"
    return (f"coalesce(CASE WHEN regexp_matches({p}, '^[+-]?[0-9]{{1,18}}$') THEN TRY_CAST({p} AS BIGINT) END, "
            f"TRY_CAST(trunc(TRY_CAST(nullif({p}, '') AS DOUBLE)) AS BIGINT), 0)")


def _weight_sql(x: str) -> str:
    p = f"regexp_extract({x}, {_NUM}, 1)"
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
            f"ELSE TRY_CAST(TRY_CAST(CASE WHEN {p} = '' THEN '0' ELSE {p} END AS DOUBLE) AS DECIMAL(6,2)) END")


_PHP_TRIM_SQL = "trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11))"


@register("coerce_requests", f"""WITH r AS (
  SELECT event_id, json_extract_string(props, '$.k') AS k_text,
         '  ' || CAST(user_id AS VARCHAR) || 'x' || chr(9) AS user_text,
         CAST(CAST(value * 1000 AS DECIMAL(12,2)) AS VARCHAR) AS value_text, event_type
  FROM events)
SELECT event_id, {_php_int_sql('k_text')} AS k_int, {_weight_sql('k_text')} AS k_weight,
  {_php_int_sql('user_text')} AS user_int, {_PHP_TRIM_SQL.format(x='user_text')} AS user_trim,
  {_weight_sql('value_text')} AS value_weight,
  value_text IS NOT NULL AND value_text <> '' AND {_weight_sql('value_text')} IS NULL AS value_rejected,
  {_php_int_sql('event_type')} AS type_int,
  CASE WHEN {_PHP_TRIM_SQL.format(x='event_type')} IN ('', '0') THEN NULL
       ELSE {_PHP_TRIM_SQL.format(x='event_type')} END AS type_or_null
FROM r""")
def coerce_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PHP trim, ``?: null``, ``(int)`` and weight coercion over
    request-like text derived from the events."""
    from logmart.functions.coerce import empty_to_null, php_int, php_trim, weight_out_of_range, weight_value
    e = D.table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k_text"),
        F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit("x\t")).alias("user_text"),
        (F.col("value") * 1000).cast("decimal(12,2)").cast("string").alias("value_text"), "event_type")
    return e.select(
        "event_id", php_int("k_text").alias("k_int"), weight_value("k_text").alias("k_weight"),
        php_int("user_text").alias("user_int"), php_trim("user_text").alias("user_trim"),
        weight_value("value_text").alias("value_weight"), weight_out_of_range("value_text").alias("value_rejected"),
        php_int("event_type").alias("type_int"), empty_to_null("event_type").alias("type_or_null"))


@register("pg_arrays", """SELECT p_partkey,
  CASE WHEN t IS NULL OR t = '{}' THEN '' ELSE
    array_to_string(list_transform(string_split(trim(t, '{}'), ','), lambda e: trim(e, '"')), '|') END AS text_items,
  array_to_string(list_transform(string_split(trim(i, '{}'), ','), lambda e: CAST(e AS INTEGER)), '|') AS int_items,
  CASE WHEN q IS NULL OR q = '{}' THEN '' ELSE
    array_to_string(list_transform(string_split(trim(q, '{}'), ','), lambda e: trim(e, '"')), '|') END AS quoted_items
FROM (SELECT p_partkey, '{' || replace(p_name, ' ', ',') || '}' AS t,
             '{' || p_size || ',' || p_partkey || '}' AS i,
             '{"' || p_brand || '",' || p_type || '}' AS q FROM part) x""")
def pg_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PostgreSQL array text (built from part columns) parsed
    back into arrays, rendered as text."""
    from logmart.sources.io import pg_int_array, pg_text_array
    p = D.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("{"), F.regexp_replace("p_name", " ", ","), F.lit("}")).alias("t"),
        F.concat(F.lit("{"), F.col("p_size").cast("string"), F.lit(","), F.col("p_partkey").cast("string"),
                 F.lit("}")).alias("i"),
        F.concat(F.lit('{"'), F.col("p_brand"), F.lit('",'), F.col("p_type"), F.lit("}")).alias("q"))
    return p.select("p_partkey", F.array_join(pg_text_array("t"), "|").alias("text_items"),
                    F.array_join(pg_int_array("i"), "|").alias("int_items"),
                    F.array_join(pg_text_array("q"), "|").alias("quoted_items"))


# ------------------------------------------------------------- I1
def _driver_rules():
    from logmart.operators.audit import fk, max_length, not_null, numeric, unique
    return [
        unique("orders", "o_orderkey"), not_null("orders", "o_custkey"),
        fk("orders", "o_custkey", "customer", "c_custkey"),
        unique("lineitem", "l_orderkey", "l_linenumber"),
        fk("lineitem", "l_orderkey", "orders", "o_orderkey"), fk("lineitem", "l_partkey", "part", "p_partkey"),
        fk("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        numeric("lineitem", "l_quantity", 6, 2), numeric("lineitem", "l_extendedprice", 6, 2),
        not_null("lineitem", "l_shipdate"),
        max_length("customer", "c_name", 100), fk("customer", "c_nationkey", "nation", "n_nationkey"),
        max_length("part", "p_name", 10), unique("part", "p_partkey"),
        fk("supplier", "s_nationkey", "nation", "n_nationkey"), fk("nation", "n_regionkey", "region", "r_regionkey"),
    ]


def _rule_sql(r) -> str:
    head = f"SELECT '{r.table}' AS tbl, '{r.kind}' AS rule, '{r.label}' AS cols, CAST(count(*) AS BIGINT) AS violations"
    c = r.cols[0]
    if r.kind == "not_null":
        return f"{head} FROM {r.table} WHERE {c} IS NULL"
    if r.kind == "max_length":
        return f"{head} FROM {r.table} WHERE {c} IS NOT NULL AND length({c}) > {r.arg}"
    if r.kind == "numeric":
        p, s = r.arg
        return f"{head} FROM {r.table} WHERE {c} IS NOT NULL AND abs(round({c}, {s})) >= {10 ** (p - s)}"
    if r.kind == "unique":
        return f"{head} FROM (SELECT {r.label} FROM {r.table} GROUP BY {r.label} HAVING count(*) > 1) d"
    parent, pcols = r.arg
    cond = " AND ".join(f"p.{pc} = t.{cc}" for pc, cc in zip(pcols, r.cols))
    return (f"{head} FROM {r.table} t WHERE {' AND '.join(f't.{cc} IS NOT NULL' for cc in r.cols)} "
            f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {cond})")


@register("integrity_audit", "\nUNION ALL\n".join(_rule_sql(r) for r in _driver_rules()))
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared-constraint audit of the driver tables (keys, foreign
    keys, lengths, numeric ranges)."""
    from logmart.operators.audit import audit
    names = ["orders", "lineitem", "customer", "part", "supplier", "nation", "region"]
    return audit({n: D.table(spark, sf_dir, n) for n in names}, _driver_rules())


# ------------------------------------------------------------- K1
LOCK_WINDOW, LOCK_MAX = 86400, 3  # sparse events: 24 h window, 3 failures

_LOCKOUT_SQL = f"""WITH RECURSIVE a AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id AS attempt_id, ts,
         CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS kind,
         CAST(floor(epoch(ts)) AS BIGINT) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type IN ('error', 'signup')
),
r AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS attempt_id, CAST(NULL AS TIMESTAMP) AS ts,
         CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS outcome, CAST([] AS BIGINT[]) AS state
  FROM (SELECT DISTINCT key FROM a) k
  UNION ALL
  SELECT a.key, a.rn, a.attempt_id, a.ts, a.kind,
    CASE WHEN len(list_filter(r.state, lambda x: x > a.t - {LOCK_WINDOW})) >= {LOCK_MAX} THEN 'blocked'
         WHEN a.kind = 'success' THEN 'ok' ELSE 'invalid' END,
    CASE WHEN len(list_filter(r.state, lambda x: x > a.t - {LOCK_WINDOW})) >= {LOCK_MAX}
           THEN list_filter(r.state, lambda x: x > a.t - {LOCK_WINDOW})
         WHEN a.kind = 'success' THEN CAST([] AS BIGINT[])
         ELSE list_append(list_filter(r.state, lambda x: x > a.t - {LOCK_WINDOW}), a.t) END
  FROM r JOIN a ON a.key = r.key AND a.rn = r.rn + 1
)
SELECT key, attempt_id, ts, kind, outcome FROM r WHERE rn > 0"""


@register("lockout", _LOCKOUT_SQL)
def lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 (batch): lockout outcome of every login-like event (error =
    failure, signup = success) per user."""
    from logmart.operators.lockout import lockout as op
    return op(D.attempts(spark, sf_dir), max_attempts=LOCK_MAX, window=LOCK_WINDOW)


# ------------------------------------------------------------- C1 .. C8
def _applied(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from logmart.operators.changes import apply_changes, empty_tables
    from logmart.plans.driver_log import change_log
    gyms = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    parts = D.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    return apply_changes(empty_tables(spark, gyms, parts), change_log(spark, sf_dir))


def _final_sql(select: str) -> str:
    from logmart.plans.driver_log import FINAL_SQL
    return FINAL_SQL + "\n" + select


@register("apply_changes_outcomes", _final_sql("SELECT CAST(seq AS BIGINT) AS seq, op, outcome FROM outcomes"))
def apply_changes_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + C8: verdict of every request of the replayed log."""
    return _applied(spark, sf_dir)["outcomes"].select("seq", "op", "outcome")


@register("apply_changes_headers", _final_sql(
    "SELECT CAST(id AS BIGINT) AS id, CAST(gym_id AS BIGINT) AS gym_id, started_at, finished_at FROM headers"))
def apply_changes_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 + C7 + C6 inside C8: headers after the log."""
    return _applied(spark, sf_dir)["workouts"].select("id", "gym_id", "started_at", "finished_at")


@register("apply_changes_children", _final_sql(
    "SELECT CAST(id AS BIGINT) AS id, CAST(workout_id AS BIGINT) AS workout_id, name, machine, max_weight, "
    "sort_order FROM children"))
def apply_changes_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 + C5 + C6 inside C8: children after the log."""
    return _applied(spark, sf_dir)["exercises"].select("id", "workout_id", "name", "machine", "max_weight",
                                                      "sort_order")


@register("apply_changes_bridge", _final_sql(
    "SELECT CAST(exercise_id AS BIGINT) AS exercise_id, body_part_id FROM bridge"))
def apply_changes_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + C5 + C6 inside C8: member rows after the log."""
    return _applied(spark, sf_dir)["exercise_body_parts"].select("exercise_id", "body_part_id")


def _with_members(children: DataFrame, bridge: DataFrame) -> DataFrame:
    ids = bridge.groupBy(F.col("exercise_id").alias("id")).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list("body_part_id")), lambda x: x.cast("string")), ",").alias("members"))
    return children.join(ids, "id", "left").select("id", "workout_id", "name", "max_weight", "sort_order",
                                                   F.coalesce("members", F.lit("")).alias("members"))


def _interleaved(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from logmart.operators.changes import apply_changes
    from logmart.plans.driver_log import interleaved_base, interleaved_log
    return apply_changes(interleaved_base(spark, sf_dir), interleaved_log(spark, sf_dir))


def _driver_log_sql(name: str) -> str:
    from logmart.plans import driver_log
    return getattr(driver_log, name)


@register("apply_interleaved_children", _driver_log_sql("INTERLEAVED_CHILDREN"))
def apply_interleaved_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 on tables that hold all orders and lines: adds after deletes,
    headers deleted and created again, an id used again; children with their
    members."""
    t = _interleaved(spark, sf_dir)
    return _with_members(t["exercises"], t["exercise_body_parts"])


@register("apply_interleaved_outcomes", _driver_log_sql("INTERLEAVED_OUTCOMES"))
def apply_interleaved_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the interleaved log."""
    return _interleaved(spark, sf_dir)["outcomes"].select("seq", "outcome")


# ------------------------------------------------------- S1, S4, S5, T1, J7, C3, C9, C10, C11
@register("read_declared", """SELECT r_name AS region, count(*) AS nations, string_agg(n_name, ',' ORDER BY n_nationkey) AS names
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def read_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read with declared schemas."""
    from pyspark.sql import types as T

    from logmart.sources.io import read_tables
    of = lambda ddl: T.StructType.fromDDL(ddl)
    t = read_tables(spark, sf_dir, {"region": of("r_regionkey int, r_name string"),
                                    "nation": of("n_nationkey int, n_name string, n_regionkey int")})
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).groupBy(
        F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("nations"), F.array_join(names, ",").alias("names"))


@register("json_round_trip", f"""WITH h AS ({D.HEADERS_SQL})
SELECT id, gym_id, started_at, finished_at, notes, finished_at IS NULL AS open FROM h""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written as JSON lines and read back; the key of a NULL is
    in the text."""
    import uuid

    from logmart.session import scratch_path
    from logmart.sources.io import write_json
    h = D.headers(spark, sf_dir)
    path = scratch_path(spark, f"json-{uuid.uuid4().hex}")
    write_json(h, path)
    back = F.from_json("value", h.schema.simpleString())
    return spark.read.text(path).select(
        back.alias("h"), F.col("value").contains('"finished_at":null').alias("open")).select("h.*", "open")


@register("read_change_log", _final_sql("SELECT op, count(*) AS n, CAST(min(seq) AS BIGINT) AS first, "
                                        "CAST(max(seq) AS BIGINT) AS last FROM outcomes GROUP BY op"))
def read_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replayed log written as JSON lines, read with the declared
    schema, its requests decoded."""
    import uuid

    from logmart.plans.driver_log import change_log
    from logmart.session import scratch_path
    from logmart.sources.io import parse_payload, read_changes, write_json
    path = scratch_path(spark, f"log-{uuid.uuid4().hex}")
    write_json(change_log(spark, sf_dir), path)
    log = read_changes(spark, path).withColumn("p", parse_payload("payload"))
    return log.where("p is not null").groupBy("op").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


@register("quarantined_lines", _final_sql(f"""SELECT 'change' AS kind, op AS line, count(*) AS n FROM outcomes GROUP BY op
UNION ALL SELECT 'quarantined', props, count(*) FROM events GROUP BY props"""))
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's lines among lines of another kind (the events' text);
    the latter are set aside as they are."""
    import uuid

    from logmart.plans.driver_log import change_log
    from logmart.session import scratch_path
    from logmart.sources.io import read_requests, write_json
    path = scratch_path(spark, f"requests-{uuid.uuid4().hex}")
    write_json(change_log(spark, sf_dir), path)
    D.table(spark, sf_dir, "events").select("props").write.mode("append").text(path, compression="gzip")
    good, bad = read_requests(spark, path)
    return good.groupBy(F.lit("change").alias("kind"), F.col("op").alias("line")).count().unionByName(
        bad.groupBy(F.lit("quarantined").alias("kind"), "line").count()).withColumnRenamed("count", "n")


@register("deep_page", """SELECT row_number() OVER w AS rank, o_orderkey AS id, o_orderdate AS started_at
FROM orders WINDOW w AS (ORDER BY o_orderdate DESC, o_orderkey DESC)
QUALIFY row_number() OVER w BETWEEN 1001 AND 1050""")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 headers at offset 1000, newest first, by distributed selection."""
    from logmart.operators.listing import deep_page as op
    h = D.headers(spark, sf_dir).select("id", "started_at")
    return op(h, "started_at", "id", 50, 1000, few=200).select("rank", "id", "started_at")


@register("page_of_dimension", """SELECT row_number() OVER w AS rank, c_custkey AS id, c_name AS name
FROM customer WINDOW w AS (ORDER BY c_nationkey, c_custkey) QUALIFY row_number() OVER w BETWEEN 31 AND 50""")
def page_of_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a listing."""
    from logmart.operators.listing import page
    return page(D.dims(spark, sf_dir), [F.asc_nulls_last("sort_order"), F.asc("id")], 20, 30).select("rank", "id", "name")


@register("resolve_names", f"""WITH k AS (SELECT min(p_partkey) AS id, p_name FROM part GROUP BY p_name)
SELECT {_KEY_ASC}, k.id AS resolved_id FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN k USING (p_name)""")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's part name resolved to a key."""
    from logmart.operators.listing import resolve_keys
    parts = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    ok, _ = resolve_keys(D.children(spark, sf_dir, with_name=True), parts, name_col="name")
    return ok.select(*D.LINE_KEY, "resolved_id")


@register("append_children", f"""WITH b AS (SELECT o_orderkey AS h, coalesce(max(l_linenumber), 0) AS top
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT {10 ** 12} + event_id AS id, h AS workout_id,
  CAST(top + row_number() OVER (PARTITION BY h ORDER BY ts, event_id) AS INTEGER) AS sort_order
FROM events JOIN b ON h = user_id""")
def append_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event appended, in order of time, to the header that has its
    user's number; next ordinals after the lines that are there."""
    from logmart.operators.changes import append_children as op
    base = D.table(spark, sf_dir, "lineitem").select(
        F.lit(-1).cast("long").alias("id"), F.col("l_orderkey").alias("workout_id"), F.lit("line").alias("name"),
        F.lit(None).cast("string").alias("machine"), F.lit(None).cast("decimal(6,2)").alias("max_weight"),
        F.col("l_linenumber").alias("sort_order"), F.col("l_shipdate").alias("created_at"))
    e = D.table(spark, sf_dir, "events").join(
        D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("user_id")), "user_id", "left_semi")
    adds = e.select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").cast("long").alias("h"),
                    (F.col("event_id") + 10 ** 12).alias("cid"), "ts", F.col("event_type").alias("name"),
                    F.lit(None).cast("string").alias("machine"), F.lit(None).cast("decimal(6,2)").alias("max_weight"))
    return op(base, adds).where("id >= 0").select("id", "workout_id", "sort_order")


@register("fk_to_bridge", """SELECT s_suppkey AS exercise_id, s_nationkey AS body_part_id FROM supplier
WHERE s_nationkey IS NOT NULL""")
def fk_to_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' nation column moved into a bridge table."""
    from logmart.operators.changes import fk_to_bridge as op
    return op(D.table(spark, sf_dir, "supplier"), key="s_suppkey", fk="s_nationkey")[1]


@register("keyed_update", """SELECT c.c_custkey, c.c_name,
  CASE WHEN o.k IS NULL THEN c.c_mktsegment WHEN o.n > 15 THEN NULL ELSE 'active' END AS c_mktsegment
FROM customer c LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.k = c.c_custkey""")
def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of every customer with orders set to 'active', to
    NULL beyond 15 orders."""
    from logmart.operators.changes import keyed_update as op
    new = D.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.when(F.count(F.lit(1)) > 15, F.lit(None).cast("string")).otherwise("active").alias("c_mktsegment"))
    return op(D.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", new)


@register("append_rows", """SELECT r_regionkey AS id, r_name AS name, CAST(NULL AS INTEGER) AS sort_order FROM region
UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation""")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: reference rows appended; a missing column is NULL."""
    from logmart.operators.changes import append_rows as op
    nations = D.table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("sort_order"))
    regions = D.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return op(nations, regions).select("id", "name", "sort_order")


# ------------------------------------------------------------- K1 / K2 streams
@register("lockout_stream", _LOCKOUT_SQL)
def lockout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 (stream): the events file as a stream through the stateful
    lockout (applyInPandasWithState); same outcomes as the batch fold."""
    from logmart.streaming.changes_stream import run_available_now
    from logmart.streaming.lockout_stream import lockout_stream as op
    schema = D.table(spark, sf_dir, "events").schema
    ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    att = ev.where(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("attempt_id"), "ts",
        F.when(F.col("event_type") == "error", "fail").otherwise("success").alias("kind"))
    return run_available_now(op(att, max_attempts=LOCK_MAX, window=LOCK_WINDOW), "lockout_stream")


def _streamed(spark: SparkSession, base, log: DataFrame, cuts: list[int]) -> str:
    """The log arriving in pieces, each applied as one micro-batch of the
    continuous job; the folder of its change set."""
    import uuid

    from logmart import schemas as S
    from logmart.session import discard, scratch_path, stored, tidy
    from logmart.sources.io import write_json
    from logmart.streaming.changes_stream import stream_changes
    run = scratch_path(spark, f"stream_changes-{uuid.uuid4().hex[:12]}")
    log = stored(log, "log")            # made once, each piece is a range of it
    for lo, hi in zip(cuts, cuts[1:]):
        tidy(log.where((F.col("seq") >= lo) & (F.col("seq") < hi)), lambda x: write_json(x, f"{run}/log", mode="append"))
        stream = spark.readStream.schema(S.CHANGES).json(f"{run}/log")
        q = stream_changes(stream, base, f"{run}/tables", f"{run}/ckpt", available_now=True)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    discard(log)
    return f"{run}/tables"


@register("stream_changes_children", _final_sql(
    "SELECT CAST(id AS BIGINT) AS id, CAST(workout_id AS BIGINT) AS workout_id, name, machine, max_weight, "
    "sort_order FROM children"))
def stream_changes_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the replayed log arriving in three micro-batches through
    foreachBatch change sets ends in the same children as the batch C8."""
    from logmart.operators.changes import empty_tables
    from logmart.plans.driver_log import PHASE, change_log
    from logmart.streaming.changes_stream import read_latest
    gyms = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    parts = D.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    base = empty_tables(spark, gyms, parts)
    out = _streamed(spark, base, change_log(spark, sf_dir), [0, 2 * PHASE, 5 * PHASE, 7 * PHASE])
    return read_latest(spark, out, base).exercises.select("id", "workout_id", "name", "machine", "max_weight", "sort_order")


@register("stream_interleaved_children", _driver_log_sql("INTERLEAVED_CHILDREN"))
def stream_interleaved_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 from tables that aren't empty: the interleaved log in three
    micro-batches; children with their members."""
    from dataclasses import fields, replace

    from logmart.plans.driver_log import PHASE, interleaved_base, interleaved_log
    from logmart.streaming.changes_stream import read_latest
    from logmart.session import stored
    b = interleaved_base(spark, sf_dir)
    # every batch reads the tables several times: they are made once
    base = replace(b, **{f.name: stored(getattr(b, f.name), f.name) for f in fields(b)})
    out = _streamed(spark, base, interleaved_log(spark, sf_dir), [0, 3 * PHASE, 5 * PHASE, 8 * PHASE])
    t = read_latest(spark, out, base)
    return _with_members(t.exercises, t.exercise_body_parts)
