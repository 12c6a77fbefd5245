"""Latest value per key and term search.

L1 latest_per_key / latest_values, L2 search_latest, L3 last_value_for,
L4 active_header.

Scale notes
-----------
* L1 is one ``max_by`` aggregation over ``struct(order...)``: a map-side
  partial step keeps at most one row per key per task, so a key holding a
  third of the rows costs no more shuffle than any other key. A NULL
  payload is kept (the struct wrapping it is not NULL).
* L2 matches terms against the L1 result (one row per key), never raw
  children, through an exact n-gram equi-join: every name matching a
  term contains each literal bigram of the term, so the term is joined
  on its rarest bigram (or character) to the names holding it and then
  checked with the real predicate. Terms made only of wildcards join on
  their underscore count; no product of the two sides is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logmart.functions.coerce import php_trim
from logmart.operators.common import fits, keys
from logmart.schemas import SEARCH_LIMIT, SEARCH_MIN_LEN
from logmart.session import ensure_checkpoint_dir

# Wildcard-only terms per search batch that may be broadcast as predicates.
TERM_BROADCAST_LIMIT = 100_000


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str],
                   payload: Sequence[str]) -> DataFrame:
    """L1 (``DISTINCT ON (key) ... ORDER BY key, order DESC``): one row per
    key carrying ``payload`` from the row with the greatest ``order``
    tuple. Ties must be broken inside ``order`` (end it with unique ids)."""
    k = keys(key)
    best = F.max_by(F.struct(*[F.col(p) for p in payload]), F.struct(*[F.col(o) for o in order]))
    return df.groupBy(*k).agg(best.alias("_best")).select(*k, *[F.col(f"_best.{p}").alias(p) for p in payload])


def latest_values(children: DataFrame, headers: DataFrame, *, name: str = "name",
                  value: str = "max_weight", child_id: str | Sequence[str] = "id",
                  child_fk: str = "workout_id", header_id: str = "id",
                  started: str = "started_at") -> DataFrame:
    """L1 for the log model: per child name, the value recorded in the most
    recent header (``started_at``, then header id, then child id), with
    ``last_date`` and the header id. Names are case-sensitive keys."""
    ids = keys(child_id)
    h = headers.select(F.col(header_id).alias("_hid"), F.col(started).alias("last_date"))
    j = children.select(name, value, child_fk, *[c for c in ids if c not in (name, value, child_fk)]).join(
        h, F.col(child_fk) == F.col("_hid"))
    order = ["last_date", child_fk, *[c for c in ids if c != child_fk]]
    out = latest_per_key(j, name, order, [value, "last_date", child_fk])
    return out.withColumnRenamed(child_fk, "workout_id") if child_fk != "workout_id" else out


def clean_terms(terms: DataFrame, term: str = "term", min_len: int = SEARCH_MIN_LEN) -> DataFrame:
    """Client rules: trim (PHP set), drop blank and terms shorter than
    ``min_len`` characters. A repeated term is one term."""
    t = terms.select(F.col(term).alias("term"), php_trim(F.col(term)).alias("_q"))
    return t.where((F.col("_q") != "") & (F.char_length("_q") >= F.lit(min_len))).distinct()


def pg_escapes(q: Column) -> Column:
    """PostgreSQL reads ``\\x`` as a literal x for any x; Spark accepts an
    escape only before %, _ or itself. Escape pairs are consumed left to
    right: ``\\`` + ordinary char loses its backslash, escaped %, _ and
    backslash stay as they are."""
    return F.regexp_replace(q, r"\\([^%_\\])|(\\[%_\\])", "$1$2")


def _pattern(q: Column, mode: str) -> Column:
    if mode == "pattern":
        # PostgreSQL treats '\x' as a literal x; Spark only accepts an escape
        # before %, _ or itself, so drop the backslash before other chars.
        return F.concat(F.lit("%"), pg_escapes(q), F.lit("%"))
    return q


def _matches(name: Column, q: Column, mode: str) -> Column:
    if mode == "pattern":
        return F.ilike(name, _pattern(q, mode))
    if mode == "literal":
        return F.contains(F.lower(name), F.lower(q))
    raise ValueError(f"unknown mode {mode!r}")


def _grams(runs: Column, n: int) -> Column:
    """All n-grams of every string in ``runs``."""
    return F.flatten(F.transform(runs, lambda r: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(r) - (n - 1), F.lit(1))),
                 lambda i: i <= F.char_length(r) - (n - 1)),
        lambda i: F.substring(r, i, n))))


# Private-use characters standing in for escaped %, _ and backslash while a
# pattern is split at its wildcards (terms containing them are matched
# without the index).
_ESC = {"%": "\ue000", "_": "\ue001", "\\": "\ue002"}


def _literal_runs(q: Column, mode: str) -> Column:
    """Pieces of the lower-cased term that every match must contain
    literally. In pattern mode the whole pattern ``'%' || term || '%'`` is
    split at its wildcards; escaped wildcards and backslashes stay in the
    pieces as literal characters (a trailing backslash escapes the final
    ``%``)."""
    x = F.lower(q)
    if mode == "literal":
        return F.array(x)
    pat = F.concat(F.lit("%"), pg_escapes(x), F.lit("%"))
    # after pg_escapes every backslash starts a pair with %, _ or itself
    pat = F.regexp_replace(pat, r"\\\\", _ESC["\\"])
    pat = F.regexp_replace(pat, r"\\%", _ESC["%"])
    pat = F.regexp_replace(pat, r"\\_", _ESC["_"])
    runs = F.split(pat, "[%_]")
    return F.transform(runs, lambda r: F.translate(r, "".join(_ESC.values()), "".join(_ESC.keys())))


def _indexed_candidates(latest: DataFrame, terms: DataFrame, name: str, mode: str) -> DataFrame:
    """Exact term/name matches through equi-joins, never a product of the
    two sides:

    * a term with a literal bigram (or character) joins on its rarest one
      to the names holding that gram; the real predicate then checks the
      candidate pairs;
    * a term made only of ``%`` and ``_`` matches exactly the names with at
      least as many characters as it has ``_``: names are expanded once per
      length threshold up to the largest such count (measured first) and
      joined on it.

    Only a term containing the private-use stand-in characters themselves
    is checked as a predicate, with those few terms broadcast after a
    bounded count."""
    low = F.lower(F.col(name))
    names = latest.select(name).distinct()
    ngrams = names.select(name, F.explode(F.array_distinct(F.concat(
        _grams(F.array(low), 2), _grams(F.array(low), 1)))).alias("_g"))
    freq = ngrams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    odd = F.col("_q").rlike("[" + "".join(_ESC.values()) + "]")
    runs = _literal_runs(F.col("_q"), mode)
    bi, uni = _grams(runs, 2), _grams(runs, 1)
    t = terms.withColumn("_cand", F.when(odd, F.array().cast("array<string>"))
                         .when(F.size(bi) > 0, bi).otherwise(uni))
    indexed = t.where(F.size("_cand") > 0)
    tg = indexed.select("term", "_q", F.explode(F.array_distinct("_cand")).alias("_g"))
    chosen = tg.join(freq, "_g", "left").groupBy("term", "_q").agg(
        F.min_by("_g", F.coalesce(F.col("_n"), F.lit(0))).alias("_g"))
    hits = (chosen.join(ngrams, "_g").drop("_g").join(latest, name)
            .where(_matches(F.col(name), F.col("_q"), mode)))
    rest = t.where(F.size("_cand") == 0).drop("_cand")
    if rest.limit(1).count() == 0:
        return hits
    wild = rest.where(~odd).withColumn("_nu", F.char_length(F.regexp_replace("_q", "%", "")))
    max_nu = wild.agg(F.max("_nu")).first()[0]
    if max_nu is not None:
        by_len = latest.withColumn("_nu", F.explode(F.sequence(
            F.lit(0), F.least(F.char_length(name), F.lit(int(max_nu))))))
        hits = hits.unionByName(by_len.join(wild, "_nu").drop("_nu")
                                .where(_matches(F.col(name), F.col("_q"), mode)))
    other = rest.where(odd)
    if other.limit(1).count() == 0:
        return hits
    if not fits(other, TERM_BROADCAST_LIMIT):
        raise ValueError("too many search terms containing private-use characters")
    return hits.unionByName(latest.join(F.broadcast(other), _matches(F.col(name), F.col("_q"), mode)))


def search_latest(latest: DataFrame, terms: DataFrame, *, term: str = "term", name: str = "name",
                  k: int | None = SEARCH_LIMIT, min_len: int = SEARCH_MIN_LEN,
                  mode: str = "pattern", collation: str | None = None) -> DataFrame:
    """L2: for each search term, up to ``k`` L1 rows whose name matches
    ``ILIKE '%term%'`` in name order, with ``rank`` 1..k.

    ``mode='pattern'`` keeps the user's ``%``/``_`` wildcards active as the
    source application does; ``mode='literal'`` matches the text as is.
    ``min_len`` applies the client's rule (terms under 2 characters are
    not searched); pass 1 to search every non-blank term like the server.
    Names are ranked in binary order unless ``collation`` names a Spark
    collation (e.g. ``"cs"`` puts ``č`` after ``c``).
    Matching goes through an n-gram equi-join (``_indexed_candidates``), so
    neither side is ever paired with all of the other.
    """
    t = clean_terms(terms, term, min_len)
    # L1 feeds the index, the candidates and the wildcard branch: compute
    # it once (one row per key) and cut the lineage there
    ensure_checkpoint_dir(latest.sparkSession)
    latest = latest.checkpoint(eager=True)
    pairs = _indexed_candidates(latest, t, name, mode)
    by = F.col(name) if collation is None else F.collate(F.col(name), collation)
    w = Window.partitionBy("term").orderBy(by.asc(), F.col(name).asc())
    ranked = pairs.withColumn("rank", F.row_number().over(w).cast("long"))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.drop("_q")


def last_value_for(latest: DataFrame, terms: DataFrame, *, term: str = "term", name: str = "name",
                   value: str = "max_weight", k: int = SEARCH_LIMIT, min_len: int = SEARCH_MIN_LEN,
                   mode: str = "pattern", collation: str | None = None) -> DataFrame:
    """L3: per term, the first of its (at most ``k``) search hits whose name
    equals the term case-insensitively; nothing when that hit's value is
    NULL (the client hides an empty last value)."""
    hits = search_latest(latest, terms, term=term, name=name, k=k, min_len=min_len, mode=mode,
                         collation=collation)
    exact = hits.where(F.lower(F.col(name)) == F.lower(php_trim(F.col("term"))))
    w = Window.partitionBy("term").orderBy("rank")
    first = exact.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    return first.where(F.col(value).isNotNull())


def active_header(headers: DataFrame, *, partition: str | Sequence[str] | None = None,
                  header_id: str = "id", started: str = "started_at",
                  finished: str = "finished_at") -> DataFrame:
    """L4: the newest header (by ``started_at``, then id) overall or per
    ``partition``, returned only if it is unfinished. An older unfinished
    header behind a finished one is ignored."""
    cols = [c for c in headers.columns]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(started), F.col(header_id)))
    if partition is None:
        newest = headers.agg(best.alias("_b"))
        out = newest.select("_b.*")
    else:
        p = keys(partition)
        out = headers.groupBy(*[F.col(c).alias(f"_p_{c}") for c in p]).agg(best.alias("_b")).select("_b.*")
    return out.where(F.col(finished).isNull())

