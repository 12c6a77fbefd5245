"""Integrity audit for what a relational schema enforces and Parquet
does not: NOT NULL, varchar length, numeric(p,s) range, primary-key
uniqueness and foreign-key existence.

``audit(tables, rules)`` returns one row per rule: ``tbl, rule, cols,
violations``; ``audit_rows`` returns the offending rows of one rule.

Plan shape: all column rules of a table are evaluated in **one**
aggregation pass over that table (conditional counts, then ``unpivot``
into rows); each key rule is one partially aggregated ``groupBy``; each
foreign key counts child rows per key value first (partial aggregation)
and anti-joins only those distinct values to the parent's keys (AQE
broadcasts the smaller side when it can measure it).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmart.operators.common import keys


@dataclass(frozen=True)
class Rule:
    table: str
    kind: str            # not_null | max_length | numeric | unique | fk
    cols: tuple[str, ...]
    arg: object = None   # length, (precision, scale), or (parent table, parent cols)

    @property
    def label(self) -> str:
        return ",".join(self.cols)


def not_null(table: str, col: str) -> Rule:
    return Rule(table, "not_null", (col,))


def max_length(table: str, col: str, n: int) -> Rule:
    return Rule(table, "max_length", (col,), n)


def numeric(table: str, col: str, precision: int, scale: int) -> Rule:
    return Rule(table, "numeric", (col,), (precision, scale))


def unique(table: str, *cols: str) -> Rule:
    return Rule(table, "unique", tuple(cols))


def fk(table: str, cols: str | tuple[str, ...], parent: str, parent_cols: str | tuple[str, ...]) -> Rule:
    return Rule(table, "fk", tuple(keys(cols)), (parent, tuple(keys(parent_cols))))


def _bad(rule: Rule) -> Column:
    c = F.col(rule.cols[0])
    if rule.kind == "not_null":
        return c.isNull()
    if rule.kind == "max_length":
        return c.isNotNull() & (F.char_length(c) > F.lit(rule.arg))
    if rule.kind == "numeric":
        p, s = rule.arg
        # numeric(p,s) stores the value rounded to s digits; it must stay
        # below 10^(p-s) in magnitude.
        limit = 10 ** (p - s)
        return c.isNotNull() & (F.abs(F.round(c.cast("double"), s)) >= F.lit(limit))
    raise ValueError(rule.kind)


def _column_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    aggs = [F.sum(F.when(_bad(r), 1).otherwise(0)).cast("long").alias(f"r{i}") for i, r in enumerate(rules)]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(r.table).alias("tbl"), F.lit(r.kind).alias("rule"), F.lit(r.label).alias("cols"),
                 F.coalesce(F.col(f"r{i}"), F.lit(0).cast("long")).alias("violations"))
        for i, r in enumerate(rules)]))
    return wide.select(rows.alias("x")).select("x.*")


def _unique(df: DataFrame, r: Rule) -> DataFrame:
    dup = df.groupBy(*r.cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return dup.agg(F.count(F.lit(1)).cast("long").alias("violations")).select(
        F.lit(r.table).alias("tbl"), F.lit("unique").alias("rule"), F.lit(r.label).alias("cols"), "violations")


def _orphans(df: DataFrame, parent: DataFrame, r: Rule) -> DataFrame:
    _, pcols = r.arg
    p = parent.select(*[F.col(pc).alias(c) for pc, c in zip(pcols, r.cols)]).distinct()
    child = df.select(*r.cols).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in r.cols]))
    return child.join(p, list(r.cols), "left_anti")


def _fk(df: DataFrame, parent: DataFrame, r: Rule) -> DataFrame:
    """Orphan rows, counted per key value first (partial aggregation) so a
    key held by a third of the rows is one row before the anti join."""
    _, pcols = r.arg
    p = parent.select(*[F.col(pc).alias(c) for pc, c in zip(pcols, r.cols)]).distinct()
    per_key = (df.select(*r.cols).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in r.cols]))
               .groupBy(*r.cols).agg(F.count(F.lit(1)).alias("_n")))
    orphan = per_key.join(p, list(r.cols), "left_anti")
    return orphan.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violations")).select(
        F.lit(r.table).alias("tbl"), F.lit("fk").alias("rule"), F.lit(r.label).alias("cols"), "violations")


def audit(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """One row per rule with the number of violations (0 when clean):
    rows for column rules, duplicated key values for ``unique``, orphan
    rows for ``fk``."""
    parts: list[DataFrame] = []
    col_rules: dict[str, list[Rule]] = {}
    for r in rules:
        if r.kind in ("not_null", "max_length", "numeric"):
            col_rules.setdefault(r.table, []).append(r)
        elif r.kind == "unique":
            parts.append(_unique(tables[r.table], r))
        elif r.kind == "fk":
            parts.append(_fk(tables[r.table], tables[r.arg[0]], r))
        else:
            raise ValueError(r.kind)
    for t, rs in col_rules.items():
        parts.append(_column_rules(tables[t].select(*dict.fromkeys(c for r in rs for c in r.cols)), rs))
    return reduce(DataFrame.unionByName, parts)


def audit_rows(tables: dict[str, DataFrame], rule: Rule) -> DataFrame:
    """The offending rows of one rule (key values for ``unique``)."""
    df = tables[rule.table]
    if rule.kind == "unique":
        return df.groupBy(*rule.cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if rule.kind == "fk":
        return _orphans(df, tables[rule.arg[0]], rule)
    return df.where(_bad(rule))


# The constraints declared by the source schema.
REFERENCE_RULES = [
    not_null("projects", "title"), max_length("projects", "title", 200), max_length("projects", "url", 500),
    unique("projects", "id"),
    not_null("gyms", "name"), max_length("gyms", "name", 100), unique("gyms", "id"),
    not_null("body_parts", "name"), max_length("body_parts", "name", 50), unique("body_parts", "id"),
    not_null("workouts", "gym_id"), not_null("workouts", "started_at"), unique("workouts", "id"),
    fk("workouts", "gym_id", "gyms", "id"),
    not_null("exercises", "workout_id"), not_null("exercises", "name"), max_length("exercises", "name", 200),
    max_length("exercises", "machine", 200), numeric("exercises", "max_weight", 6, 2), unique("exercises", "id"),
    fk("exercises", "workout_id", "workouts", "id"),
    not_null("exercise_body_parts", "exercise_id"), not_null("exercise_body_parts", "body_part_id"),
    unique("exercise_body_parts", "exercise_id", "body_part_id"),
    fk("exercise_body_parts", "exercise_id", "exercises", "id"),
    fk("exercise_body_parts", "body_part_id", "body_parts", "id"),
]
