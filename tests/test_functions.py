"""Table-driven tests of the scalar functions (F1-F12, D1), the array and
JSON sources (S2-S5) and search edge cases."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from logmart.functions import coerce, labels
from logmart.operators import audit, latest, listing
from logmart.sources import io


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,expected", [
    ("12abc", 12), ("abc", 0), ("", 0), (None, 0), ("  7", 7), ("\t-5", -5), ("+3", 3), ("1e3", 1000),
    ("1.9", 1), ("-1.9", -1), (".5", 0), ("0", 0), ("12 ", 12), ("0x1A", 0),
])
def test_php_int(spark, text, expected):
    assert one(spark, coerce.php_int, text) == expected


@pytest.mark.parametrize("text,expected", [
    (" \t\n\rabc\x00\x0b", "abc"), ("  a b  ", "a b"), ("x", "x"),
])
def test_php_trim(spark, text, expected):
    assert one(spark, coerce.php_trim, text) == expected


@pytest.mark.parametrize("text,expected", [("", None), ("0", None), (" 0 ", None), ("\t", None),
                                           ("00", "00"), (" a ", "a"), (None, None)])
def test_empty_to_null(spark, text, expected):
    assert one(spark, coerce.empty_to_null, text) == expected


@pytest.mark.parametrize("text,value,rejected", [
    ("", None, False), (None, None, False), ("abc", Decimal("0.00"), False), ("-5", Decimal("-5.00"), False),
    ("2.345", Decimal("2.35"), False), ("9999.995", None, True), ("10000", None, True),
    ("9999.99", Decimal("9999.99"), False), ("12kg", Decimal("12.00"), False), (" 1e2", Decimal("100.00"), False),
])
def test_weight(spark, text, value, rejected):
    assert one(spark, coerce.weight_value, text) == value
    assert one(spark, coerce.weight_out_of_range, text) == rejected


def test_labels(spark):
    ts = dt.datetime(2026, 1, 2, 9, 5)
    df = spark.createDataFrame([(ts, Decimal("0.00"), 125)], "t timestamp_ntz, w decimal(6,2), s int")
    r = df.select(labels.cz_date("t").alias("d"), labels.cz_time("t").alias("h"),
                  labels.weight_label("w").alias("wl"), labels.elapsed_label("s").alias("e"),
                  labels.last_value_label("w", "t").alias("lv"),
                  labels.minutes_between(F.col("t"), F.col("t") + F.expr("INTERVAL 3599 SECONDS")).alias("m")).first()
    assert (r.d, r.h, r.wl, r.e, r.m) == ("2. 1. 2026", "09:05", "0.00 kg", "2:05", 59)
    assert r.lv == "Last time: 0.00 kg (2. 1. 2026)"
    none = spark.createDataFrame([(None,)], "w decimal(6,2)").select(labels.weight_label("w").alias("x")).first().x
    assert none == ""


@pytest.mark.parametrize("text,expected", [
    (None, []), ("{}", []), ("{a,b}", ["a", "b"]), ('{"x y",z}', ["x y", "z"]), ('{"a,b",c}', ["a", "b", "c"]),
])
def test_pg_text_array(spark, text, expected):
    # a quoted comma splits, exactly like the source's naive parser
    assert one(spark, io.pg_text_array, text) == expected


def test_pg_int_array(spark):
    assert one(spark, io.pg_int_array, "{1,2,30}") == [1, 2, 30]
    assert one(spark, io.pg_int_array, None) == []


def test_write_json_keeps_nulls(spark, seed):
    out = os.path.join(tempfile.mkdtemp(prefix="logmart-json-"), "p")
    io.write_json(seed["exercises"].where("id = 4").select("id", "name", "max_weight"), out)
    rows = [json.loads(x) for x in spark.read.text(out).toPandas()["value"]]
    assert rows == [{"id": 4, "name": "Plank", "max_weight": None}]
    doc = io.to_json_doc(seed["exercises"].where("id = 4").select("id", "machine")).first().json
    assert json.loads(doc) == {"id": 4, "machine": None}


def test_read_changes_and_payload(spark):
    d = tempfile.mkdtemp(prefix="logmart-changes-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write(json.dumps({"seq": 1, "ts": "2026-01-22T12:00:00", "op": "add_child", "child_id": 9,
                            "payload": json.dumps({"workout_id": 3, "name": " Squat ", "body_part_ids": [1, "2"],
                                                   "max_weight": 80.5})}) + "\n")
    ch = io.read_changes(spark, d)
    r = ch.select("seq", "op", io.parse_payload("payload").alias("p")).first()
    assert (r.seq, r.op, r.p.workout_id, r.p.name, r.p.body_part_ids, r.p.max_weight) == (
        1, "add_child", "3", " Squat ", ["1", "2"], "80.5")


def test_search_wildcards_and_escapes(spark):
    l1 = spark.createDataFrame([("Leg press", Decimal("1")), ("a%b", Decimal("2")), ("Abc", Decimal("3")),
                                ("Squat", Decimal("4")), ("squat", Decimal("5")), ("axb", Decimal("6"))],
                               "name string, max_weight decimal(6,2)")
    terms = spark.createDataFrame([(t,) for t in [" ", "a", "%", "a_b", "\\b", "a\\b", "SQU", "a\\%"]],
                                  "term string")
    hits = latest.search_latest(l1, terms, min_len=1).collect()
    got = {}
    for h in hits:
        got.setdefault(h.term, []).append(h.name)
    assert " " not in got                                   # blank term: nothing
    assert sorted(got["%"]) == sorted(["Leg press", "a%b", "Abc", "Squat", "squat", "axb"])
    assert got["a_b"] == ["a%b", "axb"]                     # _ is a wildcard
    assert got["\\b"] == ["Abc", "a%b", "axb"]              # \b is a literal b
    assert got["SQU"] == ["Squat", "squat"]                 # case-insensitive, binary name order
    assert got["a\\%"] == ["a%b"]                           # escaped % is literal
    client = latest.search_latest(l1, terms).collect()      # client rule: 2+ characters
    assert {h.term for h in client} == {"a_b", "\\b", "a\\b", "SQU", "a\\%"}
    literal = latest.search_latest(l1, terms, mode="literal", min_len=1).collect()
    assert sorted(h.name for h in literal if h.term == "%") == ["a%b"]


def _like(name: str, term: str) -> bool:
    """Brute-force PostgreSQL ``name ILIKE '%' || term || '%'``: backslash
    escapes the next character, % and _ are wildcards."""
    import re
    pat, out, i = ("%" + term + "%").lower(), [], 0
    while i < len(pat):
        c = pat[i]
        if c == "\\" and i + 1 < len(pat):
            out.append(re.escape(pat[i + 1]))
            i += 2
            continue
        out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        i += 1
    return re.fullmatch("".join(out), name.lower(), re.S) is not None


def test_search_index_against_brute_force(spark, monkeypatch):
    import random
    rnd = random.Random(3)
    alphabet = "abcAB %_\\"
    names = sorted({"".join(rnd.choice("abcAB %_") for _ in range(rnd.randint(1, 7))) for _ in range(80)})
    terms = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 5))) for _ in range(200)})
    terms = [t for t in terms if t.strip(" \t\n\r\x00\x0b") == t and t]
    l1 = spark.createDataFrame([(n, Decimal(i)) for i, n in enumerate(names)], "name string, max_weight decimal(6,2)")
    tdf = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.term, r.name) for r in latest.search_latest(l1, tdf, k=None, min_len=1).collect()}
    want = {(t, n) for t in terms for n in names if _like(n, t)}
    assert got == want
    lit = {(r.term, r.name) for r in latest.search_latest(l1, tdf, k=None, min_len=1, mode="literal").collect()}
    assert lit == {(t, n) for t in terms for n in names if t.lower() in n.lower()}
    assert any(set(t) <= {"%", "_"} for t in terms)
    # wildcard-only terms join on their underscore count: no broadcast needed
    monkeypatch.setattr(latest, "TERM_BROADCAST_LIMIT", 0)
    again = {(r.term, r.name) for r in latest.search_latest(l1, tdf, k=None, min_len=1).collect()}
    assert again == want
    odd = spark.createDataFrame([("a\ue000",)], "term string")
    with pytest.raises(ValueError):
        latest.search_latest(l1, odd, min_len=1)   # only stand-in characters need the bounded broadcast


def test_audit_seed_is_clean_and_finds_violations(spark, seed):
    tables = dict(seed)
    res = {(r.tbl, r.rule, r.cols): r.violations for r in audit.audit(tables, audit.REFERENCE_RULES).collect()}
    assert len(res) == len(audit.REFERENCE_RULES)
    assert all(v == 0 for v in res.values())
    bad = dict(seed)
    bad["exercise_body_parts"] = seed["exercise_body_parts"].unionByName(
        spark.createDataFrame([(1, 1), (99, 3), (2, 42)], "exercise_id long, body_part_id int"))
    res = {(r.tbl, r.rule, r.cols): r.violations for r in audit.audit(bad, audit.REFERENCE_RULES).collect()}
    assert res[("exercise_body_parts", "unique", "exercise_id,body_part_id")] == 1
    assert res[("exercise_body_parts", "fk", "exercise_id")] == 1
    assert res[("exercise_body_parts", "fk", "body_part_id")] == 1
    rows = audit.audit_rows(bad, audit.fk("exercise_body_parts", "body_part_id", "body_parts", "id")).collect()
    assert [r.body_part_id for r in rows] == [42]


def test_global_rank_matches_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select(
        F.col("id"), (F.col("id") % 13).alias("g"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 5)
        .alias("s"))
    order = [F.col("s").asc_nulls_last(), F.col("g").desc(), F.col("id").asc()]
    from logmart.operators.common import global_rank
    ranked = {r.id: r.rank for r in global_rank(df, order).collect()}
    pdf = df.toPandas().sort_values(["s", "g", "id"], ascending=[True, False, True], na_position="last")
    assert [ranked[i] for i in pdf["id"]] == list(range(1, 5001))


def test_visible_listing_null_rules(spark):
    rows = [(1, 2, True, dt.datetime(2026, 1, 1)), (2, None, True, dt.datetime(2026, 1, 2)),
            (3, 2, None, None), (4, 2, True, None), (5, 1, False, None), (6, 2, True, dt.datetime(2026, 1, 3))]
    df = spark.createDataFrame(rows, "id int, sort_order int, visible boolean, created_at timestamp_ntz")
    got = [r.id for r in listing.visible_listing(df).orderBy("rank").collect()]
    assert got == [4, 6, 1, 2]   # NULL created first in DESC, NULL sort last in ASC, NULL visible dropped


def test_page(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 7)
    rows = listing.page(df, [F.col("g").desc(), F.col("id").asc()], limit=3, offset=2).collect()
    assert [(r.rank, r.id) for r in rows] == [(3, 20), (4, 27), (5, 34)]
    with pytest.raises(ValueError):
        listing.page(df, [F.col("id")], limit=-1)


def test_read_tables(spark, seed):
    d = tempfile.mkdtemp(prefix="logmart-tables-")
    seed["gyms"].write.parquet(f"{d}/gyms.parquet")
    from logmart import schemas as S
    t = io.read_tables(spark, d, {"gyms": S.GYMS})
    got = [(f.name, f.dataType) for f in t["gyms"].schema]
    assert t["gyms"].count() == 5 and got == [(f.name, f.dataType) for f in S.GYMS]


def test_group_rank_splits_hot_groups(spark):
    from logmart.operators.common import group_rank
    # group 0 holds most rows; with a low threshold it takes the distributed path
    df = spark.range(0, 3000, numPartitions=6).select(
        F.col("id"), F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 7 + 1).alias("g"),
        (F.col("id") * 7919 % 101).alias("s"))
    order = [F.col("s").asc(), F.col("id").desc()]
    want = {r.id: r.p for r in df.withColumn(
        "p", F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("g").orderBy(*order)))
        .collect()}
    for hot_rows in (10_000, 100, 0):
        got = {r.id: r.position for r in group_rank(df, "g", order, hot_rows=hot_rows).collect()}
        assert got == want, hot_rows


def _php_number_prefix(s):
    """Plain-Python model of PHP's leading-number rule for strings."""
    import re
    m = re.match(r"[ \t\n\r\x0b\f]*([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?)", s)
    return m.group(1) if m else ""


def test_php_coercions_against_model(spark):
    import math
    import random
    rnd = random.Random(13)
    alphabet = "0123456789.eE+- \tab"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    rows = df.select("i", coerce.php_int("x").alias("n"), coerce.weight_value("x").alias("w")).collect()
    got = {r.i: (r.n, r.w) for r in rows}
    for i, t in enumerate(texts):
        p = _php_number_prefix(t)
        f = float(p) if p else 0.0
        want_int = 0 if not p or not math.isfinite(f) else max(-2 ** 63, min(2 ** 63 - 1, int(f)))
        if p and re.fullmatch(r"[+-]?\d{1,18}", p):
            want_int = int(p)
        assert got[i][0] == want_int, (t, p)
        if t == "":
            assert got[i][1] is None
        else:
            d = (Decimal(repr(f)).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
                 if math.isfinite(f) and abs(f) < 1e6 else None)
            want_w = d if d is not None and abs(d) < 10000 else None
            assert got[i][1] == want_w, (t, p)


def test_search_collation(spark):
    l1 = spark.createDataFrame([(n, Decimal(1)) for n in ["dx", "čx", "cx", "bx", "Ax"]],
                               "name string, max_weight decimal(6,2)")
    terms = spark.createDataFrame([("x",)], "term string")
    binary = [r.name for r in latest.search_latest(l1, terms, min_len=1).orderBy("rank").collect()]
    czech = [r.name for r in latest.search_latest(l1, terms, min_len=1, collation="cs").orderBy("rank").collect()]
    assert binary == ["Ax", "bx", "cx", "dx", "čx"]
    assert czech == ["Ax", "bx", "cx", "čx", "dx"]


def test_read_requests_keeps_every_line(spark, tmp_path):
    """Lines that aren't change rows come back as they are."""
    from logmart.sources.io import read_requests
    good = ['{"seq": 1, "ts": "2026-01-22T12:00:00", "op": "create_header", "header_id": 5, "payload": "{\\"gym_id\\": 1}"}',
            '{"seq": 2, "ts": "2026-01-22T12:00:00", "op": "bogus", "payload": "not json", "more": 1}']
    bad = ["", "   ", "not json \u00e9", '{"seq": "x", "ts": "2026-01-22T12:00:00", "op": "y"}', "[1, 2]", '{"seq": 3', "null", "{}", '{"seq": 4, "op": "y"}']
    (tmp_path / "log.json").write_text("\n".join([good[0], *bad, good[1]]) + "\n", encoding="utf-8")
    changes, aside = read_requests(spark, str(tmp_path))
    assert sorted((r.seq, r.op, r.payload) for r in changes.collect()) == [
        (1, "create_header", '{"gym_id": 1}'), (2, "bogus", "not json")]
    rows = aside.collect()
    assert sorted(r.line for r in rows) == sorted(bad) and all(r.file.endswith("log.json") for r in rows)


def test_deep_page_equals_order_by_offset(spark):
    """Ties, NULL keys, both directions, offsets up to and beyond the end."""
    import random

    from logmart.operators.listing import deep_page
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, 1.5, rnd.random() * 50, float(rnd.randrange(5))])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k double").repartition(5)
    up = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    down = up[::-1]
    for want, descending in ((down, True), (up, False)):
        for offset, limit in ((0, 5), (333, 20), (590, 50), (700, 3), (10, 0)):
            got = deep_page(df, "k", "id", limit, offset, descending=descending, buckets=8, few=10).orderBy("rank").collect()
            assert [(r.rank, r.id, r.k) for r in got] == [
                (offset + i + 1, *r) for i, r in enumerate(want[offset:offset + limit])]
    assert deep_page(df.limit(0), "k", "id", 5, 0).collect() == []


def test_json_files_are_compressed(spark, tmp_path):
    import glob
    from logmart.sources.io import write_json
    path = str(tmp_path / "lines")
    rows = spark.range(2000).selectExpr("id", "cast(null as string) AS note", "array(id, id + 1) AS pair")
    write_json(rows, path)
    files = glob.glob(f"{path}/part-*")
    assert files and all(f.endswith(".json.gz") for f in files)
    assert all('"note":null' in r.value for r in spark.read.text(path).collect())
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(path).collect())) == sorted(map(tuple, rows.collect()))
