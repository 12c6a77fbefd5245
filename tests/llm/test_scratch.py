"""What the operators leave in the shared folder and in Spark's own."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("logmart.llm")

from logmart.llm import common, jaccard_join, line_dedup  # noqa: E402
from logmart.session import ensure_checkpoint_dir  # noqa: E402


def scratch_bytes(spark) -> int:
    top = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    return sum(p.stat().st_size for p in top.rglob("*") if p.is_file())


def near_copies(rng, n: int, words: int) -> list[tuple[int, str]]:
    """Pairs of texts of ``words`` words that differ in one word."""
    rows = []
    for i in range(0, n, 2):
        w = [f"w{rng.randrange(90000)}" for _ in range(words)]
        rows += [(i, " ".join(w)), (i + 1, " ".join([*w[:-1], w[-1] + "x"]))]
    return rows


def test_scratch_of_the_jaccard_join(spark):
    """The sets and lists of the join are gone when it returns, and its result can be read again and again."""
    rows = near_copies(random.Random(3), 300, 300)
    before = scratch_bytes(spark)
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert scratch_bytes(spark) - before < 8 * 300 * 296 / 2
    want = {(i, 296, i // 2 * 2) for i, _ in rows}
    assert {tuple(r) for r in out.collect()} == want == {tuple(r) for r in out.collect()}


def test_scratch_of_the_line_dedup(spark):
    """Keys, lists and compared texts are gone when the lines are grouped."""
    rows = near_copies(random.Random(4), 2000, 16)
    before = scratch_bytes(spark)
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert scratch_bytes(spark) - before < 2000 * 34 * 4
    assert {r.doc_id: r.n_removed for r in out.collect()} == {i: i % 2 for i, _ in rows}


def test_saved_leaves_no_shuffle_files(spark):
    """Shuffle files go with the query that made them; the caller's setting stays as it was."""
    def shuffles() -> set[str]:
        return {p.name for p in Path(spark.conf.get("spark.local.dir", "/tmp")).glob("blockmgr-*/*/shuffle_*.data")} | {
            p.name for p in Path(spark.conf.get("spark.local.dir", "/tmp")).glob("*/blockmgr-*/*/shuffle_*.data")}

    for keep in (common.saved, lambda df: common.kept(df, "test")):
        before, setting = shuffles(), spark.conf.get(common.CLEANUP)
        df = keep(spark.range(10000).groupBy((F.col("id") % 7).alias("k")).count())
        assert {r["k"]: r["count"] for r in df.collect()} == {k: len(range(k, 10000, 7)) for k in range(7)}
        assert spark.conf.get(common.CLEANUP) == setting
        for _ in range(50):                 # they are deleted in the background
            if not (left := shuffles() - before):
                break
            time.sleep(0.1)
        assert not left


def test_letters_bound_the_edit_distance(spark):
    """Counts of letters never differ by more than two an edit, whatever the script; of unlike lines they do."""
    rng = random.Random(5)
    rows = []
    for alphabet in ("abcdefgh xyz", "etaoin ", "äöü ßéa1", "日本語 の文", "a"):
        for n in (1, 7, 40, 300, 900):
            x = [rng.choice(alphabet) for _ in range(n)]
            y = list(x)
            for _ in range(rng.randrange(1 + n // 5)):
                i = rng.randrange(len(y) + 1)
                y[i : i + rng.randrange(2)] = rng.choices(alphabet, k=rng.randrange(2))
            rows += [("".join(x), "".join(y)), ("".join(x), "".join(rng.choice(alphabet) for _ in range(n)))]
    rows.append(("the cat sat on the mat today", "quick brown foxes jump very h"))
    pairs = spark.createDataFrame(rows, "ta string, tb string")
    for w, t in (("_a", "ta"), ("_b", "tb")):
        pairs = pairs.withColumns({f"c{i}{w}": c for i, c in enumerate(line_dedup._packed(line_dedup._letters(F.col(t))))})
    got = pairs.select(F.levenshtein("ta", "tb").alias("d"), line_dedup._apart("_a", "_b").alias("apart")).collect()
    assert all(r.apart <= 2 * r.d for r in got)
    assert got[-1].apart > 2 * 2


def test_unlike_lines_of_one_list_are_not_stored(spark, monkeypatch):
    """Lines that share a few phrases and no more meet in their lists, but no pair of them is written."""
    rng = random.Random(6)
    words = lambda n, of: [" ".join("".join(rng.choice(of) for _ in range(9)) for _ in range(n))]
    ends = words(8, "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, " ".join(ends + words(12, rng.sample("abcdefghijklmnopqrstuvwxyz", 8)))) for i in range(120)]
    rows.append((500, rows[7][1] + "x"))
    stored = {}

    def kept(df, name):
        out = common.kept(df, name)
        stored[name] = stored.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "kept", kept)
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {i: int(i == 500) for i, _ in rows}
    assert stored["stars"] + stored["rest"] < 10


def test_lines_are_grouped_alike_in_any_number_of_slices(spark, monkeypatch):
    rows = near_copies(random.Random(7), 60, 16)
    rows += [(100, rows[0][1]), (100, rows[2][1]), (101, rows[0][1] + "x")]
    want = None
    for size in (2_000_000, 1000):
        monkeypatch.setattr(line_dedup, "SLICE", size)
        got = sorted(tuple(r) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert want is None or got == want
        want = got
    assert sum(r[-1] for r in want) == 33


def test_jaccard_pairs_are_compared_in_cells(spark, monkeypatch):
    """No table holds what all pairs of sets compared to, and the links are the same in any number of cells."""
    rng = random.Random(8)
    rows = near_copies(rng, 400, 300) + near_copies(rng, 20, 4)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    most = []

    def kept(df, name):
        out = common.kept(df, name)
        if name == "near":
            most.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "kept", kept)
    monkeypatch.setattr(jaccard_join, "CELL", 10, raising=False)
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {i: i // 2 * 2 if i < 400 else i for i, _ in rows}
    assert {r.doc_id: r.component_id for r in out.collect()} == want
    assert 0 < max(most) < 100
