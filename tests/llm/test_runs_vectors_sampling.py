"""Periodic runs, near-duplicate vectors and importance resampling: operators
and registered queries against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

pytest.importorskip("logmart.llm")

from logmart.llm import embedding_dedup, importance_resample, periodic_runs, queries  # noqa: E402

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def all_runs(w: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, period by period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(
                    all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng: random.Random, n: int, letters: str) -> list[str]:
    w = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 4:
            a, p, b = rng.randrange(n), rng.randint(1, max(1, n // 4)), rng.randint(0, n)
            w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
    return w


def test_runs_of_many_short_texts():
    rng = random.Random(11)
    for _ in range(1500):
        texts = [periodic(rng, rng.randint(0, 60), rng.choice(["a", "ab", "abc", "abcdefg"])) for _ in range(rng.choice([1, 3]))]
        h = np.array([1000 * i + ord(c) for i, w in enumerate(texts) for c in w], np.uint64)
        first = np.cumsum([0, *map(len, texts)])
        want = [(s + first[i], n, q) for i, w in enumerate(texts) for s, n, q in all_runs(w)]
        assert sorted(periodic_runs.find_runs(h)) == sorted(want)


def run_row(doc_id, text, plant: bool):
    w = words(text)
    n = len(w)
    h = crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_query(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(periodic(rng, rng.randint(0, 90), "abcdeé")), 5, "s") for i in range(150)]
    rows += [(900, None, 1, None), (901, "", 1, "x"), (902, " \n\t", 1, "x"), (903, "x " * 5000, 1, "x"), (903, "x " * 5000, 1, "x"),
             (None, "b a " * 9, 1, "x"), (904, " ".join(f"w{i % 700}" for i in range(3000)), 1, "x"), (905, "wé x " * 6, 1, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs int, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(run_row(i, t, True) for i, t, *_ in rows)
    plain = periodic_runs.collapse(spark.createDataFrame(rows, "doc_id long, text string, runs int, source string")).collect()
    assert Counter((r.doc_id, tuple(map(tuple, r.runs)), sha(r.kept_text)) for r in plain) == Counter(
        (i, tuple(all_runs(words(t))), run_row(i, t, False)[-1]) for i, t, *_ in rows)
    assert periodic_runs.collapse(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def vectors(seed: int) -> list[tuple]:
    rng, pick, rows = np.random.default_rng(seed), random.Random(seed), []
    for label in (1, 2):
        for base in rng.normal(size=(10, 24)).astype(np.float32):
            for _ in range(pick.choice([1, 2, 5, 15])):
                v = (base + rng.normal(size=24) * pick.choice([0, .05, .1, .15, .2])) * pick.choice([1, 3, .01])
                rows += [(len(rows), v.astype(np.float32).tolist(), label)]
                if pick.random() < .3:
                    rows += [(len(rows), v.astype(np.float32).tolist(), pick.choice([1, 2, None]))]
    rows += rows[5:9] + [(None, *rows[3][1:])]
    nan, inf = float("nan"), float("inf")
    rows += [(1000 + i, v, 1) for i, v in enumerate((
        None, [0.0] * 24, [None] + [1.0] * 23, [nan] * 24, [inf] + [0.0] * 23, [], rows[3][1][:20], [1e-38] * 24, [3e38] * 24))]
    pick.shuffle(rows)
    return [(*r, 7, "z") for r in rows]


def vector_rows(rows) -> Counter:
    ok = {i: (label, len(v), np.array(v, np.float64)) for i, v, label, *_ in rows
          if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in ok if j != i and ok[j][:2] == ok[i][:2]
                 and ok[i][2] @ ok[j][2] / math.sqrt((ok[i][2] @ ok[i][2]) * (ok[j][2] @ ok[j][2])) >= .98} for i in ok}
    top = {}
    for i in sorted(ok):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in top:
                top[j] = i
                todo += links[j]
    return Counter((i, len(links.get(i, ())), top.get(i, i), top.get(i, i) == i) for i, *_ in rows)


@pytest.mark.parametrize("tile", [16_384, 40, 7])
def test_near_duplicate_vectors(spark, tmp_path, tile):
    rows = vectors(tile)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, h1 int, id string")
    got = embedding_dedup.near_duplicates(df, tile=tile).collect()
    assert Counter(map(tuple, got)) == vector_rows(rows)
    if tile == 7:
        df.write.parquet(f"{tmp_path}/embeddings.parquet")
        assert Counter(map(tuple, queries.op12_embedding_dedup(spark, str(tmp_path)).collect())) == vector_rows(rows)
        assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_bounds_hold():
    """The bound of every pair covers its cosine, also for a vector of one
    large and many tiny components; no pair is lost over blocks."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 40)) * rng.choice([1, 1e-3, 1e6], size=(300, 1))
    x[::7, 0] *= 1e4
    x[150:] = x[:150] * (1 + .05 * rng.normal(size=(150, 40)))
    u, length = embedding_dedup._unit(x)
    q, s, size, rest = embedding_dedup.quantise(u, length)
    cosine = u @ u.T / np.outer(length, length)
    product = q.astype(int) @ q.astype(int).T * np.outer(s, s)
    bound = np.outer(rest, size) + np.outer(size, rest) + np.outer(rest, rest)
    assert (abs(cosine - product) <= bound + 1e-12).all()
    every = np.arange(300)
    for threshold in (.5, .98, .999):
        got = {(int(a), int(b)) for p, r in embedding_dedup.close_pairs(x, every, every, threshold, 37) for a, b in zip(p, r)}
        assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if cosine[a, b] >= threshold}


def sampled(docs, target, percent=10, shortest=20, grams=1) -> Counter:
    def features(t):
        w = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return len(w), [crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in range(1, grams + 1) for i in range(len(w) - k + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= shortest), key=lambda r: (-r[4], r[0] is None, r[0]))
    cut = percent * len(able) // 100
    return Counter((*r, k if k and k <= cut else None) for r, k in
                   [(r, k + 1) for k, r in enumerate(able)] + [(r, 0) for r in rows if r[1] < shortest])


def texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcXYZ0é-") for _ in range(rng.randint(1, 3)))
    return [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("few,percent,grams", [(2, 10, 1), (4096, 50, 2), (1, 100, 1)])
def test_resample(spark, few, percent, grams):
    docs = texts(1, 300) + [(900, None), (901, ""), (902, "A-b " * 4000), (None, "one " * 25), (7, texts(1, 8)[7][1])]
    target = [t for _, t in texts(2, 30)] + [None, ""]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, neg int, row int").repartition(7)
    tdf = spark.createDataFrame([(t, 3) for t in target], "text string, id int")
    got = importance_resample.resample(df, tdf, few=few, percent=percent, grams=grams).collect()
    assert Counter(map(tuple, got)) == sampled(docs, target, percent, grams=grams)
    none = importance_resample.resample(df.limit(0), tdf).collect()
    assert none == [] and {r.rank for r in importance_resample.resample(df, tdf, shortest=10**9).collect()} == {None}


def test_resample_query(spark, tmp_path):
    docs, target = texts(5, 400), [t for _, t in texts(6, 20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = queries.op13_importance_resample(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter((i, n, w, s, k) for (i, _, n, w, s, k), c in sampled(docs, target).items() for _ in range(c))


def test_kth_key(spark):
    rng = random.Random(3)
    keys = [(rng.randrange(20), rng.randrange(10), i) for i in range(500)]
    df = spark.createDataFrame(keys, "neg long, id long, row long").repartition(6).checkpoint()
    keys.sort()
    for k in (1, 17, 250, 500):
        assert importance_resample.kth_key(df, k, few=1) == keys[k - 1]
    assert importance_resample.kth_key(df, 0) is None and importance_resample.kth_key(df, 501) is None
