"""Resampling of documents towards a target distribution by importance.

1. Features are all runs of 1 to ``grams`` words, hashed into ``buckets``
   buckets (CRC-32 of the UTF-8 bytes). Tasks count theirs, one row a bucket
   and task is shuffled, and the driver gets ``buckets`` sums of the corpus
   and of the target. A bucket's gain is
   ``floor(1000 * ln(((t+1) * (S+buckets)) / ((s+1) * (T+buckets))))``.
2. The gains are an array of ``buckets`` longs sent with the tasks. A
   document's weight is the sum over its features, its score the weight plus
   Gumbel noise that depends on ``seed`` and its id only. So the documents of
   the highest scores are a sample without replacement by weight.
3. The cutoff is found by weighted median-of-medians selection: every
   partition gives the median of its remaining keys, the pivot is the median
   of these weighted by the numbers remaining, and one job counts the keys on
   both sides. At least a quarter of the remaining keys goes a round, until
   the pivot is the cutoff or at most ``few`` keys are left, among which the
   driver takes it. Only then the winners are sorted, over many tasks.

Keys are (score descending, id, row), so every key is unique: ties go to the
smaller id, then to a row of the scored table. The driver gets two rows a
round from each of at most ``spark.sql.shuffle.partitions`` tasks. Texts are never shuffled.

Null and empty texts have no features and weight 0. A row without an id has
the noise of the id ``null`` and comes after all ids. Repeated rows are rows
of their own. An empty target gives every bucket t = 0. Other columns aren't
read. No eligible document, or a share that rounds down to 0: nothing is drawn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmart.llm.common import arrays, saved, sub_batches
from logmart.operators.common import global_rank
from logmart.session import shuffle_partitions

BUCKETS = 10_000
GRAMS = 1
SHORTEST = 20
PERCENT = 10
SEED = 2024
FEW = 4096
LAST = 2**63 - 1
KEY = "neg long, id long, row long"


def _words(text: bytes) -> list[bytes]:
    """Lower-cased words: ASCII letters and digits and all other characters
    beyond ASCII."""
    return text.translate(FOLD).split()


#: A-Z become a-z, other ASCII but letters and digits a space.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(128)).lower() + bytes(range(128, 256)))


class _Buckets(dict):
    """Buckets of features seen lately; bounded in entries and bytes."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        at = crc32(feature) % self.n
        if len(feature) <= 64:
            if len(self) >= 1 << 18:
                self.clear()
            self[feature] = at
        return at


def _bucketed(buckets: int, grams: int):
    """Function giving, for texts, the buckets of all their features in a
    row, and each text's number of features and of words."""
    seen = _Buckets(buckets)

    def of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        words = list(map(_words, texts))
        features = [own + [b" ".join(own[i:i + k]) for k in range(2, grams + 1) for i in range(len(own) - k + 1)]
                    for own in words] if grams > 1 else words
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        at = np.fromiter(map(seen.__getitem__, chain.from_iterable(features)), np.int64, int(sizes.sum()))
        return at, sizes, list(map(len, words))

    return of


def _count(buckets: int, grams: int):
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = _bucketed(buckets, grams), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in sub_batches(batch, "text"):
                total += np.bincount(of(texts)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield arrays(schema, used, total[used])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket over all texts."""
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(
        _count(buckets, grams), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():      # one row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, from the counts of the corpus and the target."""
    n, S, T = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (S + n) / ((s + 1.0) * (T + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id, in thousandths."""
    name = "null" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain: np.ndarray, grams: int, seed: int):
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _bucketed(len(gain), grams)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in sub_batches(batch, "text"):
                buckets, sizes, words = of(texts)
                sums = np.concatenate(([0], np.cumsum(gain[buckets])))[np.concatenate(([0], np.cumsum(sizes)))]
                own, weight = ids[at:at + len(texts)], np.diff(sums)
                yield arrays(schema, own, words, sizes, weight, weight + np.array([noise(i, seed) for i in own], np.int64))

    return run


def _below(keys: np.ndarray, pivot: tuple[int, int, int]) -> np.ndarray:
    """Which keys (three rows of numbers) come before the pivot."""
    a, b, c = keys
    x, y, z = pivot
    return (a < x) | ((a == x) & ((b < y) | ((b == y) & (c < z))))


def _sides(pivot: tuple[int, int, int] | None):
    """Per partition: number and median of the keys before the pivot
    (side 0) and after it (side 1); without a pivot all are on side 1."""
    schema = pa.schema([(c, pa.int64()) for c in ("side", "n", "neg", "id", "row")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]) for batch in batches]
        keys = np.concatenate(parts, 1) if parts else np.zeros((3, 0), np.int64)
        first = _below(keys, pivot) if pivot else np.zeros(keys.shape[1], bool)
        last = ~first
        if pivot:
            last &= (keys != np.array(pivot)[:, None]).any(0)
        for side, mine in enumerate((first, last)):
            own = keys[:, mine]
            if own.shape[1]:
                middle = own[:, np.lexsort(own[::-1])[(own.shape[1] - 1) // 2]]
                yield arrays(schema, [side], [own.shape[1]], *([x] for x in middle.tolist()))

    return run


def _between(low: tuple | None, high: tuple | None):
    key = F.struct("neg", "id", "row")
    at = lambda k: F.struct(*(F.lit(x).cast("long").alias(n) for x, n in zip(k, ("neg", "id", "row"))))
    return (key > at(low) if low else F.lit(True)) & (key < at(high) if high else F.lit(True))


def kth_key(keys: DataFrame, k: int, few: int = FEW) -> tuple[int, int, int] | None:
    """The ``k``-th smallest (counted from 1) of the unique, non-null keys
    ``keys(neg, id, row)``; None if there are fewer. Reads ``keys`` again each
    round, so they should be a saved table."""
    low = high = pivot = None
    tasks = shuffle_partitions(keys.sparkSession)
    while True:
        left = keys.where(_between(low, high)).coalesce(tasks)
        got = left.mapInArrow(_sides(pivot), "side long, n long, " + KEY).collect()     # two rows a task at most
        if pivot is None:
            n = sum(r.n for r in got)
            if not 1 <= k <= n:
                return None
            side, held = 1, n
        else:
            n = sum(r.n for r in got if r.side == 0)
            if k == n + 1:
                return pivot
            side = 0 if k <= n else 1
            if side:
                low, k = pivot, k - n - 1
                n = sum(r.n for r in got if r.side == 1)
            else:
                high = pivot
        if n <= few:
            rest = keys.where(_between(low, high)).select("neg", "id", "row").collect()  # at most ``few``
            return tuple(sorted(map(tuple, rest))[k - 1])
        if n * 8 <= held:             # later rounds read what is left only
            keys, held = saved(keys.where(_between(low, high))), n
        medians = sorted((r.neg, r.id, r.row, r.n) for r in got if r.side == side)
        seen = 0
        for *key, weight in medians:
            seen += weight
            if 2 * seen >= n:
                pivot = tuple(key)
                break


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT,
             shortest: int = SHORTEST, seed: int = SEED, few: int = FEW) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_features``, ``weight``,
    ``score`` and ``rank`` (1, 2, ... by falling score) of the ``percent`` %
    drawn from the documents of at least ``shortest`` words; else null."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gain = gains(bucket_counts(rows, "text", grams, buckets), bucket_counts(target, target_col, grams, buckets))
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    scored = saved(rows.mapInArrow(_score(gain, grams, seed), ", ".join(f"{c} long" for c in names)))
    scored = scored.withColumns({"row": F.monotonically_increasing_id(), "neg": -F.col("score"),
                                 "id": F.coalesce("doc_id", F.lit(LAST))})
    able = F.col("n_words") >= shortest
    k = percent * scored.where(able).count() // 100
    cutoff = kth_key(scored.where(able).select("neg", "id", "row"), k, few) if k else None
    if cutoff is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    last = _between(cutoff, None)
    won = global_rank(scored.where(able & ~last), [F.asc("neg"), F.asc("id"), F.asc("row")])
    return won.select(*names, "rank").unionByName(
        scored.where(~able | last).select(*names, F.lit(None).cast("long").alias("rank")))
