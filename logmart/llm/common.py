"""Shared helpers of the training-data operators: batches for Arrow tasks,
word and window hashes in numpy, and connected components.

Hashes are 64-bit multilinear sums over per-byte / per-word random odd
constants with a final mix. Two different strings collide with probability
about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logmart.session import CLEANUP, ensure_checkpoint_dir, shuffle_partitions, stored, tidy  # noqa: F401

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so
    that later steps read it instead of repeating its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return tidy(df, lambda x: x.checkpoint(eager=True))


def kept(df: DataFrame, name: str) -> DataFrame:
    """As ``saved``, but by columns (Parquet): wide tables take less room, and
    ``discard`` deletes them."""
    return stored(df, name)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), *cols)


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches are cut at 8 MB, where it sets
    no size itself: Spark's 64 MB are held some five times, by JVM and Python,
    in each task whose rows are texts and lists."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, 8 << 20)


def sub_batches(batch: pa.RecordBatch, text: str, limit: int = 1_000_000, read=bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(row offset, UTF-8 texts) slices of a batch of about ``limit`` bytes;
    a longer text is a slice of its own. Null texts are empty. ``read`` gives
    the text of what the column holds."""
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    at, got, size = 0, [], 0
    for i, x in enumerate(col):
        b = read(x.as_py() or b"")
        if got and size + len(b) > limit:
            yield at, got
            at, got, size = i, [], 0
        got.append(b)
        size += len(b)
    if got:
        yield at, got


class Hasher:
    """Word and byte-window hashes of many texts at once."""

    R = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.odd = rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.n, self.pow, self.inv = 0, None, None

    def powers(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 20)
            inv = pow(self.R, -1, 2**64)
            self.pow = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.n, self.R, np.uint64))), dtype=np.uint64)
            self.inv = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.n, inv, np.uint64))), dtype=np.uint64)

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))

    def words(self, texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words (runs without 0x20, 0x09-0x0D) of all texts
        in a row, and each text's first word there (one entry more)."""
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            buf = self.lower[buf]
        self.powers(len(buf))
        inside = ~self.space[buf]
        step = np.diff(inside.view(np.int8), prepend=np.int8(0))
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.pow[: len(buf)], dtype=np.uint64, out=total[1:])
        h = self.mix((total[last] - total[first]) * self.inv[first] + (last - first).astype(np.uint64))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        return h, np.concatenate(([0], np.searchsorted(first, ends)))

    def shingles(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hash of each ``k`` words in a row (also across texts: the caller
        takes those inside a text)."""
        n = max(0, len(h) - k + 1)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += h[j : j + n] * self.odd[j % 64] * U64(2 * (j // 64) + 1)
        return self.mix(out + U64(k))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest hash in each ``w`` hashes in a row (of equal
    ones the rightmost). Hashes are cut to make room for the place."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = U64((1 << len(h).bit_length()) - 1)
    m = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    width = 1
    while width * 2 <= w:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    if width < w:
        m = np.minimum(m[:n], m[w - width : w - width + n])
    return (low - (m & low)).astype(np.int64)


def window_anchors(h: np.ndarray, first: np.ndarray, k: int, window: int):
    """Anchors of all texts in a row; ``h`` has the hash of the k-gram at
    every place, ``first`` each text's first place (one entry more).

    A window's anchor is its k-gram with the smallest hash; an anchor owns
    the windows that start in [lo, hi). Gives (text, place, lo, hi), places
    counted over all texts."""
    best = sliding_min(h, window - k + 1)
    sizes = np.diff(first) - window + 1
    starts = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + n) for a, n in zip(first[:-1], sizes) if n > 0)])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    at = best[starts]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(starts) != 1))))
    lo, n = starts[new], np.diff(np.append(new, len(starts)))
    return np.searchsorted(first, lo, side="right") - 1, at[new], lo, lo + n


def runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    step = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where one of the spans [start, end) covers a place below n."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:n]) > 0


def arrays(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in ``links(a, b)``: (id, component).

    Alternating large-star and small-star steps (Kiveris et al. 2014): each
    step only joins links with one minimum per id, so no step holds a
    component in one task; every round is kept in the checkpoint folder. A
    hot id's links are split by Spark's skew join. Null ids and self links
    are ignored.
    """
    pair = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = saved(pair.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    old = mark(edges)
    while old[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = mark(new)
        if now == old:
            break
        edges, old = new, now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component")))
