"""Periodic runs of words, found by descending-LCP Kruskal, and their collapse.

A run is a stretch of words with smallest period q (words q apart are equal),
at least ``max(6, 4 * q)`` long, that no neighbouring word extends keeping
period q. The texts of a batch are searched together, each in itself:

1. Every place gets the distance to the next equal word of its text. In a
   run of period q the first ``length - q`` places all have a distance of at
   most q. So the stretches of distances up to 2**k that are long enough for
   a period in (2**(k-1), 2**k], each with 2**k more words, hold every run
   whole. Overlapping stretches are one piece; the rest of a text can't hold
   a run.
2. The suffixes of the pieces are sorted by prefix doubling, and the LCPs of
   neighbours follow from the ranks of all rounds.
3. Neighbouring suffixes are united by decreasing LCP: a union-find over
   classes of suffixes, each with its places in order, the smaller put into
   the larger. Two places that become adjacent there at a distance d have no
   equal context between them, so d is the smallest period of the LCP + d
   words from the first. With LCP >= 3 * d they seed a run; it is whole if
   the words before the two differ.

Words are compared by 64-bit hashes. A text is one row and is searched in one
task, its memory a fixed number of bytes a word; batches are cut by bytes.

Null and empty texts have no words. Rows are judged one by one, so repeated
rows come back repeated; a null id stays null. Other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmart.llm.common import U64, Hasher, arrays, covered, runs, sub_batches

EXPONENT = 4
SHORTEST = 6
RUN = "struct<start:long,length:long,period:long>"


def _pieces(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the disjoint stretches that can hold a run (step
    1). Equal hashes mean equal words of one text."""
    order = np.argsort(h, kind="stable")
    gap = np.diff(order)
    same = h[order[1:]] == h[order[:-1]]
    ahead = np.full(len(h), len(h) + 1, np.int64)
    ahead[order[:-1][same]] = gap[same]
    starts, ends, reach = [], [], 1
    while True:
        period = reach // 2 + 1                   # the shortest of this level
        least = max(SHORTEST - reach, (EXPONENT - 1) * period)
        if least > len(h):
            break
        a, b = runs(ahead <= reach)
        long = b - a >= least
        starts.append(a[long])
        ends.append(np.minimum(b[long] + reach, len(h)))
        reach *= 2
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return runs(covered(len(h), np.concatenate(starts), np.concatenate(ends)))


def _suffixes(x: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the pieces in a row, a suffix ending with its piece
    (``end``), and the LCP of each with the next one (step 2)."""
    n = len(x)
    place = np.arange(n)
    rank = np.unique(x, return_inverse=True)[1]
    ranks, step, longest = [rank.astype(np.int32)], 1, int((end - place).max())
    while step < longest and rank.max() < n - 1:
        inside = place + step < end
        second = np.zeros(n, np.int64)
        second[inside] = rank[place[inside] + step] + 1
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1]
        ranks.append(rank.astype(np.int32))
        step *= 2
    order = np.argsort(rank, kind="stable")
    a, b, lcp = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        more = (i < end[a]) & (j < end[b])
        more[more] = ranks[k][i[more]] == ranks[k][j[more]]
        lcp[more] += np.minimum(1 << k, (end[a] - i)[more])
    return order, lcp


def _seeds(order: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, place, LCP) of all places at a distance of at most a third of
    the LCP that become adjacent when suffixes are united (step 3)."""
    useful = np.flatnonzero(lcp >= SHORTEST - 1)
    useful = useful[np.argsort(-lcp[useful], kind="stable")]
    parent = list(range(len(order)))
    places = [[p] for p in order.tolist()]
    found = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, common in zip(useful.tolist(), lcp[useful].tolist()):
        large, small = root(i), root(i + 1)
        if len(places[large]) < len(places[small]):
            large, small = small, large
        big, few = places[large], places[small]
        near = common // (EXPONENT - 1)
        # neighbours across the two sets, before they are merged
        last = -1
        for k, p in enumerate(few):
            at = bisect_left(big, p)
            if at > last and at and p - big[at - 1] <= near:
                found.append((big[at - 1], p, common))
            if at < len(big) and big[at] - p <= near and (k + 1 == len(few) or few[k + 1] > big[at]):
                found.append((p, big[at], common))
            last = at
        if len(few) < 32:
            for p in few:
                insort(big, p)
        else:
            big += few
            big.sort()                            # two ordered lists: merged
        parent[small], places[small] = large, None
    return found


def find_runs(h: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of all runs; equal hashes mean equal words of
    one text, texts follow each other."""
    if len(h) < SHORTEST:
        return
    a, b = _pieces(h)
    if not len(a):
        return
    sizes = b - a
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(int(sizes.sum())) - np.repeat(first - a, sizes)     # in h, per place of the pieces
    x = h[place]
    order, lcp = _suffixes(x, np.repeat(first + sizes, sizes))
    begins = set(first.tolist())
    for i, j, common in _seeds(order, lcp):
        period = j - i
        if common >= max(SHORTEST - period, (EXPONENT - 1) * period) and (i in begins or x[i - 1] != x[j - 1]):
            yield int(place[i]), common + period, period


def _search(rewrite: Callable[[int, int], np.ndarray | None] | None):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct(
        [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        salt = U64(Hasher.R)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in sub_batches(batch, "text"):
                h, first = hasher.words(texts)
                words = [t.split() for t in texts]              # at 0x20 and 0x09-0x0D
                for i in range(len(texts)) if rewrite else ():
                    take = rewrite(ids[at + i], len(words[i])) if words[i] else None
                    if take is not None:
                        h[first[i]:first[i + 1]] = h[first[i]:first[i + 1]][take]
                        words[i] = [words[i][k] for k in take.tolist()]
                text = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
                got = [[] for _ in texts]
                for start, length, period in find_runs(Hasher.mix(h + text * salt)):
                    i = int(text[start])
                    got[i].append((start - int(first[i]), length, period))
                kept = []
                for own, found in zip(words, got):
                    if found:
                        found.sort(key=lambda r: (r[0], r[2]))
                        s, n, q = np.array(found).T
                        own = compress(own, (~covered(len(own), s + q, s + n)).tolist())
                    kept.append(b" ".join(own))
                rows = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in got]
                yield arrays(schema, ids[at:at + len(texts)], np.diff(first), rows, [k.decode() for k in kept])

    return run


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             rewrite: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``runs`` (by start, then period) and
    ``kept_text``: the words that no run contains after its first period,
    joined by a space.

    ``rewrite(doc_id, n_words)`` may give the places of the words that a text
    is read as (None: as it is). One narrow pass, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_search(rewrite), f"doc_id long, n_words long, runs array<{RUN}>, kept_text string")


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of ``collapse``: number of runs, the longest one (ties: the
    smallest start, then period; nulls without runs) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(every, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))
