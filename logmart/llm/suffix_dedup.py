"""Suffix dedup of byte strings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts
earlier (smaller id, or same document and earlier start). Suffixes are
sorted into buckets by their first ``length`` bytes, without ever sorting
those that can't repeat:

* initial buckets hold suffixes with equal q-grams (q = length / 4). A
  bucket's identifier is made from the identifiers of shorter strings at
  later offsets: of q bytes, then id(i, 2q) from id(i, q) and id(i + q, q),
  and so on. Identifiers follow from the content, so every task has the
  same ones, and each level reuses those below.
* only the smallest q-gram of every ``length`` bytes (its anchor) enters a
  bucket: equal strings have equal anchors at equal places. An anchor owns
  the strings it is the smallest of. Buckets of one suffix end here.
* refinement: a bucket's suffixes are sorted by the identifiers of the first
  and last string they own, then by place. Where one equals its predecessor,
  all its strings start earlier. In buckets that split, the first of each part
  is compared with the bucket's first suffix, byte by byte both ways. Strings
  inside the equal bytes start earlier. The others go into buckets by side,
  distance and byte at which they leave the first suffix (equal strings leave
  it alike); buckets of one suffix end here. What is left is sorted into
  buckets by whole identifiers (two hashes of all bytes), then by place; all
  but the first of each start earlier.

Texts are shuffled once, deflated row by row, and both joins read that
exchange. Null and empty texts have no bytes. A row with a null id is kept whole and never compared;
a repeated row's bytes count as starting at the same place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmart.llm.common import U64, Hasher, arrays, covered, runs, spread, sub_batches, window_anchors

LENGTH = 100
LONGEST = 1 << 16     # strings are shorter than that


def _bits(length: int) -> int:
    """Bits of an anchor's distance to its first string and of their number;
    both are below ``length``. Short ``spot``s leave zeros, which cost nothing
    when rows are shuffled."""
    return length.bit_length()


class _Buckets:
    """Bucket identifiers of the strings at every place."""

    def __init__(self, length: int, seed: int):
        if length % 4 or not 8 <= length < LONGEST:
            raise ValueError("length: a multiple of 4 from 8 on, below 65536")
        self.hasher, self.q, self.length = Hasher(seed), length // 4, length

    def later(self, ids: np.ndarray, step: int) -> np.ndarray:
        """Identifiers of twice the length, by those ``step`` further on."""
        n = max(0, len(ids) - step)
        odd = self.hasher.odd
        return self.hasher.mix(ids[:n] * odd[1] + ids[step : step + n] * odd[2] + U64(step))

    def grams(self, buf: np.ndarray) -> np.ndarray:
        ids = self.hasher.table[buf]
        five = self.q // 5 if self.q % 5 == 0 else 1
        if five > 1:                                   # q-grams from groups of five
            ids = self.hasher.shingles(ids, 5)
            n = max(0, len(ids) - 5 * (five - 1))
            out = np.zeros(n, np.uint64)
            for j in range(five):
                out += ids[5 * j : 5 * j + n] * self.hasher.odd[j]
            return self.hasher.mix(out)
        return self.hasher.shingles(ids, self.q)

    def levels(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of q bytes and of ``length`` bytes."""
        q = self.grams(buf)
        return q, self.later(self.later(q, self.q), 2 * self.q)


def _pack(it):
    """(doc_id, text) with the text's bytes deflated: a row of two thousand
    bytes takes some two thirds of what the shuffle's own codec leaves of it."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
    for batch in it:
        yield arrays(schema, batch.column(0), [zlib.compress(x.as_py() or b"", 1) for x in batch.column(1).cast(pa.large_binary())])


def _bytes(packed: bytes | None) -> bytes:
    return zlib.decompress(packed) if packed else b""


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    return np.frombuffer(b"".join(texts), np.uint8), first


def _anchors(length: int):
    schema = pa.schema([("q", pa.int64()), ("r", pa.int64()), ("doc_id", pa.int64()), ("spot", pa.int64())])
    bits = _bits(length)

    def run(it):
        buckets = _Buckets(length, 1)
        odd, mix = buckets.hasher.odd, buckets.hasher.mix
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for off, texts in sub_batches(batch, "text", read=_bytes):
                buf, first = _joined(texts)
                if len(buf) < length:
                    continue
                q, whole = buckets.levels(buf)
                doc, at, lo, hi = window_anchors(q, first, buckets.q, length)
                r = mix(whole[lo] * odd[3] + whole[hi - 1] * odd[4] + (at - lo).astype(np.uint64) * odd[5]
                        + (hi - lo).astype(np.uint64))
                spot = (lo - first[doc]) << 2 * bits | (at - lo) << bits | (hi - lo)
                yield arrays(schema, q[at].view(np.int64), r.view(np.int64), ids[off + doc], spot)

    return run


def _contexts(length: int):
    """Of each document with its anchors: the spans that surely repeat
    (without q), and the bytes of all strings that the first
    suffixes of parts own."""
    schema = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("before", pa.int32()),
                        ("owned", pa.int32()), ("around", pa.binary())])
    bits = _bits(length)

    def run(it):
        one = _Buckets(length, 1)
        for batch in it:
            get = lambda n: batch.column(batch.schema.get_field_index(n))
            for text, doc, sure, rest in zip(get("text"), *(get(c).to_pylist() for c in ("doc_id", "sure", "rest"))):
                data = _bytes(text.as_py())
                spot = np.array(sure, np.int64)
                lo, n = spot >> 2 * bits, spot & (1 << bits) - 1
                rows = [(None, doc, a, b, 0, 0, b"") for a, b in zip(*map(np.ndarray.tolist, runs(
                    covered(len(data), lo, lo + n + length - 1))))]
                if rest:
                    spot = np.array(rest, np.int64)
                    lo, n = spot >> 2 * bits, spot & (1 << bits) - 1
                    at = lo + (spot >> bits & (1 << bits) - 1)
                    grams = np.frombuffer(data, np.uint8)[(at[:, None] + np.arange(one.q)).ravel()]
                    q = one.grams(grams)[:: one.q].view(np.int64)
                    rows += [(k, doc, x, y, x - y, m, data[y : y + m - 1 + length]) for k, x, y, m in zip(
                        q.tolist(), at.tolist(), lo.tolist(), n.tolist())]
                if rows:
                    yield arrays(schema, *zip(*rows))

    return run


def _equal(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common at the start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _leaving(length: int):
    """Of the first suffix of each part and of its bucket: the span that
    repeats (no key), and by side the strings that leave the bucket's."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("from", pa.int32()),
                        ("around", pa.binary())])
    q, reach = length // 4, length - length // 4

    def run(it):
        odd = Hasher(1).odd
        for batch in it:
            rows = []
            for k, doc, at, lo, before, owned, around, p_before, p_around in zip(*(c.to_pylist() for c in batch.columns)):
                if k is None:
                    rows.append((None, doc, at, lo, 0, b""))
                    continue
                left = _equal(around[:before][::-1], p_around[:p_before][::-1])
                right = _equal(around[before + q :], p_around[p_before + q :])
                far = at - lo                            # owned strings begin far, far - 1 ... before the anchor
                near = far - owned + 1
                a, b = max(near, reach - right), min(far, left)
                if a <= b:
                    rows.append((None, doc, at - b, at - a + length, 0, b""))
                for side, x, y, d in ((1, near, min(far, reach - right - 1), right), (2, max(near, reach - right, left + 1), far, left)):
                    if x <= y:
                        byte = around[before + q + d] if side == 1 else around[before - 1 - d]
                        with np.errstate(over="ignore"):
                            key = Hasher.mix(U64(k & 0xFFFFFFFFFFFFFFFF) + odd[6] * U64(d << 9 | byte << 1 | side - 1))
                        rows.append((int(np.uint64(key).view(np.int64)), doc, at - y, at - x + length, before - y, around))
            if rows:
                yield arrays(schema, *zip(*rows))

    return run


def _strings(length: int):
    """Identifiers of all strings in [s, e); ``from`` is the place of s in
    the bytes around. Strings end ``length`` after their start (no ``e``);
    rows with one are spans already found, which have their document for an
    identifier."""
    schema = pa.schema([("h", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def run(it):
        one, two = _Buckets(length, 1), _Buckets(length, 2)
        for batch in it:
            for at in range(0, batch.num_rows, 2000):
                parts, docs, starts, found = [], [], [], []
                for doc, s, e, a, around, sure in zip(*(c.slice(at, 2000).to_pylist() for c in batch.columns)):
                    if sure:
                        found.append((doc, -1, doc, s, e))
                        continue
                    parts.append(around[a : a + e - s])
                    docs.append(np.full(e - s - length + 1, doc))
                    starts.append(np.arange(s, e - length + 1))
                if found:
                    yield arrays(schema, *zip(*found))
                if not parts:
                    continue
                buf, first = _joined(parts)
                inside = np.concatenate([np.arange(x, y - length + 1) for x, y in zip(first, first[1:])])
                s = np.concatenate(starts)
                yield arrays(schema, one.levels(buf)[1][inside].view(np.int64), two.levels(buf)[1][inside].view(np.int64),
                             np.concatenate(docs), s, pa.nulls(len(s), pa.int64()))

    return run


def repeats(text: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans of bytes (doc_id, s, e) to remove, from ``text(doc_id, text)``
    (see ``_pack``) dealt by doc_id, without null ids. Spans may overlap."""
    anchors = text.mapInArrow(_anchors(length), "q long, r long, doc_id long, spot long")
    order = Window.partitionBy("q").orderBy("r", "doc_id", "spot")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = lambda c: F.coalesce(F.lag(c).over(order) == F.col(c), F.lit(False))
    # a repeated row gives its anchors again, each beside itself: one of them counts
    parts = anchors.withColumns({"sure": same("r"), "again": same("r") & same("doc_id") & same("spot"),
                                 "split": F.first("r").over(whole) != F.last("r").over(whole)}).where(
        "not again and (sure or split)")
    by_doc = parts.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("sure"), F.col("spot"))).alias("sure"),
        F.collect_list(F.when(~F.col("sure"), F.col("spot"))).alias("rest"))
    around = by_doc.join(text, "doc_id").mapInArrow(
        _contexts(length), "q long, doc_id long, s long, e long, before int, owned int, around binary")

    # rows without a bucket are spans already found; they pass by, spread over all tasks
    order = Window.partitionBy(F.coalesce("q", F.xxhash64("doc_id", "s"))).orderBy(F.col("q").asc_nulls_first(), "doc_id", "s")
    firsts = around.withColumns({"p_doc": F.first("doc_id").over(order), "p_at": F.first("s").over(order),
                                 "p_before": F.first("before").over(order), "p_around": F.first("around").over(order)})
    leaving = firsts.where("q is null or doc_id <> p_doc or s <> p_at").select(
        "q", "doc_id", "s", "e", "before", "owned", "around", "p_before", "p_around").mapInArrow(
        _leaving(length), "key long, doc_id long, s long, e long, from int, around binary")
    shared = F.count(F.lit(1)).over(Window.partitionBy(F.coalesce("key", F.xxhash64("doc_id", "s")), F.col("key").isNull()))
    kept = leaving.withColumn("n", shared).where("key is null or n > 1")
    strings = kept.select("doc_id", "s", "e", "from", "around", F.col("key").isNull().alias("sure")).mapInArrow(
        _strings(length), "h long, h2 long, doc_id long, s long, e long")
    order = Window.partitionBy("h", "h2").orderBy("doc_id", "s")
    return strings.withColumns({"d0": F.first("doc_id").over(order), "s0": F.first("s").over(order)}).where(
        "e is not null or doc_id <> d0 or s <> s0").select("doc_id", "s", F.coalesce("e", F.col("s") + length).alias("e"))


def _remove(it):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))),
                        ("n_removed", pa.int64()), ("kept", pa.binary())])
    for batch in it:
        get = lambda n: batch.column(batch.schema.get_field_index(n))
        for at in range(0, batch.num_rows, 200):
            rows = []
            for doc, text, s, e in zip(*(get(c).slice(at, 200).to_pylist() for c in ("doc_id", "text", "s", "e"))):
                data = _bytes(text)
                gone = covered(len(data), np.array(s or [], np.int64), np.array(e or [], np.int64)) if s else None
                a, b = runs(gone) if s else (np.zeros(0, np.int64),) * 2
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if s else data
                rows.append((doc, len(data), np.stack((a, b), 1).tolist(), len(data) - len(kept), kept))
            yield arrays(schema, *zip(*rows))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, ``spans`` (maximal removed runs),
    ``n_removed`` and ``kept`` (the bytes left)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pack = lambda df: df.mapInArrow(_pack, "doc_id long, text binary")
    # one exchange, read by all joins; said again after ``pack``, as a join would, or it would make its own
    text = spread(pack(rows.where("doc_id is not null")).where("doc_id is not null"), "doc_id")
    spans = repeats(text, length).groupBy("doc_id").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    none = F.lit(None).cast(spans.schema["s"].dataType)
    whole = pack(rows.where("doc_id is null")).withColumns({"s": none, "e": none})
    schema = "doc_id long, n_bytes long, spans array<array<bigint>>, n_removed long, kept binary"
    return text.join(spans, "doc_id", "left").mapInArrow(_remove, schema).unionByName(whole.mapInArrow(_remove, schema))
