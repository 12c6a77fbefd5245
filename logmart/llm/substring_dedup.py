"""Substring dedup of word windows by seed and extend.

A repeat is a run of ``window`` words or more that a document shares with
one of a smaller id; its words are removed.

* seed: in every window the k-gram (``window // 2`` words) with the smallest
  hash is its anchor, so equal windows have equal anchors at equal places.
  An anchor owns the windows it is the smallest of, a range of starts.
* join: each anchor meets its pivot, the first occurrence of the k-gram
  (smallest id, then place). Anchors of one document, pivot and diagonal
  form a chain.
* extend: along each chain the words are compared both ways as far as the
  windows of its anchors reach; runs of ``window`` equal words or more are
  the maximal repeats with the pivot.
* rest: windows of anchors that don't match their pivot may match another
  document. A window that matches the pivot can't equal one that doesn't,
  so only those left are compared, by a hash of the whole window and the
  smallest document that has it.

No step pairs the occurrences of an anchor with each other, and the texts
are shuffled once: every join reads that same exchange.

Null and empty texts have no words. A row with a null id is never compared
and keeps all its words; a repeated row gives a repeated result row.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmart.llm.common import Hasher, arrays, covered, runs, small_batches, spread, sub_batches, window_anchors

WINDOW = 50
CHAINS = 1000          # documents, about, whose chains share one copy of their pivot's text
HELD = 500_000         # words, or spans, in a batch that tasks give back


def _anchors(window: int):
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(it):
        hasher, k = Hasher(), window // 2
        for batch in it:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for off, texts in sub_batches(batch, "text"):
                words, first = hasher.words(texts)
                grams = hasher.shingles(words, k)
                doc, at, lo, hi = window_anchors(grams, first, k, window)
                yield arrays(schema, grams[at].view(np.int64), ids[off + doc], at - first[doc], lo - first[doc], hi - first[doc])

    return run


def _fields(chains: pa.ListScalar) -> dict[str, pa.Array]:
    """The fields of a row's chains as arrays, without Python objects."""
    c = chains.values
    return dict(zip((f.name for f in c.type), c.flatten()))


def _numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _between(words: np.ndarray, a: int, b: int) -> np.ndarray:
    """Words a to b, 0 beyond the ends."""
    out = np.zeros(b - a, np.uint64)
    out[max(0, -a) : max(0, len(words) - a)] = words[max(0, a) : b]
    return out


def _beside(it):
    """Adds to each chain its first place ``p0`` in the pivot and the pivot's
    words beside it. A document's chains along one stretch of the pivot name
    that stretch by its start ``s0`` and only the first has the words; chains
    in the pivot itself have none. Batches are cut after ``HELD`` words."""
    schema = pa.schema([("doc_id", pa.int64()), ("pivot", pa.int64()), ("a0", pa.int32()), ("a1", pa.int32()),
                        ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("p0", pa.int32()), ("s0", pa.int32()),
                        ("copy", pa.int64()), ("beside", pa.binary())])
    hasher = Hasher()
    for batch in it:
        get = lambda n: batch.column(batch.schema.get_field_index(n))
        for pivot, text, chains in zip(get("pivot").to_pylist(), get("text"), get("chains")):
            data = (text.as_py() or "").encode()
            words, copy = hasher.words([data])[0], crc32(data)     # rows with one id may differ
            c = _fields(chains)
            doc, a0, a1, diag = (_numbers(c[n]).astype(np.int64) for n in ("doc_id", "a0", "a1", "diag"))
            order = np.lexsort((diag - a1, a0 - diag, doc))        # by place in the pivot, longest first
            c = {n: x.take(pa.array(order)) for n, x in c.items()}
            doc, p0, p1 = doc[order], (a0 - diag)[order], (a1 - diag)[order]
            last, s0, end, begin, size, starts, stretches = None, 0, 0, 0, 0, [], []

            def rows(x: int, y: int) -> pa.RecordBatch:
                part = [c[n].slice(x, y - x) for n in ("doc_id", "a0", "a1", "lo", "hi")]
                part.insert(1, pa.array([pivot] * (y - x)))
                part += [pa.array(p0[x:y]), pa.array(starts), pa.array([copy] * (y - x)), pa.array(stretches, pa.binary())]
                return pa.RecordBatch.from_arrays([q.cast(f.type) for q, f in zip(part, schema)], schema=schema)

            for i, (d, x, y) in enumerate(zip(doc.tolist(), p0.tolist(), p1.tolist())):
                found = b""
                if d != last or y > end:
                    last, s0, end = d, x, y
                    if d != pivot:
                        found = _between(words, x, y).tobytes()
                starts.append(s0)
                stretches.append(found)
                size += len(found) // 8
                if size > HELD:
                    yield rows(begin, i + 1)
                    begin, size, starts, stretches = i + 1, 0, [], []
            if starts:
                yield rows(begin, len(doc))


def _extend(window: int):
    schema = pa.schema([("h", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("s", pa.int32()), ("e", pa.int32()),
                        ("sure", pa.bool_())])

    def run(it):
        hasher, one, two = Hasher(), Hasher(3), Hasher(4)
        cols, held_rows = [[] for _ in schema], 0

        def add(doc, s, e, h, h2, sure):
            nonlocal held_rows
            held_rows += len(s)
            for c, x in zip(cols, (h.view(np.int64), h2.view(np.int64), np.full(len(s), doc), s, e, np.full(len(s), sure))):
                c.append(x)

        def taken():
            nonlocal held_rows
            out = arrays(schema, *map(np.concatenate, cols))
            held_rows = 0
            for c in cols:
                c.clear()
            return out

        for batch in it:
            get = lambda n: batch.column(batch.schema.get_field_index(n))
            for text, doc, chains in zip(get("text"), get("doc_id").to_pylist(), get("chains")):
                words = hasher.words([(text.as_py() or "").encode()])[0]
                held, open_ = np.zeros(len(words) + 1, bool), np.zeros(len(words) + 1, bool)
                c = _fields(chains)
                places = list(zip(*(_numbers(c[n]).tolist() for n in ("pivot", "s0", "copy", "p0", "a0", "a1"))))
                stretch = {x[:3]: np.frombuffer(w.as_buffer(), np.uint64) for x, w in zip(places, c["beside"]) if len(w.as_buffer())}
                for (pivot, s0, copy, p0, a0, a1), lo, hi in zip(places, c["lo"], c["hi"]):
                    if pivot == doc:
                        beside = _between(words, p0, p0 + a1 - a0)
                    else:
                        beside = stretch[pivot, s0, copy][p0 - s0 :][: a1 - a0]
                    s, e = runs(words[a0:a1] == beside)
                    s, e = s[e - s >= window] + a0, e[e - s >= window] + a0
                    if doc != pivot and len(s):
                        with np.errstate(over="ignore"):
                            spot = Hasher.mix(s.astype(np.uint64) + np.array([doc], np.int64).view(np.uint64) * one.odd[0])  # spreads them
                        add(doc, s, e, spot, spot, True)
                    same = covered(a1 - a0 + 1, s - a0, e - window + 1 - a0)      # of the starts from a0 on
                    for x, y in zip(_numbers(lo.values).tolist(), _numbers(hi.values).tolist()):
                        open_[x:y] |= ~same[x - a0 : y - a0]
                    if doc != pivot:
                        held[a0 : a1 + 1] |= same
                starts = np.flatnonzero(open_ & ~held)
                if len(starts):
                    add(doc, starts, starts + window, one.shingles(words, window)[starts],
                        two.shingles(words, window)[starts], False)
                if held_rows > HELD:
                    yield taken()
            if held_rows:
                yield taken()

    return run


def repeats(text: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans of words (doc_id, s, e) to remove, from ``text(doc_id, text)``
    dealt by doc_id, without null ids. Spans may overlap."""
    anchors = text.mapInArrow(
        _anchors(window), "h long, doc_id long, at int, lo int, hi int")
    # an aggregate with a partial step, and a join that Spark can cut at hot anchors; it cuts only between two
    # exchanges, so the aggregate goes by another key of the same groups
    other = F.col("h").bitwiseXOR(F.lit(1).cast("long")).alias("g")
    pivots = anchors.groupBy(other).agg(F.min(F.struct("doc_id", "at")).alias("p"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").select(F.col("g").bitwiseXOR(F.lit(1).cast("long")).alias("h"), F.col("p.doc_id").alias("pivot"),
                        F.col("p.at").alias("p_at"))
    met = anchors.join(pivots, "h").where("doc_id <> pivot or at <> p_at")
    chains = met.groupBy("doc_id", "pivot", (F.col("at") - F.col("p_at")).alias("diag")).agg(
        F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"),
        F.min("lo").alias("a0"), (F.max("hi") + window - 1).alias("a1"))
    # a pivot's text travels once a part; no family has more documents than there are, so a part has some CHAINS of them
    part = F.pmod(F.xxhash64("doc_id"), F.lit(text.count() // CHAINS + 1))
    by_pivot = chains.groupBy("pivot", part.alias("part")).agg(
        F.collect_list(F.struct("doc_id", "diag", "a0", "a1", "lo", "hi")).alias("chains"))
    beside = by_pivot.join(text.select(F.col("doc_id").alias("pivot"), "text"), "pivot").mapInArrow(
        _beside, "doc_id long, pivot long, a0 int, a1 int, lo array<int>, hi array<int>, p0 int, s0 int, copy long, beside binary")
    by_doc = beside.groupBy("doc_id").agg(F.collect_list(
        F.struct("pivot", "a0", "a1", "lo", "hi", "p0", "s0", "copy", "beside")).alias("chains"))
    windows = by_doc.join(text, "doc_id").mapInArrow(
        _extend(window), "h long, h2 long, doc_id long, s int, e int, sure boolean")
    least = F.first("doc_id").over(Window.partitionBy("h", "h2").orderBy("doc_id"))
    return windows.withColumn("least", least).where("sure or doc_id > least").select("doc_id", "s", "e")


def _remove(it):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.list_(pa.int32()))), ("kept_text", pa.string())])
    for batch in it:
        get = lambda n: batch.column(batch.schema.get_field_index(n))
        for at in range(0, batch.num_rows, 200):
            rows = []
            for doc, text, s, e in zip(*(get(c).slice(at, 200).to_pylist() for c in ("doc_id", "text", "s", "e"))):
                words = (text or "").encode().split()      # at 0x20 and 0x09-0x0D
                gone = covered(len(words), np.array(s or [], np.int64), np.array(e or [], np.int64))
                a, b = runs(gone)
                kept = [w for w, g in zip(words, gone) if not g] if len(a) else words
                rows.append((doc, len(words), int(gone.sum()), np.stack((a, b), 1).tolist(), b" ".join(kept).decode()))
            yield arrays(schema, *zip(*rows))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_removed``, ``spans`` (removed
    runs of words) and ``kept_text`` (the words left, joined by a space).
    Arrow
    batches of a session that sets no size are cut at 8 MB."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    text = spread(rows.where("doc_id is not null"), "doc_id")       # one exchange, read by all joins
    spans = repeats(text, window).groupBy("doc_id").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))
    none = F.lit(None).cast(spans.schema["s"].dataType)
    whole = rows.where("doc_id is null").withColumns({"s": none, "e": none})
    schema = "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept_text string"
    return text.join(spans, "doc_id", "left").mapInArrow(_remove, schema).unionByName(whole.mapInArrow(_remove, schema))
