"""Best-fit packing of documents into sequences by bin completion.

Tokenise, cut documents longer than a sequence (the first piece takes the
rest), and pack the pieces into as few sequences as possible. How full
sequences can get depends only on how many pieces there are of each length,
and there are at most ``capacity`` lengths. So the search runs on that
histogram, whatever the input's size, and gives patterns (lengths of one
sequence, number of such sequences). Pieces take their places by their rank
among those of one length. A length that holds many pieces is ranked in
salted parts, whose counts give the offsets.

The search is branch and bound: fill a sequence around the largest piece
left, branch over undominated fillings (a filling is dominated by one that
puts a larger piece in the place of smaller ones), best fit first, and
prune where the waste so far shows that the best packing known can't be
beaten. Best-fit decreasing gives the first incumbent. It ends at the lower
bound, or after ``nodes`` nodes with the best packing found.

Null texts are empty; an empty document is the end id alone. Rows with a
null id or a repeated id are pieces like others.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmart.llm.common import saved, sub_batches

CAPACITY = 2048
END_ID = 0
SALTS = 64
NODES = 20_000
BATCH = 12_000_000     # bytes of text whose words are encoded once
CACHE, LONGEST = 600_000, 32   # words whose ids a Python worker keeps, their characters at most
ROW = 4096              # words encoded in a row

Pattern = tuple[tuple[int, ...], int]


# -- the search ---------------------------------------------------------

def lower_bound(count: Counter, capacity: int) -> int:
    """Sequences needed at least: by volume, and by the pieces over half
    with what can't go beside them (Martello and Toth's L2)."""
    volume = -(-sum(k * n for k, n in count.items()) // capacity)
    best = volume
    for small in sorted({k for k in count if 2 * k <= capacity} | {0}):
        big = sum(n for k, n in count.items() if k > capacity - small)
        mid = [(k, n) for k, n in count.items() if capacity < 2 * k <= 2 * (capacity - small)]
        free = sum(n * (capacity - k) for k, n in mid)
        load = sum(k * n for k, n in count.items() if small <= k and 2 * k <= capacity)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(load - free) // capacity)))
    return best


def best_fit(count: Counter, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram: equal bins are one entry."""
    open_: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((lengths, n))

    for k in sorted(count, reverse=True):
        left = count[k]
        while left:
            i = bisect.bisect_left(rooms, k)
            if i == len(rooms):
                each = min(capacity // k, left)
                put(capacity - each * k, (k,) * each, left // each)
                left -= left // each * each
                continue
            room = rooms[i]
            lengths, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = min(room // k, left)
            bins = min(n, left // each)
            if bins < n:
                put(room, lengths, n - bins)
            put(room - each * k, lengths + (k,) * each, bins)
            left -= bins * each
    return [p for ps in open_.values() for p in ps]


def fillings(lengths: list[int], count: Counter, room: int, most: int) -> list[tuple[int, ...]]:
    """Up to ``most`` undominated fillings of ``room``, fullest first, larger
    pieces before smaller ones. An exact fit by one piece dominates all."""
    if count.get(room):
        return [(room,)]
    out: list[tuple[int, ...]] = []
    steps = 0

    def add(start: int, left: int, got: tuple[int, ...]) -> bool:
        nonlocal steps
        steps += 1
        fits = bisect.bisect_left(lengths, -left)      # lengths are negative, ascending
        longer = True
        for i in range(max(start, fits), len(lengths)):
            k = -lengths[i]
            if got.count(k) >= count[k]:
                continue
            longer = False
            if add(i, left - k, (*got, k)):
                return True
            if steps > 50 * most or left == k:
                break
        if longer:                                     # nothing more fits: a maximal filling
            out.append(got)
        return bool(out) and sum(out[-1]) == room
    add(0, room, ())
    out.sort(key=lambda f: (-sum(f), [-x for x in f]))
    kept: list[tuple[int, ...]] = []
    for f in out:
        if not any(len(g) <= len(f) and sum(g) >= sum(f) and all(a >= b for a, b in zip(g, f)) for g in kept):
            kept.append(f)
        if len(kept) == most:
            break
    return kept or [()]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns that hold exactly ``counts`` pieces of each length."""
    count = Counter({k: n for k, n in counts.items() if n})
    if not count:
        return []
    bound = lower_bound(count, capacity)
    best = best_fit(count, capacity)
    best_n = sum(n for _, n in best)
    total = sum(k * n for k, n in count.items())
    left_nodes = nodes
    # an explicit stack: (count, patterns, sequences so far, waste so far)
    stack = [(count, [], 0, 0)]
    while stack and best_n > bound and left_nodes:
        left_nodes -= 1
        have, made, n_made, waste = stack.pop()
        if not have:
            if n_made < best_n:
                best, best_n = made, n_made
            continue
        # all other sequences full: already as many as the best packing?
        if -(-(total + waste) // capacity) >= best_n:
            continue
        top = max(have)
        rest = have.copy()
        rest[top] -= 1
        lengths = [-k for k in sorted(rest, reverse=True) if rest[k]]
        for f in reversed(fillings(lengths, rest, capacity - top, 4)):
            use = Counter((top, *f))
            times = min(have[k] // n for k, n in use.items())
            after = Counter({k: n - times * use[k] for k, n in have.items() if n - times * use[k]})
            stack.append((after, [*made, ((top, *f), times)], n_made + times,
                          waste + times * (capacity - top - sum(f))))
    return best


def places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, sequence, pieces of that length in a
    sequence, offset of the first), by length and rank."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for k, each in sorted(Counter(lengths).items(), reverse=True):
            rows.append((k, used[k], sequence, each, offset))
            used[k] += each * n
            offset += each * k
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# -- tokens -------------------------------------------------------------

def _encoder(path: str):
    """texts (UTF-8) -> arrays of their ids.

    A single space between two other characters always begins a new piece
    of the tokenizer's split pattern. So a batch's texts are cut at spaces,
    its distinct words are encoded once, many in a row, and each text is put
    together from their ids. In a row of words the ids of each are told by
    their lengths in bytes; a Python worker keeps those of up to ``CACHE``
    words from task to task. Texts with wider space anywhere, or with a literal
    special token, are encoded whole."""
    import json
    import os
    import sys
    from types import ModuleType

    import pyarrow.compute as pc
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    held = sys.modules.setdefault("logmart_worker_tokenizer", ModuleType("logmart_worker_tokenizer"))
    if getattr(held, "path", None) != path:
        tok = Tokenizer.from_file(path)
        vocab = tok.get_vocab(with_added_tokens=True)
        width = np.zeros(max(vocab.values(), default=0) + 1, np.int64)      # a byte is a character of the vocabulary
        width[list(vocab.values())] = list(map(len, vocab))
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        steps = json.loads(tok.to_str())
        by_word = not steps["normalizer"] and "ByteLevel" in str(steps["pre_tokenizer"]) and not any(" " in x for x in special)
        held.words: dict[str, bytes] = {}
        held.tok, held.path, held.width, held.special, held.by_word = tok, path, width, special, by_word
    spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in held.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def after_space(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words with a space before each, and how many each has."""
        found = list(map(held.words.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        rows = [new[i : i + ROW] for i in range(0, len(new), ROW)]
        got = np.concatenate([np.zeros(0, "<u4"), *encode([" " + " ".join(r) for r in rows])])
        ends = np.cumsum(np.fromiter((1 + len(w.encode()) for w in new), np.int64, len(new)))
        last = (4 * np.searchsorted(np.cumsum(held.width[got]), ends) + 4).tolist()
        raw = got.tobytes()
        parts = [raw[a:b] for a, b in zip([0, *last], last)]
        fresh = iter(parts)
        found = [next(fresh) if x is None else x for x in found]
        if len(held.words) + len(new) > CACHE:
            held.words = {}
        held.words.update((w, x) for w, x in zip(new[:CACHE], parts) if len(w) <= LONGEST)
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def ids(texts: list[bytes]) -> list[np.ndarray]:
        if not held.by_word:
            return encode([t.decode() for t in texts])
        split = pc.split_pattern(pa.array(texts, pa.large_binary()).cast(pa.large_string()), " ")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        words = coded.dictionary
        code = coded.indices.to_numpy()
        trimmed = pc.utf8_trim(words, characters=spaces)
        odd = pc.or_(pc.equal(words, ""), pc.not_equal(words, trimmed))     # not alone between single spaces
        for x in held.special:
            odd = pc.or_(odd, pc.match_substring(words, x))
        odd = odd.to_numpy(zero_copy_only=False)
        # code 2 * c + 1: word c after a space, 2 * c: at its text's start
        code = code.astype(np.int64) * 2 + 1
        code[first[:-1]] -= 1
        used = np.zeros(2 * len(words), bool)
        used[code] = True
        used &= ~np.repeat(odd, 2)
        later, start = np.flatnonzero(used[1::2]), np.flatnonzero(used[::2])
        pool, n_later = after_space(words.take(pa.array(later)).to_pylist())
        at_start = encode(words.take(pa.array(start)).to_pylist())
        size, place = np.zeros((2, 2 * len(words)), np.int64)
        size[2 * later + 1] = n_later
        place[2 * later + 1] = np.cumsum(n_later) - n_later
        size[2 * start] = n_start = np.fromiter(map(len, at_start), np.int64, len(at_start))
        place[2 * start] = len(pool) + np.cumsum(n_start) - n_start
        pool = np.concatenate([pool, *at_start])
        n = size[code]
        ends = np.concatenate(([0], np.cumsum(n)))
        joined = pool[np.arange(ends[-1]) + np.repeat(place[code] - ends[:-1], n)]
        out = [joined[a:b] for a, b in zip(ends[first[:-1]], ends[first[1:]])]
        whole = np.flatnonzero(np.logical_or.reduceat(odd[code // 2], first[:-1])).tolist()
        for i, x in zip(whole, encode([texts[i].decode() for i in whole])):
            out[i] = x
        return out

    return ids


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if
    kept, ``ids`` (little-endian unsigned 32 bit)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def cut(doc, ids: bytes):
        n = len(ids) // 4
        bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
        for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
            part = ids[4 * a : 4 * b]
            yield doc, p, a, b - a, zlib.crc32(part), part if keep_ids else None

    def run(it):
        encode, end = _encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in it:
            for at, texts in sub_batches(batch, "text", BATCH):
                rows = []
                for doc, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), encode(texts)):
                    rows += cut(doc, ids.tobytes() + end)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset``."""
    cols = pieces.columns
    kept = saved(pieces.withColumn("_row", F.monotonically_increasing_id()))
    full = kept.where(F.col("length") == capacity).select(
        *cols, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = kept.where(F.col("length") < capacity).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
    # at most capacity x SALTS rows
    counts = saved(part.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row"))
    ranked = part.withColumn("_rank", rank).join(F.broadcast(firsts), ["length", "_salt"]).select(
        *cols, (F.col("_first") + F.col("_rank") - 1).alias("_rank"))
    table = places(pack_lengths(by_length, capacity, nodes))

    def run(it):
        keys = table[:, 0] << 40 | table[:, 1]
        for batch in it:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            length = batch.column(at["length"]).to_numpy(zero_copy_only=False)
            r = batch.column(at["_rank"]).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length << 40 | r, side="right") - 1].reshape(-1, 5)
            k = r - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[c]) for c in cols), pa.array(row[:, 2] + k // row[:, 3]),
                 pa.array(row[:, 4] + k % row[:, 3] * length)], names=[*cols, "sequence_id", "offset"])

    return full.unionByName(ranked.mapInArrow(run, full.schema))
