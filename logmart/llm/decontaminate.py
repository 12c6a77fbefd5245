"""Benchmark decontamination: a BM25 index of the test items, block-max WAND
over every training passage, and a check of question and answer.

Items are the indexed texts, passages the queries. A passage is ``2 * stride``
words; passages overlap by half, and the stride is at least the longest item,
so every item that a document holds lies inside one passage. Impacts are BM25
weights divided by the item's own total, so a score is the share of the item
(by weight) that the passage has, and one threshold fits all items.

* postings are grouped in blocks of ``BLOCK`` items with the largest impact
  of each term and block. Terms in most items (whose impacts together stay
  under half the threshold for every item) never open a block; a block's
  bound is what they may add at most, plus its block maxima of the other
  terms of the passage. Blocks bounded below the threshold are skipped.
* items of the blocks left are scored in full (exactly; blocks are small, as
  a bound grows with the items it covers), and all at or above the
  threshold are retrieved.
* of those, passages must hold ``overlap`` of the word n-grams of the
  question and of the answer.

Statistics cover all items. The index is sent to the tasks in parts of about
``PART`` characters of items, each against all passages, so what a task holds
is bounded for any number of items. Texts are read once a part and never
shuffled; only hits are.

Null texts have no words; items without words are left out. Rows with a null
id are reported with a null id. Repeated items are hits of their own.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmart.llm.common import Hasher, saved, sub_batches

K1, B = 1.2, 0.75
BLOCK = 2
CELLS = 4_000_000      # passages times blocks whose bounds a task sums at once
PART = 4_000_000
THRESHOLD = 0.5
OVERLAP = 0.5
NGRAM = 3
STRIDE = 64

WORD = re.compile(r"\w+")
OTHER = re.compile(r"[^\w\x00-\x7f]+")      # non-ASCII that parts words
HIT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word int"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of question and answer of an item given as one text: the last
    sentence is the answer if both parts have words enough for an n-gram,
    else the second half."""
    parts = re.split(r"(?<=[.!?])\s+", (text or "").strip())
    q, a = words(" ".join(parts[:-1])), words(parts[-1])
    if min(len(q), len(a)) < NGRAM:
        w = q + a
        q, a = w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]
    return q, a


class Words:
    """Word hashes of texts: the words of ``words()``, found in the bytes."""

    def __init__(self):
        self.hasher = Hasher()
        self.hasher.space = np.array([c < 128 and not (chr(c).isalnum() or c == 95) for c in range(256)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in a row, and each text's first word (one
        entry more)."""
        lower = (t.lower() for t in texts)
        return self.hasher.words([(t if t.isascii() else OTHER.sub(" ", t)).encode("utf-8", "replace") for t in lower])

    def grams(self, h: np.ndarray, n: int) -> np.ndarray:
        return np.unique(self.hasher.shingles(h, n))


def _expand(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places first[i] .. first[i] + n[i] - 1 of every list, and its i."""
    of = np.repeat(np.arange(len(n)), n)
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(of)), of


class Index:
    """Impacts of some items, with statistics of all. Lists of a term are
    runs in arrays: of items (``item``, ``impact``) and of blocks (``block``,
    ``most``; empty for terms that never open one)."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], df: dict[str, int], n: int, mean: float, threshold: float):
        items = sorted(items, key=lambda x: (len(x[1]) + len(x[2]), x[0]))
        self.ids, self.threshold = [i for i, _, _ in items], threshold
        self.impacts: list[dict[str, float]] = []
        holders = defaultdict(list)
        for i, (_, q, a) in enumerate(items):
            w = q + a
            norm = K1 * (1 - B + B * len(w) / mean)
            one = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in Counter(w).items()}
            total = sum(one.values())
            self.impacts.append({t: x / total for t, x in one.items()})
            for t, x in self.impacts[-1].items():
                holders[t].append((i, x))
        # terms that never open a block: the most frequent, while they stay under half the threshold in every item
        spent, common = [0.0] * len(items), set()
        for t in sorted(holders, key=lambda t: (-df[t], t)):
            if any(spent[i] + x >= threshold / 2 for i, x in holders[t]):
                break
            common.add(t)
            for i, x in holders[t]:
                spent[i] += x
        self.blocks = -(-len(items) // BLOCK)
        self.may_add = np.array([max(spent[b * BLOCK : (b + 1) * BLOCK]) for b in range(self.blocks)])

        # terms by hash; per term the runs of its items and blocks
        self.words = Words()
        names = list(holders)
        h, _ = self.words([" ".join(names)])
        order = np.argsort(h)
        self.hashes, names = h[order], [names[k] for k in order]
        of_item, of_block, n_item, n_block = [], [], [], []
        for t in names:
            best: dict[int, float] = {}
            for i, x in holders[t] if t not in common else ():
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), x)
            of_item += holders[t]
            of_block += best.items()
            n_item.append(len(holders[t]))
            n_block.append(len(best))
        self.item, self.impact = np.array([i for i, _ in of_item], np.int64), np.array([x for _, x in of_item])
        self.block, self.most = np.array([i for i, _ in of_block], np.int64), np.array([x for _, x in of_block])
        self.n_block = np.array(n_block, np.int64)
        self.first_block = np.cumsum(self.n_block) - self.n_block
        # the items of a term and block are a run too: found by term * blocks + block
        key = np.repeat(np.arange(len(names)), n_item) * self.blocks + self.item // BLOCK
        self.runs, self.first_item, self.n_item = np.unique(key, return_index=True, return_counts=True)

        # n-grams of question and answer
        self.parts = []
        for _, q, a in items:
            h, _ = self.words([" ".join(q + a)])
            self.parts.append([(k, self.words.grams(x, k)) for x in (h[: len(q)], h[len(q) :]) for k in [min(NGRAM, len(x))] if k])

    def _terms(self, h: np.ndarray, at: np.ndarray, stride: int):
        """Passages of each text, and the distinct (passage, term) pairs."""
        passages = np.maximum(1, -(-np.diff(at) // stride))
        base = np.cumsum(passages) - passages
        t = np.searchsorted(self.hashes, h)
        t[t == len(self.hashes)] = 0
        place = np.flatnonzero(self.hashes[t] == h)
        t = t[place]
        text = np.searchsorted(at, place, side="right") - 1
        p = (place - at[text]) // stride
        # each place lies in two passages (the first stride words in one)
        g, again = base[text] + p, p > 0
        pair = np.unique(np.concatenate((g, g[again] - 1)) * len(self.hashes) + np.concatenate((t, t[again])))
        return passages, pair // len(self.hashes), pair % len(self.hashes)

    def _open(self, p: np.ndarray, t: np.ndarray):
        """(passage, block) whose bound reaches the threshold. The sums are
        taken for ``CELLS`` passages times blocks at a time."""
        step = max(1, CELLS // self.blocks)
        for lo in range(0, int(p[-1]) + 1 if len(p) else 0, step):
            a, b = np.searchsorted(p, (lo, lo + step))
            post, of = _expand(self.first_block[t[a:b]], self.n_block[t[a:b]])
            if len(post):
                cell = (p[a:b][of] - lo) * self.blocks + self.block[post]
                bound = np.bincount(cell, self.most[post])
                met = np.flatnonzero(bound)
                met = met[bound[met] + self.may_add[met % self.blocks] >= self.threshold - 1e-9]
                yield met // self.blocks + lo, met % self.blocks

    def open_blocks(self, doc: list[str], stride: int) -> list[tuple[int, int]]:
        h, at = self.words([" ".join(doc)])
        _, p, t = self._terms(h, at, stride)
        return [(int(x), int(y)) for got in self._open(p, t) for x, y in zip(*got)]

    def hits(self, texts: list[str], stride: int, overlap: float):
        """The best passage of each item found in each text: (text, item,
        score, question, answer, first word)."""
        h, at = self.words(texts)
        passages, p, t = self._terms(h, at, stride)
        base = np.cumsum(passages) - passages
        best: dict[tuple[int, int], tuple] = {}
        for op, ob in self._open(p, t):
            # full scores of the open blocks' items, some passages at a time
            for lo in range(0, len(op), 20_000):
                q, b = op[lo : lo + 20_000], ob[lo : lo + 20_000]
                a = np.searchsorted(p, q)
                place, of = _expand(a, np.searchsorted(p, q, side="right") - a)
                key = t[place] * self.blocks + b[of]
                run = np.searchsorted(self.runs, key)
                run[run == len(self.runs)] = 0
                have = self.runs[run] == key
                run, of = run[have], of[have]
                post, which = _expand(self.first_item[run], self.n_item[run])
                cell = of[which] * BLOCK + self.item[post] % BLOCK
                score = np.bincount(cell, self.impact[post], minlength=1)
                for c in np.flatnonzero(score >= self.threshold).tolist():
                    self._verify(h, at, base, int(q[c // BLOCK]), int(b[c // BLOCK]) * BLOCK + c % BLOCK, float(score[c]),
                                 stride, overlap, best)
        return [(x, self.ids[i], *got) for (x, i), got in sorted(best.items())]

    def _verify(self, h, at, base, passage, i, score, stride, overlap, best) -> None:
        text = int(np.searchsorted(base, passage, side="right")) - 1
        if score <= best.get((text, i), (0.0,))[0]:
            return
        first = (passage - int(base[text])) * stride
        inside = h[at[text] + first : min(at[text] + first + 2 * stride, at[text + 1])]
        held = [float(np.isin(g, self.words.grams(inside, k)).mean()) for k, g in self.parts[i]]
        if min(held) >= overlap:
            best[text, i] = (score, held[0], held[1] if len(held) > 1 else 1.0, first)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, part: int = PART) -> DataFrame:
    """One row per document and item found: ``doc_id``, ``item_id``,
    ``score``, ``question_overlap``, ``answer_overlap``, ``first_word`` (of
    the best passage)."""
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("item_id", pa.int64()), ("q", pa.list_(pa.string())), ("a", pa.list_(pa.string()))])

    def split(it):
        for batch in it:
            rows = [(i, *question_answer(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    parsed = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("t")).mapInArrow(
        split, "item_id long, q array<string>, a array<string>").withColumn("w", F.concat("q", "a")).where(F.size("w") > 0)
    parsed = saved(parsed.withColumn("row", F.monotonically_increasing_id()))
    n, mean, chars, longest = parsed.agg(
        F.count(F.lit(1)), F.avg(F.size("w")), F.sum(F.length(F.array_join("w", " "))), F.max(F.size("w"))).first()
    if not n:
        return spark.createDataFrame([], HIT)
    stride = max(STRIDE, longest)
    parts = -(-chars // part)
    parsed = parsed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    df = parsed.select("row", F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    out = None
    for k in range(parts):
        mine = saved(parsed.where(F.col("part") == k))
        rows = mine.select("item_id", "q", "a").collect()                    # about ``part`` characters
        if not rows:
            continue
        terms = mine.select(F.explode("w").alias("t")).distinct().join(df, "t").collect()
        # by value: workers need no installed package
        index = spark.sparkContext.broadcast(cloudpickle.dumps(
            Index([(r[0], r[1], r[2]) for r in rows], {r[0]: r[1] for r in terms}, n, mean, threshold)))

        def scan(it, index=index):
            items = pickle.loads(index.value)
            found_schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), (
                "question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int32())])
            for batch in it:
                ids = batch.column(0).to_pylist()
                found = [(ids[at + i], *hit) for at, texts in sub_batches(batch, "text")
                         for i, *hit in items.hits([t.decode() for t in texts], stride, overlap)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), found_schema)],
                                                     schema=found_schema)

        hits = text.mapInArrow(scan, HIT)
        out = hits if out is None else out.unionByName(hits)
    return out
