"""N-gram Jaccard join of documents by a size-aware heavy-light plan.

A document's set holds its distinct word shingles. Two sets link when their
Jaccard similarity is at least ``num / den``. The plan, for sets in one
global token order (rare first):

* ``need(n) = ceil(n * num / den)`` tokens of a set of ``n`` must be shared,
  so two linked sets share k of their first ``n - need(n) + k`` tokens.
* small sets (``n <= boundary``) list every 2-subset of that prefix with
  k = 2 as a key; large sets list each token of the prefix with k = 1, an
  inverted list. Sets of up to ``boundary * den / num`` do both, so every
  pair meets in the index of its smaller set. The boundary is where the
  number of subsets passes the expected length of the lists to scan.
* in a key's list all members are compared with one pivot (a star). Pivots
  differ by key. Pairs still in different components after that, and whose
  distances to the pivot differ by no more than the threshold (Jaccard
  distance is a metric), are compared too. So no link between components
  is lost, and a family of n copies doesn't make n * n pairs.

Every candidate is verified on its whole sets. Frequent tokens come last in
the order. Which tokens are frequent is counted over all documents, by tokens
that repeat within a task; at most ``max_frequent`` are sent to the tasks (8
MB), and a rarer cut is taken beyond that. The order only steers cost.

Nulls, empty texts and texts without words give an empty set, linked with
nothing; rows with a null id are dropped, repeated ids count as one document
(the union of its sets is not taken: the smallest set hash wins).
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logmart.llm.common import U64, Hasher, arrays, connected_components, kept, sub_batches
from logmart.session import discard

SHINGLE = 5
NUM, DEN = 80, 100
FREQUENT = 64
MAX_FREQUENT = 1 << 20
STARS = 4
CELL, CELLS = 5_000, 5      # pairs of a cell, cells a side at most


def _sets(hasher: Hasher, texts: list[bytes], k: int):
    """Sorted distinct shingle hashes of each text."""
    h, at = hasher.words(texts, lower=True)
    whole = hasher.shingles(h, k)
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= k:
            yield np.unique(whole[a : b - k + 1])
        elif b > a:
            yield hasher.shingles(h[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _set_id(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        x = Hasher.mix(np.array([Hasher.mix(s).sum(dtype=np.uint64) + U64(len(s))], np.uint64))
    return int(x.view(np.int64)[0])


def _profile(k: int):
    """Per document its set's id and size; per task, the tokens that repeat
    in it with their counts (rows without doc_id)."""
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.int64()), ("n", pa.int64())])

    def run(it):
        hasher, kept, held = Hasher(), [], 0

        def repeats():
            token, count = np.unique(np.concatenate(kept), return_counts=True)
            token, count = token[count > 1], count[count > 1]
            return arrays(schema, pa.nulls(len(token), pa.int64()), token.view(np.int64), count)

        for batch in it:
            ids = batch.column(0).to_pylist()
            for at, texts in sub_batches(batch, "text"):
                sets = list(_sets(hasher, texts, k))
                yield arrays(schema, ids[at : at + len(texts)], [_set_id(s) for s in sets], [len(s) for s in sets])
                kept += sets
                held += sum(map(len, sets))
                if held > 8_000_000:
                    yield repeats()
                    kept, held = [], 0
        if held:
            yield repeats()

    return run


def _prefix_rows(k: int, num: int, den: int, boundary: int, frequent):
    """(key, sid, n) rows of the two indexes."""
    schema = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int32())])
    with_subsets = boundary * den // num

    def run(it):
        hasher = Hasher()
        often, rank = frequent.value          # sorted tokens, their place by frequency
        for batch in it:
            for _, texts in sub_batches(batch, "text"):
                keys, sids, sizes = [], [], []
                for s in _sets(hasher, texts, k):
                    n = len(s)
                    if n < 2:
                        continue
                    if len(often):
                        place = np.searchsorted(often, s)
                        place[place == len(often)] = 0
                        hit = often[place] == s
                        if hit.any():
                            s = np.concatenate((s[~hit], s[hit][np.argsort(rank[place[hit]], kind="stable")]))
                    need = -(-n * num // den)
                    got = []
                    if n > boundary:
                        got.append(s[: n - need + 1])
                    if n <= with_subsets and need >= 2:
                        p = s[: n - need + 2]
                        a, b = np.triu_indices(len(p), 1)
                        x, y = np.minimum(p[a], p[b]), np.maximum(p[a], p[b])
                        got.append(hasher.mix(x * hasher.odd[0] + y * hasher.odd[1]))
                    if got:
                        got = np.concatenate(got)
                        keys.append(got)
                        sids.append((_set_id(np.sort(s)), len(got)))
                        sizes.append(n)
                if keys:
                    reps = [c for _, c in sids]
                    yield arrays(schema, np.concatenate(keys).view(np.int64),
                                 np.repeat(np.array([s for s, _ in sids], np.int64), reps),
                                 np.repeat(np.array(sizes, np.int32), reps))

    return run


def _set_rows(k: int):
    schema = pa.schema([("sid", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(it):
        hasher = Hasher()
        for batch in it:
            for _, texts in sub_batches(batch, "text"):
                sets = list(_sets(hasher, texts, k))
                yield arrays(schema, [_set_id(s) for s in sets], [s.view(np.int64) for s in sets])

    return run


def _similar(pairs: DataFrame, left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """pairs(a, b) of the sets ``left`` and ``right`` with ``inter`` (shared tokens), ``total`` (of the union)
    and ``linked``."""
    a = left.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    b = right.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("inter", F.size(F.array_intersect("ta", "tb")))
    out = both.select("a", "b", "inter", (F.size("ta") + F.size("tb") - F.col("inter")).alias("total"))
    return out.withColumn("linked", F.col("inter") * den >= F.col("total") * num)


def _compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``_similar`` cell by cell: the pairs of some sets a with some sets b,
    so that few pairs and sets are on disk beside each other at a time."""
    side = min(CELLS, 1 + math.isqrt(pairs.count() // CELL))
    in_part = lambda c, i: F.pmod(F.col(c), F.lit(side)) == i
    cells = []
    for i, j in product(range(side), repeat=2):
        cells.append(kept(_similar(pairs.where(in_part("a", i) & in_part("b", j)), sets.where(in_part("sid", i)),
                                   sets.where(in_part("sid", j)), num, den), "near"))
    return reduce(DataFrame.unionByName, cells)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       num: int = NUM, den: int = DEN, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``,
    the smallest id reachable by links (its own included)."""
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        "doc_id is not null")
    both = kept(text.mapInArrow(_profile(shingle), "doc_id long, sid long, n long"), "profile")
    doc_sets = kept(both.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("sid", "n")).alias("s")).select(
        "doc_id", "s.*"), "documents")
    counts = kept(both.where("doc_id is null").groupBy(F.col("sid").alias("token")).agg(F.sum("n").alias("df")), "counts")
    discard(both)

    # frequent tokens: as many as max_frequent allows, rarer cuts doubled until they fit
    total = doc_sets.agg(F.sum("n")).first()[0] or 0
    cut = FREQUENT
    tiers = {r[0]: (r[1], r[2]) for r in counts.groupBy(F.floor(F.log2("df")).cast("int")).agg(
        F.count(F.lit(1)), F.sum(F.col("df") * F.col("df"))).collect()}
    while sum(n for t, (n, _) in tiers.items() if 2**t >= cut) > max_frequent:
        cut *= 2
    rows = counts.where(F.col("df") >= cut).orderBy("df", "token").limit(max_frequent).toPandas()
    discard(counts)
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    often = spark.sparkContext.broadcast((tokens[order], order.astype(np.int64)))

    # sets are small while their subsets are fewer than the entries that a scan of their lists would meet
    scanned = sum(sq for t, (_, sq) in tiers.items() if 2**t < cut)
    length = 1 + scanned / max(1, total)
    boundary = max(n for n in range(1, 400) if (p := n - -(-n * num // den) + 1) * (p + 1) / 2 <= p * (1 + length))

    index = text.mapInArrow(_prefix_rows(shingle, num, den, boundary, often), "key long, sid long, n int")
    first = Window.partitionBy("key").orderBy(F.xxhash64("sid", F.pmod("key", F.lit(STARS))), "sid")
    stars = kept(index.withColumns({"pivot": F.first("sid").over(first), "pn": F.first("n").over(first)})
                 .where("sid <> pivot").select("key", "sid", "n", "pivot", "pn").distinct(), "stars")
    sized = F.least("n", "pn") * den >= F.greatest("n", "pn") * num

    members = stars.select("sid").union(stars.select("pivot")).distinct()
    reps = doc_sets.groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    wanted = members.join(reps, "sid")
    sets = kept(text.join(wanted, "doc_id").select("text")
                .mapInArrow(_set_rows(shingle), "sid long, tokens array<long>").dropDuplicates(["sid"]), "sets")

    pairs = kept(stars.where(sized).select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    near = _compared(pairs, sets, num, den)
    discard(pairs)
    links = near.where("linked").select("a", "b")
    parts = connected_components(links)

    # pairs of one list that are still in different components
    listed = stars.select("key", "sid", "n", "pivot").unionByName(
        stars.select("key", F.col("pivot").alias("sid"), F.col("pn").alias("n"), "pivot").distinct())
    far = near.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), (1 - F.col("inter") / F.col("total")).alias("d"))
    listed = listed.join(parts.withColumnRenamed("id", "sid"), "sid", "left").join(far, ["sid", "pivot"], "left")
    listed = listed.select("key", "sid", "n", F.coalesce("component", "sid").alias("c"),
                           F.when(F.col("sid") == F.col("pivot"), 0.0).otherwise(F.col("d")).alias("d"),
                           (F.col("sid") == F.col("pivot")).alias("is_pivot"))
    split = listed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    open_ = kept(listed.where("not is_pivot").join(split, "key"), "open")
    discard(stars)
    x = open_.select("key", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("d").alias("da"))
    y = open_.select("key", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("d").alias("db"))
    slack = (den - num) / den + 1e-9
    rest = x.join(y, "key").where(
        (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
        & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
        & (F.col("da").isNull() | F.col("db").isNull() | (F.abs(F.col("da") - F.col("db")) <= slack))
    ).select("a", "b").distinct()
    rest = kept(rest, "rest")
    discard(open_)
    more_near = _compared(rest, sets, num, den)
    more = more_near.where("linked").select("a", "b")
    all_links = links.unionByName(more)
    sid_parts = connected_components(all_links)
    for df in (sets, near, rest, more_near):
        discard(df)

    # set components -> smallest document of any set in them
    in_part = doc_sets.where("n > 0").join(sid_parts.withColumnRenamed("id", "sid"), "sid", "left").withColumn(
        "c", F.coalesce("component", "sid"))
    least = in_part.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    with_words = in_part.join(least, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(doc_sets.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
