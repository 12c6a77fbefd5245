"""Near duplicates among embeddings by int8 tile products with error bounds.

Vectors are compared when their labels (and lengths) are equal; two link when
their cosine in double precision is at least ``threshold``.

1. Exact copies of a vector are one class (two 64-bit hashes of label and
   components); its smallest id stands for it and carries their number.
   Copies link with each other without being compared.
2. The classes of a label are dealt by hash into tiles of about ``tile``
   vectors (fewer if they are long: ``tile_bytes``), every class to each pair
   of tiles it belongs to. So a hot label is many groups of bounded size.
3. In a pair of tiles the unit vectors are quantised, x = s * q + e with q of
   int8 and the length of e measured. Then
   ``|cos(x, y) - s s' (q . q')| <= |e| |s'q'| + |sq| |e'| + |e| |e'|``.
   The products q . q' come from block-wise matrix products, which are exact
   (sums below 2**24 in float32, else float64). Only pairs whose upper bound
   reaches the threshold are computed again in double precision.
4. A pair of tiles gives at most one row a vector: how many vectors it links
   with and the smallest id it is connected to there. Links are summed by
   id, and the rows are the links from which components are made. So a
   family of n near copies doesn't make n * n rows.

Vectors that are null, zero or hold null or non-finite components, and those
without a label or an id, link with nothing; without an id the component is
null and the row is kept. Repeated rows (id, label and vector equal) count
once and come back repeated; an id with several vectors has the links of all
of them. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmart.llm.common import arrays, connected_components, saved

THRESHOLD = 0.98
TILE = 16_384
TILE_BYTES = 32 << 20
BLOCK = 2048
#: Beyond the rounding of the bounds (float32 scaling, double sums).
SLACK = 1e-6
CLASS = ["label", "dim", "h1", "h2"]


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two (exact) and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, np.sqrt(np.einsum("ij,ij->i", x, x))


def quantise(x: np.ndarray, length: np.ndarray):
    """Per vector of ``x / length``: int8 values q, the scale s, |s * q| and
    the length of the rest."""
    u = x / length[:, None]
    s = np.abs(u).max(1) / 127
    q = np.rint(u / s[:, None])
    back = q * s[:, None]
    return q.astype(np.int8), s, np.linalg.norm(back, axis=1), np.linalg.norm(u - back, axis=1)


def close_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, block: int = BLOCK
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i < j if the two lists are the same) with a cosine of
    at least ``threshold``, one from each list, block by block."""
    x, length = _unit(x)
    q, s, size, rest = quantise(x, length)
    exact = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64
    same = left is right
    for a in range(0, len(left), block):
        i = left[a:a + block]
        qi = q[i].astype(exact)
        for b in range(a if same else 0, len(right), block):
            j = right[b:b + block]
            bound = qi @ q[j].astype(exact).T               # int8 products, exact
            bound *= s[j].astype(exact)
            error = rest[i] * (size[j] + rest[j]).max() + size[i] * rest[j].max()
            near, far = np.nonzero(bound >= ((threshold - SLACK - error) / s[i]).astype(exact)[:, None])
            p, r = i[near], j[far]
            upper = bound[near, far] * s[p] + rest[p] * (size[r] + rest[r]) + size[p] * rest[r]
            able = upper >= threshold - SLACK
            if same and a == b:
                able &= p < r
            p, r, near, far = p[able], r[able], near[able], far[able]
            if len(p) * 16 > len(i) * len(j):               # nearly all of a block: one product
                cosine = (x[i] @ x[j].T)[near, far]
            else:
                step = max(1, (1 << 21) // x.shape[1])
                cosine = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[p[k:k + step]], x[r[k:k + step]])
                                                        for k in range(0, len(p), step))])
            linked = cosine / (length[p] * length[r]) >= threshold
            yield p[linked], r[linked]


def _unite(root: np.ndarray, p: np.ndarray, r: np.ndarray) -> None:
    """Connects the places of the pairs: ``root`` is the smallest place
    reached."""
    while len(p):
        a, b = root[p], root[r]
        open_ = a != b
        p, r, a, b = p[open_], r[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _tile_pair(threshold: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("least", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        get = lambda c: group.column(c).combine_chunks()
        ids, first = np.unique(get("id").to_numpy(), return_index=True)      # by id; repeated rows once
        dim = get("dim")[0].as_py()
        x = get("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[first].astype(np.float64)
        copies, tile, a, b = (get(c).to_numpy()[first] for c in ("copies", "tile", "a", "b"))
        left = np.flatnonzero(tile == a)
        right = left if a[0] == b[0] else np.flatnonzero(tile == b)
        root, links = np.arange(len(ids)), np.zeros(len(ids))
        for p, r in close_pairs(x, left, right, threshold):
            links += np.bincount(p, copies[r], len(ids)) + np.bincount(r, copies[p], len(ids))
            _unite(root, p, r)
        linked = np.flatnonzero(links)
        return pa.Table.from_batches([arrays(schema, ids[linked], links[linked].astype(np.int64), ids[root[linked]])])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE,
                    tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Per row ``vec_id``, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable by links, its own included) and
    ``kept`` (the id is its component's)."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    x = F.col("x")
    whole = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.exists(x, lambda c: c != 0)
             & ~F.exists(x, lambda c: F.coalesce(bad(c), F.lit(True))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("x")).withColumn("ok", F.coalesce(whole, F.lit(False)))
    rows = rows.withColumns({"dim": F.when(F.col("ok"), F.size("x")), "h1": F.when(F.col("ok"), F.xxhash64("x")),
                             "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "x"))})
    names = saved(rows.select("vec_id", *CLASS))
    classes = saved(names.where("dim is not null").distinct().groupBy(*CLASS).agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))

    fit = F.greatest(F.lit(2), F.least(F.lit(tile), F.floor(F.lit(tile_bytes) / (8 * F.col("dim")))))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / fit).alias("tiles"))
    one = rows.where("ok").withColumnRenamed("vec_id", "id").join(classes, [*CLASS, "id"])
    dealt = one.join(sizes, ["label", "dim"]).withColumn("tile", F.expr("pmod(h1, tiles)"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "label", "dim", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "id",
        "copies", "x")
    found = saved(pairs.groupBy("label", "dim", "a", "b").applyInArrow(
        _tile_pair(threshold), "id long, links long, least long"))

    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    known = classes.join(links, "id", "left").join(parts, "id", "left").select(
        *CLASS, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component"))
    out = names.join(known, CLASS, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
