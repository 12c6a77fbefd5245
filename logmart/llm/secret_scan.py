"""Secret scans with corpus-wide ownership frequency.

Base patterns (fixed values of the contract), leftmost and non-overlapping
per kind, find assignments, access ids and long hex strings. A wider pattern
finds generic candidates: words of 20 or more letters, digits and ``+/_-``
with at least 3 digits and 3 letters. Every candidate's secret is hashed, and
hashes are counted over the whole corpus by distinct repositories and
distinct owners. A hash held by ``max_owners`` owners at most is live-looking
(``live``), one held by more is a widely copied example (``copied``). Live
generic candidates that no base span overlaps are added as spans of kind
``live``; base spans always stay.

Null texts are empty. Rows with a null id keep a null id. Owners that are
null count as one owner.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logmart.llm.common import saved

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "live")
MAX_OWNERS = 2

FOUND = "array<struct<kind:int,s:int,e:int,secret:binary>>"


def _scanner():
    assign = re.compile(ASSIGN.replace("(password", "((?ai:password", 1).replace("key)", "key))", 1))
    access, hexes = re.compile("AKIA[A-Z0-9]{12,}"), re.compile("[0-9a-f]{32,}")
    generic = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
    digest = lambda x: hashlib.blake2b(x.encode(), digest_size=16).digest()

    def scan(text: str) -> list[tuple[int, int, int, bytes]]:
        found = [(0, m.start(), m.end(), digest(m[2])) for m in assign.finditer(text) if len(m[2]) >= 8]
        found += [(1, m.start(), m.end(), digest(m[0])) for m in access.finditer(text)]
        found += [(2, m.start(), m.end(), digest(m[0])) for m in hexes.finditer(text)]
        base = list(found)
        for m in generic.finditer(text):
            w = m[0]
            if sum(c.isdigit() for c in w) >= 3 and sum(c.isalpha() for c in w) >= 3 and not any(
                    s < m.end() and m.start() < e for _, s, e, _ in base):
                found.append((3, m.start(), m.end(), digest(w)))
        return found

    return scan


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
               repo_col: str | None = None) -> DataFrame:
    """Per document: ``doc_id``, ``owner``, ``repo`` (the document itself
    unless a column says otherwise) and ``found``: its candidates."""
    schema = pa.schema([("doc_id", pa.int64()), ("owner", pa.string()), ("repo", pa.string()), (
        "found", pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("secret", pa.binary())])))])

    def run(it):
        scan = _scanner()
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [[dict(zip(("kind", "s", "e", "secret"), x)) for x in scan(t.as_py() or "")] for t in part.column(3)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).cast(schema.field(i).type) for i in range(3)] + [pa.array(found, schema.field(3).type)],
                    schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                       F.col(repo_col or id_col).cast("string").alias("repo"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, owner string, repo string, found {FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """``secret``, ``n_repos``, ``n_owners`` over the corpus: distinct pairs
    first, so a secret copied by a third of all rows is spread."""
    each = found.select("owner", "repo", F.explode("found").alias("f")).select("owner", "repo", "f.secret").distinct()
    owners = each.groupBy("secret", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("secret").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str | None = None, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per document ``doc_id`` and ``spans``: array of (s, kind, e, n_repos,
    n_owners, live), in order; kind is a place in ``KINDS``."""
    found = saved(candidates(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.*").join(ownership(found), "secret")
    each = each.withColumn("live", F.col("n_owners") <= max_owners).where("kind < 3 or live")
    spans = each.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("s", "kind", "e", "n_repos", "n_owners", "live"))).alias("spans"))
    none = F.array().cast("array<struct<s:int,kind:int,e:int,n_repos:bigint,n_owners:bigint,live:boolean>>")
    return found.select("row", "doc_id").join(spans, "row", "left").select(
        "doc_id", F.coalesce("spans", none).alias("spans"))


def span_digests(scanned: DataFrame) -> DataFrame:
    """The counts and digests of every document's spans."""
    name = lambda x: F.concat_ws(
        ":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"]), x["s"].cast("string"), x["e"].cast("string"))
    text = lambda a: F.array_join(F.transform(a, name), ",")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
