"""Content-addressed WARC archive.

``write`` keeps two tables under one folder: ``payloads`` holds the bytes of
every distinct payload once under its SHA-256, ``records`` the exact header
bytes of every WARC record. ``read`` joins them by digest and gives the
original records back: header, blank line, payload and end of record.

Of records with equal payloads of at least ``min_bytes`` the one with the
smallest id is a response, the others are revisits that name it; shorter
payloads are responses always. A digest is verified when it is written (all
payloads of a digest must agree in length and a second hash) and when it is
read (the bytes are hashed again). Payload bytes are shuffled once to be
written and once to be read.

Headers are lines that end with CR LF, and only there they are taken apart.
A url that holds CR or LF itself is written with ``%``, CR and LF as ``%25``,
``%0D`` and ``%0A`` and marked by a header field, so every url comes back as
it was. Null payloads are empty; null urls give an empty target. A row with a
null id is a response that nothing refers to. Repeated rows are repeated
records with one digest (of equal ids, all rows count as that id).
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 100
CRLF = "\r\n"
ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
ESCAPED = "X-Target-URI-Escaped"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(*fields) -> F.Column:
    """Header bytes; fields are (name, column or None to leave it out)."""
    lines = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit("")))
    return F.encode(F.concat(*lines), "UTF-8")


def _escaped(url):
    for text, code in ESCAPES:
        url = F.replace(url, F.lit(text), F.lit(code))
    return url


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = MIN_BYTES, date: str | None = None) -> None:
    """Write the archive of ``pages`` to ``path``. ``date`` is the records'
    WARC-Date (default: now)."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    src = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    # one row a digest: partial aggregates first, so a hot payload is one row a task
    by = src.groupBy("digest").agg(
        F.min("id").alias("first_id"), F.any_value("payload").alias("payload"), F.min("bytes").alias("lo"),
        F.max("bytes").alias("hi"), F.min(F.xxhash64("payload")).alias("x_lo"), F.max(F.xxhash64("payload")).alias("x_hi"))
    clash = F.raise_error(F.concat(F.lit("two payloads with digest "), F.col("digest")))
    by.select("digest", "first_id", F.when((F.col("lo") == F.col("hi")) & (F.col("x_lo") == F.col("x_hi")), F.col("payload"))
              .otherwise(clash.cast("binary")).alias("payload")).write.mode("overwrite").option(
        "compression", "zstd").parquet(f"{path}/payloads")

    firsts = src.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id")
    rec = src.drop("payload").join(firsts, "digest")
    refers = F.when((F.col("bytes") >= min_bytes) & (F.col("id") != F.col("first_id")), F.col("first_id"))
    kind = F.when(refers.isNotNull(), "revisit").otherwise("response")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    broken = F.col("url").rlike("[\r\n]")
    rec.select("id", "digest", _header(
        ("WARC-Type", kind), ("WARC-Record-ID", urn(F.col("id"))),
        ("WARC-Target-URI", F.when(broken, _escaped(F.col("url"))).otherwise(F.col("url"))),
        (ESCAPED, F.when(broken, F.lit("yes"))), ("WARC-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(refers.isNotNull(), REVISIT)), ("WARC-Refers-To", F.when(refers.isNotNull(), urn(refers))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(refers.isNotNull(), F.lit(0)).otherwise(F.col("bytes")))).alias("header")
    ).write.mode("overwrite").parquet(f"{path}/records")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The original records: ``header``, ``payload`` (the full one, for
    revisits too), ``record`` (the bytes of the WARC record) and the
    header's fields. Payload bytes are checked against their name."""
    store = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("digest")))
    store = store.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
                         .otherwise(wrong.cast("binary")).alias("payload"))
    lines = F.split(F.decode("header", "UTF-8"), CRLF)
    rec = spark.read.parquet(f"{path}/records").withColumn("f", F.map_from_entries(F.transform(
        F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x != ""),
        lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), x.substr(F.instr(x, ": ") + 2, F.length(x)).alias("v")))))
    field = lambda name: F.col("f").getItem(name)
    number = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    url = field("WARC-Target-URI")
    for text, code in ESCAPES[::-1]:
        url = F.replace(url, F.lit(code), F.lit(text))
    rec = rec.select(
        number("WARC-Record-ID").alias("id"), field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.when(field(ESCAPED).isNotNull(), url).otherwise(field("WARC-Target-URI")).alias("url"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha256:(.*)", 1).alias("payload_digest"), "header", "digest")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return rec.join(store, "digest").drop("digest").withColumn(
        "record", F.concat("header", F.lit(CRLF.encode()), body, F.lit((CRLF * 2).encode())))
