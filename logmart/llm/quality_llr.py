"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Every document is scored against two multinomials over hashed word unigrams
and bigrams: a trusted target (a bounded sample of labelled good documents)
and the raw corpus (all documents). The score is the mean log-likelihood
ratio per n-gram, in fixed point, so it is the same for any task layout:

    score = sum over n-grams round(SCALE * ln(p_target / p_raw)) / n-grams

A document is kept when it passes the base rules and its score is at least
``threshold``. Only built-in functions are used. The corpus counts shuffle
one row per bucket and task; texts are never shuffled. The weights are one
number per bucket (``buckets`` of them, whatever the input), so they travel
as a constant.

Null and empty texts have no words and fail the base rules. Without any
trusted document the ratio has no evidence and every score is 0 (kept).
Documents with a null id are scored like others, but never trusted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 14
TRUSTED = 20_000       # labelled documents of the target at most
SCALE = 1_000_000
PRIOR = 4096          # n-grams that the raw corpus counts for in the target
#: Fixed-point mean log-likelihood ratio below which a document goes.
THRESHOLD = -100_000
MIN_WORDS, REPEAT_PCT = 50, 50


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. A column named by
    withColumn may be copied into a filter or a lambda by the optimizer, and
    then be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(h: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more; ``h`` has
    the hash of the window at each place."""
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    again = _let(placed, lambda s: F.transform(F.filter(
        s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    cover = F.aggregate(
        F.array_sort(again), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + (p + 3 - F.greatest(p, a["end"]))).alias("n")),
        lambda a: a["n"])
    return F.when(F.size(F.array_distinct(h)) < F.size(h), cover).otherwise(F.lit(0).cast("long"))


def _windows(w: Column) -> Column:
    return F.when(F.size(w) > 2, F.transform(
        F.slice(w, F.lit(1), F.size(w) - 2),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _ngrams(w: Column, buckets: int) -> Column:
    """Bucket of every unigram and bigram (letters in lower case)."""
    return _let(F.transform(w, lambda x: F.xxhash64(F.lower(x))), lambda h: F.concat(
        F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int")),
        F.transform(F.slice(h, F.lit(2), F.size(h)), lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i)), F.lit(buckets)).cast("int"))))


def _rules(text: Column, constant: Column, buckets: int) -> Column:
    """All counts and the score of a text as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        total = lambda g: F.when(F.size(g) > 0, F.round(F.aggregate(
            g, F.lit(0).cast("long"), lambda a, b: a + F.get(constant, b)) / F.size(g)).cast("long")).otherwise(
            F.lit(0).cast("long"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _let(_windows(w), _repeat_words).alias("n_repeat_words"),
            _let(_ngrams(w, buckets), total).alias("score"))

    return _let(word_array(text), of)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """At most ``limit`` labelled good ids, those with the smallest hashes."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    good = good.select(F.col("doc_id").cast("long").alias("_trusted")).distinct()
    return good.orderBy(F.xxhash64("_trusted"), "_trusted").limit(limit)


def weights(docs: DataFrame, trusted: DataFrame, text_col: str = "text", id_col: str = "doc_id",
            buckets: int = BUCKETS) -> list[int]:
    """Fixed-point log ratio of every bucket."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grams = plain.join(F.broadcast(trusted), F.col("id") == F.col("_trusted"), "left").select(
        F.col("_trusted").isNotNull().cast("long").alias("t"),
        F.explode(_let(word_array(F.col("text")), lambda w: _ngrams(w, buckets))).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("r"), F.sum("t").alias("t")).collect()  # one row a bucket
    raw, good = sum(x["r"] for x in counts), sum(x["t"] for x in counts)
    out = [0] * buckets
    if good:
        for x in counts:          # the target's share, with the raw corpus as prior of PRIOR n-grams
            share = x["r"] / raw
            out[x["b"]] = round(SCALE * math.log((x["t"] + PRIOR * share) / (good + PRIOR) / share))
    return out


def quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
            buckets: int = BUCKETS, threshold: int = THRESHOLD, limit: int = TRUSTED, prefix: str = "") -> DataFrame:
    """The columns of ``docs`` with the base counts, ``score`` (fixed point)
    and ``kept``, their names after ``prefix``. They take the place of columns
    of the same name; with a prefix that no column has, none is lost. Names
    that begin with ``__`` are kept for work inside."""
    table = weights(docs, trusted_ids(labels, limit), text_col, id_col, buckets)
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = lambda n: prefix + n
    df = docs.withColumn("__r", _rules(text, constant, buckets))
    df = df.withColumns({name(n): F.col("__r")[n] for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")}).drop("__r")
    df = df.withColumn(name("base_failed"), (F.col(name("n_words")) < MIN_WORDS)
                       | (F.col(name("n_repeat_words")) * 100 > F.col(name("n_words")) * REPEAT_PCT))
    return df.withColumn(name("kept"), ~F.col(name("base_failed")) & (F.col(name("score")) >= threshold))
