"""Column expressions reproducing the request coercions of the source
application (PHP semantics) with Spark built-ins only, ANSI-safe: no
expression here raises on untrusted text.

F1 php_trim, F2 empty_to_null, F3 is_blank, F4 php_int, F5 weight_value,
F6 ilike_contains, F7 lower_equals, F8 default (``coalesce``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logmart.schemas import WEIGHT_TYPE

# PHP trim() strips exactly these characters:
# space, tab, newline, carriage return, NUL and vertical tab.
PHP_TRIM_CHARS = " \t\n\r\x00\x0b"
# PHP numeric prefix after optional leading whitespace (space, tab, newline,
# carriage return, vertical tab, form feed): sign, digits with optional
# fraction (or a bare fraction), optional exponent.
_NUM_PREFIX = r"^[ \t\n\r\x0b\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)"
_INT_ONLY = r"^[+-]?[0-9]{1,18}\z"
_PLAIN_DECIMAL = r"^[0-9]{1,12}(\.[0-9]{1,12})?\z"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def php_trim(c: Column | str) -> Column:
    """``trim()`` with PHP's default character set."""
    return F.btrim(_c(c), F.lit(PHP_TRIM_CHARS))


def is_blank(c: Column | str) -> Column:
    """PHP falsiness of a (trimmed) string: NULL, ``""`` and ``"0"``."""
    t = php_trim(c)
    return t.isNull() | t.isin("", "0")


def empty_to_null(c: Column | str) -> Column:
    """``trim($x) ?: null``."""
    return F.when(is_blank(c), F.lit(None).cast("string")).otherwise(php_trim(c))


def numeric_prefix(c: Column | str) -> Column:
    """Leading numeric text as PHP reads it; '' when there is none."""
    return F.regexp_extract(_c(c), _NUM_PREFIX, 1)


def _usually(x: Column, pattern: str, usual: Column, rest) -> Column:
    """``usual`` where the text ``x`` matches ``pattern``, else ``rest(x)``;
    NULL for NULL. ``rest`` stands in a lambda: its patterns are tried on the
    few texts that need them and not generated once more into each row's code."""
    odd = F.filter(F.array(x), lambda y: y.isNotNull() & ~y.rlike(pattern))
    return F.coalesce(F.when(x.rlike(pattern), usual), F.get(F.transform(odd, rest), F.lit(0)))


def php_int(c: Column | str) -> Column:
    """``(int)$x`` for text: numeric prefix truncated toward zero,
    0 when there is none (``'12abc'`` -> 12, ``'abc'`` -> 0, ``'1e3'`` ->
    1000), saturating at the 64-bit range, 0 for an infinite value.
    NULL (absent) -> 0, as ``?? 0`` gives."""
    x = _c(c)
    return F.coalesce(_usually(x, _INT_ONLY, x.try_cast("long"), _prefix_int), F.lit(0).cast("long"))


def _prefix_int(x: Column) -> Column:
    p = numeric_prefix(x)
    exact = F.when(p.rlike(_INT_ONLY), p.try_cast("long"))
    d = F.when(p != "", p.try_cast("double"))
    # finite values truncate and saturate at the 64-bit range (floor/ceil
    # return bigint, saturating); an infinite one becomes 0
    trunc = (F.when(F.abs(d) == F.lit(float("inf")), F.lit(0))
             .when(d >= 0, F.floor(d)).otherwise(F.ceil(d)))
    return F.coalesce(exact, trunc.try_cast("long"))


def weight_value(c: Column | str) -> Column:
    """``isset($x) && $x !== '' ? (float)$x : null`` stored as
    numeric(6,2): NULL/'' -> NULL, text without a number -> 0.00, rounded
    half up to 2 decimals; NULL when the value does not fit (|x| >= 10^4),
    which the validation step reports as a reject."""
    x = _c(c)
    # PHP reads the prefix as a float; the float's shortest decimal form is
    # then rounded half up to numeric(6,2), NULL when it does not fit
    f = _usually(x, _PLAIN_DECIMAL, x.try_cast("double"), lambda y: F.when(numeric_prefix(y) == "", F.lit(0.0))
                 .otherwise(numeric_prefix(y).try_cast("double")))
    val = f.try_cast(WEIGHT_TYPE)
    return F.when(x.isNull() | (x == ""), F.lit(None).cast(WEIGHT_TYPE)).otherwise(val)


def weight_out_of_range(c: Column | str) -> Column:
    """True when a weight was given but cannot be stored as numeric(6,2)."""
    x = _c(c)
    return x.isNotNull() & (x != "") & weight_value(x).isNull()


def ilike_contains(name: Column | str, term: Column | str) -> Column:
    """``name ILIKE '%' || term || '%'`` with the term's wildcards
    active (see ``latest.search_latest`` for the escape handling)."""
    t = F.regexp_replace(_c(term), r"\\([^%_\\])|(\\[%_\\])", "$1$2")
    return F.ilike(_c(name), F.concat(F.lit("%"), t, F.lit("%")))


def lower_equals(a: Column | str, b: Column | str) -> Column:
    """``a.toLowerCase() === b.toLowerCase()``."""
    return F.lower(_c(a)) == F.lower(_c(b))
