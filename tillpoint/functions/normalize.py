"""FN1-FN8 and FN18: normalisers, codes and coercions as Column expressions.

Every function takes and returns ``Column`` objects built from
``pyspark.sql.functions`` so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpoint import params as P

# -- fixed values: white space that JavaScript's String.trim() removes --------
JS_WHITESPACE = (" \t\n\r\f\u000b\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
                 + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim like JavaScript ``String.trim`` (ASCII and Unicode spaces, line ends, BOM)."""
    return F.trim(_col(c), F.lit(JS_WHITESPACE))


def ascii_lower(c) -> Column:
    """A-Z to lower case and nothing else: how SQLite's LOWER, LIKE and NOCASE fold."""
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_or_empty(c) -> Column:
    """``String(x || "")``: NULL becomes the empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def folded(c) -> Column:
    """trim + lower-case of a possibly NULL text."""
    return F.lower(js_trim(text_or_empty(c)))


# FN1 ------------------------------------------------------------------------
def normalize_item_status(c) -> Column:
    """Low/out spellings map to their label; anything else, NULL too, is In Stock."""
    f = folded(c)
    return (F.when(f.isin("low stock", "low-stock"), F.lit(P.LOW_STOCK))
             .when(f.isin("out of stock", "out-of-stock"), F.lit(P.OUT_OF_STOCK))
             .otherwise(F.lit(P.IN_STOCK)))


# FN2 ------------------------------------------------------------------------
def derive_legacy_status(quantity, reorder_level) -> Column:
    q, r = _col(quantity), _col(reorder_level)
    return (F.when(q <= 0, F.lit(P.OUT_OF_STOCK))
             .when(q <= r, F.lit(P.LOW_STOCK))
             .otherwise(F.lit(P.IN_STOCK)))


# FN3 ------------------------------------------------------------------------
def normalize_inventory_filter(c) -> Column:
    f = F.lower(js_trim(F.coalesce(_col(c).cast("string"), F.lit("all"))))
    return (F.when(f.isin("in stock", "in-stock"), F.lit(P.IN_STOCK))
             .when(f.isin("low stock", "low-stock"), F.lit(P.LOW_STOCK))
             .when(f.isin("out of stock", "out-of-stock"), F.lit(P.OUT_OF_STOCK))
             .when(f.isin("low/out of stock", "low-out-of-stock", "low / out of stock"), F.lit(P.LOW_OR_OUT))
             .otherwise(F.lit("all")))


# FN4 ------------------------------------------------------------------------
def normalize_sales_filter(c) -> Column:
    f = F.lower(js_trim(F.coalesce(_col(c).cast("string"), F.lit("all"))))
    return F.when(f.isin("all", "today", "week", "month"), f).otherwise(F.lit("all"))


# FN5 ------------------------------------------------------------------------
def normalize_role(c) -> Column:
    return F.when(folded(c) == "user", F.lit("User")).otherwise(F.lit("Admin"))


# FN6 ------------------------------------------------------------------------
def normalize_service_type(c) -> Column:
    return F.when(folded(c) == "gcash", F.lit("gcash")).otherwise(F.lit("eload"))


# FN7 ------------------------------------------------------------------------
def padded_code(prefix: str, id_col) -> Column:
    """``prefix`` + id left-padded to 4 digits, never cut (unlike ``lpad``)."""
    return F.format_string(prefix + "%04d", _col(id_col))


def sale_code(id_col) -> Column:
    return padded_code("S", id_col)


def request_code(service_type, id_col) -> Column:
    return F.when(folded(service_type) == "gcash", padded_code("GC", id_col)) \
            .otherwise(padded_code("EL", id_col))


# FN8 ------------------------------------------------------------------------
def normalize_barcode(c) -> Column:
    return js_trim(text_or_empty(c))


def normalize_identity(c) -> Column:
    return F.lower(js_trim(text_or_empty(c)))


def rate_limit_key(c) -> Column:
    t = js_trim(text_or_empty(c))
    return F.when(t == "", F.lit("unknown")).otherwise(t)


# FN18 -----------------------------------------------------------------------
def at_least_one(c) -> Column:
    """``Math.max(1, Number(x) || 1)``: NULL, zero and NaN count as one."""
    v = _col(c).cast("double")
    return F.greatest(F.lit(1.0), F.when(v.isNull() | (v == 0) | F.isnan(v), F.lit(1.0)).otherwise(v))


def name_or_system(c) -> Column:
    """``String(x || "System").trim() || "System"``."""
    t = js_trim(text_or_empty(c))
    return F.when(t == "", F.lit("System")).otherwise(t)
