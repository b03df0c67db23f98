"""FN9-FN11, FN14, FN17, FN20: text parsing and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpoint.functions.normalize import JS_WHITESPACE, _col, js_trim, text_or_empty

# -- fixed values: patterns ---------------------------------------------------
LAST_NUMBER_PATTERN = r"(\d+(\.\d+)?)"          # server-side promo price
WHOLE_NUMBER_PATTERN = r"(\d+)"                 # client-side variant
PRODUCT_VARIANT_PATTERN = r"\(([^()]*)\)\s*$"    # final "(...)" of a name
LABEL_CUT = 20                                   # chart label length


# FN9 ------------------------------------------------------------------------
def last_number(c, whole_digits_only: bool = False) -> Column:
    """Last number in the text as DOUBLE, 0 when there is none."""
    pattern = WHOLE_NUMBER_PATTERN if whole_digits_only else LAST_NUMBER_PATTERN
    found = F.try_element_at(F.regexp_extract_all(text_or_empty(c), F.lit(pattern), 1), F.lit(-1))
    return F.coalesce(found.cast("double"), F.lit(0.0))


# FN10 -----------------------------------------------------------------------
def product_name_parts(c) -> Column:
    """``struct(name, variant)``: a final ``(...)`` without inner brackets is the
    variant; when either part would be empty the name is kept whole."""
    source = F.coalesce(_col(c).cast("string"), F.lit(""))
    variant = js_trim(F.regexp_extract(source, PRODUCT_VARIANT_PATTERN, 1))
    base = F.rtrim(F.regexp_replace(source, PRODUCT_VARIANT_PATTERN, ""), F.lit(JS_WHITESPACE))
    ok = source.rlike(PRODUCT_VARIANT_PATTERN) & (base != "") & (variant != "")
    return F.struct(F.when(ok, base).otherwise(source).alias("name"),
                    F.when(ok, variant).otherwise(F.lit("")).alias("variant"))


# FN11 -----------------------------------------------------------------------
def mobile_digits(c) -> Column:
    return F.substring(F.regexp_replace(text_or_empty(c), r"\D", ""), 1, 11)


def ph_mobile(c) -> Column:
    """``#### ### ####`` for an 11-digit ``09`` number, else ``''``."""
    d = mobile_digits(c)
    formatted = F.concat_ws(" ", F.substring(d, 1, 4), F.substring(d, 5, 3), F.substring(d, 8, 4))
    return F.when((F.length(d) == 11) & d.startswith("09"), formatted).otherwise(F.lit(""))


def ph_mobile_partial(c) -> Column:
    """Client-side formatting while typing: the non-empty groups joined by spaces."""
    d = mobile_digits(c)
    n = F.length(d)
    return F.concat_ws(" ", F.when(n > 0, F.substring(d, 1, 4)),
                       F.when(n > 4, F.substring(d, 5, 3)),
                       F.when(n > 7, F.substring(d, 8, 4)))


# FN14 -----------------------------------------------------------------------
def weekday_short(d) -> Column:
    return F.date_format(_col(d), "EEE")


def month_short(d) -> Column:
    return F.date_format(_col(d), "MMM")


def long_date(d) -> Column:
    return F.date_format(_col(d), "MMM d, yyyy")


def php_currency(x) -> Column:
    """en-PH currency text: ``₱1,234.50``; negatives as ``-₱1,234.50``."""
    v = _col(x).cast("decimal(38,2)")
    body = F.concat(F.lit("₱"), F.format_number(F.abs(v), 2))
    return F.when(v < 0, F.concat(F.lit("-"), body)).otherwise(body)


def short_label(c, width: int = LABEL_CUT) -> Column:
    s = text_or_empty(c)
    return F.when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("..."))).otherwise(s)


# FN17 -----------------------------------------------------------------------
def device_name_from_agent(c) -> Column:
    ua = F.lower(text_or_empty(c))
    browser = (F.when(ua.contains("edg/"), F.lit("Edge"))
                .when(ua.contains("firefox/"), F.lit("Firefox"))
                .when(ua.contains("chrome/") | ua.contains("crios/"), F.lit("Chrome"))
                .when(ua.contains("safari/"), F.lit("Safari"))
                .otherwise(F.lit("Browser")))
    platform = (F.when(ua.contains("android"), F.lit("Android"))
                 .when(ua.contains("iphone") | ua.contains("ipad"), F.lit("iOS"))
                 .when(ua.contains("windows"), F.lit("Windows"))
                 .when(ua.contains("mac os"), F.lit("macOS"))
                 .when(ua.contains("linux"), F.lit("Linux"))
                 .otherwise(F.lit("this device")))
    return F.concat(browser, F.lit(" on "), platform)


# FN20 -----------------------------------------------------------------------
def js_number_text(x) -> Column:
    """Number -> text the way JavaScript prints it below 1e21: plain digits, no
    trailing zeros (``50``, ``12345678.9``). Formatted from DECIMAL; a DOUBLE
    would print 1.23456789E7."""
    v = _col(x).cast("decimal(38,10)")
    return F.regexp_replace(F.regexp_replace(v.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def load_value_and_amount(load_type, promo_name, promo_price, regular_amount) -> Column:
    """``struct(load_value, amount)`` for an eLoad entry.

    promo: the promo name, priced by the catalogue or else by the last whole
    number in its name; regular: ``Regular N`` (blank when N is 0)."""
    is_promo = _col(load_type) == "promo"
    promo_amt = F.when(F.coalesce(_col(promo_price), F.lit(0)) != 0, _col(promo_price).cast("double")) \
                 .otherwise(last_number(promo_name, whole_digits_only=True))
    reg_amt = F.coalesce(_col(regular_amount).cast("double"), F.lit(0.0))
    reg_val = F.when(reg_amt != 0, F.concat(F.lit("Regular "), js_number_text(reg_amt))).otherwise(F.lit(""))
    return F.struct(F.when(is_promo, text_or_empty(promo_name)).otherwise(reg_val).alias("load_value"),
                    F.when(is_promo, promo_amt).otherwise(reg_amt).alias("amount"))
