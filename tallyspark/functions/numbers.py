"""Column expressions over whole cents, ratios and medians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
#: Blanks and signs that may stand inside a money text.
FILLERS = "[$,  _]"


def cents_of(amount: Column) -> Column:
    """Whole cents of a numeric amount."""
    return F.round(amount * 100).cast("bigint")


def exact_sum(cents: Column) -> Column:
    """Sum that cannot overflow a long."""
    return F.sum(cents.cast(WIDE))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as a double; null, never zero, over zero."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def percent(top: Column, bottom: Column, digits: int = 6) -> Column:
    return F.round(ratio(top, bottom) * 100, digits)


def upper_median(value: str) -> Column:
    """Aggregate: the value at 0-based place n / 2 of the sorted non-null values.

    That is the lower median of the descending order; tasks count their distinct values first, so no key's rows meet in one sort.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def parse_money(text: Column) -> Column:
    """struct(cents, error) of a money text: signs, brackets, fillers; nothing is ever rounded."""
    trimmed = F.trim(F.translate(text, "\t\r\n", "   "))

    def signed(t: Column) -> Column:
        bracketed = t.startswith("(") & t.endswith(")")
        body = F.when(bracketed, F.substring(t, F.lit(2), F.length(t) - 2)).when(t.startswith("-"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)
        return F.struct((bracketed | t.startswith("-")).alias("minus"), F.regexp_replace(body, FILLERS, "").alias("bare"), (t == "").alias("blank"))

    def exact(x: Column) -> Column:
        shaped = x["bare"].rlike(r"^([0-9]+(\.[0-9]{0,2})?|\.[0-9]{1,2})$") & (F.length(x["bare"]) <= 29)
        value = F.concat(F.lit("0"), F.regexp_replace(x["bare"], r"\.$", "")).try_cast("decimal(32,2)") * 100
        return F.struct(shaped.alias("shaped"), F.when(shaped, F.when(x["minus"], -value).otherwise(value)).try_cast("bigint").alias("cents"), x["bare"].alias("bare"), x["blank"].alias("blank"))

    def judged(x: Column) -> Column:
        error = F.when(x["bare"].isNull() | x["blank"], "empty").when(~x["shaped"] & x["bare"].rlike(r"^[0-9]*\.[0-9]{3,}$"), "fraction").when(~x["shaped"], "not_money").when(x["cents"].isNull(), "overflow")
        return F.struct(F.when(x["shaped"], x["cents"]).alias("cents"), error.alias("error"))

    return _let(_let(_let(trimmed, signed), exact), judged)


def parse_money_strict(text: Column) -> Column:
    """Cents of a text with a whole part, a point and exactly two decimals; else null."""
    bare = F.regexp_replace(F.trim(text), "[,$ ]", "")
    negative = bare.rlike(r"^(-|\().*")
    digits = F.regexp_replace(bare, r"^[-(]|\)$", "")
    cents = F.when(digits.rlike(r"^[0-9]+\.[0-9]{2}$"), F.regexp_replace(digits, r"\.", "").try_cast("bigint"))
    return F.when(negative, -cents).otherwise(cents)


def format_money(cents: Column) -> Column:
    """``-$1.05``: no thousands separators."""
    digits = F.regexp_replace(cents.cast("string"), "-", "")
    digits = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    shown = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 2), F.lit("."), F.right(digits, F.lit(2)))
    return F.concat(F.when(cents < 0, "-$").otherwise("$"), shown)


def compact(cents: Column) -> Column:
    """Dollars in B, M or K with 2, 1 or 0 decimals; U+2212 as the minus sign."""
    dollars = F.abs(cents) / 100.0
    sign = F.when(cents < 0, "\u2212").otherwise("")
    body = (
        F.when(dollars >= 1e9, F.concat(F.format_string("%.2f", dollars / 1e9), F.lit("B")))
        .when(dollars >= 1e6, F.concat(F.format_string("%.1f", dollars / 1e6), F.lit("M")))
        .when(dollars >= 1e3, F.concat(F.format_string("%.0f", dollars / 1e3), F.lit("K")))
        .otherwise(F.format_string("%.0f", dollars))
    )
    return F.when(cents.isNotNull(), F.concat(sign, F.lit("$"), body))


def _grouped(whole: Column) -> Column:
    return F.format_number(whole, 0)


def dollars(cents: Column) -> Column:
    """Whole dollars with grouping, half away from zero: -$1,235."""
    return F.concat(F.when(cents < 0, "-$").otherwise("$"), _grouped(F.floor((F.abs(cents) + 50) / 100)))


def exact(cents: Column) -> Column:
    """Dollars and cents with grouping: $1,234.50."""
    size = F.abs(cents)
    return F.concat(F.when(cents < 0, "-$").otherwise("$"), _grouped(F.floor(size / 100)), F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))


def delta(cents: Column) -> Column:
    """A signed compact amount, U+2212 as the minus sign; nothing is $0 without one."""
    return F.when(cents == 0, "$0").otherwise(F.concat(F.when(cents > 0, "+").otherwise("\u2212"), compact(F.abs(cents))))


def percent_label(pct: Column, digits: int = 2) -> Column:
    """A signed percentage; without one the reason, never 0 %."""
    sign = F.when(pct > 0, "+").when(pct < 0, "\u2212").otherwise("")
    return F.when(pct.isNull(), "no authority to take a share of").otherwise(F.concat(sign, F.format_string(f"%.{digits}f", F.abs(pct)), F.lit("%")))


def billions(cents: Column) -> Column:
    """Billions of dollars for a report column of seven."""
    return F.when(cents.isNotNull(), F.format_string("%7.2f", cents / 1e11))


def share_label(part: Column, whole: Column) -> Column:
    """part of whole as a percentage for a report column of six; a dash where either is missing or the whole is nothing."""
    return F.when(part.isNotNull() & (whole > 0), F.format_string("%5.1f%%", part / whole * 100.0)).otherwise("    \u2014")
