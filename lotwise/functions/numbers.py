"""Numbers and dates: rounding, prices, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.text import compatible

MICROS_PER_DAY = 86_400_000_000


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round with ties toward plus infinity (``F.round`` sends negative ties away from zero)."""
    if digits == 0:
        return F.floor(value + F.lit(0.5)).cast("double")
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def parse_eur_cents(text: Column) -> Column:
    """Displayed price to cents: free words are 0, otherwise a euro sign is required.

    Exactly two digits after the last separator are cents; every other separator groups digits.
    """
    value = F.trim(compatible(text))
    digits = F.regexp_replace(value, r"[^0-9.,]", "")
    has_cents = digits.rlike(r"[.,][0-9]{2}$")
    euros = F.regexp_replace(
        F.when(has_cents, F.regexp_replace(digits, r"[.,][0-9]{2}$", "")).otherwise(digits),
        r"[^0-9]",
        "",
    )
    cents = F.when(has_cents, F.regexp_extract(digits, r"([0-9]{2})$", 1)).otherwise(F.lit("00"))
    # Fifteen euro digits keep the amount inside the exact integers of a double.
    amount = F.when(
        (euros != "") & (F.length(F.ltrim(euros, F.lit("0"))) <= 13),
        F.concat(F.lit("0"), euros).cast("decimal(38,0)").cast("bigint") * 100 + cents.cast("bigint"),
    )
    return F.when(value.rlike(r"(?iu)^(?:free|gr[aá]tis|gratuito)$"), F.lit(0).cast("bigint")).when(
        F.contains(value, F.lit("€")), amount
    )


def is_price_text(text: Column) -> Column:
    return text.rlike(
        r"(?iu)^(?:€\s*[\d., ]+|[\d., ]+\s*€|free|grátis|gratuito|contact seller"
        r"|contactar vendedor|preço sob consulta)$"
    )


def age_days(at: Column, evaluated_at: Column) -> Column:
    """Fractional days since ``at``; infinite when it is missing or in the future."""
    days = (F.unix_micros(evaluated_at) - F.unix_micros(at)) / F.lit(float(MICROS_PER_DAY))
    return F.when(days >= 0, days).otherwise(F.lit(float("inf")))


def whole_age_days(at: Column, evaluated_at: Column) -> Column:
    """Whole days since ``at``; null when it is missing or in the future."""
    micros = F.unix_micros(evaluated_at) - F.unix_micros(at)
    return F.when(micros >= 0, F.floor(micros / F.lit(MICROS_PER_DAY)))


def vehicle_age(year: Column, evaluated_at: Column) -> Column:
    """Years since registration between 0 and 100; unknown counts as 100."""
    age = F.least(F.lit(100), F.greatest(F.lit(0), F.year(evaluated_at) - year))
    return F.when(year.isNull(), F.lit(100)).otherwise(age)


def in_days(at: Column, evaluated_at: Column, days: int) -> Column:
    """True when ``at`` lies in the ``days`` before the evaluation and not after it."""
    return F.coalesce(
        (at <= evaluated_at) & (F.unix_micros(evaluated_at) - F.unix_micros(at) <= F.lit(days * MICROS_PER_DAY)),
        F.lit(False),
    )
