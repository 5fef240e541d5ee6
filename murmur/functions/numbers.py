"""Numbers as dashboards show them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Halves go up, of negative numbers too."""
    return F.floor(x + F.lit(0.5))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(100.0 * part / whole)).otherwise(F.lit(0)).cast("long")


def nice_ceil(x: Column, least: int = 4) -> Column:
    """The next 1, 2, 5 or 10 times a power of ten."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    lead = x / power
    return F.when(x <= 0, F.lit(float(least))).otherwise(power * F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10))


def delta_label(delta: Column, suffix: str) -> Column:
    sign = F.when(delta > 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(delta == 0, F.lit("No change")).otherwise(F.concat(sign, delta.cast("string"), F.lit(f" {suffix}")))


def currency(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(half_up(value), 0))


def parsed(x: Column) -> Column:
    """The number that a text begins with, as a form reads it; 0 for none."""
    return F.coalesce(F.regexp_extract(F.ltrim(x), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double"), F.lit(0.0))


def useful_sizes(loaded: Column, sizes: list[int]) -> Column:
    """Of the page sizes, ascending, the first and those larger than one that already shows all."""
    return F.filter(F.array(*map(F.lit, sizes)), lambda s, i: (i == 0) | (loaded > F.element_at(F.array(*map(F.lit, sizes)), F.greatest(i, F.lit(1)))))
