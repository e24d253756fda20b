"""Sizes with SI prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SI prefixes a 64-bit count can need, by power of a thousand; what is not positive gets the smallest.
PREFIXES = ("", "k", "M", "G", "T", "P", "E")
SMALLEST = "q"


def human_readable(n: Column, unit: str) -> Column:
    """Whole number ``n`` with two decimals and a prefix.

    An exact power of a thousand above 1 keeps the smaller prefix (1000 gives ``1000.00 ``); zero and negative numbers
    use the smallest prefix. Decimal arithmetic keeps rounding exact; null stays null.
    """
    value = n.cast("decimal(20,0)")
    text = lambda number, prefix: F.concat(number.cast("decimal(30,2)").cast("string"), F.lit(f" {prefix}{unit}"))
    zeros = F.when(value == 0, F.lit("")).otherwise(F.lit("0" * 30))
    out = F.when(value <= 0, F.concat(value.cast("string"), zeros, F.lit(f".00 {SMALLEST}{unit}")))
    for power in range(len(PREFIXES) - 1, 0, -1):
        divisor = 1000**power
        scaled = F.round(value / F.lit(divisor).cast("decimal(19,0)"), 2)
        out = out.when(value > divisor, text(scaled, PREFIXES[power]))
    return out.when(value.isNotNull(), text(value, PREFIXES[0]))


#: SI prefixes by power of a thousand, from the smallest.
ALL_PREFIXES = ("q", "r", "y", "z", "a", "f", "p", "n", "µ", "m", "", "k", "M", "G", "T", "P", "E", "Z", "Y", "R", "Q")
LEAST_POWER = -10


def human_readable_float(n: Column, unit: str, precision: int = 2) -> Column:
    """:func:`human_readable` of floating-point numbers, with all prefixes and any precision.

    An exact power of a thousand keeps the smaller prefix, but 1 has none; what is not above the smallest power gets its
    prefix. Halves are rounded away from zero in the shortest decimal form of the quotient; null stays null.
    """
    value = n.cast("double")
    shown = lambda power, prefix: F.concat(
        F.format_string(f"%.{precision}f", value / F.lit(float(f"1e{3 * power}"))), F.lit(f" {prefix}{unit}")
    )
    steps = list(enumerate(ALL_PREFIXES, LEAST_POWER))
    out = None
    for power, prefix in reversed(steps[1:]):
        limit = F.lit(float(f"1e{3 * power}"))
        above = value >= limit if not prefix else value > limit
        out = F.when(above, shown(power, prefix)) if out is None else out.when(above, shown(power, prefix))
    return out.when(value.isNotNull(), shown(*steps[0]))
