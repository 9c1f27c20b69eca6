"""Products of wide decimals without rounding.

Spark's product of two wide decimals keeps six places. Here a number is a pair: `whole` (its floor, decimal(38,0)) and
`part` (the rest in [0, 1) with 24 places). Factors may have 25 digits before the point and 12 behind it; a product
beyond 38 digits before the point is NULL.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE, PART = "decimal(25,0)", "decimal(12,12)"
_WIDE, _FINE = "decimal(38,0)", "decimal(30,24)"
#: How far Spark's own product and difference may be off: half a unit of the sixth place each.
OFF = Decimal("0.000002")


def split(value: Column, whole: str = WHOLE, part: str = PART) -> tuple[Column, Column]:
    return F.floor(value).try_cast(whole), fraction(value).try_cast(part)


def fraction(value: Column) -> Column:
    """What lies above the floor; a remainder keeps all places, which a wide difference would not."""
    return F.pmod(value, F.lit(Decimal(1)))


def total(wholes: list[Column], parts: list[Column]) -> tuple[Column, Column]:
    """Sum of pairs, carried over so that the part lies in [0, 1)."""
    part = sum(parts[1:], parts[0])
    carry = F.floor(part)
    whole = wholes[0]
    for w in [*wholes[1:], carry]:
        whole = F.try_add(whole, w.try_cast(_WIDE)).try_cast(_WIDE)
    return whole, fraction(part).try_cast(_FINE)


def product_miss(left: Column, right: Column, result: Column) -> tuple[Column, Column]:
    """left * right - result as a pair."""
    (a, b), (c, d) = split(left), split(right)
    e, f = split(result, _WIDE)
    crossed = [a * d, b * c]  # 25 digits times 12 places fit exactly
    wholes = [F.try_multiply(a, c), *(F.floor(x) for x in crossed), -e]
    return total([w.try_cast(_WIDE) for w in wholes], [*(fraction(x).cast(_FINE) for x in crossed), (b * d).cast(_FINE), -f.cast(_FINE)])


def within(pair: tuple[Column, Column], limit: Decimal) -> Column:
    """Whether the absolute value is at most the limit."""
    whole, part = pair

    def bound(value: Decimal) -> tuple[Column, Column]:
        floor = math.floor(value)
        return F.lit(Decimal(floor)), F.lit(value - floor)

    (high, high_part), (low, low_part) = bound(limit), bound(-limit)
    below = (whole < high) | ((whole == high) & (part <= high_part))
    return below & ((whole > low) | ((whole == low) & (part >= low_part)))


def as_double(pair: tuple[Column, Column]) -> Column:
    """The double next to the pair; from 14 digits before the point on it may be the one beside it."""
    whole, part = pair
    small = (whole.try_cast("decimal(13,0)") + part).cast("double")
    return F.coalesce(small, whole.cast("double") + part.cast("double"))


def product_within(left: Column, right: Column, result: Column, limit: Decimal) -> Column:
    """|left * right - result| <= limit. Spark's rounded product decides unless it comes close to the limit."""
    rough = F.abs(F.try_subtract(F.try_multiply(left, right), result))
    clear = F.abs(rough - F.lit(limit)) > F.lit(OFF)
    return F.when(clear, rough <= F.lit(limit)).otherwise(within(product_miss(left, right, result), limit))
