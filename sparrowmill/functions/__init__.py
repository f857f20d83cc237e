"""Scalar expressions that come out the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAD_STATUS = ("cancelled", "refunded")


def ratio_round(num: Column, den: Column, digits: int) -> Column:
    """num / den rounded half away from zero, in whole numbers until the last division; null where den is 0.

    Decimal averages and ratios have another type and scale on each engine; this has none.
    """
    ten = 10**digits
    n, d = num.cast("decimal(38,0)"), F.nullif(den.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    whole = F.floor((F.abs(n) * (2 * ten) + d) / (d * 2))
    return F.signum(n) * whole.cast("double") / float(ten)


def ratio_sql(num: str, den: str, digits: int) -> str:
    """DuckDB text of ratio_round."""
    ten = 10**digits
    return f"(sign({num}) * CAST((abs(CAST({num} AS HUGEINT)) * {2 * ten} + nullif({den}, 0)) // (nullif({den}, 0) * 2) AS DOUBLE) / {float(ten)})"


def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def valid(status: Column) -> Column:
    """An order that counts as revenue."""
    return ~status.isin(*BAD_STATUS)


def title_or_default(title: Column, item: Column) -> Column:
    return F.coalesce(title, F.concat(F.lit("Item "), item.cast("string")))


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with the small constant that keeps zero vectors finite."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)
