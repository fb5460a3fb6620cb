"""Small numeric rules: capped terms, bands, tri-state ladders, coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capped(value: Column, per: float, cap: float) -> Column:
    return F.when(value.isNotNull(), F.least(value * F.lit(per), F.lit(cap)))


def repair_complexity(impl: Column, diversity: Column, churn: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.15) * impl + F.lit(0.1) * diversity + churn / F.lit(2000.0))


def complexity_band(x: Column) -> Column:
    return F.when(x < 0.33, "low").when(x < 0.66, "medium").otherwise("high")


def depth_band(total: Column) -> Column:
    """Depth 0 to 6 of a weighted total; null stays null."""
    out = F.when(total.isNull(), F.lit(None).cast("int"))
    for i, top in enumerate((0.5, 3.0, 7.0, 14.0, 28.0, 55.0)):
        out = out.when(total < top, i)
    return out.otherwise(6)


def clamp(raw: Column, low: int, high: int, default: int | None = None) -> Column:
    """Whole number inside bounds; what isn't a number gives the default."""
    n = raw.try_cast("int")
    return F.coalesce(F.when(n.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), n))), F.lit(default))


def share(part: Column, whole: Column) -> Column:
    """Null where nothing was measured."""
    return part / F.nullif(whole, F.lit(0))


def index_of(*flags: Column) -> Column:
    """Number of true flags, null where one is not measured."""
    total, known = F.lit(0), F.lit(True)
    for f in flags:
        total, known = total + f.cast("int"), known & f.isNotNull()
    return F.when(known, total)


def csv_cell(c: Column, kind: str) -> Column:
    """Text of a CSV cell: null is empty, booleans are lower case, nested values are JSON."""
    if kind == "boolean":
        return F.coalesce(F.when(c, "true").when(~c, "false"), F.lit(""))
    if kind.startswith("map"):
        return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))), F.lit(""))
    return F.coalesce(F.to_json(c) if kind.startswith(("array", "struct")) else c.cast("string"), F.lit(""))


def row_status(timed_out: Column, available: Column, requested: Column) -> Column:
    """timed_out before unavailable before skipped before measured."""
    return F.when(timed_out, "timed_out").when(requested & ~available, "unavailable").when(~requested, "skipped").otherwise("measured")


def day_span(first: Column, last: Column) -> Column:
    """Whole days between two instants, rounded down."""
    return F.floor((F.unix_timestamp(last) - F.unix_timestamp(first)) / 86400)
