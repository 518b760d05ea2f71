"""Prefix scans over an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.storage import materialize

_PART = "__part"
_OPS = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(op: str, a: Column, b: Column) -> Column:
    return a + b if op == "sum" else F.least(a, b) if op == "min" else F.greatest(a, b)


def prefix_scan(
    df: DataFrame, order: list[str | Column], outs: dict[str, str], op: str = "sum", inclusive: bool = False, reverse: bool = False
) -> DataFrame:
    """``df`` with a column for each of ``outs`` (out: value): ``op`` (sum, min or max) of the values before each row, or up to it (inclusive).

    Rows are dealt by ranges of ``order`` and scanned in each range; what the
    ranges before came to (one row a range) is combined with the scan inside.
    Nothing before a row is 0 for sums and null else; null values count as
    nothing; null order keys come first, or last if ``reverse``. Rows that tie in
    ``order`` are taken in some order, so give keys that tell rows apart. No rows
    give no rows.
    """
    plain = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"__key{i}" for i in range(len(order))]
    rows = df.select("*", *(k.alias(n) for k, n in zip(plain, names, strict=True)))
    ranges = [F.col(n).desc() if reverse else F.col(n).asc() for n in names]
    rows = materialize(rows.repartitionByRange(*ranges).withColumn(_PART, F.spark_partition_id()), "ranges")
    types = dict(df.dtypes)
    kinds = {out: "double" if types[value] in ("double", "float") else "bigint" for out, value in outs.items()}
    nothing = {out: F.lit(0 if op == "sum" else None).cast(kinds[out]) for out in outs}
    values = {out: F.coalesce(F.col(value).cast(kinds[out]), nothing[out]) for out, value in outs.items()}
    totals = rows.groupBy(_PART).agg(*(_OPS[op](values[out]).alias(f"__all_{out}") for out in outs))
    ahead = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(_PART, *(F.coalesce(_OPS[op](f"__all_{out}").over(ahead), nothing[out]).alias(f"__before_{out}") for out in outs))
    inside = Window.partitionBy(_PART).orderBy(*ranges).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = rows.select("*", *(F.coalesce(_OPS[op](values[out]).over(inside), nothing[out]).alias(f"__in_{out}") for out in outs))
    return within.join(F.broadcast(before), _PART).select(  # one row a range
        *(f"`{c}`" for c in df.columns), *(_combine(op, F.col(f"__before_{out}"), F.col(f"__in_{out}")).alias(out) for out in outs)
    )
