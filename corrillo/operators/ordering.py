"""Total orders over a whole table without a window over one partition: rows are dealt to ranges of the order.

The cuts between ranges are values of all order columns, taken from rows that a hash of these columns chooses, so that a
leading value that a third of all rows share is cut as well. A range has one small row (its last values, its sum) that
meets those of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE, MOST_RANGES, CHOSEN_PER_RANGE = 100_000, 16_384, 50
RANGE = "__range"


def cuts(df: DataFrame, order: list[str], per_range: int) -> list[tuple]:
    """Sorted values of the order columns; at most about MOST_RANGES * CHOSEN_PER_RANGE rows meet on the driver."""
    rows = df.count()
    ranges = min(MOST_RANGES, -(-rows // per_range))
    if ranges < 2:
        return []
    one_of = max(1, rows // (ranges * CHOSEN_PER_RANGE))
    chosen = df.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(one_of)) == 0)
    least = chosen.withColumn("__k", F.ntile(ranges).over(Window.orderBy(*order))).groupBy("__k").agg(F.min(F.struct(*order)).alias("o"))
    return [tuple(r["o"]) for r in least.orderBy("__k").collect()][1:]


def dealt(df: DataFrame, order: list[str], per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with the number of its range, found by halving among the cuts."""
    found, kinds = cuts(df, order, per_range), dict(df.dtypes)
    if not found:
        return df.withColumn(RANGE, F.lit(0))
    bounds = F.array(*(F.struct(*(F.lit(None if v is None else str(v)).cast(kinds[c]).alias(c) for c, v in zip(order, cut))) for cut in found))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(found).bit_length()))))
    own = F.struct(*order)
    there = lambda upto: (upto <= len(found)) & (F.get(bounds, upto - 1) <= own)
    return df.withColumn(RANGE, F.aggregate(steps, F.lit(0), lambda at, step: F.when(there(at + step), at + step).otherwise(at)))


def _ranged(df: DataFrame, order: list[str], per_range: int) -> DataFrame:
    return df if RANGE in df.columns else dealt(df, order, per_range)


def _joined(df: DataFrame, per_range: DataFrame) -> DataFrame:
    """At most MOST_RANGES rows are broadcast."""
    return df.join(F.broadcast(per_range), RANGE)


def previous(df: DataFrame, order: list[str], columns: list[str], per_range: int = ROWS_PER_RANGE, keep: bool = False) -> DataFrame:
    """df with previous_<column> of the row before in the order of the columns `order`, which is unique; null for the first."""
    rows, names = _ranged(df, order, per_range), [f"previous_{c}" for c in columns]
    inside = Window.partitionBy(RANGE).orderBy(*order)
    values = F.struct(*(F.col(c).alias(n) for n, c in zip(names, columns)))
    last = rows.groupBy(RANGE).agg(F.max_by(values, F.struct(*order)).alias("__last"))
    before = last.select(RANGE, F.lag("__last").over(Window.orderBy(RANGE)).alias("__before"))
    found = _joined(rows.withColumn("__own", F.lag(values).over(inside)), before)
    found = found.withColumns({n: F.when(F.col("__own").isNotNull(), F.col(f"__own.{n}")).otherwise(F.col(f"__before.{n}")) for n in names})
    return found.drop("__own", "__before", *([] if keep else [RANGE]))


def running(df: DataFrame, order: list[str], value: Column | str, name: str, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with the sum of `value` up to and with each row in the order of the columns `order`, which is unique."""
    rows = _ranged(df, order, per_range).withColumn("__value", F.col(value) if isinstance(value, str) else value)
    inside = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(RANGE).agg(F.sum("__value").alias("__sum")).select(RANGE, F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    found = _joined(rows.withColumn(name, F.sum("__value").over(inside)), sums)
    return found.withColumn(name, F.col(name) + F.col("__ahead")).drop("__value", "__ahead", RANGE)
