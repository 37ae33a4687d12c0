"""Running sums over groups of any size: rows in ranges, sums of the ranges, and offsets, so that no group has to be ordered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.sources.tables import same, written


def prefix_sums(rows: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str | Column], totals: dict[str, str | Column] | None = None, inclusive: bool = True, parts: int | None = None) -> DataFrame:
    """`rows` with a running sum of the group for each of `sums` (name: what is added), in `order`, and the whole group's sum for each of `totals`.

    Rows are dealt out by ranges of keys and order and written once, so that every later step sees the same ranges. A range's rows are summed on their own;
    what stands before a range comes from the ranges' sums, a row for each group and range. Without `inclusive` a row's own value is left out.
    NULLs add nothing, groups with NULL keys are groups like any other, sums before the first value are 0. Rows equal in `order` stay in one range, in any
    order among themselves: end it with a column that parts them. `parts` ranges are made, as many as Spark shuffles by if None.
    """
    totals = totals or {}
    column = lambda c: F.col(c) if isinstance(c, str) else c
    ordered = [column(o) for o in order]
    marked = rows.withColumns({f"__add_{k}": column(c) for k, c in {**sums, **totals}.items()})
    dealt = written(marked.repartitionByRange(*([parts] if parts else []), *by, *ordered).withColumn("__part", F.spark_partition_id()), "ranges")
    of_parts = dealt.groupBy(*by, "__part").agg(*(F.coalesce(F.sum(f"__add_{k}"), F.lit(0)).alias(f"__sum_{k}") for k in {**sums, **totals}))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = of_parts.select(
        *by, "__part",
        *(F.coalesce(F.sum(f"__sum_{k}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k in sums), *(F.sum(f"__sum_{k}").over(group).alias(k) for k in totals),
    )
    within = Window.partitionBy(*by, "__part").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    summed = dealt.withColumns({f"__own_{k}": F.coalesce(F.sum(f"__add_{k}").over(within), F.lit(0)) for k in sums})
    met = summed.join(offsets, same(summed, offsets, [*by, "__part"]))
    return met.select(*(summed[c] for c in rows.columns), *((F.col(f"__before_{k}") + F.col(f"__own_{k}")).alias(k) for k in sums), *totals)
