"""Exact quantiles of groups of any size: a mergeable sketch brackets each rank, and only what lies within the bracket is gathered.

The first pass sums a group's sketch (map-side, like any sum), whose values below and above a rank are at most a stated share of the group apart. The second
counts exactly what is under, at and over either value, and collects the values strictly between them; the value of the rank is picked
from these. So a task holds some 6 / ACCURACY of a group for each quantile, never a group, and ties are counted, not collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.tables import same

#: A sketch's ranks are right to one in so many of a group.
ACCURACY = 20_000


def _value_at(k: Column, x: Column) -> Column:
    """The value of rank `k` (from 0) by the counts around a bracket. Sketches may be one rank off besides their error, hence the neighbours."""
    outside = (k < x["under_low"] - 1) | (k > x["upto_high"])
    return (
        F.when(outside, F.raise_error(F.lit("a rank is outside its bracket")).cast("double"))
        .when(k < x["under_low"], x["below"])
        .when(k < x["upto_low"], x["low"])
        .when(k < x["under_high"], F.get(x["inside"], (k - x["upto_low"]).cast("int")))
        .when(k < x["upto_high"], x["high"])
        .otherwise(x["above"])
    )


def with_quantiles(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float], aggregates: list[Column] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(by, aggregates, quantiles by name) of each group: quantiles of the values that are not NULL, by linear interpolation; NULL where there are none.

    Groups with a NULL key are groups like any other, NaN is the largest value. No rows give no groups (without keys: one row of NULLs)."""
    plain = rows.withColumn("__v", F.col(value).cast("double"))
    edges = [min(1.0, max(0.0, p + side * 3 / accuracy)) for p in quantiles.values() for side in (-1, 1)]
    sketched = plain.groupBy(*by).agg(*(aggregates or []), F.count("__v").alias("__n"), F.percentile_approx("__v", F.array(*map(F.lit, edges)), accuracy).alias("__edges"))
    own = [c for c in sketched.columns if c not in by]
    sketched = sketched.select(*by, F.struct(*own).alias("__own"))
    # Rows without a value count nowhere; the groups of such rows alone are added from the first pass, which has the same columns here, so that it is not made twice.
    values = plain.where("__v IS NOT NULL").select(*by, "__v")
    empty = sketched.where("__own.__n = 0 AND (__own.__edges IS NULL OR size(__own.__edges) >= 0)")
    met = values.join(sketched, same(values, sketched, by)).select(*(values[c] for c in by), "__v", "__own")
    v, counted = F.col("__v"), []
    for i in range(len(quantiles)):
        low, high = F.col("__own.__edges")[2 * i], F.col("__own.__edges")[2 * i + 1]
        counted.append(
            F.struct(
                F.count_if(v < low).alias("under_low"), F.count_if(v <= low).alias("upto_low"), F.count_if(v < high).alias("under_high"), F.count_if(v <= high).alias("upto_high"),
                F.max(F.when(v < low, v)).alias("below"), F.min(F.when(v > high, v)).alias("above"), F.first(low).alias("low"), F.first(high).alias("high"),
                F.sort_array(F.collect_list(F.when((v > low) & (v < high), v))).alias("inside"),
            ).alias(f"__q{i}")
        )
    # A group's own figures are a key, not an aggregate: where no quantile is asked for, an aggregate of structs would sort all rows.
    groups = met.groupBy(*by, "__own").agg(*counted)
    groups = groups.unionByName(empty.select(*by, "__own", *(F.lit(None).cast(groups.schema[f"__q{i}"].dataType).alias(f"__q{i}") for i in range(len(quantiles)))))
    n, out = F.col("__own.__n"), []
    for i, (name, p) in enumerate(quantiles.items()):
        place = F.lit(float(p)) * (n - 1)
        first, last = (_value_at(f(place).cast("long"), F.col(f"__q{i}")) for f in (F.floor, F.ceil))
        out.append(F.when(n > 0, F.when(F.floor(place) == F.ceil(place), first).otherwise(first + (last - first) * (place - F.floor(place)))).alias(name))
    return groups.select(*by, *(F.col(f"__own.{c}").alias(c) for c in own if not c.startswith("__")), *out)
