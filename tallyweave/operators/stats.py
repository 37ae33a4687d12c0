"""Order statistics, error bars, histograms and size reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.quantiles import with_quantiles


def stat_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: n, mean, standard error (0 for one value), median and quartiles (linear interpolation). Groups may be of any size."""
    return with_quantiles(rows.where(F.col(value).isNotNull()), by, value, {"median": 0.5, "q25": 0.25, "q75": 0.75}, _means(value))


def _means(value: str) -> list[Column]:
    sem = F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), sem.alias("sem")]


def mean_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: n, mean and standard error, as `stat_summary` gives them, in one pass without quantiles."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(*_means(value))


def error_bars(stats: DataFrame, robust: bool) -> DataFrame:
    """Centre and arms: mean and standard error, or median and distances to the quartiles, never below 0."""
    if not robust:
        return stats.withColumns({"centre": F.col("mean"), "below": F.col("sem"), "above": F.col("sem")})
    return stats.withColumns({"centre": F.col("median"), "below": F.greatest(F.col("median") - F.col("q25"), F.lit(0.0)), "above": F.greatest(F.col("q75") - F.col("median"), F.lit(0.0))})


def axis_bounds(bars: DataFrame, cap: float = 100.0) -> DataFrame:
    """One row: the upper bound (a tenth above the highest bar, at most `cap`) and the floor of a logarithmic axis (half the least positive centre)."""
    return bars.agg(F.least(F.max(F.col("centre") + F.col("above")) * 1.1, F.lit(cap)).alias("upper"), (F.min(F.when(F.col("centre") > 0, F.col("centre"))) / 2).alias("log_floor"))


def histogram(rows: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin from 0, n) over equal bins from the least to the greatest value; the last bin holds its upper end. The bounds are one row."""
    bounds = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return rows.where(F.col(value).isNotNull()).join(F.broadcast(bounds)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def char_totals(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    return texts.groupBy(*by).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"), F.count("*").alias("files"))


def over_limit(totals: DataFrame, limit: int, size: str = "chars") -> DataFrame:
    """Totals with a flag for those over the limit, largest first."""
    return totals.withColumn("over", F.col(size) > limit).orderBy(F.desc(size))


def confusion(judge: str | Column, human: str | Column) -> Column:
    """TP, FP, TN or FN of a judge's flag against a person's; NULL where either is unknown."""
    j, h = (F.col(c) if isinstance(c, str) else c for c in (judge, human))
    return F.when(j & h, "TP").when(j & ~h, "FP").when(~j & ~h, "TN").when(~j & h, "FN")
