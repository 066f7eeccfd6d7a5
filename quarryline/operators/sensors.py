"""Sensor readings: statistics, steady windows, cross checks, conditions, verdicts under uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a window must keep to to be steady, and how far a condition may be missed.
STEADY_SHARE, STEADY_LEAST, STEADY_ROWS = 0.01, 1e-6, 5
CONDITION_LEAST, CONDITION_SHARE = 1e-6, 1e-3


def statistics(readings: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean, deviation, extremes, median and outer percentiles; the deviation of one reading is 0."""
    q = lambda p: F.percentile(value, F.lit(p))
    return readings.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), q(0.5).alias("median"), q(0.05).alias("p05"), q(0.95).alias("p95"))


def in_window(readings: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    return readings if low is None or high is None else readings.filter(F.col(column).between(low, high))


def varied(readings: DataFrame, key: str, actuators: list[str]) -> DataFrame:
    """Experiments with the actuators that took more than one value."""
    counts = readings.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(a).alias(a) for a in actuators])
    return counts.select(key, "rows", F.array_compact(F.array(*[F.when(F.col(a) > 1, F.lit(a)) for a in actuators])).alias("varied"))


def cross_check(readings: DataFrame, key: str, sensors: list[str]) -> DataFrame:
    """The first sensor against the mean of the others, and the mean spread of all of them in a row."""
    n = len(sensors)
    others = sum((F.col(s) for s in sensors[1:]), F.lit(0.0)) / (n - 1)
    mean = sum((F.col(s) for s in sensors), F.lit(0.0)) / n
    spread = F.sqrt(sum((F.pow(F.col(s) - mean, 2) for s in sensors), F.lit(0.0)) / (n - 1))
    return readings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(sensors[0]) - others).alias("offset"), F.coalesce(F.stddev_samp(F.col(sensors[0]) - others), F.lit(0.0)).alias("sigma"), F.avg(spread).alias("spread"))


def steady(readings: DataFrame, key: str, order: str, actuator: str, least_rows: int) -> DataFrame:
    """Rows around which the actuator stays put; all rows of an experiment where fewer than ``least_rows`` are such."""
    last = Window.partitionBy(key).orderBy(order).rowsBetween(1 - STEADY_ROWS, 0)
    whole = Window.partitionBy(key)
    bound = F.greatest(F.lit(STEADY_LEAST), STEADY_SHARE * (F.max(actuator).over(whole) - F.min(actuator).over(whole)))
    marked = readings.withColumn("_steady", F.coalesce(F.stddev_samp(actuator).over(last) < bound, F.lit(False)))
    enough = F.count_if("_steady").over(whole) >= least_rows
    return marked.withColumn("_enough", enough).filter("_steady OR NOT _enough").drop("_steady", "_enough")


def std_of_std(readings: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """How much the deviation of the two halves differs; 0 for fewer than four readings."""
    by = Window.partitionBy(key)
    half = readings.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_half", F.row_number().over(by.orderBy(order)) <= F.floor(F.col("_n") / 2))
    sides = half.groupBy(key).agg(F.max("_n").alias("n"), F.stddev_samp(F.when(F.col("_half"), F.col(value))).alias("a"), F.stddev_samp(F.when(~F.col("_half"), F.col(value))).alias("b"))
    return sides.select(key, F.when(F.col("n") < 4, 0.0).otherwise(F.abs(F.col("a") - F.col("b")) / F.sqrt(F.lit(2.0))).alias("std_of_std"))


def combined(*sigmas: Column) -> Column:
    return F.sqrt(sum((F.pow(s, 2) for s in sigmas), F.lit(0.0)))


def holds(value: Column, at: Column, low: Column, high: Column) -> Column:
    """Whether all readings of a group meet a condition (aggregate); without any bound it is met, without readings it isn't."""
    near = F.greatest(F.lit(CONDITION_LEAST), CONDITION_SHARE * F.abs(at))
    fits = F.coalesce(value.between(at - near, at + near), F.lit(True)) if at is not None else F.lit(True)
    fits = fits & F.coalesce(value >= low - CONDITION_LEAST, F.lit(True)) & F.coalesce(value <= high + CONDITION_LEAST, F.lit(True))
    return F.coalesce(F.bool_and(fits & ~F.isnan(value) & value.isNotNull()), F.lit(False))


def verdict(measured: Column, sigma: Column, tolerance: Column, agent: Column, low: Column, high: Column, claimed: Column, stub: Column, unmatched: Column) -> Column:
    """pass, inconclusive or fail; the marks of a measurement that was not taken come first, as NaN compares as the greatest."""
    unsure = combined(sigma, tolerance, agent)
    outside = F.greatest(F.coalesce(low - measured, F.lit(0.0)), F.coalesce(measured - high, F.lit(0.0)), F.lit(0.0))
    apart = F.abs(measured - claimed)
    ranged = F.when(outside == 0, "pass").when(outside <= unsure, "inconclusive").otherwise("fail")
    central = F.when(sigma > tolerance, "inconclusive").when(apart <= tolerance, "pass").when(apart <= unsure, "inconclusive").otherwise("fail")
    return F.when(stub | unmatched, "inconclusive").when(claimed.isNull(), ranged).otherwise(central)


def sweep(claims: DataFrame, low: float, high: float, steps: int = 21) -> DataFrame:
    """Each claim with its upper bound moved from low to high times itself in even steps."""
    return claims.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("claimed_max", F.col("claimed_max") * (low + (high - low) * F.col("k") / (steps - 1)))
