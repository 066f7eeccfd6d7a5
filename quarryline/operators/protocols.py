"""Protocols: how a claim's quantity is measured from readings.  A claim names one, and is measured by it.

``claims`` have claim_id, protocol and experiment; ``readings`` have experiment and value.  A protocol is a
function (claims, readings) -> claim_id, measured_value, sigma, sigma_basis and unmatched; each sees the claims that name it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Protocol = Callable[[DataFrame, DataFrame], DataFrame]

PROTOCOLS: dict[str, Protocol] = {}

_NO_NAMES = "cast(array() as array<string>)"


def protocol(name: str):
    def enter(f: Protocol) -> Protocol:
        if name in PROTOCOLS:
            raise ValueError(f"two protocols are called {name}")
        PROTOCOLS[name] = f
        return f

    return enter


def _measured(claims: DataFrame, readings: DataFrame, value: Column, basis: str) -> DataFrame:
    sigma = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    found = readings.groupBy("experiment").agg(value.cast("double").alias("measured_value"), sigma.alias("sigma"))
    return claims.join(found, "experiment").select("claim_id", "measured_value", "sigma", F.lit(basis).alias("sigma_basis"), F.expr(_NO_NAMES).alias("unmatched"))


@protocol("mean")
def mean(claims: DataFrame, readings: DataFrame) -> DataFrame:
    return _measured(claims, readings, F.avg("value"), "std")


@protocol("precision")
def precision(claims: DataFrame, readings: DataFrame) -> DataFrame:
    return _measured(claims, readings, F.coalesce(F.stddev_samp("value"), F.lit(0.0)), "std")


@protocol("range")
def spread(claims: DataFrame, readings: DataFrame) -> DataFrame:
    return _measured(claims, readings, F.max("value") - F.min("value"), "std")


@protocol("engagement_diagnostic")
def engagement_diagnostic(claims: DataFrame, readings: DataFrame) -> DataFrame:
    """Measures nothing: a claim that only asks whether a device engages is always left open."""
    return claims.select("claim_id", F.lit(float("nan")).alias("measured_value"), F.lit(float("nan")).alias("sigma"), F.lit("stub").alias("sigma_basis"), F.array(F.lit("engagement-diagnostic")).alias("unmatched"))


def dispatched(claims: DataFrame, readings: DataFrame) -> DataFrame:
    """Each claim measured by the protocol that it names; one that no protocol has is an error when it is read."""
    known = reduce(DataFrame.unionByName, [f(claims.filter(F.col("protocol") == name), readings) for name, f in PROTOCOLS.items()])
    unknown = claims.filter(~F.coalesce(F.col("protocol").isin(*PROTOCOLS), F.lit(False)))
    error = F.raise_error(F.concat(F.lit("there is no protocol "), F.coalesce("protocol", F.lit("(none)")))).cast("double")
    return known.unionByName(unknown.select("claim_id", error.alias("measured_value"), F.lit(None).cast("double").alias("sigma"), F.lit(None).cast("string").alias("sigma_basis"), F.expr(_NO_NAMES).alias("unmatched")))
