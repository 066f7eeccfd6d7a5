"""Claim sets from one file at the driver: YAML where PyYAML is installed, else JSON."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.claims import unique_ids

CLAIM_SCHEMA = "id string, component string, description string, claimed_min double, claimed_max double, claimed_typical double, unit string"


def data_folder() -> Path:
    """$QUARRYLINE_DATA, or ``data`` below the working folder."""
    return Path(os.environ.get("QUARRYLINE_DATA", "data"))


def read(spark: SparkSession, path: Path) -> DataFrame:
    """The claims with an explicit schema; fields of other names are an error, and so is an id that stands twice."""
    text = path.read_text()
    if path.suffix in (".yaml", ".yml"):
        import yaml

        rows = yaml.safe_load(text)
    else:
        rows = json.loads(text)
    names = [x.split()[0] for x in CLAIM_SCHEMA.split(", ")]
    for row in rows:
        if other := set(row) - set(names):
            raise ValueError(f"unknown fields of a claim: {sorted(other)}")
    return unique_ids(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CLAIM_SCHEMA))
