"""Options of a build: they are part of the manifest's key, so another choice builds anew."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that switch an option off.
OFF = ("0", "false", "no", "off")


def is_on(value: Column, default: bool = True) -> Column:
    """An option's word as a flag; null, which is not set, is the default."""
    return F.coalesce(~F.lower(F.trim(value)).isin(*OFF), F.lit(default))


def switched_on(name: str, default: bool = True) -> bool:
    value = os.environ.get(name)
    return default if value is None else value.strip().lower() not in OFF


@dataclass(frozen=True)
class Options:
    strip_furniture: bool = True
    least_figure_percent: float = 1.0
    front_matter_pages: int = 2
    front_matter_chars: int = 6000

    def key(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)
