"""Canonical JSON: keys sorted, no spaces, no NaN."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(payload: Any) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_json(c: Column) -> Column:
    """The canonical form of JSON text of any shape. Spark's own writers do not sort keys, so this runs in Python, batch by batch."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), allow_nan=False))

    return run(c)


def canonical_map(c: Column) -> Column:
    """The same for a map of strings, without leaving the JVM."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
