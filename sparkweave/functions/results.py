"""Timing results: mean over copies, filters, and a merged JSON file."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_results(results: DataFrame, **equal) -> DataFrame:
    """Rows of (kind, algorithm, graph, workers, seconds) whose columns equal all given values."""
    for name, value in equal.items():
        results = results.where(F.col(name) == value)
    return results


def mean_results(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean milliseconds by ``by``; null seconds don't count."""
    return results.groupBy(*by).agg((F.avg("seconds") * 1000).alias("ms"))


def merge_json(path: str, kind: str, algorithm: str, graph: str, workers: int, seconds: float) -> dict:
    """Put a time into the file's kind, algorithm, graph and workers, over what is there, and leave the rest."""
    file = Path(path)
    data = json.loads(file.read_text()) if file.exists() else {}
    data.setdefault(kind, {}).setdefault(algorithm, {}).setdefault(graph, {})[str(workers)] = seconds
    file.write_text(json.dumps(data, indent=1, sort_keys=True))
    return data
