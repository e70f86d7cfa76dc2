"""Unions of many relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of relations with the same column order, paired up level by level.

    Spark analyses every intermediate union. Pairing keeps those small, and the optimizer flattens
    the tree into one union anyway.
    """
    level = list(parts)
    while len(level) > 1:
        level = [level[i].union(level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]
