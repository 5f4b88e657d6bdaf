"""Seeded choice of bounded training samples, and sparse rows for learners that run on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: Column, rows: int, seed: int = 1) -> DataFrame:
    """Rows of ``df`` chosen by a hash of ``key``: about ``rows`` of them, or all if there are no more.

    The choice follows from the key, so that it is the same however often it is
    evaluated.
    """
    total = df.count()
    if total <= rows:
        return df
    share = rows / total
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) < int(share * (1 << 40)))


def sample_of_distinct(df: DataFrame, key: list[str], rows: int, seed: int = 1) -> DataFrame:
    """One row for each of about ``rows`` values of the ``key`` columns, chosen by a hash, or for all if there are no more.

    The choice follows from the key, so that it is the same however often it is
    evaluated.  Rows that repeat a key count once, so that the bound holds whatever
    the rows.
    """
    keyed = df.withColumn("_chosen_by", F.xxhash64(F.lit(seed), *key))
    total = keyed.select("_chosen_by").distinct().count()
    if total > rows:
        share = rows / total
        keyed = keyed.where(F.pmod("_chosen_by", F.lit(1 << 40)) < int(share * (1 << 40)))
    return keyed.dropDuplicates(["_chosen_by"]).drop("_chosen_by")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def take_rows(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the chosen rows' values, number of the chosen row each belongs to)."""
    length = offsets[rows + 1] - offsets[rows]
    owner = np.repeat(np.arange(len(rows)), length)
    first = np.cumsum(length) - length
    return np.arange(length.sum()) - first[owner] + offsets[rows][owner], owner
