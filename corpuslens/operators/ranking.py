"""Top rows of groups, also of groups far too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, salt: Sequence[str] | None = None, salts: int = 32) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, by window ordering in two steps.

    Every group is first cut into ``salts`` parts by a hash of the ``salt`` columns and each part keeps
    its own first ``k`` rows; only these at most ``k * salts`` rows a group are ranked together. Null
    keys form a group of their own. ``order`` must be total for a defined result on ties.
    """
    part = F.pmod(F.xxhash64(*(salt or df.columns)), F.lit(salts))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("__salt", part).withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= k)
    return cut.withColumn("__rank", F.row_number().over(last)).where(F.col("__rank") <= k).drop("__salt", "__rank")
